"""Exact dedup against history through a minimal perfect hash.

History's distinct digests are dealt into buckets of bounded expected size by a hash of the digest.
Each bucket is one row of the index, made by one Arrow function: levels of bit arrays in which a
digest owns a bit that no other digest of its level hashed to, so the number of bits set before its
own is its slot: a minimal perfect hash, about 3.7 bits a digest.  Slots hold the whole digest, the
length of its text, how many rows had it, and a locator of the winner (id and row number).

A lookup sends distinct digests of new rows to their bucket and compares what the slot holds byte by
byte, since the hash gives any other digest some slot too.  Members are repeats of history;
nonmembers are grouped apart.  Texts never leave the task that reads them: only digests, ids and
counts are shuffled, counted before they are, so a group of any size costs a row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.llm.common import U64, as_binary, fmix, join_unique, materialize, shuffle_partitions, table

#: Distinct digests of an index row, on average.
BUCKET = 1024
#: Bits of a level for each digest that is left.
GAMMA = 2
_STEP = U64(0x9E3779B97F4A7C15)
_WIDTH = 32  # bytes of a digest

INDEX = "bucket bigint, sizes array<int>, bits binary, digests binary, n_bytes array<bigint>, copies array<bigint>, winners array<bigint>, rows array<bigint>"
FOUND = "digest binary, member boolean, winner bigint, winner_row bigint, own_winner bigint, own_row bigint, copies bigint"


def _words(digests: np.ndarray) -> np.ndarray:
    """(n, 4) numbers of (n * 32) bytes."""
    return np.ascontiguousarray(digests).view(U64).reshape(-1, _WIDTH // 8)


def _places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Each digest's bit in a level; all of its 256 bits take part."""
    with np.errstate(over="ignore"):
        h = fmix(words[:, 0] + U64(level) * _STEP)
        for k in range(1, words.shape[1]):
            h = fmix(h ^ words[:, k])
    return (h % U64(size)).astype(np.int64)


def build_slots(digests: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """``(sizes, bits, slots)`` of distinct digests: level sizes, all levels' bits, and each digest's slot."""
    left = np.arange(len(digests) // _WIDTH)
    words = _words(digests)
    sizes: list[int] = []
    levels, owners = [], []
    while len(left):
        if len(sizes) == 1000:
            raise ValueError("digests are not distinct")
        size = max(64, GAMMA * len(left))
        at = _places(words[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        owner = np.full(size, -1)
        owner[at[mine]] = left[mine]
        owners.append(owner[alone])
        levels.append(alone)
        sizes.append(size)
        left = left[~mine]
    slots = np.empty(len(words), np.int64)
    order = np.concatenate([np.zeros(0, np.int64), *owners])
    slots[order] = np.arange(len(order))
    return sizes, np.concatenate([np.zeros(0, bool), *levels]), slots


def find_slots(digests: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each digest; -1 or any slot for one that the hash was not built on."""
    words = _words(digests)
    rank = np.concatenate([[0], np.cumsum(bits)])
    out = np.full(len(words), -1)
    left, start = np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        at = start + _places(words[left], level, size)
        hit = bits[at]
        out[left[hit]] = rank[at[hit]]
        left = left[~hit]
        start += size
    return out


def _fixed(raw: np.ndarray) -> pa.Array:
    """Binary array of digests side by side."""
    n = len(raw) // _WIDTH
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * _WIDTH).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows of each bucket from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        b = batch.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]]).tolist()
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if held and b[x] != last:
                yield int(last), pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(x, y - x))
            last = b[x]
    if held:
        yield int(last), pa.Table.from_batches(held).combine_chunks()


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(bucket, digest, n_bytes, copies, winner, winner_row)`` sorted by bucket -> rows of the index."""
    schema = pa.schema([("bucket", pa.int64()), ("sizes", pa.list_(pa.int32())), ("bits", pa.binary()), ("digests", pa.binary()), ("n_bytes", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("winners", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64()))])
    for bucket, t in _by_bucket(batches):
        raw = as_binary(t.column("digest"))[0]
        sizes, bits, slots = build_slots(raw)
        order = np.argsort(slots)
        at = pa.array(order)
        held = raw.reshape(-1, _WIDTH)[order].tobytes()
        lists = [t.column(c).combine_chunks().take(at).to_pylist() for c in ("n_bytes", "copies", "winner", "winner_row")]
        yield pa.RecordBatch.from_pylist([{"bucket": bucket, "sizes": sizes, "bits": np.packbits(bits).tobytes(), "digests": held, "n_bytes": lists[0], "copies": lists[1], "winners": lists[2], "rows": lists[3]}], schema=schema)


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the index (those with sizes) and digests asked for, sorted by bucket, the index first -> FOUND."""
    bucket, index = None, None
    said = ["digest", "member", "winner", "winner_row", "own_winner", "own_row", "copies"]
    for batch in batches:
        names = batch.schema.names
        col = {c: batch.column(i) for i, c in enumerate(names)}
        of = col["bucket"].to_numpy()
        is_index = col["sizes"].is_valid().to_numpy(zero_copy_only=False)
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, np.flatnonzero(is_index), np.flatnonzero(is_index) + 1, [len(of)]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if is_index[a]:
                bucket, index = of[a], {c: col[c].slice(a, 1) for c in ("sizes", "bits", "digests", "n_bytes", "winners", "rows")}
                sizes = index["sizes"][0].as_py()
                bits = np.unpackbits(as_binary(index["bits"])[0])[: sum(sizes)].astype(bool)
                digests = as_binary(index["digests"])[0].reshape(-1, _WIDTH)
                lengths, winners, rows = (index[c].flatten() for c in ("n_bytes", "winners", "rows"))
                continue
            asked = as_binary(col["digest"].slice(a, b - a))[0]
            own = [col[c].slice(a, b - a) for c in ("winner", "winner_row", "count")]
            if index is None or of[a] != bucket:  # no digest of history is in this bucket
                nothing = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([_fixed(asked), pa.array(np.zeros(b - a, bool)), nothing, nothing, *own], said)
                continue
            slot = find_slots(asked, sizes, bits)
            member = slot >= 0
            member[member] = (digests[slot[member]] == asked.reshape(-1, _WIDTH)[member]).all(1)
            member[member] = lengths.to_numpy()[slot[member]] == col["len"].slice(a, b - a).to_numpy()[member]
            at = pa.array(np.where(member, slot, 0), mask=~member)
            yield pa.RecordBatch.from_arrays([_fixed(asked), pa.array(member), winners.take(at), rows.take(at), *own], said)


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, row, digest, n_bytes)`` of every row, stored: SHA-256 and bytes of the text with whitespace runs as one space.

    row numbers the rows and tells repeated ones apart; nulls are empty texts.
    """
    plain = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    out = docs.select(F.col(id_col).cast("long").alias("id"), plain.alias("t"))
    out = out.select("id", F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").cast("long").alias("n_bytes"))
    return materialize(out.withColumn("row", F.monotonically_increasing_id()), "digests")


def distinct_digests(rows: DataFrame) -> DataFrame:
    """``(digest, n_bytes, copies, winner, winner_row)``: of equal texts the smallest id wins, nulls last, then the smallest row."""
    out = rows.groupBy("digest").agg(F.first("n_bytes").alias("n_bytes"), F.count("*").alias("copies"), F.min(_first("id", "row")).alias("w"))
    return out.select("digest", "n_bytes", "copies", F.col("w.id").alias("winner"), F.col("w.row").alias("winner_row"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets))


def build_index(classes: DataFrame, buckets: int) -> DataFrame:
    """The index of ``distinct_digests`` rows, stored: one row a bucket that has digests."""
    dealt = classes.select(_bucket(buckets).alias("bucket"), "digest", "n_bytes", "copies", "winner", "winner_row")
    dealt = dealt.repartition(shuffle_partitions(classes.sparkSession), "bucket").sortWithinPartitions("bucket")
    return materialize(dealt.mapInArrow(_build, INDEX), "index")


def look_up(classes: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Distinct digests with ``member`` and the winner that history's slot holds (null for nonmembers), beside their own winner and copies."""
    own = ["winner", "winner_row", "count"]
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in index.schema if f.name != "bucket"]
    asked = classes.select(_bucket(buckets).alias("bucket"), "digest", F.col("n_bytes").alias("len"), "winner", "winner_row", F.col("copies").alias("count"), *blank)
    nothing = [F.lit(None).cast("binary").alias("digest"), *[F.lit(None).cast("long").alias(c) for c in ("len", *own)]]
    held = index.select("bucket", *nothing, *[c for c in index.columns if c != "bucket"])
    both = held.unionByName(asked).withColumn("asks", F.col("sizes").isNull())
    both = both.repartition(shuffle_partitions(classes.sparkSession), "bucket").sortWithinPartitions("bucket", "asks")
    return both.mapInArrow(_look_up, FOUND)


def _first(winner: str, row: str) -> Column:
    """What orders the rows of a group: null ids last."""
    return F.struct(F.col(winner).isNull().alias("none"), F.col(winner).alias("id"), F.col(row).alias("row"))


def exact_duplicates(docs: DataFrame, id_col: str, text_col: str, history: Column | None = None) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` of every row.

    Texts are equal when they are identical after each run of ASCII whitespace becomes one space;
    nulls count as empty.  Of equal texts the row with the smallest id stays, null ids last; of rows
    that share it too, exactly one stays (any, as they are the same), so kept is true once a group.
    history: a condition on ``id`` that picks the rows that came before the others; left out, the
    rows up to about the middle of the ids.  The result does not depend on it.
    Texts of any length are read whole; an empty table gives an empty result; other columns are
    ignored.
    """
    rows = digests(docs, id_col, text_col)
    if history is None:
        middle = rows.select(F.percentile_approx("id", 0.5)).first()[0]
        history = F.col("id") <= F.lit(middle)
    old = F.coalesce(history, F.lit(False))
    before = materialize(distinct_digests(rows.where(old)), "history")
    buckets = max(1, -(-before.count() // BUCKET))
    found = materialize(look_up(distinct_digests(rows.where(~old)), build_index(before, buckets), buckets), "found")
    # repeats of history add to its counts; the other texts are groups of their own
    known = before.select("digest", _first("winner", "winner_row").alias("w"), "copies")
    repeats = found.where("member").select("digest", F.least(_first("winner", "winner_row"), _first("own_winner", "own_row")).alias("w"), "copies")
    joined = known.unionByName(repeats).groupBy("digest").agg(F.min("w").alias("w"), F.sum("copies").alias("copies"))
    apart = found.where("not member").select("digest", _first("own_winner", "own_row").alias("w"), "copies")
    groups = materialize(joined.unionByName(apart).select("digest", F.col("w.id").alias("winner"), F.col("w.row").alias("winner_row"), "copies"), "groups")
    out = join_unique(rows, groups, ["digest"])
    return out.select("id", F.col("winner").alias("keep_id"), F.col("copies").alias("group_size"), (F.col("row") == F.col("winner_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.withColumnRenamed("id", "doc_id")
