"""Spelling variants of words by permuterm rotations.

Every word gets an end mark and is turned to start at each of its places.  A rotation whose last
character is the one edited has all the rest of the word before it: words that differ in that
character share this prefix, and the word without it has exactly the prefix as a rotation of its
own.  So all rotations, whole and less their last character, are sorted, and a scan of equal runs
finds the neighbours.  A run holds at most one whole rotation and one row for each character of the
alphabet, whatever the data.  No pair is emitted: each word gets a count and its best neighbour from a run.

A replaced character meets its pair in one run.  An inserted one may stand anywhere in a run of
itself ("aab", "aaab"), so only the first of equal characters counts for insertions and deletions.

Rotations of a word of length L take L * L characters.  Beyond LONG code points a rotation is a hash
of 93 bits instead, made from prefix sums modulo three primes, and the word itself is known by its
SHA-256, so long words cost rows of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.llm.common import join_unique, materialize, shuffle_partitions, table

#: Marks the end of a word; not a letter.
END = "$"
#: Longest word whose rotations are written out.
LONG = 64
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Kinds of rotations, as bits: less the edited character, which is the first of its run; the word sorts before the one without it; whole.
FIRST, BEFORE, WHOLE = 1, 2, 4
_PRIMES = (2147483647, 2147483629, 2147483587)
_ROW = "key string, id string, n bigint, last string, kind int"


def words_of(docs: DataFrame, id_col: str, text_col: str, drop_every: int, min_length: int) -> DataFrame:
    """``(word, n)``: runs of letters, A-Z lower-cased, and how often each occurs; nulls count as no text.

    Where drop_every divides the CRC-32 of ``id:run`` (a null id is empty), one of the run's code points is left out.
    Shorter words than min_length are not counted.
    """
    lowered = F.translate(F.col(text_col), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_length)
    code = F.crc32(F.concat("id", F.lit(":"), "run"))
    place = (code % F.length("run")).cast("int")
    short = F.concat(F.col("run").substr(F.lit(1), place), F.col("run").substr(place + 2, F.length("run")))
    word = F.when(code % drop_every == 0, short).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))


def _written_out(words: DataFrame) -> DataFrame:
    """Rotations of ``(word, n)`` as text."""
    w, size = F.col("word"), F.length("word")

    def turned(start: Column, upto: Column) -> Column:
        return F.concat(w.substr(start + 1, size), F.lit(END), w.substr(F.lit(1), upto))

    def less_one(i: Column) -> Column:
        c = w.substr(i + 1, F.lit(1))
        first = F.when((i == 0) | (w.substr(i, F.lit(1)) != c), FIRST).otherwise(0)
        before = F.when(c < F.ltrim(w.substr(i + 1, size), c), BEFORE).otherwise(0)
        return F.struct(turned(i + 1, i).alias("key"), c.alias("last"), (first + before).alias("kind"))

    def whole(i: Column) -> Column:
        return F.struct(turned(i, i).alias("key"), F.lit("").alias("last"), F.lit(WHOLE).alias("kind"))

    both = F.concat(F.transform(F.sequence(F.lit(0), size - 1), less_one), F.transform(F.sequence(F.lit(0), size), whole))
    return words.select(w.alias("id"), "n", F.explode(both).alias("r")).select("r.key", "id", "n", "r.last", "r.kind")


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
    return out[:n]


def _turned_hashes(code: np.ndarray, skip: int) -> list[str]:
    """Hashes of ``code`` turned to start at each place, less the character before the start if skip is 1."""
    size = len(code)
    at = np.arange(size + 1 - skip)
    parts = []
    for k, prime in enumerate(_PRIMES):
        base = 1_000_003 + 7919 * k
        up, down = _powers(base, size + 2, prime), _powers(pow(base, -1, prime), size + 2, prime)
        p = np.concatenate([[0], np.cumsum((code + 1) * up[:size] % prime) % prime])
        tail = (p[size] - p[at + skip]) % prime * down[at + skip] % prime
        head = p[at] * up[size - at - skip + 1] % prime
        parts.append((tail + up[size - at - skip] + head) % prime)
    return [f"#{size - skip}:{a:08x}{b:08x}{c:08x}" for a, b, c in zip(*parts, strict=True)]


def _hashed(long: int):
    """Rotations of ``(word, n, id)`` from ``long`` code points on; words of just so many give whole ones, to meet longer words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, n, ident in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                code = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
                size = len(code)
                keys = _turned_hashes(code, 0)
                last, kind = [""] * len(keys), [np.full(len(keys), WHOLE)]
                if size > long:
                    # the character after each run of equal ones, 0 at the end
                    ends = np.append(np.flatnonzero(code[1:] != code[:-1]) + 1, size)
                    after = np.append(code, 0)[ends[np.searchsorted(ends, np.arange(size), "right")]]
                    first = np.append(True, code[1:] != code[:-1])
                    keys += _turned_hashes(code, 1)
                    last += list(word)
                    kind.append(FIRST * first + BEFORE * (code < after))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([ident] * len(keys)), pa.array(np.full(len(keys), n)), pa.array(last), pa.array(np.concatenate(kind).astype(np.int32))], ["key", "id", "n", "last", "kind"])

    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rotations sorted by (key, falling n, last) -> ``(id, near, best_n, best)``: neighbours that a word has in a run."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        if batch.num_rows < 2:
            held = batch
            continue
        key = batch.column(0)
        new = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(np.append(True, new))[-1])  # the last run may go on in the next batch
        held = batch.slice(last)
        if last:
            yield from _runs(batch.slice(0, last), np.append(True, new[: last - 1]))
    if held is not None and held.num_rows > 1:
        yield from _runs(held, np.append(True, np.zeros(held.num_rows - 1, bool)))


def _runs(batch: pa.RecordBatch, new: np.ndarray) -> Iterator[pa.RecordBatch]:
    run = np.cumsum(new) - 1
    several = (np.bincount(run) > 1)[run]
    if not several.any():
        return
    rows = batch.filter(pa.array(several))
    new = new[several]
    start, run = np.flatnonzero(new), np.cumsum(new) - 1
    n, kind = rows.column(2).to_numpy(), rows.column(4).to_numpy()
    at, none = np.arange(len(n)), len(n)
    whole, first = kind == WHOLE, kind & FIRST == FIRST

    def lowest(which: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(np.where(which, at, none), start)[run]

    def many(which: np.ndarray) -> np.ndarray:
        return np.add.reduceat(which.astype(np.int64), start)[run]

    top = lowest(~whole)
    second = lowest(~whole & (at != top))
    alone = lowest(whole)  # the word without the character
    other = np.where(at == top, second, top)
    # of equal counts the smaller word is best: rows are sorted by their character, the word without it by its flag
    n_of, kind_of = np.append(n, -1), np.append(kind, 0)
    better = (n_of[alone] > n_of[other]) | ((n_of[alone] == n_of[other]) & (kind_of[other] & BEFORE == 0))
    best = np.where(whole, lowest(first), np.where(first & (alone < none) & better, alone, other))
    near = np.where(whole, many(first), many(~whole) - 1 + (first & (alone < none)))
    some = np.flatnonzero(near)
    ids = rows.column(1)
    yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(near[some]), pa.array(n[best[some]]), ids.take(pa.array(best[some]))], ["id", "near", "best_n", "best"])


def spelling_variants(words: DataFrame, ratio: int = 10, long_from: int = LONG) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of distinct ``(word, n)``.

    Words are near when one inserted, deleted or replaced code point makes one of the other.  form
    is the near word of largest n, ties to the first in code-point order, where its n is at least
    ratio times the word's; root follows forms to the last.  Null and empty words are left out; words
    must hold no END and no ``#``; words of any length are compared whole (long_from: the longest
    whose rotations are text); an empty table gives an empty result; other columns are ignored.
    """
    spark = words.sparkSession
    is_long = F.length("word") > long_from
    ident = F.when(is_long, F.concat(F.lit("#"), F.sha2("word", 256))).otherwise(F.col("word"))
    words = materialize(words.where("word <> ''").select("word", F.col("n").cast("long").alias("n"), ident.alias("id")), "words")
    spread = words.repartition(shuffle_partitions(spark), "id")  # a small table is read back in few parts, and each row becomes dozens
    rotations = _written_out(spread.where(~is_long))
    rotations = rotations.unionByName(spread.where(F.length("word") >= long_from).select("word", "n", "id").mapInArrow(_hashed(long_from), _ROW))
    dealt = rotations.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", F.desc("n"), "last")
    found = materialize(dealt.mapInArrow(_scan, "id string, near bigint, best_n bigint, best string"), "near")
    long = words.where(is_long).select(F.col("id").alias("best"), F.col("word").alias("text"))
    if not long.isEmpty():
        found = materialize(join_unique(found, long, ["best"], "left").withColumn("best", F.coalesce("text", "best")).drop("text"), "near")
    best = F.struct((-F.col("best_n")).alias("fewer"), F.col("best").alias("word"))
    own = words.select("id", "word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<fewer:bigint,word:string>").alias("best"))
    seen = found.select("id", F.lit(None).cast("string").alias("word"), F.lit(None).cast("long").alias("n"), "near", best.alias("best"))
    every = own.unionByName(seen).groupBy("id").agg(F.max("word").alias("word"), F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    form = F.when(-F.col("best.fewer") >= ratio * F.col("n"), F.col("best.word"))
    every = every.withColumn("form", form).select("word", "form", "n", "n_near", F.when(F.col("form").isNotNull(), -F.col("best.fewer")).alias("form_n"))
    every = materialize(every, "variants")
    roots = _roots(every.where("form is not null").select("word", F.col("form").alias("root")))
    out = every.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """``(word, root)``: each word's form followed to the last; each round doubles the steps taken, and counts grow at each."""
    links = materialize(links, "forms")
    while True:
        more = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(join_unique(links, more, ["root"], "left"), "forms")
        if moved.where("further is not null").isEmpty():
            return links
        links = materialize(moved.select("word", F.coalesce("further", "root").alias("root")), "forms")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = words_of(table(spark, sf_dir, "documents"), "doc_id", "text", 31, 7)
    return spelling_variants(words.where("n >= 2"))
