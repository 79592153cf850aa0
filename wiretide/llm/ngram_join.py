"""N-gram Jaccard join: exact near-duplicate groups by blocked sparse matrix products.

The matrix has a row for each distinct shingle set and a column for each shingle.  A product
of two row blocks accumulates overlap counts; a pair whose sizes alone rule the threshold out
is discarded before it is counted.  Row blocks come from partition keys: in a size band, two
sets that link differ in at most d shingles, so if the shingles are dealt into parts and a set
fills more than d of them, some filled part is equal in both.  Sets with an equal part share a
block, hence no link is lost, while documents that only share a passage rarely meet.

Only groups are asked for, so pairs that other links join already need no count.  In a first round
each set goes to one block of its own, dealt into chunks that all hold the block's leader; what
links there is one component.  In a second round only blocks that still hold several components
are multiplied, and there the largest component only with the others, not with itself.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.llm.common import U64, as_binary, by_bytes, fmix, join_unique, materialize, row_key, shuffle_partitions, table, tidied
from wiretide.llm.components import connected_components
from wiretide.llm.shingles import set_ids, shingle_sets

#: Rows, and shingles of all rows, of one side of a block product.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 19
#: Keys that a task holds before it passes them on.
KEYS_HELD = 1_000_000
#: Bytes of keys that meet in one task.
MEET_BYTES = 12 << 20
#: Bytes of texts that are shingled at once.
TEXT_BYTES = 2 << 20


@functools.cache
def _bands(n: int) -> tuple[int, ...]:
    """Lower ends of size bands up to size n, each about a quarter above the one before."""
    out = [1]
    while out[-1] <= n:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return tuple(out)


def _part_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the parts of a set, for its own size band and those below where a partner may be."""
    n = len(s)
    edges = _bands(1 << (n.bit_length()))
    band = bisect.bisect_right(edges, n) - 1
    out = []
    for b in range(band, -1, -1):
        if (edges[b + 1] - 1) * den < n * num:
            break  # every set of band b is too small for this one
        top = edges[b + 1] - 1  # the smaller set of a pair met in this band has at most so many
        d = (den - num) * (top + top * den // num) // (den + num)  # most shingles in which the two differ
        parts = d + 1 + (d + 9) // 10
        part = (((s >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sums = np.add.reduceat(fmix(s ^ U64(7919 * b + 13)), first)
        ids = part[first]
        if len(first) <= d:  # too few filled parts to be sure of one: empty ones count as well
            empty = np.setdiff1d(np.arange(parts), ids, assume_unique=True)
            ids, sums = np.concatenate([ids, empty]), np.concatenate([sums, np.zeros(len(empty), U64)])
        out.append(fmix(sums ^ (ids.astype(U64) * U64(0x9E3779B97F4A7C15)) ^ U64(b)))
    return np.concatenate(out)


def _leaders(keys: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Pairs (smallest node of a key, other node of it), each once."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    lead = nodes[first][np.cumsum(first) - 1] if len(keys) else nodes
    other = lead != nodes
    return np.unique(np.stack([lead[other], nodes[other]], 1), axis=0) if other.any() else np.zeros((0, 2), np.int64)


_KEYED = "bucket int, keys binary, nodes binary"


def _emit_keys(keys: np.ndarray, nodes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Every distinct (key, node), to the key's bucket: a leader chosen here would part the key's nodes from those of other tasks."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])])
    keys, nodes = keys[new], nodes[new]
    bucket = (keys >> U64(40)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    parts = [[x.tobytes() for x in np.split(col[order], first[1:])] for col in (keys, nodes)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), *(pa.array(x, pa.binary()) for x in parts)], ["bucket", "keys", "nodes"])


def signatures(rows: DataFrame, k: int) -> DataFrame:
    """``(id, rk, n_shingles, node, code)`` of every row of ``rows(id, rk, text)``.

    node is the 128-bit identity of the row's shingle set, code its first half; null where the set is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, 2, TEXT_BYTES)):
            sets = shingle_sets(*as_binary(batch.column(2)), k)
            size = np.array([len(s) for s in sets], np.int64)
            ids = set_ids(sets)
            node = pa.array([x.tobytes() if n else None for x, n in zip(ids, size, strict=True)], pa.binary())
            code = pa.array(np.ascontiguousarray(ids[:, 0]).view(np.int64), mask=size == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(size), node, code], ["id", "rk", "n_shingles", "node", "code"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "rk", "text").mapInArrow(tidied(run), f"id {kind}, rk binary, n_shingles bigint, node binary, code bigint")


def _met_pairs(rows: DataFrame, shingles: int, k: int, num: int, den: int) -> DataFrame:
    """``(leader, code)``: sets with an equal part and the leader of that part.  Sets go by code here; two with one code just meet."""
    # a set has about 2 (den - num) / (den + num) keys a shingle, in two bands
    per = 4.5 * (den - num) / (den + num)
    buckets = max(shuffle_partitions(rows.sparkSession), int(shingles * min(per, 2.5) * 16 / MEET_BYTES))
    most = KEYS_HELD

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys: list[np.ndarray] = []
        codes: list[np.ndarray] = []
        held = 0
        for batch in (part for whole in batches for part in by_bytes(whole, 0, TEXT_BYTES)):
            sets = shingle_sets(*as_binary(batch.column(0)), k)
            for s, code in zip(sets, np.ascontiguousarray(set_ids(sets)[:, 0]).view(np.int64).tolist(), strict=True):
                if not len(s) or code in seen:
                    continue
                seen.add(code)
                keys.append(_part_keys(s, num, den))
                codes.append(np.full(len(keys[-1]), code, np.int64))
                held += len(keys[-1])
                if held >= most:
                    yield _emit_keys(np.concatenate(keys), np.concatenate(codes), buckets)
                    seen, keys, codes, held = set(), [], [], 0
        if keys:
            yield _emit_keys(np.concatenate(keys), np.concatenate(codes), buckets)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[], []]
        for batch in batches:
            for j, kind in enumerate((U64, np.int64)):
                data, _ = as_binary(batch.column(j + 1))
                got[j].append(np.frombuffer(data.tobytes(), kind))
        if not got[0]:
            return
        pairs = _leaders(*(np.concatenate(x) for x in got))
        for i in range(0, len(pairs), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + 50_000, 0]), pa.array(pairs[i : i + 50_000, 1])], ["leader", "code"])

    dealt = rows.select("text").mapInArrow(tidied(keyed), _KEYED).repartition(buckets, "bucket")
    return materialize(dealt.mapInArrow(tidied(met), "leader bigint, code bigint").distinct(), "pairs")


def overlaps(rows: list[np.ndarray]) -> np.ndarray:
    """Product of the incidence matrix of ``rows`` with its transpose: overlap counts.

    Columns that many rows have go through dense products of column blocks, the others through
    runs of equal shingles in sorted order.
    """
    g = len(rows)
    count = np.zeros((g, g), np.int64)
    tok = np.concatenate(rows)
    row = np.repeat(np.arange(g, dtype=np.int32), [len(r) for r in rows])
    order = np.argsort(tok, kind="stable")
    tok, row = tok[order], row[order]
    start = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
    length = np.diff(np.append(start, len(tok)))
    dense = length > 48
    if dense.any():
        at = np.repeat(dense, length)
        col = np.repeat(np.arange(dense.sum()), length[dense])
        r = row[at]
        for c in range(0, int(dense.sum()), 4096):
            lo, hi = np.searchsorted(col, [c, c + 4096])
            block = np.zeros((g, min(4096, int(dense.sum()) - c)), np.float32)
            block[r[lo:hi], col[lo:hi] - c] = 1
            count += (block @ block.T).astype(np.int64)
        tok, row = tok[~at], row[~at]
    for step in range(1, 48):
        same = np.flatnonzero(tok[step:] == tok[:-step])
        if not len(same):
            break
        a, b = row[same].astype(np.int64), row[same + step].astype(np.int64)
        count += np.bincount(a * g + b, minlength=g * g).reshape(g, g)
        count += np.bincount(b * g + a, minlength=g * g).reshape(g, g)
    return count


def local_roots(adjacent: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each row of a symmetric boolean matrix."""
    g = len(adjacent)
    label = np.arange(g)
    a, b = np.nonzero(adjacent)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _block_links(k: int, num: int, den: int):
    """Links among rows ``(block, i, j, node, text)`` sorted by (block, i, j): each row linked with the first of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, ids = None, [], {}

        def product() -> pa.RecordBatch | None:
            if len(rows) < 2:
                return None
            size = np.array([len(r) for r in rows])
            node = np.array(list(ids), object)
            order = np.argsort(size, kind="stable")
            size, node = size[order], node[order]
            links_u, links_v = [], []
            # rows in order of size: beyond a gap that the threshold can't bridge, no pair is possible
            gap = np.flatnonzero(size[:-1] * den < num * size[1:]) + 1
            for part in np.split(np.arange(len(size)), gap):
                if len(part) < 2:
                    continue
                both = overlaps([rows[order[i]] for i in part])
                total = size[part][:, None] + size[part][None]
                linked = den * both >= num * (total - both)
                np.fill_diagonal(linked, False)
                root = local_roots(linked)
                move = root != np.arange(len(part))
                links_u.append(node[part][root[move]])
                links_v.append(node[part][move])
            if not links_u:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(links_u), pa.binary()), pa.array(np.concatenate(links_v), pa.binary())], ["u", "v"])

        for batch in (part for whole in batches for part in by_bytes(whole, 4, TEXT_BYTES)):
            block, i, j = (batch.column(c).to_numpy() for c in range(3))
            sets = shingle_sets(*as_binary(batch.column(4)), k)
            for x, (s, own, node) in enumerate(zip(sets, set_ids(sets), batch.column(3).to_pylist(), strict=True)):
                if (block[x], i[x], j[x]) != key:
                    if (out := product()) is not None:
                        yield out
                    key, rows, ids = (block[x], i[x], j[x]), [], {}
                # repeated rows bring a set again, and rows that share a key by chance another set
                if node not in ids and own.tobytes() == node:
                    ids[node] = None
                    rows.append(s)
        if (out := product()) is not None:
            yield out

    return run


def _parts(rows: str, shingles: str) -> Column:
    """Number of chunks of so many rows and shingles."""
    return F.greatest(F.lit(1), F.ceil(F.col(rows) / BLOCK_ROWS), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _multiply(rows: DataFrame, routes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links found in the products that ``routes(block, i, j, node, rk)`` deals the texts of ``rows(rk, text)`` to."""
    spark = rows.sparkSession
    routes = materialize(routes, "routes")
    with prefiltered(spark):  # the filter on keys reaches the scan before texts are shuffled
        texts = rows.select("rk", "text").join(routes, "rk").select("block", "i", "j", "node", "text")
        dealt = texts.repartition(shuffle_partitions(spark), "block", "i", "j").sortWithinPartitions("block", "i", "j")
        return materialize(dealt.mapInArrow(tidied(_block_links(k, num, den)), "u binary, v binary"), "links")


def _home_routes(pairs: DataFrame, carriers: DataFrame) -> DataFrame:
    """First round: every set in the block of its least leader, and the leader in each chunk of it."""
    home = pairs.groupBy("code").agg(F.min("leader").alias("block")).join(carriers, "code")
    home = materialize(home.select("block", "node", "rk", "n"), "homes")
    g = home.groupBy("block").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).select("block", _parts("rows", "shingles").alias("g"))
    g = materialize(g, "home-chunks")
    chunk = F.pmod(F.xxhash64("node", F.lit(3)), F.col("g")).cast("int")
    own = join_unique(home, g, ["block"]).select("block", chunk.alias("i"), F.lit(0).alias("j"), "node", "rk")
    lead = g.join(carriers, g["block"] == carriers["code"]).select("block", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("i"), F.lit(0).alias("j"), "node", "rk")
    return own.unionByName(lead)


def _open_routes(pairs: DataFrame, carriers: DataFrame, labels: DataFrame) -> DataFrame | None:
    """Second round: blocks that still hold several components; None where there are none."""
    comp = carriers.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    comp = comp.select("code", "node", "rk", "n", F.coalesce("root", "node").alias("comp"))
    leaders = pairs.select("leader", F.col("leader").alias("code")).distinct()
    members = materialize(pairs.unionByName(leaders), "members")
    members = materialize(join_unique(members, _one_or_list(comp), ["code"]).select(F.col("leader").alias("block"), F.inline("sets")), "block-members")
    by_comp = members.groupBy("block", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    # the largest component of a block is its main one
    plan = by_comp.groupBy("block").agg(F.count("*").alias("kinds"), F.max(F.struct("c", "s", "comp")).alias("main"), F.sum("c").alias("c"), F.sum("s").alias("s")).where("kinds > 1")
    small = (F.col("c") <= BLOCK_ROWS) & (F.col("s") <= BLOCK_SHINGLES)
    plan = plan.select("block", small.alias("small"), F.col("main.comp").alias("main"), F.col("main.c").alias("mc"), F.col("main.s").alias("ms"), (F.col("c") - F.col("main.c")).alias("oc"), (F.col("s") - F.col("main.s")).alias("os"))
    plan = plan.select("block", "main", F.when(F.col("small"), 1).otherwise(_parts("oc", "os")).alias("h"), F.when(F.col("small"), 0).otherwise(_parts("mc", "ms")).alias("m"))
    plan = materialize(plan, "open-blocks")
    if plan.isEmpty():
        return None
    placed = join_unique(members, plan, ["block"])
    alone = (F.col("comp") != F.col("main")) | (F.col("m") == 0)
    placed = placed.withColumn("alone", alone).withColumn("c", F.pmod(F.xxhash64("node", F.lit(4)), F.when(F.col("alone"), F.col("h")).otherwise(F.col("m"))).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda o: F.struct(F.least(F.col("c"), o).alias("i"), F.greatest(F.col("c"), o).alias("j")))
    mains = F.when(F.col("m") > 0, F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.struct(F.col("c").alias("i"), (F.col("h") + o).alias("j"))))
    to = F.when(F.col("alone"), F.concat(others, F.coalesce(mains, F.array().cast("array<struct<i:int,j:int>>"))))
    to = to.otherwise(F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda o: F.struct(o.alias("i"), (F.col("h") + F.col("c")).alias("j"))))
    return placed.select("block", F.inline(to), "node", "rk")


def _one_or_list(comp: DataFrame) -> DataFrame:
    """``(code, sets)``: the sets of a code, one but for codes that meet by chance."""
    return comp.groupBy("code").agg(F.collect_list(F.struct("node", "rk", "n", "comp")).alias("sets"))


def ngram_jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Near-duplicate groups: ``(id, n_shingles, component_id)`` for every row of ``docs``.

    Two rows link when the Jaccard similarity of their k-word shingle sets is at least num/den,
    compared in integers; shingles go by 64-bit hashes and whole sets by 128-bit ones, so other
    words are taken for the same only by chance (about shingles of both sets squared / 2**65 a
    pair).  component_id is the smallest id reachable by links.  Rows without words (null, empty
    or blank text) have an empty set, n_shingles 0, and are alone.  A text of any length is one
    set.  Repeated rows form one group.  A null id is grouped like any other; a group of null ids
    only has a null component_id.  An empty table gives an empty result.  Other columns, whatever
    their names, are ignored.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), text).alias("rk"), text.alias("text"))
    sig = materialize(signatures(rows, k), "signatures")
    pairs = _met_pairs(rows, sig.agg(F.sum("n_shingles")).first()[0] or 0, k, num, den)
    met = pairs.select("code").unionByName(pairs.select(F.col("leader").alias("code"))).distinct()
    carriers = sig.where("node is not null").groupBy("node", "code").agg(F.min("rk").alias("rk"), F.first("n_shingles").alias("n"))
    carriers = materialize(carriers.join(met, "code", "left_semi"), "carriers")
    links = _multiply(rows, _home_routes(pairs, carriers), k, num, den)
    labels = connected_components(links)
    routes = _open_routes(pairs, carriers, labels)
    if routes is not None:
        labels = connected_components(links.unionByName(_multiply(rows, routes, k, num, den)))
    rooted = join_unique(sig.select("id", "n_shingles", "node"), labels, ["node"], "left")
    rooted = materialize(rooted.select("id", "n_shingles", F.coalesce("root", "node").alias("root")), "rooted")
    lowest = materialize(rooted.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id")), "lowest")
    out = join_unique(rooted, lowest, ["root"], "left")
    return out.select("id", "n_shingles", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


class prefiltered:
    """Lets joins inside filter a large scan by a Bloom filter of the other side, which Spark bounds at 8 MB."""

    _SET = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256MB"}

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.old = {k: self.conf.get(k, None) for k in self._SET}
        for k, v in self._SET.items():
            self.conf.set(k, v)

    def __exit__(self, *exc: object) -> None:
        for k, v in self.old.items():
            self.conf.unset(k) if v is None else self.conf.set(k, v)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_jaccard_groups(table(spark, sf_dir, "documents"), k=4, num=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
