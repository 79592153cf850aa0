"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are rotated at random and split into blocks.  If two lie within squared distance d2,
then in some block they lie within that block's share of d2.  Each block is range-joined: a few of
its coordinates span a grid of cells twice as wide as the block's radius, and a vector goes to
every cell that its box of half the radius each way meets, so two vectors within the radius share
the cell of their greater lower corners.  Only ids and a block's own coordinates go to cells.  Rows
that are in no candidate pair are dropped there; for the others the original vectors are fetched,
once for each cell.  Candidates of several blocks are united by rule, not as rows: a pair counts in
its first block and in its one cell there, where it is verified exactly.  No pair leaves a task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.llm.common import as_binary, join_unique, materialize, row_key, shuffle_partitions, table
from wiretide.llm.components import connected_components
from wiretide.llm.vectors import matrix, usable

BLOCKS = 8
#: Vectors of a cell compared in one task; larger cells are dealt into chunks, and pairs of chunks to tasks.
CHUNK_ROWS = 2048
_SLACK = 1e-5  # rotated coordinates are kept in single precision


def _rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([dim, 2]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _block_slices(dim: int) -> list[slice]:
    edge = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)
    return [slice(a, b) for a, b in itertools.pairwise(edge.tolist())]


def _budget(dim: int, sl: slice, min_cos: float) -> float:
    return (2.0 - 2.0 * min_cos) * (sl.stop - sl.start) / dim + _SLACK


_CELLS = "node binary, grp bigint, dim int, block int, low array<int>, cell array<int>, place binary"


def _to_cells(min_cos: float):
    """``(node, dim, grid, v, grp)`` -> cells of each block, with the block's coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, grid = (batch.column(i).to_numpy() for i in (1, 2))
            for dim, g in sorted(set(zip(dims.tolist(), grid.tolist(), strict=True))):
                idx = np.flatnonzero((dims == dim) & (grid == g))
                node, grp = (batch.column(c).take(pa.array(idx)) for c in (0, 4))
                turned = (_units(matrix(batch.column(3).take(pa.array(idx)), dim)) @ _rotation(dim)).astype(np.float32)
                for b, sl in enumerate(_block_slices(dim)):
                    r = np.sqrt(_budget(dim, sl, min_cos))
                    block = np.ascontiguousarray(turned[:, sl])
                    y = block[:, :g].astype(np.float64)
                    low, high = np.floor((y - r / 2) / (2 * r)).astype(np.int32), np.floor((y + r / 2) / (2 * r)).astype(np.int32)
                    for corner in itertools.product((0, 1), repeat=y.shape[1]):
                        step = np.array(corner, np.int32)
                        at = np.flatnonzero(((step == 0) | (high > low)).all(1))
                        if len(at):
                            yield pa.RecordBatch.from_arrays([node.take(pa.array(at)), grp.take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)), pa.array(np.full(len(at), b, np.int32)), _lists(low[at]), _lists(low[at] + step), _bytes(block[at])], ["node", "grp", "dim", "block", "low", "cell", "place"])

    return run


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * x.strides[0]), pa.py_buffer(np.ascontiguousarray(x))])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows that share their first ``keys`` columns, one table a group, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for a, b in itertools.pairwise(cuts):
            if held and (key[a] != last).any():
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
            last = key[a]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


#: A row of a cell: where it is, and which vector.
_ROW = ["key", "i", "j", "block", "chunk", "dim", "grp", "node", "low", "cell"]


def _alike(t: pa.Table) -> Iterator[pa.Table]:
    """Rows of one block, length and label; others share a key by chance only."""
    of = [t.column(c).to_numpy() for c in ("block", "dim", "grp")]
    for kinds in sorted(set(zip(*(x.tolist() for x in of), strict=True))):
        same = np.all([x == k for x, k in zip(of, kinds, strict=True)], 0)
        if same.sum() > 1:
            yield t.filter(pa.array(same)).combine_chunks()


def _near(t: pa.Table, y: np.ndarray, min_cos: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within the block's share of the distance, in the one cell where they count."""
    i, j, block, dim = (t.column(c)[0].as_py() for c in ("i", "j", "block", "dim"))
    n = t.num_rows
    chunk = t.column("chunk").to_numpy()
    low, cell = (np.asarray(t.column(c).combine_chunks().flatten()).reshape(n, -1) for c in ("low", "cell"))
    limit = _budget(dim, _block_slices(dim)[block], min_cos)
    sq = (y**2).sum(1)
    step = max(1, (4 << 20) // n)
    for a in range(0, n, step):
        u, v = np.nonzero(sq[a : a + step, None] + sq[None] - 2 * (y[a : a + step] @ y.T) <= limit + 1e-9)
        u += a
        keep = u < v
        if i != j:
            keep &= chunk[u] != chunk[v]
        u, v = u[keep], v[keep]
        for c in range(0, len(u), 50_000):
            p, q = u[c : c + 50_000], v[c : c + 50_000]
            own = (np.maximum(low[p], low[q]) == cell[p]).all(1) & (cell[p] == cell[q]).all(1)
            own[own] = ((y[p[own]] - y[q[own]]) ** 2).sum(1) <= limit
            yield p[own], q[own]


def _candidates(min_cos: float):
    """Cells ``(*_ROW, place)`` sorted by (key, i, j) -> their rows that are in some candidate pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            for t in _alike(group):
                y = np.frombuffer(as_binary(t.column("place"))[0].tobytes(), np.float32).reshape(t.num_rows, -1).astype(np.float64)
                met = np.zeros(t.num_rows, bool)
                for p, q in _near(t, y, min_cos):
                    met[p] = met[q] = True
                if met.any():
                    yield from t.select(_ROW).filter(pa.array(met)).to_batches()

    return run


def _verify(min_cos: float):
    """Candidate rows ``(*_ROW, copies, vec)`` sorted by (key, i, j): links of pairs whose first block this is."""

    def links(t: pa.Table) -> pa.RecordBatch | None:
        n, dim, block = t.num_rows, t.column("dim")[0].as_py(), t.column("block")[0].as_py()
        copies, node = t.column("copies").to_numpy(), t.column("node").combine_chunks()
        unit = _units(matrix(t.column("vec").combine_chunks(), dim))
        turned = (unit @ _rotation(dim)).astype(np.float32).astype(np.float64)
        slices = _block_slices(dim)
        us, vs = [], []
        for p, q in _near(t, turned[:, slices[block]], min_cos):
            first = np.ones(len(p), bool)
            for earlier in slices[:block]:
                first &= ((turned[p, earlier] - turned[q, earlier]) ** 2).sum(1) > _budget(dim, earlier, min_cos)
            p, q = p[first], q[first]
            linked = (unit[p] * unit[q]).sum(1) >= min_cos
            us.append(p[linked])
            vs.append(q[linked])
        a, b = np.concatenate([np.zeros(0, np.int64), *us]), np.concatenate([np.zeros(0, np.int64), *vs])
        if not len(a):
            return None
        count = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
        label = np.arange(n)
        while True:
            lower = label.copy()
            np.minimum.at(lower, a, label[b])
            np.minimum.at(lower, b, label[a])
            lower = lower[lower]
            if (lower == label).all():
                break
            label = lower
        met = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([node.take(pa.array(label[met])), node.take(pa.array(met)), pa.array(count[met].astype(np.int64))], ["u", "v", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            for t in _alike(group):
                if (out := links(t)) is not None:
                    yield out

    return run


def near_duplicate_vectors(vectors: DataFrame, min_cos: float, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id, n_links, component_id, kept)`` of every row.

    Two rows link when their labels are equal and not null, their vectors have the same length and
    their cosine in double precision is at least min_cos.  Vectors that are null, empty, zero, or
    hold null or non-finite components link with nothing, nor do rows with a null label: n_links
    0, component_id the row's own id, kept true.  Equal vectors are joined once and counted by
    their number, so repeated rows link with each other.  A pair at the threshold itself links.
    An empty table gives an empty result.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    counts_for = usable(v) & F.col(label_col).isNotNull()
    node = F.when(counts_for, row_key(F.col(label_col), v))
    rows = vectors.select(F.col(id_col).alias("id"), node.alias("node"), F.xxhash64(F.lit(2), F.col(label_col), F.size(v)).alias("grp"), v.alias("v"))
    classes = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.first("grp").alias("grp"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("dim", F.size("v")), "vectors")
    # more coordinates span the grid where a label has more vectors
    per = classes.groupBy("grp").agg(F.count("*").alias("n"))
    span = F.greatest(F.lit(1), F.least(F.floor(F.col("dim") / BLOCKS), F.ceil(F.log(F.col("n") / CHUNK_ROWS) / F.log(F.lit(2.5))))).cast("int")
    sized = join_unique(classes, materialize(per, "groups"), ["grp"]).select("node", "grp", "dim", span.alias("grid"), "v")
    spots = sized.select("node", "dim", "grid", "v", "grp").mapInArrow(_to_cells(min_cos), _CELLS)
    cells = materialize(spots.withColumn("key", F.xxhash64("grp", "block", "cell")), "cells")
    load = cells.groupBy("key").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("g"), F.count("*").alias("c")).where("c > 1").drop("c")
    mine = F.pmod(F.xxhash64("node", F.lit(5)), F.col("g")).cast("int")
    routed = join_unique(cells, materialize(load, "loads"), ["key"]).withColumn("chunk", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    routed = routed.select("key", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "block", "chunk", "dim", "grp", "node", "low", "cell", "place")
    at = ["key", "i", "j"]
    dealt = routed.repartition(shuffle_partitions(spark), *at).sortWithinPartitions(*at)
    near = dealt.mapInArrow(_candidates(min_cos), "key bigint, i int, j int, block int, chunk int, dim int, grp bigint, node binary, low array<int>, cell array<int>")
    near = materialize(near, "candidates")
    checked = near.join(classes.select("node", "copies", F.col("v").alias("vec")), "node").select(*_ROW, "copies", "vec")
    checked = checked.repartition(shuffle_partitions(spark), *at).sortWithinPartitions(*at)
    found = materialize(checked.mapInArrow(_verify(min_cos), "u binary, v binary, links bigint"), "links")
    labels = connected_components(found)
    links = found.groupBy(F.col("v").alias("ln")).agg(F.sum("links").alias("links"))
    by_class = classes.select("node", "copies").join(links, F.col("node") == F.col("ln"), "left").join(labels.withColumnRenamed("node", "cn"), F.col("node") == F.col("cn"), "left")
    by_class = materialize(by_class.select(F.col("node").alias("k"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "by-class")
    ids = materialize(rows.select("id", F.col("node").alias("k")), "ids")
    placed = materialize(join_unique(ids, by_class, ["k"], "left").select("id", "n_links", "root"), "placed")
    lowest = materialize(placed.where("root is not null").groupBy("root").agg(F.min("id").alias("least")), "lowest")
    component = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least"))
    out = join_unique(placed, lowest, ["root"], "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicate_vectors(table(spark, sf_dir, "embeddings"), 0.98)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")
