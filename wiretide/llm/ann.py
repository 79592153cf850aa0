"""Approximate nearest neighbours on robust-pruned directed graphs, one graph for each shard.

Largest inner product becomes smallest distance by one more coordinate, which lifts all vectors
of a shard to the same norm.  A graph grows in batches: a greedy beam search over the graph so far
proposes neighbours, relaxed distance pruning keeps diverse edges, and edges back are pruned alike
where a node has too many.  Every query runs a beam search on every shard, so shards are as large
as a task's memory bears; queries stream past a shard that is read once.  The shards' best are
merged.  Scores of what is returned are computed again in double precision.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiretide.llm.common import materialize, row_key, shuffle_partitions, table
from wiretide.llm.vectors import matrix, usable

#: Distinct vectors of a shard, on average; 64 dimensions take about 1 kB a vector while a graph grows.
SHARD_ROWS = 50_000
#: Queries that one task streams past a shard, at most on average: an index row is copied once for so many.  Their number costs
#: a task time, not memory; with few shards there are more splits, so that all tasks have work.
TASK_QUERIES = 500_000
DEGREE = 28
BEAM_BUILD = 96
BEAM_SEARCH = 400
ALPHA = 1.2
#: Queries searched together.
QUERY_BLOCK = 256


def lift(x: np.ndarray) -> np.ndarray:
    """One more coordinate, so that the nearest to (q, 0) is the one with the largest inner product with q."""
    sq = (x.astype(np.float64) ** 2).sum(1)
    scale = np.sqrt(sq.max()) if len(sq) and sq.max() > 0 else 1.0
    return np.concatenate([x / scale, np.sqrt(np.maximum(0.0, 1.0 - sq / scale**2))[:, None]], 1).astype(np.float32)


def beam_search(x: np.ndarray, graph: np.ndarray, entry: np.ndarray, q: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances) of the ``beam`` best met for each query, nearest first; -1 and inf where fewer.

    graph holds out-neighbours, -1 padded.  All queries advance together, each expanding its
    nearest unexpanded nodes until none of its best is unexpanded.
    """
    nq, n = len(q), len(x)
    xs = (x**2).sum(1)
    ids = np.full((nq, beam), -1, np.int64)
    dist = np.full((nq, beam), np.inf, np.float32)
    done = np.ones((nq, beam), bool)
    seen = np.zeros((nq, n + 1), bool)
    seen[:, n] = True  # where -1 points
    e = entry[:beam]
    ids[:, : len(e)] = e
    dist[:, : len(e)] = xs[e][None] - 2 * (q @ x[e].T)
    done[:, : len(e)] = False
    seen[:, e] = True
    order = np.argsort(dist, 1, kind="stable")
    ids, dist, done = (np.take_along_axis(a, order, 1) for a in (ids, dist, done))
    live = np.arange(nq)
    while len(live):
        open_ = ~done[live]
        rank = np.cumsum(open_, 1)
        pick = open_ & (rank <= expand)
        some = pick.any(1)
        live, pick, rank = live[some], pick[some], rank[some]
        if not len(live):
            break
        done[live] |= pick
        r, c = np.nonzero(pick)
        front = np.full((len(live), expand), -1, np.int64)
        front[r, rank[r, c] - 1] = ids[live[r], c]
        new = graph[front.ravel()].reshape(len(live), -1)
        new[np.repeat(front < 0, graph.shape[1], 1)] = -1
        row = np.repeat(np.arange(len(live)), new.shape[1]).reshape(new.shape)
        new = np.where(seen[live[row], new], -1, new)
        # a node met twice in one step counts once
        new.sort(1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        seen[live[row], new] = True
        fresh = new >= 0
        d = np.full(new.shape, np.inf, np.float32)
        fr, fc = np.nonzero(fresh)
        nodes = new[fr, fc]
        d[fr, fc] = xs[nodes] - 2 * np.einsum("ij,ij->i", x[nodes], q[live[fr]])
        all_d = np.concatenate([dist[live], d], 1)
        best = np.argpartition(all_d, beam - 1, 1)[:, :beam]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_d, best, 1), 1, kind="stable"), 1)
        dist[live] = np.take_along_axis(all_d, best, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], new], 1), best, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], 1), best, 1)
    return ids, dist + (q**2).sum(1, keepdims=True)


def robust_prune(x: np.ndarray, p: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours of nodes p from candidates (-1 padded): the nearest, then those not much nearer to a chosen one than to p."""
    out = np.full((len(p), degree), -1, np.int64)
    step = max(1, (24 << 20) // max(1, cand.shape[1] ** 2 * 4))
    for a in range(0, len(p), step):
        pp, cc = p[a : a + step], np.sort(cand[a : a + step], 1)
        alive = (cc >= 0) & (cc != pp[:, None])
        alive[:, 1:] &= cc[:, 1:] != cc[:, :-1]
        v = x[cc]
        s = (v**2).sum(2)
        to_p = np.where(alive, s - 2 * np.einsum("bcd,bd->bc", v, x[pp]) + (x[pp] ** 2).sum(1)[:, None], np.inf)
        between = s[:, :, None] + s[:, None] - 2 * (v @ v.transpose(0, 2, 1))
        rows = np.arange(len(pp))
        for k in range(degree):
            c = np.where(alive, to_p, np.inf).argmin(1)
            ok = alive[rows, c]
            if not ok.any():
                break
            out[a + rows[ok], k] = cc[rows[ok], c[ok]]
            # squared distances, hence alpha squared
            alive &= ~((alpha**2 * between[rows, c] <= to_p) & ok[:, None])
            alive[rows, c] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM_BUILD, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(out-neighbours, entry nodes) of a graph over lifted vectors."""
    n = len(x)
    graph = np.full((n + 1, degree), -1, np.int64)  # the last row is where -1 points
    order = np.random.default_rng(9).permutation(n)
    entry = order[: min(n, 8)]
    done = min(n, 8)
    for i in range(done):
        others = np.delete(order[:done], i)
        graph[order[i], : len(others)] = others[:degree]
    while done < n:
        batch = order[done : min(n, done + max(8, min(512, done)))]
        ids, _ = beam_search(x, graph, entry, x[batch], beam)
        graph[batch] = robust_prune(x, batch, ids, degree, alpha)
        src = np.repeat(batch, degree)
        dst = graph[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        o = np.argsort(dst, kind="stable")
        src, dst = src[o], dst[o]
        node, first, count = np.unique(dst, return_index=True, return_counts=True)
        inc = np.full((len(node), int(count.max())), -1, np.int64)
        inc[np.repeat(np.arange(len(node)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
        both = np.concatenate([graph[node], inc], 1)
        size = (both >= 0).sum(1)
        packed = np.take_along_axis(both, np.argsort(both < 0, 1, kind="stable"), 1)
        fits = size <= degree
        graph[node[fits]] = packed[fits][:, :degree]
        for width in (degree + 16, degree + 64, both.shape[1]):  # by size, so that few rows are padded far
            full = ~fits & (size <= width)
            if full.any():
                graph[node[full]] = robust_prune(x, node[full], packed[full][:, :width], degree, alpha)
                fits |= full
        done += len(batch)
    return graph, entry


_INDEX = "shard int, dim int, vectors binary, graph binary, entry binary, members array<array<bigint>>"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(shard, dim, v, members)`` sorted by (shard, dim) -> one index row each."""
    key, vecs, ids = None, [], []

    def flush() -> pa.RecordBatch:
        raw = np.concatenate(vecs)
        graph, entry = build_graph(lift(raw))
        members = pa.concat_arrays(ids)
        whole = pa.ListArray.from_arrays(pa.array([0, len(members)], pa.int32()), members)
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([raw.tobytes()], pa.binary()), pa.array([graph.astype(np.int32).tobytes()], pa.binary()), pa.array([entry.tobytes()], pa.binary()), whole],
            ["shard", "dim", "vectors", "graph", "entry", "members"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        shard, dim = (batch.column(i).to_numpy() for i in (0, 1))
        edges = np.flatnonzero((shard[1:] != shard[:-1]) | (dim[1:] != dim[:-1])) + 1
        for i, j in itertools.pairwise([0, *edges.tolist(), len(shard)]):
            if (shard[i], dim[i]) != key:
                if vecs:
                    yield flush()
                key, vecs, ids = (shard[i], dim[i]), [], []
            vecs.append(matrix(batch.column(2).slice(i, j - i), int(dim[i])).astype(np.float64))
            ids.append(batch.column(3).slice(i, j - i))
    if vecs:
        yield flush()


_WORK = "shard int, dim int, split int, kind int, vectors binary, graph binary, entry binary, members array<array<bigint>>, qid bigint, qv array<double>"


def _search(top: int):
    """Over rows sorted by (shard, dim, split, kind): an index row, then the queries that search it."""
    beam = max(BEAM_SEARCH, 2 * (top + 1))

    def search(index: tuple, qid: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        raw, x, graph, entry, ids, offs = index
        size = np.sqrt((q**2).sum(1, keepdims=True))
        near, _ = beam_search(x, graph, entry, np.concatenate([q / size, np.zeros((len(q), 1))], 1).astype(np.float32), beam)
        got = near >= 0
        row, node = np.nonzero(got)[0], near[got]
        score = np.concatenate([(raw[node[c : c + 65536]] * q[row[c : c + 65536]]).sum(1) for c in range(0, len(node), 65536)])
        # every id of a vector that was met, but the query's own; ties of score go to smaller ids
        count = offs[node + 1] - offs[node]
        place = np.repeat(offs[node] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        row, score, vid = np.repeat(row, count), np.repeat(score, count), ids[place]
        own = vid == qid[row]
        row, score, vid = row[~own], score[~own], vid[~own]
        order = np.lexsort((vid, -score, row))
        row, score, vid = row[order], score[order], vid[order]
        first = np.searchsorted(row, np.arange(len(q)))
        keep = np.arange(len(row)) - first[row] < top
        return pa.RecordBatch.from_arrays([pa.array(qid[row[keep]]), pa.array(vid[keep]), pa.array(score[keep])], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, index = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, dim, split, kind = (batch.column(i).to_numpy() for i in range(4))
            edges = np.flatnonzero((shard[1:] != shard[:-1]) | (dim[1:] != dim[:-1]) | (split[1:] != split[:-1]) | (kind[1:] != kind[:-1])) + 1
            for i, j in itertools.pairwise([0, *edges.tolist(), len(shard)]):
                here = (shard[i], dim[i], split[i])
                if kind[i] == 0:
                    raw = np.frombuffer(batch.column(4)[i].as_py(), np.float64).reshape(-1, dim[i])
                    graph = np.frombuffer(batch.column(5)[i].as_py(), np.int32).reshape(len(raw) + 1, -1).astype(np.int64)
                    lists = batch.column(7)[i].values
                    offs = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                    key, index = here, (raw, lift(raw), graph, np.frombuffer(batch.column(6)[i].as_py(), np.int64), lists.flatten().to_numpy(), offs)
                elif here == key:  # a query without an index row has no vector of its length in the shard
                    qid = batch.column(8).slice(i, j - i).to_numpy()
                    q = matrix(batch.column(9).slice(i, j - i), int(dim[i])).astype(np.float64)
                    for c in range(0, len(q), QUERY_BLOCK):
                        yield search(index, qid[c : c + QUERY_BLOCK], q[c : c + QUERY_BLOCK])

    return run


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, top: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` the top rows of ``vectors`` by inner product.

    A query's own id is no candidate.  Ties go to the smaller id.  Only vectors of the query's
    length are candidates.  Vectors null, empty, zero, or with null or non-finite components, and
    rows with a null id, take no part.  Every distinct vector is indexed once, with the smallest
    top + 1 ids that have it, so copies and repeated rows never fill a graph.  An empty table, of
    vectors or of queries, gives an empty result.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    wide = F.transform(v, lambda y: y.cast("double"))
    rows = vectors.where(usable(v) & F.col(id_col).isNotNull()).select(row_key(v).alias("node"), F.col(id_col).cast("long").alias("id"), wide.alias("v"))
    # the smallest ids of each vector: Spark limits groups before the shuffle and again after it
    few = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("node").orderBy("id"))).where(F.col("r") <= top + 1)
    classes = few.groupBy("node").agg(F.array_sort(F.collect_set("id")).alias("members"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("dim", F.size("v")), "vectors")
    shards = max(1, -(-classes.count() // SHARD_ROWS))
    dealt = classes.select(F.pmod(F.xxhash64(F.lit(4), "node"), F.lit(shards)).cast("int").alias("shard"), "dim", "v", "members")
    dealt = dealt.repartition(max(shards, shuffle_partitions(spark)), "shard", "dim").sortWithinPartitions("shard", "dim")
    index = materialize(dealt.mapInArrow(_build, _INDEX), "graphs")

    asked = queries.where(usable(v) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("qid"), wide.alias("qv"), F.size(v).alias("dim")).distinct()
    splits = max(1, -(-asked.count() // TASK_QUERIES), -(-shuffle_partitions(spark) // shards))
    share = F.pmod(F.xxhash64(F.lit(6), "qid"), F.lit(splits)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    none = {c: F.lit(None).cast(t) for c, t in (x.rsplit(" ", 1) for x in _WORK.split(", "))}
    indexes = index.select("shard", "dim", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"), F.lit(0).alias("kind"), "vectors", "graph", "entry", "members", none["qid"].alias("qid"), none["qv"].alias("qv"))
    searches = asked.select(every.alias("shard"), "dim", share.alias("split"), F.lit(1).alias("kind"), *(none[c].alias(c) for c in ("vectors", "graph", "entry", "members")), "qid", "qv")
    work = indexes.unionByName(searches).repartition(max(shards * splits, shuffle_partitions(spark)), "shard", "dim", "split").sortWithinPartitions("shard", "dim", "split", "kind")
    found = work.mapInArrow(_search(top), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)
