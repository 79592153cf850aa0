"""Whitening of vectors by FEAST contour integration.

Two passes over the vectors sum them and then the products of what is left after the mean, in
numpy inside tasks; sums of tasks meet in two steps.  The covariance has the size of one vector
squared, whatever the number of rows, so its eigenvectors are found on the driver:

* inertia: by Sylvester's law V - s has as many negative eigenvalues as the LDL^T pivots of its
  tridiagonal form, which counts the eigenvalues below any s.  Bisection on counts cuts the top of the
  spectrum into intervals with gaps at their ends.
* FEAST: the projector onto an interval's eigenvectors is a contour integral of the resolvent.
  Gauss-Legendre nodes on the upper half circle give one complex shifted solve each; their weighted
  sum filters a block of vectors, and Rayleigh-Ritz in the block gives eigenpairs, until residuals
  are at rounding.
* each interval must yield as many pairs as its inertia says, else the search is repeated with a
  larger block; no pair can be missed.

A third pass projects the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.llm.common import materialize, table

#: Steps of an entry, and what keeps them positive.
SCALE, SHIFT = 1024, 100_000
#: Most steps of an entry, either way; so sums of 2**23 such entries still are exact in 64 bits.
MOST = 2.0**40
#: Entries worked on at once.
AT_ONCE = 1 << 20
NODES = 16
#: Groups in which sums of tasks meet first.
FAN = 64
_EPS = np.finfo(float).eps


# --- eigenvectors of the covariance -------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix similar to the symmetric ``a``, by Householder reflections."""
    a = a.copy()
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        v = x.copy()
        v[0] += np.copysign(norm, x[0])
        v /= np.linalg.norm(v)
        sub = a[k + 1 :, k + 1 :]
        p = sub @ v
        w = p - (v @ p) * v
        sub -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = a[k, k + 1] = -np.copysign(norm, x[0])
    return np.diag(a).copy(), np.diag(a, 1).copy()


def below(diagonal: np.ndarray, off: np.ndarray, shift: float) -> int:
    """How many eigenvalues are below ``shift``: negative pivots of the LDL^T factors of T - shift."""
    tiny = _EPS * (np.abs(diagonal).max(initial=0) + np.abs(off).max(initial=0)) + np.finfo(float).tiny
    count, pivot = 0, 1.0
    for i in range(len(diagonal)):
        pivot = diagonal[i] - shift - (off[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot < 0
    return count


def intervals(diagonal: np.ndarray, off: np.ndarray, wanted: int, block: int = 16) -> list[tuple[float, float, int]]:
    """``(low, high, count)`` from the top, which together hold at least the ``wanted`` largest eigenvalues.

    Bisection halves intervals of more than ``block`` eigenvalues, unless they are clusters; ends are
    moved off eigenvalues, so counts at an end hold within a margin of it.
    """
    n = len(diagonal)
    radius = np.abs(off).max(initial=0) * 2
    bottom, top = diagonal.min() - radius, diagonal.max() + radius
    width = max(top - bottom, np.abs([top, bottom]).max() * 1e-3)
    todo = [(bottom - 0.01 * width, top + 0.01 * width, 0, n)]
    out, have = [], 0
    while todo and have < wanted:
        low, high, under, upto = todo.pop()
        count = upto - under
        if not count:
            continue
        if count <= block or high - low < 1e-9 * width:
            out.append((low, high, count))
            have += count
            continue
        span = high - low
        cuts = low + span * np.linspace(0.4, 0.6, 9)
        seen = [below(diagonal, off, c) for c in cuts]
        clear = [abs(below(diagonal, off, c + 0.005 * span) - below(diagonal, off, c - 0.005 * span)) for c in cuts]
        best = min(range(9), key=lambda i: (clear[i], abs(i - 4)))
        todo += [(low, cuts[best], under, seen[best]), (cuts[best], high, seen[best], upto)]
    return out


def feast(v: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the symmetric ``v`` in (low, high), falling, and their unit vectors as columns.

    count is what inertia says; ValueError if the contour can't find as many.
    """
    n = len(v)
    centre, radius = (low + high) / 2, (high - low) / 2
    scale = np.abs(v).max() or 1.0
    t, weight = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi * (1 + t) / 2
    node = centre + radius * np.exp(1j * angle)
    inverse = [np.linalg.inv(z * np.eye(n) - v) for z in node]
    for size in (count + max(4, count // 2), 2 * count + 8, 4 * count + 16, n):
        size = min(size, n)
        q = np.linalg.qr(np.random.default_rng([seed, size]).standard_normal((n, size)))[0]
        last = np.inf
        for _ in range(60):
            turned = sum((w * radius / 2) * np.real(np.exp(1j * a) * (r @ q)) for w, a, r in zip(weight, angle, inverse, strict=True))
            q = np.linalg.qr(turned)[0]
            ritz, inner = np.linalg.eigh(q.T @ v @ q)
            q = q @ inner
            inside = (ritz > low) & (ritz < high)
            error = np.abs(v @ q[:, inside] - q[:, inside] * ritz[inside]).max(initial=0) / scale
            if inside.sum() == count and error < 1e-11 and error >= last / 2:  # no round makes it smaller
                order = np.argsort(-ritz[inside], kind="stable")
                return ritz[inside][order], q[:, inside][:, order]
            last = error
    raise ValueError(f"inertia counts {count} eigenvalues between {low} and {high}; the contour does not find them")


def top_components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of the covariance ``v``, falling, and unit vectors as columns; those at rounding are left out."""
    n = len(v)
    values, vectors = np.zeros(0), np.zeros((n, 0))
    if not n or not np.abs(v).max():
        return values, vectors
    for low, high, count in intervals(*tridiagonal(v), min(wanted, n)):
        e, q = feast(v, low, high, count)
        values, vectors = np.append(values, e), np.hstack([vectors, q])
    # one more Rayleigh-Ritz step, over all intervals, makes vectors of different ones orthogonal to rounding
    q = np.linalg.qr(vectors)[0]
    values, inner = np.linalg.eigh(q.T @ v @ q)
    values, vectors = values[::-1], (q @ inner)[:, ::-1]
    real = np.flatnonzero(values > n * _EPS * np.abs(v).max() * 16)[:wanted]
    return values[real], vectors[:, real]


# --- passes over the vectors --------------------------------------------------------------------


def _stepped(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list array that count, by length: their places and their (rows, length) steps as doubles."""
    lengths = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
    for dim in np.unique(lengths[lengths > 0]).tolist():
        same = np.flatnonzero(lengths == dim)
        step = max(1, AT_ONCE // dim)
        for at in (same[a : a + step] for a in range(0, len(same), step)):
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(SCALE * flat[starts[at][:, None] + np.arange(dim)]) + SHIFT
                good = (np.abs(x) <= MOST).all(1)  # false for null, NaN and infinite entries
            yield at[good], x[good]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors -> ``(dim, n, sums)`` of the task."""
    total: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for _, x in _stepped(batch.column(0)):
            n, s = total.get(x.shape[1], (0, np.zeros(x.shape[1], np.int64)))
            total[x.shape[1]] = n + len(x), s + x.astype(np.int64).sum(0)
    for dim, (n, s) in total.items():
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([n]), pa.array([s.tolist()], pa.list_(pa.int64()))], ["dim", "n", "sums"])


def _products(mean: np.ndarray):
    """Vectors -> ``(part, i, row)``: rows of the task's sum of products of what is left after the mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = len(mean)
        total = np.zeros((dim, dim))
        for batch in batches:
            for _, x in _stepped(batch.column(0)):
                if x.shape[1] == dim:
                    x = x - mean
                    total += x.T @ x
        part = int(np.random.default_rng().integers(FAN))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, part, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(list(total))], ["part", "i", "row"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(i, row)`` sorted by i -> their sums by i."""
    i, row = None, None
    for batch in batches:
        for k, r in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            values = r.values.to_numpy()
            if k == i:
                row = row + values
            else:
                if i is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([row])], ["i", "row"])
                i, row = k, values
    if i is not None:
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([row])], ["i", "row"])


def _projected(n: int, sums: np.ndarray, turn: np.ndarray):
    """``(vec, id)`` -> ``(id, deviation, w)``: exact deviation, and whitened coordinates."""
    dim = len(sums)
    mean = sums / n
    most = int(np.sqrt(2.0**62 / dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _stepped(batch.column(0)):
                if x.shape[1] != dim or not len(at):
                    continue
                steps = x.astype(np.int64)
                far = np.abs(n * (x - mean)).max(1) >= most  # else no product or sum leaves 64 bits
                off = n * steps - sums
                deviation = pa.array((off * off).sum(1), mask=far)
                if far.any():
                    whole = deviation.to_pylist()
                    for k in np.flatnonzero(far).tolist():
                        exact = sum((n * int(a) - int(b)) ** 2 for a, b in zip(steps[k], sums, strict=True))
                        whole[k] = exact if exact < 1 << 63 else None
                    deviation = pa.array(whole, pa.int64())
                w = (x - mean) @ turn
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at)), deviation, pa.array(list(w), pa.list_(pa.float64()))], ["id", "deviation", "w"])

    return run


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` of each row that counts and each component from 1.

    Left out are vectors that are null or empty, hold null or non-finite entries or entries beyond
    2**40 steps, or have another length than most (ties: the longer).  Zero vectors count.  An
    entry c is floor(SCALE * c) + SHIFT.  Components are eigenvectors of the covariance (divisor n)
    by falling eigenvalue; those without variance are left out, so equal vectors alone give no row,
    as does an empty table.  Of equal eigenvalues any basis is taken.  deviation, the sum of
    (n * x - sum)^2, is exact, and null where 64 bits don't hold it.  Repeated rows and null ids are
    rows like others; further columns are ignored.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(vector_col).cast("array<double>").alias("v"), F.col(id_col).alias("id"))
    only = given.select("v")
    per = only.mapInArrow(_sums, "dim bigint, n bigint, sums array<bigint>")
    lines = per.select("dim", "n", F.posexplode("sums").alias("i", "s")).groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    most = lines.where("i = 0").orderBy(F.desc("n"), F.desc("dim")).select("dim", "n").first()
    schema = f"id {given.schema['id'].dataType.simpleString()}, deviation bigint, w array<double>"
    if most is None:
        dim, n, sums = 0, 1, np.zeros(0, np.int64)
        values, axes = np.zeros(0), np.zeros((0, 0))
        trace = 1.0
    else:
        dim, n = most
        sums = np.array([r.s for r in lines.where(F.col("dim") == dim).orderBy("i").select("s").collect()], np.int64)
        rows = only.mapInArrow(_products(sums / n), "part int, i int, row array<double>")
        step = rows.repartition(FAN, "part", "i").sortWithinPartitions("i").select("i", "row").mapInArrow(_added, "i int, row array<double>")
        step = step.repartition(FAN, "i").sortWithinPartitions("i").mapInArrow(_added, "i int, row array<double>")
        covariance = np.zeros((dim, dim))
        for r in step.toLocalIterator():
            covariance[r.i] = r.row
        covariance = (covariance + covariance.T) / (2 * n)
        trace = float(np.trace(covariance))
        values, axes = top_components(covariance, components)
    if not len(values):
        return spark.createDataFrame([], f"id {given.schema['id'].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    turned = materialize(given.mapInArrow(_projected(n, sums, axes / np.sqrt(values)), schema), "whitened")
    k = len(values)
    # covar_pop merges means and co-moments, so products are of centred values
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    moments = turned.select(*[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs]).first()
    error = max(abs(m - (i == j)) for (i, j), m in zip(pairs, moments, strict=True))
    share = F.array(*[F.lit(float(v / trace)) for v in values])
    out = turned.select("id", "deviation", F.posexplode("w").alias("c", "whitened"))
    return out.select("id", (F.col("c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[F.col("c")].alias("explained"), F.lit(float(error)).alias("identity_error"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
