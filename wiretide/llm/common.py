"""Helpers shared by the corpus operators: tables, scratch space, byte views."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            base = jvm_dir.get()
        elif not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wiretide-"))
            base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back.

    Cuts lineage the recoverable way: a lost executor costs a reread, never a recompute.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns memory that this process has freed to the machine, where its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which its worker keeps no freed memory: workers outlive their tasks, beside stages that need it."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return inner


def row_key(*cols: Column | str) -> Column:
    """128-bit key of a row's columns; rows equal in all of them share it."""
    cols = tuple(F.col(c) if isinstance(c, str) else c for c in cols)
    null = [c.isNull() for c in cols]
    half = [F.lpad(F.hex(F.xxhash64(F.lit(seed), *cols, *null)), 16, "0") for seed in (1, 2)]
    return F.unhex(F.concat(*half))


#: A key with more than one in so many rows of a table is heavy; so there are fewer heavy keys than this.
HEAVY = 200


def join_unique(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", heavy: list[int] | None = None) -> DataFrame:
    """Join (inner or left) of a stored ``left`` with ``right``, which has each key once.

    Keys with over 1/HEAVY of left's rows, fewer than HEAVY by count, are joined by broadcast of
    their rows alone; no task gets all rows of one key.  Null keys match nothing and aren't shuffled.
    heavy: xxhash64 of the heavy keys, where the caller has them.
    """
    known = functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    code = F.xxhash64(*on)
    if heavy is None:
        heavy = [r[0] for r in left.where(known).groupBy(code.alias("h")).count().where(F.col("count") > left.count() / HEAVY).collect()]
    if heavy:
        out = left.where(known & ~code.isin(heavy)).join(right, on, how)
        out = out.unionByName(left.where(known & code.isin(heavy)).join(F.broadcast(right.where(code.isin(heavy))), on, how))
    else:
        out = left.where(known).join(right, on, how)
    if how == "left":
        new = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name not in on]
        out = out.unionByName(left.where(~known).select("*", *new))
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_binary(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array, without copying; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_dictionary(col.type):
        col = col.dictionary_decode()
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offs, data = col.buffers()
    kind = np.int64 if large else np.int32
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def by_bytes(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about ``most`` bytes, so that work space does not follow a batch's size."""
    ends = as_binary(batch.column(column))[1]
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary array of the slices of ``data`` that start at ``starts``."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    place = np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[place])])


def codes(*halves: np.ndarray) -> pa.Array:
    """Binary array of values of 64 bits side by side."""
    both = np.ascontiguousarray(np.stack([h.view(U64) for h in halves], 1))
    width = 8 * len(halves)
    return pa.Array.from_buffers(pa.binary(), len(both), [None, pa.py_buffer((np.arange(len(both) + 1) * width).astype(np.int32)), pa.py_buffer(both)])


def fmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class Powers:
    """Powers of an odd base modulo 2**64 and their inverses, for hashes of substrings from prefix sums."""

    def __init__(self, base: int, n: int):
        self.base, self.n = base, n
        inv = pow(base, -1, 1 << 64)
        self.up = self._run(base, n + 1)
        self.down = self._run(inv, n + 1)

    @staticmethod
    def _run(b: int, n: int) -> np.ndarray:
        out = np.full(n, U64(b), dtype=U64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """P with P[e] - P[s] = sum of (byte + 1) * base**i for s <= i < e."""
        out = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * self.up[: len(data)], out=out[1:])
        return out
