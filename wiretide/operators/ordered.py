"""Row numbers, previous values and running sums in one order within each session.

A window by session alone would put a whole capture into one task.  Orders that begin with a packet's
number are cut into blocks of BLOCK numbers: windows run within a block of a session or flow, by
one hash shuffle, and a small table of block totals carries numbers and states over from the
blocks before.  For other orders rows are dealt into ranges of (session, order), found by sampling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretide.operators.scratch import materialize

KEY = "session_id"
#: Packets of a session in a block.
BLOCK = 1 << 17


def block_of(packet_id: Column) -> Column:
    """The block of a packet; null for null."""
    return F.floor(packet_id / F.lit(BLOCK)).cast("long")


def numbered_in_blocks(df: DataFrame, block: Column, order: list[str], name: str) -> DataFrame:
    """Adds ``name``, 1, 2, ... in order within each session.

    Blocks must follow the order, so that all rows of one come before those of the next.  df is read
    twice, the first time for its session and block alone, so it should be stored.
    """
    d = df.withColumn("_block", block)
    w = Window.partitionBy(KEY).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per = d.groupBy(KEY, "_block").agg(F.count("*").alias("_n"))
    before = per.select(KEY, "_block", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(KEY, "_block").orderBy(*order))
    return d.withColumn(name, own).join(before, [KEY, "_block"]).withColumn(name, F.col(name) + F.col("_before")).drop("_block", "_before")


def dealt(df: DataFrame, order: list[str]) -> DataFrame:
    """``df``, stored, with ``part``: the number of its range; ranges follow (session_id, order)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = materialize(df, "to-order")  # ranges are drawn from a sample, so rows are read twice
    return materialize(stored.repartitionByRange(parts, KEY, *order).withColumn("part", F.spark_partition_id()), "ranges")


def _carried(d: DataFrame, value: Column, name: str) -> DataFrame:
    """``(session_id, part, name)``: sum of a value over the parts before, a row a session and part."""
    w = Window.partitionBy(KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = d.groupBy(KEY, "part").agg(F.sum(value).alias("_v"))
    return per.select(KEY, "part", F.coalesce(F.sum("_v").over(w), F.lit(0)).alias(name))


def numbered(d: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``, 1, 2, ... in order within each session, to rows from ``dealt``."""
    w = Window.partitionBy(KEY, "part").orderBy(*order)
    out = d.withColumn(name, F.row_number().over(w).cast("long")).join(_carried(d, F.lit(1), "_before"), [KEY, "part"])
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def summed(d: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``, the sum of a whole-number value up to and with each row."""
    w = Window.partitionBy(KEY, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = d.withColumn(name, F.sum(value).over(w)).join(_carried(d, F.col(value), "_before"), [KEY, "part"])
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def previous(d: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``, the value of the row before in its session, null for the first."""
    w = Window.partitionBy(KEY, "part").orderBy(*order)
    last = d.groupBy(KEY, "part").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    last = last.select(KEY, "part", F.lag("_last").over(Window.partitionBy(KEY).orderBy("part")).alias("_last"))
    first = F.row_number().over(w) == 1
    out = d.withColumn(name, F.lag(value).over(w)).withColumn("_first", first).join(last, [KEY, "part"])
    return out.withColumn(name, F.when(F.col("_first"), F.col("_last")).otherwise(F.col(name))).drop("_first", "_last")
