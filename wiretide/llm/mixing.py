"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is the rate at which its documents are taken.  The whole part of
the rate is certain: that many copies of every document.  For the rest, each document has an
inclusion probability p and a uniform number u from a hash; documents are ranked by
(u / (1 - u)) / (p / (1 - p)) and taken from the smallest rank up to the one that would pass what
is left of the target; the row whose size is nearest to the remaining gap closes the sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiretide.llm.common import materialize, table

#: Ranks are dealt into LEVEL ** 2 intervals, so that running totals never need a source in one task.
LEVEL = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, size)``.

    Sources in code-point order, null last, weigh ``weights``, repeating, and share the total of
    all sizes.  A target stops at cap times its source's size; what exceeds it is shared again by
    weight among sources below their caps, until none is above.  Closed form: with sources in
    order of cap over weight, the first k are at their caps where the level set by the others
    exceeds theirs.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row a source: ranks need all sources in order, so this window is over the summary alone
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    total = F.sum("source_size").over(Window.partitionBy()).cast("double")
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    capped_before = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    # words per unit of weight if exactly the sources before this one are at their caps
    per = per.withColumn("level", (total - capped_before) / weight_left)
    per = per.withColumn("full", F.col("level") * F.col("w") >= F.col("most"))
    # sources are full up to the first that is not; its level holds for it and all after it
    level = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("w"), F.col("level")))).over(Window.partitionBy())
    target = F.when(F.col("full"), F.col("most")).otherwise(level["level"] * F.col("w"))
    return per.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, size, source_size, target, copies, taken)`` of every row, and the columns in ``keep``.

    size counts words; copies is how often the mix takes the row, never above cap rounded up;
    taken is copies times size.  Probabilities are unequal: long documents are damped by the
    square root of their size over their source's mean, within a factor of 4.  Null text has
    size 0; a null source is a source of its own; sources of size 0 have target 0.  Reruns
    agree, as random numbers are hashes of id, text and seed; rows equal in id and text are
    taken alike; ties of rank go to the smaller id, then size.  Words of long texts are all
    counted; an empty table gives an empty result; other columns are ignored but for ``keep``.
    The closing row of a source is picked by size, not by rank: its odds are not a Pareto draw's,
    which changes the inclusion odds of one row a source.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), text), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), u.alias("u"), *keep), "sizes")
    # rows of a source, for the mean size
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    targets = materialize(source_targets(rows, weights, cap).alias("t").join(counts.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"), "targets")
    # a null source joins as well
    t = targets.withColumnRenamed("source", "of")
    joined = rows.join(t, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("whole", F.floor(rate + 1e-12)).withColumn("part", F.greatest(F.lit(0.0), rate - F.col("whole")))
    damp = F.least(F.lit(4.0), F.greatest(F.lit(0.25), F.sqrt(F.col("source_size") / F.col("n") / F.greatest(F.col("size"), F.lit(1)))))
    p = F.lit(1.0) - F.pow(F.lit(1.0) - F.col("part"), damp)
    odds = (F.col("u") / (1.0 - F.col("u"))) / (p / (1.0 - p))
    # x / (1 + x) keeps the order of ranks and lies between 0 and 1
    rank = F.when((F.col("part") > 1e-9) & (F.col("size") > 0), odds / (1.0 + odds))
    fine = F.least(F.floor(F.col("rank") * LEVEL * LEVEL), F.lit(LEVEL * LEVEL - 1)).cast("int")
    ranked = joined.withColumn("rank", rank).withColumn("fine", fine)
    ranked = materialize(ranked.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")).drop("u", "n", "part"), "ranked")

    def edge(df: DataFrame, bucket: Column) -> DataFrame:
        """(source, bucket, before): the interval of each source in which its running total passes what is left."""
        sums = df.where("rank is not null").groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        w = Window.partitionBy("source").orderBy("bucket")
        run = sums.withColumn("upto", F.sum("words").over(w))
        return run.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") <= F.col("left"))).select(F.col("source").alias("of"), F.col("bucket").alias("edge"), (F.col("upto") - F.col("words")).alias("before"))

    coarse = materialize(edge(ranked, F.floor(F.col("fine") / LEVEL).cast("int")), "edges")
    near = ranked.join(coarse, F.col("source").eqNullSafe(F.col("of")) & (F.floor(F.col("fine") / LEVEL) == F.col("edge"))).withColumn("left", F.col("left") - F.col("before")).drop("of", "edge", "before")
    near = materialize(near, "near")
    inner = materialize(edge(near, F.col("fine")).withColumnRenamed("before", "inner_before"), "edges")
    cross = near.join(inner, F.col("source").eqNullSafe(F.col("of")) & (F.col("fine") == F.col("edge"))).withColumn("left", F.col("left") - F.col("inner_before"))
    # the last interval, 1 / 65536 of a source: exact order up to the row that would pass what is left
    w = Window.partitionBy("source").orderBy("rank", "id", "size")
    cross = cross.withColumn("upto", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = cross.where("upto - size <= left").groupBy("source").agg(F.max(F.struct("upto", "size", "rank", "id")).alias("m"), F.first("left").alias("left"))
    last = F.struct(F.col("m.rank").alias("rank"), F.col("m.id").alias("id"), F.col("m.size").alias("size"))
    stop = materialize(at.select(F.col("source").alias("of"), last.alias("last"), (F.col("left") - F.col("m.upto") + F.col("m.size")).alias("gap")), "stops")
    here = F.struct("rank", "id", "size")
    out = ranked.join(stop, F.col("source").eqNullSafe(F.col("of")), "left")
    # one more row a source, the one whose size comes nearest to the gap that remains
    rest = out.where(F.col("rank").isNotNull() & F.col("gap").isNotNull() & ~(here < F.col("last"))).groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), here.alias("row"))).alias("m"), F.first("gap").alias("gap"))
    close = materialize(rest.where("m.off < gap").select(F.col("source").alias("of2"), F.col("m.row").alias("closing")), "closing")
    out = out.join(close, F.col("source").eqNullSafe(F.col("of2")), "left")
    ranked_in = F.col("gap").isNull() | (here < F.col("last")) | F.coalesce(here == F.col("closing"), F.lit(False))
    extra = F.when(F.col("rank").isNotNull() & ranked_in, F.lit(1)).otherwise(F.lit(0))
    copies = (F.col("whole") + extra).cast("long")
    return out.select("id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "source", *keep)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")
