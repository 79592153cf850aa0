"""Connected components of an edge table, as a loop of joins and partial aggregates.

Every round maps each node to the closed neighbour with the smallest hash and contracts the
graph along that map.  The hash order differs by round, so long paths shrink by a constant
share each time.  Hubs cost nothing special: minima combine before the shuffle, and the joins
have one unique side, which adaptive execution splits.  Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretide.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` -> ``(node, root)`` for every node that has an edge to another node.

    root names the component: one of its nodes, the same for all, though not the smallest.
    Nulls and loops are ignored; an empty table gives an empty result.
    """
    e = materialize(edges.select("u", "v").where("u <> v").distinct(), "cc-edges")
    maps: list[DataFrame] = []
    while not e.isEmpty():
        k = len(maps)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", F.lit(k)).alias("p"), F.col("v").alias("n"))).alias("m"))
        own = F.struct(F.xxhash64("u", F.lit(k)).alias("p"), F.col("u").alias("n"))
        maps.append(materialize(best.select(F.col("u").alias("node"), F.least("m", own)["n"].alias("rep")), "cc-map"))
        m = maps[-1]
        half = e.join(m.select(F.col("node").alias("u"), F.col("rep").alias("ru")), "u").select("ru", "v")
        full = half.join(m.select(F.col("node").alias("v"), F.col("rep").alias("rv")), "v")
        e = materialize(full.where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "cc-edges")
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).where("false")
    labels = maps[-1].select("node", F.col("rep").alias("root"))
    for m in reversed(maps[:-1]):
        up = labels.select(F.col("node").alias("rep"), "root")
        labels = m.join(up, "rep", "left").select("node", F.coalesce("root", "rep").alias("root"))
    return materialize(labels, "cc-labels")
