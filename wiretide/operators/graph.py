"""Event graph: the parent of each event, and size and depth of the tree below each root."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_parents(events: DataFrame) -> DataFrame:
    """A parent for each event of a flow: the flow's first event; the first event of a flow is a root."""
    w = Window.partitionBy("session_id", "flow_id").orderBy("event_id")
    first = F.first("event_id").over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.lag("event_id").over(w)
    # a transition hangs on the event before it, all else on the flow's first
    parent = F.when(F.col("event_id") != first, F.when(F.col("event_type") == "TCP", before).otherwise(first))
    return events.select("session_id", "event_id", "flow_id", "event_type", parent.alias("parent_id"))


def descendants(graph: DataFrame) -> DataFrame:
    """``(session_id, root, events, depth)``: number of events in each root's tree and its greatest depth, by pointer doubling.

    Every event points at its parent; pointers double until all reach roots, so a chain of n
    events takes log2(n) joins.  A cycle never reaches a root and is left out.
    """
    up = graph.select("session_id", "event_id", F.coalesce("parent_id", "event_id").alias("top"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"))
    roots = graph.where("parent_id is null").select("session_id", F.col("event_id").alias("top"))
    from wiretide.operators.scratch import materialize

    up = materialize(up, "graph")
    for _ in range(40):
        on = up.select("session_id", F.col("event_id").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        step = materialize(up.join(on, ["session_id", "top"]).select("session_id", "event_id", F.col("next").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("next") != F.col("top")).alias("moved")), "graph")
        up = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    return up.join(roots, ["session_id", "top"], "left_semi").groupBy("session_id", F.col("top").alias("root")).agg(F.count("*").alias("events"), F.max("depth").alias("depth"))
