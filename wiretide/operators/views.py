"""Pages, orders and small lookups of the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretide.operators.sessions import page_bounds

#: Fixed names of orders of flows; any other is by start.
FLOW_ORDERS = {"bytes": "bytes", "packets": "packet_count"}


def flows_sorted(flows: DataFrame, sort: str = "start_ts", limit: int | None = None) -> DataFrame:
    """Flows by start, or by most bytes or packets; ties by id.  An unknown order is by start."""
    first = F.desc(FLOW_ORDERS[sort]) if sort in FLOW_ORDERS else F.asc("start_us")
    out = flows.orderBy(first, "session_id", "flow_id")
    return out if limit is None else out.limit(limit)


def packet_page(packets: DataFrame, session_id: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of a session's packets in order of time and number, with the session's total beside each."""
    page_bounds(limit, offset)
    own = packets.where(F.col("session_id") == session_id)
    page = own.orderBy("ts_us", "packet_id").offset(offset).limit(limit)
    return page.join(F.broadcast(own.agg(F.count("*").alias("total"))))  # one row


def recent(events: DataFrame, n: int) -> DataFrame:
    """The first n events by time, the last of them first, as the report prints them."""
    page_bounds(n, 0)
    return events.orderBy("ts_us", "event_id").limit(n).orderBy(F.desc("ts_us"), F.desc("event_id"))


def clock_text(us: Column) -> Column:
    """Local time of day with milliseconds, cut off, in the session's time zone."""
    return F.date_format(F.timestamp_micros(us), "HH:mm:ss.SSS")


def by_status(diff: DataFrame, status: str) -> DataFrame:
    """Flows of a comparison that were added, removed, changed or unchanged."""
    return diff.where(F.col("status") == status)


def with_flags(stats: DataFrame, loss: DataFrame) -> DataFrame:
    """Statistics with has_traffic, and has_loss where the session has any finding of ``loss``."""
    lost = loss.select("session_id").distinct().withColumn("has_loss", F.lit(True))
    out = stats.join(lost, "session_id", "left").withColumn("has_loss", F.coalesce("has_loss", F.lit(False)))
    return out.withColumn("has_traffic", F.coalesce(F.col("packets") > 0, F.lit(False)))


def children(events: DataFrame) -> DataFrame:
    """``(session_id, event_id, place, child_id)`` of events with parent_id: each event's children in order of id, a row each."""
    w = Window.partitionBy("session_id", "parent_id").orderBy("event_id")
    kids = events.where("parent_id is not null").select("session_id", F.col("parent_id").alias("of"), F.row_number().over(w).alias("place"), F.col("event_id").alias("child_id"))
    return kids.withColumnRenamed("of", "event_id").select("session_id", "event_id", "place", "child_id")


def shared_features(features: DataFrame, target: str) -> DataFrame:
    """``(session_id, kind, feature, count, target_count)``: what every other session shares with the target, a row each."""
    t = features.where(F.col("session_id") == target).select("kind", "feature", F.col("count").alias("target_count"))
    return features.where(F.col("session_id") != target).join(t, ["kind", "feature"]).select("session_id", "kind", "feature", "count", "target_count")


def clamped(scores: DataFrame) -> DataFrame:
    """Scores of incidents between 0 and 1; 0 where a side has no features."""
    return scores.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)))))


def totals(features: DataFrame) -> DataFrame:
    """``(session_id, kind, total, different)`` of fingerprints."""
    return features.groupBy("session_id", "kind").agg(F.sum("count").alias("total"), F.count("*").alias("different"))
