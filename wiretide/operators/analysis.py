"""Statistics, comparison, fingerprints, loss, replay schedules and redaction over packets, flows and events."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretide.operators.flows import LOSS
from wiretide.operators.ordered import dealt, numbered, previous
from wiretide.operators.sanitize import ip_token

#: Fixed port categories.
PORT_NAMES = {80: "web", 443: "web-alt", 8080: "web-alt2", 53: "dns", 25: "mail", 587: "mail-alt"}
DOMAIN_WEIGHTS = {"domain": 3.0, "ip": 1.0, "port": 0.5}
PATTERN_WEIGHTS = {"proto": 1.0, "event": 1.5, "port": 0.75}


def port_category(port: Column) -> Column:
    out = F.when(port.isNull(), "none")
    for p, name in PORT_NAMES.items():
        out = out.when(port == p, name)
    return out.when(port < 1024, "well-known").otherwise("ephemeral")


def session_stats(packets: DataFrame, flows: DataFrame, events: DataFrame) -> DataFrame:
    p = packets.groupBy("session_id").agg(F.count("*").alias("packets"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    f = flows.groupBy("session_id").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("flows"), F.count_if(F.col("state") == "RST").alias("resets"))
    e = events.groupBy("session_id").agg(F.count("*").alias("events"), F.count_if(F.col("event_type").isin(*LOSS[1:])).alias("retransmissions"))
    out = p.join(f, "session_id", "left").join(e, "session_id", "left")
    duration = (F.col("last_us") - F.col("first_us")) / 1e6
    window = F.when(duration > 0, duration).otherwise(1.0)
    return out.select("session_id", "packets", "bytes", "flows", "events", "resets", "retransmissions", "first_us", "last_us", duration.alias("duration"), F.round(F.col("packets") / window, 6).alias("pps"), F.round(F.col("bytes") * 8 / window, 6).alias("bps"), F.round(F.col("bytes") / F.col("packets"), 6).alias("avg_size"))


def _side(flows: DataFrame, session: str, suffix: str) -> DataFrame:
    a, b = F.struct(F.col("source").alias("h"), F.col("src_port").alias("p")), F.struct(F.col("destination").alias("h"), F.col("dst_port").alias("p"))
    f = flows.where(F.col("session_id") == session).withColumn("a", F.least(a, b)).withColumn("b", F.greatest(a, b))
    last = Window.partitionBy("protocol", "a", "b").orderBy(F.col("start_us").desc(), F.col("flow_id").desc())
    f = f.withColumn("rn", F.row_number().over(last)).where("rn = 1")
    return f.select("protocol", F.col("a.h").alias("host_a"), F.col("a.p").alias("port_a"), F.col("b.h").alias("host_b"), F.col("b.p").alias("port_b"), *[F.col(c).alias(f"{c}_{suffix}") for c in ("packet_count", "bytes", "state", "start_us", "end_us")])


PAIR = ["protocol", "host_a", "port_a", "host_b", "port_b"]


def _paired(flows: DataFrame, before: str, after: str, how: str) -> DataFrame:
    """Flows of two sessions side by side by protocol and endpoints; a missing port equals a missing port."""
    x, y = _side(flows, before, "before").alias("x"), _side(flows, after, "after").alias("y")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in PAIR]
    j = x.join(y, functools.reduce(lambda a, b: a & b, same), how)
    rest = [c for c in (*x.columns, *y.columns) if c not in PAIR]
    return j.select(*[F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in PAIR], *rest)


def flow_diff(flows: DataFrame, before: str, after: str) -> DataFrame:
    j = _paired(flows, before, after, "full_outer")
    same = (F.col("packet_count_before") == F.col("packet_count_after")) & (F.col("bytes_before") == F.col("bytes_after")) & (F.col("state_before") == F.col("state_after"))
    status = F.when(F.col("packet_count_before").isNull(), "added").when(F.col("packet_count_after").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(*PAIR, status.alias("status"), (zero("packet_count_after") - zero("packet_count_before")).alias("packet_delta"), (zero("bytes_after") - zero("bytes_before")).alias("byte_delta"))


def timing_diff(flows: DataFrame, before: str, after: str) -> DataFrame:
    j = _paired(flows, before, after, "inner")
    span = lambda s: F.greatest(F.lit(0), F.col(f"end_us_{s}") - F.col(f"start_us_{s}"))
    return j.select(*PAIR, span("before").alias("before_us"), span("after").alias("after_us"), (span("after") - span("before")).alias("delta_us"))


def event_diff(events: DataFrame, before: str, after: str) -> DataFrame:
    e = events.where(F.col("session_id").isin(before, after)).groupBy("event_type")
    e = e.agg(F.count_if(F.col("session_id") == before).alias("n_before"), F.count_if(F.col("session_id") == after).alias("n_after"))
    return e.withColumn("delta", F.col("n_after") - F.col("n_before"))


def domain_features(flows: DataFrame, events: DataFrame, max_events: int | None = None) -> DataFrame:
    """``(session_id, kind, feature, count)``: names in DNS and TLS events, addresses, protocol and port.

    ``max_events`` bounds the events of a session that are searched for names; None takes all.
    """
    first = events if max_events is None else events.where(F.col("event_id") <= max_events)
    first = first.where(F.col("event_type").isin("DNS", "TLS"))
    names = F.array(F.regexp_extract("summary", r"sni=([^\s]+)", 1), F.regexp_extract("summary", r"DNS (?:QUERY|RESPONSE) ([^\s(]+)", 1))
    d = first.select("session_id", F.lit("domain").alias("kind"), F.explode(names).alias("feature")).where("feature <> ''").withColumn("feature", F.lower("feature"))
    i = flows.select("session_id", F.lit("ip").alias("kind"), F.explode(F.array("source", "destination")).alias("feature"))
    p = flows.where("dst_port <> 0").select("session_id", F.lit("port").alias("kind"), F.concat_ws(":", "protocol", F.col("dst_port").cast("string")).alias("feature"))
    return d.unionByName(i).unionByName(p).groupBy("session_id", "kind", "feature").agg(F.count("*").alias("count"))


def pattern_features(flows: DataFrame, events: DataFrame) -> DataFrame:
    a = flows.select("session_id", F.lit("proto").alias("kind"), F.upper("protocol").alias("feature"))
    b = flows.select("session_id", F.lit("port").alias("kind"), port_category(F.col("dst_port")).alias("feature"))
    c = events.select("session_id", F.lit("event").alias("kind"), F.upper("event_type").alias("feature"))
    return a.unionByName(b).unionByName(c).groupBy("session_id", "kind", "feature").agg(F.count("*").alias("count"))


def cosine_to(features: DataFrame, weights: dict[str, float], target: str) -> DataFrame:
    """Cosine of every other session's weighted feature vector with the target's."""
    w = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in weights.items()])
    v = features.select("session_id", "kind", "feature", (F.col("count") * w).alias("x"))
    t = v.where(F.col("session_id") == target).select("kind", "feature", F.col("x").alias("y"))
    norm_t = t.agg(F.sum(F.col("y") * F.col("y")).alias("tt"))
    per = v.where(F.col("session_id") != target).join(t, ["kind", "feature"], "left").groupBy("session_id")
    per = per.agg(F.sum(F.col("x") * F.col("x")).alias("ss"), F.sum(F.col("x") * F.coalesce("y", F.lit(0.0))).alias("dot"), F.count_if(F.col("y").isNotNull()).alias("shared"))
    # one row, by construction
    return per.join(F.broadcast(norm_t)).select("session_id", F.round(F.col("dot") / (F.sqrt("ss") * F.sqrt("tt")), 9).alias("score"), "shared")


def loss_spans(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("session_id", "flow_id").orderBy("ts_us", "event_id")
    e = events.where(F.col("event_type").isin(*LOSS))
    return e.select("session_id", "flow_id", F.col("ts_us").alias("start_us"), F.coalesce(F.lead("ts_us").over(w), F.col("ts_us")).alias("end_us"), F.lower(F.substring("event_type", 8, 100)).alias("severity"), F.col("summary").alias("detail"))


def schedule(packets: DataFrame, speed: float = 1.0, cap: float | None = None, cap_first: bool = False) -> DataFrame:
    """Waits before each packet of a session: scaled then capped, or capped then scaled; the first is 0."""
    order = ["ts_us", "packet_id"]
    p = previous(dealt(packets.select("session_id", "packet_id", "ts_us"), order), order, "ts_us", "before")
    gap = F.greatest(F.lit(0), F.col("ts_us") - F.coalesce("before", "ts_us")) / 1e6
    if cap is not None and cap_first:
        wait = F.least(gap, F.lit(cap)) / speed
    else:
        wait = gap / speed if cap is None else F.least(gap / speed, F.lit(cap))
    return p.select("session_id", "packet_id", "ts_us", wait.alias("wait"))


def duplicate_acks(tracked: DataFrame) -> DataFrame:
    """Packets per flow that only repeat the last acknowledgement of their side (ack taken from ``ack``)."""
    w = Window.partitionBy("session_id", "flow_id", "resp").orderBy("packet_id").rowsBetween(Window.unboundedPreceding, -1)
    acks = tracked.where((F.col("protocol") == "TCP") & (F.col("flags").bitwiseAND(F.lit(16)) != 0))
    acks = acks.withColumn("before", F.last("ack", ignorenulls=True).over(w))
    pure = (F.col("flags").bitwiseAND(F.lit(2)) == 0) & (F.col("payload") == 0)
    return acks.groupBy("session_id", "flow_id").agg(F.count_if(pure & (F.col("ack") == F.col("before"))).alias("dup_acks"), F.count("*").alias("acks"))


def pseudonyms(packets: DataFrame) -> DataFrame:
    """``(session_id, address, token)``: addresses numbered in first-seen order, source before destination."""
    o = packets.select("session_id", "ts_us", "packet_id", F.posexplode(F.array("source", "destination")).alias("pos", "address")).where("address <> ''")
    first = o.groupBy("session_id", "address").agg(F.min(F.struct("ts_us", "packet_id", "pos")).alias("at"))
    placed = numbered(dealt(first, ["at"]), ["at"], "i").withColumn("i", F.col("i") - 1)
    return placed.select("session_id", "address", ip_token(F.col("i")).alias("token"))


def redact_ips(packets: DataFrame) -> DataFrame:
    """Packets with both addresses replaced by their session's tokens."""
    t = pseudonyms(packets)
    s = t.select("session_id", F.col("address").alias("source"), F.col("token").alias("source_token"))
    d = t.select("session_id", F.col("address").alias("destination"), F.col("token").alias("destination_token"))
    return packets.join(s, ["session_id", "source"], "left").join(d, ["session_id", "destination"], "left")


def regression_checks(stats: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """``(session_id, name, passed)`` for rules (name, column, limit); names begin with min_ or max_."""
    checks = F.array(*[F.struct(F.lit(n).alias("name"), (F.col(c) >= v if n.startswith("min_") else F.col(c) <= v).alias("passed")) for n, c, v in rules])
    return stats.select("session_id", F.explode(checks).alias("c")).select("session_id", "c.name", "c.passed")
