"""Registered queries of the packet-analytics operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiretide.functions.display_filter import apply_filter
from wiretide.operators import analysis as A
from wiretide.operators import flows as W
from wiretide.operators import graph as G
from wiretide.operators import ordered as O  # noqa: N812
from wiretide.operators import views as V
from wiretide.operators.selection import ReplaySelection
from wiretide.sources.adapter import packets

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FLOW = ["session_id", "flow_id", "source", "destination", "protocol", "src_port", "dst_port", "start_us", "end_us", "packet_count", "bytes", "state"]
PACKET = ["session_id", "packet_id", "ts_us", "source", "destination", "protocol", "src_port", "dst_port", "length"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _flows(s: SparkSession, d: str) -> DataFrame:
    return W.flows(packets(s, d)).select(*FLOW)


def _events(s: SparkSession, d: str) -> DataFrame:
    return W.events(packets(s, d))


def _flows_events(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Flows and events, not numbered, of one pass over the packets."""
    t = W.tracked(packets(s, d))
    return W.flows_of(t).select(*FLOW), W.packet_events(t)


def _said(s: SparkSession, d: str) -> DataFrame:
    """Events where their numbers don't matter."""
    return W.packet_events(W.tracked(packets(s, d)))


def _span(s: SparkSession, d: str) -> DataFrame:
    """One row: first and last time of all packets."""
    return packets(s, d).agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))


@query
def flow_rollup(s, d):
    return _flows(s, d)


@query
def flow_ids(s, d):
    return W.tracked(packets(s, d)).select("session_id", "packet_id", "flow_id")


@query
def flow_started(s, d):
    return W.tracked(packets(s, d)).where("n = 1").select("session_id", "packet_id", "flow_id", "source", "destination")


@query
def responder_flag(s, d):
    return W.tracked(packets(s, d)).groupBy("session_id", "flow_id").agg(F.count_if("resp").alias("from_responder"), F.count_if(~F.col("resp")).alias("from_initiator"))


@query
def tcp_state(s, d):
    return W.tracked(packets(s, d)).where("protocol = 'TCP'").select("session_id", "packet_id", "tcp_state", "state")


@query
def tcp_transitions(s, d):
    return W.tracked(packets(s, d)).where("protocol = 'TCP' and state <> previous").select("session_id", "packet_id", "ts_us", "flow_id", F.col("previous").alias("from_state"), F.col("state").alias("to_state"))


@query
def lifecycle_events(s, d):
    t = W.tracked(packets(s, d)).where("protocol = 'TCP' and state <> previous")
    was, now = W.mapped(F.col("previous"), W.PHASE), W.mapped(F.col("state"), W.PHASE)
    t = t.withColumn("phase", now).where(now.isNotNull() & ~now.eqNullSafe(was))
    a, b = W.endpoint(F.col("init.source"), F.col("init.src_port")), W.endpoint(F.col("init.destination"), F.col("init.dst_port"))
    return t.select("session_id", "packet_id", "flow_id", W.mapped(F.col("phase"), W.PHASE_EVENT).alias("event_type"), F.concat("protocol", F.lit(" "), a, F.lit(" -> "), b, F.lit(" "), "phase").alias("summary"))


@query
def event_feed(s, d):
    return _events(s, d)


@query
def timeline_range(s, d):
    x = _span(s, d)
    e = _events(s, d).join(F.broadcast(x)).where("ts_us >= lo + (hi - lo) div 4 and ts_us <= lo + (hi - lo) div 2")
    return e.select("session_id", "event_id", "ts_us", "event_type", "flow_id", "summary")


@query
def timeline_types(s, d):
    return _events(s, d).where(F.col("event_type").isin("DNS", "STREAM_GAP")).select("session_id", "event_id", "ts_us", "event_type", "summary")


@query
def event_type_counts(s, d):
    return _said(s, d).groupBy("session_id", "event_type").agg(F.count("*").alias("n"))


@query
def stats(s, d):
    t = W.tracked(packets(s, d))
    return A.session_stats(t, W.flows_of(t), W.packet_events(t))


@query
def session_info(s, d):
    t = W.tracked(packets(s, d))
    e = W.packet_events(t).groupBy("session_id").agg(F.count("*").alias("events"))
    p = t.groupBy("session_id").agg(F.count("*").alias("packets"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count_if(F.col("n") == 1).alias("flows"))
    return p.join(e, "session_id", "left").withColumn("events", F.coalesce("events", F.lit(0)))


@query
def flows_by_bytes(s, d):
    return _flows(s, d).orderBy(F.col("bytes").desc(), "session_id", "flow_id").limit(50).select("session_id", "flow_id", "bytes")


@query
def packets_page(s, d):
    return packets(s, d).select(*PACKET).orderBy("ts_us", "packet_id").offset(200).limit(100)


@query
def keyset_page(s, d):
    x = packets(s, d).where("packet_id = 500").select(F.col("ts_us").alias("t"), F.col("packet_id").alias("i"))
    p = packets(s, d).join(F.broadcast(x)).where("ts_us > t or ts_us = t and packet_id > i")
    return p.select(*PACKET).orderBy("ts_us", "packet_id").limit(512)


@query
def flow_packets_all(s, d):
    return W.packet_lists(W.tracked(packets(s, d)))


@query
def filter_proto_port(s, d):
    return apply_filter(packets(s, d).select(*PACKET), "tcp and port == 443")


@query
def filter_not_null(s, d):
    return apply_filter(_events(s, d), "not length > 10 and not protocol == tcp").select("session_id", "event_id")


@query
def filter_ip_ne(s, d):
    return apply_filter(packets(s, d).select(*PACKET), "ip != 203.0.113.1 and length < 90").select("session_id", "packet_id")


@query
def filter_contains(s, d):
    return apply_filter(_events(s, d), "summary contains 'QUERY H1'").select("session_id", "event_id", "summary")


@query
def filter_numeric_eq(s, d):
    return apply_filter(packets(s, d).select(*PACKET), "length == 50.0 or (sport >= 49155 and not dns)").select("session_id", "packet_id")


@query
def filter_limit_first(s, d):
    return apply_filter(packets(s, d).select(*PACKET).orderBy("ts_us", "packet_id").limit(1000), "dns or dport == 80").select("session_id", "packet_id")


@query
def search_flows(s, d):
    return _flows(s, d).where(F.col("source").ilike("%10.0.1%") | F.col("destination").ilike("%10.0.1%")).select("session_id", "flow_id", "source", "destination")


@query
def search_events(s, d):
    return _events(s, d).where(F.col("summary").ilike("%RESPONSE h_.example%")).select("session_id", "event_id", "summary")


@query
def search_packets(s, d):
    p = packets(s, d).where(F.col("source").ilike("%113.5") | F.col("destination").ilike("%113.5"))
    return p.orderBy("ts_us", "packet_id").limit(100).select("session_id", "packet_id", "source", "destination")


@query
def flow_diff(s, d):
    return A.flow_diff(_flows(s, d), "s0", "s1")


@query
def timing_diff(s, d):
    """Clients of the sessions never meet, so they and their ports are put under one name first."""
    f, client = _flows(s, d), r"^10\.0\.\d+\.\d+$"
    for host, port in (("source", "src_port"), ("destination", "dst_port")):
        f = f.withColumn(port, F.when(F.col(host).rlike(client), 1).otherwise(F.col(port))).withColumn(host, F.regexp_replace(host, client, "client"))
    return A.timing_diff(f, "s0", "s1")


@query
def event_diff(s, d):
    return A.event_diff(_said(s, d), "s0", "s1")


@query
def identical(s, d):
    f, e = _flows_events(s, d)
    f = A.flow_diff(f, "s0", "s1").agg(F.coalesce(F.bool_and(F.col("status") == "unchanged"), F.lit(True)).alias("flows_same"))
    e = A.event_diff(e, "s0", "s1").agg(F.coalesce(F.bool_and(F.col("delta") == 0), F.lit(True)).alias("events_same"))
    return f.join(F.broadcast(e)).select((F.col("flows_same") & F.col("events_same")).alias("identical"))


@query
def domain_fingerprint_all(s, d):
    return A.domain_features(*_flows_events(s, d))


@query
def behaviour_fingerprint(s, d):
    return A.pattern_features(*_flows_events(s, d))


@query
def similar_sessions_all(s, d):
    c = A.cosine_to(A.domain_features(*_flows_events(s, d)), A.DOMAIN_WEIGHTS, "s0")
    return c.where("score > 0").orderBy(F.col("score").desc(), "session_id").limit(10)


@query
def similar_incidents(s, d):
    return A.cosine_to(A.pattern_features(*_flows_events(s, d)), A.PATTERN_WEIGHTS, "s0")


@query
def probe_search(s, d):
    f = A.pattern_features(*_flows_events(s, d)).groupBy("session_id").agg(F.collect_set(F.when(F.col("kind") == "event", F.col("feature"))).alias("ev"), F.collect_set(F.when(F.col("kind") == "proto", F.col("feature"))).alias("pr"), F.sum("count").alias("score"))
    return f.where(F.arrays_overlap("ev", F.array(F.lit("STREAM_GAP"))) & F.arrays_overlap("pr", F.array(F.lit("TCP"), F.lit("UDP")))).select("session_id", "score")


@query
def loss_spans(s, d):
    return A.loss_spans(_events(s, d))


@query
def loss_report(s, d):
    n = lambda k: F.count_if(F.col("severity") == k)
    return A.loss_spans(_events(s, d)).groupBy("session_id").agg(n("gap").alias("gaps"), n("retransmission").alias("retransmissions"), n("overlap").alias("overlaps"), F.sum(F.col("end_us") - F.col("start_us")).alias("lost_us"))


@query
def story_gaps(s, d):
    order = ["ts_us", "event_id"]
    e = O.previous(O.dealt(_events(s, d).select("session_id", *order), order), order, "ts_us", "before")
    return e.select("session_id", "event_id", (F.greatest(F.lit(0), F.col("ts_us") - F.coalesce("before", "ts_us")) / 2e6).alias("wait"))


@query
def replay_schedule_story(s, d):
    return A.schedule(packets(s, d).where("protocol = 'TCP'"), 2.0, 5.0)


@query
def replay_schedule_faithful(s, d):
    return A.schedule(packets(s, d), 1.0)


@query
def build_schedule(s, d):
    return A.schedule(packets(s, d), 2.0, 5.0, cap_first=True)


@query
def virtual_clock(s, d):
    p = A.schedule(packets(s, d), 1.0).withColumn("us", F.bround(F.col("wait") * 1e6).cast("long"))
    order = ["ts_us", "packet_id"]
    return O.summed(O.dealt(p, order), order, "us", "clock_us").select("session_id", "packet_id", "clock_us")


@query
def replay_offset_limit(s, d):
    order = ["ts_us", "packet_id"]
    p = O.numbered(O.dealt(packets(s, d).select("session_id", *order, "length"), order), order, "rn")
    p = p.withColumn("ok", F.col("length") > 45).withColumn("sent", F.when((F.col("rn") > 20) & F.col("ok"), 1).otherwise(0))
    p = O.summed(p, order, "sent", "done").where("rn > 20 and done - sent < 30")
    return p.select("session_id", "packet_id", "ok")


@query
def selection_semi(s, d):
    chosen = _flows(s, d).where("bytes > 1500").select("session_id", "flow_id")
    return W.tracked(packets(s, d)).join(chosen, ["session_id", "flow_id"], "left_semi").select("session_id", "packet_id", "flow_id")


@query
def scenario_select(s, d):
    x = _span(s, d)
    t = W.tracked(packets(s, d)).join(F.broadcast(x)).where("ts_us between lo + (hi - lo) div 10 and lo + (hi - lo) div 3 and protocol in ('DNS') and flow_id in (1, 2, 3, 5, 8)")
    return t.select("session_id", "packet_id", "flow_id")


@query
def udp_metrics(s, d):
    g = W.tracked(packets(s, d)).where("protocol = 'DNS'").groupBy("session_id", "flow_id").agg(F.count("*").alias("datagrams"), F.sum("length").alias("bytes"), ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("duration"))
    return g.select("session_id", "flow_id", "datagrams", "bytes", F.round(F.col("bytes") / F.col("datagrams"), 6).alias("avg_size"), F.round(F.col("datagrams") / F.when(F.col("duration") > 0, F.col("duration")).otherwise(1.0), 6).alias("per_second"))


@query
def dup_acks(s, d):
    t = W.tracked(packets(s, d)).withColumn("ack", F.col("k") % 7).withColumn("payload", F.when(F.col("length") > 60, F.col("length") - 60).otherwise(0))
    return A.duplicate_acks(t)


@query
def handshake_rtt(s, d):
    t = W.tracked(packets(s, d)).where("protocol = 'TCP'")
    w = Window.partitionBy("session_id", "flow_id").orderBy("packet_id").rowsBetween(Window.unboundedPreceding, 0)
    bit = lambda m: F.col("flags").bitwiseAND(F.lit(m)) != 0
    t = t.withColumn("syn_us", F.last(F.when(~F.col("resp") & bit(2) & ~bit(16), F.col("ts_us")), ignorenulls=True).over(w))
    t = t.where(F.col("resp") & bit(2) & bit(16) & F.col("syn_us").isNotNull())
    return t.groupBy("session_id", "flow_id").agg(F.min_by(F.greatest(F.lit(0), F.col("ts_us") - F.col("syn_us")), "packet_id").alias("rtt_us"))


@query
def protocol_facts(s, d):
    e = _events(s, d).where("event_type = 'DNS' and summary like 'DNS %' and summary not like 'DNS flow%'")
    q = F.regexp_extract("summary", r"DNS (?:QUERY|RESPONSE) ([^\s(]+)", 1)
    facts = F.array(F.struct(F.lit("qname").alias("name"), q.alias("value")), F.struct(F.lit("rcode").alias("name"), F.regexp_extract("summary", r"rcode=(\d+)", 1).alias("value")), F.struct(F.lit("answers").alias("name"), F.regexp_extract("summary", r"answers=([^\s]+)", 1).alias("value")))
    return e.select("session_id", "packet_id", F.explode(facts).alias("f")).where("f.value <> ''").select("session_id", "packet_id", "f.name", "f.value")


@query
def pseudonym_table(s, d):
    return A.pseudonyms(packets(s, d))


@query
def redact_ip(s, d):
    return A.redact_ips(packets(s, d)).select("session_id", "packet_id", "source_token", "destination_token")


@query
def redact_text(s, d):
    t = F.regexp_replace("summary", r"\b[A-Za-z0-9][A-Za-z0-9._-]*\.[A-Za-z]{2,}\b", "host.example")
    return _events(s, d).select("session_id", "event_id", F.regexp_replace(t, r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "0.0.0.0").alias("summary"))


@query
def regression_checks(s, d):
    t = W.tracked(packets(s, d))
    return A.regression_checks(A.session_stats(t, W.flows_of(t), W.packet_events(t)), [("min_packets", "packets", 100), ("max_resets", "resets", 40), ("min_flows", "flows", 10**9), ("max_retransmissions", "retransmissions", 10**6)])


@query
def port_category(s, d):
    return _flows(s, d).groupBy("session_id", A.port_category(F.col("dst_port")).alias("category")).agg(F.count("*").alias("flows"))


@query
def event_tree(s, d):
    return G.descendants(G.with_parents(_events(s, d)))


@query
def export_ndjson_rows(s, d):
    p = packets(s, d).select(*PACKET)
    return p.select("packet_id", F.to_json(F.struct("packet_id", "ts_us", "source", "destination", "protocol", "src_port", "dst_port", "length"), {"ignoreNullFields": "false"}).alias("line"))


@query
def replay_selection(s, d):
    """Packets 100 to 4000 of flows 1 to 40, in a middle part of the capture."""
    lo, hi = _span(s, d).first()
    chosen = ReplaySelection(frozenset(range(100, 4001)), frozenset(range(1, 41)), lo + (hi - lo) // 10, hi)
    return chosen.select(W.tracked(packets(s, d))).select("session_id", "packet_id", "flow_id")


@query
def packet_page_total(s, d):
    return V.packet_page(packets(s, d), "s1", 25, 50).select("session_id", "packet_id", "ts_us", "total")


@query
def flows_by_packets(s, d):
    return V.flows_sorted(_flows(s, d), "packets", 100).select("session_id", "flow_id", "packet_count")


@query
def event_children(s, d):
    return V.children(G.with_parents(_events(s, d)))


@query
def shared_features(s, d):
    return V.shared_features(A.domain_features(*_flows_events(s, d)), "s0")


@query
def session_flags(s, d):
    t = W.tracked(packets(s, d))
    e = W.packet_events(t)
    return V.with_flags(A.session_stats(t, W.flows_of(t), e), e.where(F.col("event_type").isin(*W.LOSS))).select("session_id", "has_traffic", "has_loss")


@query
def clock_times(s, d):
    return packets(s, d).select("session_id", "packet_id", V.clock_text(F.col("ts_us")).alias("clock"))
