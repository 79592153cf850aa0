"""Facts of packets and of ended streams, conversations, and decoders' findings as VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretide.operators.sessions import FACTS, page_bounds
from wiretide.operators.tcp_metrics import metrics

FLOW = ["session_id", "flow_id"]
#: Fixed order of a stream's facts.
STREAM_FACTS = ("dup_acks", "retransmissions", "zero_window", "handshake_rtt", "rtt_count", "rtt_min", "rtt_avg", "rtt_max", "window_min", "window_max", "datagrams", "avg_size", "datagrams_per_second")
FACTS_LIMIT = 1000


def infos(decoded: DataFrame) -> DataFrame:
    """``(session_id, packet_id, info)``: what decoders found, a VARIANT object with a field for each; null fields stay, bytes are hex.

    ``variant_get(info, '$.dns.qname', 'string')`` and the like are predicates on it; ``to_json`` gives its text.
    """
    found = []
    for name in FACTS:
        fields = [F.lower(F.hex(F.col(name)[f.name])).alias(f.name) if f.dataType.typeName() == "binary" else F.col(name)[f.name].alias(f.name) for f in decoded.schema[name].dataType]
        found.append(F.when(F.col(name).isNotNull(), F.struct(F.lit(name).alias("key"), F.to_variant_object(F.struct(*fields)).alias("value"))))
    some = F.filter(F.array(*found), lambda x: x.isNotNull())
    return decoded.select("session_id", "packet_id", F.to_variant_object(F.map_from_entries(some)).alias("info"))


def info_of(info: Column, path: str, kind: str = "string") -> Column:
    """A field of ``infos``, null where it is not there or of another kind; path as ``dns.qname``."""
    return F.try_variant_get(info, f"$.{path}", kind)


def in_order(facts: DataFrame, packet_id: int | None = None, stream_id: int | None = None, protocol: str | None = None, limit: int | None = FACTS_LIMIT) -> DataFrame:
    """Facts that have the given values, packets' before streams', in the order in which they were found.

    A page of ``limit``, as the reports have it; None gives all.
    """
    page_bounds(limit, 0)
    for name, value in (("packet_id", packet_id), ("stream_id", stream_id), ("protocol", protocol)):
        if value is not None:
            facts = facts.where(F.col(name) == value) if name in facts.columns else facts.where("false")
    order = {n: i for i, n in enumerate([*(f"{p}.{n}" for p, names in FACTS.items() for n in names), *(f"tcp.{n}" for n in STREAM_FACTS), *(f"udp.{n}" for n in STREAM_FACTS)])}
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.concat_ws(".", "protocol", "name")]
    number = lambda c: F.col(c) if c in facts.columns else F.lit(None).cast("long")
    placed = facts.withColumn("_place", place)
    return placed if limit is None else placed.orderBy("session_id", number("packet_id").asc_nulls_last(), number("stream_id"), "_place").limit(limit).drop("_place")


def seconds_text(us: Column) -> Column:
    """Microseconds as seconds, in the shortest digits; below a tenth of a millisecond with an exponent."""
    us = us.cast("long")
    tail = F.rtrim(F.lpad((us % 1_000_000).cast("string"), 6, "0"), F.lit("0"))
    plain = F.concat(F.floor(us / 1_000_000).cast("string"), F.lit("."), F.when(tail == "", "0").otherwise(tail))
    tens = F.concat(F.floor(us / 10).cast("string"), F.when(us % 10 == 0, "").otherwise(F.concat(F.lit("."), (us % 10).cast("string"))), F.lit("e-05"))
    return F.when((us == 0) | (us >= 100), plain).when(us < 10, F.concat(us.cast("string"), F.lit("e-06"))).otherwise(tens)


def datagrams(tracked: DataFrame) -> DataFrame:
    """One row a UDP flow: datagrams, their mean size and their number a second (of at least one, where all came at once)."""
    g = tracked.where(F.col("protocol").isin("UDP", "DNS")).groupBy(*FLOW)
    return rates(g.agg(F.count("*").alias("datagrams"), F.sum("length").alias("bytes"), (F.max("ts_us") - F.min("ts_us")).alias("us")))


def rates(g: DataFrame) -> DataFrame:
    """``datagrams`` from flows' ``datagrams, bytes, us``: their number, their bytes and the time between the first and the last."""
    window = F.when(F.col("us") > 0, F.col("us") / 1e6).otherwise(1.0)
    return g.select(*FLOW, "datagrams", F.round(F.col("bytes") / F.col("datagrams"), 3).alias("avg_size"), F.round(F.col("datagrams") / window, 3).alias("datagrams_per_second"))


def stream_facts(tracked: DataFrame, rfc: bool = False) -> DataFrame:
    """``(session_id, stream_id, protocol, name, value)``: the measurements of every TCP and UDP flow as facts, once its packets are all there.

    A stream is a flow, by its number.  What could not be measured is left out.
    """
    return facts_of(metrics(tracked, rfc), datagrams(tracked))


def facts_of(m: DataFrame, d: DataFrame) -> DataFrame:
    """``stream_facts`` from rows as ``metrics`` and ``datagrams`` give them."""
    text = lambda c: F.col(c).cast("string")
    tcp = {
        "dup_acks": text("dup_acks"), "retransmissions": text("retransmissions"), "zero_window": text("zero_window"), "handshake_rtt": seconds_text(F.col("handshake_us")), "rtt_count": F.when(F.col("rtt_count") > 0, text("rtt_count")),
        "rtt_min": seconds_text(F.col("rtt_min_us")), "rtt_avg": seconds_text(F.round(F.col("rtt_sum_us") / F.col("rtt_count"))), "rtt_max": seconds_text(F.col("rtt_max_us")), "window_min": text("window_min"), "window_max": text("window_max"),
    }
    udp = {c: text(c) for c in ("datagrams", "avg_size", "datagrams_per_second")}
    out = None
    for protocol, rows, values in (("tcp", m, tcp), ("udp", d, udp)):
        pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in values.items()]), lambda x: x["value"].isNotNull())
        some = rows.select("session_id", F.col("flow_id").alias("stream_id"), F.lit(protocol).alias("protocol"), F.explode(pairs).alias("f")).select("session_id", "stream_id", "protocol", "f.*")
        out = some if out is None else out.unionByName(some)
    return out


def conversations(flows: DataFrame, tracked: DataFrame, reassembled: DataFrame) -> DataFrame:
    """One row a TCP flow: its ends, packets with data and contiguous bytes of each side, and its measurements."""
    side = lambda resp, c: F.coalesce(F.sum(F.when(F.col("resp") == resp, c)), F.lit(0))
    size = F.octet_length("data").cast("long")
    written = reassembled.groupBy(*FLOW).agg(side(False, size).alias("client_bytes"), side(True, size).alias("server_bytes"))
    data = (F.coalesce(F.octet_length("payload"), F.lit(0)) > 0).cast("long")
    segments = tracked.where("protocol = 'TCP'").groupBy(*FLOW).agg(side(False, data).alias("client_segments"), side(True, data).alias("server_segments"))
    ends = flows.where("protocol = 'TCP'").select(*FLOW, F.col("source").alias("client"), F.col("src_port").alias("client_port"), F.col("destination").alias("server"), F.col("dst_port").alias("server_port"), "start_us", "end_us", "state")
    out = ends.join(segments, FLOW).join(written, FLOW, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("client_bytes", "server_bytes")})
    return out.join(metrics(tracked), FLOW, "left")
