"""From captured frames to packets, flows, the timeline and TCP measurements.

frames -> parse -> dispatch to decoders -> track flows -> events of packets, and issues of reassembly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretide.functions.dispatch import applications, messages
from wiretide.functions.frames import parse
from wiretide.operators import flows as W
from wiretide.operators.ordered import dealt, numbered
from wiretide.operators.reassembly import reassemble
from wiretide.operators.scratch import materialize
from wiretide.operators.tls import decrypt_events, records
from wiretide.sources.capture_file import NO_SESSION

#: Fixed event types of reassembly issues.
ISSUES = {"gap": "STREAM_GAP", "retransmission": "STREAM_RETRANSMISSION", "overlap": "STREAM_OVERLAP"}


def of_captures(captures: DataFrame) -> DataFrame:
    """Frames of capture files: a file is a session named by its path's last part, packets count from 1.

    Files below a folder ``session_id=<name>``, as exports write them, are one session, whose packets count
    in order of time, then of file and place.
    """
    folder = F.regexp_extract("path", r"/session_id=([^/]*)/[^/]*$", 1)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.(pcap|pcapng)$", "")
    rest = ["ts_us", "raw", F.col("orig_len").cast("long").alias("orig_len")]
    alone = captures.where(folder == "").select(name.alias("session_id"), (F.col("capture_seq") + 1).alias("packet_id"), *rest)
    parts = captures.where(folder != "").select(F.nullif(F.url_decode(folder), F.lit(NO_SESSION)).alias("session_id"), "path", "capture_seq", *rest)
    if parts.isEmpty():
        return alone
    order = ["ts_us", "path", "capture_seq"]
    counted = numbered(dealt(parts.withColumn("session_id", F.coalesce("session_id", F.lit(""))), order), order, "packet_id")
    return alone.unionByName(counted.select(*alone.columns))


def decoded(frames: DataFrame) -> DataFrame:
    """Packets of ``frames(session_id, packet_id, ts_us, raw)`` with addresses, TCP fields, payload and decoders' structs.

    length is the original length where frames have one, else that of raw.  Frames that parse as
    nothing stay, as protocol UNKNOWN without addresses.
    """
    length = F.coalesce("orig_len", F.octet_length("raw")) if "orig_len" in frames.columns else F.octet_length("raw")
    p = materialize(parse(frames.withColumn("length", F.coalesce(length, F.lit(0)))), "parsed")
    p = p.withColumn("source", F.coalesce("source", F.lit(""))).withColumn("destination", F.coalesce("destination", F.lit("")))
    return materialize(applications(p).withColumn("flags", F.coalesce("tcp_flags", F.lit(0))), "decoded")


def packets_of(decoded: DataFrame) -> DataFrame:
    """Packets as the flow operators take them, with the messages of their decoders."""
    return decoded.select("session_id", "packet_id", "ts_us", "source", "destination", "protocol", "src_port", "dst_port", "length", "flags", "tcp_seq", "tcp_ack", "tcp_window", "payload", messages(decoded).alias("messages"))


def issue_events(tracked: DataFrame) -> DataFrame:
    """Events of TCP reassembly; holes that are open at the end have no packet and the time of the packet behind them."""
    r = reassemble(segments_of(tracked)).where("issue is not null").drop("data")
    at = tracked.select("session_id", F.col("packet_id").alias("cause_packet"), "ts_us")
    kind = W.mapped(F.col("issue"), ISSUES, F.lit("STREAM_ERROR"))
    # after all other events of a packet; at the end by flow, the initiator's direction first
    pos = F.when(F.col("packet_id").isNotNull(), F.lit(1 << 20)).otherwise(F.col("flow_id") * 2 + F.col("resp").cast("int"))
    return r.join(at, ["session_id", "cause_packet"]).select("session_id", "packet_id", "ts_us", "flow_id", pos.cast("long").alias("pos"), kind.alias("event_type"), F.col("detail").alias("summary"))


def segments_of(tracked: DataFrame) -> DataFrame:
    """TCP segments of tracked packets, as ``reassemble`` takes them."""
    return tracked.where("protocol = 'TCP' and payload is not null").select("session_id", "flow_id", "resp", "packet_id", F.col("tcp_seq").alias("seq"), F.col("payload").alias("data"))


def timeline(tracked: DataFrame, keylog: DataFrame | None = None) -> DataFrame:
    """All events of tracked packets with payloads, numbered: packets' own, then reassembly's of each packet, the open holes last.

    With a key log, events of what it opens follow all others.
    """
    own = W.packet_events(tracked).withColumn("pos", F.col("pos").cast("long"))
    events = own.unionByName(issue_events(tracked))
    if keylog is not None:
        events = events.unionByName(decrypt_events(records(reassemble(segments_of(tracked))), keylog, tracked))
    return W.in_insertion_order(materialize(events, "events"))


def ingest(frames: DataFrame, keylog: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(packets with flow ids, flows, events) of frames, and of their TLS records as far as a key log opens them."""
    t = W.tracked(packets_of(decoded(frames)))
    return t, W.flows_of(t), timeline(t, keylog)
