"""Bidirectional flows, TCP states and the event timeline.

A flow's state after a packet depends on four things of the packets so far: which sides sent a SYN and a FIN, the
last decisive flag, whether a plain acknowledgement followed it, and who began.  Each is a maximum, a minimum or a
bit union, so a block of a flow's packets has a small summary, and summaries of blocks add up.  A flow
of any length is thus worked on in all tasks: blocks are summed up, summaries carried over, and windows run
within a block only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretide.operators.ordered import block_of, numbered_in_blocks
from wiretide.operators.scratch import materialize

KEY = ["session_id", "protocol", "ka", "kb"]
#: Fixed state names: fine state to coarse state.
COARSE = {"SYN_SENT": "SYN", "SYN_RECEIVED": "SYN/ACK", "ESTABLISHED": "ESTABLISHED", "FIN_WAIT": "FIN", "CLOSE_WAIT": "FIN", "CLOSED": "CLOSED", "RESET": "RST"}
#: Fixed phase names: coarse state to lifecycle phase.
PHASE = {"SYN": "open", "SYN/ACK": "open", "ACK": "open", "ESTABLISHED": "active", "FIN": "half-closed", "CLOSED": "closed", "RST": "closed"}
PHASE_EVENT = {"open": "FLOW_OPEN", "active": "FLOW_ACTIVE", "half-closed": "FLOW_HALF_CLOSED", "closed": "FLOW_CLOSED"}
LOSS = ("STREAM_GAP", "STREAM_RETRANSMISSION", "STREAM_OVERLAP")


def mapped(c: Column, names: dict[str, str], other: Column | None = None) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in names.items():
        out = out.when(c == k, F.lit(v))
    return out.otherwise(other) if other is not None else out


def endpoint(host: Column, port: Column) -> Column:
    return F.concat_ws(":", host, port.cast("string"))


def keyed(packets: DataFrame) -> DataFrame:
    """Adds the direction-free key: endpoints as (host, port), the smaller first."""
    a = F.struct(F.col("source").alias("h"), F.coalesce("src_port", F.lit(0)).alias("p"))
    b = F.struct(F.col("destination").alias("h"), F.coalesce("dst_port", F.lit(0)).alias("p"))
    return packets.withColumn("ka", F.least(a, b)).withColumn("kb", F.greatest(a, b))


def rollup(packets: DataFrame) -> DataFrame:
    """One row a flow: the first packet gives direction and start, the last gives the end."""
    first = F.min_by(F.struct("source", "destination", "src_port", "dst_port", "ts_us", "packet_id"), "packet_id")
    g = keyed(packets).groupBy(*KEY).agg(first.alias("f"), F.max_by("ts_us", "packet_id").alias("end_us"), F.count("*").alias("packet_count"), F.sum("length").alias("bytes"))
    return g.select("session_id", "protocol", "f.source", "f.destination", "f.src_port", "f.dst_port", F.col("f.ts_us").alias("start_us"), "end_us", "packet_count", "bytes", F.col("f.packet_id").alias("first_packet"), "ka", "kb")


#: Bits of sides that sent a SYN and a FIN: side a, side b.
SYN_A, SYN_B, FIN_A, FIN_B = 1, 2, 4, 8
#: Decisive flags; a code is packet * CODES + flag * 2 + side, so the greatest code is the last flag.
RST, FIN, SYN, CODES = 0, 1, 2, 8


def _bit(mask: int) -> Column:
    return F.col("flags").bitwiseAND(F.lit(mask)) != 0


def with_flags(keyed: DataFrame) -> DataFrame:
    """Adds what a packet adds to its flow's state: ``side``, ``bits``, ``code`` of a decisive flag, ``plain`` packet number of an acknowledgement.

    A reset hides its own SYN, FIN and ACK.
    """
    side = F.when(F.struct(F.col("source").alias("h"), F.coalesce("src_port", F.lit(0)).alias("p")).eqNullSafe(F.col("ka")), 0).otherwise(1)
    tcp = F.col("protocol") == "TCP"
    rst, b = tcp & _bit(4), F.col("side") == 1
    syn, fin, ack = tcp & _bit(2) & ~_bit(4), tcp & _bit(1) & ~_bit(4), tcp & _bit(16) & ~_bit(4)
    bits = F.when(syn, F.when(b, SYN_B).otherwise(SYN_A)).otherwise(0) + F.when(fin, F.when(b, FIN_B).otherwise(FIN_A)).otherwise(0)
    flag = F.when(rst, RST).when(fin, FIN).when(syn, SYN)
    plain = F.when(ack & ~syn & ~fin, F.col("packet_id"))
    return keyed.withColumn("side", side).withColumns({"bits": bits, "code": F.col("packet_id") * CODES + flag * 2 + F.col("side"), "plain": plain})


def state_of(bits: Column, code: Column, plain: Column, first_side: Column, one: Column) -> Column:
    """Fine state from the bits so far, the last decisive code and the last plain acknowledgement.

    ``one``: both endpoints are the same, and all packets count as answers.
    """
    flag, resp = F.floor(code / 2) % 4, (code % 2 != first_side) | one
    both = lambda two: (bits.bitwiseAND(F.lit(two)) == two) & ~one
    decided = (
        F.when(flag == RST, "RESET")
        .when(flag == FIN, F.when(both(FIN_A | FIN_B), "CLOSED").when(resp, "CLOSE_WAIT").otherwise("FIN_WAIT"))
        .when(flag == SYN, F.when(plain > F.floor(code / CODES), "ESTABLISHED").when(both(SYN_A | SYN_B) | resp, "SYN_RECEIVED").otherwise("SYN_SENT"))
    )
    return F.coalesce(decided, F.lit("NONE"))


def summaries(packets: DataFrame) -> DataFrame:
    """``(*KEY, block, count, first, bits, code, plain)``: each flow's packets in each block, combined before they are shuffled."""
    first = F.min(F.struct("packet_id", "source", "src_port", "destination", "dst_port", "side")).alias("first")
    p = with_flags(keyed(packets)).withColumn("block", block_of(F.col("packet_id")))
    return p.groupBy(*KEY, "block").agg(F.count("*").alias("count"), first, F.bit_or("bits").alias("bits"), F.max("code").alias("code"), F.max("plain").alias("plain"))


def _carried(blocks: DataFrame) -> DataFrame:
    """Each block's state before its first packet, its flow's number and first packet."""
    w = Window.partitionBy(*KEY).orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    c = blocks.select(
        *KEY, "block", F.first("first").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("init"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("n0"),
        F.coalesce(F.bit_or("bits").over(before), F.lit(0)).alias("bits0"), F.max("code").over(before).alias("code0"), F.max("plain").over(before).alias("plain0"), (F.row_number().over(w) == 1).alias("begins"),
    )
    c = materialize(c.withColumn("first_packet", F.col("init.packet_id")), "carried")
    starts = c.where("begins").select("session_id", "first_packet")
    ids = numbered_in_blocks(starts, block_of(F.col("first_packet")), ["first_packet"], "flow_id")
    return c.join(ids, ["session_id", "first_packet"]).drop("begins", "first_packet")


def tracked(packets: DataFrame) -> DataFrame:
    """Every packet with its flow's id, initiator, direction, fine and coarse TCP state, stored.

    State is the last decisive flag, promoted by a later plain ACK.  Flow ids are dense, in first-seen
    order within each session.  packet_id tells the packets of a session apart and orders them.
    """
    own = packets.columns
    carried = _carried(summaries(packets))
    # null parts of keys meet too
    at = ["session_id", "protocol", "ka", "kb", "block"]
    p = with_flags(keyed(packets)).withColumn("block", block_of(F.col("packet_id")))
    c = carried.select(*[F.col(x).alias(f"_{x}") for x in at], *[x for x in carried.columns if x not in at])
    p = p.join(c, [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in at]).drop(*[f"_{x}" for x in at])
    w = Window.partitionBy(*at).orderBy("packet_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumns({
        "n": F.row_number().over(w) + F.col("n0"), "bits": F.bit_or("bits").over(upto).bitwiseOR(F.col("bits0")),
        "code": F.greatest(F.max("code").over(upto), F.col("code0")), "plain": F.greatest(F.max("plain").over(upto), F.col("plain0")),
    })
    first_side, one = F.col("init.side"), F.col("ka") == F.col("kb")
    state = state_of(F.col("bits"), F.col("code"), F.col("plain"), first_side, one)
    carried_state = state_of(F.col("bits0"), F.col("code0"), F.col("plain0"), first_side, one)
    p = p.withColumn("tcp_state", state).withColumn("state", mapped(F.col("tcp_state"), COARSE, F.lit("NONE")))
    p = p.withColumn("previous", F.coalesce(F.lag("state", 1).over(w), mapped(carried_state, COARSE, F.lit("NONE"))))
    init = F.struct("init.source", "init.src_port", "init.destination", "init.dst_port")
    out = p.select(*own, init.alias("init"), F.col("n").cast("long").alias("n"), ((F.col("side") != first_side) | one).alias("resp"), "tcp_state", "state", "previous", "flow_id")
    return materialize(out, "tracked")


def flows_of(tracked: DataFrame) -> DataFrame:
    """One row a flow of tracked packets, with its last state."""
    g = tracked.groupBy("session_id", "flow_id", "protocol", "init")
    g = g.agg(F.min_by("ts_us", "packet_id").alias("start_us"), F.max_by("ts_us", "packet_id").alias("end_us"), F.count("*").alias("packet_count"), F.sum("length").alias("bytes"), F.max_by("state", "packet_id").alias("state"))
    return g.select("session_id", "protocol", "init.source", "init.destination", "init.src_port", "init.dst_port", "start_us", "end_us", "packet_count", "bytes", "flow_id", "state")


def packet_lists(tracked: DataFrame) -> DataFrame:
    """``(session_id, flow_id, packets, first_packet, last_packet, packet_ids, bytes, first_us, last_us)`` of every flow.

    packet_ids names all packets of the flow in order, with commas between; null where no packet has
    a number.  A block's part is put together on its own, so numbers of a long flow are sorted in
    many tasks, and only text, a part a block, meets in the flow's row.
    """
    key = ["session_id", "flow_id"]
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("packet_id")), lambda x: x.cast("string")), ",")
    part = tracked.groupBy(*key, block_of(F.col("packet_id")).alias("block")).agg(
        F.count("*").alias("packets"), F.min("packet_id").alias("first_packet"), F.max("packet_id").alias("last_packet"), F.nullif(ids, F.lit("")).alias("ids"),
        F.sum("length").alias("bytes"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    parts = F.array_sort(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("block", "ids"))))
    return part.groupBy(*key).agg(
        F.sum("packets").alias("packets"), F.min("first_packet").alias("first_packet"), F.max("last_packet").alias("last_packet"), F.nullif(F.array_join(F.transform(parts, lambda x: x["ids"]), ","), F.lit("")).alias("packet_ids"),
        F.sum("bytes").alias("bytes"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


def flows(packets: DataFrame) -> DataFrame:
    return flows_of(tracked(packets))


def packet_events(tracked: DataFrame) -> DataFrame:
    """Events of each packet in fixed order, from one scan: start of its flow, TCP transition, then its messages.

    ``messages`` of the packets, where there are any, is an array of struct(event_type, summary).
    """
    a, b = endpoint(F.col("init.source"), F.col("init.src_port")), endpoint(F.col("init.destination"), F.col("init.dst_port"))
    make = lambda when, kind, text: F.when(when, F.struct(kind.alias("event_type"), text.alias("summary")))
    tcp = F.col("protocol") == "TCP"
    own = F.array(
        make(F.col("n") == 1, F.col("protocol"), F.concat(F.col("protocol"), F.lit(" flow "), a, F.lit(" -> "), b)),
        make(tcp & (F.col("state") != F.col("previous")) & (F.col("state") != "NONE"), F.lit("TCP"), F.concat(F.lit("TCP "), a, F.lit(" -> "), b, F.lit(" ["), F.col("state"), F.lit("]"))),
    )
    found = F.concat(own, F.coalesce("messages", F.array().cast("array<struct<event_type:string,summary:string>>"))) if "messages" in tracked.columns else own
    e = tracked.select("session_id", "packet_id", "ts_us", "flow_id", F.posexplode(F.filter(found, lambda x: x.isNotNull())).alias("pos", "e"))
    return e.select("session_id", "packet_id", "ts_us", "flow_id", "pos", "e.event_type", "e.summary")


def in_insertion_order(events: DataFrame, ties: Iterable[str] = ()) -> DataFrame:
    """Events ``(.., packet_id, pos)`` numbered by packet, place and ``ties``; those without a packet come last.  events should be stored."""
    e = events.withColumn("at", F.coalesce("packet_id", F.lit((1 << 63) - 1)))
    # blocks of those without a packet follow all others
    block = F.coalesce(block_of(F.col("packet_id")), F.lit(1 << 62) + block_of(F.col("pos")))
    return numbered_in_blocks(e, block, ["at", "pos", *ties], "event_id").select("session_id", "event_id", "packet_id", "ts_us", "flow_id", "event_type", "summary")


def events_of(tracked: DataFrame) -> DataFrame:
    return in_insertion_order(packet_events(tracked))


def events(packets: DataFrame) -> DataFrame:
    """The timeline of packets, numbered in insertion order."""
    return events_of(tracked(packets))
