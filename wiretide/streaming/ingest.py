"""Frames that arrive, as flows and timeline in a Store, the same as batch ingest of all that has come.

A stateful processor per flow keeps what batch ingest carries between blocks (who began, sides that sent a SYN
and a FIN, the last decisive flag and acknowledgement) and both reassembly edges: some hundred bytes, and one
waiting segment a direction.  Each micro-batch is run once, into a folder of its own number that a repeated
batch overwrites; then its events are appended and its flows upserted under that number, so a
replay changes nothing.

Flow ids and event numbers depend on all flows of a session, so they are given when the store is read;
until then a flow is named by its first packet.  Holes that are open are read off the flows' last
records, as they close when more bytes come.

With ``measured``, flows' records also hold their measurements, which ``live_facts`` gives as facts, each stream's
once.  The state then has 16 bytes more for each segment that nothing has acknowledged.  With ``idle_s``, a flow of which nothing
came for so long (by the cluster's clock, as captures' own times may lie anywhere) is closed: segments that wait
behind a hole end it as the end of a capture does, open segments are let go, and the record is marked closed.  A
segment that comes later reopens the flow: it counts like any other, in the same flow; bytes that belong into a
hole given up are retransmissions, acknowledgements match only segments since; the next record takes the
place of the one before, so facts stay one set a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from wiretide.functions.dispatch import applications, messages
from wiretide.functions.frames import parse
from wiretide.operators import flows as W
from wiretide.operators.facts import facts_of, rates
from wiretide.operators.ingest import ISSUES
from wiretide.operators.ordered import block_of, numbered_in_blocks
from wiretide.operators.reassembly import SPAN, Direction, Piece, ahead, drain
from wiretide.operators.scratch import materialize
from wiretide.sources.store import Store
from wiretide.streaming import measures as M
from wiretide.streaming.flows import ROCKSDB

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
FLOW = ["session_id", "protocol", "ha", "pa", "hb", "pb"]
#: Place of reassembly's issues after all other events of a packet.
LATER = 1 << 20
_STATE = (
    "first long, source string, src_port int, destination string, dst_port int, start_us long, end_us long, last long, count long, bytes long, "
    "syn int, fin int, decided string, acked boolean, state string, edge0 long, seq0 long, data0 binary, packet0 long, ts0 long, edge1 long, seq1 long, data1 binary, packet1 long, ts1 long, low_us long, high_us long, due long, " + M.STATE
)
_FIELDS = [x.split()[0] for x in _STATE.split(", ")]
OUTPUT = (
    "kind string, session_id string, first_packet long, packet_id long, pos long, ts_us long, event_type string, summary string, protocol string, source string, destination string, "
    "src_port int, dst_port int, start_us long, end_us long, last_packet long, packet_count long, bytes long, state string, hole0 string, hole0_us long, hole1 string, hole1_us long, closed boolean, spread_us long, "
    + ", ".join(f"{f} long" for f in M.RECORD)
)
_OUT = [x.split()[0] for x in OUTPUT.split(", ")]
_NUMBERS = {x.split()[0]: "Int64" for x in OUTPUT.split(", ") if x.split()[1] in ("long", "int")}


def decoded(frames: DataFrame, named: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A stream of packets of ``(session_id, packet_id, ts_us, raw)``, keyed by flow, with their decoders' messages;
    ``named`` gives parsed packets the names of their hosts in place of addresses."""
    length = F.coalesce("orig_len", F.octet_length("raw")) if "orig_len" in frames.columns else F.octet_length("raw")
    p = parse(frames.withColumn("length", F.coalesce(length, F.lit(0)).cast("long")))
    p = p.withColumn("source", F.coalesce("source", F.lit(""))).withColumn("destination", F.coalesce("destination", F.lit("")))
    p = named(p) if named else p
    p = applications(p).withColumn("flags", F.coalesce("tcp_flags", F.lit(0)))
    p = W.keyed(p.withColumn("messages", messages(p)))
    kinds, texts = F.col("messages.event_type"), F.col("messages.summary")
    segment = F.when(F.col("protocol") == "TCP", F.col("payload"))
    return p.select(
        "session_id", "protocol", F.col("ka.h").alias("ha"), F.col("ka.p").alias("pa"), F.col("kb.h").alias("hb"), F.col("kb.p").alias("pb"), "packet_id", "ts_us",
        "source", "src_port", "destination", "dst_port", "length", "flags", F.col("tcp_seq").alias("seq"), F.col("tcp_ack").alias("ack"), F.col("tcp_window").alias("window"), segment.alias("data"), kinds.alias("kinds"), texts.alias("texts"),
    )


def _whole(x) -> int | None:
    return None if x is None or x != x else int(x)


def _port(host: str, port: int | None) -> str:
    return host if port is None else f"{host}:{port}"


class Flow:
    """One flow so far."""

    def __init__(self, key: tuple, state: tuple | None, measured: bool = False, rfc: bool = False) -> None:
        self.key, self.closed = key, False
        self.s = dict(zip(_FIELDS, state, strict=True)) if state else None
        self.measures = M.Measures(self.s or {}, rfc) if measured and key[1] == "TCP" else None
        self.sides = [self._side(i) if self.s else Direction() for i in (0, 1)]

    def _side(self, i: int) -> Direction:
        edge, seq, data, packet = (self.s[f"{x}{i}"] for x in ("edge", "seq", "data", "packet"))
        return Direction(edge, [Piece(seq, bytes(data), packet)] if seq is not None else [])

    def take(self, r) -> Iterator[tuple]:
        """Events of a packet: ``(pos, event_type, summary)``."""
        protocol, src, dst = self.key[1], (r.source, _whole(r.src_port)), (r.destination, _whole(r.dst_port))
        begins = self.s is None
        if begins:
            self.s = dict.fromkeys(_FIELDS) | {"first": int(r.packet_id), "source": src[0], "src_port": src[1], "destination": dst[0], "dst_port": dst[1], "start_us": int(r.ts_us), "count": 0, "bytes": 0, "syn": 0, "fin": 0, "acked": False, "state": "NONE"}
        s = self.s
        resp = src[0] == s["destination"] and (src[1] or 0) == (s["dst_port"] or 0)
        s["count"], s["bytes"], s["end_us"], s["last"] = s["count"] + 1, s["bytes"] + int(r.length), int(r.ts_us), int(r.packet_id)
        s["low_us"], s["high_us"] = (x(int(r.ts_us), s[c]) if s[c] is not None else int(r.ts_us) for x, c in ((min, "low_us"), (max, "high_us")))
        was = s["state"]
        if self.measures:
            size = 0 if r.data is None else len(r.data)
            self.measures.take(int(resp), int(r.ts_us), int(r.flags), _whole(r.seq) or 0, _whole(r.ack) or 0, size, _whole(r.window))
        if protocol == "TCP":
            self._flags(int(r.flags), int(resp))
        ends = f"{_port(s['source'], s['src_port'])} -> {_port(s['destination'], s['dst_port'])}"
        found = [(protocol, f"{protocol} flow {ends}")] if begins else []
        if protocol == "TCP" and s["state"] not in (was, "NONE"):
            found.append(("TCP", f"TCP {ends} [{s['state']}]"))
        for pos, (kind, text) in enumerate([*found, *zip(r.kinds, r.texts, strict=True)]):
            yield pos, kind, text
        if r.data is not None and len(r.data) and _whole(r.seq) is not None:
            told = self.sides[resp].row((), int(r.packet_id), int(r.seq), bytes(r.data))
            if any(p.packet == r.packet_id for p in self.sides[resp].waiting):
                s[f"ts{int(resp)}"] = int(r.ts_us)
            if told and told[2]:
                yield LATER, ISSUES.get(told[2], "STREAM_ERROR"), told[4]

    def _flags(self, flags: int, side: int) -> None:
        s = self.s
        if flags & 4:
            s["decided"], s["acked"] = "RESET", False
        elif flags & 3:
            s["syn"] |= (flags >> 1 & 1) << side
            s["fin"] |= (flags & 1) << side
            if flags & 1:
                s["decided"] = "CLOSED" if s["fin"] == 3 else "CLOSE_WAIT" if side else "FIN_WAIT"
            else:
                s["decided"] = "SYN_RECEIVED" if s["syn"] == 3 or side else "SYN_SENT"
            s["acked"] = False
        elif flags & 16:
            s["acked"] = True
        fine = "ESTABLISHED" if s["acked"] and s["decided"] in ("SYN_SENT", "SYN_RECEIVED") else s["decided"]
        s["state"] = W.COARSE.get(fine, "NONE")

    def end(self) -> Iterator[tuple]:
        """Closes the flow; ``(direction, ts_us, event_type, summary)`` of a hole in each."""
        for i, d in enumerate(self.sides):
            if d.waiting:
                ends = [(p.seq + len(p.data)) % SPAN for p in d.waiting]
                issue = drain(d.edge, d.waiting)[1]
                d.edge, d.waiting = max(ends, key=lambda e: ahead(e, d.edge)), []
                yield i, self.s[f"ts{i}"], ISSUES[issue.kind], issue.detail
        self.closed = True
        if self.measures:
            self.measures.forget()

    def state(self) -> tuple:
        for i, d in enumerate(self.sides):
            seq, data, packet = d.waiting[0] if d.waiting else (None, None, None)
            self.s |= {f"edge{i}": d.edge, f"seq{i}": seq, f"data{i}": data, f"packet{i}": packet}
        if self.measures:
            self.s |= self.measures.state()
        return tuple(self.s[f] for f in _FIELDS)

    def record(self) -> dict:
        s = self.s
        holes = {}
        for i, d in enumerate(self.sides):
            issue = drain(d.edge, d.waiting)[1] if d.waiting else None
            holes |= {f"hole{i}": issue.detail if issue else None, f"hole{i}_us": s[f"ts{i}"] if issue else None}
        return {"kind": "flow", "session_id": self.key[0], "first_packet": s["first"], "protocol": self.key[1], "last_packet": s["last"], "packet_count": s["count"]} | {c: s[c] for c in ("source", "destination", "src_port", "dst_port", "start_us", "end_us", "bytes", "state")} | holes | {"closed": self.closed, "spread_us": s["high_us"] - s["low_us"]} | (self.measures.record() if self.measures else {})


class FlowProcessor(StatefulProcessor):
    """Packets of a flow in a micro-batch, in order of their numbers -> events and the flow's new record."""

    def __init__(self, measured: bool = False, rfc: bool = False, idle_ms: int | None = None) -> None:
        self.measured, self.rfc, self.idle_ms = measured, rfc, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("flow", _STATE)

    def _flow(self, key) -> Flow:
        return Flow(key, self.held.get() if self.held.exists() else None, self.measured, self.rfc)

    def _rows(self, flow: Flow, events: list[dict]) -> pd.DataFrame:
        self.held.update(flow.state())
        events = [{"kind": "event", "session_id": flow.key[0], "first_packet": flow.s["first"]} | e for e in events]
        return pd.DataFrame([*events, flow.record()], columns=_OUT, dtype=object).astype(_NUMBERS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        flow, out = self._flow(key), []
        for r in pd.concat(list(rows)).sort_values("packet_id").itertuples(index=False):
            out += [{"packet_id": int(r.packet_id), "pos": pos, "ts_us": int(r.ts_us), "event_type": kind, "summary": text} for pos, kind, text in flow.take(r)]
        if self.idle_ms is not None:
            if flow.s["due"] is not None:
                self.handle.deleteTimer(flow.s["due"])
            flow.s["due"] = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(flow.s["due"])
        yield self._rows(flow, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        flow = self._flow(key)
        out = [{"packet_id": None, "pos": i, "ts_us": ts, "event_type": kind, "summary": text} for i, ts, kind, text in flow.end()]
        flow.s["due"] = None
        yield self._rows(flow, out)

    def close(self) -> None:
        pass


def tracked_stream(frames: DataFrame, measured: bool = False, rfc: bool = False, idle_s: float | None = None, named: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A stream of events and of flows' records (``kind``) of a stream of frames; needs the RocksDB state store."""
    processor = FlowProcessor(measured, rfc, None if idle_s is None else int(idle_s * 1000))
    return decoded(frames, named).groupBy(*FLOW).transformWithStateInPandas(processor, OUTPUT, "Append", "None" if idle_s is None else "ProcessingTime")


def ingest_stream(frames: DataFrame, store: Store, checkpoint: str, name: str = "ingest", measured: bool = False, rfc: bool = False, idle_s: float | None = None, every: str | None = None, named: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Starts ingesting frames into the store's live_events and live_flows: those that are there now, or with ``every`` (as
    "10 seconds") those that come until the query is stopped.

    Frames of a flow must arrive in order of packet_id over micro-batches; inside one they are sorted.
    checkpoint is a shared folder of this stream's own, name tells its rows from those of other
    streams into the same store.  ``named`` names hosts, as in ``decoded``.  Idle flows are closed in a batch after their time, so ``idle_s`` needs
    ``every``.
    """
    if idle_s is not None and every is None:
        raise ValueError("idle_s needs every: streams end with no batch after the last")
    spark = frames.sparkSession

    def put(batch: DataFrame, i: int) -> None:
        staged = f"{checkpoint}/staged/{i % 2}"  # the processor runs once a batch, whatever is made of its rows; a batch before the last is stored
        batch.write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(batch.schema).parquet(staged)
        if idle_s is not None and rows.isEmpty():  # a batch that only looked at the clock
            return
        store.append("live_events", rows.where("kind = 'event'").select("session_id", "first_packet", "packet_id", "pos", "ts_us", "event_type", "summary"), f"{name}-{i}")
        store.put("live_flows", rows.where("kind = 'flow'").drop("kind", "packet_id", "pos", "ts_us", "event_type", "summary"), f"{name}-{i}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:  # the setting is read when a stream starts
        now = {"availableNow": True} if every is None else {"processingTime": every}
        writer = tracked_stream(frames, measured, rfc, idle_s, named).writeStream.outputMode("append").trigger(**now).option("checkpointLocation", f"{checkpoint}/state")
        return writer.foreachBatch(put).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _live_flows(store: Store) -> DataFrame:
    """Last records of flows with dense ids."""
    f = materialize(store.table("live_flows"), "flows")
    return numbered_in_blocks(f, block_of(F.col("first_packet")), ["first_packet"], "flow_id")


def live_facts(store: Store, closed: bool = False) -> DataFrame:
    """Facts of streams that were ingested with ``measured``, as facts.stream_facts gives them: one set a stream, off its last
    record; with ``closed`` only of streams that idled out and were not reopened."""
    f = _live_flows(store)
    f = f.where("closed") if closed else f
    udp = f.where(F.col("protocol").isin("UDP", "DNS")).select("session_id", "flow_id", F.col("packet_count").alias("datagrams"), "bytes", F.col("spread_us").alias("us"))
    return facts_of(f.where("protocol = 'TCP' and dup_acks is not null"), rates(udp))


def ingested(store: Store) -> tuple[DataFrame, DataFrame]:
    """(flows, events) of all that has come, as batch ingest gives them: dense ids, events numbered, open holes last."""
    f = materialize(_live_flows(store), "flows")
    ids = f.select("session_id", "first_packet", "flow_id")
    e = store.table("live_events").join(ids, ["session_id", "first_packet"])
    pos = F.when(F.col("packet_id").isNull(), F.col("flow_id") * 2 + F.col("pos")).otherwise(F.col("pos"))
    e = e.select("session_id", "packet_id", "ts_us", "flow_id", pos.alias("pos"), "event_type", "summary")
    sides = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"hole{i}").alias("summary"), F.col(f"hole{i}_us").alias("ts_us")) for i in (0, 1)])
    holes = f.select("session_id", "flow_id", F.explode(sides).alias("h")).where("h.summary is not null")
    holes = holes.select("session_id", F.lit(None).cast("long").alias("packet_id"), "h.ts_us", "flow_id", (F.col("flow_id") * 2 + F.col("h.i")).cast("long").alias("pos"), F.lit("STREAM_GAP").alias("event_type"), "h.summary")
    flows = f.select("session_id", "protocol", "source", "destination", "src_port", "dst_port", "start_us", "end_us", "packet_count", "bytes", "flow_id", "state")
    return flows, W.in_insertion_order(materialize(e.unionByName(holes), "events"), ["ts_us", "summary"])
