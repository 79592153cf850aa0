"""Exports of a session's packets, flows and events: capture files, a JSON document, NDJSON and CSV.

Everything is lines of text written by many tasks.  A document that has one order is dealt into
ranges, so its part files, in order of name, are the document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretide.operators.ordered import dealt, numbered
from wiretide.sources.capture_file import write_captures

#: Fixed field names of exported packets and flows.
PACKET_FIELDS = ("id", "ts", "source", "destination", "protocol", "src_port", "dst_port", "length", "flow_id", "raw_len")
FLOW_FIELDS = ("id", "source", "destination", "protocol", "src_port", "dst_port", "start_ts", "end_ts", "packet_count", "bytes", "state")
EVENT_FIELDS = ("ts", "event_type", "flow_id", "summary")
_KEEP_NULLS = {"ignoreNullFields": "false"}


def seconds(us: str) -> Column:
    """Seconds, written plainly and to the microsecond."""
    return (F.col(us).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(20,6)")


def packet_records(packets: DataFrame) -> DataFrame:
    """``session_id`` and PACKET_FIELDS of packets with flow_id and, where there is one, raw."""
    raw = F.coalesce(F.octet_length("raw"), F.lit(0)) if "raw" in packets.columns else F.col("length")
    return packets.select("session_id", F.col("packet_id").alias("id"), seconds("ts_us").alias("ts"), "source", "destination", "protocol", "src_port", "dst_port", "length", "flow_id", raw.alias("raw_len"))


def flow_records(flows: DataFrame) -> DataFrame:
    return flows.select("session_id", F.col("flow_id").alias("id"), "source", "destination", "protocol", "src_port", "dst_port", seconds("start_us").alias("start_ts"), seconds("end_us").alias("end_ts"), "packet_count", "bytes", "state")


def event_records(events: DataFrame) -> DataFrame:
    return events.select("session_id", "event_id", seconds("ts_us").alias("ts"), "event_type", "flow_id", "summary")


def _json(fields: tuple[str, ...]) -> Column:
    return F.to_json(F.struct(*fields), _KEEP_NULLS)


def ndjson_lines(packets: DataFrame) -> DataFrame:
    """``(session_id, id, line)``: an object a packet, nulls written."""
    return packet_records(packets).select("session_id", "id", _json(PACKET_FIELDS).alias("line"))


def csv_lines(rows: DataFrame, kind: str = "packets") -> DataFrame:
    """``(session_id, id, line)`` of packets or flows; the header is a line of its own, written with the files."""
    if kind not in ("packets", "flows"):
        raise ValueError(f"unknown CSV kind: {kind!r}")
    records, fields = (packet_records(rows), PACKET_FIELDS) if kind == "packets" else (flow_records(rows), FLOW_FIELDS)
    return records.select("session_id", "id", F.to_csv(F.struct(*fields)).alias("line"))


def document_lines(packets: DataFrame, flows: DataFrame, events: DataFrame, names: Column | None = None) -> DataFrame:
    """``(session_id, section, n, line)``: a JSON document a session, in order of section and n.

    Sections: 0 head, 1 flows, 2 events, 3 packets, 4 foot.  Each record is a line; all but the first of a
    list begin with a comma.  A session without rows of a kind has an empty list.
    """
    name = F.to_json(F.struct(F.col("session_id"), (names if names is not None else F.lit(None).cast("string")).alias("name")), _KEEP_NULLS)
    head = packets.select("session_id").distinct()
    ends = [(0, F.concat(F.regexp_replace(name, r"\}$", ""), F.lit(', "flows": ['))), (4, F.lit("]}"))]
    lists = [
        (1, flow_records(flows).select("session_id", F.col("id").alias("at"), _json(FLOW_FIELDS).alias("record"))),
        (2, event_records(events).select("session_id", F.col("event_id").alias("at"), _json(EVENT_FIELDS).alias("record"))),
        (3, packet_records(packets).select("session_id", F.col("id").alias("at"), _json(PACKET_FIELDS).alias("record"))),
    ]
    opened = {2: '], "events": [', 3: '], "packets": ['}
    out = None
    for section, rows in lists:
        ranked = numbered(dealt(rows, ["at"]), ["at"], "n")
        some = ranked.select("session_id", F.lit(section).alias("section"), "n", F.concat(F.when(F.col("n") > 1, ",").otherwise(""), "record").alias("line"))
        if section in opened:
            some = some.unionByName(head.select("session_id", F.lit(section).alias("section"), F.lit(0).cast("long").alias("n"), F.lit(opened[section]).alias("line")))
        out = some if out is None else out.unionByName(some)
    for section, line in ends:
        out = out.unionByName(head.select("session_id", F.lit(section).alias("section"), F.lit(0).cast("long").alias("n"), line.alias("line")))
    return out


def _write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = lines.repartitionByRange(parts, "session_id", *order).sortWithinPartitions("session_id", *order)
    placed.select("session_id", "line").write.partitionBy("session_id").text(path)


def _to_json(path: str, packets: DataFrame, flows: DataFrame, events: DataFrame) -> None:
    _write_lines(document_lines(packets, flows, events), ["section", "n"], path)


def _to_ndjson(path: str, packets: DataFrame, flows: DataFrame, events: DataFrame) -> None:
    _write_lines(ndjson_lines(packets), ["id"], path)


def _to_csv(path: str, packets: DataFrame, flows: DataFrame, events: DataFrame, kind: str = "packets") -> None:
    if kind not in ("packets", "flows"):
        raise ValueError(f"unknown CSV kind: {kind!r}")
    records = packet_records(packets) if kind == "packets" else flow_records(flows)
    records.repartitionByRange("session_id", "id").sortWithinPartitions("session_id", "id").write.partitionBy("session_id").option("header", True).csv(path)


def _to_capture(kind: str) -> Callable[..., None]:
    """A folder of capture files for each session, with original lengths where packets have them."""

    def write(path: str, packets: DataFrame, flows: DataFrame, events: DataFrame) -> None:
        write_captures(packets.select("session_id", "ts_us", "raw", *[c for c in ("orig_len",) if c in packets.columns]), path, kind)

    return write


FORMATS: dict[str, Callable[..., None]] = {"pcap": _to_capture("pcap"), "pcapng": _to_capture("pcapng"), "json": _to_json, "ndjson": _to_ndjson, "csv": _to_csv}


def export(fmt: str, path: str, packets: DataFrame, flows: DataFrame, events: DataFrame, **options: str) -> None:
    """Writes a format by its name, in any case of letters; capture files need raw frames."""
    if fmt.lower() not in FORMATS:
        raise ValueError(f"unknown export format: {fmt!r} (one of {', '.join(sorted(FORMATS))})")
    FORMATS[fmt.lower()](path, packets, flows, events, **options)
