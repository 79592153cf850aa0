"""Views and checks of sessions: facts, search, packet and flow detail, regression, replay results, hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.operators.scratch import materialize

#: Fixed fields of decoders that become facts.
FACTS = {"dns": ("qname", "qtype", "rcode", "answers"), "tls": ("sni", "version"), "http": ("method", "path", "host", "status"), "http2": ("frame_type", "stream_id"), "quic": ("version", "packet_type")}
#: Fixed names of statuses from older sessions.
STATUS = {"complete": "ready", "running": "capturing", "error": "failed"}
SEARCH_CAPS = {"flow": 100, "event": 200, "packet": 100}
#: Expectations of a regression case: the statistic and the sense of each bound.
BOUNDS = {"min_packets": ("packets", ">="), "max_packets": ("packets", "<="), "min_flows": ("flows", ">="), "max_flows": ("flows", "<="), "min_duration": ("duration", ">="), "max_duration": ("duration", "<="), "max_resets": ("resets", "<=")}


def facts(decoded: DataFrame) -> DataFrame:
    """``(session_id, packet_id, protocol, name, value)``: decoders' fields as rows; null and empty ones left out, 0 kept."""
    found = []
    for protocol, names in FACTS.items():
        for name in names:
            value = F.col(protocol)[name]
            text = F.array_join(value, ",") if name == "answers" else value.cast("string")
            found.append(F.struct(F.lit(protocol).alias("protocol"), F.lit(name).alias("name"), text.alias("value")))
    rows = decoded.select("session_id", "packet_id", F.explode(F.filter(F.array(*found), lambda x: x["value"] != "")).alias("f"))
    return rows.select("session_id", "packet_id", "f.*")


def legacy_status(status: Column) -> Column:
    return F.coalesce(*[F.when(status == k, F.lit(v)) for k, v in STATUS.items()], status)


def timeline_types(text: str | None) -> list[str] | None:
    """Event types of a comma list, trimmed and upper-cased; None where there are none."""
    kinds = [x.strip().upper() for x in (text or "").split(",")]
    return [x for x in kinds if x] or None


def timeline(events: DataFrame, types: str | None = None, start_us: int | None = None, end_us: int | None = None, flow_id: int | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Events in a time range, of some types, of one flow, in order of time and id; a page where limit is given."""
    page_bounds(limit, offset)
    out, kinds = events, timeline_types(types)
    for test in (kinds and F.col("event_type").isin(*kinds), start_us is not None and F.col("ts_us") >= start_us, end_us is not None and F.col("ts_us") <= end_us, flow_id is not None and F.col("flow_id") == flow_id):
        out = out.where(test) if isinstance(test, Column) else out
    return out if limit is None else out.orderBy("ts_us", "event_id").offset(offset).limit(limit)


def page_bounds(limit: int | None, offset: int) -> None:
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    if offset < 0:
        raise ValueError("offset must not be negative")


def capture_filter_fault(expression: str) -> str | None:
    """What makes a capture filter unacceptable, None if nothing; the filter itself is only handed on."""
    text = expression.strip()
    if text.count("(") != text.count(")"):
        return "unbalanced parentheses"
    if any(text.count(q) % 2 for q in "'\""):
        return "unbalanced quotes"
    found = [t for t in (";", "&&", "|", "`", "$(") if t in text]
    return f"illegal token {found[0]!r}" if found else None


def search(flows: DataFrame, events: DataFrame, packets: DataFrame, needle: str, caps: dict[str, int] | None = None) -> DataFrame:
    """``(kind, session_id, id, text)`` of flows and packets by endpoint and events by summary, in any case of letters.

    A blank needle finds nothing.  caps bounds each kind, by start or time, as the reports do; {} takes all.
    """
    text = needle.strip()
    bounds = SEARCH_CAPS if caps is None else caps
    has = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
    ends = has("source") | has("destination")
    pair = F.concat_ws(" -> ", "source", "destination")
    kinds = {
        "flow": (flows.where(ends), "start_us", "flow_id", pair),
        "event": (events.where(has("summary")), "ts_us", "event_id", F.col("summary")),
        "packet": (packets.where(ends), "ts_us", "packet_id", pair),
    }
    out = None
    for kind, (rows, time, key, shown) in kinds.items():
        if kind in bounds:
            rows = rows.orderBy(time, "session_id", key).limit(bounds[kind])
        found = rows.where(F.lit(bool(text))).select(F.lit(kind).alias("kind"), "session_id", F.col(key).alias("id"), shown.alias("text"))
        out = found if out is None else out.unionByName(found)
    return out


def hex_rows(df: DataFrame, key: list[str], raw: str = "raw", width: int = 16) -> DataFrame:
    """``key, offset, hex, ascii``: bytes as rows of ``width``; other than printable ones show as dots."""
    if width <= 0:
        raise ValueError("width must be positive")
    x = df.where(F.octet_length(raw) > 0).select(*key, F.col(raw).alias("_r"), F.explode(F.sequence(F.lit(0), F.octet_length(raw) - 1, F.lit(width))).alias("offset"))
    part = F.substring("_r", F.col("offset") + 1, F.lit(width))
    pairs = F.trim(F.regexp_replace(F.lower(F.hex(part)), "(..)", "$1 "))
    return x.select(*key, F.col("offset").cast("long").alias("offset"), pairs.alias("hex"), F.regexp_replace(F.decode(part, "ISO-8859-1"), r"[^ -~]", ".").alias("ascii"))


def layer_tree(decoded: DataFrame) -> DataFrame:
    """``(session_id, packet_id, tree)``: JSON of the layers of each packet, Ethernet outside, messages inside."""
    from wiretide.functions import protocols as L  # noqa: N812

    node = lambda name, fields, children: F.struct(name.alias("name"), fields.alias("fields"), children.alias("children"))
    told = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c.upper()).alias("name"), F.struct(text(F.col(c)).alias("summary")).alias("fields"))) for c, text in (("dns", L.dns_summary), ("tls", L.tls_summary), ("http", L.http_summary))]
    transport = node(F.coalesce("protocol", F.lit("Unknown")), F.struct("src_port", "dst_port", "length"), F.filter(F.array(*told), lambda x: x.isNotNull()))
    ip = node(F.lit("IP"), F.struct("source", "destination", "ttl"), F.array(transport))
    return decoded.select("session_id", "packet_id", F.to_json(node(F.lit("Ethernet"), F.struct("source", "destination"), F.array(ip)), {"ignoreNullFields": "false"}).alias("tree"))


def flow_detail(flows: DataFrame, packets: DataFrame) -> DataFrame:
    """Flows with duration, rates and times of their first and last packet; packets of a flow are rows, in ``flow_packets``."""
    times = packets.groupBy("session_id", "flow_id").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    took = F.greatest(F.lit(0), F.col("end_us") - F.col("start_us")) / 1e6
    window = F.when(took > 0, took).otherwise(1.0)
    return flows.join(times, ["session_id", "flow_id"], "left").select("session_id", "flow_id", took.alias("duration"), F.round(F.col("packet_count") / window, 6).alias("packets_per_second"), F.round(F.col("bytes") / window, 6).alias("bytes_per_second"), "first_us", "last_us")


def packet_detail(events: DataFrame) -> DataFrame:
    """``(session_id, packet_id, ...)`` of events with parent_id: first event, ids of the events above and below, whether one is an error.

    A packet has as many events as its decoders and reassembly found, so lists are short; children of
    an event are counted, and only their ids below this packet's events are listed.
    """
    e = events.where("packet_id is not null")
    first = e.groupBy("session_id", "packet_id").agg(F.min_by(F.struct("event_id", "event_type", "summary", "ts_us", "flow_id"), "event_id").alias("f"), F.bool_or(F.col("event_type").isin("ERROR", "STREAM_ERROR")).alias("has_error"), F.array_sort(F.collect_set("parent_id")).alias("upstream"))
    mine = e.select("session_id", F.col("event_id").alias("parent_id"), "packet_id")
    below = events.select("session_id", "parent_id", F.col("event_id").alias("child")).join(mine, ["session_id", "parent_id"]).groupBy("session_id", "packet_id").agg(F.count("*").alias("downstream"))
    out = first.join(below, ["session_id", "packet_id"], "left")
    return out.select("session_id", "packet_id", "f.event_id", "f.event_type", "f.summary", "f.flow_id", "upstream", F.coalesce("downstream", F.lit(0)).alias("downstream"), "has_error")


def capture_integrity(packets: DataFrame, events: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """``(session_id, dropped, malformed, gaps, status, is_complete)`` of each session.

    malformed are frames that parse as nothing, gaps the holes of streams.  status is complete without dropped and
    malformed packets; is_complete asks for no gaps besides.  dropped is ``(session_id, dropped)``, 0 where there is none.
    """
    m = packets.groupBy("session_id").agg(F.count_if(F.col("protocol") == "UNKNOWN").alias("malformed"))
    g = events.where("event_type = 'STREAM_GAP'").groupBy("session_id").agg(F.count("*").alias("gaps"))
    out = m.join(g, "session_id", "left")
    out = out.join(dropped, "session_id", "left") if dropped is not None else out.withColumn("dropped", F.lit(0).cast("long"))
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("gaps", "dropped")})
    whole = (F.col("dropped") == 0) & (F.col("malformed") == 0)
    return out.select("session_id", "dropped", "malformed", "gaps", F.when(whole, "complete").otherwise("partial").alias("status"), (whole & (F.col("gaps") == 0)).alias("is_complete"))


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """``(file, name, session, key, value)``: a row for each expectation of the regression cases below ``path`` (``*.check.json``).

    An event type is a row of its own; a case without expectations is one row with a null key.  Unknown keys and a missing
    session are errors.
    """
    schema = "name string, session string, expect map<string,string>"
    files = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.check.json").json(path).withColumn("file", F.col("_metadata.file_path"))
    stem = F.regexp_replace(F.element_at(F.split("session", "/"), -1), r"\.[^.]*$", "")
    known = F.array(*[F.lit(k) for k in (*BOUNDS, "event_types")])
    wrong = F.filter(F.map_keys("expect"), lambda k: ~F.array_contains(known, k))
    checked = F.when(F.col("session").isNull(), F.raise_error(F.concat("file", F.lit(": missing 'session'")))).when(F.size(wrong) > 0, F.raise_error(F.concat(F.lit("unknown expectation keys: "), F.array_join(wrong, ", ")))).otherwise(F.col("session"))
    rows = files.select("file", F.coalesce("name", stem).alias("name"), checked.alias("session"), F.explode_outer("expect").alias("key", "value"))
    types = F.from_json("value", "array<string>")
    values = F.when(F.col("key") == "event_types", types).otherwise(F.array("value"))
    return rows.select("file", "name", "session", "key", F.explode_outer(values).alias("value"))


def regression(cases: DataFrame, stats: DataFrame, events: DataFrame) -> DataFrame:
    """``(name, session, check, passed, detail)``: a row for each expectation; a case without any passes with a null check.

    A session that is not in ``stats`` fails its case with the detail "session not found".
    """
    seen = events.select("session_id", F.upper("event_type").alias("value")).distinct().withColumn("present", F.lit(True))
    c = cases.withColumn("wanted", F.when(F.col("key") == "event_types", F.upper("value")))
    j = c.join(stats.withColumnRenamed("session_id", "session"), "session", "left")
    j = j.join(seen.select(F.col("session_id").alias("session"), F.col("value").alias("wanted"), "present"), ["session", "wanted"], "left")
    actual = F.coalesce(*[F.when(F.col("key") == k, F.col(stat).cast("double")) for k, (stat, _) in BOUNDS.items()])
    at_least = F.col("key").isin(*[k for k, (_, sense) in BOUNDS.items() if sense == ">="])
    limit = F.col("value").cast("double")
    name = F.concat(F.coalesce(*[F.when(F.col("key") == k, F.lit(f"{stat} {sense} ")) for k, (stat, sense) in BOUNDS.items()]), "value")
    missing, event = F.col("packets").isNull(), F.col("key") == "event_types"
    passed = F.when(missing, False).when(F.col("key").isNull(), True).when(event, F.coalesce("present", F.lit(False))).otherwise(F.when(at_least, actual >= limit).otherwise(actual <= limit))
    detail = F.when(missing, "session not found").when(event, F.when(passed, "present").otherwise("absent")).otherwise(F.concat(F.lit("actual="), actual.cast("string")))
    return j.select("name", "session", F.when(event, F.concat(F.lit("event "), "value")).otherwise(name).alias("check"), passed.alias("passed"), detail.alias("detail"))


def regression_summary(results: DataFrame) -> DataFrame:
    """One row: cases that passed and failed, whether all passed, and the line that says so."""
    per = results.groupBy("name", "session").agg(F.bool_and("passed").alias("ok"))
    n = per.agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))
    return n.select("passed", "failed", (F.col("failed") == 0).alias("ok"), F.concat(F.col("passed").cast("string"), F.lit(" passed, "), F.col("failed").cast("string"), F.lit(" failed")).alias("summary"))


def replay_stats(results: DataFrame) -> DataFrame:
    """Totals a session of ``(session_id, status, bytes, gap, elapsed)`` rows, status sent, skipped or failed; sums of parts add up.

    drift is the time that passed less the time that was scheduled.
    """
    n = lambda s: F.count_if(F.col("status") == s)
    sent = F.col("status") == "sent"
    g = results.groupBy("session_id").agg(n("sent").alias("sent"), n("skipped").alias("skipped"), n("failed").alias("failed"), F.sum(F.when(sent, F.greatest(F.lit(0), "bytes")).otherwise(0)).alias("bytes"), F.sum(F.when(sent, F.greatest(F.lit(0.0), "gap")).otherwise(0.0)).alias("scheduled"), F.sum("elapsed").alias("elapsed"))
    return g.withColumn("attempted", F.col("sent") + F.col("failed")).withColumn("drift", F.col("elapsed") - F.col("scheduled"))


def _hash(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, digest = None, hashlib.sha256()
    for batch in batches:
        for session, raw in batch.itertuples(index=False, name=None):
            if session != key:
                if key is not None:
                    yield pd.DataFrame({"session_id": [key], "sha256": [digest.hexdigest()]})
                key, digest = session, hashlib.sha256()
            digest.update(raw or b"")
    if key is not None:
        yield pd.DataFrame({"session_id": [key], "sha256": [digest.hexdigest()]})


def integrity_hash(frames: DataFrame) -> DataFrame:
    """SHA-256 over all raw frames of each session in order of packets.

    Such a hash can't be put together from parts, so a session is one task that streams its sorted frames.
    """
    return frames.select("session_id", "packet_id", "raw").repartition("session_id").sortWithinPartitions("session_id", "packet_id").select("session_id", "raw").mapInPandas(_hash, "session_id string, sha256 string")


def blob_chunks(df: DataFrame, key: list[str], raw: str = "raw", size: int = 65536) -> DataFrame:
    """``key, seq, data``: bytes in chunks; an empty value has one empty chunk."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.octet_length(raw) - 1), F.lit(size))
    return df.select(*key, F.col(raw).alias("_r"), F.posexplode(starts).alias("seq", "_at")).select(*key, "seq", F.substring("_r", F.col("_at") + 1, F.lit(size)).alias("data"))


def blob_whole(chunks: DataFrame, key: list[str]) -> DataFrame:
    """``key, raw``: chunks joined again in order; a value is one row, so its chunks are one group."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "data")))
    return chunks.groupBy(*key).agg(F.aggregate(parts, F.expr("X''"), lambda a, x: F.concat(a, x["data"])).alias("raw"))


def ancestors(graph: DataFrame) -> DataFrame:
    """``(session_id, event_id, ancestor_id, distance)`` of events with parent_id, by doubling: log2 of the depth joins.

    distance 1 is the parent.  By event, in order of falling distance, they are its ancestors, oldest
    first; by ancestor, its descendants.  In a cycle an event is no ancestor of its own, and each pair counts at its least distance.
    """
    pair = ["session_id", "event_id", "ancestor_id"]
    hop = graph.where("parent_id is not null and parent_id <> event_id").select("session_id", "event_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("distance"))
    known = hop = materialize(hop, "ancestors")
    while True:
        then = lambda df: df.select("session_id", F.col("event_id").alias("ancestor_id"), F.col("ancestor_id").alias("next"), F.col("distance").alias("more"))
        further = lambda df: hop.join(then(df), ["session_id", "ancestor_id"]).select("session_id", "event_id", F.col("next").alias("ancestor_id"), (F.col("distance") + F.col("more")).alias("distance"))  # noqa: E731, B023
        new = further(known).where("ancestor_id <> event_id").join(known.select(*pair), pair, "left_anti").groupBy(*pair).agg(F.min("distance").alias("distance"))
        new = materialize(new, "ancestors")
        if new.isEmpty():
            return known
        hop, known = materialize(further(hop), "hops"), known.unionByName(new)


def unknown_parents(graph: DataFrame) -> DataFrame:
    """Events whose parent is no event of their session."""
    ids = graph.select("session_id", F.col("event_id").alias("parent_id"))
    return graph.where("parent_id is not null").join(ids, ["session_id", "parent_id"], "left_anti")
