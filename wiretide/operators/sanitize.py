"""Rewrites a session without its addresses and names: pseudonyms in first-seen order, frames with repaired checksums.

Two passes, both distributed: observations are reduced to the first of each value and numbered in
ranges; then packets, flows, events and frames are joined with the numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretide.functions.frames import IPV4, ipv4_text, number, remap_to
from wiretide.operators.ordered import dealt, numbered
from wiretide.operators.scratch import materialize

#: Fixed patterns of host names and IPv4 addresses in text.
HOST = r"\b([A-Za-z0-9][A-Za-z0-9._-]*\.[A-Za-z]{2,})\b"
ADDRESS = r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"


def ip_token(i: Column) -> Column:
    """10.255.x.y; past 65,536 addresses the second part counts down, past 2**24 they are 240.0.0.0 and on.

    All 2**24 + 2**28 tokens differ; one more is an error.
    """
    j = i - (1 << 24)
    octet = lambda n, at: F.floor(n / (1 << at)) % 256
    first = F.array(F.lit(10).cast("long"), 255 - octet(i, 16), octet(i, 8), octet(i, 0))
    more = F.array(240 + octet(j, 24), octet(j, 16), octet(j, 8), octet(j, 0))
    out = F.array_join(F.transform(F.when(j < 0, first).otherwise(more), lambda x: x.cast("string")), ".")
    return F.when(j < 1 << 28, out).otherwise(F.raise_error(F.lit("more addresses in a session than there are tokens")))


def mac_token(i: Column) -> Column:
    """02:00:00:00:x:y and on; all 2**40 tokens differ, one more is an error."""
    digits = F.lpad(F.lower(F.hex(i.cast("long"))), 10, "0")
    out = F.concat(F.lit("02"), F.regexp_replace(digits, "(..)", ":$1"))
    return F.when(i < 1 << 40, out).otherwise(F.raise_error(F.lit("more MACs in a session than there are tokens")))


def _mac(at: int) -> Column:
    return F.lower(F.hex(F.substring("raw", at + 1, 6)))


def _numbers(seen: DataFrame, token) -> DataFrame:
    """``(session_id, value, token)`` of ``seen(session_id, value, at)``, in order of the first time."""
    first = seen.where("value <> ''").groupBy("session_id", "value").agg(F.min("at").alias("at"))
    placed = numbered(dealt(first, ["at", "value"]), ["at", "value"], "i")
    return materialize(placed.select("session_id", "value", token(F.col("i") - 1).alias("token")), "tokens")


def observed(packets: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tokens of IPs, MACs and names of packets with raw frames and of events with summaries."""
    place = lambda pos: F.struct("ts_us", "packet_id", pos.alias("pos"))
    four = (number(F.col("raw"), 12, 2) == IPV4) & (F.octet_length("raw") >= 34)
    ips = F.array(F.when(four, ipv4_text(F.col("raw"), 26)), F.when(four, ipv4_text(F.col("raw"), 30)), F.col("source"), F.col("destination"))
    macs = F.when(F.octet_length("raw") >= 14, F.array(_mac(0), _mac(6)))
    seen = packets.select("session_id", "ts_us", "packet_id", F.posexplode(ips).alias("pos", "value")).select("session_id", "value", place(F.col("pos")).alias("at"))
    # addresses that only texts name come after those of packets, in order of events
    late = events.select("session_id", F.lit((1 << 63) - 1).alias("ts_us"), F.col("event_id").alias("packet_id"), F.posexplode(F.regexp_extract_all("summary", F.lit(ADDRESS), F.lit(1))).alias("pos", "value"))
    seen = seen.unionByName(late.select("session_id", "value", place(F.col("pos")).alias("at")))
    links = packets.select("session_id", "ts_us", "packet_id", F.posexplode(macs).alias("pos", "value")).select("session_id", "value", place(F.col("pos")).alias("at"))
    named = events.select("session_id", "event_id", F.posexplode(F.regexp_extract_all("summary", F.lit(HOST), F.lit(1))).alias("pos", "value"))
    hosts = named.select("session_id", "value", F.struct("event_id", "pos").alias("at"))
    return _numbers(seen, ip_token), _numbers(links, mac_token), _numbers(hosts, lambda i: F.concat(F.lit("host-"), i.cast("string"), F.lit(".example")))


def _looked_up(df: DataFrame, tokens: DataFrame, value: Column, name: str) -> DataFrame:
    t = tokens.select("session_id", F.col("value").alias("_v"), F.col("token").alias(name))
    return df.withColumn("_v", value).join(t, ["session_id", "_v"], "left").drop("_v")


def sanitize_text(events: DataFrame, hosts: DataFrame, ips: DataFrame) -> DataFrame:
    """Events with host names, then addresses, in summaries replaced where they stand."""
    out = events
    for pattern, tokens in ((HOST, hosts), (ADDRESS, ips)):
        found = out.select("session_id", "event_id", F.posexplode(F.regexp_extract_all("summary", F.lit(pattern), F.lit(1))).alias("pos", "_v"))
        t = tokens.select("session_id", F.col("value").alias("_v"), "token")
        new = found.join(t, ["session_id", "_v"]).groupBy("session_id", "event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("_t"))
        parts = F.split("summary", pattern, -1)
        text = F.concat_ws("", F.flatten(F.zip_with(parts, F.col("_t"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))
        out = out.join(new, ["session_id", "event_id"], "left").withColumn("summary", F.when(F.col("_t").isNotNull(), text).otherwise(F.col("summary"))).drop("_t")
    return out


def sanitize(packets: DataFrame, flows: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(packets, flows, events, report) of sessions, redacted.

    packets have raw frames: MACs and IPv4 addresses in them are replaced and checksums repaired.  An
    endpoint that is no IPv4 address (IPv6, MAC) has a token of the same kind, and its bytes in the
    frame stay.  The report counts rows and different addresses, MACs and names of each session.
    """
    ips, macs, hosts = observed(packets, events)
    p = packets
    for name, value in (("s", F.col("source")), ("d", F.col("destination")), ("fs", ipv4_text(F.col("raw"), 26)), ("fd", ipv4_text(F.col("raw"), 30))):
        p = _looked_up(p, ips, value, name)
    for name, at in (("ms", 6), ("md", 0)):
        p = _looked_up(p, macs, _mac(at), name)
    # stored first: the rewrite names each looked-up token several times
    p = materialize(p, "tokens-of-packets")
    raw = remap_to(F.col("raw"), F.col("md"), F.col("ms"), F.col("fs"), F.col("fd"))
    p = p.withColumn("source", F.coalesce("s", "source")).withColumn("destination", F.coalesce("d", "destination")).withColumn("raw", raw).select(*packets.columns)
    f = _looked_up(_looked_up(flows, ips, F.col("source"), "s"), ips, F.col("destination"), "d")
    f = f.withColumn("source", F.coalesce("s", "source")).withColumn("destination", F.coalesce("d", "destination")).select(*flows.columns)
    e = sanitize_text(events, hosts, ips).select(*events.columns)
    count = lambda df, name: df.groupBy("session_id").agg(F.count("*").alias(name))
    report = count(packets, "packets")
    for df, name in ((flows, "flows"), (events, "events"), (ips, "ips"), (macs, "macs"), (hosts, "domains")):
        report = report.join(count(df, name), "session_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return p, f, e, report
