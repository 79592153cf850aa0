"""Packet-shaped projection of the ``events`` table: integer-only, the same in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.functions.frames import big_endian, bound, build, octets

#: Server and port of each event type.
SERVERS = {"error": ("203.0.113.1", 53), "click": ("203.0.113.2", 443), "view": ("203.0.113.3", 80), "signup": ("203.0.113.4", 8080), "purchase": ("203.0.113.5", 25)}

#: Last first octet of clients' addresses.
LAST_NET = 126


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark.read.parquet(f"{sf_dir}/events.parquet"))


def packet_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return project(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def project(e: DataFrame) -> DataFrame:
    e = e.select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    pick = lambda i: F.coalesce(*[F.when(F.col("event_type") == n, F.lit(v[i])) for n, v in SERVERS.items()])
    e = e.select(
        (F.col("event_id") + 1).alias("packet_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("session_id"),
        F.concat(F.lit("10.0."), F.expr("user_id div 16").cast("string"), F.lit("."), (F.col("user_id") % 16 + 1).cast("string")).alias("client"),
        (F.lit(49152) + F.col("user_id") % 8).cast("int").alias("cport"),
        pick(0).alias("server"),
        pick(1).alias("sport"),
        F.when(F.col("event_type") == "error", "DNS").otherwise("TCP").alias("protocol"),
        (F.floor("value").cast("int") + 40).alias("length"),
        k.alias("k"),
    )
    out = F.col("k") % 2 == 0
    m = F.col("k") % 10
    flags = F.when(m == 0, 2).when(m == 1, 18).when(m.isin(4, 5), 24).when(m == 7, 17).when(m == 8, 4).otherwise(16)
    return e.select(
        "session_id",
        "packet_id",
        "ts_us",
        F.when(out, F.col("client")).otherwise(F.col("server")).alias("source"),
        F.when(out, F.col("server")).otherwise(F.col("client")).alias("destination"),
        "protocol",
        F.when(out, F.col("cport")).otherwise(F.col("sport")).alias("src_port"),
        F.when(out, F.col("sport")).otherwise(F.col("cport")).alias("dst_port"),
        "length",
        flags.alias("flags"),
        "k",
        _messages().alias("messages"),
    )


def _messages() -> Column:
    """What this table's packets say, by k, as a decoder and a reassembler would report it."""
    k, n = F.col("k").cast("string"), F.col("length").cast("string")
    host = F.concat(F.lit("h"), k, F.lit(".example.com"))
    dns = F.when(F.col("k") % 2 == 0, F.concat(F.lit("DNS QUERY "), host, F.lit(" (A)"))).otherwise(F.concat(F.lit("DNS RESPONSE "), host, F.lit(" rcode=0 answers=203.0.113."), (F.col("k") % 5 + 1).cast("string")))
    make = lambda when, kind, text: F.when(when, F.struct(F.lit(kind).alias("event_type"), text.alias("summary")))
    tcp = F.col("protocol") == "TCP"
    said = F.array(
        make(F.col("protocol") == "DNS", "DNS", dns),
        make(tcp & (F.col("k") == 11), "STREAM_GAP", F.concat(F.lit("missing "), n, F.lit(" byte(s) in gap"))),
        make(tcp & (F.col("k") == 7), "STREAM_RETRANSMISSION", F.concat(F.lit("retransmitted "), n, F.lit(" byte(s) at seq="), F.col("packet_id").cast("string"))),
        make(tcp & (F.col("k") == 13), "STREAM_OVERLAP", F.concat(F.lit("overlap of "), n, F.lit(" byte(s)"))),
    )
    return F.filter(said, lambda x: x.isNotNull())


def wire_address(name: Column) -> Column:
    """The IPv4 address that stands in frames for a client's name 10.0.b.c, whose b grows with the table: 10.0.b.c itself up
    to b = 255, else b's two low bytes are the second and third octet, the next three bits count sixteens of the last one,
    and the rest is added to the first.  No two clients share an address; other addresses stay."""

    def dealt(o: Column) -> Column:
        b, c = o[2], o[3]
        parts = F.shiftright(b, 19) + 10, F.shiftright(b, 8).bitwiseAND(255), b.bitwiseAND(255), c + F.shiftright(b, 16).bitwiseAND(7) * 16
        address = F.concat_ws(".", *[x.cast("string") for x in parts])
        return F.when(b < (LAST_NET - 9) << 19, address).otherwise(F.raise_error(F.concat(F.lit("no IPv4 address left for a client: 10.0."), b.cast("string"), F.lit("."), c.cast("string"))))

    return bound(name, lambda a: F.when(a.startswith("10.0."), bound(_numbers(a), dealt)).otherwise(a))


def client_name(address: Column) -> Column:
    """The client's name of an address of ``wire_address``; servers' addresses stay."""

    def joined(o: Column) -> Column:
        last = o[3] - 1
        b = F.shiftleft(o[0] - 10, 19) + F.shiftleft(F.shiftright(last, 4), 16) + o[1] * 256 + o[2]
        return F.concat(F.lit("10.0."), b.cast("string"), F.lit("."), (last.bitwiseAND(15) + 1).cast("string"))

    first = lambda a: F.substring_index(a, ".", 1).cast("int")
    return bound(address, lambda a: F.when(a.rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.when(first(a).between(10, LAST_NET), bound(_numbers(a), joined)).otherwise(a)).otherwise(a))


def _numbers(address: Column) -> Column:
    return F.transform(F.split(address, r"\."), lambda x: x.cast("long"))


def named(packets: DataFrame) -> DataFrame:
    """Packets parsed from these frames, under the names of their clients."""
    return packets.withColumns({c: client_name(F.col(c)) for c in ("source", "destination")})


def frames(packets: DataFrame) -> DataFrame:
    """The packets as Ethernet frames with messages of their service: DNS, HTTP, a ClientHello, or filler.  Clients have
    the addresses of ``wire_address``."""
    k = F.col("k").cast("string")
    asked = F.col("k") % 2 == 0
    port = F.when(asked, F.col("dst_port")).otherwise(F.col("src_port"))
    host = F.concat(F.lit("h"), k, F.lit(".example.com"))
    text = lambda c: F.encode(c, "UTF-8")
    label = F.concat(F.lit("h"), k)
    question = F.concat(big_endian(F.length(label), 1), text(label), octets("076578616d706c6503636f6d0000010001"))
    answer = F.concat(octets("c00c00010001000000780004"), octets("cb0071"), big_endian(F.col("k") % 5 + 1, 1))
    ident = big_endian(F.col("packet_id") % 65536, 2)
    dns = F.when(asked, F.concat(ident, octets("01000001000000000000"), question)).otherwise(F.concat(ident, octets("81800001000100000000"), question, answer))
    http = F.when(asked, text(F.concat(F.lit("GET /"), k, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")))).otherwise(text(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\n")))
    n = F.length(host)
    name = F.concat(octets("0000"), big_endian(n + 5, 2), big_endian(n + 3, 2), octets("00"), big_endian(n, 2), text(host))
    hello = F.concat(octets("0303"), text(F.lit("r" * 32)), octets("0000021301" + "0100"), big_endian(n + 9, 2), name)
    shake = F.concat(octets("01"), big_endian(F.octet_length(hello), 3), hello)
    tls = F.concat(octets("160301"), big_endian(F.octet_length(shake), 2), shake)
    filler = text(F.repeat(F.lit("x"), F.greatest(F.col("length") - 40, F.lit(0))))
    payload = F.when(F.col("protocol") == "DNS", dns).when(port.isin(80, 8080), http).when((port == 443) & asked, tls).otherwise(filler)
    seq = F.col("packet_id") % (1 << 32)
    raw = build(F.col("source"), F.col("destination"), F.col("protocol"), F.col("src_port"), F.col("dst_port"), F.col("body"), F.col("flags"), seq, F.lit(0), F.col("k") * 100)
    ends = {c: wire_address(F.col(c)) for c in ("source", "destination")}
    return packets.withColumns(ends | {"body": payload}).select("session_id", "packet_id", "ts_us", "k", raw.alias("raw"))
