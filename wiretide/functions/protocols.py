"""Application-layer decoders on payload columns; a payload that is something else gives null.

HTTP, HTTP/2 and QUIC heads are built-in functions.  DNS names and TLS extensions are chains of
length-prefixed parts, which Arrow functions walk.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from wiretide.functions.frames import number, octets

#: Names of DNS types, of TLS handshakes and versions, of HTTP/2 frames and of QUIC versions and packets.
DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 41: "OPT", 43: "SSHFP", 47: "ANY", 99: "SPF", 255: "ANY"}
HANDSHAKES = {1: "ClientHello", 2: "ServerHello", 11: "Certificate", 12: "ServerKeyExchange", 13: "CertificateRequest", 14: "ServerHelloDone", 15: "CertificateVerify", 16: "ClientKeyExchange", 20: "Finished"}
TLS_VERSIONS = {0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3", 0x0002: "SSL 2.0", 0x0003: "SSL 3.0"}
HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH", "TRACE", "CONNECT")
HTTP_PORTS = (80, 8000, 8080, 8888)
HTTP2_FRAMES = ("DATA", "HEADERS", "PRIORITY", "RST_STREAM", "SETTINGS", "PUSH_PROMISE", "PING", "GOAWAY", "WINDOW_UPDATE", "CONTINUATION")
HTTP2_PREFACE = b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n"
QUIC_VERSIONS = {0x00000001: "QUIC v1", 0x6B3343CF: "QUIC v2", 0xFF00001D: "draft-29"}
QUIC_PACKETS = ("Initial", "0-RTT", "Handshake", "Retry")


class Parts:
    """Reads numbers and length-prefixed blocks off bytes; ValueError where they end early."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, width: int) -> int:
        return int.from_bytes(self.take(width), "big")

    def block(self, width: int) -> Parts:
        return Parts(self.take(self.number(width)))

    def more(self) -> bool:
        return self.at < len(self.data)


def server_name(hello: bytes) -> str | None:
    """Host name in a ClientHello body."""
    try:
        p = Parts(hello)
        p.take(34)
        p.block(1), p.block(2), p.block(1)  # session id, ciphers, compressions
        extensions = p.block(2)
        while extensions.more():
            kind, body = extensions.number(2), extensions.block(2)
            if kind == 0:
                names = body.block(2)
                while names.more():
                    host, name = names.number(1) == 0, names.block(2).data
                    if host:
                        return name.decode("utf-8", "replace")
    except ValueError:
        pass
    return None


def tls_record(payload: bytes | None) -> dict | None:
    """Version, handshake and host name of the first record, if it is a handshake."""
    if not payload or payload[0] != 0x16:
        return None
    try:
        p = Parts(payload, 1)
        version = p.number(2)
        body = payload[5 : 5 + int.from_bytes(payload[3:5], "big")]
        if len(body) < 4:
            return None
        kind, hello = body[0], body[4 : 4 + int.from_bytes(body[1:4], "big")]
    except ValueError:
        return None
    return {"version": TLS_VERSIONS.get(version, hex(version)), "handshake": HANDSHAKES.get(kind, f"Handshake({kind})"), "sni": server_name(hello) if kind == 1 else None}


def _name(p: Parts) -> str:
    """A domain name; compression pointers may only lead backwards, so that they end."""
    labels, limit, back = [], p.at, None
    while True:
        n = p.number(1)
        if n == 0:
            break
        if n >= 0xC0:
            to = (n & 0x3F) << 8 | p.number(1)
            if to >= limit:
                raise ValueError("pointer leads forward")
            back = p.at if back is None else back
            p.at = limit = to
        else:
            labels.append(p.take(n).decode("utf-8", "replace"))
    if back is not None:
        p.at = back
    return ".".join(labels)


def dns_message(payload: bytes | None) -> dict | None:
    """First question and up to 8 answers; null for a query without a name.

    Addresses and names are given as text, other answers as hexadecimal.
    """
    if not payload or len(payload) < 12:
        return None
    flags, questions, records = (int.from_bytes(payload[i : i + 2], "big") for i in (2, 4, 6))
    p, qname, qtype, answers = Parts(payload, 12), "", 0, []
    try:
        for i in range(questions):
            name, kind = _name(p), p.number(2)
            p.take(2)
            if i == 0:
                qname, qtype = name, kind
        for _ in range(min(records, 8)):
            _name(p)
            kind = p.number(2)
            p.take(6)
            size = p.number(2)
            start = p.at
            data = p.take(size)
            if kind in (1, 28) and size in (4, 16):
                answers.append(str(ipaddress.ip_address(data)))
            elif kind in (2, 5, 12):
                answers.append(_name(Parts(payload, start)))
            else:
                answers.append(data.hex())
    except ValueError:
        pass
    query = flags & 0x8000 == 0
    if query and not qname:
        return None
    return {"is_query": query, "qname": qname, "qtype": DNS_TYPES.get(qtype, str(qtype)), "rcode": flags & 15, "answers": answers}


def _frame(rows: list[dict | None], fields: list[str]) -> pd.DataFrame:
    return pd.DataFrame({f: pd.Series([None if r is None else r[f] for r in rows], dtype=object) for f in fields})


def _tls(payload: pd.Series) -> pd.DataFrame:
    return _frame([tls_record(x) for x in payload], ["version", "handshake", "sni"])


def _dns(payload: pd.Series) -> pd.DataFrame:
    return _frame([dns_message(x) for x in payload], ["is_query", "qname", "qtype", "rcode", "answers"])


def tls(payload: Column) -> Column:
    return F.pandas_udf(_tls, "version string, handshake string, sni string")(payload)


def tls_summary(t: Column) -> Column:
    return F.concat(F.lit("TLS "), t["handshake"], F.lit(" "), t["version"], F.coalesce(F.concat(F.lit(" sni="), F.nullif(t["sni"], F.lit(""))), F.lit("")))


def dns(payload: Column) -> Column:
    return F.pandas_udf(_dns, "is_query boolean, qname string, qtype string, rcode int, answers array<string>")(payload)


def dns_summary(d: Column) -> Column:
    answers = F.when(F.size(d["answers"]) > 0, F.concat(F.lit(" answers="), F.array_join(F.slice(d["answers"], 1, 6), ","))).otherwise("")
    reply = F.concat(F.lit("DNS RESPONSE "), d["qname"], F.lit(" rcode="), d["rcode"].cast("string"), answers)
    return F.when(d["is_query"], F.concat(F.lit("DNS QUERY "), d["qname"], F.lit(" ("), d["qtype"], F.lit(")"))).otherwise(reply)


def http(payload: Column) -> Column:
    """Start line, host and content type of an HTTP/1 message at the payload's start."""
    head = F.substring_index(F.decode(payload, "ISO-8859-1"), "\r\n\r\n", 1)
    start = F.substring_index(head, "\r\n", 1)
    request, reply = rf"(?s)^({'|'.join(HTTP_METHODS)}) ([^ ]*)(?: (.*))?$", r"(?s)^(HTTP/[^ ]*) ([0-9]+)(?: .*)?$"
    header = lambda name: F.trim(F.regexp_extract(head, rf"(?is)^.*\r\n[ \t]*{name}[ \t]*:([^\r\n]*)", 1))
    version = F.coalesce(F.nullif(F.regexp_extract(start, request, 3), F.lit("")), F.lit("HTTP/1.0"))
    asked = F.struct(F.lit("request").alias("kind"), F.regexp_extract(start, request, 1).alias("method"), F.regexp_extract(start, request, 2).alias("path"), F.lit(0).alias("status"), version.alias("version"), header("host").alias("host"), header("content-type").alias("content_type"))
    answered = F.struct(F.lit("response").alias("kind"), F.lit("").alias("method"), F.lit("").alias("path"), F.try_to_number(F.regexp_extract(start, reply, 2), F.lit("999999999")).cast("int").alias("status"), F.regexp_extract(start, reply, 1).alias("version"), F.lit("").alias("host"), header("content-type").alias("content_type"))
    return F.when(start.rlike(reply), answered).when(start.rlike(request) & version.startswith("HTTP/"), asked)


def http_summary(h: Column) -> Column:
    target = F.coalesce(F.nullif(h["host"], F.lit("")), h["path"])
    return F.trim(F.when(h["kind"] == "request", F.concat_ws(" ", F.lit("HTTP"), h["method"], target, h["version"])).otherwise(F.concat_ws(" ", F.lit("HTTP"), h["status"].cast("string"), h["version"])))


def _named(c: Column, names: dict[int, str], other: Column) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in names.items()], other)


def http2(payload: Column) -> Column:
    """First frame after the HTTP/2 preface; "(preface)" if its head is not there."""
    n = len(HTTP2_PREFACE)
    kind = number(payload, n + 3, 1)
    frame = F.struct(
        _named(kind, dict(enumerate(HTTP2_FRAMES)), F.concat(F.lit("TYPE("), kind.cast("string"), F.lit(")"))).alias("frame_type"),
        number(payload, n, 3).alias("length"), number(payload, n + 4, 1).alias("flags"), number(payload, n + 5, 4).bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).alias("stream_id"),
    )
    zero = F.lit(0).cast("long")
    alone = F.struct(F.lit("(preface)").alias("frame_type"), zero.alias("length"), zero.alias("flags"), zero.alias("stream_id"))
    return F.when(F.substring(payload, 1, n) == octets(HTTP2_PREFACE.hex()), F.when(F.octet_length(payload) < n + 9, alone).otherwise(frame))


def http2_summary(h: Column) -> Column:
    return F.concat(F.lit("HTTP/2 "), h["frame_type"], F.lit(" stream="), h["stream_id"].cast("string"), F.lit(" len="), h["length"].cast("string"))


def quic(payload: Column) -> Column:
    """Version and kind of a QUIC packet with a long header."""
    first, version, ids = number(payload, 0, 1), number(payload, 1, 4), number(payload, 5, 1)
    name = _named(version, QUIC_VERSIONS, F.concat(F.lit("QUIC 0x"), F.lpad(F.lower(F.hex(version)), 8, "0")))
    kind = F.shiftright(first.bitwiseAND(F.lit(0x30).cast("long")), 4)
    good = (F.octet_length(payload) >= 7) & (first >= 0x80) & (version != 0) & (ids + 6 < F.octet_length(payload))
    return F.when(good, F.struct(name.alias("version"), _named(kind, dict(enumerate(QUIC_PACKETS)), F.lit("Unknown")).alias("packet_type"), ids.alias("dcid_len"), number(payload, (ids + 6).cast("int"), 1).alias("scid_len")))


def quic_summary(q: Column) -> Column:
    return F.concat_ws(" ", q["version"], q["packet_type"])
