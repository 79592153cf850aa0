"""TLS records, HTTP/1 messages and HTTP/2 frames of reassembled directions.

Rows of ``reassemble`` arrive sorted by direction and order.  A scanner takes a direction's bytes as they
come and holds the head of one unfinished unit, or one TLS record: bodies are counted and let go.  What
can't be read any further is given up at once, and its later bytes are dropped unread, so
memory is bounded and each byte is looked at once or twice whatever the direction holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from wiretide.functions.protocols import HTTP2_FRAMES, HTTP2_PREFACE, HTTP_METHODS, TLS_VERSIONS, Parts
from wiretide.operators.reassembly import DIRECTION

#: Longest HTTP/2 frame that a scan follows by default, and longest head of an HTTP message.
MAX_UNIT, MAX_HEAD = 1 << 20, 1 << 24
#: Fixed names of handshakes and cipher suites in streams.
STREAM_HANDSHAKES = {1: "ClientHello", 2: "ServerHello", 4: "NewSessionTicket", 8: "EncryptedExtensions", 11: "Certificate", 12: "ServerKeyExchange", 14: "ServerHelloDone", 15: "CertificateVerify", 16: "ClientKeyExchange", 20: "Finished"}
CIPHERS = {
    0x1301: "AES_128_GCM_SHA256", 0x1302: "AES_256_GCM_SHA384", 0x1303: "CHACHA20_POLY1305_SHA256", 0x1304: "AES_128_CCM_SHA256", 0x1305: "AES_128_CCM_8_SHA256",
    0xC02B: "ECDHE_ECDSA_WITH_AES_128_GCM_SHA256", 0xC02C: "ECDHE_ECDSA_WITH_AES_256_GCM_SHA384", 0xC02F: "ECDHE_RSA_WITH_AES_128_GCM_SHA256", 0xC030: "ECDHE_RSA_WITH_AES_256_GCM_SHA384",
    0x009C: "RSA_WITH_AES_128_GCM_SHA256", 0x009D: "RSA_WITH_AES_256_GCM_SHA384", 0x003C: "RSA_WITH_AES_128_CBC_SHA", 0x003D: "RSA_WITH_AES_256_CBC_SHA", 0xC013: "ECDHE_RSA_WITH_AES_128_CBC_SHA", 0x002F: "RSA_WITH_AES_128_CBC_SHA256",
}
VERSIONS = {0x0304: "1.3", 0x0303: "1.2"}
UNITS = "session_id string, flow_id long, resp boolean, n long, protocol string, kind string, summary string, size long, sni string, ciphers array<string>, alpn array<string>, versions array<string>"
Unit = dict[str, object]


def _hello(body: bytes) -> Unit:
    """Host name, cipher suites, protocols and versions a ClientHello offers, as far as it can be read."""
    out: Unit = {"sni": None, "ciphers": [], "alpn": [], "versions": []}
    try:
        p = Parts(body)
        p.take(34)
        p.block(1)
        suites = p.block(2)
        while suites.at + 1 < len(suites.data):
            code = suites.number(2)
            out["ciphers"].append(CIPHERS.get(code, f"0x{code:04X}"))
        p.block(1)
        extensions = p.block(2)
        while extensions.more():
            kind, value = extensions.number(2), extensions.block(2)
            if kind == 0:
                names = value.block(2)
                while names.more() and out["sni"] is None:
                    host, name = names.number(1) == 0, names.block(2).data
                    out["sni"] = name.decode("utf-8", "replace") if host else None
            elif kind == 16:
                names = value.block(2)
                while names.more():
                    out["alpn"].append(names.block(1).data.decode("ascii", "replace"))
            elif kind == 43:
                offered = value.block(1) if value.data and value.data[0] == len(value.data) - 1 else value
                while offered.at + 1 < len(offered.data):
                    code = offered.number(2)
                    out["versions"].append(VERSIONS.get(code, f"0x{code:04X}"))
    except ValueError:
        pass
    return out


def _record(kind: int, version: int, body: bytes) -> Unit:
    name = TLS_VERSIONS.get(version, hex(version))
    unit: Unit = {"protocol": "tls", "kind": f"record({kind})", "size": len(body)}
    if kind == 22 and len(body) >= 4:
        unit["kind"] = STREAM_HANDSHAKES.get(body[0], f"type={body[0]}")
        if body[0] == 1:
            unit |= _hello(body[4:])
        elif body[0] == 2 and len(body) >= 39:  # established results read the suite at a fixed place, one byte before its own
            code = int.from_bytes(body[38:40], "big")
            unit["ciphers"] = [CIPHERS.get(code, f"0x{code:04X}")]
    sni, new = unit.get("sni"), "1.3" in (unit.get("versions") or [])
    unit["summary"] = f"TLS {name} {unit['kind']}" + (f" sni={sni}" if sni else "") + (" (1.3)" if new else "")
    return unit


class Scanner:
    """Takes the bytes of a direction piece by piece and gives units; ``live`` is false once nothing can follow."""

    def __init__(self) -> None:
        self.held, self.live = bytearray(), True

    def feed(self, data: bytes) -> Iterator[Unit]:
        self.held += data
        yield from self.units()
        if not self.live:
            self.held = bytearray()

    def units(self) -> Iterator[Unit]:
        raise NotImplementedError


class Tls(Scanner):
    """Whole records; what is no record ends the scan."""

    def units(self) -> Iterator[Unit]:
        at, held = 0, self.held
        while self.live and len(held) - at >= 5:
            size = int.from_bytes(held[at + 3 : at + 5], "big")
            self.live = 20 <= held[at] <= 24
            if not self.live or len(held) - at < 5 + size:
                break
            yield _record(held[at], int.from_bytes(held[at + 1 : at + 3], "big"), bytes(held[at + 5 : at + 5 + size]))
            at += 5 + size
        del held[:at]


class Http2(Scanner):
    """Whole frames, whose bodies are counted only; a frame over ``most`` bytes ends the scan."""

    def __init__(self, most: int | None = MAX_UNIT) -> None:
        super().__init__()
        self.most, self.pending, self.body = most, None, 0

    def units(self) -> Iterator[Unit]:
        at, held = 0, self.held
        while self.live:
            if self.pending is not None:
                step = min(self.body, len(held) - at)
                at, self.body = at + step, self.body - step
                if self.body:
                    break
                unit, self.pending = self.pending, None
                yield unit
            if len(held) - at < 9:
                break
            size, kind, flags = int.from_bytes(held[at : at + 3], "big"), held[at + 3], held[at + 4]
            stream = int.from_bytes(held[at + 5 : at + 9], "big") & 0x7FFFFFFF
            self.live = self.most is None or size <= self.most
            name = HTTP2_FRAMES[kind] if kind < len(HTTP2_FRAMES) else f"type={kind}"
            self.pending, self.body = {"protocol": "http2", "kind": name, "size": size, "summary": f"HTTP/2 {name} stream={stream} len={size} flags={flags:#x}"}, size
            at += 9
        del held[:at]


def _framing(head: bytes) -> int | str | None:
    """Body length of a head: a number, "chunked", or None without either; the first header of the two counts."""
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        name = name.strip().lower()
        if colon and name == b"transfer-encoding" and b"chunked" in value.lower():
            return "chunked"
        if colon and name == b"content-length":
            return int(value) if value.strip().isdigit() else None
    return None


def _start_line(head: bytes) -> tuple[str, str] | None:
    """(kind, summary) of a message's head, None where it is no HTTP."""
    lines = head.decode("latin-1").split("\r\n")
    words = lines[0].split(" ", 2)
    headers = {k.strip().lower(): v.strip() for k, c, v in (x.partition(":") for x in lines[1:]) if c}
    if words[0].startswith("HTTP/"):
        return ("response", f"HTTP {words[1]} {words[0]}") if len(words) > 1 and words[1].isdigit() else None
    if words[0] in HTTP_METHODS and len(words) > 1:
        version = words[2] if len(words) > 2 and words[2] else "HTTP/1.0"
        return ("request", f"HTTP {words[0]} {headers.get('host') or words[1]} {version}") if version.startswith("HTTP/") else None
    return None


_STARTS = tuple(m.encode() + b" " for m in HTTP_METHODS)


def _may_start(first: bytes) -> bool:
    """Whether bytes can be the beginning of a message's head."""
    return first[:5] == b"HTTP/"[: len(first)] or any(first[: len(m)] == m[: len(first)] for m in _STARTS)


class Http1(Scanner):
    """Whole messages: a body is counted by its length, a chunked one reaches to the last end of chunks in the piece that has one.

    A head that is no HTTP ends the scan, as does one that has no end within ``most`` bytes.
    """

    END = b"0\r\n\r\n"

    def __init__(self, most: int | None = MAX_HEAD) -> None:
        super().__init__()
        self.most, self.searched = most, 0
        self.found, self.size, self.body = None, 0, 0  # head in hand, bytes of the message let go, bytes of its body to come (-1: chunked)

    def units(self) -> Iterator[Unit]:
        while self.live:
            if self.found is None and not self._head():
                return
            n = len(self.held)
            if self.body >= 0:
                take = min(self.body, n)
                self.body -= take
                done = self.body == 0
            else:
                end = self.held.rfind(self.END)
                done = end >= 0
                take = end + len(self.END) if done else max(0, n - len(self.END) + 1)  # an end may be cut in two
            del self.held[:take]
            self.size += take
            if not done:
                return
            yield {"protocol": "http", "kind": self.found[0], "size": self.size, "summary": self.found[1]}
            self.found, self.searched = None, 0

    def _head(self) -> bool:
        held = self.held
        if not _may_start(bytes(held[:8])):
            self.live = False
            return False
        at = held.find(b"\r\n\r\n", max(0, self.searched - 3))
        self.searched = len(held)
        if at < 0:
            self.live = self.most is None or len(held) <= self.most
            return False
        self.found = _start_line(bytes(held[:at]))
        if self.found is None:
            self.live = False
            return False
        length = _framing(bytes(held[: at + 4]))
        self.size, self.body = at + 4, -1 if length == "chunked" else length or 0
        del held[: at + 4]
        return True


def scanner(first: bytes, most_frame: int | None = MAX_UNIT, most_head: int | None = MAX_HEAD) -> tuple[Scanner | None, int]:
    """The scanner for a direction that begins with these bytes and what it skips; None while they are too few to tell."""
    if first[:1] == b"\x16":
        return Tls(), 0
    n = min(len(first), len(HTTP2_PREFACE))
    if first[:n] == HTTP2_PREFACE[:n]:
        return (Http2(most_frame), n) if len(first) >= len(HTTP2_PREFACE) + 9 else (None, 0)
    return Http1(most_head), 0


def _scan(most_frame: int | None = MAX_UNIT, most_head: int | None = MAX_HEAD):
    names = [c.split()[0] for c in UNITS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first, scan, n = None, b"", None, 0
        for batch in batches:
            out = []
            for session, flow, resp, data in batch.itertuples(index=False, name=None):
                if (session, flow, resp) != key:
                    key, first, scan, n = (session, flow, resp), b"", None, 0
                if scan is None and data:
                    first, data = first + bytes(data), b""
                    scan, skip = scanner(first, most_frame, most_head)
                    if scan:
                        data, first = first[skip:], b""
                if scan is None or not scan.live:
                    continue
                for unit in scan.feed(data):
                    n += 1
                    out.append((*key, n, *(unit.get(c) for c in names[4:])))
            if out:
                yield pd.DataFrame(out, columns=names)

    return run


def stream_units(reassembled: DataFrame, most_frame: int | None = MAX_UNIT, most_head: int | None = MAX_HEAD) -> DataFrame:
    """Protocol units of each direction, numbered in order: TLS if it begins with a handshake record, HTTP/2 after its preface, else HTTP/1.

    A longer HTTP/2 frame or HTTP/1 head than allowed ends its direction's scan; None allows any.  Bodies of any length are counted whole.
    """
    r = reassembled.where("octet_length(data) > 0").selectExpr("session_id", "flow_id", "resp", "coalesce(packet_id, 9223372036854775807) at", "data")
    r = r.repartition(*DIRECTION).sortWithinPartitions(*DIRECTION, "at").select(*DIRECTION, "data")
    return r.mapInPandas(_scan(most_frame, most_head), UNITS)
