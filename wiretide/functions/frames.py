"""Ethernet frames as binary columns: build, parse, validate, change.

Everything is built-in functions on the JVM, so parsing stays in one code-generated stage with the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Transport names by IP protocol number.
TRANSPORT = {6: "TCP", 17: "UDP", 1: "ICMP", 58: "ICMPv6"}
IPV4, IPV6, ARP, VLAN = 0x0800, 0x86DD, 0x0806, 0x8100


def octets(hexadecimal: str) -> Column:
    return F.expr(f"X'{hexadecimal}'")


def number(raw: Column, at: Column | int, width: int) -> Column:
    """Big-endian unsigned number; null where the bytes are not all there."""
    part = F.substring(raw, at + 1, F.lit(width))
    return F.when(F.octet_length(part) == width, F.conv(F.hex(part), 16, 10).cast("long"))


def big_endian(value: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * width, "0"))


def _and(c: Column, mask: int) -> Column:
    return c.bitwiseAND(F.lit(mask).cast("long"))


def ipv4_text(raw: Column, at: Column | int) -> Column:
    return F.concat_ws(".", *[number(raw, at + i, 1).cast("string") for i in range(4)])


def ipv4_bytes(text: Column) -> Column:
    return F.concat(*[big_endian(F.split(text, r"\.")[i].cast("long"), 1) for i in range(4)])


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ipv6_text(raw: Column, at: Column | int) -> Column:
    """Canonical text: the first longest run of two or more zero groups is folded."""
    full = F.concat(*[F.concat(F.lit(":"), F.lower(F.conv(F.hex(F.substring(raw, at + 2 * i + 1, F.lit(2))), 16, 16))) for i in range(8)])

    def fold(text: Column) -> Column:
        out = text
        for n in range(2, 9):  # the last, longest run is asked for first
            run = f"(?::0){{{n}}}(?=:|$)"
            out = F.when(text.rlike(run), F.regexp_replace(text, f"^(.*?){run}(.*)$", "$1@$2")).otherwise(out)
        return F.regexp_replace(F.regexp_replace(out, "^:", ""), "@:?", "::")

    mapped = F.hex(F.substring(raw, at + 1, F.lit(12))) == "00000000000000000000FFFF"
    return F.when(mapped, F.concat(F.lit("::ffff:"), ipv4_text(raw, at + 12))).otherwise(bound(full, fold))


def mac_text(raw: Column, at: int) -> Column:
    return F.lower(F.concat_ws(":", *[F.hex(F.substring(raw, at + i + 1, 1)) for i in range(6)]))


def checksum(data: Column) -> Column:
    """Internet checksum: complement of the ones-complement sum of 16-bit words; an odd end is padded."""
    zero = F.lit(0).cast("long")

    def folded(total: Column) -> Column:
        for _ in range(3):
            total = _and(total, 0xFFFF) + F.shiftright(total, 16)
        return F.lit(0xFFFF).cast("long") - total

    def summed(d: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.octet_length(d), F.lit(1)), F.lit(2))
        words = F.transform(starts, lambda i: F.conv(F.rpad(F.hex(F.substring(d, i, F.lit(2))), 4, "0"), 16, 10).cast("long"))
        return F.aggregate(words, zero, lambda x, y: x + y, folded)

    return bound(data, summed)


def _never_zero(total: Column, udp: Column) -> Column:
    """A UDP checksum of zero means none, so it is sent as all ones."""
    return bound(total, lambda t: F.when(udp & (t == 0), 0xFFFF).otherwise(t))


def build(source: Column, destination: Column, transport: Column, src_port: Column, dst_port: Column, payload: Column, flags: Column, seq: Column, ack: Column, window: Column) -> Column:
    """An Ethernet, IPv4 and TCP or UDP frame with right checksums."""
    tcp = transport == "TCP"
    proto = F.when(tcp, octets("06")).otherwise(octets("11"))
    size = F.octet_length(payload)
    ports = F.concat(big_endian(src_port, 2), big_endian(dst_port, 2))
    before = F.when(tcp, F.concat(ports, big_endian(seq, 4), big_endian(ack, 4), octets("50"), big_endian(flags, 1), big_endian(window, 2))).otherwise(F.concat(ports, big_endian(size + 8, 2)))
    after = F.when(tcp, F.concat(octets("0000"), payload)).otherwise(payload)
    a, b = ipv4_bytes(source), ipv4_bytes(destination)
    length = F.when(tcp, size + 20).otherwise(size + 8)
    segment_sum = checksum(F.concat(a, b, octets("00"), proto, big_endian(length, 2), before, octets("0000"), after))
    head = F.concat(octets("4500"), big_endian(length + 20, 2), octets("0000400040"), proto)
    ip = F.concat(head, big_endian(checksum(F.concat(head, octets("0000"), a, b)), 2), a, b)
    return F.concat(octets("0200000000020200000000010800"), ip, before, big_endian(_never_zero(segment_sum, ~tcp), 2), after)


def parse(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds addresses, ports, protocol, TCP fields and the transport payload of each frame.

    Null or under 14 bytes: protocol UNKNOWN and nulls.  One VLAN tag is skipped.  UDP with port 53 on either side is
    named DNS, whatever it carries.  Later fragments have no ports.  Ethernet padding is no payload.  The frame should
    be a stored column: a filter on what is parsed repeats the expressions that make it.
    """
    r = F.col(raw)
    df = df.withColumn("_at", F.when(number(r, 12, 2) == VLAN, 18).otherwise(14))
    df = df.withColumn("eth_type", number(r, F.col("_at") - 2, 2))
    at = F.col("_at")
    four = (F.col("eth_type") == IPV4) & (F.shiftright(number(r, at, 1), 4) == 4)
    six = F.col("eth_type") == IPV6
    df = df.withColumn("_ip", F.when(four, 4).when(six, 6).otherwise(0))
    v4, v6 = F.col("_ip") == 4, F.col("_ip") == 6
    df = df.withColumns({
        "_proto": F.when(v4, number(r, at + 9, 1)).when(v6, number(r, at + 6, 1)),
        "_l4": F.when(v4, at + _and(number(r, at, 1), 15) * 4).when(v6, at + 40),
        "_whole": F.when(v4, _and(number(r, at + 6, 2), 0x1FFF) == 0).otherwise(v6),
        "_total": F.when(v4, number(r, at + 2, 2)).when(v6, number(r, at + 4, 2) + 40),
    })
    l4 = F.col("_l4").cast("int")
    end = F.least(F.octet_length(r), F.when(F.col("_total") > 0, at + F.col("_total")).otherwise(F.octet_length(r))).cast("int")
    tcp, udp = (F.col("_proto") == 6) & F.col("_whole"), (F.col("_proto") == 17) & F.col("_whole")
    arp = F.col("eth_type") == ARP
    src_port, dst_port = F.when(tcp | udp, number(r, l4, 2)).cast("int"), F.when(tcp | udp, number(r, l4 + 2, 2)).cast("int")
    name = F.coalesce(*[F.when(F.col("_proto") == k, F.lit(v)) for k, v in TRANSPORT.items()], F.concat(F.lit("IP("), F.col("_proto").cast("string"), F.lit(")")))
    short = F.coalesce(F.octet_length(r), F.lit(0)) < 14
    link = F.when(F.col("eth_type") > 1500, F.concat(F.lit("L2(0x"), F.lpad(F.lower(F.hex("eth_type")), 4, "0"), F.lit(")"))).otherwise("L2")
    dns = udp & ((src_port == 53) | (dst_port == 53))
    protocol = F.when(short, "UNKNOWN").when(F.coalesce(dns, F.lit(False)), "DNS").when(v4 | v6, name).when(arp, "ARP").otherwise(link)
    head = F.when(tcp, F.shiftright(number(r, l4 + 12, 1), 4) * 4).when(udp, 8).cast("int")
    from_, to = l4 + head, end - (l4 + head)
    out = df.withColumns({
        "source": F.when(short, None).when(v4, ipv4_text(r, at + 12)).when(v6, ipv6_text(r, at + 8)).when(arp, ipv4_text(r, at + 14)).otherwise(mac_text(r, 6)),
        "destination": F.when(short, None).when(v4, ipv4_text(r, at + 16)).when(v6, ipv6_text(r, at + 24)).when(arp, ipv4_text(r, at + 24)).otherwise(mac_text(r, 0)),
        "ttl": F.when(v4, number(r, at + 8, 1)).cast("int"),
        "protocol": protocol,
        "src_port": src_port,
        "dst_port": dst_port,
        "tcp_flags": F.when(tcp, number(r, l4 + 13, 1)).cast("int"),
        "tcp_seq": F.when(tcp, number(r, l4 + 4, 4)),
        "tcp_ack": F.when(tcp, number(r, l4 + 8, 4)),
        "tcp_window": F.when(tcp, number(r, l4 + 14, 2)).cast("int"),
        "payload": F.when((tcp | udp) & (to > 0), F.substring(r, from_ + 1, to)),
    })
    return out.drop("_at", "_ip", "_proto", "_l4", "_whole", "_total")


def issues(raw: Column, verify_checksums: bool = False) -> Column:
    """Structural faults of a frame in fixed wording; an empty array is a valid frame."""
    n = F.octet_length(raw)
    ihl, total, proto = _and(number(raw, 14, 1), 15) * 4, number(raw, 16, 2), number(raw, 23, 1)
    version = F.shiftright(number(raw, 14, 1), 4)
    wrong = F.when(version != 4, F.concat(F.lit("unexpected IPv4 version "), version.cast("string")))
    header = F.substring(raw, F.lit(15), ihl.cast("int"))
    found = [
        wrong,
        F.when(total < ihl, "IPv4 total length smaller than header").when(total + 14 > n, "frame shorter than IPv4 total length"),
        F.when(proto.isin(6, 17) & (total < ihl + 4), "transport header truncated"),
    ]
    if verify_checksums:  # a header with its own checksum sums to zero; UDP is left out, as is protocol 0
        found.append(F.when(~proto.isin(0, 17) & (checksum(header) != 0), "IPv4 header checksum mismatch"))
    some = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    return (
        F.when(F.coalesce(n, F.lit(0)) < 14, F.array(F.lit("frame shorter than Ethernet header")))
        .when(number(raw, 12, 2) != IPV4, F.array().cast("array<string>"))
        .when(n < 34, F.array(F.lit("truncated IPv4 header")))
        .when(ihl < 20, some(wrong, F.concat(F.lit("invalid IPv4 IHL "), ihl.cast("string"))))
        .when(n < 14 + ihl, some(wrong, F.lit("truncated IPv4 options")))
        .otherwise(some(*found))
    )


def truncate(raw: Column, length: int) -> Column:
    if length <= 0:
        raise ValueError("length must be positive")
    return F.substring(raw, 1, length)


def pad(raw: Column, length: int) -> Column:
    if length < 0:
        raise ValueError("length must not be negative")
    return F.when(F.octet_length(raw) >= length, raw).otherwise(F.rpad(raw, length, octets("00")))


def replace(raw: Column, old: bytes, new: bytes) -> Column:
    """Replaces every occurrence; Latin-1 text maps bytes to characters one to one."""
    if not old:
        raise ValueError("old must not be empty")
    return F.encode(F.replace(F.decode(raw, "ISO-8859-1"), F.lit(old.decode("latin-1")), F.lit(new.decode("latin-1"))), "ISO-8859-1")


def _swap(value: Column, names: dict[str, str]) -> Column:
    out = value
    for k, v in names.items():
        out = F.when(value == octets(k), octets(v)).otherwise(out)
    return out


def remap(raw: Column, macs: dict[str, str] | None = None, ips: dict[str, str] | None = None, ports: dict[int, int] | None = None) -> Column:
    """Replaces MAC and IPv4 addresses and ports, and repairs checksums.

    Later fragments keep their transport checksum, and so does UDP without one.  Other frames pass unchanged but
    for their MACs.  The maps are parameters of a job, not data; they become part of the expression.
    """
    if any(not 0 <= p <= 65535 for p in (ports or {}).values()):
        raise ValueError("port out of range")
    mac_hex = {mac_octets(k): mac_octets(v) for k, v in (macs or {}).items()}
    ip_hex = {ipv4_octets(k): ipv4_octets(v) for k, v in (ips or {}).items()}
    port_hex = {f"{k:04x}": f"{v:04x}" for k, v in (ports or {}).items()}
    return _remapped(raw, lambda at, c: _swap(c, mac_hex), lambda at, c: _swap(c, ip_hex), lambda c: _swap(c, port_hex))


def remap_to(raw: Column, dst_mac: Column, src_mac: Column, src_ip: Column, dst_ip: Column) -> Column:
    """The frame with the given MACs (text with colons) and IPv4 addresses (text) in place of its own, where they are not null."""
    macs, ips = {0: dst_mac, 6: src_mac}, {26: src_ip, 30: dst_ip}
    mac = lambda at, c: F.coalesce(F.unhex(F.replace(macs[at], F.lit(":"))), c)
    return _remapped(raw, mac, lambda at, c: F.coalesce(F.when(ips[at].isNotNull(), ipv4_bytes(ips[at])), c), lambda c: c)


def mac_octets(text: str) -> str:
    """Hexadecimal digits of a MAC; six parts of two digits, else ValueError."""
    parts = text.split(":")
    if len(parts) != 6 or any(not re.fullmatch("[0-9A-Fa-f]{2}", x) for x in parts):
        raise ValueError(f"no MAC address: {text!r}")
    return "".join(parts).lower()


def ipv4_octets(text: str) -> str:
    """Hexadecimal digits of an IPv4 address; four numbers up to 255, else ValueError."""
    parts = text.split(".")
    if len(parts) != 4 or any(not re.fullmatch("[0-9]{1,3}", x) or int(x) > 255 for x in parts):
        raise ValueError(f"no IPv4 address: {text!r}")
    return "".join(f"{int(x):02x}" for x in parts)


def _remapped(raw: Column, mac: Callable[[int, Column], Column], ip: Callable[[int, Column], Column], port: Callable[[Column], Column]) -> Column:
    """The frame with each address and port as the functions give it, and repaired checksums."""
    cut = lambda at, size: F.substring(raw, at + 1, F.lit(size))
    n = F.octet_length(raw)
    link = F.concat(mac(0, cut(0, 6)), mac(6, cut(6, 6)), cut(12, 2))
    ihl = (_and(number(raw, 14, 1), 15) * 4).cast("int")
    base, proto, total = ihl + 14, number(raw, 23, 1), number(raw, 16, 2).cast("int")
    has_ports = proto.isin(6, 17) & (n >= base + 4)
    rest = F.substring(raw, base + 1, n)
    ports_now = F.substring(raw, base + 1, F.lit(4))
    ports_new = F.concat(port(cut(base, 2)), port(cut(base + 2, 2)))
    length = F.when((total - ihl >= 4) & (n >= base + total - ihl), total - ihl).otherwise(n - base)
    place = F.when(proto == 6, 16).otherwise(6)
    first = (_and(number(raw, 20, 2), 0x1FFF) == 0) & (n >= base + place + 2) & ~((proto == 17) & (number(raw, base + 6, 2) == 0))
    new = F.struct(
        F.concat(ip(26, cut(26, 4)), ip(30, cut(30, 4))).alias("ip"),
        F.when(has_ports, F.concat(ports_new, F.substring(rest, F.lit(5), n))).otherwise(rest).alias("segment"),
        (has_ports & (ports_now != ports_new)).alias("ports_changed"),
        F.struct(has_ports.alias("has_ports"), length.alias("length"), place.alias("place"), first.alias("first"), (proto == 17).alias("udp"), big_endian(proto, 1).alias("proto")).alias("t"),
        F.struct(cut(14, 10).alias("start"), cut(24, 2).alias("sum"), cut(26, 8).alias("ip"), F.substring(raw, F.lit(35), F.greatest(ihl - 20, F.lit(0))).alias("options")).alias("old"),
    )

    def repaired(v: Column) -> Column:
        t, seg, at = v["t"], v["segment"], v["t"]["place"]
        before = F.when(t["udp"], F.concat(F.substring(seg, F.lit(1), F.lit(4)), big_endian(t["length"], 2))).otherwise(F.substring(seg, F.lit(1), at))
        after = F.substring(seg, at + 3, F.octet_length(seg))
        covered = F.substring(F.concat(before, octets("0000"), after), F.lit(1), t["length"])
        total_sum = checksum(F.concat(v["ip"], octets("00"), t["proto"], big_endian(t["length"], 2), covered))
        return F.concat(before, big_endian(_never_zero(total_sum, t["udp"]), 2), after)

    def joined(v: Column) -> Column:
        old, moved = v["old"], v["ip"] != v["old"]["ip"]
        ip_sum = F.when(moved, big_endian(checksum(F.concat(old["start"], octets("0000"), v["ip"], old["options"])), 2)).otherwise(old["sum"])
        repair = v["t"]["has_ports"] & v["t"]["first"] & (moved | v["ports_changed"])
        return F.concat(old["start"], ip_sum, v["ip"], old["options"], F.when(repair, repaired(v)).otherwise(v["segment"]))

    full = (number(raw, 12, 2) == IPV4) & (n >= 34) & (ihl >= 20) & (n >= base)
    return F.when(F.coalesce(n, F.lit(0)) < 14, raw).when(full, F.concat(link, bound(new, joined))).otherwise(F.concat(link, F.substring(raw, F.lit(15), n)))
