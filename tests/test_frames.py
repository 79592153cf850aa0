"""Frames, decoders, TCP streams and capture files on small literal fixtures."""

import struct

import pytest
from pyspark.sql import functions as F

from wiretide.functions import frames as R
from wiretide.functions import protocols as L
from wiretide.operators.reassembly import Direction
from wiretide.sources.capture_file import packets_of


def one(spark, raw, *columns):
    return spark.createDataFrame([(raw,)], "raw binary").select(*columns).first()


@pytest.mark.parametrize(
    "feeds, out, kinds",
    [
        ([(1000, b"AAAA"), (1004, b"BBBB")], b"AAAABBBB", []),
        ([(1000, b"AAAA"), (1008, b"DDDD"), (1004, b"BBBB")], b"AAAABBBBDDDD", []),
        ([(1000, b"AAAA"), (1008, b"DDDD"), (1012, b"EEEE")], b"AAAADDDDEEEE", ["gap"]),
        ([(1000, b"AAAA"), (1000, b"AAAA")], b"AAAA", ["retransmission"]),
        ([(1000, b"AAAA"), (1002, b"AACC")], b"AAAACC", ["overlap"]),
        ([(0xFFFFFFFE, b"AAAA"), (2, b"BBBB")], b"AAAABBBB", []),
    ],
)
def test_direction(feeds, out, kinds):
    d, got, seen = Direction(), b"", []
    for i, (seq, data) in enumerate(feeds):
        row = d.row(("s",), i, seq, data)
        got += row[2] if row else b""
        seen += [row[3]] if row and row[3] else []
    assert (got, seen) == (out, kinds)


def test_end_of_direction():
    d = Direction()
    d.row(("s",), 1, 1000, b"AAAA")
    d.row(("s",), 2, 1008, b"DDDD")
    assert d.end(("s",)) == ("s", None, b"DDDD", "gap", 1004, "unfilled gap of 4 byte(s) at flush", 2)
    assert d.end(("s",)) is None


@pytest.mark.parametrize(
    "address, text",
    [("20010db8000000000000000000000001", "2001:db8::1"), ("00" * 16, "::"), ("00" * 15 + "01", "::1"), ("fe80" + "00" * 14, "fe80::"), ("00010000000000020000000000000003", "1:0:0:2::3"), ("00" * 10 + "ffff01020304", "::ffff:1.2.3.4"), ("0001000200030004000500060007" + "0008", "1:2:3:4:5:6:7:8")],
)
def test_ipv6_text(spark, address, text):
    assert one(spark, bytearray.fromhex(address), R.ipv6_text(F.col("raw"), 0))[0] == text


def test_odd_frames(spark):
    short, none = bytearray(b"abc"), None
    rows = R.parse(spark.createDataFrame([(1, short), (2, none), (3, bytearray(12) + b"\x88\xcc"), (4, bytearray(12) + b"\x08\x00\x45")], "i int, raw binary")).orderBy("i").select("protocol", "source").collect()
    assert [tuple(r) for r in rows[:3]] == [("UNKNOWN", None), ("UNKNOWN", None), ("L2(0x88cc)", "00:00:00:00:00:00")]
    assert one(spark, short, R.issues(F.col("raw")))[0] == ["frame shorter than Ethernet header"]


def test_changes(spark):
    raw = bytearray(b"\x00ab\xffab")
    r = one(spark, raw, R.truncate(F.col("raw"), 2), R.pad(F.col("raw"), 8), R.pad(F.col("raw"), 2), R.replace(F.col("raw"), b"ab", b"\xfe"))
    assert [bytes(x) for x in r] == [b"\x00a", b"\x00ab\xffab\0\0", bytes(raw), b"\x00\xfe\xff\xfe"]


def test_checksum(spark):
    header = bytearray.fromhex("4500003c1c4640004006" + "0000" + "ac100a63ac100a0c")
    assert one(spark, header, R.checksum(F.col("raw")))[0] == 0xB1E6
    assert one(spark, bytearray(), R.checksum(F.col("raw")))[0] == 0xFFFF


def test_heads(spark):
    frame = bytearray(L.HTTP2_PREFACE + bytes.fromhex("000012040000000000"))
    assert one(spark, frame, L.http2_summary(L.http2(F.col("raw"))))[0] == "HTTP/2 SETTINGS stream=0 len=18"
    assert one(spark, bytearray(L.HTTP2_PREFACE), L.http2(F.col("raw"))["frame_type"])[0] == "(preface)"
    assert one(spark, bytearray.fromhex("c0000000010000aa"), L.quic_summary(L.quic(F.col("raw"))))[0] == "QUIC v1 Initial"
    assert one(spark, bytearray.fromhex("40000000010000aa"), L.quic(F.col("raw")))[0] is None
    assert one(spark, bytearray(b"BREW / HTTP/1.1\r\n\r\n"), L.http(F.col("raw")))[0] is None
    assert one(spark, None, L.http(F.col("raw")))[0] is None


def test_dns_pointer_loop_ends():
    head = bytes.fromhex("000081800001000000000000")
    assert L.dns_message(head + b"\xc0\x0c\x00\x01\x00\x01")["qname"] == ""
    assert L.tls_record(b"\x16\x03") is None and L.tls_record(b"") is None


def test_capture_formats():
    record = struct.pack(">4I", 7, 5_000, 3, 9) + b"abc"
    nano = b"\xa1\xb2\x3c\x4d" + struct.pack(">HHiIII", 2, 4, 0, 0, 65535, 1) + record
    assert list(packets_of(nano)) == [(7_000_005, b"abc", 9)]
    assert list(packets_of(nano[:-1])) == []
    section = struct.pack(">IIIHHqI", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1, 28)
    port = struct.pack(">IIHHI", 1, 28, 1, 0, 0) + struct.pack(">HHBxxx", 9, 1, 3) + struct.pack(">I", 28)
    block = struct.pack(">7I", 6, 36, 0, 0, 1500, 3, 3) + b"abc\0" + struct.pack(">I", 36)
    assert list(packets_of(section + port + block)) == [(1_500_000, b"abc", 3)]
    with pytest.raises(ValueError):
        packets_of(b"text")


def test_stream_of_segments(spark):
    """Reassembly in Spark against a cursor for each direction on the driver."""
    from wiretide.operators import flows as W
    from wiretide.plans.frame_queries import QUERIES, segments
    from wiretide.sources.adapter import packets

    want = []
    rows = segments(W.tracked(packets(spark, "/root/testdata/sf0.001"))).orderBy("packet_id").collect()
    directions = {}
    for r in rows:
        key = (r.session_id, r.flow_id, r.resp)
        want.append(directions.setdefault(key, Direction()).row(key, r.packet_id, r.seq, bytes(r.data)))
    want += [d.end(k) for k, d in directions.items()]
    want = [(*r[:4], r[4].decode(), *r[5:8]) for r in want if r]
    got = QUERIES["reassembly"](spark, "/root/testdata/sf0.001").select("session_id", "flow_id", "resp", "packet_id", "text", "issue", "at_seq", "detail").collect()
    assert {x[5] for x in want} >= {"gap", "overlap", None}
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_reassembly_over_batches(spark, tmp_path):
    """Two micro-batches share the state of a direction: the hole of the first is filled by the second."""
    from wiretide.streaming.flows import ROCKSDB, reassemble_stream, run_to_end

    schema = "session_id string, flow_id long, resp boolean, packet_id long, seq long, data binary"
    for i, part in enumerate([[(1, 1000, b"AAAA"), (2, 1008, b"CCCC")], [(3, 1004, b"BBBB"), (4, 1000, b"AAAA")]]):
        spark.createDataFrame([("s", 1, False, p, s, bytearray(d)) for p, s, d in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = {r.packet_id: (bytes(r.data), r.issue) for r in run_to_end(reassemble_stream(stream), "append").collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == {1: (b"AAAA", None), 3: (b"BBBBCCCC", None), 4: (b"", "retransmission")}


def test_reassembly_ends_in_a_stream(spark, tmp_path):
    """A row that is marked as the last of its direction brings out what waits behind a hole."""
    from wiretide.streaming.flows import ROCKSDB, reassemble_stream, run_to_end

    schema = "session_id string, flow_id long, resp boolean, packet_id long, seq long, data binary, last boolean"
    for part in ([(1, 1000, b"AAAA", False), (2, 1008, b"CCCC", None)], [(3, None, None, True)]):
        spark.createDataFrame([("s", 1, False, p, s, d and bytearray(d), e) for p, s, d, e in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = {(r.packet_id, bytes(r.data), r.issue, r.cause_packet) for r in run_to_end(reassemble_stream(stream), "append").collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == {(1, b"AAAA", None, None), (None, b"CCCC", "gap", 2)}
