"""Facts of streams, VARIANT findings, conversations."""

import json

import pytest
from pyspark.sql import functions as F
from test_ingest import ACK, FIN, PSH, SYN, hello, tcp, udp

from wiretide.operators import facts as A
from wiretide.operators import flows as W
from wiretide.operators import ingest as I  # noqa: E741
from wiretide.operators import sessions as V
from wiretide.operators.reassembly import reassemble

QUIC = bytes.fromhex("c0000000010000aa")
HTTP2 = b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n" + bytes([0, 0, 0, 4, 0, 0, 0, 0, 0])
DNS = b"\x00\x07\x01\x00\x00\x01" + bytes(6) + b"\x01h\x02ex\x00\x00\x01\x00\x01"


@pytest.fixture(scope="module")
def decoded(spark):
    frames = [
        tcp(True, SYN, 100), tcp(False, SYN | ACK, 500, ack=101), tcp(True, PSH | ACK, 101, b"GET /a HTTP/1.1\r\nHost: h\r\n\r\n", window=7), tcp(False, ACK, 501, ack=130), tcp(False, ACK, 501, ack=130), tcp(False, ACK, 501, b"0123456789", ack=130),
        udp(DNS), udp(DNS), tcp(True, ACK, 1, hello(), port=443), tcp(True, ACK, 1, HTTP2, port=8080), udp(QUIC, sp=5000, dp=443), tcp(True, FIN | ACK, 130),
    ]
    rows = [("s", i + 1, 1_000_000 + 7 * i, f) for i, f in enumerate(frames)]
    return I.decoded(spark.createDataFrame(rows, "session_id string, packet_id long, ts_us long, raw binary"))


def test_infos(spark, decoded, tmp_path):
    A.infos(decoded).write.parquet(str(tmp_path / "infos"))
    i = spark.read.parquet(str(tmp_path / "infos"))
    got = {r.packet_id: json.loads(r.j) for r in i.select("packet_id", F.to_json("info").alias("j")).collect()}
    assert got[1] == {} and got[7] == {"dns": {"is_query": True, "qname": "h.ex", "qtype": "A", "rcode": 0, "answers": []}}
    assert got[9]["tls"]["sni"] == "example.com" and got[3]["http"]["path"] == "/a" and got[10]["http2"]["frame_type"] == "SETTINGS" and got[11]["quic"]["version"] == "QUIC v1"
    assert [r.packet_id for r in i.where(A.info_of(F.col("info"), "tls.sni") == "example.com").collect()] == [9]
    assert [r.packet_id for r in i.where(A.info_of(F.col("info"), "http.status", "int") == 0).collect()] == [3]
    # text and back
    back = i.select("packet_id", F.parse_json(F.to_json("info")).alias("info"))
    assert {r.packet_id: r.q for r in back.select("packet_id", A.info_of(F.col("info"), "dns.qname").alias("q")).where("q is not null").collect()} == {7: "h.ex", 8: "h.ex"}


def test_facts_in_order(decoded):
    f = V.facts(decoded)
    assert [(r.packet_id, r.name) for r in A.in_order(f, protocol="dns").collect()] == [(7, "qname"), (7, "qtype"), (7, "rcode"), (8, "qname"), (8, "qtype"), (8, "rcode")]
    assert [r.name for r in A.in_order(f, packet_id=3, limit=2).collect()] == ["method", "path"]
    assert A.in_order(f, stream_id=1).count() == 0 and A.in_order(f, limit=None).count() == f.count()
    with pytest.raises(ValueError, match="positive"):
        A.in_order(f, limit=0)


def test_stream_facts(decoded):
    t = W.tracked(I.packets_of(decoded))
    got = {}
    for r in A.in_order(A.stream_facts(t), limit=None).collect():
        got.setdefault((r.stream_id, r.protocol), {})[r.name] = r.value
    # as established, an acknowledgement covers what ends at or after it: packet 12 that of packet 6, not packet 4 that of packet 3
    assert got[1, "tcp"] == {"dup_acks": "2", "retransmissions": "0", "zero_window": "0", "handshake_rtt": "7e-06", "rtt_count": "1", "rtt_min": "4.2e-05", "rtt_avg": "4.2e-05", "rtt_max": "4.2e-05", "window_min": "7", "window_max": "1000"}
    size = 14 + 20 + 8 + len(DNS)
    assert got[2, "udp"] == {"datagrams": "2", "avg_size": f"{size}.0", "datagrams_per_second": str(round(2 / 7e-6, 3))}
    c = A.conversations(W.flows_of(t), t, reassemble(I.segments_of(t))).where("flow_id = 1").first()
    assert (c.client, c.client_port, c.server, c.server_port, c.client_bytes, c.server_bytes, c.client_segments, c.server_segments) == ("10.0.0.1", 40000, "10.0.0.2", 80, 28, 10, 1, 1)


@pytest.mark.parametrize("us", [0, 1, 9, 10, 12, 99, 100, 123, 1_000_000, 1_500_000, 12_345_678, 60_000_000])
def test_seconds_are_shortest(spark, us):
    assert spark.range(1).select(A.seconds_text(F.lit(us))).first()[0] == str(us / 1e6)
