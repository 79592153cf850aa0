"""From literal frames to events, measurements, stream units, exports, redaction and checks."""

import hashlib
import json
import socket
import struct

import pytest
from pyspark.sql import functions as F

from wiretide.functions import frames as R
from wiretide.operators import analysis as A
from wiretide.operators import flows as W
from wiretide.operators import ingest as I  # noqa: E741
from wiretide.operators import ordered as O  # noqa: N812
from wiretide.operators import sanitize as Z
from wiretide.operators import sessions as V
from wiretide.operators import streams as S
from wiretide.operators import tcp_metrics as T
from wiretide.sources import exports as X

A1, B1 = "10.0.0.1", "10.0.0.2"
SYN, FIN, PSH, ACK = 2, 1, 8, 16


def ip(src, dst, proto, body, macs=b"\x02\x00\x00\x00\x00\x0b\x02\x00\x00\x00\x00\x0a"):
    head = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 1, 0, 64, proto, 0, socket.inet_aton(src), socket.inet_aton(dst))
    total = sum(struct.unpack("!10H", head))
    total = (total & 0xFFFF) + (total >> 16)
    head = head[:10] + struct.pack("!H", 0xFFFF - (total & 0xFFFF) - (total >> 16)) + head[12:]
    return macs + b"\x08\x00" + head + body


def tcp(out, flags, seq, payload=b"", ack=0, window=1000, port=80):
    src, dst, sp, dp = (A1, B1, 40000, port) if out else (B1, A1, port, 40000)
    return ip(src, dst, 6, struct.pack("!HHIIBBHHH", sp, dp, seq, ack, 0x50, flags, window, 0, 0) + payload)


def udp(payload, sp=5353, dp=53, src=A1, dst=B1):
    return ip(src, dst, 17, struct.pack("!HHHH", sp, dp, 8 + len(payload), 0) + payload)


def hello(name=b"example.com"):
    sni = struct.pack("!HHHBH", 0, len(name) + 5, len(name) + 3, 0, len(name)) + name
    more = struct.pack("!HHHB", 16, 5, 3, 2) + b"h2" + struct.pack("!HHBH", 43, 3, 2, 0x0304)
    body = b"\x03\x03" + bytes(32) + b"\x00" + b"\x00\x02\x13\x01" + b"\x01\x00" + struct.pack("!H", len(sni + more)) + sni + more
    shake = b"\x01" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack("!H", len(shake)) + shake


GET, OK = b"GET / HTTP/1.1\r\nHost: example.com\r\n\r\n", b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"
OPEN = [tcp(True, SYN, 100), tcp(False, SYN | ACK, 500, ack=101), tcp(True, ACK, 101, ack=501)]
QUESTION = b"\x16\x03\x01\x00\x00\x01\x00\x00\x00\x00\x00\x00" + b"\x04test\x03org\x00\x00\x01\x00\x01"
FLOW = "10.0.0.1:40000 -> 10.0.0.2:80"
CASES = {
    "basic": (
        [*OPEN, tcp(True, PSH | ACK, 101, GET), tcp(False, PSH | ACK, 501, OK), tcp(True, FIN | ACK, 101 + len(GET)), tcp(False, FIN | ACK, 501 + len(OK))],
        [(1, "TCP", f"TCP flow {FLOW}"), (1, "TCP", f"TCP {FLOW} [SYN]"), (2, "TCP", f"TCP {FLOW} [SYN/ACK]"), (3, "TCP", f"TCP {FLOW} [ESTABLISHED]"), (4, "HTTP", "HTTP GET example.com HTTP/1.1"), (5, "HTTP", "HTTP 200 HTTP/1.1"), (6, "TCP", f"TCP {FLOW} [FIN]"), (7, "TCP", f"TCP {FLOW} [CLOSED]")],
    ),
    "again": (
        [*OPEN, tcp(True, ACK, 101, b"AAAA"), tcp(True, ACK, 101, b"AAAA"), tcp(True, ACK, 103, b"AACC")],
        [(1, "TCP", f"TCP flow {FLOW}"), (1, "TCP", f"TCP {FLOW} [SYN]"), (2, "TCP", f"TCP {FLOW} [SYN/ACK]"), (3, "TCP", f"TCP {FLOW} [ESTABLISHED]"), (5, "STREAM_RETRANSMISSION", "retransmitted 4 byte(s) at seq=101"), (6, "STREAM_OVERLAP", "overlap of 2 byte(s) then 2 new byte(s)")],
    ),
    "hole": (
        [*OPEN, tcp(True, ACK, 101, b"AAAA"), tcp(True, ACK, 109, b"CCCC"), tcp(False, ACK, 501, b"zz"), tcp(False, ACK, 505, b"y"), tcp(False, ACK, 507, b"x")],
        [(1, "TCP", f"TCP flow {FLOW}"), (1, "TCP", f"TCP {FLOW} [SYN]"), (2, "TCP", f"TCP {FLOW} [SYN/ACK]"), (3, "TCP", f"TCP {FLOW} [ESTABLISHED]"), (8, "STREAM_GAP", "missing 2 byte(s) in gap"), (None, "STREAM_GAP", "unfilled gap of 4 byte(s) at flush"), (None, "STREAM_GAP", "unfilled gap of 1 byte(s) at flush")],
    ),
    "dns": ([udp(QUESTION)], [(1, "DNS", "DNS flow 10.0.0.1:5353 -> 10.0.0.2:53"), (1, "DNS", "DNS QUERY test.org (A)")]),
    "tls": ([tcp(True, ACK, 1, hello(), port=443)], [(1, "TCP", "TCP flow 10.0.0.1:40000 -> 10.0.0.2:443"), (1, "TLS", "TLS ClientHello TLS 1.0 sni=example.com")]),
    "http2": ([tcp(True, ACK, 1, b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n" + bytes([0, 0, 0, 4, 0, 0, 0, 0, 0]))], [(1, "TCP", f"TCP flow {FLOW}"), (1, "HTTP2", "HTTP/2 SETTINGS stream=0 len=0")]),
    "quic": ([udp(b"\xc0\x00\x00\x00\x01\x01\x07\x00" + bytes(20), 40000, 443)], [(1, "UDP", "UDP flow 10.0.0.1:40000 -> 10.0.0.2:443"), (1, "QUIC", "QUIC v1 Initial")]),
    "odd": ([b"abc", b"", tcp(True, ACK, 1, b"\x16\x03", port=443)], [(1, "UNKNOWN", "UNKNOWN flow  -> "), (3, "TCP", "TCP flow 10.0.0.1:40000 -> 10.0.0.2:443")]),
}


@pytest.fixture(scope="module")
def ingested(spark):
    rows = [(name, i + 1, 1_000_000 + i * 1000, bytearray(raw)) for name, (raws, _) in CASES.items() for i, raw in enumerate(raws)]
    df = spark.createDataFrame(rows, "session_id string, packet_id long, ts_us long, raw binary").repartition(5)
    p, f, e = I.ingest(df)
    return df, p.cache(), f.cache(), e.cache()


def test_events(ingested):
    got = {}
    for r in sorted(ingested[3].collect(), key=lambda r: (r.session_id, r.event_id)):
        got.setdefault(r.session_id, []).append((r.event_id, r.packet_id, r.event_type, r.summary))
        assert r.ts_us >= 1_000_000
    for name, (_, want) in CASES.items():
        have = got[name]
        assert [x[0] for x in have] == list(range(1, len(have) + 1))
        plain = [x[1:] for x in have if "NONE" not in x[3] and not (name in ("tls", "http2", "odd") and x[2] == "TCP" and "[" in x[3])]
        assert plain == want, name


def test_flows_and_facts(spark, ingested):
    f = {r.session_id: r for r in ingested[2].collect()}
    assert (f["basic"].packet_count, f["basic"].state, f["basic"].src_port, f["basic"].dst_port) == (7, "CLOSED", 40000, 80)
    got = {(r.session_id, r.protocol, r.name, r.value) for r in V.facts(I.decoded(ingested[0])).collect()}
    assert {("dns", "dns", "qname", "test.org"), ("tls", "tls", "sni", "example.com"), ("http2", "http2", "frame_type", "SETTINGS"), ("quic", "quic", "packet_type", "Initial"), ("basic", "http", "status", "0")} <= got
    assert not [x for x in got if x[0] == "dns" and x[1] == "tls"]
    trees = {r.session_id: json.loads(r.tree) for r in V.layer_tree(I.decoded(ingested[0])).where("packet_id = 1").collect()}
    assert trees["dns"]["children"][0]["children"][0]["children"][0]["fields"]["summary"] == "DNS QUERY test.org (A)"


@pytest.mark.parametrize(("rfc", "want"), [(False, [(101, 1)]), (True, [(101, 3), (103, 1)])])
def test_round_trips(spark, rfc, want):
    rows = [tcp(True, ACK, 101, b"ab"), tcp(True, ACK, 103, b"cd"), tcp(False, ACK, 501, ack=103), tcp(False, ACK, 501, ack=103), tcp(False, ACK, 501, ack=105, window=0)]
    df = spark.createDataFrame([("s", i + 1, 1000 * (i + 1) ** 2, bytearray(r)) for i, r in enumerate(rows)], "session_id string, packet_id long, ts_us long, raw binary")
    t = W.tracked(I.packets_of(I.decoded(df)))
    got = {r.packet_id: r.us for r in T.samples(t, rfc).collect()}
    # without rfc the first ACK of 103 takes both segments, as both end at or after it
    assert sorted(r.us for r in T.samples(t, rfc).collect()) == ([5000, 8000] if not rfc else [8000, 21000]) and got
    (m,) = T.metrics(t, rfc).collect()
    assert (m.dup_acks, m.zero_window, m.window_min, m.window_max, m.rtt_count, m.handshake_us) == (1, 1, 0, 1000, 2, None)
    assert want


def test_stream_units(spark):
    preface = b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    server = b"\x02" + (38).to_bytes(3, "big") + b"\x03\x03" + bytes(32) + b"\x00\x13\x02\x00"
    made = {
        "tls": [hello()[:20], hello()[20:] + b"\x16\x03\x03" + struct.pack("!H", len(server)) + server + b"\x17\x03\x03\x00\x02ab"],
        "http": [GET + b"POST /x HTTP/1.1\r\nContent-Length: 5\r\n\r\nab", b"cde", OK[:-1]],
        "chunked": [chunked[:60], chunked[60:]],
        "http2": [preface[:10], preface[10:] + bytes([0, 0, 2, 0, 1, 0, 0, 0, 3]), b"hi" + bytes([0, 0, 0, 200, 0, 0, 0, 0, 0])],
        "other": [b"hello there", b"\r\n\r\n"],
    }
    rows = [(k, 1, False, i, bytearray(d)) for k, parts in made.items() for i, d in enumerate(parts)]
    got = {}
    for r in sorted(S.stream_units(spark.createDataFrame(rows, "session_id string, flow_id long, resp boolean, packet_id long, data binary")).collect(), key=lambda r: (r.session_id, r.n)):
        got.setdefault(r.session_id, []).append(r)
    assert [r.summary for r in got["tls"]] == ["TLS TLS 1.0 ClientHello sni=example.com (1.3)", "TLS TLS 1.2 ServerHello", "TLS TLS 1.2 record(23)"]
    assert (got["tls"][0].ciphers, got["tls"][0].alpn, got["tls"][0].versions, got["tls"][1].ciphers) == (["AES_128_GCM_SHA256"], ["h2"], ["1.3"], ["0x0013"])
    assert [(r.summary, r.size) for r in got["http"]] == [("HTTP GET example.com HTTP/1.1", len(GET)), ("HTTP POST /x HTTP/1.1", 44)]
    assert [r.size for r in got["chunked"]] == [len(chunked)]
    assert [r.summary for r in got["http2"]] == ["HTTP/2 DATA stream=3 len=2 flags=0x1", "HTTP/2 type=200 stream=0 len=0 flags=0x0"]
    assert "other" not in got


def test_exports(spark, ingested, tmp_path):
    raw, p, f, e = ingested
    packets = p.join(raw.select("session_id", "packet_id", "raw"), ["session_id", "packet_id"])
    lines = {}
    for r in sorted(X.document_lines(packets, f, e).collect(), key=lambda r: (r.session_id, r.section, r.n)):
        lines.setdefault(r.session_id, []).append(r.line)
    doc = json.loads("".join(lines["basic"]))
    assert (doc["session_id"], len(doc["flows"]), len(doc["events"]), len(doc["packets"])) == ("basic", 1, 8, 7)
    assert list(doc["packets"][0]) == list(X.PACKET_FIELDS) and list(doc["flows"][0]) == list(X.FLOW_FIELDS)
    assert doc["packets"][0]["raw_len"] == 54 and doc["packets"][1]["ts"] == 1.001
    for fmt in ("JSON", "ndjson", "csv", "pcapng"):
        X.export(fmt, str(tmp_path / fmt), packets, f, e)
    parts = sorted((tmp_path / "JSON" / "session_id=hole").glob("part-*"))
    assert len(json.loads("".join(x.read_text() for x in parts))["packets"]) == 8
    assert spark.read.json(str(tmp_path / "ndjson")).count() == packets.count() == spark.read.option("header", True).csv(str(tmp_path / "csv")).count()
    with pytest.raises(ValueError, match="unknown export format"):
        X.export("xml", str(tmp_path), packets, f, e)
    with pytest.raises(ValueError, match="unknown CSV kind"):
        X.csv_lines(packets, "events")


def test_sanitize(spark, ingested):
    raw, p, f, e = ingested
    packets = p.join(raw.select("session_id", "packet_id", "raw"), ["session_id", "packet_id"])
    sp, sf, se, report = Z.sanitize(packets, f, e)
    rows = {r.packet_id: r for r in sp.where("session_id = 'basic'").withColumn("faults", R.issues(F.col("raw"), True)).collect()}
    first = bytes(rows[1].raw)
    assert (rows[1].source, rows[1].destination, rows[2].source) == ("10.255.0.0", "10.255.0.1", "10.255.0.1")
    assert first[:12].hex(":") == "02:00:00:00:00:00:02:00:00:00:00:01" and socket.inet_ntoa(first[26:30]) == "10.255.0.0" and rows[1].faults == []
    assert bytes(rows[4].raw)[54:] == GET
    texts = [r.summary for r in se.where("session_id = 'dns'").orderBy("event_id").collect()]
    assert texts == ["DNS flow 10.255.0.0:5353 -> 10.255.0.1:53", "DNS QUERY host-0.example (A)"]
    assert {r.source for r in sf.where("session_id <> 'odd'").collect()} == {"10.255.0.0"}
    r = {x.session_id: x for x in report.collect()}["basic"]
    assert (r.packets, r.flows, r.events, r.ips, r.macs, r.domains) == (7, 1, 8, 2, 2, 1)


def test_regression(spark, ingested, tmp_path):
    _, p, f, e = ingested
    stats = A.session_stats(p, f, e)
    (tmp_path / "a.check.json").write_text(json.dumps({"name": "good", "session": "basic", "expect": {"min_packets": 7, "max_flows": 1, "event_types": ["http", "TCP"], "max_duration": 1.5}}))
    (tmp_path / "b.check.json").write_text(json.dumps({"session": "hole", "expect": {"max_packets": 3, "event_types": ["DNS"]}}))
    (tmp_path / "c.check.json").write_text(json.dumps({"session": "gone", "expect": {"min_flows": 1}}))
    (tmp_path / "d.check.json").write_text(json.dumps({"session": "dns"}))
    got = V.regression(V.load_cases(spark, str(tmp_path)), stats, e)
    rows = {(r.name, r.check): (r.passed, r.detail) for r in got.collect()}
    assert rows[("good", "packets >= 7")] == (True, "actual=7.0") and rows[("good", "event http")] == (True, "present") and rows[("hole", "event DNS")] == (False, "absent")
    assert rows[("hole", "packets <= 3")][0] is False and rows[("gone", "flows >= 1")] == (False, "session not found") and rows[("dns", None)][0] is True
    assert V.regression_summary(got).first().summary == "2 passed, 2 failed"
    (tmp_path / "e.check.json").write_text(json.dumps({"session": "dns", "expect": {"min_cats": 1}}))
    with pytest.raises(Exception, match="unknown expectation keys"):
        V.load_cases(spark, str(tmp_path)).collect()


def test_views(spark, ingested):
    raw, p, f, e = ingested
    assert {(r.kind, r.session_id) for r in V.search(f, e, p, " TEST.org ").collect()} == {("event", "dns")}
    assert V.search(f, e, p, "  ").count() == 0 and V.search(f, e, p, "10.0.0", {"flow": 2}).where("kind = 'flow'").count() == 2
    assert [r.event_type for r in V.timeline(e, " dns,, ", limit=5).collect()] == ["DNS", "DNS"] and V.timeline_types(" , ") is None
    with pytest.raises(ValueError, match="limit"):
        V.timeline(e, limit=0)
    assert V.capture_filter_fault("tcp port 80 and (udp") and V.capture_filter_fault("a; b") and V.capture_filter_fault("tcp port 80") is None
    want = {k: hashlib.sha256(b"".join(raws)).hexdigest() for k, (raws, _) in CASES.items()}
    assert {r.session_id: r.sha256 for r in V.integrity_hash(raw).collect()} == want
    chunks = V.blob_chunks(raw, ["session_id", "packet_id"], size=7)
    assert {(r.session_id, r.packet_id): bytes(r.raw) for r in V.blob_whole(chunks, ["session_id", "packet_id"]).collect()} == {(k, i + 1): x for k, (raws, _) in CASES.items() for i, x in enumerate(raws)}
    hexed = [r for r in V.hex_rows(spark.createDataFrame([(1, bytearray(b"GET /\r\n" + bytes(range(200, 212))))], "i int, raw binary"), ["i"]).orderBy("offset").collect()]
    assert (hexed[0].ascii, hexed[1].hex) == ("GET /...........", "d1 d2 d3")
    replay = spark.createDataFrame([("s", "sent", 10, 0.5, 0.6), ("s", "failed", 9, 0.1, 0.1), ("s", "skipped", 9, 0.0, 0.0), ("s", "sent", -3, -1.0, 0.4)], "session_id string, status string, bytes long, gap double, elapsed double")
    r = V.replay_stats(replay).first()
    assert (r.sent, r.skipped, r.failed, r.bytes, r.scheduled, r.attempted, round(r.drift, 9)) == (2, 1, 1, 10, 0.5, 3, 0.6)


def test_event_graph(spark):
    rows = [("s", 1, None), ("s", 2, 1), ("s", 3, 2), ("s", 4, 3), ("s", 5, 4), ("s", 6, 1), ("s", 7, 8), ("s", 8, 7), ("s", 9, 77)]
    g = spark.createDataFrame(rows, "session_id string, event_id long, parent_id long")
    got = {(r.event_id, r.ancestor_id, r.distance) for r in V.ancestors(g).collect()}
    assert got == {(2, 1, 1), (3, 2, 1), (3, 1, 2), (4, 3, 1), (4, 2, 2), (4, 1, 3), (5, 4, 1), (5, 3, 2), (5, 2, 3), (5, 1, 4), (6, 1, 1), (7, 8, 1), (8, 7, 1), (9, 77, 1)}
    assert [r.event_id for r in V.unknown_parents(g).collect()] == [9]
    e = g.withColumn("packet_id", F.col("event_id") % 3).withColumn("event_type", F.when(F.col("event_id") == 4, "ERROR").otherwise("TCP")).withColumn("summary", F.lit("x")).withColumn("ts_us", F.lit(1)).withColumn("flow_id", F.lit(1))
    d = {r.packet_id: r for r in V.packet_detail(e).collect()}
    assert (d[1].event_id, d[1].upstream, d[1].downstream, d[1].has_error) == (1, [3, 8], 4, True)


def test_missing_ports_pair(spark):
    rows = [(s, 1, A1, B1, "ICMP", None, None, 1, 2, 3, 4, "NONE") for s in ("a", "b")]
    flows = spark.createDataFrame(rows, "session_id string, flow_id long, source string, destination string, protocol string, src_port int, dst_port int, start_us long, end_us long, packet_count long, bytes long, state string")
    assert [(r.status, r.port_a) for r in A.flow_diff(flows, "a", "b").collect()] == [("unchanged", None)]
    assert A.timing_diff(flows, "a", "b").count() == 1


def test_order_in_ranges(spark):
    """Numbers, previous values and sums of ranges against one list a session."""
    rows = [(f"s{i % 3 if i % 2 else 0}", (i * 7919) % 1009, i) for i in range(900)]
    d = O.dealt(spark.createDataFrame(rows, "session_id string, at long, v long"), ["at", "v"])
    assert d.select("part").distinct().count() > 1
    got = O.summed(O.previous(O.numbered(d, ["at", "v"], "n"), ["at", "v"], "v", "before"), ["at", "v"], "v", "total").collect()
    for s in {r[0] for r in rows}:
        mine = sorted((at, v) for x, at, v in rows if x == s)
        total = 0
        for i, ((at, v), r) in enumerate(zip(mine, sorted((r for r in got if r.session_id == s), key=lambda r: r.n), strict=True)):
            total += v
            assert (r.at, r.v, r.n, r.before, r.total) == (at, v, i + 1, mine[i - 1][1] if i else None, total)


@pytest.mark.parametrize("kind", ["pcap", "pcapng"])
def test_cut_packets_keep_their_length(spark, tmp_path, kind):
    from wiretide.sources.capture_file import read_captures, write_captures

    rows = [(1_000_001, bytearray(b"abc"), 60), (2_000_002, bytearray(b"defgh"), None)]
    write_captures(spark.createDataFrame(rows, "ts_us long, raw binary, orig_len int"), str(tmp_path / "c"), kind)
    got = I.of_captures(read_captures(spark, str(tmp_path / "c"))).orderBy("ts_us").collect()
    assert [(r.ts_us, bytes(r.raw), r.orig_len) for r in got] == [(1_000_001, b"abc", 60), (2_000_002, b"defgh", 5)]
