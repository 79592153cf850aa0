"""Long flows and directions, sessions kept apart, tokens beyond a byte."""

import random
import time
import tracemalloc

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wiretide.operators import ingest as I  # noqa: E741
from wiretide.operators import streams as S
from wiretide.operators.reassembly import SPAN, ahead
from wiretide.operators.sanitize import ip_token, mac_token
from wiretide.operators.tcp_metrics import _match
from wiretide.operators.tls import read_keylog
from wiretide.sources import exports as X
from wiretide.sources.capture_file import read_captures

NAMES = ["session_id", "flow_id", "resp", "packet_id", "ts_us", "flags", "seq", "ack", "size"]


def matched(rows, rfc):
    out = list(_match(rfc)(iter([pd.DataFrame(rows, columns=NAMES)])))
    return sorted(map(tuple, pd.concat(out).itertuples(index=False))) if out else []


def matched_by_hand(rows, rfc):
    out, open_ = [], ({}, {})
    for s, f, resp, packet, ts, flags, seq, ack, size in rows:
        if size == 0 and flags & 16 and not flags & 2:
            theirs = open_[not resp]
            for end in [e for e in theirs if (ahead(ack, e) >= 0 if rfc else ahead(e, ack) >= 0)]:
                out += [(s, f, "rtt", packet, max(0, ts - t)) for t in theirs.pop(end)]
        if size:
            sent = open_[resp].setdefault((seq + size) % SPAN, [])
            if any(t < ts for t in sent):
                out.append((s, f, "again", packet, 0))
            sent.append(ts)
    return sorted(out)


@pytest.mark.parametrize("rfc", [False, True])
@pytest.mark.parametrize("around", [0, 5000, SPAN - 300, SPAN // 2])
def test_round_trips(rfc, around):
    rng = random.Random(around)
    near = lambda: (around + rng.choice([rng.randint(-400, 400), rng.randint(0, SPAN - 1), SPAN // 2 + rng.randint(-3, 3)])) % SPAN
    rows = [("s", 1, rng.random() < 0.5, i, 1000 + i - rng.choice([0, 0, 0, 2, 50]), rng.choice([16, 16, 18, 2]), near(), near(), rng.choice([0, 0, 1, 7, 100])) for i in range(3000)]
    assert matched(rows, rfc) == matched_by_hand(rows, rfc)


@pytest.mark.parametrize("rfc", [False, True])
def test_long_flow_in_linear_time(rfc):
    rows = [("s", 1, i % 4 == 3, i, i, 16, 100 * i % SPAN if i % 4 != 3 else 1, 0 if i % 4 != 3 else (100 * i - 250) % SPAN, 100 if i % 4 != 3 else 0) for i in range(200_000)]
    start = time.time()
    assert matched(rows, rfc)
    assert time.time() - start < 20


def units(pieces, **options):
    rows = pd.DataFrame([("s", 1, False, p) for p in pieces], columns=["session_id", "flow_id", "resp", "data"])
    out = list(S._scan(**options)(rows.iloc[i : i + 64] for i in range(0, len(rows), 64)))
    return [(u.kind, u.size) for x in out for u in x.itertuples()]


def test_directions_that_nothing_reads_are_let_go():
    noise = random.Random(0).randbytes(1 << 20)
    starts = [b"SSH-2.0-x\r\n\r\n", b"", b"\x16\x03\x03\x00\x04\x0e\x00\x00\x00garbage", S.HTTP2_PREFACE + b"\xff" * 9, b"GET / HTTP/1.1\r\nContent-Length: 99999999999\r\n\r\n", b"POST /x HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\n"]
    for first in starts:
        tracemalloc.start()
        begin = time.time()
        list(S._scan()(pd.DataFrame([("s", 1, False, (first if i == 0 else b"") + noise)], columns=["session_id", "flow_id", "resp", "data"]) for i in range(64)))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 32 << 20 and time.time() - begin < 20, (first, peak)


def test_small_segments_take_linear_time():
    pieces = [b"GET /" + b"a" * 1000] + [b"b" * 1000] * 8000
    start = time.time()
    assert units(pieces) == []
    assert time.time() - start < 10


def http(body, *more):
    return b"HTTP/1.1 200 OK\r\n" + b"".join(m + b"\r\n" for m in more) + b"\r\n" + body


@pytest.mark.parametrize("cut", [1, 2, 3, 7, 50, 10_000])
def test_messages_cut_anywhere(cut):
    long = http(b"x" * 3000, b"Content-Length: 3000")
    chunked = http(b"5\r\nhello\r\n0\r\n\r\n", b"Transfer-Encoding: chunked")
    stream = b"GET /a HTTP/1.1\r\nHost: h\r\n\r\n" + long + chunked + http(b"")
    got = units([stream[i : i + cut] for i in range(0, len(stream), cut)])
    if cut < 50:  # a chunked message reaches to the last end in its piece
        assert got == [("request", 28), ("response", len(long)), ("response", len(chunked)), ("response", len(http(b"")))]
    else:
        assert got[:2] == [("request", 28), ("response", len(long))] and sum(n for _, n in got) == len(stream)
    frames = S.HTTP2_PREFACE + b"\x00\x00\x05\x00\x00\x00\x00\x00\x01hello" + b"\x20\x00\x00\x00\x00\x00\x00\x00\x01" + b"z" * (1 << 21) + b"\x00\x00\x00\x04\x00\x00\x00\x00\x00"
    if cut > 7:
        pieces = [frames[i : i + cut] for i in range(0, len(frames), cut)]
        assert units(pieces) == [("DATA", 5)]
        assert units(pieces, most_frame=None) == [("DATA", 5), ("DATA", 1 << 21), ("SETTINGS", 0)]


def test_long_heads_end_a_scan_unless_allowed():
    pieces = [b"GET /" + b"a" * (1 << 20)] + [b"a" * (1 << 20)] * 16 + [b" HTTP/1.1\r\n\r\n"]
    assert units(pieces) == [] and [k for k, _ in units(pieces, most_head=None)] == ["request"]


def test_tokens(spark):
    i = [0, 255, 256, 65_535, 65_536, (1 << 24) - 1, 1 << 24, (1 << 24) + (1 << 28) - 1]
    df = spark.createDataFrame([(x,) for x in i], "i long").coalesce(1)
    ips = [r[0] for r in df.select(ip_token(F.col("i"))).collect()]
    assert ips == ["10.255.0.0", "10.255.0.255", "10.255.1.0", "10.255.255.255", "10.254.0.0", "10.0.255.255", "240.0.0.0", "255.255.255.255"]
    macs = [r[0] for r in df.select(mac_token(F.col("i"))).collect()]
    assert macs[:5] == ["02:00:00:00:00:00", "02:00:00:00:00:ff", "02:00:00:00:01:00", "02:00:00:00:ff:ff", "02:00:00:01:00:00"]
    many = spark.range(70_000).select(ip_token(F.col("id")).alias("a"), mac_token(F.col("id")).alias("m")).agg(F.countDistinct("a"), F.countDistinct("m")).first()
    assert tuple(many) == (70_000, 70_000)
    for token, at in ((ip_token, (1 << 24) + (1 << 28)), (mac_token, 1 << 40)):
        with pytest.raises(Exception, match="tokens"):
            spark.createDataFrame([(at,)], "i long").select(token(F.col("i"))).collect()


@pytest.mark.parametrize("kind", ["pcap", "pcapng"])
def test_captures_of_sessions(spark, tmp_path, kind):
    rows = [(s, i, 1000 * i + n, bytes([n, i]) * 10, 20 + i) for n, s in enumerate(["s0", "a/b=c d", "s0.x"]) for i in range(1, 40)]
    packets = spark.createDataFrame(rows, "session_id string, packet_id long, ts_us long, raw binary, orig_len long").repartition(3)
    X.export(kind, str(tmp_path / "out"), packets, packets, packets)
    back = I.of_captures(read_captures(spark, str(tmp_path / "out")))
    assert sorted(map(tuple, back.select("session_id", "packet_id", "ts_us", "raw", "orig_len").collect())) == sorted((s, i, t, bytearray(r), n) for s, i, t, r, n in rows)


def test_last_secret_counts(spark, tmp_path):
    a, b = "aa" * 32, "bb" * 32
    (tmp_path / "1.log").write_text(f"CLIENT_RANDOM {a} 01\nCLIENT_RANDOM {b} 02\nCLIENT_RANDOM {a} 03\n# note\n")
    (tmp_path / "2.log").write_text(f"CLIENT_RANDOM {b} 04\nCLIENT_RANDOM {b} 05\n")
    got = {r.client_random.hex(): r.secret.hex() for r in read_keylog(spark, str(tmp_path)).collect()}
    assert got == {a: "03", b: "05"}
