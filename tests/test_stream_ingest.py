"""Frames that arrive in pieces against batch ingest of all of them."""

import random
import time

import pytest
from pyspark.sql import functions as F

from test_ingest import ACK, FIN, PSH, SYN, hello, tcp, udp
from wiretide.operators import facts as A
from wiretide.operators import flows as W
from wiretide.operators import ingest as I  # noqa: E741
from wiretide.sources.capture_file import stream_captures, write_captures
from wiretide.sources.store import Store
from wiretide.streaming.ingest import ingest_stream, ingested, live_facts

FRAMES = "session_id string, packet_id long, ts_us long, raw binary"


def session(name, seed):
    """A TCP flow with losses, repeats and an open hole, one of TLS, and datagrams."""
    rng = random.Random(seed)
    frames = [tcp(True, SYN, 100), tcp(False, SYN | ACK, 500, ack=101), tcp(True, ACK, 101, ack=501), tcp(True, PSH | ACK, 101, b"GET /a HTTP/1.1\r\nHost: h.example\r\n\r\n")]
    seq = 501
    for _ in range(30):
        size = rng.randint(1, 9)
        frames.append(tcp(False, ACK, seq + rng.choice([0, 0, 0, 0, 6, -5]), bytes(rng.randrange(256) for _ in range(size)), ack=150))
        seq += size
    frames += [udp(b"\x00\x07\x01\x00\x00\x01" + bytes(6) + b"\x01h\x02ex\x00\x00\x01\x00\x01"), tcp(True, PSH | ACK, 1, hello(), port=443), tcp(True, FIN | ACK, 140), tcp(False, FIN | ACK, seq), tcp(True, ACK, 141), b"\x00" * 9, tcp(False, ACK, seq + 50, b"late", ack=150), tcp(True, ACK, 300, b"early")]
    return [(name, i + 1, 1_000_000 + 10 * i, f) for i, f in enumerate(frames)]


def as_rows(df):
    return sorted(tuple((c, r[c]) for c in sorted(df.columns)) for r in df.collect())


def all_rows(flows, events):
    key = lambda rows: sorted(map(repr, rows))
    return key(as_rows(flows)), key(as_rows(events))


@pytest.mark.parametrize("pieces", [1, 7])
def test_stream_equals_batch(spark, tmp_path, pieces):
    rows = session("s1", 1) + session("s2", 2)
    for i in range(pieces):
        part = [r for r in rows if (r[1] - 1) * pieces // 43 == i]
        spark.createDataFrame(part, FRAMES).repartition(2).write.parquet(str(tmp_path / "made" / str(i)))
    _, flows, events = I.ingest(spark.createDataFrame(rows, FRAMES))
    want = all_rows(flows, events)
    store = Store(spark, str(tmp_path / "store"))
    (tmp_path / "in").mkdir()
    for i in range(pieces):  # a restart for each piece
        (tmp_path / "made" / str(i)).rename(tmp_path / "in" / str(i))
        stream = spark.readStream.schema(FRAMES).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        ingest_stream(stream, store, str(tmp_path / "state")).awaitTermination()
    assert all_rows(*ingested(store)) == want
    assert any(e["event_type"] == "STREAM_GAP" and e["packet_id"] is None for e in map(dict, as_rows(events)))


def test_replayed_batch_changes_nothing(spark, tmp_path):
    rows = session("s", 3)
    for i in range(2):
        spark.createDataFrame([r for r in rows if r[1] % 2 == i or True][i * 20 : 20 + i * 30], FRAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store, state = Store(spark, str(tmp_path / "store")), tmp_path / "state"
    stream = lambda: spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest_stream(stream(), store, str(state)).awaitTermination()
    first = all_rows(*ingested(store))
    commits = sorted((p for p in (state / "state" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    assert len(commits) >= 2
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):  # as if the driver was lost before it noted the last batch
        p.unlink(missing_ok=True)
    ingest_stream(stream(), store, str(state)).awaitTermination()
    assert all_rows(*ingested(store)) == first


def test_captures_dropped_into_a_folder(spark, tmp_path):
    rows = session("a", 4)
    frames = spark.createDataFrame(rows, FRAMES)
    write_captures(frames.select("ts_us", "raw").coalesce(1), str(tmp_path / "in"))
    captures = stream_captures(spark, str(tmp_path / "in"))
    stream = captures.select(F.lit("a").alias("session_id"), (F.col("capture_seq") + 1).alias("packet_id"), "ts_us", "raw", "orig_len")
    store = Store(spark, str(tmp_path / "store"))
    ingest_stream(stream, store, str(tmp_path / "state")).awaitTermination()
    _, flows, events = I.ingest(frames)
    assert all_rows(*ingested(store)) == all_rows(flows, events)


def talk(name, seed):
    """Flows with handshakes, acknowledgements old and new, repeats, windows that close, and datagrams."""
    rng, frames, sent = random.Random(seed), [tcp(True, SYN, 100), tcp(False, SYN | ACK, 500, ack=101), tcp(False, SYN | ACK, 500, ack=101)], [101, 501]
    for _ in range(60):
        side = rng.randrange(2)
        size = rng.choice([0, 0, 5, 9])
        again = rng.choice([0, 0, 0, 5])
        frames.append(tcp(side == 0, ACK, sent[side] - again, bytes(size), ack=rng.choice([sent[1 - side], sent[1 - side] - 5, 7]), window=rng.choice([0, 7, 900])))
        sent[side] += max(0, size - again)
    frames += [udp(bytes(rng.randrange(1, 90)), sp=5000, dp=6000) for _ in range(5)] + [tcp(True, SYN, 1, port=443), tcp(True, ACK, 2, b"alone", port=443)]
    return [(name, i + 1, 1_000_000 + rng.randrange(9000), f) for i, f in enumerate(frames)]


@pytest.mark.parametrize("rfc", [False, True])
def test_facts_equal_batch(spark, tmp_path, rfc):
    rows = talk("s1", 5) + talk("s2", 6)
    want = as_rows(A.stream_facts(W.tracked(I.packets_of(I.decoded(spark.createDataFrame(rows, FRAMES)))), rfc))
    assert {"handshake_rtt", "rtt_avg", "datagrams_per_second"} <= {dict(r)["name"] for r in want}
    store = Store(spark, str(tmp_path / "store"))
    for low, high in ((0, 9), (9, 40), (40, 99)):
        spark.createDataFrame([r for r in rows if low < r[1] <= high], FRAMES).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(FRAMES).parquet(str(tmp_path / "in"))
        ingest_stream(stream, store, str(tmp_path / "state"), measured=True, rfc=rfc).awaitTermination()
    assert as_rows(live_facts(store)) == want
    assert live_facts(store, closed=True).count() == 0


def test_idle_flows_close_and_reopen(spark, tmp_path):
    rows = session("s1", 1) + session("s2", 2)
    _, flows, events = I.ingest(spark.createDataFrame(rows, FRAMES))
    facts = as_rows(A.stream_facts(W.tracked(I.packets_of(I.decoded(spark.createDataFrame(rows, FRAMES))))))
    counted = flows.agg(F.sum("packet_count")).first()[0]
    store, source = Store(spark, str(tmp_path / "store")), str(tmp_path / "in")
    spark.createDataFrame(rows, FRAMES).repartition(2).write.parquet(source)
    stream = spark.readStream.schema(FRAMES).parquet(source)
    with pytest.raises(ValueError, match="every"):
        ingest_stream(stream, store, str(tmp_path / "state"), idle_s=1)
    query = ingest_stream(stream, store, str(tmp_path / "state"), measured=True, idle_s=1, every="1 second")

    def closed(n, packets):
        """Waits until all flows are closed and have that many packets."""
        for _ in range(60):
            time.sleep(1)
            assert query.exception() is None
            try:
                got = store.table("live_flows").agg(F.count_if("closed"), F.sum("packet_count")).first()
            except ValueError:
                continue
            if tuple(got) == (n, packets):
                return
        raise AssertionError(f"not closed: {got} of {n, packets}")

    try:
        closed(flows.count(), counted)
        assert all_rows(*ingested(store)) == all_rows(flows, events)
        assert as_rows(live_facts(store, closed=True)) == as_rows(live_facts(store)) == facts
        # a segment that comes late belongs to its flow; its bytes lie in a hole that was given up
        late = [("s1", 99, 2_000_000, tcp(True, ACK, 290, b"lost!", ack=150))]
        spark.createDataFrame(late, FRAMES).coalesce(1).write.mode("append").parquet(source)
        closed(flows.count(), counted + 1)
    finally:
        query.stop()
    more, told = ingested(store)
    assert more.count() == flows.count()
    assert [r.event_type for r in told.where("session_id = 's1' and packet_id = 99").collect()] == ["STREAM_RETRANSMISSION"]
    ids = lambda rows: sorted((dict(r)["session_id"], dict(r)["stream_id"], dict(r)["name"]) for r in rows)
    assert ids(as_rows(live_facts(store, closed=True))) == ids(facts)
