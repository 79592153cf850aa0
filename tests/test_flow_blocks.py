"""Flows in blocks against a walk of each flow, packet by packet."""

import random
import time

import pytest
from pyspark.sql import functions as F

from wiretide.operators import flows as W
from wiretide.operators import ordered as O  # noqa: N812
from wiretide.plans.queries import QUERIES
from wiretide.sources.adapter import packets

SCHEMA = "session_id string, packet_id long, ts_us long, source string, destination string, protocol string, src_port int, dst_port int, length int, flags int"


def walk(rows):
    """(session, packet) -> (flow_id, n, resp, fine, coarse, previous)."""
    flows, ids, out = {}, {}, {}
    for session, packet, _, src, dst, proto, sp, dp, _, flags in sorted(rows, key=lambda r: (r[0], r[1])):
        a, b = (src, sp or 0), (dst, dp or 0)
        key = (session, proto, min(a, b), max(a, b))
        f = flows.setdefault(key, {"n": 0, "init": (a, b), "syn": set(), "fin": set(), "last": None, "acked": False, "was": "NONE"})
        if f["n"] == 0:
            ids[session] = f["id"] = ids.get(session, 0) + 1
        f["n"] += 1
        resp = a == f["init"][1]
        if proto == "TCP":
            if flags & 4:
                f["last"], f["acked"] = "RESET", False
            else:
                if flags & 2:
                    f["syn"].add(resp)
                if flags & 1:
                    f["fin"].add(resp)
                if flags & 1:
                    f["last"], f["acked"] = ("CLOSED" if len(f["fin"]) == 2 else "CLOSE_WAIT" if resp else "FIN_WAIT"), False
                elif flags & 2:
                    f["last"], f["acked"] = ("SYN_RECEIVED" if len(f["syn"]) == 2 or resp else "SYN_SENT"), False
                elif flags & 16:
                    f["acked"] = True
        fine = f["last"] or "NONE"
        if fine.startswith("SYN") and f["acked"]:
            fine = "ESTABLISHED"
        coarse = W.COARSE.get(fine, "NONE")
        out[session, packet] = (f["id"], f["n"], resp, fine, coarse, f["was"])
        f["was"] = coarse
    return out


@pytest.mark.parametrize("block", [2, 7, 1 << 17])
def test_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(O, "BLOCK", block)
    rng = random.Random(block)
    hosts, ports = ["h1", "h2", ""], [None, 0, 5, 6]
    rows = []
    for s in ("x", "y"):
        for i in rng.sample(range(900), 400):
            flags = rng.choice([2, 18, 16, 16, 24, 17, 1, 4, 20, 3, 0, 22])
            rows.append((s, i, rng.randint(0, 9), rng.choice(hosts), rng.choice(hosts), rng.choice(["TCP", "TCP", "UDP"]), rng.choice(ports), rng.choice(ports), 10, flags))
    t = W.tracked(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = {(r.session_id, r.packet_id): (r.flow_id, r.n, r.resp, r.tcp_state, r.state, r.previous) for r in t.collect()}
    assert got == walk(rows)
    events = W.events_of(t).collect()
    for s in ("x", "y"):
        own = sorted((e for e in events if e.session_id == s), key=lambda e: e.event_id)
        assert [e.event_id for e in own] == list(range(1, len(own) + 1)) and [e.packet_id for e in own] == sorted(e.packet_id for e in own)


def test_events_without_a_packet_come_last(spark, monkeypatch):
    monkeypatch.setattr(O, "BLOCK", 4)
    rows = [("s", p, 0, 1, pos, "T", f"{p}/{pos}") for p in [*range(1, 12), None] for pos in (0, 3, 1 << 20)]
    e = spark.createDataFrame(rows, "session_id string, packet_id long, ts_us long, flow_id long, pos long, event_type string, summary string").repartition(4)
    got = [r.summary for r in W.in_insertion_order(e).orderBy("event_id").collect()]
    assert got == [f"{p}/{pos}" for p in [*range(1, 12), None] for pos in (0, 3, 1 << 20)]


def test_one_long_flow_is_shared_out(spark):
    n = 2_000_000
    flags = F.when(F.col("id") == 0, 2).when(F.col("id") == 1, 18).when(F.col("id") == n - 2, 17).when(F.col("id") == n - 1, 17).otherwise(16)
    out = F.col("id") % 2 == 0
    host = lambda a, b: F.when(out, a).otherwise(b)
    p = spark.range(n).select(F.lit("s").alias("session_id"), F.col("id").alias("packet_id"), F.col("id").alias("ts_us"), host("a", "b").alias("source"), host("b", "a").alias("destination"), F.lit("TCP").alias("protocol"), host(F.lit(1), F.lit(2)).alias("src_port"), host(F.lit(2), F.lit(1)).alias("dst_port"), F.lit(60).alias("length"), flags.alias("flags"))
    start = time.time()
    t = W.tracked(p)
    got = {r.tcp_state: (r.c, r.lo) for r in t.groupBy("tcp_state").agg(F.count("*").alias("c"), F.min("packet_id").alias("lo")).collect()}
    assert got == {"SYN_SENT": (1, 0), "SYN_RECEIVED": (1, 1), "ESTABLISHED": (n - 4, 2), "FIN_WAIT": (1, n - 2), "CLOSED": (1, n - 1)}
    assert t.agg(F.max("n"), F.countDistinct("flow_id")).first()[:] == (n, 1)
    assert t.rdd.getNumPartitions() > 1 and time.time() - start < 120


@pytest.mark.parametrize("block", [3, 1 << 17])
def test_packet_lists_name_every_packet(spark, monkeypatch, block):
    monkeypatch.setattr(O, "BLOCK", block)
    rows = [("s", 1, i, 10 * i, 5) for i in (9, 10, 2, 100, 30, 3)] + [("s", 2, 4, 40, 7), ("r", 1, 10, 1, 1), ("r", 1, 9, 2, 1), ("r", 2, None, 3, 1)]
    t = spark.createDataFrame(rows, "session_id string, flow_id long, packet_id long, ts_us long, length int").repartition(3)
    got = {(r[0], r[1]): tuple(r)[2:] for r in W.packet_lists(t).collect()}
    assert got == {("s", 1): (6, 2, 100, "2,3,9,10,30,100", 30, 20, 1000), ("s", 2): (1, 4, 4, "4", 7, 40, 40), ("r", 1): (2, 9, 10, "9,10", 2, 1, 2), ("r", 2): (1, None, None, None, 1, 3, 3)}


def test_flow_packets_all_names_every_packet(spark):
    """Sums of numbers don't tell which packets a flow has."""
    d = "/root/testdata/sf0.001"
    want = sorted((r.session_id, r.flow_id, r.packet_id) for r in W.tracked(packets(spark, d)).collect())
    got = sorted((r.session_id, r.flow_id, int(i)) for r in QUERIES["flow_packets_all"](spark, d).collect() for i in r.packet_ids.split(","))
    assert got == want
