"""What a replay or a scenario covers, and the small views of reports."""

import pytest
from pyspark.sql import functions as F

from wiretide.operators import selection as S
from wiretide.operators import views as V
from wiretide.operators.selection import ReplayConfig, ReplaySelection, ScenarioSelection


@pytest.fixture(scope="module")
def packets(spark):
    rows = [("s", i, 1_000_000 * i, None if i == 5 else i % 3, "TCP" if i % 2 else "DNS") for i in range(1, 11)] + [("t", 1, 0, 1, "TCP")]
    return spark.createDataFrame(rows, "session_id string, packet_id long, ts_us long, flow_id long, protocol string")


def ids(df):
    return sorted(r.packet_id for r in df.where("session_id = 's'").collect())


@pytest.mark.parametrize("inline", [0, 1000])
def test_replay_selection(packets, monkeypatch, inline):
    monkeypatch.setattr(S, "INLINE", inline)
    assert ids(ReplaySelection().select(packets)) == list(range(1, 11)) and ReplaySelection(frozenset(), frozenset()).is_unrestricted
    assert ids(ReplaySelection(frozenset({2, 5, 99})).select(packets)) == [2, 5]
    assert ids(ReplaySelection(flow_ids=frozenset({1})).select(packets)) == [1, 4, 7, 10]
    assert ids(ReplaySelection(frozenset({1, 4, 7}), frozenset({1}), 4_000_000, 7_000_000).select(packets)) == [4, 7]
    with pytest.raises(ValueError, match="end before start"):
        ReplaySelection(start_us=2, end_us=1)


def test_scenario_selection(packets):
    assert ids(ScenarioSelection("s").select(packets)) == [5]  # nothing but what has no flow
    assert ids(ScenarioSelection("s", include_all=True, start=3, end=6.0).select(packets)) == [3, 4, 5, 6]
    some = ScenarioSelection("s", (1, 2), protocols=("TCP",), packets=(1, 2))
    assert ids(some.select(packets)) == [1, 5, 7] and ids(ScenarioSelection("s", include_all=True, protocols=("tcp",)).select(packets)) == []
    assert ScenarioSelection.from_json(some.to_json()) == some
    for text in (None, "", "{", "[1]", "null", "{}"):
        assert ScenarioSelection.from_json(text) == ScenarioSelection("")


def test_replay_config(packets):
    for wrong, error in (({"speed": True}, TypeError), ({"speed": "2"}, TypeError), ({"speed": 0}, ValueError), ({"mode": "x"}, ValueError), ({"offset": -1}, ValueError), ({"limit": -1}, ValueError)):
        with pytest.raises(error):
            ReplayConfig(**wrong)
    assert ReplayConfig.preset("0.1").speed == 0.1
    for name in ("3", "fast", None):
        with pytest.raises(ValueError, match="unknown preset"):
            ReplayConfig.preset(name)
    own = packets.where("session_id = 's' and packet_id in (1, 2, 10)")
    waits = lambda c: [r.wait for r in c.schedule(own).orderBy("packet_id").collect()]
    assert waits(ReplayConfig(speed=2.0, max_gap=3.0)) == [0.0, 0.5, 3.0] and waits(ReplayConfig("faithful", 2.0)) == [0.0, 0.5, 4.0]
    assert waits(ReplayConfig("faithful", selection=ReplaySelection(frozenset({1, 10})))) == [0.0, 9.0]


def test_views(spark, packets):
    page = V.packet_page(packets, "s", 3, 2).orderBy("packet_id").collect()
    assert [(r.packet_id, r.total) for r in page] == [(3, 10), (4, 10), (5, 10)]
    assert V.packet_page(packets, "none").count() == 0
    with pytest.raises(ValueError, match="positive"):
        V.packet_page(packets, "s", 0)
    flows = spark.createDataFrame([("s", 1, 30, 5, 9), ("s", 2, 10, 7, 9), ("s", 3, 20, 7, 1)], "session_id string, flow_id long, start_us long, bytes long, packet_count long")
    order = lambda sort, n=None: [r.flow_id for r in V.flows_sorted(flows, sort, n).collect()]
    assert (order("start_ts"), order("bytes"), order("packets"), order("no such"), order("bytes", 1)) == ([2, 3, 1], [2, 3, 1], [1, 2, 3], [2, 3, 1], [2])
    events = spark.createDataFrame([("s", i, 100 - i % 2, None if i == 1 else (i + 1) // 2) for i in range(1, 7)], "session_id string, event_id long, ts_us long, parent_id long")
    assert [r.event_id for r in V.recent(events, 4).collect()] == [2, 5, 3, 1]
    assert sorted(tuple(r) for r in V.children(events).collect()) == [("s", 1, 1, 2), ("s", 2, 1, 3), ("s", 2, 2, 4), ("s", 3, 1, 5), ("s", 3, 2, 6)]
    assert spark.range(1).select(V.clock_text(F.lit(3_661_999_900))).first()[0] == "01:01:01.999"
    scores = spark.createDataFrame([(1.0000001,), (-0.5,), (float("nan"),), (None,), (0.25,)], "score double")
    assert [r.score for r in V.clamped(scores).collect()] == [1.0, 0.0, 0.0, 0.0, 0.25]
    diff = spark.createDataFrame([("a", "added"), ("b", "changed")], "x string, status string")
    assert [r.x for r in V.by_status(diff, "added").collect()] == ["a"]
    features = spark.createDataFrame([("s", "ip", "a", 2), ("s", "ip", "b", 1), ("t", "ip", "b", 4), ("t", "ip", "c", 4)], "session_id string, kind string, feature string, count long")
    assert [tuple(r) for r in V.shared_features(features, "s").collect()] == [("t", "ip", "b", 4, 1)]
    assert sorted(tuple(r) for r in V.totals(features).collect()) == [("s", "ip", 3, 2), ("t", "ip", 8, 2)]
    flags = V.with_flags(spark.createDataFrame([("s", 0), ("t", 5)], "session_id string, packets long"), spark.createDataFrame([("t",), ("t",)], "session_id string"))
    assert sorted((r.session_id, r.has_traffic, r.has_loss) for r in flags.collect()) == [("s", False, False), ("t", True, True)]
