"""Sessions in a folder of Parquet tables."""

import pytest

from wiretide.sources.store import Store, selection_fault


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "sessions"))
    packets = spark.createDataFrame([("a", 1, 10), ("a", 2, 30), ("b", 1, 20)], "session_id string, packet_id long, ts_us long")
    with pytest.raises(ValueError, match="nothing is stored"):
        s.table("packets")
    s.append("packets", packets)
    s.append("packets", packets.where("session_id = 'b'").selectExpr("session_id", "packet_id + 1 packet_id", "ts_us + 5 ts_us"))
    assert [tuple(r) for r in s.sessions().collect()] == [("a", 2, 10, 30), ("b", 2, 20, 25)]
    flow = "session_id string, flow_id long, start_us long, state string"
    s.put("flows", spark.createDataFrame([("a", 1, 5, "SYN"), ("a", 2, 1, "SYN"), ("b", 1, 1, "RST")], flow))
    s.put("flows", spark.createDataFrame([("a", 1, 5, "CLOSED")], flow))
    assert [(r.session_id, r.flow_id, r.state) for r in s.table("flows").where("session_id = 'a'").collect()] == [("a", 2, "SYN"), ("a", 1, "CLOSED")]
    s.put("scenarios", spark.createDataFrame([("a", "x", 2, "one"), ("a", "y", 1, "two")], "session_id string, id string, created_at long, name string"))
    s.put("scenarios", spark.createDataFrame([("a", "x", 2, "new")], "session_id string, id string, created_at long, name string"))
    s.remove("scenarios", spark.createDataFrame([("a", "y")], "session_id string, id string"))
    assert [(r.id, r.name) for r in s.table("scenarios").collect()] == [("x", "new")]
    s.delete_session("b")
    assert [r.session_id for r in s.sessions().collect()] == ["a"] and s.table("flows").where("session_id = 'b'").count() == 0
    s.append("packets", packets.where("session_id = 'b'"))  # the name may be used again
    assert [(r.session_id, r.packets) for r in s.sessions().collect()] == [("a", 2), ("b", 1)]
    for call in (s.append, s.put):
        with pytest.raises(ValueError, match="unknown table"):
            call("nothing", packets)


def test_selection_fault():
    assert selection_fault("time_range", None, None, None) and selection_fault("time_range", 2.0, 1.0, None) and selection_fault("flow", 1.0, None, None)
    assert selection_fault("time_range", 1.0, None, None) is None and selection_fault("flow", None, None, "7") is None
