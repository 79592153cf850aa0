"""Every registered packet query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from wiretide.operators.analysis import domain_features
from wiretide.plans import frame_queries, ingest_queries
from wiretide.plans.oracle import ORACLE as PACKET_SQL
from wiretide.plans.queries import QUERIES as PACKET_QUERIES

QUERIES, ORACLE = PACKET_QUERIES | frame_queries.QUERIES | ingest_queries.QUERIES, PACKET_SQL | frame_queries.ORACLE | ingest_queries.ORACLE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    place = [want.columns.index(c) for c in cols]
    rows = sorted(repr(tuple(r[i] for i in place)) for r in want.fetchall())
    assert sorted(repr(tuple(r)) for r in got.select(*cols).collect()) == rows


def test_domain_features_of_late_events(spark):
    events = spark.createDataFrame([("s0", i, "DNS", f"DNS QUERY H{i}.example.com (A)") for i in (1, 50_000, 50_001, 900_000)], "session_id string, event_id long, event_type string, summary string")
    flows = spark.createDataFrame([], "session_id string, source string, destination string, protocol string, dst_port int")
    got = {r.feature for r in domain_features(flows, events).collect()}
    assert got == {f"h{i}.example.com" for i in (1, 50_000, 50_001, 900_000)}
    assert {r.feature for r in domain_features(flows, events, 50_000).collect()} == {"h1.example.com", "h50000.example.com"}
