"""Clients beyond the 4096 that 10.0.0.0/16 names: frames keep them apart, and queries on frames give their SQL's rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from wiretide.functions import frames as R
from wiretide.plans import frame_queries, ingest_queries
from wiretide.sources.adapter import client_name, frames, named, packets, wire_address

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = frame_queries.QUERIES | ingest_queries.QUERIES, frame_queries.ORACLE | ingest_queries.ORACLE


@pytest.fixture(scope="module")
def grown(tmp_path_factory):
    """The smallest events three times, their users in nets 16, 256 and 4096, which begin with the same two hexadecimal digits."""
    base = tmp_path_factory.mktemp("grown")
    copies = f"select event_id + i * 1000 as event_id, ts, (user_id + 256 * 16 ** i)::bigint as user_id, event_type, value, props from '{SF}/events.parquet', (select unnest(range(3)) as i)"
    duckdb.sql(f"copy (select * from ({copies}) order by event_id) to '{base}/events.parquet' (format parquet)")
    return str(base)


def test_addresses_are_legal_apart_and_lead_back(spark):
    b = [0, 255, 256, 257, 4095, 65535, 65536, 65536 * 7 + 255, 65536 * 8, (117 << 19) - 1]
    names = [f"10.0.{x}.{c}" for x in b for c in (1, 9, 16)] + ["203.0.113.2", "198.51.100.9"]
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("address", wire_address(F.col("name")))
    rows = df.withColumn("back", client_name(F.col("address"))).collect()
    assert [r.back for r in rows] == names
    assert len({r.address for r in rows}) == len(names)
    assert all(len(r.address.split(".")) == 4 and all(0 <= int(x) <= 255 for x in r.address.split(".")) for r in rows)
    assert {r.address for r in rows if r.name in ("10.0.0.1", "10.0.255.16", "203.0.113.2")} == {"10.0.0.1", "10.0.255.16", "203.0.113.2"}


def test_a_client_without_an_address_is_an_error(spark):
    df = spark.createDataFrame([(f"10.0.{117 << 19}.1",)], "name string")
    with pytest.raises(Exception, match="no IPv4 address left"):
        df.select(wire_address(F.col("name"))).collect()


def test_frames_keep_clients_apart(spark, grown):
    p = packets(spark, grown)
    got = named(R.parse(frames(p))).select("packet_id", "source", "destination")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, p.select("packet_id", "source", "destination").collect()))


@pytest.mark.parametrize("name", ["stream_facts", "window_stats", "tcp_metrics", "frame_events", "stream_frame_events", "live_stream_facts", "remap_frames", "frame_fields", "pcap_roundtrip", "pcapng_roundtrip"])
def test_matches_sql_with_more_clients(spark, grown, name):
    got = QUERIES[name](spark, grown)
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{grown}/events.parquet'")
    want = c.sql(ORACLE[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    place = [want.columns.index(x) for x in cols]
    rows = sorted(repr(tuple(r[i] for i in place)) for r in want.fetchall())
    assert sorted(repr(tuple(r)) for r in got.select(*cols).collect()) == rows
