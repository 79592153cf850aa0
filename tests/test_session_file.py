"""Session files: rows in ranges, frames in blocks, older schemas, other journals, files that are none."""

import sqlite3

import pytest

from wiretide.sources import session_file as Q
from wiretide.sources.store import Store


def made(path, session, n, old=False, wal=False, magic="NREP", version="1"):
    db = sqlite3.connect(path)
    if wal:
        db.execute("PRAGMA journal_mode=WAL")
    more = "" if old else ", packet_id INTEGER, parent_id INTEGER"
    db.executescript(
        f"""CREATE TABLE nrp_header (key TEXT PRIMARY KEY, value TEXT NOT NULL); CREATE TABLE metadata (key TEXT PRIMARY KEY, value TEXT NOT NULL);
        CREATE TABLE packets (id INTEGER PRIMARY KEY AUTOINCREMENT, session_id TEXT NOT NULL, ts INTEGER NOT NULL, source TEXT, destination TEXT, protocol TEXT, src_port INTEGER, dst_port INTEGER, length INTEGER, flow_id INTEGER{'' if old else ', info TEXT'});
        CREATE TABLE flows (id INTEGER PRIMARY KEY AUTOINCREMENT, session_id TEXT NOT NULL, source TEXT, destination TEXT, protocol TEXT, src_port INTEGER, dst_port INTEGER, start_ts INTEGER, end_ts INTEGER, packet_count INTEGER, bytes INTEGER, state TEXT);
        CREATE TABLE events (id INTEGER PRIMARY KEY AUTOINCREMENT, session_id TEXT NOT NULL, ts INTEGER NOT NULL, event_type TEXT NOT NULL, flow_id INTEGER, summary TEXT{more});
        CREATE TABLE raw_blocks (packet_id INTEGER NOT NULL, seq INTEGER NOT NULL, size INTEGER NOT NULL, data BLOB NOT NULL, PRIMARY KEY (packet_id, seq));"""
    )
    db.executemany("INSERT INTO nrp_header VALUES (?, ?)", [("magic", magic), ("version", version)])
    db.executemany("INSERT INTO metadata VALUES (?, ?)", [("session_id", session), ("name", "a name")])
    if not old:
        db.execute("CREATE TABLE protocol_facts (id INTEGER PRIMARY KEY AUTOINCREMENT, session_id TEXT NOT NULL, packet_id INTEGER, stream_id INTEGER, protocol TEXT NOT NULL, name TEXT NOT NULL, value TEXT)")
        db.execute("INSERT INTO protocol_facts VALUES (1, ?, 2, NULL, 'dns', 'qname', 'h.example')", (session,))
    for i in range(1, n + 1):
        db.execute(f"INSERT INTO packets VALUES (?, ?, ?, 'a', 'b', 'TCP', ?, 80, 60, 1{'' if old else ', NULL'})", (3 * i, session, 1000 + i, None if i % 2 else i))
        db.executemany("INSERT INTO raw_blocks VALUES (?, ?, ?, ?)", [(3 * i, k, 4, b"%d/%d;" % (i, k)) for k in reversed(range(i % 4))])
        db.execute(f"INSERT INTO events VALUES (?, ?, ?, 'TCP', 1, ?{'' if old else ', ?, NULL'})", (i, session, 1000 + i, f"e{i}", *([] if old else [3 * i])))
    db.execute("INSERT INTO flows VALUES (1, ?, 'a', 'b', 'TCP', 1, 80, 1001, 1009, ?, 7, 'SYN')", (session, n))
    db.commit()
    db.close()


@pytest.fixture
def folder(tmp_path):
    f = tmp_path / "in"
    (f / "below").mkdir(parents=True)
    made(f / "one.nrp", "s1", 25)
    made(f / "below" / "two.nrp", "s2", 7, old=True, wal=True)
    made(f / "empty.nrp", "s3", 0)
    made(f / "magic.nrp", "s4", 1, magic="ELSE")
    made(f / "newer.nrp", "s5", 1, version="2")
    (f / "text.nrp").write_bytes(b"no database at all, but long enough to have a head of its own" * 20)
    (f / "none.nrp").write_bytes(b"")
    (f / "other.db").write_bytes(b"x")
    return f


@pytest.mark.parametrize("rows", [4, 200_000])
def test_read(spark, folder, rows):
    got = Q.read_sessions(spark, str(folder), rows)
    want = [(s, 3 * i, 1000 + i, None if i % 2 else i, b"".join(b"%d/%d;" % (i, k) for k in range(i % 4)) or None) for s, n in (("s1", 25), ("s2", 7)) for i in range(1, n + 1)]
    packets = [(r.session_id, r.packet_id, r.ts_us, r.src_port, None if r.raw is None else bytes(r.raw)) for r in got["packets"].collect()]
    assert sorted(packets, key=lambda r: r[:2]) == want
    events = got["events"].orderBy("session_id", "event_id").collect()
    assert [(e.session_id, e.event_id, e.summary, e.packet_id) for e in events] == [(s, i, f"e{i}", 3 * i if s == "s1" else None) for s, n in (("s1", 25), ("s2", 7)) for i in range(1, n + 1)]
    assert {(f.session_id, f.flow_id, f.packet_count, f.state) for f in got["flows"].collect()} == {("s1", 1, 25, "SYN"), ("s2", 1, 7, "SYN"), ("s3", 1, 0, "SYN")}
    assert {(f.session_id, f.packet_id, f.name, f.value) for f in got["protocol_facts"].collect()} == {("s1", 2, "qname", "h.example"), ("s3", 2, "qname", "h.example")}
    assert {(m.session_id, m.name, m.value) for m in got["metadata"].where("name = 'name'").collect()} == {(s, "name", "a name") for s in ("s1", "s2", "s3")}
    bad = {r.path.rsplit("/", 1)[1]: r.fault for r in got["bad"].collect()}
    assert bad == {"magic.nrp": "wrong magic", "newer.nrp": "unsupported or missing version", "text.nrp": "no session file"}  # Spark passes over empty files


def test_import(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert Q.import_sessions(spark, str(folder), store).count() == 3
    assert [(r.session_id, r.packets) for r in store.sessions().collect()] == [("s1", 25), ("s2", 7)]
    assert store.table("flows").count() == 3 and store.table("events").count() == 32 and store.table("facts").count() == 2


def test_write(spark, tmp_path):
    rows = [(s, i, i, "a", None, "TCP", 1, None, 60, b"x" * (70_000 if i == 3 else i)) for s in ("s", "t") for i in range(1, 9)]
    p = spark.createDataFrame(rows, "session_id string, packet_id long, ts_us long, source string, destination string, protocol string, src_port int, dst_port int, length long, raw binary")
    assert Q.write_sessions(p, str(tmp_path / "out")).agg({"packets": "sum"}).first()[0] == 16
    back = Q.read_sessions(spark, str(tmp_path / "out"))["packets"].select(p.columns).collect()
    assert sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in back) == sorted(rows)
