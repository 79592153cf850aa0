"""Session files of the older format: SQLite databases, read in ranges of rows, and written for those who keep them.

Files are listed through Spark's binaryFile.  One pass reads heads and row numbers; then a task takes a range of rows of
one table, loads the file's bytes into a database in memory and reads its range.  Nothing is locked or
migrated: columns that an older file has not are null.
"""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.operators.ordered import block_of
from wiretide.operators.scratch import materialize
from wiretide.sources.capture_file import _file, _store
from wiretide.sources.store import Store

#: Fixed values of the format: extension, table and value of its head, newest version, bytes of a block of a frame.
EXTENSION, HEAD, MAGIC, VERSION, CHUNK = "nrp", "nrp_header", "NREP", 1, 65536
#: Rows of a table that a task reads.
RANGE = 200_000
#: Fixed columns of tables: name in the file, name here, type.
TABLES = {
    "packets": [("id", "packet_id", "long"), ("ts", "ts_us", "long"), ("source", "source", "string"), ("destination", "destination", "string"), ("protocol", "protocol", "string"), ("src_port", "src_port", "int"), ("dst_port", "dst_port", "int"), ("length", "length", "long"), ("flow_id", "flow_id", "long"), ("info", "info", "string")],
    "flows": [("id", "flow_id", "long"), ("source", "source", "string"), ("destination", "destination", "string"), ("protocol", "protocol", "string"), ("src_port", "src_port", "int"), ("dst_port", "dst_port", "int"), ("start_ts", "start_us", "long"), ("end_ts", "end_us", "long"), ("packet_count", "packet_count", "long"), ("bytes", "bytes", "long"), ("state", "state", "string")],
    "events": [("id", "event_id", "long"), ("ts", "ts_us", "long"), ("event_type", "event_type", "string"), ("flow_id", "flow_id", "long"), ("summary", "summary", "string"), ("packet_id", "packet_id", "long"), ("parent_id", "parent_id", "long")],
    "protocol_facts": [("packet_id", "packet_id", "long"), ("stream_id", "stream_id", "long"), ("protocol", "protocol", "string"), ("name", "name", "string"), ("value", "value", "string")],
    "metadata": [("key", "name", "string"), ("value", "value", "string")],
}
_LISTED = "path string, session_id string, fault string, name string, low long, high long"


def opened(data: bytes) -> sqlite3.Connection:
    """The database of a file's bytes, whatever journal it was written with."""
    db = sqlite3.connect(":memory:")
    if data[18:20] == b"\x02\x02":  # a write-ahead log needs a file beside it; what it had not taken in is not in these bytes
        data = data[:18] + b"\x01\x01" + data[20:]
    db.deserialize(data)
    return db


def fault_of(db: sqlite3.Connection) -> str | None:
    """What makes a file unusable, None for a good one."""
    try:
        head = dict(db.execute(f"SELECT key, value FROM {HEAD}").fetchall())
    except sqlite3.DatabaseError:
        return "no session file"
    if head.get("magic") != MAGIC:
        return "wrong magic"
    version = head.get("version", "")
    return None if version.isdigit() and int(version) <= VERSION else "unsupported or missing version"


def _columns(db: sqlite3.Connection, table: str) -> set[str]:
    return {r[1] for r in db.execute(f"PRAGMA table_info({table})")}


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files -> their session and the row numbers of their tables, or their fault."""
    names = [c.split()[0] for c in _LISTED.split(", ")]
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                db = opened(bytes(content))
                fault = fault_of(db)
            except sqlite3.Error:
                fault = "no session file"
            if fault:
                rows.append((path, None, fault, None, None, None))
                continue
            session = (db.execute("SELECT value FROM metadata WHERE key = 'session_id'").fetchone() or [None])[0] if _columns(db, "metadata") else None
            for table in TABLES:
                if _columns(db, table):
                    low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {table}").fetchone()
                    rows.append((path, session, None, table, low, high))
            db.close()
        yield pd.DataFrame(rows, columns=names, dtype=object).astype({"low": "Int64", "high": "Int64"})


def _range(table: str):
    """Ranges ``(path, session_id, low, high)`` -> rows of a table, packets with their frames."""
    columns = TABLES[table]
    names = ["session_id", *[to for _, to, _ in columns], *(["raw"] if table == "packets" else [])]
    whole = {to: "Int64" for _, to, kind in columns if kind in ("long", "int")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, db = None, None
        for batch in batches:
            for path, session, low, high in batch[["path", "session_id", "low", "high"]].itertuples(index=False, name=None):
                if path != at:
                    with _file(path) as f:
                        at, db = path, opened(f.read())
                have = _columns(db, table)
                own = "coalesce(session_id, ?)" if "session_id" in have else "?"
                picked = ", ".join(c if c in have else f"NULL AS {c}" for c, _, _ in columns)
                rows = db.execute(f"SELECT {own}, {picked} FROM {table} WHERE rowid BETWEEN ? AND ? ORDER BY rowid", (session, low, high))
                if table != "packets":
                    while some := rows.fetchmany(20_000):
                        yield pd.DataFrame(some, columns=names, dtype=object).astype(whole)
                    continue
                while some := rows.fetchmany(2_000):
                    blocks: dict[int, bytes] = {}
                    if _columns(db, "raw_blocks"):  # ids of a table are its row numbers
                        for packet, data in db.execute("SELECT packet_id, data FROM raw_blocks WHERE packet_id BETWEEN ? AND ? ORDER BY packet_id, seq", (some[0][1], some[-1][1])):
                            blocks[packet] = blocks.get(packet, b"") + data
                    yield pd.DataFrame([(*r, blocks.get(r[1])) for r in some], columns=names, dtype=object).astype(whole)

    return run


def _listed(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{EXTENSION}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(_heads, _LISTED)


def read_sessions(spark: SparkSession, path: str, rows: int = RANGE) -> dict[str, DataFrame]:
    """DataFrames of the tables of all session files under ``path``, and ``bad``: files left out, with what is wrong with them.

    Each file, under 2 GB, is read by every task that takes a range of it.
    """
    listed = materialize(_listed(spark, path), "session-files")
    out = {"bad": listed.where("fault is not null").select("path", "fault").orderBy("path")}
    cut = F.explode(F.sequence(F.col("low"), F.col("high"), F.lit(rows).cast("long")))
    ranges = listed.where("low is not null").withColumn("low", cut).withColumn("high", F.least("high", F.col("low") + (rows - 1)))
    ranges = materialize(ranges, "row-ranges")
    tasks = max(1, min(ranges.count(), 100_000))
    for table, columns in TABLES.items():
        schema = ", ".join(["session_id string", *[f"{to} {kind}" for _, to, kind in columns], *(["raw binary"] if table == "packets" else [])])
        out[table] = ranges.where(F.col("name") == table).repartition(tasks, "path", "low").mapInPandas(_range(table), schema)
    return out


def import_sessions(spark: SparkSession, path: str, store: Store) -> DataFrame:
    """Adds all good session files under ``path`` to a store; gives those left out, with what is wrong with them."""
    read = read_sessions(spark, path)
    batch = f"import-{uuid.uuid4().hex}"
    store.append("packets", read["packets"], batch)
    store.append("events", read["events"], batch)
    store.append("facts", read["protocol_facts"], batch)
    store.put("flows", read["flows"], batch)
    store.put("meta", read["metadata"], batch)
    return read["bad"]


_WRITTEN = "path string, session_id string, packets long"


def write_sessions(packets: DataFrame, path: str) -> DataFrame:
    """Writes packets with raw frames as session files, one for each session and block of packet numbers; gives what was written.

    Run once for each folder: the files' names are those of sessions and blocks, so a task that runs again overwrites its own.
    """
    columns = [to for _, to, _ in TABLES["packets"] if to in packets.columns]

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        session, block = key
        db = sqlite3.connect(":memory:")
        db.executescript(f"CREATE TABLE {HEAD} (key TEXT PRIMARY KEY, value TEXT NOT NULL); CREATE TABLE metadata (key TEXT PRIMARY KEY, value TEXT NOT NULL); CREATE TABLE raw_blocks (packet_id INTEGER NOT NULL, seq INTEGER NOT NULL, size INTEGER NOT NULL, data BLOB NOT NULL, PRIMARY KEY (packet_id, seq))")
        kinds = {"string": "TEXT", "long": "INTEGER", "int": "INTEGER"}
        db.execute(f"CREATE TABLE packets (session_id TEXT, {', '.join(c + ' ' + kinds[k] + (' PRIMARY KEY' if c == 'id' else '') for c, _, k in TABLES['packets'])})")
        db.executemany(f"INSERT INTO {HEAD} VALUES (?, ?)", [("magic", MAGIC), ("version", str(VERSION))])
        db.execute("INSERT INTO metadata VALUES ('session_id', ?)", (session,))
        names = [c for c, to, _ in TABLES["packets"] if to in columns]
        plain = rows[columns].astype(object).where(rows[columns].notna(), None)
        db.executemany(f"INSERT INTO packets (session_id, {', '.join(names)}) VALUES (?, {', '.join('?' * len(names))})", [(session, *r) for r in plain.itertuples(index=False, name=None)])
        for packet, raw in zip(rows["packet_id"], rows["raw"], strict=True):
            raw = bytes(raw or b"")
            db.executemany("INSERT INTO raw_blocks VALUES (?, ?, ?, ?)", [(int(packet), i // CHUNK, len(raw[i : i + CHUNK]), raw[i : i + CHUNK]) for i in range(0, len(raw), CHUNK)])
        db.commit()
        fs, root = _store(path)
        fs.create_dir(root, recursive=True)
        name = f"{root}/{session}-{block}.{EXTENSION}"
        with fs.open_output_stream(name) as f:
            f.write(db.serialize())
        return pd.DataFrame([(name, session, len(rows))], columns=["path", "session_id", "packets"])

    dealt = packets.select("session_id", *columns, "raw", block_of(F.col("packet_id")).alias("block"))
    return materialize(dealt.groupBy("session_id", "block").applyInPandas(write, _WRITTEN), "written")
