"""Sessions kept as Parquet: append-only tables by session, records with versions, deletions as marks.

Nothing is rewritten in place, so a writer that is lost and starts again leaves old rows readable.  A table of
records keeps every version; readers take the last of each key.  A deletion is a row of its own that hides all
that was written before it.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed tables: rows that are only added, and records with their keys; those of a stream name a flow by its first packet.
TABLES = ("packets", "events", "facts", "chunks", "live_events")
RECORDS = {"flows": ["session_id", "flow_id"], "live_flows": ["session_id", "first_packet"], "meta": ["session_id", "name"], "scenarios": ["session_id", "id"], "runs": ["session_id", "id"], "annotations": ["session_id", "id"]}
#: Fixed order of lists of records.
ORDER = {"flows": ["start_us", "flow_id"], "live_flows": ["first_packet"], "meta": ["name"], "scenarios": ["created_at", "id"], "runs": ["started_at", "id"], "annotations": ["created_at", "id"]}


class Store:
    """A folder of sessions that all executors reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/{name}").drop("batch")
        except Exception as e:  # a table that nothing was written to
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def _write(self, name: str, rows: DataFrame, batch: str | None = None) -> None:
        """Rows go into a folder of their batch; a batch that is written again takes the place of its first writing."""
        folder = f"{self.path}/{name}/batch={batch or uuid.uuid4().hex}"
        rows.withColumn("_version", F.lit(time.time_ns())).repartition("session_id", F.spark_partition_id()).write.partitionBy("session_id").mode("overwrite").parquet(folder)

    def append(self, name: str, rows: DataFrame, batch: str | None = None) -> None:
        """Adds rows with a session_id to a table of TABLES; a named batch counts once, however often it is added."""
        if name not in TABLES:
            raise ValueError(f"unknown table: {name!r}")
        self._write(name, rows, batch)

    def put(self, name: str, records: DataFrame, batch: str | None = None) -> None:
        """Adds records, or newer versions of records with the same key, to a table of RECORDS; batch as in append."""
        if name not in RECORDS:
            raise ValueError(f"unknown table: {name!r}")
        self._write(name, records, batch)

    def remove(self, name: str, keys: DataFrame) -> None:
        """Removes the records with these keys: a version that says so."""
        self._write(name, keys.select(*RECORDS[name]).distinct().withColumn("_gone", F.lit(True)))

    def delete_session(self, session_id: str) -> None:
        self._write("deleted", self.spark.createDataFrame([(session_id, True)], "session_id string, gone boolean"))

    def _living(self, rows: DataFrame) -> DataFrame:
        marks = self._read("deleted")
        if marks is None:
            return rows
        until = marks.groupBy("session_id").agg(F.max("_version").alias("_until"))
        return rows.join(until, "session_id", "left").where("_until is null or _version > _until").drop("_until")

    def table(self, name: str) -> DataFrame:
        """Rows of living sessions; of records the last version of each, in the order of their lists."""
        rows = self._read(name)
        if rows is None:
            raise ValueError(f"nothing is stored as {name}")
        rows = self._living(rows.withColumn("session_id", F.col("session_id").cast("string")))
        if name not in RECORDS:
            return rows.drop("_version")
        key = RECORDS[name]
        rest = [c for c in rows.columns if c not in key]
        last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_version").alias("r")).select(*key, "r.*")
        if "_gone" in last.columns:
            last = last.where("_gone is null or not _gone").drop("_gone")
        return last.drop("_version").orderBy(*ORDER[name])

    def sessions(self) -> DataFrame:
        """``(session_id, packets, first_us, last_us)`` of living sessions, by name."""
        return self.table("packets").groupBy("session_id").agg(F.count("*").alias("packets"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")).orderBy("session_id")


def run_status(started: Column, finished: Column, failed: Column) -> Column:
    return F.when(failed, "failed").when(finished.isNotNull(), "done").when(started.isNotNull(), "running").otherwise("pending")


def selection_fault(kind: str, start_ts: float | None, end_ts: float | None, target_id: str | None) -> str | None:
    """What makes an annotation's target unusable: a time range needs its start, any other kind an id."""
    if kind == "time_range":
        if start_ts is None:
            return "a time range needs start_ts"
        return "end_ts before start_ts" if end_ts is not None and end_ts < start_ts else None
    return None if target_id else f"{kind} needs target_id"
