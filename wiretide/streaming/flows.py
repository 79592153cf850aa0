"""Structured Streaming forms of the packet operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wiretide.operators.flows import rollup
from wiretide.operators.reassembly import DIRECTION, OUTPUT, Direction, Piece, packed, segments_of
from wiretide.operators.scratch import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def flow_rollup(packets: DataFrame) -> DataFrame:
    """Bidirectional flows so far, with their key; in update mode a batch gives the flows it changed.

    State is a row a flow and never expires, as flows have no end of their own.
    """
    return rollup(packets)


FLOW_KEY = ["session_id", "protocol", "ka", "kb"]


def rates(packets: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Packets and bytes a session and time window; in append mode a window goes out once it is ``late`` past."""
    p = packets.withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", late)
    g = p.groupBy("session_id", F.window("at", width)).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))
    return g.select("session_id", F.unix_micros("window.start").alias("window_us"), "packets", "bytes")


class Reassembler(StatefulProcessor):
    """Stream of one direction over micro-batches; batches arrive in capture order, rows inside are sorted here.

    State is the next sequence number and at most one waiting segment.  A batch's size bounds memory.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("edge", "next long, seq long, data binary, packet long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        direction = Direction()
        if self.state.exists():
            edge, seq, data, packet = self.state.get()
            direction = Direction(edge, [Piece(seq, bytes(data), packet)] if seq is not None else [])
        out = []
        batch = pd.concat(list(rows)).sort_values(["packet_id", "seq"])
        for packet, seq, data, last in zip(batch["packet_id"], batch["seq"], batch["data"], batch["last"], strict=True):
            if seq == seq and data is not None and len(data):
                out.append(direction.row(key, int(packet), int(seq), bytes(data)))
            if last:
                out.append(direction.end(key))
        if len(batch) and direction.edge is not None:
            seq, data, packet = direction.waiting[0] if direction.waiting else (None, None, None)
            self.state.update((direction.edge, seq, data, packet))
        yield packed([r for r in out if r])

    def close(self) -> None:
        pass


def reassemble_stream(segments: DataFrame) -> DataFrame:
    """Contiguous bytes and issues as segments arrive; needs the RocksDB state store.

    A row with ``last`` true ends its direction after its own data, if any: what waits behind a hole
    then comes out as it does at the end of a batch.  Without such a column nothing ends.
    """
    last = "coalesce(last, false) last" if "last" in segments.columns else "false last"
    s = segments_of(segments, last).where("last or octet_length(data) > 0 and seq is not null")
    return s.groupBy(*DIRECTION).transformWithStateInPandas(Reassembler(), OUTPUT, "Append", "None")


def run_to_end(stream: DataFrame, mode: str, key: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there now; gives the last state of "complete", all rows of "append", or of "update" the last row of each key.

    Each micro-batch overwrites its own folder, so a repeated batch changes nothing.
    """
    spark: SparkSession = stream.sparkSession
    base, done = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}", []

    def put(batch: DataFrame, i: int) -> None:
        batch.withColumn("batch_number", F.lit(i)).write.mode("overwrite").parquet(f"{base}/out/{i}")
        done.append(i)

    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(put).start()
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    kept = done[-1:] if mode == "complete" else sorted(set(done))
    out = spark.read.parquet(*[f"{base}/out/{i}" for i in kept])
    if mode == "update":
        out = out.groupBy(*key).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in key]), "batch_number").alias("row")).select(*key, "row.*")
    return out.select(*stream.columns)
