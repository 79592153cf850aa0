"""Measurements of TCP flows from tracked packets: round trips, repeated acknowledgements, windows."""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretide.operators.reassembly import SPAN

SYN, ACK = 2, 16
_SAMPLES = "session_id string, flow_id long, kind string, packet_id long, us long"


def _bit(mask: int) -> Column:
    return F.col("flags").bitwiseAND(F.lit(mask)) != 0


class Open:
    """Segments of one side that nothing has acknowledged, 16 bytes each, in order of (end, time sent).

    Ends are numbers modulo 2**32; those that an acknowledgement covers are half a circle, so one or
    two slices of the order.  Segments mostly come in order and leave from an end of it, so
    both cost a search and a short move.
    """

    def __init__(self) -> None:
        self.ends, self.sent = array("q"), array("q")

    def add(self, end: int, ts: int) -> bool:
        """Whether an open segment with this end was sent earlier."""
        low, high = bisect_left(self.ends, end), bisect_right(self.ends, end)
        again = low < high and self.sent[low] < ts
        at = bisect_right(self.sent, ts, low, high)
        self.ends.insert(at, end)
        self.sent.insert(at, ts)
        return again

    def covered(self, low: int) -> list[int]:
        """Takes out the segments that end in the half circle from ``low`` on; gives their times."""
        low, out = low % SPAN, []
        high = low + SPAN // 2
        for a, b in ((low, min(high, SPAN)), (0, high - SPAN)):
            if a < b:
                i, j = bisect_left(self.ends, a), bisect_left(self.ends, b)
                out += self.sent[i:j]
                del self.ends[i:j], self.sent[i:j]
        return out


def _match(rfc: bool):
    """Walks flows in capture order; yields a row for each segment that is acknowledged or sent again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, open_ = None, (Open(), Open())
        for batch in batches:
            out = []
            for session, flow, resp, packet, ts, flags, seq, ack, size in batch.itertuples(index=False, name=None):
                if (session, flow) != key:
                    key, open_ = (session, flow), (Open(), Open())
                if size == 0 and flags & ACK and not flags & SYN:
                    # ends up to ack, or from ack on
                    times = open_[not resp].covered(ack - SPAN // 2 + 1 if rfc else ack)
                    out += [(session, flow, "rtt", packet, max(0, ts - sent)) for sent in times]
                if size and open_[resp].add((seq + size) % SPAN, ts):
                    out.append((session, flow, "again", packet, 0))
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _SAMPLES.split(", ")])

    return run


def samples(tracked: DataFrame, rfc: bool = False) -> DataFrame:
    """``(session_id, flow_id, kind, packet_id, us)``: a round trip ("rtt") for each data segment that a pure
    acknowledgement of the other side matches, and "again" for each segment that ends where an open one of its side does.

    With ``rfc`` an acknowledgement covers segments that end at or before it; without, those that end
    at or after it, as the established results have it.  One flow is walked in order, in one task; it
    holds 16 bytes for each segment that nothing has acknowledged, and its time is linear.
    """
    t = tracked.where("protocol = 'TCP'").select("session_id", "flow_id", "resp", "packet_id", "ts_us", "flags", F.coalesce("tcp_seq", F.lit(0)).alias("seq"), F.coalesce("tcp_ack", F.lit(0)).alias("ack"), F.coalesce(F.octet_length("payload"), F.lit(0)).alias("size"))
    return t.repartition("session_id", "flow_id").sortWithinPartitions("session_id", "flow_id", "packet_id").mapInPandas(_match(rfc), _SAMPLES)


def metrics(tracked: DataFrame, rfc: bool = False) -> DataFrame:
    """One row a TCP flow: handshake and round-trip times in microseconds, repeated acknowledgements, segments sent again, windows."""
    t = tracked.where("protocol = 'TCP'").withColumn("size", F.coalesce(F.octet_length("payload"), F.lit(0)))
    flow = ["session_id", "flow_id"]
    before = Window.partitionBy(*flow, "resp").orderBy("packet_id").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*flow).orderBy("packet_id").rowsBetween(Window.unboundedPreceding, 0)
    pure = _bit(ACK) & ~_bit(SYN) & (F.col("size") == 0)
    said = F.when(pure | (_bit(ACK) & (F.col("size") > 0)), F.coalesce("tcp_ack", F.lit(0)))
    t = t.withColumn("said", said).withColumn("said_before", F.last("said", ignorenulls=True).over(before))
    t = t.withColumn("asked_us", F.last(F.when(_bit(SYN) & ~_bit(ACK) & ~F.col("resp"), F.col("ts_us")), ignorenulls=True).over(upto))
    answered = _bit(SYN) & _bit(ACK) & F.col("resp") & F.col("asked_us").isNotNull()
    shake = F.min_by(F.when(answered, F.greatest(F.lit(0), F.col("ts_us") - F.col("asked_us"))), F.when(answered, F.col("packet_id")))
    one = t.groupBy(*flow).agg(
        shake.alias("handshake_us"), F.count_if(pure & (F.col("said") == F.col("said_before"))).alias("dup_acks"), F.count_if(F.col("tcp_window") == 0).alias("zero_window"), F.min("tcp_window").alias("window_min"), F.max("tcp_window").alias("window_max"),
    )
    rtt = F.when(F.col("kind") == "rtt", F.col("us"))
    two = samples(tracked, rfc).groupBy(*flow).agg(F.count_if(F.col("kind") == "again").alias("retransmissions"), F.count(rtt).alias("rtt_count"), F.min(rtt).alias("rtt_min_us"), F.max(rtt).alias("rtt_max_us"), F.sum(rtt).alias("rtt_sum_us"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("retransmissions", "rtt_count")}
    return one.join(two, flow, "left").withColumns(zero)
