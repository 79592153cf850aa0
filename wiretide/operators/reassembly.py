"""TCP byte streams from segments, one direction of a flow at a time, in capture order.

Spark deals directions over partitions and sorts each partition by direction and capture order; a
function then walks the sorted rows.  It holds the edge of one stream and at most one waiting segment, so a flow
with a third of all packets costs time in one task but no memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

SPAN = 1 << 32
#: Segments beyond a hole at which it is given up.
PATIENCE = 2
DIRECTION = ["session_id", "flow_id", "resp"]
OUTPUT = "session_id string, flow_id long, resp boolean, packet_id long, data binary, issue string, at_seq long, detail string, cause_packet long"
_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]


class Piece(NamedTuple):
    """A segment that waits beyond a hole."""

    seq: int
    data: bytes
    packet: int | None


class Issue(NamedTuple):
    kind: str
    at_seq: int
    detail: str
    packet: int | None


def ahead(a: int, b: int) -> int:
    """How far sequence number ``a`` lies past ``b``, negative if before, over the wrap at 2**32."""
    return (a - b + SPAN // 2) % SPAN - SPAN // 2


def joined(edge: int, pieces: Iterable[Piece]) -> tuple[int, bytes, list[Piece]]:
    """(new edge, bytes, rest): what pieces add to a stream that is known up to ``edge``, and those beyond a hole.

    A piece reaches from its lead over the edge to its lead plus its length; only what lies past the
    edge is new, and a piece with nothing new is used up.
    """
    start, out, rest = edge, bytearray(), []
    for piece in sorted(pieces, key=lambda p: ahead(p.seq, start)):
        lead = ahead(piece.seq, edge)
        if lead > 0:
            rest.append(piece)
        elif lead + len(piece.data) > 0:
            out += piece.data[-lead:]
            edge = (piece.seq + len(piece.data)) % SPAN
    return edge, bytes(out), rest


def step(edge: int | None, waiting: list[Piece], piece: Piece) -> tuple[int, list[Piece], bytes, Issue | None]:
    """One segment with data: (edge, waiting, bytes, issue) after it."""
    if edge is None:
        edge = piece.seq
    behind = -ahead(piece.seq, edge)
    if behind > 0:  # known bytes come again: what waits is not looked at
        edge, out, _ = joined(edge, [piece])
        if out:
            return edge, waiting, out, Issue("overlap", piece.seq, f"overlap of {behind} byte(s) then {len(out)} new byte(s)", piece.packet)
        return edge, waiting, out, Issue("retransmission", piece.seq, f"retransmitted {len(piece.data)} byte(s) at seq={piece.seq}", piece.packet)
    edge, out, waiting = joined(edge, [*waiting, piece])
    if len(waiting) < PATIENCE:
        return edge, waiting, out, None
    near = min(ahead(p.seq, edge) for p in waiting)
    issue = Issue("gap", edge, f"missing {near} byte(s) in gap", piece.packet)
    edge, more, waiting = joined((edge + near) % SPAN, waiting)
    return edge, waiting, out + more, issue


def drain(edge: int, waiting: list[Piece]) -> tuple[bytes, Issue | None]:
    """Bytes that still wait at the end of a direction; the last hole before them is the issue."""
    out, issue = b"", None
    while waiting:
        first = min(waiting, key=lambda p: ahead(p.seq, edge))
        hole = ahead(first.seq, edge)
        issue = Issue("gap", edge, f"unfilled gap of {hole} byte(s) at flush", first.packet)
        edge, more, waiting = joined(first.seq, waiting)
        out += more
    return out, issue


class Direction:
    """A direction's stream so far: the next sequence number, and pieces beyond a hole."""

    def __init__(self, edge: int | None = None, waiting: list[Piece] | None = None) -> None:
        self.edge, self.waiting = edge, waiting or []

    def row(self, key: tuple, packet: int, seq: int, data: bytes) -> tuple | None:
        self.edge, self.waiting, out, issue = step(self.edge, self.waiting, Piece(seq, data, packet))
        return (*key, packet, out, *_told(issue)) if out or issue else None

    def end(self, key: tuple) -> tuple | None:
        if not self.waiting:
            return None
        out, issue = drain(self.edge, self.waiting)
        self.waiting = []
        return (*key, None, out, *_told(issue))


def _told(issue: Issue | None) -> tuple:
    return tuple(issue) if issue else (None, None, None, None)


def packed(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES).astype({"flow_id": "Int64", "packet_id": "Int64", "at_seq": "Int64", "cause_packet": "Int64"})


def _walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, direction = None, Direction()
    for batch in batches:
        rows = []
        for session, flow, resp, packet, seq, data in batch.itertuples(index=False, name=None):
            flow = None if flow != flow else int(flow)  # pandas has NaN for null
            if (session, flow, resp) != key:
                rows.append(direction.end(key))
                key, direction = (session, flow, resp), Direction()
            rows.append(direction.row(key, packet, int(seq), bytes(data)))
        rows = [r for r in rows if r]
        if rows:
            yield packed(rows)
    if (last := direction.end(key)) is not None:
        yield packed([last])


def segments_of(df: DataFrame, *more: str) -> DataFrame:
    return df.selectExpr("session_id", "cast(flow_id as long) flow_id", "resp", "cast(packet_id as long) packet_id", "cast(seq as long) seq", "data", *more)


def reassemble(segments: DataFrame) -> DataFrame:
    """Contiguous bytes and issues, a row a segment that gives either; a null packet_id marks the end of a direction.

    Takes session_id, flow_id, resp, packet_id, seq, data; other columns are left out.  Segments without
    data change nothing, null keys are a direction of their own, repeated rows are retransmissions.
    cause_packet is the packet an issue was noticed with, or that waited behind a hole at the end.
    """
    s = segments_of(segments).where("octet_length(data) > 0 and seq is not null")
    return s.repartition(*DIRECTION).sortWithinPartitions(*DIRECTION, "packet_id", "seq").mapInPandas(_walk, OUTPUT)
