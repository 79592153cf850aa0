"""What of a session a replay or a scenario covers, and how it is replayed: checked on the driver, applied as one filter or semi-join."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed names of replay modes, and speeds that go by name.
MODES = ("story", "faithful")
SPEEDS = (0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 10.0)
#: Ids up to which a set becomes part of the filter; larger ones are joined.
INLINE = 1000


def _within(packets: DataFrame, column: str, ids: frozenset[int]) -> DataFrame:
    if len(ids) <= INLINE:
        return packets.where(F.col(column).isin(*ids))
    some = packets.sparkSession.createDataFrame([(i,) for i in sorted(ids)], f"{column} long")
    return packets.join(some, column, "left_semi")


@dataclass(frozen=True)
class ReplaySelection:
    """Packets by number, flow and time, ends included; what is None or empty restricts nothing."""

    packet_ids: frozenset[int] | None = None
    flow_ids: frozenset[int] | None = None
    start_us: int | None = None
    end_us: int | None = None

    def __post_init__(self) -> None:
        if self.start_us is not None and self.end_us is not None and self.end_us < self.start_us:
            raise ValueError("end before start")

    @property
    def is_unrestricted(self) -> bool:
        return not self.packet_ids and not self.flow_ids and self.start_us is None and self.end_us is None

    def select(self, packets: DataFrame) -> DataFrame:
        """Packets ``(.., packet_id, flow_id, ts_us)`` that are covered; those without a flow are in no set of flows."""
        out = packets
        if self.start_us is not None:
            out = out.where(F.col("ts_us") >= self.start_us)
        if self.end_us is not None:
            out = out.where(F.col("ts_us") <= self.end_us)
        for column, ids in (("packet_id", self.packet_ids), ("flow_id", self.flow_ids)):
            out = _within(out, column, frozenset(ids)) if ids else out
        return out


@dataclass(frozen=True)
class ScenarioSelection:
    """Packets of a session by time, protocol (exact, none means any) and flow; without flows and include_all only those without a flow.

    packets, a range of numbers, is kept with the rest but restricts nothing.
    """

    session_id: str
    flow_ids: tuple[int, ...] = ()
    include_all: bool = False
    start: float | None = None
    end: float | None = None
    packets: tuple[int | None, int | None] = (None, None)
    protocols: tuple[str, ...] = field(default=())

    def select(self, packets: DataFrame) -> DataFrame:
        out = packets.where(F.col("session_id") == self.session_id)
        for bound, test in ((self.start, lambda x: F.col("ts_us") >= x), (self.end, lambda x: F.col("ts_us") <= x)):
            out = out.where(test(round(bound * 1_000_000))) if bound is not None else out
        if self.protocols:
            out = out.where(F.col("protocol").isin(*self.protocols))
        if self.include_all:
            return out
        return out.where(F.col("flow_id").isNull()).unionByName(_within(out, "flow_id", frozenset(self.flow_ids)))

    def to_json(self) -> str:
        return json.dumps({
            "session_id": self.session_id, "flows": {"flow_ids": list(self.flow_ids), "include_all": self.include_all}, "time_range": {"start": self.start, "end": self.end},
            "packets": {"start": self.packets[0], "end": self.packets[1]}, "protocols": list(self.protocols),
        })

    @classmethod
    def from_json(cls, text: str | None) -> ScenarioSelection:
        """What can't be read, or is left out, is the default: no session, no flows, any time and protocol."""
        try:
            data = json.loads(text or "{}")
        except ValueError:
            data = {}
        data = data if isinstance(data, dict) else {}
        flows, times, numbers = (data.get(k) or {} for k in ("flows", "time_range", "packets"))
        return cls(data.get("session_id") or "", tuple(flows.get("flow_ids") or ()), bool(flows.get("include_all")), times.get("start"), times.get("end"), (numbers.get("start"), numbers.get("end")), tuple(data.get("protocols") or ()))


@dataclass(frozen=True)
class ReplayConfig:
    """How packets are replayed: ``mode`` story caps gaps at max_gap, faithful keeps them; speed divides them."""

    mode: str = "story"
    speed: float = 1.0
    max_gap: float = 5.0
    offset: int = 0
    limit: int | None = None
    selection: ReplaySelection | None = None

    def __post_init__(self) -> None:
        if isinstance(self.speed, bool) or not isinstance(self.speed, int | float):
            raise TypeError("speed must be a number")
        if self.speed <= 0:
            raise ValueError("speed must be greater than 0")
        if self.mode not in MODES:
            raise ValueError(f"unknown mode: {self.mode!r}")
        if self.offset < 0 or (self.limit is not None and self.limit < 0):
            raise ValueError("offset and limit must not be negative")

    @classmethod
    def preset(cls, name: str) -> ReplayConfig:
        """The config of a speed that goes by name."""
        try:
            speed = float(name)
        except (TypeError, ValueError):
            speed = 0.0
        if speed not in SPEEDS:
            raise ValueError(f"unknown preset {name!r}")
        return cls(speed=speed)

    def schedule(self, packets: DataFrame) -> DataFrame:
        """``(session_id, packet_id, ts_us, wait)`` of the selected packets, as the mode waits before each."""
        from wiretide.operators.analysis import schedule

        chosen = self.selection.select(packets) if self.selection else packets
        return schedule(chosen, self.speed, self.max_gap if self.mode == "story" else None)
