"""Measurements of a TCP flow whose packets come bit by bit, the same as tcp_metrics.metrics gives for a whole flow."""

from __future__ import annotations

from array import array

from wiretide.operators.reassembly import SPAN
from wiretide.operators.tcp_metrics import ACK, SYN, Open

#: What is kept between micro-batches; open segments as packed 64-bit numbers.
STATE = (
    "asked long, handshake_us long, dup_acks long, zero_window long, window_min long, window_max long, said0 long, said1 long, "
    "retransmissions long, rtt_count long, rtt_min_us long, rtt_max_us long, rtt_sum_us long, ends0 binary, sent0 binary, ends1 binary, sent1 binary"
)
FIELDS = [x.split()[0] for x in STATE.split(", ")]
#: What a flow's record tells of them.
RECORD = [f for f in FIELDS if f[-1] not in "01" and f != "asked"]
_COUNTS = ("dup_acks", "zero_window", "retransmissions", "rtt_count")


class Measures:
    """One flow so far; with ``rfc`` an acknowledgement covers segments that end at or before it, as in tcp_metrics."""

    def __init__(self, state: dict, rfc: bool) -> None:
        self.m = {f: state.get(f) for f in FIELDS} | {f: state.get(f) or 0 for f in _COUNTS}
        self.rfc, self.open = rfc, [self._open(i) for i in (0, 1)]

    def _open(self, i: int) -> Open:
        held = Open()
        for name, numbers in ((f"ends{i}", held.ends), (f"sent{i}", held.sent)):
            if self.m[name] is not None:
                numbers.frombytes(bytes(self.m[name]))
        return held

    def take(self, resp: int, ts: int, flags: int, seq: int, ack: int, size: int, window: int | None) -> None:
        m = self.m
        if flags & SYN and not flags & ACK and not resp:
            m["asked"] = ts
        if flags & SYN and flags & ACK and resp and m["asked"] is not None and m["handshake_us"] is None:
            m["handshake_us"] = max(0, ts - m["asked"])
        if window is not None:
            m["zero_window"] += window == 0
            m["window_min"] = window if m["window_min"] is None else min(m["window_min"], window)
            m["window_max"] = window if m["window_max"] is None else max(m["window_max"], window)
        pure = size == 0 and flags & ACK and not flags & SYN
        if pure or (size and flags & ACK):
            m["dup_acks"] += bool(pure) and m[f"said{resp}"] == ack
            m[f"said{resp}"] = ack
        if pure:
            for sent in self.open[1 - resp].covered(ack - SPAN // 2 + 1 if self.rfc else ack):
                self._trip(max(0, ts - sent))
        if size and self.open[resp].add((seq + size) % SPAN, ts):
            m["retransmissions"] += 1

    def _trip(self, us: int) -> None:
        m, first = self.m, self.m["rtt_count"] == 0
        m["rtt_count"] += 1
        m["rtt_sum_us"] = us if first else m["rtt_sum_us"] + us
        m["rtt_min_us"] = us if first else min(m["rtt_min_us"], us)
        m["rtt_max_us"] = us if first else max(m["rtt_max_us"], us)

    def forget(self) -> None:
        """Lets go of segments that nothing has acknowledged; what is measured stays."""
        self.open = [Open(), Open()]

    def state(self) -> dict:
        packed = {f"{n}{i}": array.tobytes(getattr(o, n)) for i, o in enumerate(self.open) for n in ("ends", "sent")}
        return self.m | packed

    def record(self) -> dict:
        return {f: self.m[f] for f in RECORD}
