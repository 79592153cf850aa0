"""Capture files in ranges of bytes, cut anywhere, against whole ones."""

import random
import struct

import pandas as pd
import pytest

from wiretide.sources.capture_file import Blocks, Classic, Memory, _head, _record, bad_captures, chained, opened, packets_of, read_captures, survey


def capture(kind, seed, n=12, odd=True):
    rng = random.Random(seed)
    raws = [rng.randbytes(rng.choice([0, 1, 3, 8, 20, 40])) for _ in range(n)]
    if odd:  # bytes that look like a capture file themselves
        raws[n // 2] = _head(kind) + b"".join(_record(kind, 5_000_000 + i, b"inner" * 3, 15) for i in range(9))
    return _head(kind) + b"".join(_record(kind, 1_700_000_000_000_000 + i, r, len(r) + i % 2) for i, r in enumerate(raws))


def sections():
    """Two sections of different byte orders, with interfaces of different ticks between their packets."""
    out = b""
    for order, magic in (("<", 0x1A2B3C4D), (">", 0x1A2B3C4D)):
        out += struct.pack(order + "IIIHHqI", 0x0A0D0D0A, 28, magic, 1, 0, -1, 28)
        for port, unit in enumerate((6, 9, 3)):
            out += struct.pack(order + "IIHHI", 1, 32, 1, 0, 0) + struct.pack(order + "HHBxxxHH", 9, 1, unit, 0, 0) + struct.pack(order + "I", 32)
            for i in range(3):
                out += struct.pack(order + "7I", 6, 40, port, 0, 7_000_000 + i, 5, 9) + b"hello\0\0\0" + struct.pack(order + "I", 40)
            out += struct.pack(order + "III", 3, 20, 3) + b"abc\0" + struct.pack(order + "I", 20)
    return out


def in_ranges(data, split):
    """What the Spark job does with each range, one after the other."""
    source = Memory(data)
    rows = [("f", i, low, min(low + split, len(data)), *survey(source, low, min(low + split, len(data)))) for i, low in enumerate(range(0, len(data), split))]
    names = ["path", "i", "low", "high", "begin", "end", "count", "order", "order_after", "section", "ticks"]
    for _ in range(len(rows) + 1):
        chain = chained(pd.DataFrame(rows, columns=names))
        wrong = chain[chain["again"]]
        if wrong.empty:
            break
        for r in wrong.itertuples(index=False):
            rows[r.i] = (r.path, r.i, r.low, r.high, *survey(source, r.low, r.high, int(r.begin) if r.begin is not pd.NA else None, r.order))
    else:
        raise AssertionError("never settles")
    out = []
    for r in chain.itertuples(index=False):
        if r.begin < r.high:
            reader = Classic(source, r.begin) if isinstance(opened(source), Classic) else Blocks(source, r.begin, r.order, r.ticks)
            got = [(ts, data[at : at + kept], whole) for ts, at, kept, whole in reader.records(r.high)]
            assert r.first == len(out)
            out += got
    return out


@pytest.mark.parametrize("kind", ["pcap", "pcapng"])
@pytest.mark.parametrize("cut", [0, 1, 9, 30])
def test_cut_at_every_byte(kind, cut):
    data = capture(kind, cut)
    data = data[: len(data) - cut]
    whole = list(packets_of(data))
    assert len(whole) >= 9
    for split in [*range(25, 60), *range(60, len(data) + 2, 7)]:
        assert in_ranges(data, split) == whole


def test_sections_of_two_orders():
    data = sections()
    whole = list(packets_of(data))
    assert len(whole) == 24 and len({t for t, _, _ in whole}) > 6
    for split in [*range(28, 200), len(data)]:
        assert in_ranges(data, split) == whole


def test_broken_record_ends_the_file_in_ranges_too():
    data = bytearray(capture("pcap", 5, n=30, odd=False))
    at = 24
    for _ in range(9):
        at += 16 + struct.unpack_from("<I", data, at + 8)[0]
    struct.pack_into("<I", data, at + 8, 1 << 30)
    whole = list(packets_of(bytes(data)))
    assert len(whole) == 9
    for split in (40, 100, 333):
        assert in_ranges(bytes(data), split) == whole


def test_files_of_all_sizes(spark, tmp_path):
    want = []
    for kind in ("pcap", "pcapng"):
        for n in (3, 400):
            data = capture(kind, n, n)
            (tmp_path / f"f{n}.{kind}").write_bytes(data)
            want += [(f"f{n}.{kind}", i, ts, raw, size) for i, (ts, raw, size) in enumerate(packets_of(data))]
    for skip, text in ((False, None), (True, b"not a capture" * 400)):
        if text:
            (tmp_path / "bad.pcap").write_bytes(text)
            (tmp_path / "short.pcapng").write_bytes(b"x")
        for split in (300, 1500):
            got = read_captures(spark, str(tmp_path), skip, split).collect()
            assert sorted((r.path.rsplit("/", 1)[1], r.capture_seq, r.ts_us, bytes(r.raw), r.orig_len) for r in got) == sorted(want)
    assert sorted(r.path.rsplit("/", 1)[1] for r in bad_captures(spark, str(tmp_path)).collect()) == ["bad.pcap", "short.pcapng"]
    with pytest.raises(Exception, match="neither PCAP nor PCAPNG"):
        read_captures(spark, str(tmp_path), False, 300).collect()
