"""PCAP and PCAPNG files as a batch source, a streaming source and a sink.

The source lists files through Spark's binaryFile.  A file up to a split is one row of it, so any store that Spark
reaches will do.  A larger one is read by ranges of bytes: a task looks for a chain of plausible record heads
in its range, and what it finds is checked against the end of the range before it.  The sink is a Python data source: every task writes files of at most ``roll`` bytes
under temporary names, and the driver renames those of committed attempts.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from wiretide.operators.scratch import materialize

SCHEMA = "path string, capture_seq long, ts_us long, raw binary, orig_len long"
ROLL = 256 << 20
#: Bytes of a file up to which it is read whole, and of a range beyond.
SPLIT = 128 << 20
#: File magics (byte order, ticks a second), PCAPNG block types, Ethernet link type.
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
SECTION_BYTES = b"\x0a\x0d\x0d\x0a"
ETHERNET, SNAPLEN = 1, 65535
#: Folder of rows whose session is null.
NO_SESSION = "__HIVE_DEFAULT_PARTITION__"


class Memory:
    """A file's bytes in hand."""

    def __init__(self, data: bytes) -> None:
        self.data, self.size = data, len(data)

    def at(self, start: int, count: int) -> bytes:
        return self.data[start : start + count]


class Blocked:
    """A file's bytes, read a block at a time from where they are asked for."""

    def __init__(self, file, block: int = 4 << 20) -> None:
        self.file, self.size, self.block = file, file.size(), block
        self.start, self.held = 0, b""

    def at(self, start: int, count: int) -> bytes:
        if not self.start <= start <= start + count <= self.start + len(self.held):
            self.file.seek(start)
            self.start, self.held = start, self.file.read(max(count, self.block))
        return self.held[start - self.start : start - self.start + count]


class Classic:
    """Records of a PCAP file from ``here`` on; ``here`` follows them, and is the file's size once nothing more can be read."""

    HEAD = 24

    def __init__(self, source: Memory | Blocked, here: int = HEAD) -> None:
        self.source, self.here = source, here
        self.order, self.ticks = MAGICS[source.at(0, 4)]
        self.head = struct.Struct(self.order + "4I")

    def records(self, stop: int) -> Iterator[tuple[int, int, int, int]]:
        """(time in microseconds, place of the bytes, how many, original length) of records that begin before ``stop``."""
        source, size = self.source, self.source.size
        while self.here < min(stop, size):
            at = self.here + 16
            self.here = size  # unless there is a whole record
            if at <= size:
                sec, part, kept, whole = self.head.unpack(source.at(at - 16, 16))
                if at + kept <= size:
                    self.here = at + kept
                    yield sec * 10**6 + part * 10**6 // self.ticks, at, kept, whole

    def resume(self, start: int, stop: int) -> int | None:
        """The first place from ``start`` on that looks like the head of a record, and leads to others."""
        source = self.source
        first = struct.unpack(self.order + "I", source.at(self.HEAD, 4))[0] if source.size >= self.HEAD + 16 else 0

        def plausible(w: np.ndarray) -> np.ndarray:
            sec, part, kept, whole = (w[k : len(w) - 12 + k].astype(np.int64) for k in (0, 4, 8, 12))
            return (part < self.ticks) & (kept <= LONGEST) & (whole >= kept) & (whole <= 1 << 24) & (abs(sec - first) < YEARS)

        return _resume(source, start, stop, 16, plausible, lambda w: 16 + w[8 : len(w) - 4].astype(np.int64), self.order)


#: Longest packet that a search for records takes for one, seconds between packets of a file, and records that must follow one another.
LONGEST, YEARS, CHAIN = 1 << 18, 20 * 365 * 86400, 6


def _resume(source, start: int, stop: int, head: int, plausible, length, order: str) -> int | None:
    """The first of the places from ``start`` to ``stop`` at which a chain of plausible heads begins.

    A wrong guess costs time only: it does not meet the end of the range before, and the range is read again from there.
    """
    window, ahead = 1 << 20, 4 * LONGEST
    for low in range(start, min(stop, source.size), window):
        data = source.at(low, window + ahead)
        words = np.zeros(max(0, len(data) - 3), np.uint32)  # at every byte
        for k in range(4):
            part = np.frombuffer(data[k : k + (len(data) - k) // 4 * 4], order + "u4")
            words[k::4] = part[: len(words[k::4])]
        if len(words) < head - 3:
            return None
        good, step = plausible(words), length(words)
        for at in np.flatnonzero(good[: min(window, stop - low)]).tolist():
            x, seen = at, 0
            while seen < CHAIN and x < len(good) and good[x]:
                x, seen = x + int(step[x]), seen + 1
            # whole chains, or those that reach the end of the file or of what is in hand
            if seen == CHAIN or low + x == source.size or x >= len(good) and low + x <= source.size:
                return low + at
    return None


def _resolution(options: bytes, order: str) -> int:
    """Ticks a second from the options of an interface."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "2H", options, at)
        if code == 0:
            break
        if code == 9 and size:
            v = options[at + 4]
            return 2 ** (v & 127) if v & 128 else 10**v
        at += 4 + size + -size % 4
    return 10**6


class Blocks:
    """Packets of a PCAPNG file from ``here`` on, with the byte order and the interfaces' ticks that hold there."""

    HEAD = 0

    def __init__(self, source: Memory | Blocked, here: int = HEAD, order: str = "<", ticks: list[int] | None = None) -> None:
        self.source, self.here, self.order, self.ticks = source, here, order, list(ticks or [])
        self.section = False  # whether one began since

    def records(self, stop: int) -> Iterator[tuple[int, int, int, int]]:
        source, size = self.source, self.source.size
        while self.here < min(stop, size):
            at = self.here
            self.here = size  # unless there is a whole block
            if at + 12 > size:
                return
            head = source.at(at, 12)
            if head[:4] == SECTION_BYTES:
                self.order, self.ticks, self.section = ("<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"), [], True
            kind, length = struct.unpack(self.order + "2I", head[:8])
            if length < 12 or length % 4 or at + length > size:
                return
            self.here = at + length
            if kind == INTERFACE:
                self.ticks.append(_resolution(source.at(at + 16, length - 20), self.order))
            elif kind == ENHANCED and length >= 32:
                port, high, low, kept, whole = struct.unpack(self.order + "5I", source.at(at + 8, 20))
                per = self.ticks[port] if port < len(self.ticks) else 10**6
                yield (high << 32 | low) * 10**6 // per, at + 28, min(kept, length - 32), whole
            elif kind == SIMPLE and length >= 16:
                whole = struct.unpack(self.order + "I", source.at(at + 8, 4))[0]
                yield 0, at + 12, min(whole, length - 16), whole

    def resume(self, start: int, stop: int) -> int | None:
        """As of Classic; sets the byte order that is found."""
        found = []
        for order in "<>":
            def plausible(w: np.ndarray, order=order) -> np.ndarray:
                kind, size = w[: len(w) - 8], w[4 : len(w) - 4].astype(np.int64)
                known = (kind == SECTION) | (kind >= 1) & (kind <= 6) | (kind == 10) | (kind == 0xBAD) | (kind == 0x40000BAD)
                close = np.arange(len(size)) + size - 4  # the length again
                inside = close < len(w)
                same = np.ones(len(size), bool)
                same[inside] = w[close[inside]] == size[inside]
                return known & (size >= 12) & (size % 4 == 0) & (size <= 4 * LONGEST) & same

            at = _resume(self.source, start, stop, 12, plausible, lambda w: w[4 : len(w) - 4].astype(np.int64), order)
            if at is not None:
                found.append((at, order))
        if not found:
            return None
        at, self.order = min(found)
        return at


def opened(source: Memory | Blocked) -> Classic | Blocks:
    """The reader of a capture file, at its first record."""
    if source.at(0, 4) in MAGICS:
        return Classic(source)
    if source.at(0, 4) == SECTION_BYTES:
        return Blocks(source)
    raise ValueError("neither PCAP nor PCAPNG")


def packets_of(data: bytes) -> Iterator[tuple[int, bytes, int]]:
    """Time in microseconds, bytes and original length of every packet; a cut-off last one is left out."""
    reader = opened(Memory(data))
    return ((ts, data[at : at + kept], whole) for ts, at, kept, whole in reader.records(len(data)))


def _decode(skip_bad: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                source = Memory(bytes(content))
                try:
                    reader = opened(source)
                except ValueError as e:
                    if skip_bad:
                        continue
                    raise ValueError(f"{path}: {e}") from e
                yield from _rows(path, 0, source, reader, source.size)

    return run


def _rows(path: str, first: int, source: Memory | Blocked, reader: Classic | Blocks, stop: int) -> Iterator[pd.DataFrame]:
    """Packets that begin before ``stop``, some megabytes at a time."""
    names = ["path", "capture_seq", "ts_us", "raw", "orig_len"]
    rows, held = [], 0
    for i, (ts, at, kept, whole) in enumerate(reader.records(stop), first):
        rows.append((path, i, ts, source.at(at, kept), whole))
        held += kept + 64
        if held > 8 << 20:
            yield pd.DataFrame(rows, columns=names)
            rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=names)


# --- files larger than a split: ranges of bytes --------------------------------------------------

def survey(source: Memory | Blocked, low: int, high: int, begin: int | None = None, order: str | None = None) -> tuple:
    """(begin, end, count, order, order_after, section, ticks) of a range; begin and order are guessed where they are not given."""
    reader = opened(source)
    if low == 0:
        begin = reader.HEAD
    elif begin is None:
        begin = reader.resume(low, high)
    if begin is None:
        return None, None, 0, reader.order, reader.order, False, []
    reader = Classic(source, begin) if isinstance(reader, Classic) else Blocks(source, begin, order or reader.order)
    before = reader.order
    count = sum(1 for _ in reader.records(high))
    return begin, reader.here, count, before, reader.order, getattr(reader, "section", False), reader.ticks if isinstance(reader, Blocks) else []


def chained(ranges: pd.DataFrame) -> pd.DataFrame:
    """Ranges of one file with ``first``, the packets before each, ``ticks`` that hold at its begin, and ``again``: its begin was guessed wrong.

    A range must begin where the one before ends; the first begins after the file's head, so by
    induction no record is lost or read twice.  Where it does not, begin and order are set right for another survey.
    """
    out, first, place, order, ticks = [], 0, None, None, []
    for r in ranges.sort_values("i").itertuples(index=False):
        begin, end = (None if x is None or x != x else int(x) for x in (r.begin, r.end))
        held, again = list(ticks), False
        if place is None and begin is None:
            out.append((r.path, r.i, r.low, r.high, None, None, first, r.order, held, False))
            continue
        if place is None:
            place, order = begin, r.order
        if place >= r.high:  # a record of a range before covers this one, or the file can't be read any further
            out.append((r.path, r.i, r.low, r.high, place, place, first, order, held, False))
            continue
        again = begin != place or r.order != order
        out.append((r.path, r.i, r.low, r.high, place, end, first, order, held, again))
        if again:  # what follows is looked at once this is known; meanwhile its guess stands
            place, order = None, None
            continue
        first += int(r.count)
        ticks = list(r.ticks) if r.section else ticks + list(r.ticks)
        place, order = end, r.order_after
    return pd.DataFrame(out, columns=["path", "i", "low", "high", "begin", "end", "first", "order", "ticks", "again"]).astype({"begin": "Int64", "end": "Int64"})


def _file(path: str):
    store, name = _store(path)
    return store.open_input_file(name)


def _surveyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranges ``(path, i, low, high, begin, order)`` -> the same with what ``survey`` finds."""
    names = ["path", "i", "low", "high", "begin", "end", "count", "order", "order_after", "section", "ticks"]
    for batch in batches:
        rows = []
        for path, i, low, high, begin, order in batch[["path", "i", "low", "high", "begin", "order"]].itertuples(index=False, name=None):
            with _file(path) as f:
                rows.append((path, i, low, high, *survey(Blocked(f), low, high, None if begin is None or begin != begin else int(begin), order)))
        if rows:
            yield pd.DataFrame(rows, columns=names).astype({"begin": "Int64", "end": "Int64"})


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, high, begin, first, order, ticks in batch[["path", "high", "begin", "first", "order", "ticks"]].itertuples(index=False, name=None):
            with _file(path) as f:
                source = Blocked(f)
                reader = opened(source)
                reader = Classic(source, begin) if isinstance(reader, Classic) else Blocks(source, begin, order, [int(t) for t in ticks])
                yield from _rows(path, first, source, reader, high)


def _ranges(files: DataFrame, split: int, skip_bad: bool) -> DataFrame:
    """Packets of files above ``split`` bytes, a range a task: ranges are surveyed, chained, surveyed again where a begin was wrong, and read."""
    spark = files.sparkSession
    i = F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / split).cast("int")))
    begin = "path string, i int, low long, high long"
    spread = files.select("path", "length", i.alias("i")).select("path", "i", (F.col("i").cast("long") * split).alias("low"), F.least((F.col("i").cast("long") + 1) * split, F.col("length")).alias("high"))
    if skip_bad:
        good = files.select("path").mapInPandas(_known, "path string")
        spread = spread.join(good, "path", "left_semi")
    spread = materialize(spread, "ranges")
    many = max(1, min(spread.count(), 100_000))  # a task a range, so that one that is lost costs one range
    found = f"{begin}, begin long, end long, count long, order string, order_after string, section boolean, ticks array<long>"
    fold = f"{begin}, begin long, end long, first long, order string, ticks array<long>, again boolean"
    asked = spread.withColumn("begin", F.lit(None).cast("long")).withColumn("order", F.lit(None).cast("string"))
    known = materialize(asked.repartition(many).mapInPandas(_surveyed, found), "surveyed")
    while True:
        chain = materialize(known.groupBy("path").applyInPandas(chained, fold), "chained")
        wrong = chain.where("again")
        if wrong.isEmpty():
            break
        mended = wrong.select("path", "i", "low", "high", "begin", "order").mapInPandas(_surveyed, found)
        known = materialize(known.join(wrong.select("path", "i"), ["path", "i"], "left_anti").unionByName(mended), "surveyed")
    return chain.where("begin < high").repartition(many).mapInPandas(_read, SCHEMA)


def _known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Paths of files whose head is that of a capture."""
    for batch in batches:
        kept = []
        for path in batch["path"]:
            with _file(path) as f:
                head = f.read(4)
            kept += [path] if head in MAGICS or head == SECTION_BYTES else []
        yield pd.DataFrame({"path": kept}, dtype=object)


def read_captures(spark: SparkSession, path: str, skip_bad: bool = False, split: int = SPLIT) -> DataFrame:
    """Packets of all .pcap and .pcapng files under ``path``; unknown content raises, or is left out with ``skip_bad``.

    A file of up to ``split`` bytes is one row of binaryFile.  Larger ones, of any size, are read by ranges of
    ``split`` bytes, in a task each, through pyarrow; numbers and times are as if they were read whole.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pcap,pcapng}").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= split).select("path", "content").mapInPandas(_decode(skip_bad), SCHEMA)
    large = files.where(F.col("length") > split).select("path", "length")
    return small if large.isEmpty() else small.unionByName(_ranges(large, split, skip_bad))


def bad_captures(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length)`` of files that ``skip_bad`` leaves out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pcap,pcapng}").option("recursiveFileLookup", "true").load(path)
    magics = [F.expr(f"X'{m.hex()}'") for m in (*MAGICS, SECTION_BYTES)]
    small = files.where(F.col("length") <= SPLIT).where(~F.substring("content", 1, 4).isin(*magics)).select("path", "length")
    large = files.where(F.col("length") > SPLIT).select("path", "length")
    return small if large.isEmpty() else small.unionByName(large.join(large.select("path").mapInPandas(_known, "path string"), "path", "left_anti"))


def stream_captures(spark: SparkSession, path: str, files_per_batch: int = 64, skip_bad: bool = False) -> DataFrame:
    """The same as a stream over files that arrive in a folder; unknown content stops it, or is left out with ``skip_bad``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{pcap,pcapng}").option("maxFilesPerTrigger", files_per_batch).load(path)
    return files.select("path", "content").mapInPandas(_decode(skip_bad), SCHEMA)


def _head(kind: str) -> bytes:
    if kind == "pcap":
        return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, SNAPLEN, ETHERNET)
    section = struct.pack("<IIIHHqI", SECTION, 28, 0x1A2B3C4D, 1, 0, -1, 28)
    return section + struct.pack("<IIHHII", INTERFACE, 20, ETHERNET, 0, SNAPLEN, 20)


def _record(kind: str, ts_us: int, raw: bytes, whole: int) -> bytes:
    if kind == "pcap":
        return struct.pack("<4I", ts_us // 10**6, ts_us % 10**6, len(raw), whole) + raw
    size = 32 + len(raw) + -len(raw) % 4
    return struct.pack("<7I", ENHANCED, size, 0, ts_us >> 32, ts_us & 0xFFFFFFFF, len(raw), whole) + raw + bytes(-len(raw) % 4) + struct.pack("<I", size)


def _store(path: str):
    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in local else (fs.LocalFileSystem(), local)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class CaptureWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.kind, self.roll = options["path"], options.get("kind", "pcap"), int(options.get("roll", ROLL))
        if self.kind not in ("pcap", "pcapng"):
            raise ValueError(f"unknown kind of capture file: {self.kind}")

    def write(self, iterator) -> Written:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        files, out, size, here = [], None, 0, None
        for batch in iterator:
            for folder, ts, raw, whole in zip(*(batch.column(c).to_pylist() for c in ("folder", "ts_us", "raw", "orig_len")), strict=True):
                if out is None or size >= self.roll or folder != here:
                    if out is not None:
                        out.close()
                    here, name = folder, f"part-{uuid.uuid4().hex}.{self.kind}"
                    store.create_dir(f"{root}/{folder}", recursive=True)
                    files.append((f"{root}/{folder}/_tmp-{name}", f"{root}/{folder}/{name}"))
                    out, size = store.open_output_stream(files[-1][0]), 0
                    out.write(_head(self.kind))
                record = _record(self.kind, ts, raw or b"", whole)
                out.write(record)
                size += len(record)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        store, _ = _store(self.path)
        for m in messages:
            for a, b in m.files if m else []:
                store.move(a, b)

    def abort(self, messages) -> None:
        store, _ = _store(self.path)
        for m in messages:
            for a, _b in m.files if m else []:
                store.delete_file(a)


class CaptureSink(DataSource):
    """``df.write.format("wiretide_capture").option("kind", "pcapng").save(path)`` for folder, ts_us, raw and orig_len; rows of a folder below the path stand together."""

    @classmethod
    def name(cls) -> str:
        return "wiretide_capture"

    def schema(self) -> str:
        return "folder string, ts_us long, raw binary, orig_len long"

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(dict(self.options))


def write_captures(packets: DataFrame, path: str, kind: str = "pcap", roll: int = ROLL) -> None:
    """Writes ts_us and raw as capture files, each in time order; rows without a time are left out.

    Where there is a column orig_len it is written as the packet's length before it was cut, else that of raw.
    Where there is a column session_id, each session has a folder ``session_id=<name>`` of its own (names
    with special characters are percent-encoded), else all files are in one.

    Files cover any share of the packets; a reader that needs one order sorts by ts_us.
    """
    spark = packets.sparkSession
    spark.dataSource.register(CaptureSink)
    kept = F.coalesce(F.octet_length("raw"), F.lit(0)).cast("long")
    whole = F.greatest(kept, F.coalesce(F.col("orig_len").cast("long"), kept)) if "orig_len" in packets.columns else kept
    own = "session_id" in packets.columns
    folder = F.concat(F.lit("session_id="), F.coalesce(F.url_encode(F.col("session_id").cast("string")), F.lit(NO_SESSION))) if own else F.lit(".")
    rows = packets.select(folder.alias("folder"), F.col("ts_us").cast("long").alias("ts_us"), "raw", whole.alias("orig_len")).where("ts_us is not null")
    if own:  # few files a session, and no task with all of a large one
        rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "folder", "ts_us")
    rows = rows.sortWithinPartitions("folder", "ts_us")
    rows.write.format("wiretide_capture").option("path", path).option("kind", kind).option("roll", str(roll)).mode("append").save()
