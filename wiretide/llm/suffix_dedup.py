"""Suffix-array dedup: every byte string of min_len bytes that occurs again, found exactly.

A suffix array of the whole corpus fits no machine, so suffixes are first dealt into blocks.  Each
window of min_len bytes is represented by its minimizer, the k-gram in it with the smallest hash:
equal windows have equal minimizers, hence meet in one block.  Consecutive windows with one
minimizer travel as one segment.  Segments equal in full form a class: one representative, with
the class's number of copies, stands for them all.  A suffix array orders the suffixes of a
block's classes; a class of several copies has each suffix once more, next to itself, for its
later copies.  From the array come the longest-previous-factor array, by previous and next smaller
positions in suffix order, and its mirror image for later matches; these decide every window, and
what they say of a class's later copies goes to its members.

A block of very many classes is split by a longer common core, as a k-gram extended on both sides:
windows are dealt by their place about the minimizer into narrow ranges, and a range's block is
what all its windows share.  What is still too large is split into single windows, whose core is
the window itself, so that a block is one class.  No block grows with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.llm.common import HEAVY, U64, Powers, as_binary, codes, fmix, gathered, join_unique, materialize, row_key, shuffle_partitions, table
from wiretide.llm.ngram_join import prefiltered

#: Bytes walked at once.
PIECE = 1 << 20
#: Classes of a block beyond which it is split.
SPLIT_ABOVE = 1000
#: Neighbouring places of windows that stay together at each level of splitting; the last must be 1.
WIDTHS = (8, 1)
#: Bytes of segments whose suffixes are sorted together, at least one block's.
SORT_BYTES = 1 << 18
_OFF = 1 << 20
_POWERS: dict[int, Powers] = {}
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _powers(i: int) -> Powers:
    if i not in _POWERS:
        _POWERS[i] = Powers(_BASES[i], PIECE + 8192)
    return _POWERS[i]


def kgram_length(min_len: int) -> int:
    return max(1, min(64, min_len // 3))


def segments(data: np.ndarray, offsets: np.ndarray, min_len: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Yields (text index, start in text, windows, minimizer hash, content hash, minimizer's place from start) of all segments, piece by piece."""
    k = kgram_length(min_len)
    w = min_len - k + 1
    n = len(data)
    for a in range(0, n, PIECE):
        b = min(n, a + PIECE)
        end = min(n, b + min_len - 1)
        raw = data[a:end]
        m = len(raw)
        if m < min_len:
            continue
        p = _powers(0).prefix(raw)
        h = fmix((p[k:] - p[:-k]) * _powers(0).down[: m - k + 1])
        key = (h & ~U64((1 << 21) - 1)) | np.arange(len(h), dtype=U64)
        size, low = 1, key
        while size * 2 <= w:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < w:
            low = np.minimum(low[: m - min_len + 1], low[w - size : w - size + m - min_len + 1])
        at = (low[: m - min_len + 1] & U64((1 << 21) - 1)).astype(np.int64)
        count = min(b - a, m - min_len + 1)
        at = at[:count]
        # windows that cross from one text into the next are none
        edges = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, end, "left")] - a
        delta = np.zeros(count + 1, np.int32)
        np.add.at(delta, np.clip(edges - min_len + 1, 0, count), 1)
        np.add.at(delta, np.clip(edges, 0, count), -1)
        valid = np.cumsum(delta[:-1]) == 0
        new = np.ones(count, bool)
        new[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
        starts = np.flatnonzero(new & valid)
        if not len(starts):
            continue
        brk = np.flatnonzero(new | ~valid)
        nxt = np.searchsorted(brk, starts, "right")
        stops = np.where(nxt < len(brk), brk[np.minimum(nxt, len(brk) - 1)], count)
        # content: a polynomial over the mixed hashes of all k-grams, which have no structure of the bytes left
        q = np.zeros(len(h) + 1, U64)
        np.cumsum(h * _powers(1).up[: len(h)], out=q[1:])
        ends = stops - k + min_len
        content = fmix(((q[ends] - q[starts]) * _powers(1).down[starts]) ^ (ends - starts).astype(U64))
        doc = np.searchsorted(offsets, starts + a, "right") - 1
        yield doc, starts + a - offsets[doc], stops - starts, h[at[starts]], content, at[starts] - starts


def _runs_of(data: np.ndarray, offsets: np.ndarray, min_len: int) -> list[np.ndarray]:
    got = list(segments(data, offsets, min_len))
    return [np.concatenate([g[i] for g in got]) for i in range(6)] if got else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, U64)] * 2 + [np.zeros(0, np.int64)]


def _repeated_minimizers(docs: DataFrame, min_len: int) -> DataFrame:
    """``(mh)``: hashes of minimizers of at least two segments.  A task sends each hash once, marked if it has it twice."""
    buckets = shuffle_partitions(docs.sparkSession)
    names = ["bucket", "once", "more"]

    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        v, c = np.unique(np.concatenate(held), return_counts=True)
        b = ((v >> U64(11)) % U64(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        v, c = v[order], c[order]
        cut = np.searchsorted(b[order], np.arange(buckets + 1))
        once = [v[i:j][c[i:j] == 1].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
        more = [v[i:j][c[i:j] > 1].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(buckets), pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            mh = _runs_of(*as_binary(batch.column(0)), min_len)[3]
            held.append(mh)
            n += len(mh)
            if n > 4_000_000:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, more = [np.zeros(0, U64)], [np.zeros(0, U64)]
        for batch in batches:
            once.append(np.frombuffer(as_binary(batch.column(1))[0].tobytes(), U64))
            more.append(np.frombuffer(as_binary(batch.column(2))[0].tobytes(), U64))
        twice = np.unique(np.concatenate(more))
        v, c = np.unique(np.concatenate([*once, twice]), return_counts=True)
        out = np.union1d(v[c > 1], twice).view(np.int64)
        for i in range(0, len(out), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(out[i : i + 100_000])], ["mh"])

    sent = docs.select("text").mapInArrow(send, "bucket int, once binary, more binary")
    return sent.repartition(buckets, "bucket").mapInArrow(meet, "mh bigint")


def _all_segments(docs: DataFrame, min_len: int) -> DataFrame:
    """``(rk, id, s, n, mh, ch)`` of every segment of ``docs(rk, id, text)``; n is windows + _OFF * place of the minimizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, s, n, mh, ch, off = _runs_of(*as_binary(batch.column(2)), min_len)
            n = n + off * _OFF
            for i in range(0, len(doc), 200_000):
                j = slice(i, i + 200_000)
                of = pa.array(doc[j])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(s[j]), pa.array(n[j]), pa.array(mh[j].view(np.int64)), pa.array(ch[j].view(np.int64))], ["rk", "id", "s", "n", "mh", "ch"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("rk", "id", "text").mapInArrow(run, f"rk binary, id {kind}, s bigint, n bigint, mh bigint, ch bigint")


# -- suffix arrays -----------------------------------------------------------------------------


def suffix_order(data: np.ndarray, at: np.ndarray, depth: int, block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array over the positions ``at`` by their first ``depth`` bytes, and LCPs with the one before, up to depth.

    With a number of a block for each position, each block has an array of its own, one after the other.
    Ranks of substrings double in length: a rank of 2 L bytes is a pair of ranks of L bytes.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(depth + 8, np.uint8)])
    word = np.zeros(n, U64)
    for j in range(8):
        word = (word << U64(8)) | padded[j : j + n].astype(U64)
    rank = np.unique(word, return_inverse=True)[1].astype(np.int64)
    levels = [(8, rank)]
    size = 8
    while size * 2 <= depth:
        right = np.zeros(n, np.int64)
        right[: n - size] = rank[size:] + 1
        rank = np.unique((rank << 32) | right, return_inverse=True)[1].astype(np.int64)
        size *= 2
        levels.append((size, rank))
    tail = np.minimum(at + (depth - size), n - 1)
    key = (rank[at] << 32) | rank[tail]
    order = np.argsort(key, kind="stable") if block is None else np.lexsort((key, block))
    sa = at[order]
    a, b = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(len(sa), np.int64)
    got = np.zeros(len(a), np.int64)
    for size, r in reversed(levels):
        for _ in range(2 if size == levels[-1][0] else 1):
            same = (a < n) & (b < n) & (got + size <= depth)
            same[same] = r[a[same]] == r[b[same]]
            got[same] += size
            a[same] += size
            b[same] += size
    # what is left is under 8 bytes
    for _ in range(7):
        more = (got < depth) & (a < n) & (b < n)
        more[more] = data[a[more]] == data[b[more]]
        if not more.any():
            break
        got[more] += 1
        a[more] += 1
        b[more] += 1
    lcp[1:] = got
    if block is not None:
        lcp[1:][block[order][1:] != block[order][:-1]] = 0
    return sa, lcp


def previous_smaller(pos: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """For each suffix the common prefix with the nearest suffix before it, in suffix order, that starts earlier.

    Pointers jump over suffixes that start later; a chain ends where the common prefix falls below ``least``.
    """
    n = len(pos)
    jump, common = np.arange(n) - 1, lcp.copy()
    active = np.flatnonzero((jump >= 0) & (common >= least))
    active = active[pos[jump[active]] > pos[active]]
    while len(active):
        q = jump[active]
        c, nxt = np.minimum(common[active], common[q]), jump[q]
        common[active], jump[active] = c, nxt
        go = (nxt >= 0) & (c >= least)
        common[active[nxt < 0]] = 0
        active, nxt = active[go], nxt[go]
        active = active[pos[nxt] > pos[active]]
    if n:
        common[jump < 0] = 0
    return np.where(common >= least, common, 0)


def factors(sa: np.ndarray, lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(longest previous factor, longest next factor) of each suffix in ``sa``; values below ``least`` count as 0."""
    back = np.zeros_like(lcp)
    if len(lcp):
        back[1:] = lcp[:0:-1]
    lpf = np.maximum(previous_smaller(sa, lcp, least), previous_smaller(sa[::-1], back, least)[::-1])
    lnf = np.maximum(previous_smaller(-sa, lcp, least), previous_smaller(-sa[::-1], back, least)[::-1])
    return lpf, lnf


def _solve(data: np.ndarray, size: np.ndarray, n: np.ndarray, block: np.ndarray, copied: np.ndarray, min_len: int, first_stays: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(segment, from, to) of ranges of windows that occur again (or before), for first copies and then for later ones."""
    first = np.cumsum(size) - size
    seg = np.repeat(np.arange(len(n)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = first[seg] + inner
    sa, lcp = suffix_order(data, at, min_len, block[seg])
    # a class of several copies has its suffixes twice: the later copies' stand right behind, alike to their whole depth
    times = 1 + copied[np.searchsorted(first, sa, "right") - 1]
    later = np.ones(int(times.sum()), bool)
    later[np.cumsum(times) - times] = False
    pos, common = np.repeat(sa, times), np.repeat(lcp, times)
    common[later] = min_len
    lpf, lnf = factors(pos + later * len(data), common, min_len)
    again = lpf >= min_len if first_stays else (lpf >= min_len) | (lnf >= min_len)
    for of in (False, True):
        hit = np.zeros(len(data) + 1, bool)
        hit[pos[later == of]] = again[later == of]
        mark = hit[at]
        cut = seg[1:] != seg[:-1]
        edge = np.flatnonzero(mark & np.concatenate([[True], ~mark[:-1] | cut]))
        stop = np.flatnonzero(mark & np.concatenate([~mark[1:] | cut, [True]])) + 1
        yield seg[edge], inner[edge], inner[edge] + (stop - edge), of


_RANGES = "later boolean, level int, c1 bigint, c2 bigint, rk binary, s bigint, a bigint, b bigint"


def _matched_windows(min_len: int, first_stays: bool):
    """Over classes ``(k, level, c1, c2, rk, s, n, copies, bytes)`` sorted by block k: ranges of windows to remove, from the segment's start."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        c1, c2 = rows.column(2).to_numpy(), rows.column(3).to_numpy()
        new = np.ones(len(c1), bool)  # a repeated row brings a class again
        new[1:] = (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])
        k, level, c1, c2, rk, s, n, copies, raw = (c.combine_chunks() for c in rows.filter(pa.array(new)).columns)
        data, offs = as_binary(raw)
        key = np.frombuffer(as_binary(k)[0].tobytes(), U64).reshape(-1, 2)
        block = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(1))])
        for seg, a, b, later in _solve(data, np.diff(offs), n.to_numpy(), block, copies.to_numpy() > 1, min_len, first_stays):
            if len(seg):
                of = pa.array(seg)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seg), later)), *(x.take(of) for x in (level, c1, c2, rk, s)), pa.array(a), pa.array(b)], ["later", "level", "c1", "c2", "rk", "s", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.frombuffer(as_binary(batch.column(0))[0].tobytes(), U64).reshape(-1, 2)
            ends = as_binary(batch.column(8))[1]
            edges = (np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()
            if held and (key[0] != last).any():
                edges.insert(0, 0)
            start = 0
            for e in edges:  # where a block begins
                if size + ends[e] - ends[start] >= SORT_BYTES:
                    yield from flush([*held, batch.slice(start, e - start)] if e > start else held)
                    held, size, start = [], 0, e
            held.append(batch.slice(start))
            size += int(ends[-1] - ends[start])
            last = key[-1]
        if held:
            yield from flush(held)

    return run


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def _narrower(width: int, min_len: int, id_type: pa.DataType):
    """Cuts segments ``(id, rk, s, n, r, bytes)`` into ranges of windows by their place r about the minimizer; a range's block is what its windows share."""
    types = [pa.binary(), pa.int64(), pa.int64(), id_type, pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["k", "c1", "c2", "id", "rk", "s", "n", "r", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in types]
            for key, rk, s, n, r, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for q in range(r // width, (r + n - 1) // width + 1):
                    lo, hi = max(r, q * width), min(r + n, (q + 1) * width)
                    # from the last place of the range to the end of its first window: within every one of its windows
                    core = raw[(q + 1) * width - 1 - r : max(0, q * width - r + min_len)]
                    part = raw[lo - r : hi - 1 - r + min_len]
                    k = _digest(q.to_bytes(8, "little", signed=True), core)
                    c = _digest(k, lo.to_bytes(8, "little", signed=True), part)
                    row = (k, int.from_bytes(c[:8], "little", signed=True), int.from_bytes(c[8:], "little", signed=True), key, rk, s + lo - r, hi - lo, lo, part)
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
                if len(out[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
                    out = [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return run


def _fetched(min_len: int):
    """Bytes of the segments listed with each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = as_binary(batch.column(1))
            lists = batch.column(2)
            of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            ids, mh, ch, copies, s, n, split = lists.flatten().flatten()
            s, (off, n) = s.to_numpy(), np.divmod(n.to_numpy(), _OFF)
            block = codes(mh.to_numpy(), np.zeros(len(of), np.int64))
            for i in range(0, len(of), 5000):
                j = slice(i, i + 5000)
                yield pa.RecordBatch.from_arrays(
                    [block.slice(i, 5000), mh.slice(i, 5000), ch.slice(i, 5000), ids.slice(i, 5000), batch.column(0).take(pa.array(of[j])), pa.array(s[j]), pa.array(n[j]), pa.array(-off[j]), copies.slice(i, 5000), split.slice(i, 5000), gathered(data, offs[of[j]] + s[j], n[j] - 1 + min_len)],
                    ["k", "c1", "c2", "id", "rk", "s", "n", "r", "copies", "split", "bytes"],
                )

    return run


def _heavy(counts: DataFrame, size: str, total: int, on: list[str]) -> list[int]:
    """Codes of the keys with over 1/HEAVY of all rows, from a table of counts by key."""
    return [r[0] for r in counts.where(F.col(size) > total / HEAVY).select(F.xxhash64(*on)).collect()]


def _split_marks(classes: DataFrame, block: str) -> DataFrame:
    """``classes`` and whether their block has so many of them that it is split."""
    wide = classes.groupBy(block).agg(F.count("*").alias("kinds")).where(F.col("kinds") > SPLIT_ABOVE).select(block)
    wide = materialize(wide, "wide")
    inside, outside = (classes.join(wide, block, how) for how in ("left_semi", "left_anti"))
    return inside.withColumn("split", F.lit(True)).unionByName(outside.withColumn("split", F.lit(False)))


def repeated_spans(docs: DataFrame, min_len: int, keep: str) -> DataFrame:
    """``(rk, spans)``: for each text of ``docs(rk, id, text)`` with any, ranges of starts of windows to remove."""
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    first_stays = keep == "first"
    spark = docs.sparkSession
    kind = docs.schema["id"].dataType.simpleString()
    id_type = docs.select("id").limit(0).toArrow().schema.field(0).type
    twice = materialize(_repeated_minimizers(docs, min_len), "minimizers")
    segs = materialize(_all_segments(docs, min_len).join(twice, "mh", "left_semi"), "segments")
    classes = segs.groupBy("mh", "ch").agg(F.count("*").alias("copies"), F.min(F.struct("id", "rk", "s", "n")).alias("r"))
    classes = materialize(classes.select("mh", "ch", "copies", "r.id", "r.rk", "r.s", "r.n"), "classes")
    # a table of members of classes for each level, and its heavy classes
    members = [(segs.select(F.col("mh").alias("c1"), F.col("ch").alias("c2"), "rk", "s"), _heavy(classes, "copies", segs.count(), ["mh", "ch"]))]

    # the first of each class brings its bytes
    lists = _split_marks(classes, "mh").select("rk", F.struct("id", "mh", "ch", "copies", "s", "n", "split").alias("x"))
    lists = materialize(lists.groupBy("rk").agg(F.collect_list("x").alias("xs")), "lists")
    schema = f"k binary, c1 bigint, c2 bigint, id {kind}, rk binary, s bigint, n bigint, r bigint, copies bigint, split boolean, bytes binary"
    with prefiltered(spark):
        level = materialize(docs.select("rk", "text").join(lists, "rk").mapInArrow(_fetched(min_len), schema), "representatives")
    names = ["k", "level", "c1", "c2", "id", "rk", "s", "n", "copies", "bytes"]
    blocks = None
    for depth, width in enumerate((*WIDTHS, None)):
        level = level.withColumn("level", F.lit(depth))
        # a class of a block to be split still meets its own copies here, and the other classes in narrower ranges
        own = F.when(F.col("split"), codes_of("c1", "c2")).otherwise(F.col("k"))
        ready = level.where("not split or copies > 1").withColumn("k", own).select(*names)
        blocks = ready if blocks is None else blocks.unionByName(ready)
        cut = level.where("split").select("id", "rk", "s", "n", "r", "bytes")
        if width is None or cut.isEmpty():
            break
        schema = f"k binary, c1 bigint, c2 bigint, id {kind}, rk binary, s bigint, n bigint, r bigint, bytes binary"
        rows = materialize(cut.mapInArrow(_narrower(width, min_len, id_type), schema), "narrow")
        kinds = rows.groupBy("c1", "c2").agg(F.count("*").alias("copies"), F.min(F.struct("id", "rk", "s", "n", "r", "k", "bytes")).alias("f"))
        kinds = materialize(kinds.select("c1", "c2", "copies", "f.*"), "narrow-classes")
        members.append((rows.select("c1", "c2", "rk", "s"), _heavy(kinds, "copies", rows.count(), ["c1", "c2"])))
        level = _split_marks(kinds, "k")
    dealt = blocks.repartition(shuffle_partitions(spark), "k").sortWithinPartitions("k", "id", "rk", "s").select("k", "level", "c1", "c2", "rk", "s", "n", "copies", "bytes")
    found = materialize(dealt.mapInArrow(_matched_windows(min_len, first_stays), _RANGES), "ranges")

    spans = found.where("not later").select("rk", (F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b")).alias("b"))
    for depth, (rows, heavy) in enumerate(members):
        # a later copy matches its first in all windows, so a class has one range here, for all members but the first
        later = found.where(F.col("later") & (F.col("level") == depth)).select("c1", "c2", F.col("rk").alias("first_rk"), F.col("s").alias("first_s"), "a", "b")
        others = join_unique(rows, later, ["c1", "c2"], heavy=heavy).where((F.col("rk") != F.col("first_rk")) | (F.col("s") != F.col("first_s")))
        spans = spans.unionByName(others.select("rk", (F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b")).alias("b")))
    return materialize(spans.groupBy("rk").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")


def codes_of(*columns: str) -> Column:
    """The columns' 64-bit values side by side, as bytes."""
    return F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in columns]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 200, keep: str = "first", with_text: bool = True) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` of every row; kept (if with_text) holds the remaining bytes where any were removed, else null.

    Texts are UTF-8 bytes; null is empty.  A byte goes if it lies in a string of min_len bytes that
    occurs earlier (keep="first": in order of id, then place) or anywhere else (keep="none"), in
    this text or another, judged on the input.  Matches never cross texts; texts shorter than
    min_len are untouched.  Rows with equal ids are told apart by text; fully repeated rows are
    copies of each other, and with keep="first" all of them keep what the first keeps.  Null ids
    sort first.  Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(row_key(F.col(id_col), text).alias("rk"), F.col(id_col).alias("id"), text.alias("text"))
    spans = repeated_spans(rows, min_len, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = as_binary(batch.column(1))
            out: list[list] = [[] for _ in range(5)]
            for i, (rk, xs) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                raw = data[offs[i] : offs[i + 1]]
                x = xs.values.flatten()
                depth = np.zeros(len(raw) + 1, np.int64)
                np.add.at(depth, x[0].to_numpy(), 1)
                np.add.at(depth, x[1].to_numpy() - 1 + min_len, -1)
                gone = np.cumsum(depth[:-1]) > 0
                left = raw[~gone].tobytes()
                row = (rk, int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(left).hexdigest(), left)
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())], ["rk", "n_removed", "n_spans", "kept_sha256", "kept"])

    with prefiltered(docs.sparkSession):
        changed = rows.select("rk", "text").join(spans, "rk").mapInArrow(run, "rk binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
        changed = materialize(changed if with_text else changed.drop("kept"), "changed").dropDuplicates(["rk"])
    base = rows.select("rk", "id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text"), 256).alias("sha"))
    zero = F.lit(0).cast("long")
    out = base.join(changed, "rk", "left").select("id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *(["kept"] if with_text else []))
    return out


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), keep="none", with_text=False)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
