"""Tokenizer calls for Arrow batches: whole texts, split at safe boundaries, each distinct part encoded once.

A safe boundary lies before a single space whose neighbours are both visible: the tokenizers used
here end a pre-token there, so the parts' ids, joined, are the text's ids.  Long texts thus never
reach the library whole, batches are cut by bytes, and parts that repeat are looked up.

For tokenizers of the form WORDS, which drop whitespace and lower-case, parts are folded before they
are told apart and also end before a full stop or comma; parts that are one word of letters go to
the library's model many at once, split at spaces alone, as nothing is left to normalise in them.

For tokenizers of the form RUNS parts end wherever letters, digits, other marks and whitespace meet,
so one word is one part whatever stands around it; words behind a space go to the model in the same way.
"""

from __future__ import annotations

import json
import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa

from wiretide.llm.common import as_binary, give_back

#: Bytes of text in one batch of calls.
BATCH_BYTES = 8 << 20
#: Distinct parts that a worker remembers; beyond them it starts afresh.
REMEMBERED = 600_000
#: The same, where parts are folded: there are fewer forms, and new ones cost less.
REMEMBERED_FOLDED = 300_000
#: Parts longer than this are encoded but not remembered.
LONG_PART = 64
#: Ids that a worker holds, those of long parts too; beyond them it starts afresh.
HELD_IDS = 8_000_000

#: Normaliser and pre-tokeniser of tokenizers whose parts may be folded.
WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
#: The same of tokenizers whose pre-tokens are runs of letters, digits or other marks, with the space before them.
RUNS = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
#: Words that go to the model in one text.
JOINED = 256

_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_SPACE, _LETTER, _STOP = (np.isin(np.arange(256), list(x)) for x in (b"\t\n\r", b"abcdefghijklmnopqrstuvwxyz", b".,"))
#: A word of a-z and the lower-case letters U+00DF-U+00FF.
_WORD = re.compile(rb" ?(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: A space and letters A-Z, a-z or U+00C0-U+00FF.
_SPACED = re.compile(rb" (?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: What a special string must not be, or it might be in a word.
_LETTERS = re.compile(r"[\sA-Za-z\u00c0-\u00ff]*")
#: Kinds of ASCII bytes, in order: others, letters, digits, other visible ones, space, tab and line ends.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
_KIND[0x20] = 4
_KIND[[0x09, 0x0A, 0x0D]] = 5
_MEMORY: dict[tuple[str, bool], PartEncoder] = {}


def folded(data: np.ndarray, special: list[bytes]) -> np.ndarray:
    """A copy with A-Z and U+00C0-U+00DE in lower case and tabs and line ends as spaces.

    A letter whose next byte might begin a combining mark stays: composed first, it may have another
    lower case.  What only folding would turn into a special string stays as well.
    """
    out = data.copy()
    out[_SPACE[data]] = 0x20
    upper = (data >= 0x41) & (data <= 0x5A)
    upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    upper[:-1] &= (data[1:] < 0x80) | (data[1:] == 0xC3)
    out[upper] += 0x20
    text, raw = out.tobytes(), memoryview(data)
    for s in special:
        at = text.find(s)
        while at >= 0:
            if raw[at : at + len(s)] != s:
                out[at : at + len(s)] = data[at : at + len(s)]
            at = text.find(s, at + 1)
    return out


def cut_points(data: np.ndarray, offsets: np.ndarray, stops: bool = False) -> np.ndarray:
    """Starts of parts: every text's start, every safe boundary, and the end.  stops: also before a stop or comma after a-z."""
    mark = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        space = np.flatnonzero(data[1:-1] == 0x20) + 1
        before, after = data[space - 1], data[space + 1]
        # letters U+00C0-U+00FF are two bytes, the first 0xC3; other bytes above 0x7F might belong to a Unicode space
        ok = (_VISIBLE[before] | ((before >= 0x80) & (data[space - 2] == 0xC3))) & (_VISIBLE[after] | (after == 0xC3))
        mark[space[ok]] = True
    if stops and len(data):
        mark[1:-1] |= _STOP[data[1:]] & _LETTER[data[:-1]]
    mark[offsets] = True
    return np.flatnonzero(mark)


def run_cuts(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Starts of parts of the form RUNS: every text's start, most changes of kind, and the end.

    A part doesn't end where the library's pattern may go on: between an apostrophe and a letter,
    after a space, within whitespace (a tab or line end alone is a part), beside characters
    other than ASCII and the letters U+00C0-U+00FF, nor in a special string.
    """
    mark = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        end = _KIND[data]
        start = end.copy()
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        start[lead] = end[lead + 1] = 1
        seen = (end > 0) & (end < 4)
        before, after = end[:-1], start[1:]
        mark[1:-1] = seen[:-1] & (after > 0) & (before != after) & ~((data[:-1] == 0x27) & (after == 1))
        mark[2:-1] |= seen[:-2] & (before[1:] == 5) & (after[1:] > 0) & (after[1:] < 4)
        text = data.tobytes()
        for s in special:
            at = text.find(s)
            while at >= 0:
                mark[at + 1 : at + len(s)] = False
                at = text.find(s, at + 1)
    mark[offsets] = True
    return np.flatnonzero(mark)


class PartEncoder:
    """Ids or numbers of ids of parts, remembered within a Python worker."""

    def __init__(self, path: str, with_ids: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: Tokenizer of joined words, what they look like, and the ids that end (folded) or else begin a word.
        self.words = self.word = self.edges = None
        form = json.loads(self.tokenizer.to_str())
        added, model = form["added_tokens"], form["model"]
        letters = set(pre_tokenizers.ByteLevel.alphabet())
        form_of = (form["normalizer"], form["pre_tokenizer"])
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        plain = model["type"] == "BPE" and not model["dropout"] and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or _LETTERS.fullmatch(t["content"]) for t in added)
        self.folds = plain and form_of == WORDS and model["end_of_word_suffix"] == "</w>" and {c + "</w>" for c in letters} <= model["vocab"].keys()
        self.runs = plain and form_of == RUNS and not model["end_of_word_suffix"] and not model["continuing_subword_prefix"] and letters <= model["vocab"].keys()
        if self.folds or self.runs:
            self.words = Tokenizer(self.tokenizer.model)
            # a space is written as U+0120 in the bytes' alphabet
            steps = [pre_tokenizers.WhitespaceSplit(), bytewise] if self.folds else [bytewise, pre_tokenizers.Split("\u0120", "merged_with_next")]
            self.words.pre_tokenizer = pre_tokenizers.Sequence(steps)
            self.word = _WORD if self.folds else _SPACED
            self.edges = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.edges[[i for t, i in model["vocab"].items() if (t.endswith("</w>") if self.folds else t.startswith("\u0120"))]] = True
        self.special = [t["content"].encode() for t in added]
        del form, model
        give_back()
        self.with_ids = with_ids
        self.forget()

    @staticmethod
    def get(path: str, with_ids: bool) -> PartEncoder:
        if (path, with_ids) not in _MEMORY:
            _MEMORY[path, with_ids] = PartEncoder(path, with_ids)
        return _MEMORY[path, with_ids]

    def forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.count = np.zeros(1024, np.int32)
        self.start = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)
        self.n = self.used = 0

    def _add_words(self, words: list[bytes]) -> None:
        """Words of letters, JOINED to a text; an id that ends or begins a word tells them apart."""
        joint = b" " if self.folds else b""
        lines = [joint.join(words[i : i + JOINED]).decode() for i in range(0, len(words), JOINED)]
        for i in range(0, len(lines), 64):
            ids = np.concatenate([np.array(g.ids, np.uint32) for g in self.words.encode_batch_fast(lines[i : i + 64], add_special_tokens=False)])
            last = self.edges[ids]
            if self.runs:
                first, last = last[0], np.append(last[1:], True)
            count = np.diff(np.flatnonzero(last), prepend=-1)
            if len(count) != min(len(words) - i * JOINED, 64 * JOINED) or not last[-1] or self.runs and not first:
                raise ValueError("the model's ids don't tell where words end")
            self._keep(count.astype(np.int32), ids)

    def _keep(self, count: np.ndarray, ids: np.ndarray) -> None:
        self.count = _room(self.count, self.n + len(count))
        self.count[self.n : self.n + len(count)] = count
        if self.with_ids:
            self.start = _room(self.start, self.n + len(count))
            self.ids = _room(self.ids, self.used + len(ids))
            self.start[self.n : self.n + len(count)] = self.used + np.cumsum(count) - count
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        self.n += len(count)

    def _add_parts(self, parts: list[bytes]) -> None:
        for i in range(0, len(parts), 8192):
            got = self.tokenizer.encode_batch_fast([p.decode() for p in parts[i : i + 8192]], add_special_tokens=False)
            count = np.fromiter((len(g) for g in got), np.int32, len(got))
            self._keep(count, np.fromiter((x for g in got for x in g.ids), np.uint32, int(count.sum())) if self.with_ids else count[:0])

    def lookup(self, parts: list[bytes]) -> np.ndarray:
        """Slots of distinct parts."""
        if self.n > (REMEMBERED_FOLDED if self.folds else REMEMBERED) or self.used > HELD_IDS:
            self.forget()
        at = self.at
        slot = np.fromiter(map(at.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(slot < 0)
        if len(new):
            if self.words is not None:
                word = np.fromiter((self.word.fullmatch(parts[i]) is not None for i in new.tolist()), bool, len(new))
                new, words = np.concatenate([new[~word], new[word]]), int(word.sum())
            else:
                words = 0
            slot[new] = self.n + np.arange(len(new))
            fresh = [parts[i] for i in new.tolist()]
            self._add_parts(fresh[: len(fresh) - words])
            self._add_words(fresh[len(fresh) - words :])
            at.update((p, s) for p, s in zip(fresh, slot[new].tolist(), strict=True) if len(p) <= LONG_PART)
        return slot


def _room(x: np.ndarray, n: int) -> np.ndarray:
    if n <= len(x):
        return x
    out = np.zeros(max(n, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


def _by_bytes(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of texts of about BATCH_BYTES each; a longer text is alone."""
    out, a = [], 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BATCH_BYTES, "right")) - 1)
        out.append((a, b))
        a = b
    return out


def _slots(data: np.ndarray, offsets: np.ndarray, enc: PartEncoder) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each part, first part of each text and one more at the end)."""
    if enc.folds:
        data = folded(data, enc.special)
    cuts = run_cuts(data, offsets, enc.special) if enc.runs else cut_points(data, offsets, enc.folds)
    n = len(cuts) - 1
    parts = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
    coded = parts.dictionary_encode()
    # to_pylist would make an Arrow scalar of each part first
    slot = enc.lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
    return slot, np.searchsorted(cuts, offsets)


def token_counts(texts: pa.Array, path: str) -> np.ndarray:
    """Number of ids of each text, without special tokens added."""
    data, offsets = as_binary(texts)
    enc = PartEncoder.get(path, False)
    out = [np.zeros(0, np.int64)]
    for a, b in _by_bytes(offsets):
        o = offsets[a : b + 1] - offsets[a]
        total = np.zeros(b - a, np.int64)
        for lo, hi in _pieces(data[offsets[a] : offsets[b]], o):
            piece = data[offsets[a] + lo : offsets[a] + hi]
            po = np.clip(o, lo, hi) - lo
            slot, first = _slots(piece, po, enc)
            run = np.concatenate([[0], np.cumsum(enc.count[slot], dtype=np.int64)])
            total += np.diff(run[first])
        out.append(total)
    return np.concatenate(out)


def token_ids(texts: pa.Array, path: str):
    """Yields (index of the first text, ids of some texts joined, their offsets)."""
    data, offsets = as_binary(texts)
    enc = PartEncoder.get(path, True)
    for a, b in _by_bytes(offsets):
        o = offsets[a : b + 1] - offsets[a]
        ids, total = [], np.zeros(b - a, np.int64)
        for lo, hi in _pieces(data[offsets[a] : offsets[b]], o):
            po = np.clip(o, lo, hi) - lo
            slot, first = _slots(data[offsets[a] + lo : offsets[a] + hi], po, enc)
            count = enc.count[slot].astype(np.int64)
            run = np.concatenate([[0], np.cumsum(count)])
            total += np.diff(run[first])
            ids.append(enc.ids[np.repeat(enc.start[slot] - run[:-1], count) + np.arange(run[-1])])
        yield a, np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(total)])


def _pieces(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of at most about BATCH_BYTES that end at a text's end or a safe boundary."""
    if len(data) <= 2 * BATCH_BYTES:
        return [(0, len(data))]
    cuts = cut_points(data, offsets)
    out, lo = [], 0
    while lo < len(data):
        k = int(np.searchsorted(cuts, lo + BATCH_BYTES, "right")) - 1
        hi = int(cuts[k]) if cuts[k] > lo else int(cuts[min(k + 1, len(cuts) - 1)])
        out.append((lo, hi))
        lo = hi
    return out
