"""Word shingles of whole texts as 64-bit hashes, vectorised over Arrow batches.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.
A text of any length is walked in pieces, so memory does not follow the longest word.
"""

from __future__ import annotations

import numpy as np

from wiretide.llm.common import U64, fmix

PIECE = 1 << 20
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT = [U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3), U64(0x589965CC75374CC3)]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of each text, and the number of words of each text.

    data, offsets: concatenated UTF-8 bytes and where each text starts (one more at the end).  A
    word's hash mixes the sum of mixed (place, byte) values: no structure of a word, as a
    polynomial's has, makes different words collide other than by chance.
    """
    n = len(data)
    hashes, starts = [], []
    open_at, open_sum = -1, U64(0)  # a word that began in an earlier piece
    bounds = offsets[1:-1]
    for a in range(0, n, PIECE):
        b = min(n, a + PIECE)
        raw = _LOWER[data[a:b]]
        word = ~_WS[raw]
        lo, hi = np.searchsorted(bounds, [a, b])
        cut = np.zeros(b - a, bool)  # a text starts here
        cut[bounds[lo:hi] - a] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | cut[1:]
        s = np.flatnonzero(begins)
        at = s + a
        inside = np.flatnonzero(word)
        goes_on = open_at >= 0 and bool(word[0]) and not cut[0]
        if goes_on:
            at[0] = open_at
        elif open_at >= 0:
            hashes.append(np.array([open_sum], U64))
            starts.append(np.array([open_at]))
        if not len(s):
            open_at = -1
            continue
        place = (inside + a - at[np.cumsum(begins)[inside] - 1]).astype(U64)
        total = np.add.reduceat(fmix((place << U64(8) | raw[inside].astype(U64)) + U64(0x9E3779B97F4A7C15)), np.searchsorted(inside, s))
        if goes_on:
            total[:1] += open_sum
        open_at = -1
        if word[-1] and b < n and not (hi < len(bounds) and bounds[hi] == b):
            open_at, open_sum = int(at[-1]), total[-1]
            at, total = at[:-1], total[:-1]
        hashes.append(total)
        starts.append(at)
    if not hashes:
        return np.zeros(0, U64), np.zeros(len(offsets) - 1, np.int64)
    counts = np.diff(np.searchsorted(np.concatenate(starts), offsets))
    return fmix(np.concatenate(hashes)), counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text its sorted distinct hashes of k-word shingles; the whole sequence where it has fewer words."""
    words, counts = word_hashes(data, offsets)
    first = np.concatenate([[0], np.cumsum(counts)])
    if len(words) >= k:
        m = len(words) - k + 1
        mixed = np.zeros(m, U64)
        for j in range(k):
            mixed += words[j : j + m] * _MULT[j % len(_MULT)] * U64(2 * (j // len(_MULT)) + 1)
        mixed = fmix(mixed)
    out = []
    for i, c in enumerate(counts):
        a = first[i]
        if c >= k:
            out.append(_distinct(mixed[a : a + c - k + 1]))
        elif c:
            acc = U64(c)
            with np.errstate(over="ignore"):
                for j in range(c):
                    acc = acc * _MULT[0] + words[a + j] * _MULT[j % len(_MULT)]
            out.append(fmix(np.array([acc], U64) ^ U64(0x5BF03635)))
        else:
            out.append(np.zeros(0, U64))
    return out


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, 2) of 64 bits: a 128-bit identity of each set, zero for empty ones."""
    size = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), 2), U64)
    full = np.flatnonzero(size)
    if len(full):
        flat = np.concatenate(sets)
        first = (np.cumsum(size) - size)[full]
        for i, seed in enumerate((U64(0xABCDEF12345), U64(0x3C6EF372FE94F82A))):
            out[full, i] = fmix(np.add.reduceat(fmix(flat ^ seed), first) + size[full].astype(U64) * U64(0x9E3779B97F4A7C15))
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    if len(x) > 1:
        keep = np.empty(len(x), bool)
        keep[0] = True
        np.not_equal(x[1:], x[:-1], out=keep[1:])
        x = x[keep]
    return x
