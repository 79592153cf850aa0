"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram's vector is the product (binding) of its
letters' vectors, each rotated by the letter's place; a document's vector is the sum (bundle) of
its n-grams' vectors; a language's prototype is the sum of its training documents' unit vectors.
Documents are compared with prototypes by cosine, after the mean of all prototypes is removed
from both, since what all languages share says nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.llm.common import as_binary, materialize, table, tidied

DIMENSIONS = 1024
#: Training documents for each language, in expectation; more are not needed for a prototype.
TRAIN_PER_LANGUAGE = 4000
#: Bytes of text, and texts, handled at once; a longer text is walked in pieces.
CHUNK, TEXTS = 1 << 19, 1024
#: n-grams whose vectors exist at once, and texts counted against them.
GRAM_BLOCK, TEXT_BLOCK = 2048, 1024
_FOLD: np.ndarray | None = None
_VECTORS: dict[tuple[int, int], np.ndarray] = {}


def _fold_table() -> np.ndarray:
    """For each code point: its lower-case letter, or 0 if it is no letter."""
    global _FOLD
    if _FOLD is None:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _FOLD = out
    return _FOLD


def _letter_vector(code: int, dims: int) -> np.ndarray:
    if (code, dims) not in _VECTORS:
        _VECTORS[code, dims] = np.random.default_rng([code, dims, 6]).integers(0, 2, dims, dtype=np.int8) * 2 - 1
    return _VECTORS[code, dims]


def _collapse(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of non-letters of a text count as one blank."""
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (doc[1:] != doc[:-1])
    return codes[keep], doc[keep]


def _grams(codes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram of each place, its document, letters of each gram)."""
    letters = np.flatnonzero(np.bincount(codes, minlength=1))
    index = np.zeros(int(letters[-1]) + 1 if len(letters) else 1, np.int64)
    index[letters] = np.arange(len(letters))
    small = index[codes]
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, n), np.int64)
    key = np.zeros(m, np.int64)
    for j in range(n):
        key = key * len(letters) + small[j : j + m]
    inside = doc[n - 1 :] == doc[:m]
    key, doc = key[inside], doc[:m][inside]
    if len(letters) ** n <= 1 << 22:
        used = np.flatnonzero(np.bincount(key, minlength=1))
        back = np.zeros(len(letters) ** n, np.int64)
        back[used] = np.arange(len(used))
        gram = back[key]
    else:
        used, gram = np.unique(key, return_inverse=True)
    digits = np.stack([used // len(letters) ** (n - 1 - j) % len(letters) for j in range(n)], 1) if len(used) else np.zeros((0, n), np.int64)
    return gram, doc, letters[digits]


def _bound(letters: np.ndarray, dims: int) -> np.ndarray:
    """Vectors of n-grams: the product of their letters' vectors, each rotated by its place."""
    n = letters.shape[1]
    out = np.ones((len(letters), dims), np.int8)
    for j in range(n):
        codes, where = np.unique(letters[:, j], return_inverse=True)
        out *= np.stack([np.roll(_letter_vector(int(c), dims), n - 1 - j) for c in codes])[where]
    return out.astype(np.float32)


def _bundle(out: np.ndarray, codes: np.ndarray, doc: np.ndarray, n: int) -> None:
    """Adds to each row of ``out`` the vectors of its document's n-grams, a block of n-grams at a time."""
    gram, of, letters = _grams(codes, doc, n)
    order = np.argsort((gram // GRAM_BLOCK).astype(np.uint16), kind="stable")
    gram, of = gram[order], of[order]
    edges = np.searchsorted(gram // GRAM_BLOCK, np.arange(-(-len(letters) // GRAM_BLOCK) + 1))
    for g, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        first = g * GRAM_BLOCK
        bound = _bound(letters[first : first + GRAM_BLOCK], out.shape[1])
        gb, ob, width = gram[s:e] - first, of[s:e], len(bound)
        texts = ob[np.concatenate([[True], ob[1:] != ob[:-1]])]
        for t in range(0, len(texts), TEXT_BLOCK):
            here = texts[t : t + TEXT_BLOCK]
            p, q = np.searchsorted(ob, [here[0], here[-1] + 1])
            if (q - p) * 32 >= len(here) * width:
                row = np.searchsorted(here, ob[p:q])
                counts = np.bincount(row * width + gb[p:q], minlength=len(here) * width).reshape(len(here), width)
                out[here] += counts.astype(np.float32) @ bound
            else:  # few n-grams in each text: their vectors are added one by one
                for c in range(p, q, 4096):
                    o = ob[c : min(q, c + 4096)]
                    start = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
                    out[o[start]] += np.add.reduceat(bound[gb[c : c + len(o)]], start)


def document_vectors(texts: pa.Array, n: int = 3, dims: int = DIMENSIONS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first text, bundles of some texts, whether each has a letter).  A blank stands before and after each text."""
    data, offsets = as_binary(texts)
    a = 0
    fold = _fold_table()
    while a < len(offsets) - 1:
        b = min(a + TEXTS, max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1))
        out = np.zeros((b - a, dims), np.float32)
        has = np.zeros(b - a, bool)
        lo, end = int(offsets[a]), int(offsets[b])
        tail = np.zeros(1, np.uint32)
        while lo < end:
            hi = min(end, lo + CHUNK) if b - a == 1 else end
            while hi < end and data[hi] & 0xC0 == 0x80:
                hi += 1
            raw = data[lo:hi]
            codes = fold[np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
            if b - a == 1:  # the last letters of a piece go before the next, so no n-gram is lost or made up at a cut
                has[0] |= bool(codes.any())
                codes = np.concatenate([tail, codes, np.zeros(int(hi == end), np.uint32)])
                codes, doc = _collapse(codes, np.zeros(len(codes), np.int64))
                tail = codes[len(codes) - n + 1 :] if len(codes) >= n else codes
            else:
                at = np.flatnonzero((raw & 0xC0) != 0x80) + lo
                doc = np.searchsorted(offsets[a : b + 1], at, "right") - 1
                has |= np.bincount(doc[codes > 0], minlength=b - a) > 0
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                codes, doc = np.insert(codes, first, 0), np.insert(doc, first, doc[first])
                last = np.flatnonzero(np.diff(doc, append=b - a)) + 1
                codes, doc = _collapse(np.insert(codes, last, 0), np.insert(doc, last, doc[last - 1]))
            _bundle(out, codes, doc, n)
            lo = hi
        yield a, out, has
        a = b


def _units(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def train_prototypes(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, per_language: int = TRAIN_PER_LANGUAGE, n: int = 3, dims: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototype of each language: sums are made in tasks and by lang; one vector a language reaches the driver.

    At most about ``per_language`` documents of a language are used, chosen by a hash of id and
    text.  Every value of lang is a language, however many there are; what is gathered, and sent to
    tasks, is ``dims`` numbers for each.  Rows without lang or text teach nothing; an empty table
    gives no prototypes.
    """
    rows = labelled.where(F.col(lang_col).isNotNull())
    # stored, so its size is known before texts are read: the few rows are broadcast by Spark's own rule
    per = materialize(rows.groupBy(F.col(lang_col).alias("_lang")).agg(F.count("*").alias("_count")), "languages")
    share = F.pmod(F.xxhash64(F.lit(5), F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / float(1 << 30)
    taught = rows.where(F.col(text_col).isNotNull()).withColumn("_share", share).join(per, F.col(lang_col) == F.col("_lang"))
    picked = taught.where(F.col("_share") < per_language / F.col("_count"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column(1).to_pylist(), object)
            for at, x, _ in document_vectors(batch.column(0), n, dims):
                unit = _units(x)
                here = lang[at : at + len(unit)]
                for name in set(here.tolist()):
                    total[name] = total.get(name, 0) + unit[here == name].sum(0)
        if total:
            name = [k for k in total for _ in range(dims)]
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(total))), pa.array(np.concatenate(list(total.values())))], ["lang", "place", "value"])

    parts = picked.select(text_col, lang_col).mapInArrow(tidied(run), "lang string, place int, value double")
    sums = parts.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():  # dims rows for each language
        out.setdefault(r["lang"], np.zeros(dims))[r["place"]] = r["value"]
    return dict(sorted(out.items()))


def predict_language(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", n: int = 3, dims: int = DIMENSIONS) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (cosine with the chosen prototype, 0 to 1) added.

    Null text and text without letters, or with no prototypes given, is ``und`` with score 0.
    Ties go to the language that comes first by code point.  Whole texts count, of any length;
    repeated rows are predicted alike, and an empty table stays empty.  Columns of docs named
    lang_pred or score are replaced; others are carried.
    """
    names = list(prototypes)
    proto = _units(np.array([prototypes[k] for k in names])) if names else np.zeros((0, dims))
    centre = proto.mean(0) if len(names) > 1 else np.zeros(dims)
    basis = _units(proto - centre)
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    cols = [f.name for f in kept]
    place = cols.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for at, x, has in document_vectors(batch.column(place).cast(pa.string()), n, dims):
                if not names:
                    continue
                cos = _units(_units(x) - centre) @ basis.T
                best = cos.argmax(1)
                for i in np.flatnonzero(has):
                    lang[at + i] = names[best[i]]
                    score[at + i] = min(1.0, max(0.0, float(cos[i, best[i]])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*cols, "lang_pred", "score"])

    schema = docs.select(*cols).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*cols).mapInArrow(tidied(run), schema)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """Learns prototypes from rows outside the held-out fold and predicts every row."""
    prototypes = train_prototypes(docs.where(~held_out(id_col)), text_col, lang_col, id_col)
    base = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"), *keep)
    return predict_language(base, prototypes)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")
