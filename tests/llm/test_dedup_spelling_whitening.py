"""Exact dedup, spelling variants and whitening against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wiretide.llm import exact_dedup
from wiretide.llm.exact_dedup import build_slots, exact_duplicates, find_slots
from wiretide.llm.queries import QUERIES
from wiretide.llm.spelling import spelling_variants, words_of
from wiretide.llm.whitening import below, top_components, tridiagonal, whiten

SCHEMA = "doc_id long, text string, digest string, id string, bucket int, word string, n string, row string"
EXTRA = ("x", "y", 1, "z", "m", "r")


def docs_of(spark, pairs):
    return spark.createDataFrame([(d, t, *EXTRA) for d, t in pairs], SCHEMA).repartition(3)


# --- exact dedup --------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_minimal_perfect_hash(n):
    raw = np.frombuffer(b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(n)), np.uint8)
    sizes, bits, slots = build_slots(raw)
    assert sorted(slots.tolist()) == list(range(n))  # minimal and perfect
    assert find_slots(raw, sizes, bits).tolist() == slots.tolist()
    other = np.frombuffer(b"".join(hashlib.sha256(b"x%d" % i).digest() for i in range(200)), np.uint8)
    assert ((found := find_slots(other, sizes, bits)) < max(n, 1)).all() and (found >= -1).all()


def test_repeated_digests_are_an_error():
    with pytest.raises(ValueError, match="distinct"):
        build_slots(np.zeros(64, np.uint8))


DEDUP = [(1, "a b"), (2, "a  b"), (3, "a\t\nb"), (4, " a b"), (5, None), (6, ""), (7, " "), (8, "\n\n"), (9, "z" * 200_000), (10, "z" * 200_000), (11, "a b"), (12, "a b"), (12, "a b"), (13, "only"), (None, "only"), (None, "nobody"), (None, "nobody"), *[(20 + i, "hot text") for i in range(60)], *[(100 + i, f"text {i}") for i in range(40)]]


@pytest.mark.parametrize(("bucket", "history"), [(1024, None), (4, None), (4, "id % 3 = 0"), (4, "false"), (1, "id > 50")])
def test_exact_duplicates(spark, monkeypatch, bucket, history):
    monkeypatch.setattr(exact_dedup, "BUCKET", bucket)
    groups = defaultdict(list)
    for d, t in DEDUP:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    got = exact_duplicates(docs_of(spark, DEDUP), "doc_id", "text", history and F.expr(history)).collect()
    want = Counter()
    for t, ids in groups.items():
        ids = sorted(ids, key=lambda d: (d is None, d or 0))
        for k, d in enumerate(ids):
            want[(d, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(map(tuple, got)) == want


def test_exact_duplicates_of_nothing(spark):
    out = exact_duplicates(docs_of(spark, []), "doc_id", "text")
    assert out.columns == ["id", "keep_id", "group_size", "kept", "text_sha256"] and not out.collect()
    assert [tuple(r)[:4] for r in exact_duplicates(docs_of(spark, [(None, None)]), "doc_id", "text").collect()] == [(None, None, 1, True)]


# --- spelling variants --------------------------------------------------------------------------


def variants(words, ratio):
    near, alike = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            if (d := w[:i] + w[i + 1 :]) in words:
                near[w].add(d)
                near[d].add(w)
            alike[w[:i], w[i + 1 :]].add(w)
    for same in alike.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w, n in words.items():
        if near[w] and words[best := min(near[w], key=lambda x: (-words[x], x))] >= ratio * n:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w, "-"), root(w), n, len(near[w]), words.get(form.get(w), -1)) for w, n in words.items())


def rows_of(out):
    return sorted((r.word, r.form or "-", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in out.collect())


@pytest.mark.parametrize(("alphabet", "long_from"), [("ab", 64), ("ab", 3), ("aé\U0001d49c", 1), ("abcdefgh", 5)])
def test_variants_of_all_lengths(spark, alphabet, long_from):
    rng = random.Random(len(alphabet))
    words = {"".join(rng.choices(alphabet, k=rng.randint(1, 7))): rng.choice([1, 1, 2, 10, 10, 100, 1000]) for _ in range(150)}
    given = spark.createDataFrame([(w, n, "x", 0, 1) for w, n in [*words.items(), (None, 5), ("", 7)]], "word string, n int, id string, near int, key int").repartition(3)
    assert rows_of(spelling_variants(given, 10, long_from)) == variants(words, 10)


def test_variants_of_long_words(spark):
    long = "".join(random.Random(1).choices("abc", k=30_000))
    words = {long: 50, long[:100] + "é" + long[100:]: 5, long[:-1]: 500, "x" + long[1:]: 1, "a" * 65: 3, "a" * 64: 30, "a" * 63: 300, "a" * 40 + "b" + "a" * 23: 3}
    given = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling_variants(given)) == variants(words, 10)


def test_variants_of_nothing(spark):
    assert rows_of(spelling_variants(spark.createDataFrame([], "word string, n long"))) == []


def test_words(spark):
    rng = random.Random(3)
    base = ["Tiefgang", "tiefgang", "Größe", "größenwahn", "Ärmelkanal", "Zürichsee", "naïveté", "ab", "x" * 500, "übermorgen", "ßßßßßßß"]
    pairs = [(None if i == 7 else i, rng.choice(" ,1_中\n").join(rng.choices(base, k=30))) for i in range(40)] + [(90, None), (91, ""), (92, "1 2 3")]
    want = Counter()
    for d, t in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 5 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] += 1
    got = words_of(docs_of(spark, pairs), "doc_id", "text", 5, 7).collect()
    assert {r.word: r.n for r in got} == dict(want)


# --- whitening ----------------------------------------------------------------------------------


def covariances():
    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 8, 64):
        x = rng.standard_normal((5 * d + 3, d)) * rng.uniform(0.1, 50, d)
        yield (x - x.mean(0)).T @ (x - x.mean(0)) / len(x)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    yield np.eye(20)
    yield np.diag([5.0] * 20 + [1.0] * 10)
    yield np.outer(np.arange(9.0), np.arange(9.0))
    yield q @ np.diag(np.r_[1e6, 1e6 * (1 - 1e-9), 10, 9, 8, 7, 6, 5, 4.9999999, 4.9999998, np.linspace(0, 1, 30)]) @ q.T
    yield q @ np.diag(10.0 ** -np.arange(40.0)) @ q.T


@pytest.mark.parametrize("v", list(covariances()), ids=lambda v: str(len(v)))
def test_contour_finds_the_top(v):
    v = (v + v.T) / 2
    e, q = top_components(v, 8)
    want = np.linalg.eigvalsh(v)[::-1]
    assert len(e) == min(8, int((want > 1e-13 * want[0]).sum()))
    assert np.abs(e - want[: len(e)]).max() < 1e-13 * want[0]
    assert np.abs(v @ q - q * e).max() < 1e-13 * want[0] and np.abs(q.T @ q - np.eye(len(e))).max() < 1e-13
    d, o = tridiagonal(v)
    for s in (want[0] + 1, want.mean() + 1e-3, want[-1] - 1):
        assert below(d, o, s) == (want < s).sum()


VECTORS = "vec_id long, embedding array<float>, label int, id string, w string, deviation int"


def vectors_of(spark, pairs):
    return spark.createDataFrame([(i, v, 1, "x", "y", 2) for i, v in pairs], VECTORS).repartition(3)


def by_hand(pairs, dim):
    kept = [(i, v) for i, v in pairs if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) and abs(c) < 1e6 for c in v)]
    x = np.array([np.floor(1024 * np.float32(v).astype(float)) for _, v in kept]).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    mid = x - s / n
    e, q = np.linalg.eigh(mid.T @ mid / n)
    k = min(8, dim)
    e, q = e[::-1], q[:, ::-1][:, :k]
    return kept, n, ((n * x - s) ** 2).sum(1), mid @ q / np.sqrt(e[:k]), e[:k] / e.sum()


@pytest.mark.parametrize("dim", [1, 3, 12])
def test_whitening(spark, dim):
    rng = np.random.default_rng(dim)
    axes = rng.standard_normal((dim, dim)) * np.linspace(1, 3, dim)
    pairs = [(i, (rng.standard_normal(dim) @ axes).tolist()) for i in range(80)]
    odd = [(100, None), (101, []), (102, [None] * dim), (103, [float("nan")] * dim), (104, [float("inf")] * dim), (105, [1.0] * (dim + 1)), (106, [3e38] * dim), (107, [0.0] * dim), (3, pairs[3][1]), (None, pairs[5][1]), (108, [-0.5] * dim)]
    kept, n, deviation, want, explained = by_hand(pairs + odd, dim)
    out = whiten(vectors_of(spark, pairs + odd)).collect()
    assert Counter(r.id for r in out) == Counter(i for i, _ in kept for _ in range(want.shape[1]))
    assert {r.n for r in out} == {n} and max(r.identity_error for r in out) < 1e-10
    for c in range(want.shape[1]):
        got = sorted((-1 if r.id is None else r.id, r.deviation, r.whitened) for r in out if r.component == c + 1)
        hand = [(-1 if i is None else i, int(d), w) for (i, _), d, w in zip(kept, deviation, want[:, c], strict=True)]
        same, turned = sorted(hand), sorted((i, d, -w) for i, d, w in hand)
        assert [g[:2] for g in got] == [w[:2] for w in same]
        assert any(np.allclose([g[2] for g in got], [w[2] for w in x], atol=1e-9) for x in (same, turned))
        assert all(abs(r.explained / explained[c] - 1) < 1e-9 for r in out if r.component == c + 1)


def test_whitening_without_variance(spark):
    for pairs in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]):
        out = whiten(vectors_of(spark, pairs))
        assert out.columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and not out.collect()
    line = whiten(vectors_of(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])).collect()
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line)


def test_deviation_beyond_64_bits(spark):
    far = [(i, [9e8 * (-1) ** i, 0.0]) for i in range(6)] + [(10 + i, [0.0, float(i)]) for i in range(6)]
    x = np.floor(1024 * np.array([v for _, v in far])).astype(object) + 100_000
    want = [int(((len(x) * r - x.sum(0)) ** 2).sum()) for r in x]
    got = {r.id: r.deviation for r in whiten(vectors_of(spark, far)).collect()}
    assert got == {i: d if d < 1 << 63 else None for (i, _), d in zip(far, want, strict=True)}


@pytest.mark.parametrize("name", ["op11_embedding_whitening", "op12_spelling_variants", "op13_exact_dedup"])
def test_queries(spark, name):
    out = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    want = {"op11_embedding_whitening": ["vec_id", "component"], "op12_spelling_variants": ["word"], "op13_exact_dedup": ["doc_id"]}[name]
    assert out and len({tuple(r[c] for c in want) for r in out}) == len(out)
