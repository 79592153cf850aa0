"""Secret scans with a battery of randomness tests, in DataFrame functions only.

Base patterns find assignments, access keys and long hex runs.  The battery looks at other long
runs of key characters, and at their parts between separators, as a path or a name may be joined to
a key: the encoding is inferred from the characters that occur, and the run is tested for uniform use of that alphabet (chi-squared), for runs above and below the alphabet's
middle, and for serial correlation.  Each test gives a p-value of "as random as a key"; the three
are combined, and a false-discovery rule rejects runs that are not random, with its own threshold
for each class of length.  Runs that stay are spans of kind ``random``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.llm.common import materialize, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # from the leftmost AKIA of a run to its end, so shorter ones need not match
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
KINDS = ("assign", "access", "hex", "random")

#: Inferred encodings: what may occur, what must, and the alphabet in the order of its values.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex_lower", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", _DIGITS + "abcdef"),
    ("hex_upper", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", _UPPER + "234567"),
    ("base36_upper", r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", _DIGITS + _UPPER),
    ("base36", r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", _DIGITS + _LOWER),
    ("base62", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z]+$", _UPPER + _LOWER + _DIGITS),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/]+=*$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z_-]+=*$", _UPPER + _LOWER + _DIGITS + "-_"),
)
#: Upper ends of length classes.
LENGTHS = (24, 32, 48, 96)
FDR = 0.1
_BINS = 400


_SPANS = "array<struct<s:int,e:int,kind:int,m:string>>"


def _chunks(array: Column) -> Column:
    """An array dealt into arrays of about the square root of its size, so that a running value costs no square of it."""
    width = F.ceil(F.sqrt(F.size(array))).cast("int")
    pieces = F.transform(F.sequence(F.lit(1), F.size(array), width), lambda i: F.slice(array, i, width))
    return F.when(F.size(array) > 0, pieces)


def _spans(text: Column, found: Column, pattern: str, kind: str) -> Column:
    """Array of (start, end, kind, match), in code points, of the matches ``found`` of a pattern in text."""
    # split gives the gaps between matches; running place: each gap, then its match
    pairs = F.arrays_zip(found.alias("m"), F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("g"))
    return F.when(F.size(found) == 0, F.array().cast(_SPANS)).otherwise(_let(pairs, lambda x: _placed(x, KINDS.index(kind))))


def _placed(pairs: Column, kind: int) -> Column:
    """Spans of (gap g, match m) pairs that follow each other: places within a chunk first, then the chunks' places."""

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("s"), end.alias("e"), F.lit(kind).alias("kind"), x["m"].alias("m"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def after(acc: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda y: F.struct((y["s"] + acc["at"]).alias("s"), (y["e"] + acc["at"]).alias("e"), y["kind"].alias("kind"), y["m"].alias("m")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    zero = F.lit(0).alias("at")
    parts = F.transform(_chunks(pairs), lambda c: F.aggregate(c, F.struct(zero, F.array().cast(_SPANS).alias("out")), step))
    return F.flatten(F.aggregate(parts, F.struct(zero, F.array().cast(f"array<{_SPANS}>").alias("out")), after)["out"])


def _clear_of(spans: Column, base: Column) -> Column:
    """Spans that overlap none of base.  Base, in order of starts, is looked up by chunks, each with its first start and last end."""

    def hit(x: Column, y: Column) -> Column:
        return (y["s"] < x["e"]) & (x["s"] < y["e"])

    def block(c: Column) -> Column:
        return F.struct(F.array_min(F.transform(c, lambda y: y["s"])).alias("s"), F.array_max(F.transform(c, lambda y: y["e"])).alias("e"), c.alias("c"))

    def filtered(blocks: Column) -> Column:
        return F.filter(spans, lambda x: ~F.exists(blocks, lambda b: hit(x, b) & F.exists(b["c"], lambda y: hit(x, y))))

    return F.when(F.size(base) == 0, spans).otherwise(_let(F.transform(_chunks(base), block), filtered))


def _normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution, within 1e-7 (a rational approximation)."""
    a = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2.0) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _encoding(token: Column) -> Column:
    """Place in ENCODINGS, null where none fits."""
    return F.coalesce(*[F.when(token.rlike(rx), F.lit(i)) for i, (_, rx, _) in enumerate(ENCODINGS)])


def _with_parts(run: Column) -> Column:
    """The run and its parts of 20 characters or more between separators, with their own positions.

    A run is cut at "/"; one without an encoding mixes the two base64 alphabets (or lacks what all
    need), so it is also cut at the last characters of the one and of the other.
    """

    def cut(separator: str) -> Column:
        pairs = F.transform(F.split(run["m"], separator, -1), lambda x, i: F.struct(F.when(i > 0, F.lit(" ")).otherwise(F.lit("")).alias("g"), x.alias("m")))
        placed = F.filter(_placed(pairs, KINDS.index("random")), lambda x: (x["e"] - x["s"] >= 20) & (x["e"] - x["s"] < run["e"] - run["s"]))
        return F.transform(placed, lambda x: F.struct((x["s"] + run["s"]).alias("s"), (x["e"] + run["s"]).alias("e"), x["kind"].alias("kind"), x["m"].alias("m")))

    none = F.array().cast(_SPANS)
    # a part between "/" without "+" is also one between "/" and "+"
    mixed = F.concat(F.filter(cut("/"), lambda x: x["m"].contains("+")), cut("[/+]"), cut("[_-]"))
    parts = F.when(_encoding(run["m"]).isNull(), mixed).when(run["m"].contains("/"), cut("/")).otherwise(none)
    return F.concat(F.array(run), parts)


def battery(token: Column) -> Column:
    """struct(encoding int, klass int, p double): null where no encoding is inferred.

    p is small where the run is not random.  It is three times the least of three p-values (at
    most 1): too uneven use of the alphabet, too few or too many runs about its middle, and
    neighbouring values that depend on each other.
    """
    enc = _encoding(token)
    alphabets = F.array(*[F.lit(a) for _, _, a in ENCODINGS])

    def prepared(x: Column) -> Column:
        """Characters and their places in the alphabet."""
        chars = F.filter(F.split(F.regexp_replace(x["t"], "=+$", ""), ""), lambda c: c != "")
        alphabet = F.element_at(alphabets, x["enc"] + 1)
        values = F.transform(chars, lambda c: F.position(c, alphabet).cast("double") - 1.0)
        return F.struct(x["enc"].alias("enc"), chars.alias("chars"), values.alias("v"), F.length(alphabet).cast("double").alias("k"), F.size(chars).cast("double").alias("n"))

    def summed(x: Column) -> Column:
        v, k, n = x["v"], x["k"], x["n"]
        total = F.aggregate(v, F.lit(0.0), lambda s, y: s + y)
        high = F.aggregate(v, F.lit(0.0), lambda s, y: s + F.when(y >= k / 2, 1.0).otherwise(0.0))
        squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda s, y: s + F.pow(F.size(F.filter(v, lambda z: z == y)).cast("double"), F.lit(2.0)))
        pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.struct(x["enc"].alias("enc"), v.alias("v"), k.alias("k"), n.alias("n"), (total / n).alias("m"), high.alias("high"), squares.alias("squares"), pairs.alias("pairs"))

    def scored(x: Column) -> Column:
        k, n, m = x["k"], x["n"], x["m"]
        # chi-squared over the alphabet, to a normal score by the cube root
        df = k - 1.0
        z_chi = (F.pow(F.greatest(k / n * x["squares"] - n, F.lit(0.0)) / df, F.lit(1.0 / 3)) - (1.0 - 2.0 / (9.0 * df))) / F.sqrt(2.0 / (9.0 * df))
        # runs of values above and below the middle of the alphabet
        runs = 1.0 + F.aggregate(x["pairs"], F.lit(0.0), lambda s, y: s + F.when((y["a"] >= k / 2) != (y["b"] >= k / 2), 1.0).otherwise(0.0))
        mean = 1.0 + 2.0 * x["high"] * (n - x["high"]) / n
        var = (mean - 1.0) * (mean - 2.0) / (n - 1.0)
        z_runs = F.when(var > 0, F.abs(runs - mean) / F.sqrt(var)).otherwise(F.lit(40.0))
        # lag-one serial correlation
        ss = F.aggregate(x["v"], F.lit(0.0), lambda s, y: s + (y - m) * (y - m))
        cross = F.aggregate(x["pairs"], F.lit(0.0), lambda s, y: s + (y["a"] - m) * (y["b"] - m))
        z_serial = F.when(ss > 0, F.abs(cross / ss + 1.0 / n) * F.sqrt(n)).otherwise(F.lit(40.0))
        return F.struct(x["enc"].alias("enc"), n.alias("n"), F.array(z_chi, z_runs, z_serial).alias("z"))

    def combined(x: Column) -> Column:
        tails = F.transform(x["z"], _normal_tail)
        klass = F.size(F.filter(F.array(*[F.lit(float(t)) for t in LENGTHS]), lambda t: x["n"] > t))
        p = F.least(F.lit(1.0), 3.0 * F.least(tails[0], 2.0 * tails[1], 2.0 * tails[2]))
        return F.struct(x["enc"].alias("encoding"), klass.cast("int").alias("klass"), p.alias("p"))

    out = F.struct(token.alias("t"), enc.alias("enc"))
    out = _let(_let(_let(_let(out, prepared), summed), scored), combined)
    return F.when(enc.isNotNull() & (F.length(F.regexp_replace(token, "=+$", "")) >= 20), out)


def false_discovery_thresholds(tested: DataFrame, rate: float) -> list[float]:
    """For each length class the p-value at or below which runs are rejected as not random (Benjamini-Hochberg).

    p-values are counted in bins of their logarithm, so the rule needs classes times bins rows at most.
    """
    bins = F.least(F.floor(-F.log10(F.greatest(F.col("p"), F.lit(1e-40))) * 10), F.lit(_BINS - 1)).cast("int")
    counts = tested.groupBy("klass", bins.alias("bin")).count().collect()
    out = []
    for c in range(len(LENGTHS) + 1):
        by = {r["bin"]: r["count"] for r in counts if r["klass"] == c}
        total, upto, best = sum(by.values()), 0, 0.0
        for b in sorted(by, reverse=True):  # from the smallest p-values
            upto += by[b]
            top = 10 ** (-b / 10)
            if top <= rate * upto / total:
                best = top
        out.append(best)
    return out


def scan_secrets(docs: DataFrame, text_col: str = "text", fdr: float = FDR, with_text: bool = True) -> DataFrame:
    """Adds to ``docs`` the array ``spans`` of struct(s, e, kind, m): starts and ends in code points.

    kind is a place in KINDS.  Base spans: per kind leftmost non-overlapping matches; an
    assignment whose value has under 6 characters is dropped.  Random spans never overlap base
    spans; they are whole runs or parts of runs, never one in another.  Null and empty texts have
    none; texts of any length are scanned whole, in time near the number of matches to the power
    1.5 at worst; repeated rows are scanned alike, and an empty table stays empty.  No row is
    shuffled: matches and p-values are stored once, then compared with the thresholds.  A column
    of docs named spans is replaced, others are carried (text_col only if with_text).
    """
    none = F.array().cast("array<string>")
    kept = [c for c in docs.columns if c != "spans" and (with_text or c != text_col)]
    found = docs.select(F.struct(*[F.col(c) for c in kept]).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # what a pattern needs is looked for first: a key, a hex run or a random run lies in a long run of key characters
    found = found.withColumn("r", F.regexp_extract_all("text", F.lit(RUN), F.lit(0)))
    found = found.withColumn("a", F.when(F.col("text").contains("=") | F.col("text").contains(":"), F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(0))).otherwise(none))
    found = found.withColumn("k", F.when((F.size("r") > 0) & F.col("text").contains("AKIA"), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0))).otherwise(none))
    found = found.withColumn("h", F.when(F.size("r") > 0, F.regexp_extract_all("text", F.lit(HEX), F.lit(0))).otherwise(none))
    body = F.col("text")
    assign = F.filter(_spans(body, F.col("a"), ASSIGN, "assign"), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    found = found.select("doc", _in_order(F.concat(assign, _spans(body, F.col("k"), ACCESS, "access"), _spans(body, F.col("h"), HEX, "hex"))).alias("base"), _spans(body, F.col("r"), RUN, "random").alias("runs"))
    tried = lambda r: F.filter(F.transform(_clear_of(_with_parts(r), F.col("base")), lambda x: F.struct(x.alias("span"), battery(x["m"]).alias("t"))), lambda x: x["t"].isNotNull())
    found = materialize(found.select("doc", "base", F.filter(F.transform("runs", tried), lambda a: F.size(a) > 0).alias("runs")), "secrets")
    tested = found.select(F.explode(F.flatten("runs")).alias("r")).select("r.t.klass", "r.t.p")
    limits = F.array(*[F.lit(x) for x in false_discovery_thresholds(tested, fdr)])
    # a part of a run that stays is in its span
    within = lambda x, y: (y["s"] <= x["s"]) & (x["e"] <= y["e"]) & (x["e"] - x["s"] < y["e"] - y["s"])
    random = lambda r: F.transform(F.filter(r, lambda x: x["t"]["p"] > F.element_at(limits, x["t"]["klass"] + 1)), lambda x: x["span"])
    random = F.flatten(F.transform("runs", lambda r: _let(random(r), lambda a: F.filter(a, lambda x: ~F.exists(a, lambda y: within(x, y))))))
    return found.select("doc.*", _in_order(F.concat("base", random)).alias("spans"))


def _in_order(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["kind"] - b["kind"]))


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    base = F.filter("spans", lambda x: x["kind"] < KINDS.index("random"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == KINDS.index(kind))).cast("long")
    return out.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """Text with every span, sorted by start, replaced by a mark; overlapping spans share one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = x["s"] >= acc["at"]
        out = F.when(new, F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
