"""Display-filter language, compiled on the driver to one Column.

``or`` binds weaker than ``and``, ``and`` weaker than ``not``.  A comparison is
``field op value``; a bare protocol word stands for ``protocol == word``; other bare words are errors.  Missing values make every comparison false, before ``not``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("==", "!=", "<", "<=", ">", ">=")
PROTOCOLS = {"tcp", "udp", "dns", "tls", "http", "icmp", "arp", "ssl"}
#: Columns of each field; a field with several columns holds if any of them does.
FIELDS = {"ip": ("source", "destination"), "src": ("source",), "dst": ("destination",), "port": ("src_port", "dst_port"), "sport": ("src_port",), "dport": ("dst_port",), "protocol": ("protocol",), "type": ("event_type",), "length": ("length",), "flow": ("flow_id",), "summary": ("summary",)}


class FilterError(ValueError):
    """The expression is not a display filter."""


def tokens(text: str) -> list[tuple[str, str]]:
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
        elif c in "()":
            out.append((c, c))
            i += 1
        elif c in "\"'":
            j = text.find(c, i + 1)
            if j < 0:
                raise FilterError("unterminated quote")
            out.append(("value", text[i + 1 : j]))
            i = j + 1
        elif c in "<>=!":
            j = i
            while j < len(text) and text[j] in "<>=!":
                j += 1
            if text[i:j] not in OPERATORS:
                raise FilterError(f"unknown operator {text[i:j]}")
            out.append(("op", text[i:j]))
            i = j
        else:
            j = i
            while j < len(text) and not text[j].isspace() and text[j] not in "()<>=!\"'":
                j += 1
            out.append(("word", text[i:j]))
            i = j
    return out


def _number(value: str) -> float | None:
    try:
        return float(value)
    except ValueError:
        return None


def _leaf(columns: set[str], field: str, op: str, value: str) -> Column:
    if field not in FIELDS:
        raise FilterError(f"unknown field {field}")
    names = FIELDS[field]
    if field == "protocol" and "protocol" not in columns:
        names = ("event_type",)
    out = F.lit(False)
    for name in names:
        if name not in columns:
            continue
        text, n = F.lower(F.col(name).cast("string")), _number(value)
        number = F.expr(f"try_cast(`{name}` AS DOUBLE)")
        number = F.when(~F.isnan(number), number)
        if op == "contains":
            hit = text.contains(value.lower())
        elif op in ("==", "!="):
            same = text == value.lower()
            if n is not None and not math.isnan(n):
                same = F.coalesce(number == n, same)
            hit = same if op == "==" else ~same
        elif n is None or math.isnan(n):
            hit = F.lit(False)
        else:
            hit = {"<": number < n, "<=": number <= n, ">": number > n, ">=": number >= n}[op]
        out = out | F.coalesce(hit, F.lit(False))
    return out


def compile_filter(text: str, columns: list[str]) -> Column:
    have, toks, at = set(columns), tokens(text), 0
    if not toks:
        return _leaf(have, "protocol", "contains", "")

    def peek(kind: str, word: str | None = None) -> bool:
        return at < len(toks) and toks[at][0] == kind and (word is None or toks[at][1] == word)

    def take() -> tuple[str, str]:
        nonlocal at
        if at >= len(toks):
            raise FilterError("the expression ends early")
        at += 1
        return toks[at - 1]

    def any_of() -> Column:
        out = all_of()
        while peek("word", "or"):
            take()
            out = out | all_of()
        return out

    def all_of() -> Column:
        out = negated()
        while peek("word", "and"):
            take()
            out = out & negated()
        return out

    def negated() -> Column:
        if peek("word", "not"):
            take()
            return ~negated()
        if peek("("):
            take()
            out = any_of()
            if take()[0] != ")":
                raise FilterError("missing )")
            return out
        kind, word = take()
        if kind not in ("word", "value"):
            raise FilterError(f"unexpected {word}")
        if peek("op") or peek("word", "contains"):
            op, value = take()[1], take()
            if value[0] not in ("word", "value"):
                raise FilterError("a value is missing")
            return _leaf(have, word.lower(), op, value[1])
        if word.lower() in PROTOCOLS:
            return _leaf(have, "protocol", "==", word)
        raise FilterError(f"unknown field or protocol {word!r}")

    out = any_of()
    if at < len(toks):
        raise FilterError(f"unexpected {toks[at][1]}")
    return out


def apply_filter(rows: DataFrame, text: str) -> DataFrame:
    return rows.where(compile_filter(text, rows.columns))
