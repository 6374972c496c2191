"""JSON texts of any shape: redacted, in canonical form, bounded ([X4], [X5], [X42]).

Expressions need a schema, so these read a text as it is, in Arrow batches.
A text that is no JSON, or is nested deeper than Python's stack, gives null.
Of a key that occurs twice the last value counts; numbers are doubles and
written in the shortest form that reads back equal.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.exprs import REDACTED, REDACTIONS, SENSITIVE_KEY

# What a bounded value keeps of lists, objects, keys and strings, in all of nodes and characters, and how deep.
ITEMS, KEYS, KEY_CHARS, STRING_CHARS, NODES, CHARS, DEPTH = 16, 24, 256, 2_000, 512, 20_000, 4

_redactions = [re.compile(p, re.ASCII) for p in REDACTIONS]
_sensitive_key = re.compile(SENSITIVE_KEY)
_index = re.compile(r"0|[1-9][0-9]{0,9}")
_surrogate = re.compile("[\ud800-\udfff]")


def redact(text: str) -> str:
    for p in _redactions:
        text = p.sub(REDACTED, text)
    return text


def _refuse(name: str) -> Any:
    raise ValueError(name)


def read(text: str) -> Any:
    return json.loads(text, parse_constant=_refuse)


def number(x: int | float) -> str:
    """Plain digits from 1e-6 to below 1e21, an exponent beyond."""
    x = float(x)
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    sign, digits = ("-", repr(-x)) if x < 0 else ("", repr(x))
    mantissa, _, power = digits.partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    figures = (whole + part).lstrip("0")
    point = len(whole) + int(power or 0) - (len(whole + part) - len(figures))  # where the point stands among the figures
    figures = figures.rstrip("0")
    n = len(figures)
    if n <= point <= 21:
        return sign + figures + "0" * (point - n)
    if 0 < point <= 21:
        return sign + figures[:point] + "." + figures[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + figures
    tail = figures[0] + ("." + figures[1:] if n > 1 else "")
    return f"{sign}{tail}e{'+' if point > 0 else '-'}{abs(point - 1)}"


def quoted(text: str) -> str:
    return _surrogate.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(text, ensure_ascii=False))


def keys(found: list[str], ordered: bool) -> list[str]:
    """Keys that are array indexes by number, then the others: as given, or by their UTF-16 units."""
    index = lambda k: _index.fullmatch(k) and int(k) < 2**32 - 1
    rest = [k for k in found if not index(k)]
    return sorted(filter(index, found), key=int) + (sorted(rest, key=lambda k: k.encode("utf-16-be", "surrogatepass")) if ordered else rest)


def write(value: Any, ordered: bool = False) -> str:
    if value is None or isinstance(value, bool):
        return "null" if value is None else str(value).lower()
    if isinstance(value, str):
        return quoted(value)
    if isinstance(value, list):
        return "[" + ",".join(write(v, ordered) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{quoted(k)}:{write(value[k], ordered)}" for k in keys(list(value), ordered)) + "}"
    return number(value)


def redacted(value: Any, key: str = "") -> Any:
    """Values under sensitive keys blanked whole, but for ``file_generation``; other strings redacted."""
    if key != "file_generation" and _sensitive_key.search(key):
        return REDACTED
    if isinstance(value, str):
        return redact(value)
    if isinstance(value, list):
        return [redacted(v) for v in value]
    if isinstance(value, dict):
        return {k: redacted(v, k) for k, v in value.items()}
    return value


class _Budget:
    def __init__(self) -> None:
        self.nodes, self.chars = NODES, CHARS

    def spent(self) -> bool:
        return self.nodes <= 0 or self.chars <= 0


_DROPPED = object()


def bounded(value: Any, left: _Budget, depth: int = 0) -> Any:
    """What a bounded reading keeps: ends of strings and lists, first keys, four levels, until the budget is spent."""
    if left.spent():
        return _DROPPED
    left.nodes -= 1
    if isinstance(value, str):
        n = min(len(value), STRING_CHARS, left.chars)
        left.chars -= n
        return value[len(value) - n :]
    if not isinstance(value, list | dict):
        return value
    if depth >= DEPTH:
        return _DROPPED
    if isinstance(value, list):
        out = []
        for item in value[-ITEMS:]:
            out.append(bounded(item, left, depth + 1))
            if left.spent():
                break
        return [x for x in out if x is not _DROPPED]
    kept = {}
    for key in keys(list(value), False)[:KEYS]:
        if left.chars <= 0:
            break
        n = min(len(key), KEY_CHARS, left.chars)
        left.chars -= n
        item = bounded(value[key], left, depth + 1)
        if item is not _DROPPED:
            kept[redact(key[:n])] = item
        if left.spent():
            break
    return kept


def _expression(change: Callable[[Any], str]) -> Callable[[Column], Column]:
    def one(text: str | None) -> str | None:
        try:
            return None if text is None else change(read(text))
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf(T.StringType())
    def run(c: pd.Series) -> pd.Series:
        return c.map(one)

    return run


#: [X4] Redacted at every depth, keys in their order.
redact_json = _expression(lambda v: write(redacted(v)))
#: [X5] Keys sorted at every depth, no spaces.
canonical = _expression(lambda v: write(v, ordered=True))
#: [X42] A bounded, redacted reading.
bounded_json = _expression(lambda v: redact(write(bounded(v, _Budget()))))


def checksum_json(c: Column) -> Column:
    """[X6] Hex SHA-256 of the canonical form."""
    return F.sha2(canonical(c), 256)
