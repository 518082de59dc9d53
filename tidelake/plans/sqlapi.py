"""The callers' SQL: names, parameters and macros that Spark's dialect lacks, and results as JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame

from ..functions.time import as_utc

_QUOTED = re.compile(r"('(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/)", re.S)
_SHORT = {"us": "microsecond", "ms": "millisecond", "s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week"}


def _outside(sql: str, change) -> str:
    """Change the text outside of quotes and comments."""
    return "".join(part if i % 2 else change(part) for i, part in enumerate(_QUOTED.split(sql)))


def strip_schema(sql: str, schema: str = "lp") -> str:
    """``lp.cpu`` as ``cpu``: tables are views of the request's own session."""
    return _outside(sql, lambda s: re.sub(rf"\b{re.escape(schema)}\.(?=[A-Za-z_`\"])", "", s)) if schema else sql


def numbered_parameters(sql: str, params: Sequence[object]) -> tuple[str, dict[str, object]]:
    """``$1`` as ``:p1``, with the values by name."""
    used: set[int] = set()

    def put(m: re.Match) -> str:
        used.add(int(m[1]))
        return f":p{m[1]}"

    out = _outside(sql, lambda s: re.sub(r"\$(\d+)", put, s))
    if used and (min(used) < 1 or max(used) > len(params)):
        raise ValueError(f"the query uses ${max(used)} of {len(params)} parameters")
    return out, {f"p{i}": params[i - 1] for i in used}


def time_filter(sql: str, start: datetime | str | None, end: datetime | str | None) -> str:
    """``$__timeFilter(column)`` as BETWEEN, both ends included; without bounds it is true."""

    def put(m: re.Match) -> str:
        if start is None or end is None:
            return "true"
        a, b = (as_utc(t).strftime("%Y-%m-%d %H:%M:%S.%f") for t in (start, end))
        return f"{m[1]} BETWEEN TIMESTAMP'{a}' AND TIMESTAMP'{b}'"

    return re.sub(r"\$__timeFilter\(\s*([^()]+?)\s*\)", put, sql)


def long_intervals(sql: str) -> str:
    """``INTERVAL '5m'`` as ``INTERVAL '5 minute'``."""
    return re.sub(r"(?i)\binterval\s*'\s*(\d+)\s*(us|ms|[smhdw])\s*'", lambda m: f"INTERVAL '{m[1]} {_SHORT[m[2].lower()]}'", sql)


def named_tables(sql: str, tables: Iterable[str]) -> list[str]:
    """The tables whose name occurs in the SQL: only these need a view."""
    words = {w.lower() for w in re.findall(r"[A-Za-z_]\w*", sql)}
    return [t for t in tables if t.lower() in words]


def prepare(sql: str, params: Sequence[object] = (), start=None, end=None, schema: str = "lp") -> tuple[str, dict[str, object]]:
    return numbered_parameters(strip_schema(long_intervals(time_filter(sql, start, end)), schema), params)


def _plain(value: object) -> object:
    if isinstance(value, datetime):
        return as_utc(value.astimezone() if value.tzinfo is None else value).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return float(value) if isinstance(value, Decimal) else str(value)


def json_pieces(df: DataFrame, rows: int = 1000) -> Iterator[str]:
    """All rows as a JSON array of objects, some rows at a time; times are ISO 8601 in UTC.

    The driver holds a partition of the result and the next one, and never the whole.
    """
    mark, held = "[", []
    for r in df.toLocalIterator(prefetchPartitions=True):
        held.append(json.dumps(r.asDict(recursive=True), default=_plain))
        if len(held) == rows:
            yield mark + ", ".join(held)
            mark, held = ", ", []
    yield (mark if held or mark == "[" else "") + ", ".join(held) + "]"
