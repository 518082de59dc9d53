"""Names of tables and columns made from the names of measurements, tags and fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_NAME = 63


def identifier(name: str) -> str:
    """Letters, digits and underscores in lower case, at most 63; an underscore comes before another first character."""
    clean = re.sub(r"[^A-Za-z0-9_]", "_", name).lower()
    return (clean if re.match(r"[a-z_]", clean) else "_" + clean)[:MAX_NAME]


def identifier_column(name: Column) -> Column:
    """``identifier`` of each row."""
    clean = F.lower(F.regexp_replace(name, "[^A-Za-z0-9_]", "_"))
    return F.substring(F.when(clean.rlike("^[a-z_]"), clean).otherwise(F.concat(F.lit("_"), clean)), 1, MAX_NAME)


def tag_column(tag: str) -> str:
    return "t_" + identifier(tag)


def field_column(field: str) -> str:
    return "f_" + identifier(field)


def quoted(name: str) -> str:
    """The name as a quoted SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def distinct_columns(names: list[str], column) -> dict[str, str]:
    """Name -> column; two names that make one column are an error, as one would hide the other."""
    out: dict[str, str] = {}
    for n in names:
        c = column(n)
        if c in out.values():
            raise ValueError(f"{n!r} and another name both make the column {c}")
        out[n] = c
    return out
