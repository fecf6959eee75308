"""Query catalog: each entry pairs a Spark callable with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    columns: str
    sql: str | None = None


CATALOG: dict[str, Query] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """Register a named SQL view that checks may build on."""
    VIEWS[name] = sql


def query(name: str, columns: str, sql: str | None = None):
    """Register a query.  ``columns`` is ``name[:kind]`` separated by blanks.

    Kinds: ``i`` integer, ``f``/``g`` double rounded to 6/3 digits, ``t`` timestamp,
    ``d`` date, ``b`` boolean as 0/1, none for text.
    """

    def add(fn):
        assert name not in CATALOG, name
        CATALOG[name] = Query(name, fn, columns, sql)
        return fn

    return add


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) if ":" in c else (c, "s") for c in spec.split()]


def present(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _columns(spec):
        c = F.col(f"`{name}`")
        if kind == "i":
            c = c.cast("long")
        elif kind == "f":
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind == "g":
            c = F.round(c.cast("double"), 3) + F.lit(0.0)
        elif kind == "b":
            c = c.cast("int").cast("long")
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind == "d":
            c = F.date_format(c, "yyyy-MM-dd")
        else:
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def _needed(sql: str, seen: dict[str, str]) -> None:
    import re

    for name in VIEWS:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needed(VIEWS[name], seen)
            seen[name] = VIEWS[name]


def oracle(q: Query) -> str:
    """Full SQL text: the views it uses, its body, and the output casts."""
    seen: dict[str, str] = {}
    _needed(q.sql, seen)
    casts = []
    for name, kind in _columns(q.columns):
        c = f'"{name}"'
        c = {
            "i": f"CAST({c} AS BIGINT)",
            "f": f"round(CAST({c} AS DOUBLE), 6) + 0.0",
            "g": f"round(CAST({c} AS DOUBLE), 3) + 0.0",
            "b": f"CAST(CAST({c} AS INTEGER) AS BIGINT)",
            "t": f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')",
            "d": f"strftime({c}, '%Y-%m-%d')",
            "s": f"CAST({c} AS VARCHAR)",
        }[kind]
        casts.append(f'{c} AS "{name}"')
    ctes = [f"{n} AS ({s})" for n, s in seen.items()] + [f"result AS ({q.sql})"]
    return "WITH " + ",\n".join(ctes) + "\nSELECT " + ", ".join(casts) + " FROM result"
