"""Query registry: Spark plan, cross-check SQL, and one output specification for both.

A specification such as "station_id:i valid_time:t crps:d" fixes the output columns and their types: i = 64-bit integer,
d = double rounded to 6 digits, s and t = text (t for dates and times), b = boolean. It is applied to the Spark result and
to the SQL alike.
"""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foresift.plans.ctes import CTES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def _fields(spec: str) -> list[tuple[str, str]]:
    return [tuple(f.split(":")) for f in spec.split()]


def shape_spark(df: DataFrame, spec: str) -> DataFrame:
    cols = []
    for name, kind in _fields(spec):
        c = F.col(f"`{name}`")
        if kind == "i":
            c = c.cast("bigint")
        elif kind == "d":
            c = F.round(c.cast("double"), DIGITS) + F.lit(0.0)
        elif kind in "st":
            c = c.cast("string")
        cols.append(c.alias(name))
    return df.select(*cols)


def shape_sql(body: str, spec: str) -> str:
    cols = []
    for name, kind in _fields(spec):
        c = f'"{name}"'
        if kind == "i":
            c = f"CAST({c} AS BIGINT)"
        elif kind == "d":
            c = f"round(CAST({c} AS DOUBLE), {DIGITS}) + 0"
        elif kind in "st":
            c = f"CAST({c} AS VARCHAR)"
        cols.append(f'{c} AS "{name}"')
    return f"{with_ctes(body)} SELECT {', '.join(cols)} FROM result"


def with_ctes(body: str) -> str:
    """Prefixes the common table expressions that the body needs, in definition order."""
    needed, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name, sql in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(sql)
    parts = [f"{n} AS ({CTES[n]})" for n in CTES if n in needed]
    return "WITH " + ", ".join([*parts, f"result AS ({body})"])


def query(name: str, spec: str, sql: str | None = None):
    """Registers a plan function (spark, sf_dir) -> DataFrame."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shape_spark(fn(spark, sf_dir), spec)
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = shape_sql(sql, spec)
        return fn
    return wrap
