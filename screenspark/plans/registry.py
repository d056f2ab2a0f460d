"""All registered queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded, arrays as text: the form in which results are compared."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.round(c, DIGITS)
        elif isinstance(f.dataType, ArrayType):
            c = F.array_join(c, "|")
        out.append(c.alias(f.name))
    return df.select(*out)


def long_counts(sql: str) -> str:
    """``count_if(...)`` cast to BIGINT, the type that Spark gives it."""
    out, at = "", 0
    while (i := sql.find("count_if(", at)) >= 0:
        j, depth = i + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out += f"{sql[at:i]}CAST({sql[i:j]} AS BIGINT)"
        at = j
    return out + sql[at:]


def register(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame, and the SQL with the same result."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if sql:
            SQL[name] = long_counts(sql)
        return fn

    return add


def select_sql(source: str, keys: str, doubles: str = "", tail: str = "") -> str:
    """A final SELECT with the doubles rounded."""
    parts = [k.strip() for k in keys.split(",") if k.strip()] + [f"round({d.strip()}, {DIGITS}) AS {d.strip()}" for d in doubles.split(",") if d.strip()]
    return f"SELECT {', '.join(parts)} FROM {source} {tail}"


from screenspark.plans import (  # noqa: E402, F401
    queries_cavity,
    queries_consensus,
    queries_extra,
    queries_metrics,
    queries_model,
    queries_quality,
    queries_readers,
    queries_scoring,
    queries_sets,
    queries_streaming,
)
