"""Where queries register themselves with their check SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from publedger.plans.oracle import COMMON

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _names_in(body: str) -> set[str]:
    return set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", body)) & COMMON.keys()


def _needed(body: str) -> list[str]:
    """Common tables a statement uses, directly or through others, in definition order."""
    found: set[str] = set()
    pending = [body]
    while pending:
        for name in _names_in(pending.pop()) - found:
            found.add(name)
            pending.append(COMMON[name])
    return [name for name in COMMON if name in found]


def with_common(body: str) -> str:
    """The statement preceded by the common tables it uses."""
    body = body.strip().rstrip(";")
    parts = [f"{name} AS ({COMMON[name].strip()})" for name in _needed(body)]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join([*parts, body[5:].strip()])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def plain(df: DataFrame) -> DataFrame:
    """Result columns in the types both engines share: bigint, double, boolean and text."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType.typeName()
        if kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        elif kind == "date":
            c = c.cast("string")
        elif kind == "array":
            c = F.array_join(c.cast("array<string>"), ", ")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query. ``sql`` is its check; leave it out where SQL cannot say it."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: plain(fn(spark, folder))
        if sql is not None:
            ORACLE[name] = with_common(sql)
        return fn

    return register
