"""Run registered queries beside their check SQL and report differences.

Usage: python tests/compare.py [folder] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def duck(folder: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _key(value):
    if isinstance(value, float) and math.isfinite(value):
        return f"{value:.10g}"
    return str(value)


def difference(spark, connection, query, sql: str, folder: str) -> str | None:
    """None when both give the same columns, types and rows."""
    df = query(spark, folder)
    names = sorted(df.columns)
    relation = connection.sql(sql)
    if names != sorted(relation.columns):
        return f"columns {names} against {sorted(relation.columns)}"
    types = dict(zip(relation.columns, map(str, relation.types)))
    odd = [(n, t, types[n]) for n, t in df.dtypes if KINDS.get(t, t) != types[n]]
    order = [relation.columns.index(n) for n in names]
    ours = sorted(tuple(_key(row[n]) for n in names) for row in df.collect())
    theirs = sorted(tuple(_key(row[i]) for i in order) for row in relation.fetchall())
    if ours != theirs:
        a, b = set(ours) - set(theirs), set(theirs) - set(ours)
        show = lambda rows: "; ".join(str(r)[:400] for r in sorted(rows)[:3])
        return f"rows {len(ours)} / {len(theirs)} {names}\n      ours   {show(a)}\n      theirs {show(b)}"
    if odd:
        return f"types {odd}"
    return None


def main() -> int:
    from publedger.session import local_session

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = local_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(folder)
    oracle, bad, total = entry.oracle_sql(), 0, 0
    for name, query in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        total += 1
        started = time.time()
        try:
            if name in oracle:
                found = difference(spark, connection, query, oracle[name], folder)
            else:
                found = None if query(spark, folder).count() >= 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        if found:
            bad += 1
            print(f"FAIL {name} ({time.time() - started:.1f}s): {found}", flush=True)
        elif time.time() - started > 4:
            print(f"slow {name} ({time.time() - started:.1f}s)", flush=True)
    print(f"{total - bad}/{total} equal")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
