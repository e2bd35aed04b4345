"""The whole quality gate of a run: every check whose tables the run holds, each table read once for its rows.

Checks of single rows (shape, amounts, rates, sources, order of dates, open years, keywords) are fused: one
pass over a table computes the array of failed checks of each row and keeps only rows that failed one.
Checks across rows or tables (duplicates, dangling ids, sums, counts) are the operators of ``quality``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from publedger import schemas
from publedger.operators import quality, rules

Tables = dict[str, DataFrame]

#: Shape and row key of every table the gate knows.
SHAPES: dict[str, tuple[StructType, tuple[str, ...]]] = {
    "sections": (schemas.SECTIONS, ("section_id",)),
    "tenures": (schemas.TENURES, ("tenure_id",)),
    "items": (schemas.BUDGET_ITEMS, ("item_id",)),
    "regulations": (schemas.REGULATIONS, ("section_id", "code", "year")),
    "usage": (schemas.USAGE, ("section_id", "fiscal_year", "econ1", "econ2")),
    "activities": (schemas.ACTIVITIES, ("id",)),
    "sources": (schemas.SOURCES, ("id",)),
    "entries": (schemas.ENTRIES, ("entry_id",)),
    "publications": (schemas.PUBLICATIONS, ("dataset_id",)),
    "contracts": (schemas.CONTRACTS, ("section_id", "seq")),
    "attempts": (schemas.ATTEMPTS, ("url", "attempted_at")),
}
#: Enumerated columns of each table.
ENUMERATED = {
    "sections": ("kind",),
    "items": ("status", "currency", "unit"),
    "activities": ("source_type",),
    "sources": ("source_type", "reliability", "retrieval_status"),
    "entries": ("method", "matched_confidence", "inferred_from"),
    "publications": ("person_role",),
    "attempts": ("outcome",),
}


def row_tests(name: str, df: DataFrame, current_year: int, window_start: str) -> dict[str, dict[str, Column]]:
    """The checks of single rows of a table by group. Columns that a run does not carry are not checked."""
    shape, _ = SHAPES[name]
    held = StructType([f for f in shape.fields if f.name in df.columns])
    allowed = {c: schemas.ALLOWED[c] for c in ENUMERATED.get(name, ())}
    tests = {"schema": quality.schema_tests(df, held, allowed)}
    if name == "items":
        tests |= {"amounts": quality.amount_tests(), "rates": quality.rate_tests(), "open years": quality.open_year_tests(df, current_year)}
    if name == "tenures":
        tests["order"] = {"ends before it starts": F.col("end_date") < F.col("start_date")}
    if name in ("activities", "entries"):
        tests["window"] = {"before the window": F.col("date") < F.lit(window_start).cast("date")}
    if name == "entries":
        tests["keywords"] = quality.keyword_tests()
    for url in ("url", "source_url"):
        if url in held.names and name != "attempts":
            tests["source_url"] = quality.source_tests(url)
    return tests


def row_violations(name: str, df: DataFrame, current_year: int, window_start: str) -> DataFrame:
    """``check, key, detail`` of every failed check of every row, in one pass over the table."""
    _, key = SHAPES[name]
    hits = [
        F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(f"{name} {group}").alias("check"), F.lit(detail).alias("detail")))
        for group, tests in row_tests(name, df, current_year, window_start).items()
        for detail, test in tests.items()
    ]
    failed = df.select(F.concat_ws("/", *key).alias("key"), F.array_compact(F.array(*hits)).alias("hits")).filter(F.size("hits") > 0)
    return failed.select("key", F.explode("hits").alias("hit")).select("hit.check", "key", "hit.detail")


def _duplicates(name: str, key: str) -> tuple[str, tuple[str, ...], Callable[[Tables], DataFrame]]:
    return f"duplicate {name}", (name,), lambda t: quality.duplicate_keys(t[name], key, name)


def _dangling(name: str, column: str, target: str, target_key: str) -> tuple[str, tuple[str, ...], Callable[[Tables], DataFrame]]:
    key = SHAPES[name][1][0]
    label = f"{name} {column}"
    return label, (name, target), lambda t: quality.dangling(t[name], key, column, t[target], target_key, label)


def table_checks(current_year: int, window_start: str) -> list[tuple[str, tuple[str, ...], Callable[[Tables], DataFrame]]]:
    """Checks across rows and tables: name, tables they need, and the violations."""
    return [
        *[_duplicates(n, SHAPES[n][1][0]) for n in ("sections", "tenures", "items", "activities", "sources", "publications")],
        _dangling("items", "section_id", "sections", "section_id"),
        _dangling("tenures", "section_id", "sections", "section_id"),
        _dangling("activities", "section_id", "sections", "section_id"),
        _dangling("sources", "section_ids", "sections", "section_id"),
        _dangling("publications", "section_id", "sections", "section_id"),
        _dangling("activities", "topics", "topics", "topic"),
        ("leaf under leaf", ("items",), lambda t: quality.leaf_under_leaf(t["items"])),
        ("leaf sums", ("items",), lambda t: quality.leaf_sum_violations(t["items"])),
        ("topic counts", ("topics", "activities"), lambda t: quality.topic_count_mismatch(t["topics"], t["activities"])),
        ("hosts", ("activities", "catalogue"), lambda t: quality.uncovered_hosts(t["activities"], "id", "url", t["catalogue"])),
        ("coverage", ("coverage", "recount"), lambda t: quality.coverage_mismatch(t["coverage"], t["recount"])),
        ("coverage missing", ("sections", "coverage"), lambda t: quality.sections_without_coverage(t["sections"], t["coverage"])),
        ("usage", ("usage", "usage_coverage", "sections"), lambda t: quality.usage_violations(t["usage"], t["usage_coverage"], t["sections"], current_year)),
        ("themes", ("themes", "assignments", "items", "sections"), lambda t: quality.theme_violations(t["themes"], t["assignments"], t["items"], t["sections"])),
        ("findings", ("anomalies", "regulation_sections"), lambda t: quality.finding_violations(t["anomalies"], tuple(r for r, _ in rules.BUDGET_RULES), t["regulation_sections"])),
        ("shards", ("entries", "publications", "shard_index"), lambda t: quality.shard_violations(t["entries"], t["publications"], t["shard_index"], window_start)),
        ("categories", ("entries", "categories"), lambda t: quality.category_violations(t["entries"], t["categories"])),
        ("profiles", ("profiles", "findings", "shares", "entries"), lambda t: quality.profile_violations(t["profiles"], t["findings"], t["shares"], t["entries"])),
    ]


def all_checks(tables: Tables, current_year: int, window_start: str) -> dict[str, DataFrame]:
    """Every check whose tables are held. Input for :func:`quality.gate` and :func:`quality.violation_counts`."""
    rows = {f"rows of {n}": row_violations(n, df, current_year, window_start) for n, df in tables.items() if n in SHAPES}
    return rows | {n: check(tables) for n, needed, check in table_checks(current_year, window_start) if set(needed) <= set(tables)}
