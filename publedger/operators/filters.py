"""What a reader narrows a table by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from publedger.functions.numbers import is_large_change
from publedger.functions.text import contains_all_terms, matches_query, norm_text

ALL = "all"
CROSS_CUTTING = "cross-cutting"
SEARCH_RESULTS = 12


def filter_activities(
    df: DataFrame,
    section: str = ALL,
    year: str = ALL,
    topic: str = ALL,
    source_type: str = ALL,
    query: str = "",
    entity: str = ALL,
) -> DataFrame:
    """Activities by section, year (undated ones drop out), topic, source, entity and text."""
    if section != ALL:
        df = df.filter(F.col("section_id") == section)
    if year != ALL:
        df = df.filter(F.year("date") == int(year))
    if topic != ALL:
        df = df.filter(F.array_contains("topics", topic))
    if source_type != ALL:
        df = df.filter(F.col("source_type") == source_type)
    if entity != ALL:
        df = df.filter(F.array_contains("people", entity) | F.array_contains("organizations", entity))
    if query.strip():
        df = df.filter(matches_query(["title", "summary", "topics", "people", "organizations"], query))
    return df


def filter_sources(
    df: DataFrame,
    section: str = ALL,
    year: str = ALL,
    source_type: str = ALL,
    publisher: str = ALL,
    query: str = "",
) -> DataFrame:
    """Sources by section (or cross-cutting: no section at all), year, type, publisher and text."""
    if section == CROSS_CUTTING:
        df = df.filter(F.size("section_ids") == 0)
    elif section != ALL:
        df = df.filter(F.array_contains("section_ids", section))
    if year != ALL:
        df = df.filter(F.array_contains("fiscal_years", int(year)))
    if source_type != ALL:
        df = df.filter(F.col("source_type") == source_type)
    if publisher != ALL:
        df = df.filter(F.col("publisher") == publisher)
    if query.strip():
        df = df.filter(matches_query(["title", "publisher", "source_type_label", "url"], query))
    return df


def filter_budget(
    df: DataFrame,
    section: str = ALL,
    year: str = ALL,
    level: str = ALL,
    large_only: bool = False,
    query: str = "",
    **limits: float,
) -> DataFrame:
    """Budget lines by section, year, level, size of change, and text over title, code and path."""
    if section != ALL:
        df = df.filter(F.col("section_id") == section)
    if year != ALL:
        df = df.filter(F.col("fiscal_year") == int(year))
    if level != ALL:
        df = df.filter(F.col("level") == int(level))
    if large_only:
        df = df.filter(is_large_change("original", "updated", **limits))
    if query.strip():
        df = df.filter(matches_query(["title", "code", "path"], query))
    return df


def filter_diary(df: DataFrame, person: str = ALL, category: str = ALL, query: str = "") -> DataFrame:
    """Calendar rows by person key, category, and one piece of text in subject, place or people."""
    if person != ALL:
        df = df.filter(F.col("person_key") == person)
    if category != ALL:
        df = df.filter(F.coalesce("category", F.lit("unspecified")) == category)
    text = query.strip().lower()
    if text:
        parts = [F.coalesce(F.col(c), F.lit("")) for c in ("subject", "location", "participants")]
        df = df.filter(F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(text)))
    return df


def filter_findings(df: DataFrame, rule: str = ALL, section: str = ALL) -> DataFrame:
    if rule != ALL:
        df = df.filter(F.col("rule_id") == rule)
    if section != ALL:
        df = df.filter(F.col("section_id") == section)
    return df


def data_backed_topics(topics: DataFrame) -> DataFrame:
    """Topics that have items, most items first."""
    return topics.filter(F.col("item_count") > 0).orderBy(F.desc("item_count"), "topic")


def search_entities(df: DataFrame, query: str, n: int = SEARCH_RESULTS) -> DataFrame:
    """First entities (in ``seq`` order) whose label or keywords hold every word of the query."""
    text = norm_text(F.concat_ws(" ", "label", "keywords"), lower=True)
    return df.filter(contains_all_terms(text, query)).orderBy("seq").limit(n)


def window_flags(rows: DataFrame, start: str, end: str) -> DataFrame:
    """``outcome`` of each extracted row: kept, empty (no subject and no date) or out_of_window."""
    outside = (F.col("date") < F.lit(start).cast("date")) | (F.col("date") > F.lit(end).cast("date"))
    empty = F.col("date").isNull() & (F.coalesce(F.trim("subject"), F.lit("")) == "")
    outcome = (
        F.when(empty, F.lit("empty")).when(F.coalesce(outside, F.lit(False)), F.lit("out_of_window")).otherwise(F.lit("kept"))
    )
    return rows.withColumn("outcome", outcome)


def window_filter(rows: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Rows inside the window (undated ones stay), and what each publication lost to it."""
    flagged = window_flags(rows, start, end)
    counts = flagged.groupBy("dataset_id").agg(
        F.count_if(F.col("outcome") == "kept").alias("kept"),
        F.count_if(F.col("outcome") == "empty").alias("empty_rows"),
        F.count_if(F.col("outcome") == "out_of_window").alias("out_of_window_rows"),
    )
    return flagged.filter(F.col("outcome") == "kept").drop("outcome"), counts


def for_section(df: DataFrame, section: str, column: str = "section_id") -> DataFrame:
    """Rows of one section; ``column`` may be a single id or an array of ids."""
    if df.schema[column].dataType.typeName() == "array":
        return df.filter(F.array_contains(column, section))
    return df.filter(F.col(column) == section)


def years_available(items: DataFrame, section: str = ALL) -> DataFrame:
    if section != ALL:
        items = for_section(items, section)
    return items.select("fiscal_year").distinct().orderBy("fiscal_year")
