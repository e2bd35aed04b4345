"""Ranks, caps, de-duplication and distribution summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from publedger.functions.numbers import change_percent, col, finite, half_up, share_of
from publedger.operators.common import first_per_group, middle_values
from publedger.session import cut_lineage

FEED_CAP = 200
PAGE_SIZE = 50


def rank_of(df: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """``rank`` and ``out_of`` of every row with a value, largest first, distinct positions.

    Rows are range-partitioned by group and value and numbered inside their range; a running sum over
    the ranges of a group, a few rows, gives where each one starts. So a group of any size is ranked by
    many tasks.
    """
    order = [F.desc(value), F.col(tie)]
    ranged = df.filter(finite(value).isNotNull()).repartitionByRange(*[F.col(c) for c in by], *order)
    ranged = cut_lineage(ranged.withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(*by, "__range").agg(F.count("*").alias("__size"))
    earlier = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        *by, "__range", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__start"), F.sum("__size").over(W.partitionBy(*by)).alias("out_of")
    )
    inside = F.row_number().over(W.partitionBy(*by, "__range").orderBy(*order))
    ranked = ranged.withColumn("__inside", inside).join(starts, [*by, "__range"])
    columns = [F.col(f"`{c}`") for c in df.columns]
    return ranked.select(*columns, (F.col("__start") + F.col("__inside")).cast("int").alias("rank"), "out_of")


def rank_anomalies(findings: DataFrame) -> DataFrame:
    """``strength`` of a finding: 60 effect, 20 data quality, 20 rarity of its rule.

    Ordering is left to the reader of the table, so no global sort is forced here.
    """
    executed, allocated, revised = (F.coalesce(c, F.lit(0)) for c in ("executed", "allocated", "revised"))
    base = F.abs(F.coalesce("revised", "allocated", F.lit(0)))
    gap = F.greatest(
        F.abs(executed - revised),
        F.abs(revised - allocated),
        F.when(base == 0, F.abs(executed)).otherwise(F.lit(0)),
    )
    magnitude = F.least(F.lit(1.0), F.log10(gap.cast("double") + 1.0) / 10.0)
    ratio = F.when(base > 0, F.least(F.lit(1.0), gap.cast("double") / base)).otherwise(F.lit(1.0))
    effect = F.when(gap == 0, F.lit(0.0)).otherwise(half_up(magnitude * 0.6 + ratio * 0.4, 2))
    quality = F.when(F.col("executed").isNotNull() & F.col("revised").isNotNull(), F.lit(1.0)).otherwise(F.lit(0.5))
    rules = findings.groupBy("rule_id").agg(F.count("*").alias("__rule"))
    rules = rules.withColumn("__total", F.sum("__rule").over(W.partitionBy(F.lit(0))))
    rarity = F.lit(1.0) - F.col("__rule") / F.col("__total")
    return (
        findings.join(rules, "rule_id")
        .withColumn("strength", half_up(effect * 60.0 + quality * 20.0 + rarity * 20.0, 1))
        .drop("__rule", "__total")
    )


def rank_diary_findings(findings: DataFrame) -> DataFrame:
    """``strength``: value over the upper median of the same rule; 1 when that is no measure."""
    medians = middle_values(findings, ["rule_id"], "value").select("rule_id", F.col("hi").alias("__median"))
    relative = F.when(
        F.col("__median") > 0, F.try_divide(F.col("value").cast("double"), F.col("__median"))
    )
    return (
        findings.join(medians, "rule_id", "left")
        .withColumn("strength", F.coalesce(relative, F.lit(1.0)))
        .drop("__median")
    )


def cap_per_feed(df: DataFrame, n: int = FEED_CAP) -> tuple[DataFrame, DataFrame]:
    """Newest ``n`` rows per section and feed, and how many each feed lost to the cap."""
    by = ["section_id", "feed"]
    kept = first_per_group(df, by, [F.desc_nulls_last("date"), F.col("seq")], n)
    dropped = df.groupBy(*by).agg(
        F.least(F.count("*"), F.lit(n)).alias("kept"),
        F.greatest(F.count("*") - n, F.lit(0)).alias("dropped"),
    )
    return kept, dropped


def dedupe_entries(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per (section, role, person, date, start, subject), and kept / removed per publication.

    The row kept is the first by section, date and id, rows without section or date last.
    """
    print_ = [
        F.coalesce(F.col("section_id").cast("string"), F.lit("—")),
        F.col("role_label"),
        F.coalesce("person_label", F.lit("—")),
        F.coalesce(F.col("date").cast("string"), F.lit("—")),
        F.coalesce("start_time", F.lit("—")),
        F.col("subject"),
    ]
    marked = entries.withColumn("__print", F.struct(*[p.alias(f"p{i}") for i, p in enumerate(print_)]))
    kept = first_per_group(marked, ["__print"], [F.col("entry_id")], 1).drop("__print")
    before = entries.groupBy("dataset_id").agg(F.count("*").alias("before"))
    after = kept.groupBy("dataset_id").agg(F.count("*").alias("kept"))
    counts = before.join(after, "dataset_id", "left").select(
        "dataset_id",
        F.coalesce("kept", F.lit(0)).alias("kept"),
        (F.col("before") - F.coalesce("kept", F.lit(0))).alias("removed"),
    )
    return kept, counts


def dedupe_activities(activities: DataFrame) -> DataFrame:
    """The last row of every section and address."""
    return first_per_group(activities, ["section_id", "url"], [F.desc("seq")], 1)


def dedupe_sources(sources: DataFrame) -> DataFrame:
    """The first discovery of every address."""
    return first_per_group(sources, ["url"], [F.col("seq")], 1)


def sort_page(df: DataFrame, column: str, descending: bool, tie: str, page: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """One page of a sorted table; missing values come last in both directions."""
    order = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return df.orderBy(order, tie).offset(page * size).limit(size)


def unique_sorted(df: DataFrame, column: str, locale: str | None = None) -> DataFrame:
    """Distinct values in binary order, or in the order of a collation such as ``he``."""
    order = F.collate(column, locale) if locale else F.col(column)
    return df.select(column).distinct().orderBy(order)


def minmax_scale(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """``scaled`` in [0, 1] within the group, or on one shared scale without ``by``.

    A flat series scales by 1, and a group with fewer than two values gets none.
    """
    by = by or []
    stats = df.groupBy(*by).agg(
        F.min(value).alias("__min"), F.max(value).alias("__max"), F.count(value).alias("__n")
    )
    joined = df.join(stats, by) if by else df.join(F.broadcast(stats), F.lit(True))
    span = F.col("__max") - F.col("__min")
    scaled = (F.col(value) - F.col("__min")).cast("double") / F.when(span == 0, F.lit(1)).otherwise(span)
    return joined.withColumn("scaled", F.when(F.col("__n") >= 2, scaled)).drop("__min", "__max", "__n")


def spread(df: DataFrame, by: list[str], label: str, value: str) -> DataFrame:
    """Largest, median and smallest value with labels, where at least two are known.

    The median is the lower one of an even count.
    """
    usable = df.filter(finite(value).isNotNull())
    ends = usable.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.max(value).alias("high"),
        F.min_by(label, F.struct(-F.col(value), F.col(label))).alias("high_label"),
        F.min(value).alias("low"),
        F.max_by(label, F.struct(-F.col(value), F.col(label))).alias("low_label"),
    )
    medians = middle_values(usable, by, value).select(*by, F.col("lo").alias("median"))
    return ends.filter(F.col("n") >= 2).join(medians, by)


def concentration(df: DataFrame, by: list[str], label: str, value: str, lead: int = 3) -> DataFrame:
    """Share of the largest component and of the ``lead`` largest, over positive values."""
    usable = df.filter(F.col(value) > 0)
    totals = usable.groupBy(*by).agg(F.sum(value).alias("total"), F.count("*").alias("components"))
    ranked = first_per_group(usable, by, [F.desc(value), F.col(label)], lead, rank="__rank")
    largest = ranked.groupBy(*by).agg(
        F.max(F.when(F.col("__rank") == 1, F.col(label))).alias("top_label"),
        F.max(F.when(F.col("__rank") == 1, F.col(value))).alias("__top"),
        F.sum(value).alias("__lead"),
    )
    joined = totals.join(largest, by)
    return joined.select(
        *by,
        "components",
        "top_label",
        share_of("__top", "total").alias("top_share"),
        F.when(F.col("components") > lead, share_of("__lead", "total")).alias("lead_share"),
    )


def trend_summary(aggregates: DataFrame, by: list[str]) -> DataFrame:
    """First and last year with a figure, the change between them, and the latest execution."""
    year = F.col("fiscal_year")

    def when_known(c: Column | str) -> Column:
        return F.when(col(c).isNotNull(), year)

    ends = aggregates.groupBy(*by).agg(
        F.min(when_known("updated")).alias("first_year"),
        F.max(when_known("updated")).alias("last_year"),
        F.min_by("updated", when_known("updated")).alias("first_value"),
        F.max_by("updated", when_known("updated")).alias("last_value"),
        F.max(when_known("execution")).alias("execution_year"),
        F.max_by(F.struct("execution", "updated", "execution_is_estimate"), when_known("execution")).alias("__latest"),
    )
    changed = F.when(F.col("last_year") > F.col("first_year"), change_percent("first_value", "last_value"))
    return ends.filter(F.col("first_year").isNotNull()).select(
        *by,
        "first_year",
        "last_year",
        changed.alias("change_percent"),
        "execution_year",
        share_of(F.col("__latest.execution"), F.col("__latest.updated")).alias("execution_rate"),
        F.col("__latest.execution_is_estimate").alias("execution_is_estimate"),
    )
