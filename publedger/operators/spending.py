"""Where the money goes: economic use, themes, shifts and volatility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from publedger.functions.numbers import one_decimal_percent, share_of

ALL = "all"


def _scope(df: DataFrame, section: str = ALL, year: int | None = None) -> DataFrame:
    if section != ALL:
        df = df.filter(F.col("section_id") == section)
    if year is not None:
        df = df.filter(F.col("fiscal_year") == year)
    return df


def usage_breakdown(lines: DataFrame, kind: str = "1", depth: int = 4) -> tuple[DataFrame, DataFrame]:
    """Use of money by section, year and two economic levels; and the rejected lines.

    ``lines``: section_id, fiscal_year, kind, depth, is_proposal, econ1, econ2 (already read
    as labels, null when ambiguous), allocated, revised, executed.
    """
    chosen = lines.filter((F.col("kind") == kind) & (F.col("depth") == depth) & ~F.col("is_proposal"))
    clear = F.col("econ1").isNotNull() & F.col("econ2").isNotNull() & F.col("fiscal_year").isNotNull()
    usage = (
        chosen.filter(clear)
        .groupBy("section_id", "fiscal_year", "econ1", "econ2")
        .agg(
            F.sum("allocated").alias("allocated"),
            F.sum("revised").alias("revised"),
            F.sum("executed").alias("executed"),
            F.count("*").alias("line_count"),
        )
    )
    rejected = chosen.filter(~clear).groupBy("section_id").agg(F.count("*").alias("rejected_lines"))
    return usage, rejected


def usage_coverage(usage: DataFrame, items: DataFrame, years: list[int]) -> DataFrame:
    """Classified sum against the section's own level-1 figure, for every section and year."""
    key = ["section_id", "fiscal_year"]
    spine = (
        items.select("section_id")
        .distinct()
        .select("section_id", F.explode(F.array(*[F.lit(y) for y in years])).alias("fiscal_year"))
    )
    classified = usage.groupBy(*key).agg(F.sum(F.coalesce("revised", F.lit(0))).alias("__sum"))
    sections = (
        items.filter(F.col("level") == 1).groupBy(*key).agg(F.min_by("updated", "code").alias("section_total"))
    )
    joined = spine.join(classified, key, "left").join(sections, key, "left")
    total = F.coalesce("__sum", F.lit(0))
    return joined.select(
        *key,
        total.alias("classified_sum"),
        "section_total",
        share_of(total, "section_total").alias("coverage_percent"),
    )


def coverage_gaps(coverage: DataFrame, low: float = 99.5, high: float = 100.5) -> DataFrame:
    percent = F.col("coverage_percent")
    return coverage.filter((percent < low) | (percent > high))


def usage_series(usage: DataFrame, section: str, years: list[int]) -> DataFrame:
    """Revised money per year and category in long form, categories ordered by total.

    A year in which a category has no row stays null; a row without a figure counts as 0.
    """
    scoped = _scope(usage, section)
    revised = F.sum(F.coalesce("revised", F.lit(0)))
    yearly = scoped.groupBy("econ1", "fiscal_year").agg(revised.alias("value"))
    totals = yearly.groupBy("econ1").agg(F.sum("value").alias("__total"))
    ordered = totals.withColumn("position", F.row_number().over(W.orderBy(F.desc("__total"), "econ1")))
    spine = ordered.select("econ1", "position", F.explode(F.array(*[F.lit(y) for y in years])).alias("fiscal_year"))
    return spine.join(yearly, ["econ1", "fiscal_year"], "left").select("econ1", "position", "fiscal_year", "value")


def usage_pivot(usage: DataFrame, section: str, years: list[int], categories: list[str]) -> DataFrame:
    """The same series with one column per category, for a category list known beforehand."""
    series = usage_series(usage, section, years)
    return series.groupBy("fiscal_year").pivot("econ1", categories).agg(F.max("value"))


def _positive_share(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``share``: percent of the positive total of ``by``; null for rows at or below zero."""
    positive = F.sum(F.when(F.col(value) > 0, F.col(value))).over(W.partitionBy(*by))
    return df.withColumn("share", F.when(F.col(value) > 0, one_decimal_percent(F.col(value), positive)))


def usage_detail(usage: DataFrame, section: str, year: int) -> DataFrame:
    """Both economic levels of one year with the share of the positive total."""
    merged = (
        _scope(usage, section, year)
        .groupBy("fiscal_year", "econ1", "econ2")
        .agg(
            F.sum("allocated").alias("allocated"),
            F.sum("revised").alias("revised"),
            F.sum("executed").alias("executed"),
            F.sum("line_count").alias("line_count"),
        )
    )
    return _positive_share(merged, "revised", ["fiscal_year"])


def per_hundred(usage: DataFrame, by: list[str], section: str = ALL) -> DataFrame:
    """Split of 100 money units by main category over positive rows, per group of ``by``."""
    split = (
        _scope(usage, section)
        .filter(F.col("revised") > 0)
        .groupBy(*by, "econ1")
        .agg(F.sum("revised").alias("amount"))
    )
    return _positive_share(split, "amount", by).withColumnRenamed("share", "per_hundred")


def per_hundred_latest(usage: DataFrame) -> DataFrame:
    """The split of the latest year that has one."""
    yearly = per_hundred(usage, ["fiscal_year"])
    latest = yearly.agg(F.max("fiscal_year").alias("fiscal_year"))
    return yearly.join(latest, "fiscal_year", "left_semi")


def scale_split(split: DataFrame, amount: float, by: list[str]) -> DataFrame:
    """A split scaled to an amount of money."""
    total = F.sum("per_hundred").over(W.partitionBy(*by))
    scaled = F.try_divide(F.lit(float(amount)) * F.col("per_hundred"), total)
    return split.withColumn("scaled", scaled)


def theme_aggregates(items: DataFrame, assignments: DataFrame, themes: DataFrame, by: list[str]) -> DataFrame:
    """Leaf money per theme with its share of the positive total; empty themes do not appear.

    Members are counted; list them with :func:`theme_members`.
    """
    members = theme_members(items, assignments, themes)
    merged = members.groupBy(*by, "theme_id").agg(
        F.sum("original").alias("original"),
        F.sum("updated").alias("updated"),
        F.sum("execution").alias("execution"),
        F.count("*").alias("members"),
    )
    return _positive_share(merged, "updated", by)


def theme_members(items: DataFrame, assignments: DataFrame, themes: DataFrame) -> DataFrame:
    leaves = items.filter("is_leaf").withColumn("execution", F.coalesce("actual", "estimated"))
    assigned = assignments.select("section_id", "code", "theme_id")
    return leaves.join(assigned, ["section_id", "code"]).join(themes.select("theme_id"), "theme_id", "left_semi")


def top_shifts(items: DataFrame, assignments: DataFrame, year: int, n: int, section: str = ALL) -> DataFrame:
    """Largest original → updated shifts among leaves by absolute size."""
    delta = F.col("updated") - F.col("original")
    shifts = (
        _scope(items, section, year)
        .filter(F.col("is_leaf") & (delta != 0))
        .withColumn("delta", delta)
        .withColumn("delta_percent", one_decimal_percent(delta, F.col("original")))
        .orderBy(F.desc(F.abs("delta")), "section_id", "code")
        .limit(n)
    )
    assigned = assignments.select("section_id", "code", "theme_id")
    return shifts.join(assigned, ["section_id", "code"], "left")


def volatility(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How much of the original budget was rewritten in the year, whatever the direction."""
    by = by or ["section_id", "fiscal_year"]
    leaves = items.filter(F.col("is_leaf") & F.col("original").isNotNull() & F.col("updated").isNotNull())
    moved: Column = F.abs(F.col("updated") - F.col("original"))
    sums = leaves.groupBy(*by).agg(
        F.sum(moved).alias("sum_abs_delta"),
        F.sum(F.abs("original")).alias("sum_original"),
        F.count("*").alias("leaf_count"),
    )
    return sums.withColumn("index_percent", share_of("sum_abs_delta", "sum_original"))


def volatility_ranking(items: DataFrame, year: int) -> DataFrame:
    """Sections of one year by volatility, sections without an index left out."""
    index = volatility(items.filter(F.col("fiscal_year") == year)).filter(F.col("index_percent").isNotNull())
    order = W.partitionBy("fiscal_year").orderBy(F.desc("index_percent"), "section_id")  # one row for each section
    return index.withColumn("position", F.row_number().over(order))
