"""The ranked insight feed. A generator without data gives no row.

Every insight has the same columns: insight_id, kind, section_id, figure, second_figure,
field_size, strength. Wording is left to whoever displays them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from publedger.functions.numbers import share_of
from publedger.operators.hierarchy import YEAR_KEY, sum_no_double_count
from publedger.operators.ranking import rank_anomalies

MIN_CONTRACTS, MIN_ROWS, MIN_SECTIONS = 200, 500, 3
# How strongly each kind of insight leads the page.
STRENGTH = {
    "unused_balance": 92.0,
    "in_year_growth": 84.0,
    "exempt_tender": 78.0,
    "no_topic": 74.0,
    "unread": 70.0,
    "transparency_spread": 66.0,
}
ANOMALY_CEILING = 90.0


def _row(df: DataFrame, insight: str, kind: str, section, figure, second, field_size, strength: Column | None = None):
    value = strength if strength is not None else F.lit(STRENGTH[insight])
    return df.select(
        F.lit(insight).alias("insight_id"),
        F.lit(kind).alias("kind"),
        section.cast("string").alias("section_id"),
        figure.cast("double").alias("figure"),
        second.cast("double").alias("second_figure"),
        field_size.cast("bigint").alias("field_size"),
        value.cast("double").alias("strength"),
    )


def _year_totals(items: DataFrame, year: int) -> DataFrame:
    return sum_no_double_count(items.filter(F.col("fiscal_year") == year), YEAR_KEY)


def _leader(df: DataFrame, value: str) -> DataFrame:
    """The row with the largest value, carrying how many rows there were.

    The rows are one per section, so a single small window is enough.
    """
    everyone = W.partitionBy(F.lit(0))
    return (
        df.withColumn("__field", F.count("*").over(everyone))
        .withColumn("__rank", F.row_number().over(everyone.orderBy(F.desc(value), "section_id")))
        .filter(F.col("__rank") == 1)
    )


def insight_unused(items: DataFrame, closed_year: int) -> DataFrame:
    """Largest unused balance of the closed year."""
    unused = F.col("updated") - F.col("actual")
    rows = _year_totals(items, closed_year).withColumn("unused", unused)
    top = _leader(rows.filter((F.col("updated") > 0) & (F.col("unused") > 0)), "unused")
    share = share_of("unused", "updated")
    return _row(top, "unused_balance", "execution", F.col("section_id"), F.col("unused"), share, F.col("__field"))


def insight_growth(items: DataFrame, requests: DataFrame, year: int) -> DataFrame:
    """Largest in-year growth in money, with the number of requests held for that year."""
    delta = F.col("updated") - F.col("original")
    rows = _year_totals(items, year).withColumn("delta", delta)
    top = _leader(rows.filter((F.col("original") > 0) & (F.col("delta") > 0)), "delta")
    held = requests.filter(F.col("year") == year).groupBy("section_id").agg(F.count("*").alias("__requests"))
    joined = top.join(held, "section_id", "left")
    percent = share_of("delta", "original")
    return _row(
        joined, "in_year_growth", "budget", F.col("section_id"), F.col("delta"), percent,
        F.coalesce("__requests", F.lit(0)),
    )


def insight_exempt(procurement: DataFrame, min_contracts: int = MIN_CONTRACTS) -> DataFrame:
    """Highest share bought without a tender among sections with enough contracts."""
    rows = procurement.filter((F.col("contract_count") >= min_contracts) & (F.col("exempt_volume_percent") > 0))
    top = _leader(rows, "exempt_volume_percent")
    return _row(
        top, "exempt_tender", "procurement", F.col("section_id"), F.col("exempt_volume_percent"),
        F.col("contract_count"), F.col("__field"),
    )


def insight_no_topic(shares: DataFrame, profiles: DataFrame) -> DataFrame:
    """Share of all rows that record a meeting without saying what it was about."""
    people = profiles.agg(F.count("*").alias("__people"))
    rows = shares.filter(F.col("no_topic_percent").isNotNull()).join(F.broadcast(people), F.lit(True))
    return _row(
        rows, "no_topic", "diary", F.lit(None), F.col("no_topic_percent"), F.col("entries"), F.col("__people")
    )


def insight_unread(states: DataFrame, gaps: DataFrame) -> DataFrame:
    """Quarters published but not read, and sections of which nothing could be read."""
    quarters = gaps.agg(F.count_if("unread").alias("__quarters"))
    sections = states.agg(F.count_if(F.col("state") == "published_not_read").alias("__sections"))
    rows = quarters.join(F.broadcast(sections), F.lit(True)).filter(
        (F.col("__quarters") > 0) | (F.col("__sections") > 0)
    )
    return _row(rows, "unread", "coverage", F.lit(None), F.col("__quarters"), F.col("__sections"), F.col("__sections"))


def insight_anomaly(findings: DataFrame) -> DataFrame:
    """The strongest budget anomaly, its strength capped."""
    ranked = rank_anomalies(findings)
    total = findings.agg(F.count("*").alias("__total"))
    top = ranked.orderBy(F.desc("strength"), F.desc("sort_value"), "section_id", "code", "year", "rule_id").limit(1)
    rows = top.join(F.broadcast(total), F.lit(True))
    return _row(
        rows, "anomaly", "budget", F.col("section_id"), F.col("strength"), F.col("sort_value"), F.col("__total"),
        F.least(F.lit(ANOMALY_CEILING), F.col("strength")),
    )


def insight_spread(scores: DataFrame, min_rows: int = MIN_ROWS, min_sections: int = MIN_SECTIONS) -> DataFrame:
    """Distance between the best and the worst transparency score of well-filled sections."""
    attributed = scores.filter(F.col("section_id").isNotNull())
    rows = attributed.filter(F.col("score").isNotNull() & (F.col("entry_count") > min_rows))
    ends = rows.agg(
        F.count("*").alias("__n"),
        F.max("score").alias("__best"),
        F.min("score").alias("__worst"),
        F.min_by("section_id", F.struct(-F.col("score"), F.col("section_id"))).alias("section_id"),
    ).filter(F.col("__n") >= min_sections)
    gap = F.floor(F.col("__best") - F.col("__worst") + F.lit(0.5))
    return _row(ends, "transparency_spread", "diary", F.col("section_id"), gap, F.col("__worst"), F.col("__n"))


def insights(parts: list[DataFrame]) -> DataFrame:
    """All insights, strongest first."""
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("strength"), "insight_id")
