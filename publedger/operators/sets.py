"""Unions, gaps and reconciliation between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from publedger.functions.dates import published_quarters, quarter_index, quarter_label


def union_feeds(feeds: dict[str, DataFrame]) -> DataFrame:
    """Several feeds under one another with a ``feed`` tag; missing columns become null."""
    tagged = [df.withColumn("feed", F.lit(name)) for name, df in feeds.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def publication_gaps(entries: DataFrame, publications: DataFrame) -> DataFrame:
    """Quarters without a row between a person's first and last quarter.

    ``unread`` marks quarters a publication says it covers: those were published and not
    read, and are no gap of the person's.
    """
    quarters = (
        entries.filter(F.col("date").isNotNull())
        .select("person_key", quarter_index("date").alias("q"))
        .distinct()
    )
    spine = (
        quarters.groupBy("person_key")
        .agg(F.min("q").alias("__first"), F.max("q").alias("__last"))
        .select("person_key", F.explode(F.sequence("__first", "__last")).alias("q"))
    )
    stated = (
        publications.select("person_key", F.explode(published_quarters("period_label")).alias("quarter"))
        .distinct()
        .withColumn("__stated", F.lit(True))
    )
    return (
        spine.join(quarters, ["person_key", "q"], "left_anti")
        .select("person_key", quarter_label(F.col("q")).alias("quarter"))
        .join(stated, ["person_key", "quarter"], "left")
        .select("person_key", "quarter", F.coalesce("__stated", F.lit(False)).alias("unread"))
    )


def reconcile_keys(assigned: DataFrame, collected: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that do not agree between two tables, with the reason.

    ``assigned`` and ``collected`` carry ``keys`` and ``title``. Reasons: stale (assigned but
    not collected), missing (collected but not assigned), duplicate, retitled.
    """
    left = assigned.groupBy(*keys).agg(F.max("title").alias("__a"), F.count("*").alias("__n"))
    right = collected.groupBy(*keys).agg(F.max("title").alias("__b"), F.lit(True).alias("__there"))
    joined = left.join(right, keys, "full_outer")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("__n") > 1, F.lit("duplicate")),
            F.when(F.col("__n").isNull(), F.lit("missing")),
            F.when(F.col("__there").isNull(), F.lit("stale")),
            F.when(F.col("__a") != F.col("__b"), F.lit("retitled")),
        )
    )
    return joined.select(*keys, F.explode(reasons).alias("reason"))
