"""Building blocks that keep large or skewed groups out of single tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from publedger.functions.numbers import col

#: Shares that a group's rows are dealt to before the last cut of a top-k.
SALTS = 64
#: Shares of a group at which its histogram is cut; close together around the middle.
EDGES = [0.25, 0.45, 0.49, 0.499, 0.501, 0.51, 0.55, 0.75]
ACCURACY = 10_000


def first_per_group(df: DataFrame, by: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of every group.

    Each task cuts its own share of a group to ``n`` rows, shares are merged and cut again in
    ``SALTS`` tasks, and only what is left of those meets in one task; so a hot group never does.
    A single row needs no middle step, since a task leaves one row of each group.
    """
    rank_name = rank or "__rank"
    rows = df
    if n > 1:
        dealt = df.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        local = F.row_number().over(W.partitionBy(*by, "__salt").orderBy(*order))
        rows = dealt.withColumn("__local", local).filter(F.col("__local") <= n).drop("__salt", "__local")
    ranked = rows.withColumn(rank_name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    kept = ranked.filter(F.col(rank_name) <= n)
    return kept if rank else kept.drop(rank_name)


def middle_values(df: DataFrame, by: list[str], value: Column | str) -> DataFrame:
    """Exact middle of every group: ``by, n, lo, hi`` with positions (n-1)/2 and n/2 from below.

    Approximate quantiles cut each group into buckets by rank, so heavy tails do not fill one of
    them. Exact counts find the bucket of each position, and only the distinct values of that
    bucket, some 0.2 % of the group, are ordered. Values are compared in their own type; a poor
    approximation costs time and never the result.
    """
    keyed = df.select(*by, col(value).alias("__v")).filter(F.col("__v").isNotNull())
    counts = keyed.groupBy(*by, "__v").agg(F.count("*").alias("__c"))
    edges = keyed.groupBy(*by).agg(F.percentile_approx("__v", EDGES, ACCURACY).alias("__edges"), F.count("*").alias("n"))
    placed = counts.join(edges, by).withColumn("__b", F.size(F.filter("__edges", lambda e: e <= F.col("__v")))).drop("__edges")
    running = W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    histogram = (
        placed.groupBy(*by, "n", "__b")
        .agg(F.sum("__c").alias("__bc"))
        .withColumn("__before", F.coalesce(F.sum("__bc").over(running), F.lit(0)))
    )
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    wanted = histogram.filter(
        (low < F.col("__before") + F.col("__bc")) & (high >= F.col("__before"))
    ).select(*by, "__b", "__before")
    inside = W.partitionBy(*by, "__b").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    ordered = placed.join(wanted, [*by, "__b"]).withColumn("__upto", F.col("__before") + F.sum("__c").over(inside))
    start = F.col("__upto") - F.col("__c")

    def at(position: Column) -> Column:
        return F.max(F.when((start <= position) & (position < F.col("__upto")), F.col("__v"))).cast("double")

    return ordered.groupBy(*by, "n").agg(at(low).alias("lo"), at(high).alias("hi"))


def fixed_rows(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal table in the session of ``df``, inlined into the plan."""
    return df.sparkSession.createDataFrame(rows, schema)
