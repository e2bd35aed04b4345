"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Documents of a source stand in shuffled order. A copy's virtual finish time is the running words
of its source up to its end, divided by the source's target; a second or third round of a small
source goes on where the first ended. All copies of all sources are range-sorted by that time, and
the queue is cut where the running total reaches the budget. A copy that is being served at that
moment gives the words served so far, as in the fluid model, so every source ends at its target.

No source is sorted by one task: its order is cut into ranges of the shuffle key, whose sums give
the offsets. Totals over the whole queue come from the sums of the range partitions.

Defined cases: null texts have 0 words; documents of 0 words are returned with 0 taken; a null
source is a source, the last; a null doc_id is shuffled like any id; rows that repeat a doc_id count each; other columns are ignored;
an empty table gives an empty result; if all sizes are 0 all targets are 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from publedger.llm.common import WORD_CLASS
from publedger.session import cut_lineage

WEIGHTS = (1, 2, 3)
MOST_ROUNDS = 3
SEED = 17
KEY_BITS = 60
#: Rows of a range of the shuffle key, and of a range partition of the queue.
ROWS_PER_RANGE = 20_000
ROWS_PER_PARTITION = 100_000


def running_total(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all rows that come earlier in ``order``."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_PARTITION))
    ranged = cut_lineage(rows.repartitionByRange(tasks, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("__part").agg(F.sum(value).alias("__sum"))
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row for each partition
    offsets = sums.select("__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"))
    inside = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(offsets), "__part")
    return placed.withColumn(name, F.col("__offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__part", "__offset")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_ROUNDS) -> DataFrame:
    """``source, source_size, target``. Weights repeat over the sources in code point order; no target
    exceeds ``most`` times its source, and what that leaves is reshared by weight."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.lit(1).alias("one"))
    ranked = running_total(sums, [F.col("source").asc_nulls_last()], "one", "earlier")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.select("source", "source_size", F.element_at(cycle, (F.pmod("earlier", F.lit(len(weights))) + 1).cast("int")).alias("weight"))
    sources = cut_lineage(weighed.withColumn("bound", F.col("source_size") * float(most)), "sources")
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:  # the level of words for each unit of weight rises until no target is above its bound
        capped = F.col("bound") < level * F.col("weight")
        row = sources.agg(
            F.coalesce(F.sum(F.when(capped, F.col("bound"))), F.lit(0.0)).alias("capped"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        higher = (budget - row["capped"]) / row["open"] if row["open"] else level
        if higher <= level:
            break
        level = higher
    return sources.select("source", "source_size", F.least("bound", F.col("weight") * level).alias("target"))


def shuffle_key(name: str, seed: int) -> Column:
    """A number below 2^60 from the id, the same on every platform."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(name).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def queue(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_ROUNDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The documents with size, source_size and target, and the mix in its order: one row for each
    copy served, with its round, virtual finish time, words and the words served before it."""
    sizes = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id"),
        F.col("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD_CLASS)), F.lit(0)).cast("long").alias("size"),
        shuffle_key("doc_id", seed).alias("key"),
    )
    sized = cut_lineage(sizes, "sizes")
    targets = cut_lineage(source_targets(sized, weights, most), "targets").withColumnRenamed("source", "s")
    placed = cut_lineage(sized.join(targets, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "placed")

    bits = max(8, math.ceil(math.log2(max(1, placed.count()) / ROWS_PER_RANGE + 1)))
    ranges = placed.filter("size > 0").withColumn("range", F.shiftright("key", KEY_BITS - bits))
    sums = ranges.groupBy("source", "range").agg(F.sum("size").alias("words"))
    earlier = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut_lineage(sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset")), "offsets")
    within = W.partitionBy("source", "range").orderBy("key", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    started = ranges.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))
    started = started.join(offsets, same).withColumn("first", F.col("offset") + F.col("within"))

    copies = F.ceil((F.col("target") - F.col("first")) / F.col("source_size")).cast("int")
    rounds = started.filter("first < target").withColumn("round", F.explode(F.sequence(F.lit(0), F.least(copies, F.lit(most)) - 1)))
    start = F.col("round") * F.col("source_size") + F.col("first")
    copied = rounds.select(
        "row", "doc_id", "source", "size", "round", "key",
        ((start + F.col("size")) / F.col("target")).alias("virtual_finish"),
        F.least(F.col("size"), F.floor("target") - start).alias("words"),
    ).filter("words > 0")
    budget = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    order = [F.least("virtual_finish", F.lit(1.0)), F.col("virtual_finish"), F.col("key"), F.col("round"), F.col("row")]
    sorted_queue = running_total(copied, order, "words", "served_before").filter(F.col("served_before") < budget)
    return placed, sorted_queue.withColumn("words", F.least("words", F.lit(budget) - F.col("served_before"))).drop("key")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_ROUNDS) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row of ``docs``."""
    placed, mix = queue(docs, weights, most)
    taken = mix.groupBy("row").agg(F.sum("words").alias("words"))
    rows = placed.join(taken, "row", "left")
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))
