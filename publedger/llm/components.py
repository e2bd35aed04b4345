"""Connected components of a link table by rounds of contraction.

Each round every node points to its smallest neighbour (by a hash order, so that chains stay short),
pointers are doubled once, and links are renamed to what they point to; the graph that is left shrinks
by a constant share each round. Nodes with very many links only meet partial aggregation and joins
between written tables, which Spark splits when they are skewed. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from publedger.session import cut_lineage

MAX_ROUNDS = 64


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a``, ``b``, longs, either direction, repeats and
    self-links allowed). ``root`` is one node of the component, the same for all its nodes.
    An empty table gives an empty table."""
    named = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = cut_lineage(named, "links")
    roots = None
    for _ in range(MAX_ROUNDS):
        if not left.limit(1).count():
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("n"))
        nearest = both.groupBy("a").agg(F.min(order).alias("m"))
        itself = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("n"))
        points = cut_lineage(nearest.select(F.col("a").alias("node"), F.least("m", itself)["n"].alias("root")), "points")
        jump = points.select(F.col("node").alias("root"), F.col("root").alias("next"))
        points = cut_lineage(points.join(jump, "root").select("node", F.col("next").alias("root")), "points")
        at_a = points.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        at_b = points.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        half = left.join(at_a, "a").select("ra", "b")
        renamed = half.join(at_b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        left = cut_lineage(renamed.distinct(), "links")
        if roots is None:
            roots = points
        else:
            step = points.select(F.col("node").alias("root"), F.col("root").alias("next"))
            moved = roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            roots = cut_lineage(moved, "roots")
    else:
        raise RuntimeError(f"components are not found after {MAX_ROUNDS} rounds")
    return links.sparkSession.createDataFrame([], "node long, root long") if roots is None else roots
