"""Cleaning and mixing a corpus of documents, stage by stage.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again
as the ``docs`` of the next one, so that a lost executor costs at most one stage. The last stage
returns the mix: every document that came through, with the words the mix takes of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from publedger.llm import decontaminate, line_dedup, mixing, near_copies, toxicity
from publedger.llm.common import table
from publedger.session import cut_lineage


def whole(docs: DataFrame) -> Column:
    """All columns as one, so that none is lost to a result of the same name."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept")


def no_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are scored toxic go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs.select("text", whole(docs)), model, carry=["kept"]).filter("predicted = 0").select("kept.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller doc_id holds go; ``n_chars`` of a text that loses some is counted again."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = F.struct(F.lit(1).alias("__row"), *[F.col(f"`{c}`") for c in rest]).alias("kept")  # a struct needs a field
    cleaned = line_dedup.dedup_lines(docs.select("doc_id", "text", kept))
    out = {c: F.col(f"`{c}`") if c not in rest else F.col(f"kept.`{c}`") for c in docs.columns}
    if "n_chars" in rest:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out["n_chars"] = F.when(F.col("n_dropped") > 0, length).otherwise(out["n_chars"])
    return cleaned.select(*[value.alias(c) for c, value in out.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 or more (five-word shingles, compared exactly)
    the document with the smallest doc_id stays."""
    return near_copies.one_of_each(docs)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.find_leaks(docs.select("text", whole(docs)), table(spark, sf_dir, "benchmark"), carry=["kept"])
    return found.filter(~F.col("contaminated")).select("kept.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken``: what the mix takes of each document."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", no_toxic),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", no_leaks),
    ("mixing sources", mix),
]

#: No SQL: the first stage learns and the third hashes. Tests hold the third beside all pairs, and columns, kept rows and the mix of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of ``documents`` after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
