"""Writing CSV exports, shards, and the record of collection attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from publedger.functions.web import url_host
from publedger.sources.tables import UNATTRIBUTED

BOM = "﻿"


def csv_columns(df: DataFrame) -> DataFrame:
    """Arrays joined by ``; `` and everything as text, the way an export shows it."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.dataType.typeName() == "array":
            c = F.array_join(c.cast("array<string>"), "; ")
        out.append(c.cast("string").alias(field.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """CSV files with CRLF lines, quoted where needed, missing values empty, BOM on the header."""
    text = csv_columns(df)
    if bom:
        text = text.withColumnRenamed(text.columns[0], BOM + text.columns[0])
    text.write.csv(
        path, header=True, quote='"', escape='"', lineSep="\r\n", nullValue="", emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, encoding="UTF-8",
    )


def shard_index(df: DataFrame, key: str) -> DataFrame:
    """Key, folder and row count of every shard; rows without a key are ``unattributed``."""
    shard = F.coalesce(F.col(key).cast("string"), F.lit(UNATTRIBUTED))
    return (
        df.groupBy(shard.alias("shard_key"))
        .agg(F.count("*").alias("entry_count"))
        .withColumn("file", F.concat(F.lit(f"{key}="), F.col("shard_key")))
    )


def write_shards(df: DataFrame, key: str, path: str) -> DataFrame:
    """One folder per key value, and the index of what was written.

    Rows are spread by key and a few salts, so a key with a large share of the rows is written
    by several tasks and no key is scattered over all of them.
    """
    keyed = df.withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit(UNATTRIBUTED)))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in keyed.columns]), F.lit(8))
    keyed.repartition(F.col(key), salt).write.partitionBy(key).parquet(path)
    return shard_index(df.sparkSession.read.parquet(path), key)


def attempt_summary(attempts: DataFrame) -> DataFrame:
    outcome = F.col("outcome")
    return attempts.agg(
        F.count("*").alias("total"),
        F.count_if(outcome == "ok").alias("ok"),
        F.count_if(outcome == "blocked").alias("blocked"),
        F.count_if(~outcome.isin("ok", "blocked")).alias("failed"),
    )


def attempt_hosts(attempts: DataFrame) -> DataFrame:
    """Hosts our side blocked and hosts that refused us, with counts. They mean different things."""
    kind = F.when(F.col("outcome") == "blocked", F.lit("blocked")).when(
        (F.col("outcome") == "http_error") & (F.col("http_status") >= 400), F.lit("refused")
    )
    classed = attempts.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    return classed.groupBy(url_host("url").alias("host"), "kind").agg(F.count("*").alias("attempts"))
