"""Queries that go through readers and writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from publedger.plans.registry import query
from publedger.session import fresh_path
from publedger.sources import bindings as b
from publedger.sources import sinks, tables

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@query("src1_load_tables", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in NAMES))
def _(spark, d):
    loaded = tables.load_tables(spark, d, NAMES)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in loaded.items()]
    return reduce(DataFrame.unionByName, counts)


@query("src2_load_shard", "SELECT entry_id, subject FROM diary WHERE section_id = 'S3'")
def _(spark, d):
    path = fresh_path(spark, "shards")
    sinks.write_shards(b.diary(spark, d), "section_id", path)
    return tables.load_shard(spark, path, "S3").select("entry_id", "subject")


@query(
    "snk2_write_shards",
    "SELECT coalesce(section_id, 'unattributed') AS shard_key, count(*) AS entry_count, 'section_id=' || coalesce(section_id, 'unattributed') AS file FROM diary GROUP BY 1",
)
def _(spark, d):
    return sinks.write_shards(b.diary(spark, d), "section_id", fresh_path(spark, "shards"))


@query(
    "src3_csv_round_trip",
    """SELECT id, title, replace(summary, chr(13) || chr(10), chr(10)) AS summary, array_to_string(topics, '; ') AS topics, CASE WHEN len(people) > 0 THEN array_to_string(people, '; ') END AS people, CAST(date AS VARCHAR) AS date FROM acts""",
)
def _(spark, d):
    path = fresh_path(spark, "csv")
    columns = ["id", "title", "summary", "topics", "people", "date"]
    sinks.write_csv(b.activities(spark, d).select(*columns), path)
    shape = StructType([StructField(c, StringType()) for c in columns])
    back = tables.read_csv_table(spark, path, shape)
    return back.withColumn("summary", F.replace("summary", F.lit("\r\n"), F.lit("\n")))


@query(
    "src3_csv_grid",
    "SELECT c_mktsegment AS first_cell, 'row' AS header, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'c_mktsegment', 'header', 1",
)
def _(spark, d):
    path = fresh_path(spark, "grid")
    rows = b.read(spark, d, "customer").select("c_mktsegment", "c_name")
    sinks.write_csv(rows, path)
    grid = tables.one_header(tables.read_csv_grid(spark, path), rows.columns)
    first = grid.columns[0]
    kind = F.when(F.col(first) == "c_mktsegment", "header").otherwise("row")
    return grid.groupBy(F.col(first).alias("first_cell"), kind.alias("header")).agg(F.count("*").alias("n"))


@query(
    "src4_reconcile_pages",
    """SELECT l_orderkey AS query, count(*) AS collected, CAST(max(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1 HAVING count(*) <> max(l_linenumber)""",
)
def _(spark, d):
    lines = b.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), "l_linenumber")
    declared = lines.groupBy("query").agg(F.max("l_linenumber").cast("bigint").alias("total"))
    return tables.reconcile_pages(lines, declared)


@query(
    "src5_cap_rows",
    """SELECT event_type, event_id, n > 1500 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE rn <= 1500""",
)
def _(spark, d):
    rows = b.read(spark, d, "events").select("event_type", "event_id")
    return tables.cap_rows(rows, ["event_type"], [F.col("event_id")], 1500)


@query(
    "src5_cap_rows_small",
    """SELECT user_id, event_id, n > 20 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn <= 20""",
)
def _(spark, d):
    return tables.cap_rows(b.read(spark, d, "events").select("user_id", "event_id"), ["user_id"], [F.col("event_id")], 20)


@query(
    "snk1_csv_text",
    """SELECT id, array_to_string(topics, '; ') AS topics, CASE WHEN len(people) > 0 THEN array_to_string(people, '; ') ELSE '' END AS people, CAST(seq AS VARCHAR) AS seq FROM acts""",
)
def _(spark, d):
    return sinks.csv_columns(b.activities(spark, d).select("id", "topics", "people", "seq"))


@query(
    "snk3_attempt_summary",
    "SELECT count(*) AS total, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'blocked') AS blocked, count(*) FILTER (outcome NOT IN ('ok', 'blocked')) AS failed FROM att",
)
def _(spark, d):
    return sinks.attempt_summary(b.attempts(spark, d))


@query(
    "snk4_attempt_hosts",
    """SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, CASE WHEN outcome = 'blocked' THEN 'blocked' ELSE 'refused' END AS kind, count(*) AS attempts FROM att
       WHERE outcome = 'blocked' OR (outcome = 'http_error' AND http_status >= 400) GROUP BY 1, 2""",
)
def _(spark, d):
    return sinks.attempt_hosts(b.attempts(spark, d))

