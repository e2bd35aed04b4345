"""Reading tables, shards, grids and pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from publedger.operators.common import first_per_group
from publedger.session import cut_lineage

ROWS_PER_RESOURCE = 6_000
UNATTRIBUTED = "unattributed"


class IncompletePages(ValueError):
    """Collected rows do not add up to the declared total."""


def load_tables(
    spark: SparkSession, folder: str, names: list[str], schemas: dict[str, StructType] | None = None, fmt: str = "parquet"
) -> dict[str, DataFrame]:
    """Named datasets of a folder as DataFrames, ``name.parquet`` or ``name.json`` (an array file)."""
    schemas = schemas or {}
    tables = {}
    for name in names:
        reader = spark.read
        if name in schemas:
            reader = reader.schema(schemas[name])
        path = f"{folder}/{name}.{fmt}"
        tables[name] = reader.json(path, multiLine=True) if fmt == "json" else reader.parquet(path)
    return tables


def load_shard(spark: SparkSession, folder: str, key: str, column: str = "section_id") -> DataFrame:
    """One shard of a partitioned table. Only its folder is read; an unknown key gives no rows."""
    return spark.read.parquet(folder).filter(F.col(column) == F.lit(key))


_FRAGMENTS = "file string, block long, place int, record string"
#: ``place`` of a piece of text in its block: the end of a record of an earlier block, a whole record, the first
#: record of a file, the start of a record that goes on, and a block inside one field.
ENDING, WHOLE, FIRST, OPEN, WITHIN = range(5)


def _split_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of blocks, in order, to whole records and to the fragments at the edges of blocks.

    A line with an odd number of quotes opens or closes a quoted field. Lines that are records by
    themselves pass as they are; only records of several lines are put together.
    """
    here, odd, held = None, False, []  # held: the lines of the record that is open
    places: list[int] = []
    records: list[str] = []

    def put(place: int) -> None:
        places.append(place)
        records.append("\n".join(held))
        held.clear()

    def leave() -> None:
        if held:
            put(WITHIN if inherited else OPEN)

    inherited = False  # the open record began in an earlier block
    for batch in batches:
        keys = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("odd").to_pylist()))
        lines = batch.column("value").to_pylist()
        parity = pc.bit_wise_and(pc.count_substring(batch.column("value"), '"'), 1).to_numpy(zero_copy_only=False)
        changes = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
        for begin, end in zip(changes, [*changes[1:], len(keys)]):
            if keys[begin][:2] != here:
                leave()
                if places:
                    yield _fragments(here, places, records)
                    places, records = [], []
                here, odd = keys[begin][:2], keys[begin][2]
                inherited, first = odd, here[1] == 0
            for line, flips in zip(lines[begin:end], parity[begin:end]):
                held.append(line)
                odd ^= bool(flips)
                if not odd:
                    put(ENDING if inherited else FIRST if first else WHOLE)
                    inherited = first = False
        if places:
            yield _fragments(here, places, records)
            places, records = [], []
    leave()
    if places:
        yield _fragments(here, places, records)


def _fragments(here: tuple[str, int], places: list[int], records: list[str]) -> pa.RecordBatch:
    n = len(places)
    columns = [pa.array([here[0]] * n), pa.array([here[1]] * n, pa.int64()), pa.array(places, pa.int32()), pa.array(records, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["file", "block", "place", "record"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, is_first, record``: the records of quoted CSV files, line breaks inside fields included.

    Files are read in byte ranges by as many tasks as plain text. The quotes of each range are counted
    first; their running sum says which ranges begin inside a quoted field, and each range starts at its
    first true record. What a range's edge cuts is put together from the few fragments. Whether a range
    begins inside a field goes to all tasks: at most one small row for each range of the input.
    """
    where = F.col("_metadata")
    lines = spark.read.text(path, lineSep="\n").select("value", where["file_path"].alias("file"), where["file_block_start"].alias("block"))
    quotes = F.length(F.regexp_replace("value", '[^"]', ""))
    blocks = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("flips"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    odd = blocks.withColumn("odd", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2 == 1).filter("odd").select("file", "block", "odd")
    marked = lines.join(F.broadcast(odd), ["file", "block"], "left").select("value", "file", "block", F.coalesce("odd", F.lit(False)).alias("odd"))
    pieces = cut_lineage(marked.mapInArrow(_split_records, _FRAGMENTS), "csv-records")
    whole = pieces.filter(F.col("place").isin(WHOLE, FIRST)).select("file", (F.col("place") == FIRST).alias("is_first"), "record")
    # A record over several ranges: one that opens, any that lie within, one that ends it.
    edges = pieces.filter(~F.col("place").isin(WHOLE, FIRST))
    order = W.partitionBy("file").orderBy("block", "place").rowsBetween(W.unboundedPreceding, 0)
    numbered = edges.withColumn("n", F.count_if(F.col("place") == OPEN).over(order))
    parts = F.array_sort(F.collect_list(F.struct("block", "place", "record")))
    joined = numbered.groupBy("file", "n").agg(parts.alias("parts"), F.min("block").alias("block"))
    stitched = joined.select("file", F.lit(False).alias("is_first"), F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    record = F.regexp_replace("record", "\r$", "")
    return whole.unionByName(stitched).withColumn("record", record).filter(F.col("record") != "")


_CSV = {"quote": '"', "escape": '"', "nullValue": ""}


def read_csv_grid(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV as a grid of text: doubled quotes, line breaks inside fields, optional BOM."""
    shape = spark.read.csv(path, header=False, multiLine=True, encoding="UTF-8", **_CSV).schema  # looks at the first record
    record = F.regexp_replace("record", "^﻿", "")
    cells = csv_records(spark, path).select(F.from_csv(record, shape.simpleString()[len("struct<") : -1].replace(":", " "), _CSV).alias("r"))
    return cells.select("r.*")


def one_header(grid: DataFrame, header: list[str]) -> DataFrame:
    """A grid read from the part files of one export, each with the header row: that row once.

    A row of data that repeats the whole header cannot be told from one and goes with it.
    """
    is_header = F.lit(True)
    for column, title in zip(grid.columns, header):
        is_header = is_header & F.col(column).eqNullSafe(F.lit(title))
    return grid.filter(~is_header).unionByName(grid.filter(is_header).limit(1))


def read_csv_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Quoted CSV with a header row in each file as a table."""
    shape = schema or spark.read.csv(path, header=True, multiLine=True, **_CSV).schema
    named = StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(shape)])
    rows = csv_records(spark, path).filter(~F.col("is_first"))
    cells = rows.select(F.from_csv("record", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named), _CSV).alias("r"))
    return cells.select(*[F.col(f"r.c{k}").alias(f.name) for k, f in enumerate(shape)])


def reconcile_pages(pages: DataFrame, declared: DataFrame, by: str = "query") -> DataFrame:
    """Queries whose collected rows differ from the total the source declared.

    ``pages`` has one row per collected row; ``declared``: *by*, total.
    """
    collected = pages.groupBy(by).agg(F.count("*").alias("collected"))
    return (
        declared.join(collected, by, "left")
        .withColumn("collected", F.coalesce("collected", F.lit(0)))
        .filter(F.col("total").isNotNull() & (F.col("collected") != F.col("total")))
        .select(by, "collected", "total")
    )


def require_complete(pages: DataFrame, declared: DataFrame, by: str = "query") -> None:
    """Refuse to go on with a silently truncated set."""
    short = reconcile_pages(pages, declared, by).orderBy(by).take(5)
    if short:
        raise IncompletePages("; ".join(f"{r[by]}: {r['collected']} of {r['total']} rows" for r in short))


def cap_rows(df: DataFrame, by: list[str], order: list, n: int = ROWS_PER_RESOURCE) -> DataFrame:
    """First ``n`` rows per resource, with ``truncated`` where the resource held more."""
    kept = first_per_group(df, by, order, n)
    sizes = df.groupBy(*by).agg((F.count("*") > n).alias("truncated"))
    return kept.join(sizes, by)

