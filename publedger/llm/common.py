"""What the operators of this package share: text columns in Arrow batches, row packing, hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of the text contracts, for ``bytes.strip`` and as a character class.
SPACE = b" \t\n\x0b\x0c\r"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
ROW = "__row"


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    return [value or b"" for value in batch.column(name).cast(pa.binary()).to_pylist()]


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns beside the whole row as one struct, so that no other name can clash."""
    return docs.select(*names, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW))


def unpacked(rows: DataFrame, columns: list[str], replaced: dict[str, str]) -> DataFrame:
    """The original columns again, some replaced or added by columns of ``rows``."""
    kept = [F.col(f"`{replaced[c]}`").alias(c) if c in replaced else F.col(f"{ROW}.`{c}`").alias(c) for c in columns]
    return rows.select(*kept, *[F.col(f"`{v}`").alias(k) for k, v in replaced.items() if k not in columns])


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` for functions of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def task_count(df: DataFrame, rows: int, per_task: int) -> int:
    """Tasks for work that is heavy for each row, where size in bytes would give too few."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def unsigned(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.uint64)
