"""Line dedup: sharded cuckoo filters in front of exact reference-count tables.

The exact table counts, for every line key, the documents that hold it. A cuckoo filter per shard
holds the keys that two or more documents share. A scan probes the filters first: nearly all lines
are unique and end there, and only hits are looked up in the exact table, so a false hit costs one
lookup and never a line. Documents can be inserted and deleted: a key that reaches a second document
enters its filter, a key that falls back to one leaves it, and deleting what was inserted gives the
earlier index again.

Defined cases: a null or empty text is one empty line; a document without an id is one document
that sorts after all others; rows that repeat a doc_id belong to one document and each is cleaned;
keys under ``min_chars`` code points never count; other columns pass through, and input columns
named as an output are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from publedger.llm.common import ROW, SPACE, map_batches, packed, texts_of, union_all, unpacked
from publedger.session import cut_lineage

MIN_CHARS = 10
#: Sorts after every id, for documents without one.
NO_ID = 2**63 - 1
SLOTS = 4
MAX_KICKS = 500
#: Shards are sized for this many shared keys; bounds the memory of building one filter.
KEYS_PER_SHARD = 1 << 18
LEAST_SHARDS = 64
#: Bytes of filters broadcast at once; more shards are probed in further passes over the keys.
FILTER_BYTES = 64 << 20


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit key of a line; None when it is too short to count."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


class CuckooFilter:
    """Set of 16-byte keys with deletion: 16-bit fingerprints, two buckets of four slots per key."""

    def __init__(self, buckets: int, table: np.ndarray | None = None) -> None:
        self.mask = buckets - 1
        self.table = np.zeros(buckets * SLOTS, dtype=np.uint16) if table is None else table

    @classmethod
    def for_keys(cls, count: int) -> CuckooFilter:
        return cls(1 << max(4, int(np.ceil(np.log2(max(1, count) / (SLOTS * 0.85))))))

    @classmethod
    def built(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of all keys; doubled until they fit."""
        out = cls.for_keys(len(keys))
        while not out.insert(keys):
            out = cls(2 * (out.mask + 1))
        return out

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, dtype=np.uint16).copy()
        return cls(len(table) // SLOTS, table)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``keys``: n × 2 words. Fingerprints (never 0), first and second buckets."""
        prints = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (keys[:, 0] & np.uint64(self.mask)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket, prints):
        return bucket ^ ((np.asarray(prints).astype(np.int64) * 0x5BD1E995 >> 7) & self.mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        rows = self.table.reshape(-1, SLOTS)
        return ((rows[first] == prints[:, None]) | (rows[second] == prints[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False when a key finds no place; the filter is then to be rebuilt larger."""
        prints, first, second = self._places(keys)
        cells = self.table.tolist()
        fitted = all(self._put(cells, p, a, b) for p, a, b in zip(prints.tolist(), first.tolist(), second.tolist()))
        self.table = np.array(cells, dtype=np.uint16)
        return fitted

    def _put(self, cells: list[int], mark: int, first: int, second: int) -> bool:
        for bucket in (first, second):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if cells[at] == 0:
                    cells[at] = mark
                    return True
        bucket = second
        for kick in range(MAX_KICKS):
            at = bucket * SLOTS + (mark + kick) % SLOTS
            mark, cells[at] = cells[at], mark
            bucket = int(self._other(bucket, mark))
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if cells[at] == 0:
                    cells[at] = mark
                    return True
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted before."""
        prints, first, second = self._places(keys)
        for mark, a, b in zip(prints.tolist(), first.tolist(), second.tolist()):
            for bucket in (a, b):
                cells = self.table[bucket * SLOTS : bucket * SLOTS + SLOTS]
                hit = np.flatnonzero(cells == mark)
                if len(hit):
                    cells[hit[0]] = 0
                    break


def as_words(keys: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(bytearray().join(keys.to_pylist()) or bytearray(), dtype="<u8").reshape(-1, 2) if len(keys) else np.zeros((0, 2), np.uint64)


def document_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``key, doc_id``: every line key once for each row of ``docs``."""

    def keys(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        owners, found = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
            mine = {line_key(line, min_chars) for line in text.split(b"\n")} - {None}
            found.extend(mine)
            owners.extend([NO_ID if doc is None else doc] * len(mine))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(owners, pa.int64())], ["key", "doc_id"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), keys, "key binary, doc_id long")


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _shared(counts: DataFrame) -> DataFrame:
    """Of exact counts: per key the documents that hold it and the smallest, where there are two or more."""
    return counts.groupBy("key").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc")).filter("docs > 1")


@dataclass
class LineIndex:
    """``counts``: key, doc_id, refs (rows of that document with the key). ``shared``: key, docs,
    first_doc. ``filters``: shard, cells. All are written tables."""

    counts: DataFrame
    shared: DataFrame
    filters: DataFrame
    shards: int

    @classmethod
    def of(cls, keys: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> LineIndex:
        """The index of the keys of a first body of documents."""
        counts = cut_lineage(keys.groupBy("key", "doc_id").agg(F.count("*").alias("refs")), "line-counts")
        shared = cut_lineage(_shared(counts), "shared-lines")
        shards = max(LEAST_SHARDS, -(-shared.count() // keys_per_shard))

        def build(group: pa.Table) -> pa.Table:
            made = CuckooFilter.built(as_words(group.column("key")))
            return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "cells": [made.to_bytes()]})

        filters = shared.select("key", _shard(shards).alias("shard")).groupBy("shard").applyInArrow(build, "shard int, cells binary")
        return cls(counts, shared, cut_lineage(filters, "line-filters"), shards)

    def changed(self, keys: DataFrame, sign: int) -> LineIndex:
        """The index after documents with these keys came (1) or went (-1)."""
        moved = keys.groupBy("key", "doc_id").agg((F.count("*") * sign).alias("refs"))
        together = self.counts.unionByName(moved).groupBy("key", "doc_id").agg(F.sum("refs").alias("refs"))
        counts = cut_lineage(together.filter("refs > 0"), "line-counts")
        shared = cut_lineage(_shared(counts), "shared-lines")
        came = shared.join(self.shared, "key", "left_anti").select("key", F.lit(True).alias("came"))
        went = self.shared.join(shared, "key", "left_anti").select("key", F.lit(False).alias("came"))
        moves = came.unionByName(went).withColumn("shard", _shard(self.shards))

        def update(key: tuple, old: pa.Table, moves: pa.Table) -> pa.Table:
            now = CuckooFilter.from_bytes(old.column("cells")[0].as_py()) if old.num_rows else CuckooFilter.for_keys(4 * moves.num_rows)
            words, came = as_words(moves.column("key")), np.array(moves.column("came").to_pylist(), dtype=bool)
            now.delete(words[~came])
            full = not now.insert(words[came])
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "cells": [now.to_bytes()], "full": [full]})

        filters = cut_lineage(
            self.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInArrow(update, "shard int, cells binary, full boolean"),
            "line-filters",
        )
        if filters.filter("full").limit(1).count():  # a filter overflowed: all are built anew from the exact table
            return LineIndex.of(counts.select("key", "doc_id", F.explode(F.sequence(F.lit(1), F.col("refs").cast("int")))).drop("col"))
        return LineIndex(counts, shared, filters.drop("full"), self.shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self.changed(document_keys(docs), 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        return self.changed(document_keys(docs), -1)


def probe(keys: DataFrame, index: LineIndex, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The rows of ``keys`` that a filter lets through: all shared keys and few others.

    Filters are broadcast in blocks of at most ``filter_bytes`` (one shard at least), with one pass
    over the narrow key table for each block.
    """
    sizes = index.filters.agg(F.coalesce(F.sum(F.length("cells")), F.lit(0)).alias("all"), F.count("*").alias("n")).first()
    blocks = max(1, -(-sizes["all"] // filter_bytes))
    context = keys.sparkSession.sparkContext
    sharded = keys.withColumn("shard", _shard(index.shards))
    passes = []
    for block in range(blocks):
        mine = index.filters.filter(F.pmod("shard", F.lit(blocks)) == block)
        sent = context.broadcast({r["shard"]: bytes(r["cells"]) for r in mine.toLocalIterator()})

        def hits(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            opened: dict[int, CuckooFilter] = {}
            for batch in batches:
                shards = batch.column("shard").to_numpy()
                words, through = as_words(batch.column("key")), np.zeros(batch.num_rows, dtype=bool)
                order = np.argsort(shards, kind="stable")
                bounds = np.flatnonzero(np.diff(shards[order], prepend=-1)) if len(order) else []
                for part in np.split(order, bounds[1:]) if len(order) else []:
                    shard = int(shards[part[0]])
                    if shard in sent.value:
                        if shard not in opened:
                            opened[shard] = CuckooFilter.from_bytes(sent.value[shard])
                        through[part] = opened[shard].contains(words[part])
                yield batch.filter(pa.array(through)).select(["key", "doc_id"])

        in_block = sharded if blocks == 1 else sharded.filter(F.pmod("shard", F.lit(blocks)) == block)
        passes.append(in_block.mapInArrow(hits, "key binary, doc_id long"))
    return union_all(passes)


def lines_to_drop(keys: DataFrame, index: LineIndex) -> DataFrame:
    """``doc_id, drop``: the line keys that each document loses, because an earlier one holds them."""
    later = probe(keys, index).join(index.shared, "key").filter(F.col("doc_id") > F.col("first_doc"))
    return later.groupBy("doc_id").agg(F.collect_set("key").alias("drop"))


def without_lines(docs: DataFrame, drops: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with its text less the dropped lines, and ``n_lines``, ``n_dropped``."""
    rows = packed(docs, "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__owner"))
    joined = rows.join(drops.withColumnRenamed("doc_id", "__owner").hint("shuffle_hash"), "__owner", "left")
    row_type = joined.schema[ROW].dataType.simpleString()

    def rewrite(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kept, lines, dropped = [], [], []
        for text, drop in zip(texts_of(batch), batch.column("drop").to_pylist()):
            if drop is None:
                kept.append(text)
                lines.append(text.count(b"\n") + 1)
                dropped.append(0)
                continue
            every, gone = text.split(b"\n"), set(drop)
            stay = [line for line in every if line_key(line, min_chars) not in gone]
            kept.append(b"\n".join(stay))
            lines.append(len(every))
            dropped.append(len(every) - len(stay))
        columns = [batch.column(ROW), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [ROW, "__kept", "__lines", "__dropped"])

    out = map_batches(joined.select(ROW, "text", "drop"), rewrite, f"{ROW} {row_type}, __kept string, __lines long, __dropped long")
    return unpacked(out, docs.columns, {"text": "__kept", "n_lines": "__lines", "n_dropped": "__dropped"})


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every document with the lines left that no smaller doc_id holds; see the module for all cases."""
    keys = cut_lineage(document_keys(docs, min_chars), "document-lines")
    return without_lines(docs, lines_to_drop(keys, LineIndex.of(keys)), min_chars)
