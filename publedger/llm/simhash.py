"""SimHash near-duplicates: fingerprints of word shingles, linked by meet-in-the-middle ball hashing.

Two fingerprints at up to ``2r`` differing bits have a point at up to ``r`` bits from both. Every
distinct fingerprint emits all points of its ball of radius ``r`` (2,081 for r = 2), points are
shuffled to buckets, and fingerprints that meet on a point are linked: they are at most ``2r`` apart,
which is verified. Points are exchanged as packed arrays in eight passes, split by a parity class
of the point, so that an eighth of the points is on disk at a time. Fingerprints that meet on one point are linked
in a chain and each bucket keeps a spanning forest, so a large group of near copies never becomes
all its pairs; reachability is the same.

Defined cases: null and empty texts have fingerprint zero and link like any other; texts under
``words`` words are one shingle; rows that repeat a doc_id are each returned; a row without an id
is returned and never names a component unless all members lack one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from publedger.llm.common import ROW, map_batches, signed, task_count, texts_of, union_all, unsigned
from publedger.llm.components import components
from publedger.session import cut_lineage

WORDS, SEED, DISTANCE, BITS = 4, 42, 4, 64
#: Passes are classes of a 3-bit parity; more bits mean less disk and more jobs.
PASS_BITS = 3
LEAST_BUCKETS = 32
#: Bytes of points that one task sorts at once.
BUCKET_BYTES = 32 << 20
CHUNK = 2048
HASHES_AT_ONCE = 1 << 16


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of a text, A-Z lower-cased."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), seed)], dtype=np.uint64)
    shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64, count=len(tokens) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that over half the hashes have."""
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), HASHES_AT_ONCE):
        part = np.ascontiguousarray(hashes[start : start + HASHES_AT_ONCE]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) and ``h`` (a hash of the text) for every row."""

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        prints = np.array([fingerprint(shingle_hashes(t, words, seed)) for t in texts_of(batch)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signed(prints)), batch.column("h")], ["doc_id", "fp", "h"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")), scan, "doc_id long, fp long, h long")


def ball(radius: int) -> np.ndarray:
    """Masks of at most ``radius`` bits."""
    return np.array([sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(BITS), n)], dtype=np.uint64)


def parity_class(values: np.ndarray, bits: int = PASS_BITS) -> np.ndarray:
    """A linear class: that of x ^ y is that of x xor that of y."""
    out = np.zeros(len(values), dtype=np.int64)
    for j in range(bits):
        mask = np.uint64(sum(1 << b for b in range(BITS) if (b >> j) & 1))
        out |= (np.bitwise_count(values & mask).astype(np.int64) & 1) << j
    return out


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every node to the root of its component in these links."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lx, ly = label[x], label[y]
        low, high = np.minimum(lx, ly), np.maximum(lx, ly)
        if not (low != high).any():
            break
        np.minimum.at(label, high, low)
        while True:
            short = label[label]
            if (short == label).all():
                break
            label = short
    leaf = label != np.arange(len(nodes))
    return nodes[leaf], nodes[label[leaf]]


def _links_of_points(points: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between fingerprints that share a point, as a spanning forest."""
    order = np.argsort(points)
    meet = np.flatnonzero(points[order[1:]] == points[order[:-1]])
    a, b = prints[order[meet]], prints[order[meet + 1]]
    near = (a != b) & (np.bitwise_count(a ^ b) <= distance)
    return spanning_forest(a[near], b[near])


def near_links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``a, b`` (fingerprints as longs) that connect every two of ``distinct.fp`` at ``distance`` or fewer bits."""
    count = distinct.count()
    masks = ball((distance + 1) // 2)
    passes = 1 << PASS_BITS
    by_class = [masks[parity_class(masks) == c] for c in range(passes)]
    points_per_pass = count * max(map(len, by_class))
    buckets = 1 << max(int(math.log2(LEAST_BUCKETS)), math.ceil(math.log2(max(1, points_per_pass * 16 / BUCKET_BYTES))))
    shift = np.uint64(64 - int(math.log2(buckets)))
    spread = distinct.select("fp").repartition(task_count(distinct, count, 20_000))

    def emit(which: int):
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            every = unsigned(batch.column("fp").to_numpy())
            classes = parity_class(every)
            for c in range(passes):
                mine, flips = every[classes == c], by_class[c ^ which]
                for start in range(0, len(mine), CHUNK):
                    some = mine[start : start + CHUNK]
                    points = (some[:, None] ^ flips[None, :]).ravel()
                    owners = np.repeat(some, len(flips))
                    bucket = ((points * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
                    order = np.argsort(bucket, kind="stable")
                    pairs = np.stack([points[order], owners[order]])
                    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                    full = np.flatnonzero(np.diff(ends))
                    cells = [pairs[:, ends[k] : ends[k + 1]].tobytes() for k in full]
                    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(cells, pa.binary())], ["bucket", "cells"])

        return run

    def meet(group: pa.Table) -> pa.Table:
        cells = [np.frombuffer(c, dtype=np.uint64).reshape(2, -1) for c in group.column("cells").to_pylist()]
        both = np.concatenate(cells, axis=1)
        a, b = _links_of_points(both[0], both[1], distance)
        return pa.table({"a": signed(a), "b": signed(b)})

    found = []
    for which in range(passes):
        points = map_batches(spread, emit(which), "bucket int, cells binary")
        found.append(cut_lineage(points.groupBy("bucket").applyInArrow(meet, "a long, b long"), "near-links"))
    return union_all(found)


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fp, h, component_id`` for every row: the smallest doc_id reachable over links."""
    prints = cut_lineage(fingerprints(docs, words), "fingerprints")
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct-fingerprints")
    roots = components(near_links(distinct, distance)).withColumnRenamed("node", "fp")
    rooted = cut_lineage(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted-fingerprints")
    first = cut_lineage(rooted.groupBy("root").agg(F.min("first_doc").alias("component_id")), "components")
    groups = cut_lineage(rooted.join(first, "root").select("fp", "component_id"), "fingerprint-groups")
    return prints.join(groups, "fp").select("doc_id", "fp", "h", "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their group; every row without an id stays, and so do all
    rows that repeat the id and text of one that stays."""
    found = near_duplicates(docs, words, distance)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id", F.col("h").alias("text_hash")).distinct()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW))
    return rows.join(gone, ["doc_id", "text_hash"], "left_anti").select(f"{ROW}.*")
