"""Near copies by similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

One SimHash of 64 bits tells copies at 0.95 and more; at 0.8 its bits differ too often. So a text has
several short fingerprints from independent hashes, as many as let ``REACH`` of the pairs at exactly the
similarity asked for come within 2 bits of each other in one of them. Each fingerprint emits its ball of
radius 1, and texts that meet on a point are candidates. Candidates whose fingerprints differ far
more than the similarity allows go; all others are verified by the exact similarity of their shingles,
first one for each text, then those that are still apart. A text is only ever joined by a verified link.

So that a group of copies never becomes all its pairs, texts are first paired with the smallest and the
largest text of each point only, which is every pair of a point of up to three. Texts of larger points
send their points once more, with the group they have come to: where a point holds several groups, every
pair of texts of different groups is a candidate. These pairs are made block by block in tasks of their
own; they are as many as the square of a point only if its texts meet and yet are no copies.

Bits grow with the logarithm of the number of texts, so that strangers seldom meet; fingerprints follow.

Defined cases: texts with the same set of shingles (A-Z lower-cased, repeats and order aside) are one
set, named by a 64-bit hash; null and empty texts are the empty set, which equals itself and nothing
else; texts of fewer words are one shingle; a row without an id stays and names no group; rows that
repeat the id and text of one that stays do too; other columns are kept whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from publedger.llm.common import ROW, map_batches, signed, task_count, texts_of, union_all, unsigned
from publedger.llm.components import components
from publedger.llm.simhash import BUCKET_BYTES, LEAST_BUCKETS, shingle_hashes
from publedger.session import cut_lineage

WORDS, SIMILARITY, REACH = 5, 0.8, 0.95
#: Bits beyond log2 of the number of texts: about 33 of 2**14 strangers share a point of a fingerprint.
SPARE_BITS, LEAST_BITS, MOST_BITS = 14, 20, 64
#: Share of differing bits, beyond what the similarity expects, up to which a candidate is verified.
SLACK = 0.1
#: Points of 16 bytes that a text sends in one pass.
PASS_POINTS = 160
#: Texts of a point of which all pairs are among those with its smallest and its largest.
WHOLE = 3
#: Texts on either side of a block of pairs.
BLOCK = 256
ROWS_AT_ONCE = 512
STEP, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """An invertible 64-bit mix of every value."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def differing_share(similarity: float) -> float:
    """Expected share of fingerprint bits that differ between sets of one size at this Jaccard similarity."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def shape(texts: int, similarity: float = SIMILARITY, reach: float = REACH) -> tuple[int, int]:
    """Bits of a fingerprint and number of fingerprints for a table of so many texts."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(texts + 1)) + SPARE_BITS))
    p = differing_share(similarity)
    near = sum(math.comb(bits, d) * p**d * (1 - p) ** (bits - d) for d in range(3))
    return bits, 1 if near >= reach else math.ceil(math.log(1 - reach) / math.log(1 - near))


def fingerprints(hashes: np.ndarray, bits: int, count: int) -> np.ndarray:
    """``count`` fingerprints of ``bits`` bits: those that over half of the mixed hashes have."""
    width = -(-bits * count // 64)
    salts = np.arange(1, width + 1, dtype=np.uint64) * STEP
    totals = np.zeros(width * 64, dtype=np.int64)
    for start in range(0, len(hashes), 255):
        rows = mixed(hashes[start : start + 255, None] + salts).view(np.uint8)
        totals += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    cells = np.zeros((count, 64), dtype=bool)
    cells[:, :bits] = (2 * totals > len(hashes))[: bits * count].reshape(count, bits)
    return np.packbits(cells, axis=1, bitorder="little").view(np.uint64).ravel()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of sorted distinct hashes; 1 for two empty ones."""
    both = len(a) + len(b)
    if not both:
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (both - shared)


def scan_texts(docs: DataFrame, bits: int, count: int, words: int = WORDS) -> DataFrame:
    """``row, doc_id, h, node, prints, hashes`` for every row; ``node`` names the set of shingles."""
    schema = "row long, doc_id long, h long, node long, prints binary, hashes binary"

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            some = batch.slice(start, ROWS_AT_ONCE)
            sets = [np.unique(shingle_hashes(t, words)) for t in texts_of(some)]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64)
            prints = [fingerprints(s, bits, count).tobytes() for s in sets]
            columns = [some.column("row"), some.column("doc_id"), some.column("h"), pa.array(signed(nodes))]
            columns += [pa.array(prints, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "h", "node", "prints", "hashes"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return map_batches(rows, scan, schema)


def _emit(batch: pa.RecordBatch, prints: range, count: int, bits: int, shift: np.uint64) -> Iterator[pa.RecordBatch]:
    """The points of some fingerprints, as packed (point, node) by bucket, with the node's root where there is one."""
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(bits, dtype=np.uint64)])
    salts = (np.array(prints, dtype=np.uint64) + np.uint64(1)) * STEP
    names = [n for n in ("node", "root") if n in batch.schema.names]
    for start in range(0, batch.num_rows, ROWS_AT_ONCE):
        some = batch.slice(start, ROWS_AT_ONCE)
        every = np.frombuffer(b"".join(some.column("prints").to_pylist()), dtype=np.uint64).reshape(-1, count)
        mine = every[:, prints.start : prints.stop]
        points = mixed((mine[:, :, None] ^ flips) + salts[:, None]).ravel()
        owners = [np.repeat(unsigned(some.column(n).to_numpy()), len(prints) * len(flips)) for n in names]
        bucket = (points >> shift).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = np.stack([points[order], *(o[order] for o in owners)]), bucket[order]
        full, begin = np.unique(bucket, return_index=True)
        cells = [rows[:, i:j].tobytes() for i, j in zip(begin, [*begin[1:], len(bucket)])]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(cells, pa.binary())], ["bucket", "cells"])


def _by_point(group: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed rows in the order of points and nodes, where each point starts and how many nodes it has."""
    rows = np.concatenate([np.frombuffer(c, dtype=np.uint64).reshape(width, -1) for c in group.column("cells").to_pylist()], axis=1)
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    start = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
    return rows, start, np.diff(np.r_[start, rows.shape[1]])


def _meet(group: pa.Table) -> pa.Table:
    """Distinct pairs of each node with the smallest and the largest node of its points; a pair of a node
    with itself says that one of its points has more nodes than these pairs are whole for."""
    (_, nodes), start, size = _by_point(group, 2)
    low, high = np.repeat(nodes[start], size), np.repeat(nodes[start + size - 1], size)
    a, b = np.concatenate([low, nodes]), np.concatenate([nodes, high])
    apart = a != b
    crowded = nodes[np.repeat(size > WHOLE, size)]
    a, b = np.concatenate([a[apart], crowded]), np.concatenate([b[apart], crowded])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    return pa.table({"a": signed(a[new]), "b": signed(b[new])})


def _blocks(group: pa.Table) -> pa.Table:
    """Of the points that hold nodes of several roots, every two blocks of ``BLOCK`` of their nodes, packed."""
    rows, start, size = _by_point(group, 3)
    several = np.minimum.reduceat(rows[2], start) != np.maximum.reduceat(rows[2], start)
    found = {rows[1:, i : i + n].tobytes() for i, n in zip(start[several], size[several])}
    one, other = [], []
    for point in found:
        members = np.frombuffer(point, dtype=np.uint64).reshape(2, -1)
        parts = [members[:, i : i + BLOCK].tobytes() for i in range(0, members.shape[1], BLOCK)]
        one += [p for k, p in enumerate(parts) for _ in parts[k:]]
        other += [p for k, _ in enumerate(parts) for p in parts[k:]]
    return pa.table({"one": pa.array(one, pa.binary()), "other": pa.array(other, pa.binary())})


def _across(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The pairs of two blocks of one point whose roots differ."""
    for cells in zip(batch.column("one").to_pylist(), batch.column("other").to_pylist()):
        (a, ra), (b, rb) = (np.frombuffer(c, dtype=np.uint64).reshape(2, -1) for c in cells)
        i, j = np.nonzero((ra[:, None] != rb) & (a[:, None] < b))  # a block's nodes ascend, and so do a point's blocks
        yield pa.RecordBatch.from_arrays([pa.array(signed(a[i])), pa.array(signed(b[j]))], ["a", "b"])


def _points(sets: DataFrame, texts: int, room: int, bits: int, count: int, width: int) -> Iterator[DataFrame]:
    """The points of all fingerprints as packed rows of ``width`` numbers by bucket, in passes of ``room`` bytes."""
    step = min(count, max(1, room // (8 * width * max(1, texts) * (bits + 1))))
    buckets = 1 << max(int(math.log2(LEAST_BUCKETS)), math.ceil(math.log2(max(1, texts * step * (bits + 1) * 8 * width / BUCKET_BYTES))))
    shift = np.uint64(64 - int(math.log2(buckets)))
    spread = sets.repartition(task_count(sets, texts, 20_000))
    for first in range(0, count, step):
        emit = partial(_emit, prints=range(first, min(count, first + step)), count=count, bits=bits, shift=shift)
        yield map_batches(spread, emit, "bucket int, cells binary")


def meetings(sets: DataFrame, texts: int, bits: int, count: int) -> DataFrame:
    """``a, b``: nodes that meet on a point, see ``_meet``."""
    passes = _points(sets.select("node", "prints"), texts, 16 * PASS_POINTS * texts, bits, count, 2)
    found = [cut_lineage(p.groupBy("bucket").applyInArrow(_meet, "a long, b long"), "meeting-points") for p in passes]
    return cut_lineage(union_all(found).distinct(), "meeting-texts")


def meetings_apart(rooted: DataFrame, texts: int, bits: int, count: int) -> DataFrame:
    """Of ``node, root, prints``: all pairs ``a, b`` of nodes that meet on a point and have different roots.
    A pass has the bytes of one of all ``texts``."""
    passes = _points(rooted.select("node", "root", "prints"), rooted.count(), 16 * PASS_POINTS * texts, bits, count, 3)
    found = [cut_lineage(p.groupBy("bucket").applyInArrow(_blocks, "one binary, other binary"), "crowded-points") for p in passes]
    blocks = union_all(found).distinct()
    return map_batches(blocks, _across, "a long, b long").distinct()


def near(pairs: DataFrame, sets: DataFrame, bits: int, count: int, similarity: float = SIMILARITY) -> DataFrame:
    """Those of ``pairs`` whose fingerprints differ no more than the similarity lets expect."""
    most = (differing_share(similarity) + SLACK) * bits * count

    def close(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(-1, count) for c in ("one", "other"))
        few = np.bitwise_count(one ^ other).sum(axis=1, dtype=np.int64) <= most
        yield batch.select(["a", "b"]).filter(pa.array(few))

    one = sets.select(F.col("node").alias("a"), F.col("prints").alias("one"))
    other = sets.select(F.col("node").alias("b"), F.col("prints").alias("other"))
    return map_batches(pairs.join(one, "a").join(other, "b").select("a", "b", "one", "other"), close, "a long, b long")


def verified(pairs: DataFrame, shingles: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose sets of hashes are at least so similar."""

    def alike(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = ([np.frombuffer(v, dtype=np.uint64) for v in batch.column(c).to_pylist()] for c in ("one", "other"))
        same = [jaccard(a, b) >= similarity for a, b in zip(*sets)]
        yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    one = shingles.select(F.col("node").alias("a"), F.col("hashes").alias("one"))
    other = shingles.select(F.col("node").alias("b"), F.col("hashes").alias("other"))
    return map_batches(pairs.join(one, "a").join(other, "b").select("a", "b", "one", "other"), alike, "a long, b long")


def linked(close: DataFrame, shingles: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Verified links of the candidates ``close`` that connect every group of them. One candidate of each
    node is verified first; of the others only those between groups that are still apart."""
    first = cut_lineage(verified(close.groupBy("b").agg(F.min("a").alias("a")), shingles, similarity), "first-links")
    apart = between(close, components(first))
    return first.unionByName(cut_lineage(verified(apart, shingles, similarity), "more-links"))


def between(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose nodes are not in one of the ``groups`` (``node, root``)."""
    at_a = groups.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    at_b = groups.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return pairs.join(at_a, "a", "left").join(at_b, "b", "left").filter("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")


def links(scanned: DataFrame, sets: DataFrame, texts: int, bits: int, count: int, similarity: float = SIMILARITY) -> DataFrame:
    """Verified links between nodes that connect every group found."""
    met = meetings(sets, texts, bits, count)
    close = cut_lineage(near(met.filter("a <> b"), sets, bits, count, similarity), "candidates")
    crowded = met.filter("a = b").select(F.col("a").alias("node"))
    needed = sets.select("row", "node").join(close.select(F.explode(F.array("a", "b")).alias("node")).union(crowded).distinct(), "node")
    shingles = cut_lineage(scanned.select("row", "hashes").join(needed, "row").select("node", "hashes"), "shingles")
    found = linked(close, shingles, similarity)
    groups = components(found)
    rooted = sets.select("node", "prints").join(crowded, "node").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = meetings_apart(cut_lineage(rooted, "crowded-texts"), texts, bits, count).join(met, ["a", "b"], "left_anti")
    rest = cut_lineage(near(apart, sets, bits, count, similarity), "candidates-apart")
    return found.unionByName(linked(rest, shingles, similarity))


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, reach: float = REACH) -> DataFrame:
    """``doc_id, h, component_id`` for every row: the smallest doc_id reachable over verified links."""
    texts = docs.count()
    bits, count = shape(texts, similarity, reach)
    scanned = cut_lineage(scan_texts(docs, bits, count, words), "scanned-texts")
    narrow = scanned.groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("first_doc"))
    sets = cut_lineage(scanned.select("row", "prints").join(narrow, "row"), "shingle-sets")
    roots = components(links(scanned, sets, texts, bits, count, similarity))
    rooted = cut_lineage(sets.select("node", "first_doc").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted-sets")
    first = cut_lineage(rooted.groupBy("root").agg(F.min("first_doc").alias("component_id")), "groups")
    named = cut_lineage(rooted.join(first, "root").select("node", "component_id"), "named-sets")
    return scanned.select("doc_id", "h", "node").join(named, "node").select("doc_id", "h", "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, reach: float = REACH) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their group; every row without an id stays, and so do all
    rows that repeat the id and text of one that stays."""
    found = near_copies(docs, words, similarity, reach)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id", F.col("h").alias("text_hash")).distinct()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW))
    return rows.join(gone, ["doc_id", "text_hash"], "left_anti").select(f"{ROW}.*")
