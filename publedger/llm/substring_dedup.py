"""Repeated substrings by anchored hashing (winnowing), in place of bucket-pointer refinement.

A window is ``LENGTH`` bytes; bytes of windows that start anywhere else too are removed. The order of a
window is never needed, only its bucket: the set of equal windows. Identifiers are hashes of content, doubled
inside a text (64, 128, 256 bytes, then the whole); nothing is grouped at the lengths between, as a row for
every position would be many times the text. What is alone in its group of anchors, spans or windows is dropped.

1. Every window has an anchor, its smallest gram by hash (the first of equal ones), so equal windows have
   equal anchors at equal offsets. Anchors are one in 170 bytes. They are grouped by a hash of the
   240 bytes from the anchor on or the 224 up to the end of its gram; every window of the anchor contains one.
2. For the anchors left, windows go by blocks of 32 starts at equal offsets from the anchor. Blocks whose
   whole span stands elsewhere are done: all their windows repeat.
3. Only where a bucket of anchors and offsets holds differing spans, one of them alone, the single windows
   of one block of each span are compared; these are the ends of repeats.

Identifiers that decide are 128 bits. A bucket, however large, only meets partial aggregation and joins
with written tables.

Defined cases: null text is empty; texts under ``LENGTH`` bytes stay whole; rows that repeat doc_id and
text are documents that repeat one another; a null doc_id is a document like any other; the kept bytes of a
character that is cut in two are bytes, so the result is binary; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from publedger.llm.common import map_batches, texts_of
from publedger.session import cut_lineage

LENGTH, GRAM, BLOCK, HALF = 400, 64, 32, 160
SPREAD = LENGTH - GRAM + 1
#: Bytes handled by one set of arrays; longer texts are cut with an overlap.
PIECE = 1 << 18
_POSITION = np.uint64((1 << 24) - 1)
_SEEDS = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def _mix(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """Identifier of a bucket from those of its two halves."""
    k1, k2, k3 = (np.uint64(k) for k in _SEEDS[seed])
    x = a * k1
    x ^= x >> np.uint64(31)
    y = b * k2
    x += y ^ (y >> np.uint64(29))
    x *= k3
    x ^= x >> np.uint64(32)
    return x


def _doubled(ids: np.ndarray, length: int, seed: int) -> np.ndarray:
    return _mix(ids[:-length], ids[length:], seed)


@dataclass
class Piece:
    """Texts of several documents in one array. ``owner``, ``shift`` (place of the array in the document) and
    the starts of windows, for each part."""

    data: bytes
    owner: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    shift: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def part_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, at, side="right") - 1

    def ids(self, level: int, seed: int) -> np.ndarray:
        """Bucket identifiers of all positions, for lengths 8 · 2^n up to ``level``."""
        padded = self.data + bytes(8)
        out = np.ndarray((len(self.data),), dtype="<u8", buffer=padded, strides=(1,)).copy()
        length = 8
        while length < level:
            out = _doubled(out, length, seed)
            length *= 2
        return out

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every window its start and the place of its anchor; grams of all positions."""
        grams = self.ids(GRAM, 0)
        low = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while width * 2 <= SPREAD:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(low) - (SPREAD - width)], low[SPREAD - width :])
        starts = np.concatenate([np.arange(a, b) for a, b in zip(self.first, self.last)] or [np.zeros(0, np.int64)])
        return starts, (low[starts] & _POSITION).astype(np.int64), grams


def pieces(texts: list[bytes]) -> Iterator[Piece]:
    """The windows of all texts, in arrays of about ``PIECE`` bytes."""
    parts: list[tuple[int, int, bytes, int, int]] = []
    size = 0

    def made() -> Piece:
        ends = np.cumsum([len(p[2]) for p in parts])
        begins = ends - [len(p[2]) for p in parts]
        shift = np.array([p[1] for p in parts])
        column = lambda k: np.array([p[k] for p in parts])
        return Piece(b"".join(p[2] for p in parts), column(0), begins, ends, shift - begins, column(3) - shift + begins, column(4) - shift + begins)

    for owner, text in enumerate(texts):
        windows = len(text) - LENGTH + 1
        for start in range(0, max(0, windows), PIECE):
            stop = min(windows, start + PIECE)
            base = max(0, start - HALF)
            parts.append((owner, base, text[base : stop + LENGTH - 1], start, stop))
            size += len(parts[-1][2])
            if size >= PIECE:
                yield made()
                parts, size = [], 0
    if parts:
        yield made()


def _runs(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor in one document: part, anchor, first and last start."""
    starts, anchor, _ = piece.anchors()
    part = piece.part_of(starts)
    cut = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
    last = np.append(cut[1:], len(starts)) - 1
    return part[cut], anchor[cut], starts[cut], starts[last]


def _sides(piece: Piece, anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Refined anchor buckets, for windows that start under ``HALF`` bytes before the anchor and for those
    further left; 0 where a run has none."""
    i128 = piece.ids(128, 0)
    one, two = np.uint64(1), np.uint64(2)
    near, far = np.zeros(len(anchor), dtype=np.uint64), np.zeros(len(anchor), dtype=np.uint64)
    has = anchor - last < HALF
    a = anchor[has]  # the 240 bytes from the anchor on
    near[has] = _mix(i128[a], i128[a + LENGTH - HALF - 128], 0) & ~two | one
    has = anchor - first >= HALF
    a = anchor[has]  # the 224 bytes up to the end of its gram
    far[has] = _mix(i128[a - HALF], i128[a + GRAM - 128], 1) & ~one | two
    return near, far


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k1"), F.xxhash64(text).alias("k2"), F.col("doc_id"), text.alias("text"))


def _rows(columns: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
    made = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for v in made.values()], list(made))


def anchor_buckets(keyed: DataFrame) -> DataFrame:
    """``side, k1, k2``: the refined buckets of all anchors."""

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        out: dict[str, list[np.ndarray]] = {"side": [], "k1": [], "k2": []}
        for piece in pieces(texts_of(batch)):
            part, anchor, first, last = _runs(piece)
            owner = piece.owner[part]
            for side in _sides(piece, anchor, first, last):
                some = side != 0
                out["side"].append(side[some])
                out["k1"].append(k1[owner[some]])
                out["k2"].append(k2[owner[some]])
        yield _rows(out)

    return map_batches(keyed.select("k1", "k2", "text"), scan, "side long, k1 long, k2 long")


def block_rows(suspects: DataFrame) -> DataFrame:
    """Of ``k1, k2, text, sides`` (the buckets that are shared): one row for each block of windows, with its
    bucket, its place (``block`` counts blocks back from the anchor), the identifier of its span and its starts."""

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        shared = [np.array(s, dtype=np.int64).view(np.uint64) for s in batch.column("sides").to_pylist()]
        names = ("side", "block", "h1", "h2", "k1", "k2", "low", "high")
        out: dict[str, list[np.ndarray]] = {n: [] for n in names}
        for piece in pieces(texts_of(batch)):
            part, anchor, first, last = _runs(piece)
            known = np.unique(np.concatenate([shared[k] for k in np.unique(piece.owner)]))
            near, far = _sides(piece, anchor, first, last)
            top, bottom = (anchor - first) // BLOCK, (anchor - last) // BLOCK
            count = top - bottom + 1
            run = np.repeat(np.arange(len(part)), count)
            block = bottom[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
            side = np.where(block * BLOCK < HALF, near[run], far[run])
            keep = np.isin(side, known)
            run, block, side = run[keep], block[keep], side[keep]
            low = np.maximum(first[run], anchor[run] - block * BLOCK - BLOCK + 1)
            high = np.minimum(last[run], anchor[run] - block * BLOCK)
            owner, shift = piece.owner[part[run]], piece.shift[part[run]]
            h1, h2 = (_span(piece.ids(256, seed), low, high + LENGTH, seed) for seed in (0, 1))
            for name, values in zip(names, (side, block, h1, h2, k1[owner], k2[owner], low + shift, high + shift)):
                out[name].append(values)
        yield _rows(out)

    schema = "side long, block long, h1 long, h2 long, k1 long, k2 long, low long, high long"
    return map_batches(suspects.select("k1", "k2", "text", "sides"), scan, schema)


def _span(ids: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Identifier of [start, end), 256 to 512 bytes, from the two of 256 bytes that cover it, and its length."""
    return _mix(_mix(ids[start], ids[end - 256], seed), (end - start).astype(np.uint64), seed)


def window_rows(chosen: DataFrame) -> DataFrame:
    """Of ``k1, k2, text, ranges``: the identifier of every window that starts in a range."""

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        wanted = [np.array([(r["low"], r["high"]) for r in rs], dtype=np.int64) for rs in batch.column("ranges").to_pylist()]
        names = ("h1", "h2", "k1", "k2", "low")
        for piece in pieces(texts_of(batch)):
            starts = [np.zeros(0, np.int64)]
            owners = [np.zeros(0, np.int64)]
            for owner, shift, first, last in zip(piece.owner, piece.shift, piece.first, piece.last):
                low = np.maximum(wanted[owner][:, 0] - shift, first)
                high = np.minimum(wanted[owner][:, 1] - shift, last - 1)
                mine = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high)]))
                starts.append(mine)
                owners.append(np.full(len(mine), owner))
            at, owner = np.concatenate(starts), np.concatenate(owners)
            h1, h2 = (_span(piece.ids(256, seed), at, at + LENGTH, seed) for seed in (0, 1))
            place = at + piece.shift[piece.part_of(at)]
            yield _rows({n: [v] for n, v in zip(names, (h1, h2, k1[owner], k2[owner], place))})

    return map_batches(chosen.select("k1", "k2", "text", "ranges"), scan, "h1 long, h2 long, k1 long, k2 long, low long")


def repeated_ranges(keyed: DataFrame) -> DataFrame:
    """``k1, k2, low, high``: starts of all windows that stand elsewhere too, as ranges."""
    key, content = ["k1", "k2"], ["h1", "h2"]
    anchors = cut_lineage(anchor_buckets(keyed), "anchors")
    shared = cut_lineage(anchors.groupBy("side").agg(F.count("*").alias("n")).filter("n > 1").select("side"), "shared-anchors")
    sides = anchors.join(shared, "side").groupBy(*key).agg(F.collect_set("side").alias("sides"))
    blocks = cut_lineage(block_rows(keyed.join(sides, key)), "blocks")

    spans = blocks.groupBy("side", "block", *content).agg(F.count("*").alias("n"), F.min(F.struct(*key, "low", "high")).alias("one"))
    spans = cut_lineage(spans, "spans")
    done = blocks.join(cut_lineage(spans.filter("n > 1").select("side", "block", *content), "whole-spans"), ["side", "block", *content])

    buckets = spans.groupBy("side", "block").agg(F.count("*").alias("spans"), F.min("n").alias("least"))
    open_buckets = cut_lineage(buckets.filter("spans > 1 and least = 1").select("side", "block"), "open-buckets")
    chosen = spans.join(open_buckets, ["side", "block"]).select("one.*")
    ranges = chosen.groupBy(*key).agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    windows = cut_lineage(window_rows(keyed.join(ranges, key)), "windows")
    twice = cut_lineage(windows.groupBy(*content).agg(F.count("*").alias("n")).filter("n > 1").select(*content), "repeated-windows")
    single = windows.join(twice, content).select(*key, "low", F.col("low").alias("high"))
    return done.select(*key, "low", "high").unionByName(single)


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """``doc_id, kept`` (binary)``, n_bytes, n_removed, n_spans`` for every row."""
    keyed = _keyed(docs)
    key = ["k1", "k2"]
    ranges = cut_lineage(repeated_ranges(keyed), "repeated-ranges")
    lists = ranges.groupBy(*key).agg(F.collect_list(F.struct("low", "high")).alias("ranges"))

    def remove(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kept, size, gone, spans = [], [], [], []
        for text, ranges in zip(texts_of(batch), batch.column("ranges").to_pylist()):
            size.append(len(text))
            if not ranges:
                kept.append(text)
                gone.append(0)
                spans.append(0)
                continue
            edges = np.zeros(len(text) + 1, dtype=np.int32)
            np.add.at(edges, [r["low"] for r in ranges], 1)
            np.add.at(edges, [r["high"] + LENGTH for r in ranges], -1)
            covered = np.cumsum(edges)[:-1] > 0
            kept.append(np.frombuffer(text, dtype=np.uint8)[~covered].tobytes())
            gone.append(int(covered.sum()))
            spans.append(int((np.diff(covered.astype(np.int8), prepend=0) == 1).sum()))
        counts = [pa.array(c, pa.int64()) for c in (size, gone, spans)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), *counts], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    joined = keyed.join(lists, key, "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "ranges")
    return map_batches(joined, remove, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
