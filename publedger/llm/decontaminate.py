"""Benchmark decontamination by Wu-Manber multi-pattern search.

The windows of all benchmark items are the patterns. A shift table over blocks of bytes says how far
the search can jump where no pattern can end; where it says 0, the bucket of that suffix block gives
the patterns to try, their first bytes are compared, then the whole pattern. Documents are cut into
lanes that move through the text together, so one numpy step advances thousands of positions.

Patterns are searched in length classes, so a one-word item does not shorten the jumps of the others.
They are built by Spark and sent in blocks of bounded bytes; a benchmark of more blocks is searched block after block over
all documents, each adding its hits, with the rows written in between.

Defined cases: null and empty texts have no words and no hits; items without words never occur; an
item without an id marks words but is not listed; item rows that repeat an id count once; rows that repeat a
doc_id are each returned; an empty benchmark leaves every document clean; other columns pass through,
input columns named as an output are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from publedger.llm.common import LOWER, ROW, UPPER, map_batches, texts_of
from publedger.session import cut_lineage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Bytes of pattern text sent to the tasks at once.
BLOCK_BYTES = 16 << 20
#: Positions of one lane.
LANE = 4096
#: Length classes of patterns in bytes, each with its own tables.
CLASSES = (2, 8, 24, 48)

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


class WuManber:
    """Occurrences of patterns that are at least ``least`` bytes long."""

    def __init__(self, patterns: list[bytes]) -> None:
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.block = min(8, self.m)
        self.block_mask = np.uint64((1 << 8 * self.block) - 1)
        heads = np.array([np.frombuffer(p[: self.m], dtype=np.uint8) for p in patterns])
        bits = min(22, max(12, int(np.ceil(np.log2(4 * heads.size)))))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, self.m - self.block + 1, dtype=np.int64)
        padded = np.pad(heads, ((0, 0), (0, 8)))
        for end in range(self.block, self.m + 1):
            block = np.ascontiguousarray(padded[:, end - self.block : end - self.block + 8]).view("<u8").ravel()
            slots = self._slot(block)
            np.minimum.at(self.shift, slots, self.m - end)
        suffix = slots
        self.order = np.argsort(suffix, kind="stable")
        self.bucket = np.searchsorted(suffix[self.order], np.arange((1 << bits) + 1))
        self.prefix = np.ascontiguousarray(padded[:, :8]).view("<u8").ravel() & self.block_mask

    def _slot(self, words: np.ndarray) -> np.ndarray:
        return (((words & self.block_mask) * np.uint64(0x9E3779B97F4A7C15)) >> self.down).astype(np.int64)

    def find(self, text: bytes, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """(position, pattern) of every occurrence inside the pieces [start, end) of ``text``,
        which ends in 8 bytes of padding."""
        views = np.ndarray((len(text) - 7,), dtype="<u8", buffer=text, strides=(1,))
        first, stop = starts + self.m - 1, ends
        lanes = np.maximum(0, -(-(stop - first) // LANE))
        which = np.repeat(np.arange(len(starts)), lanes)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = first[which] + nth * LANE
        limit = np.minimum(stop[which], at + LANE)
        while len(at):
            slot = self._slot(views[at - self.block + 1])
            jump = self.shift[slot]
            stay = np.flatnonzero(jump == 0)
            if len(stay):
                yield from self._verified(text, views, at[stay], slot[stay])
            at = at + np.maximum(jump, 1)
            alive = at < limit
            if not alive.all():
                at, limit = at[alive], limit[alive]

    def _verified(self, text: bytes, views: np.ndarray, at: np.ndarray, slot: np.ndarray) -> Iterator[tuple[int, int]]:
        low, count = self.bucket[slot], self.bucket[slot + 1] - self.bucket[slot]
        start = np.repeat(at - self.m + 1, count)
        tried = self.order[np.repeat(low, count) + np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)]
        same = (views[start] & self.block_mask) == self.prefix[tried]
        for position, pattern in zip(start[same].tolist(), tried[same].tolist()):
            if text.startswith(self.patterns[pattern], position):
                yield position, pattern


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pattern, item``: each distinct window of each item, words joined and enclosed by spaces."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), 0)
    many = F.size("words") >= window
    slices = F.transform(F.sequence(F.lit(1), F.size("words") - window + 1), lambda i: F.slice("words", i, window))
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("words")).filter(F.size("words") > 0)
    windows = rows.select("item", F.explode(F.when(many, slices).otherwise(F.array("words"))).alias("w"))
    return windows.select(F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("pattern"), "item").distinct()


def _tables(rows: list) -> list[tuple[WuManber, list[list[str | None]], list[int]]]:
    items: dict[bytes, list[str | None]] = defaultdict(list)
    for row in rows:
        items[row["pattern"].encode()].append(row["item"])
    out = []
    for low, high in zip(CLASSES, (*CLASSES[1:], 1 << 60)):
        mine = [p for p in items if low <= len(p) < high]
        if mine:
            out.append((WuManber(mine), [items[p] for p in mine], [p.count(b" ") - 1 for p in mine]))
    return out


def _merge(count: int, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Maximal runs of words that the spans cover."""
    edges = np.zeros(count + 1, dtype=np.int64)
    low, high = np.array(spans, dtype=np.int64).T
    np.add.at(edges, low, 1)
    np.add.at(edges, high, -1)
    steps = np.diff((np.cumsum(edges)[:-1] > 0).astype(np.int8), prepend=0, append=0)
    return [{"start": a, "end": b} for a, b in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist())]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``carry`` columns of ``docs`` (default: all) with ``n_words``, ``hit_spans`` (runs of hit
    words, end exclusive), ``items`` (ids with occurring windows, sorted as strings) and ``contaminated``."""
    spark = docs.sparkSession
    carry = docs.columns if carry is None else carry
    windows = cut_lineage(item_windows(benchmark, window), "benchmark-windows")
    size = windows.agg(F.coalesce(F.sum(F.octet_length("pattern") + 32), F.lit(0)).alias("bytes")).first()["bytes"]
    blocks = max(1, -(-size // block_bytes))
    state = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in carry]).alias(ROW))
    row_type = state.schema[ROW].dataType.simpleString()
    results = "n_words long, hit_spans array<struct<start:long,end:long>>, items array<string>"
    for block in range(blocks):
        last = block == blocks - 1
        rows = windows.filter(F.pmod(F.xxhash64("pattern", "item"), F.lit(blocks)) == block).collect()
        sent = spark.sparkContext.broadcast([{"pattern": r["pattern"], "item": r["item"]} for r in rows])

        def search(batches: Iterator[pa.RecordBatch], sent=sent, first=block == 0, last=last) -> Iterator[pa.RecordBatch]:
            tables = _tables(sent.value)
            for batch in batches:
                yield _searched(batch, tables, first, last)

        schema = f"{ROW} {row_type}, {results}" + ("" if last else ", text string")
        state = state.mapInArrow(search, schema)
        if not last:
            state = cut_lineage(state, "leaks-so-far")
    found = state.select(ROW, "n_words", "hit_spans", "items", (F.size("hit_spans") > 0).alias("contaminated"))
    added = ["n_words", "hit_spans", "items", "contaminated"]
    return found.select(*[F.col(f"{ROW}.`{c}`").alias(c) for c in carry if c not in added], *added)


def _searched(batch: pa.RecordBatch, tables: list, first: bool, last: bool) -> pa.RecordBatch:
    counts, pieces, starts, ends, size = [], [], [], [], 0
    for text in texts_of(batch):
        words = words_of(text)
        piece = b" %b " % b" ".join(words) if words else b""
        counts.append(len(words))
        pieces.append(piece)
        starts.append(size)
        size += len(piece)
        ends.append(size)
    joined = b"".join(pieces) + bytes(8)
    starts_at, ends_at = np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64)
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k, (matcher, _, _) in enumerate(tables):
        hits = list(matcher.find(joined, starts_at, ends_at))
        owners = np.searchsorted(starts_at, [h[0] for h in hits], side="right") - 1 if hits else []
        for (position, pattern), owner in zip(hits, owners):
            found[int(owner)].append((position, k * (1 << 40) + pattern))
    spans = [[] for _ in counts] if first else batch.column("hit_spans").to_pylist()
    items = [[] for _ in counts] if first else batch.column("items").to_pylist()
    for owner, hits in found.items():
        gaps = np.flatnonzero(np.frombuffer(pieces[owner], dtype=np.uint8) == 32)
        at = np.searchsorted(gaps, [p - starts[owner] for p, _ in hits]).tolist()
        lists = [tables[code >> 40][1:] for _, code in hits]
        inside = [code & ((1 << 40) - 1) for _, code in hits]
        words = [(a, a + lengths[i]) for a, (_, lengths), i in zip(at, lists, inside)]
        spans[owner] = _merge(counts[owner], words + [(s["start"], s["end"]) for s in spans[owner]])
        names = {name for (owned, _), i in zip(lists, inside) for name in owned[i] if name is not None}
        items[owner] = sorted(names | set(items[owner]))
    columns = [batch.column(ROW), pa.array(counts, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))]
    names = [ROW, "n_words", "hit_spans", "items"]
    return pa.RecordBatch.from_arrays(columns + ([] if last else [batch.column("text")]), names + ([] if last else ["text"]))
