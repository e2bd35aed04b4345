"""Phrase collocation mining with counting quotient filters.

Words that reach ``least`` occurrences in their language get dense ids; a phrase of two to four of them
is packed into four id fields and put through an invertible permutation (a Feistel network over the two
halves), so that the packed phrases spread evenly. The leading bits of the permuted key name a shard,
the next ones a quotient, all the rest is the remainder: a filter keeps a unary run length for every
quotient, the full remainders and the counts, sorted, so it is a lossless counter and two filters are
merged by merging sorted runs. Every task fills filters over its share of the corpus, the filters of a
shard meet in one group of bounded size, and only phrases that reach ``least`` leave it, decoded by the
inverse permutation. Pairs are counted before longer phrases, whose pairs must all be frequent. Scores, cuts and containment are joins over those phrases.

The texts are read once. They are written as chunks of local word codes with the chunk's own dictionary,
and only dictionaries, never single words of the texts, meet the vocabulary, so a frequent word is one row
a chunk. A phrase with a word under ``least`` occurrences cannot reach ``least`` itself.

Defined cases: a null text is empty, a null language ``und``; empty tables give no phrases; columns other
than ``text`` and ``lang`` are not read; repeated rows count as often as they occur; a text of any length
lies in one chunk. Arithmetic on counts is exact (decimals of 38 digits).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from publedger.llm.common import LOWER, UPPER, texts_of
from publedger.session import cut_lineage

LEAST = 30
MOST_WORDS = 4
TOP = 2000
NO_LANG = "und"
#: A longer phrase that holds at least 80 of 100 occurrences of a shorter one replaces it.
COVERED = 80
SCALE = 2_000_000
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: No byte of UTF-8; stands between pieces.
BREAK = b"\xff"
CHUNK_TOKENS = 1 << 20
#: Phrases counted at once in a task, and phrase occurrences a shard may hold at most.
PENDING = 1 << 21
PER_SHARD = 1 << 22
LEAST_SHARD_BITS = 8
#: Bits of the bitmap of frequent pairs, and of one block of it.
PAIR_BITS = 27
BLOCK_BITS = 16
ROUND_KEYS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)

_FOLDED = bytes.maketrans(UPPER.encode() + b"\t" + BREAKS, LOWER.encode() + b" " + BREAK * len(BREAKS))
_IDS = ("w1", "w2", "w3", "w4")


# -- texts as chunks of local codes ------------------------------------------------------------------


def tokens_of(text: bytes) -> list[bytes]:
    """The words of a text in order, with ``BREAK`` between its pieces."""
    return text.translate(_FOLDED).replace(BREAK, b" " + BREAK + b" ").split()


class _Chunk:
    """Word codes of texts of one language; code 0 is a break."""

    def __init__(self) -> None:
        self.codes: list[np.ndarray] = []
        self.tokens = 0
        self.known: dict[bytes, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.known[BREAK]  # noqa: B018  takes code 0

    def add(self, text: bytes) -> None:
        words = tokens_of(text)
        codes = np.fromiter(map(self.known.__getitem__, [*words, BREAK]), np.int32, len(words) + 1)
        self.codes.append(codes)
        self.tokens += int(np.count_nonzero(codes))

    def batch(self, lang: str) -> pa.RecordBatch:
        codes = np.concatenate(self.codes)
        wide = len(self.known) > 1 << 16
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang]),
                pa.array([self.tokens]),
                pa.array([[w.decode("utf-8", "replace") for w in self.known][1:]], pa.list_(pa.string())),
                pa.array([np.bincount(codes, minlength=len(self.known))[1:]], pa.list_(pa.int64())),
                pa.array([wide]),
                pa.array([codes.astype(np.int32 if wide else np.uint16).tobytes()]),
            ],
            names=["lang", "tokens", "words", "counts", "wide", "codes"],
        )


_CHUNKS = "lang string, tokens long, words array<string>, counts array<long>, wide boolean, codes binary"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks: dict[str, _Chunk] = {}
    for batch in batches:
        for text, lang in zip(texts_of(batch), batch.column("lang").to_pylist()):
            chunks.setdefault(NO_LANG if lang is None else lang, _Chunk()).add(text)
            if sum(c.tokens for c in chunks.values()) >= CHUNK_TOKENS:
                for name in list(chunks):
                    yield chunks.pop(name).batch(name)
    for name, chunk in chunks.items():
        yield chunk.batch(name)


def encoded(docs: DataFrame) -> DataFrame:
    """``docs`` as written chunks: ``chunk`` and the columns of ``_CHUNKS``."""
    read = docs.select("text", "lang")
    return cut_lineage(read.mapInArrow(_encode, _CHUNKS).withColumn("chunk", F.monotonically_increasing_id()), "phrase-chunks")


def vocabulary(chunks: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``id, lang, word, f`` of the words that reach ``least``, ids dense from 1, and ``lang, n``."""
    spoken = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    counted = spoken.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    place = (F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    kept = cut_lineage(counted.filter(F.col("f") >= least).select("*", *place), "phrase-words")
    sizes = kept.groupBy("part").agg(F.count("*").alias("size"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each partition
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    words = kept.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("place") + 1).alias("id"), "lang", "word", "f")
    totals = chunks.groupBy("lang").agg(F.sum("tokens").alias("n"))
    return cut_lineage(words, "phrase-vocabulary"), totals


# -- counting quotient filters -----------------------------------------------------------------------


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def scramble(hi: np.ndarray, lo: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A permutation of all pairs of ``half``-bit numbers."""
    mask = np.uint64((1 << half) - 1)
    for key in ROUND_KEYS:
        hi, lo = lo, hi ^ (_mixed(lo, key) & mask)
    return hi, lo


def unscramble(hi: np.ndarray, lo: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``scramble``."""
    mask = np.uint64((1 << half) - 1)
    for key in reversed(ROUND_KEYS):
        hi, lo = lo ^ (_mixed(hi, key) & mask), hi
    return hi, lo


def _short(values: np.ndarray, bits: int) -> bytes:
    """The low bytes that hold ``bits`` bits of every value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)].tobytes()


def _long(data: memoryview, n: int, bits: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    width = -(-bits // 8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(n, width)
    return out.view("<u8").reshape(n)


@dataclass(frozen=True)
class Layout:
    """Bits of a half of the packed key (two word ids), and of the shard that its first half leads with."""

    half: int
    shard: int

    @property
    def rest(self) -> int:
        """Bits of the first half after the shard."""
        return self.half - self.shard

    def order(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Sorting positions of keys of one shard."""
        if self.rest + self.half <= 64:
            return np.argsort((hi << np.uint64(self.half)) | lo)
        return np.lexsort((lo, hi))


@dataclass(frozen=True)
class QuotientFilter:
    """Distinct keys of one shard in order (without the shard's bits), and their counts."""

    layout: Layout
    hi: np.ndarray
    lo: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, layout: Layout, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray | None = None) -> QuotientFilter:
        """Counts keys in any order; without ``counts`` every key is one occurrence."""
        order = layout.order(hi, lo)
        hi, lo = hi[order], lo[order]
        first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])) if len(hi) else np.zeros(0, np.int64)
        if counts is None:
            sums = np.diff(np.append(first, len(hi)))
        else:
            sums = np.add.reduceat(counts[order], first) if len(hi) else counts
        return cls(layout, hi[first], lo[first], sums.astype(np.int64))

    @classmethod
    def merged(cls, layout: Layout, filters: list[QuotientFilter]) -> QuotientFilter:
        parts = [np.concatenate([getattr(f, k) for f in filters]) for k in ("hi", "lo", "counts")]
        return cls.of(layout, *parts)

    def to_bytes(self) -> bytes:
        n, rest = len(self.hi), self.layout.rest
        q = min(max(n.bit_length() - 1, 0), rest)
        quotient = (self.hi >> np.uint64(rest - q)).astype(np.int64)
        runs = np.zeros((1 << q) + n, np.uint8)
        runs[quotient + np.arange(n)] = 1
        small = np.minimum(self.counts, 255).astype(np.uint8)
        tail = self.counts[self.counts >= 255]
        head = np.array([n, q, len(tail)], "<i8").tobytes()
        low = self.hi & np.uint64((1 << (rest - q)) - 1)
        return b"".join([head, np.packbits(runs).tobytes(), _short(low, rest - q), _short(self.lo, self.layout.half), small.tobytes(), tail.astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, layout: Layout, data: bytes) -> QuotientFilter:
        n, q, tails = (int(v) for v in np.frombuffer(data, "<i8", 3))
        view, rest = memoryview(data), layout.rest
        sizes = [24, -(-((1 << q) + n) // 8), n * -(-(rest - q) // 8), n * -(-layout.half // 8), n, 8 * tails]
        ends = np.cumsum(sizes).tolist()
        parts = [view[e - s : e] for s, e in zip(sizes, ends)]
        quotient = np.flatnonzero(np.unpackbits(np.frombuffer(parts[1], np.uint8))[: (1 << q) + n]) - np.arange(n)
        hi = (quotient.astype(np.uint64) << np.uint64(rest - q)) | _long(parts[2], n, rest - q)
        counts = np.frombuffer(parts[4], np.uint8).astype(np.int64)
        counts[counts == 255] = np.frombuffer(parts[5], "<i8")
        return cls(layout, hi, _long(parts[3], n, layout.half), counts)


def pair_places(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Places of word pairs in a bitmap of ``PAIR_BITS`` bits."""
    mixed = _mixed(first.astype(np.uint64), ROUND_KEYS[0]) ^ second.astype(np.uint64)
    return (_mixed(mixed, ROUND_KEYS[1]) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def phrases_of(ids: np.ndarray, bits: int, starts: int, sizes: tuple[int, ...], pairs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The packed halves of all phrases of the given sizes that begin in the first ``starts`` places.

    Id 0 breaks phrases, and so does a pair of words that ``pairs`` (a bitmap as bytes) does not hold.
    """
    linked = (ids[:-1] > 0) & (ids[1:] > 0)
    if pairs is not None:
        at = np.flatnonzero(linked)
        place = pair_places(ids[at], ids[at + 1])
        linked[at] = (pairs[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    heads, tails = [], []
    shift = np.uint64(bits)
    for n in sizes:
        many = max(0, min(starts, len(ids) - n + 1))
        begin = np.flatnonzero(np.logical_and.reduce([linked[k : k + many] for k in range(n - 1)]))
        w = [ids[begin + k].astype(np.uint64) for k in range(n)] + [np.uint64(0)] * (MOST_WORDS - n)
        heads.append((w[0] << shift) | w[1])
        tails.append(np.broadcast_to((w[2] << shift) | w[3], heads[-1].shape))
    return np.concatenate(heads), np.concatenate(tails)


def _filled(layout: Layout, heads: list[np.ndarray], tails: list[np.ndarray]) -> pa.RecordBatch:
    """One filter for every shard that the phrases reach. The lists are emptied."""
    hi, lo = np.concatenate(heads), np.concatenate(tails)
    heads.clear()
    tails.clear()
    hi, lo = scramble(hi, lo, layout.half)
    kind = np.uint16 if layout.shard <= 16 else np.int64  # short integers are sorted by radix
    shard = (hi >> np.uint64(layout.rest)).astype(kind)
    order = np.argsort(shard, kind="stable")
    shard, hi, lo = shard[order], hi[order] & np.uint64((1 << layout.rest) - 1), lo[order]
    cuts = np.flatnonzero(np.diff(shard)) + 1 if len(shard) else []
    names, blobs = [], []
    for begin, end in zip([0, *cuts], [*cuts, len(shard)]):
        if end > begin:
            names.append(int(shard[begin]))
            blobs.append(QuotientFilter.of(layout, hi[begin:end], lo[begin:end]).to_bytes())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "filter"])


def frequent_phrases(chunks: DataFrame, words: DataFrame, least: int = LEAST) -> DataFrame:
    """``w1 .. w4, f``: word ids (0 after the last) and count of every phrase that reaches ``least``.

    Pairs are counted first. Longer phrases are counted only where all their pairs reach ``least``, as a
    bitmap of fixed size says: a pair that falls on another one's bit costs a counter and no more.
    """
    largest = words.agg(F.max("id")).first()[0] or 1
    occurrences = chunks.agg(F.sum("tokens")).first()[0] or 0
    bits = int(largest).bit_length()
    if bits > 32:
        raise ValueError(f"{largest} words of {least} or more occurrences do not fit four ids into two words of 64 bits")

    held = chunks.select("chunk", "lang", F.posexplode("words").alias("code", "word"))
    named = held.join(words.select("lang", "word", "id"), ["lang", "word"])
    local = named.groupBy("chunk").agg(F.collect_list(F.struct("code", "id")).alias("known"))  # at most a chunk's dictionary
    ready = chunks.select("chunk", "wide", "codes", F.size("words").alias("size")).join(local, "chunk")
    ready = cut_lineage(ready.select("wide", "codes", "size", F.col("known.code").alias("code"), F.col("known.id").alias("id")), "phrase-sequences")
    twos = cut_lineage(counted(ready, bits, occurrences, (2,), least), "phrase-pairs")
    longer = counted(ready, bits, 2 * occurrences, (3, 4), least, pair_bitmap(twos))
    return twos.unionByName(longer)


def pair_bitmap(twos: DataFrame) -> np.ndarray:
    """A bitmap of ``PAIR_BITS`` bits (16 MB at any size of the corpus) with the places of all pairs in ``twos``."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = pair_places(*(batch.column(k).to_numpy() for k in range(2)))
            yield pa.RecordBatch.from_arrays([pa.array(place >> BLOCK_BITS), pa.array(place & ((1 << BLOCK_BITS) - 1))], names=["block", "place"])

    def block(group: pa.Table) -> pa.Table:
        bits = np.zeros(1 << BLOCK_BITS, np.uint8)
        bits[group.column("place").to_numpy()] = 1
        return pa.table({"block": group.column("block")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    spots = twos.select("w1", "w2").mapInArrow(places, "block long, place long").distinct()
    out = np.zeros(1 << (PAIR_BITS - 3), np.uint8).reshape(-1, 1 << (BLOCK_BITS - 3))
    for row in spots.groupBy("block").applyInArrow(block, "block long, bits binary").collect():
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def counted(ready: DataFrame, bits: int, occurrences: int, sizes: tuple[int, ...], least: int, pairs: np.ndarray | None = None) -> DataFrame:
    """Phrases of the given sizes that reach ``least``, by filters filled in tasks and merged by shard."""
    half = 2 * bits
    layout = Layout(half, min(half, max(LEAST_SHARD_BITS, (occurrences // PER_SHARD).bit_length())))
    shared = ready.sparkSession.sparkContext.broadcast(pairs)
    chunk_tokens, most_pending = CHUNK_TOKENS, PENDING

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, tails, pending = [], [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                to_id = np.zeros(batch.column("size")[k].as_py() + 1, np.int64)
                to_id[batch.column("code")[k].values.to_numpy() + 1] = batch.column("id")[k].values.to_numpy()
                kind = np.int32 if batch.column("wide")[k].as_py() else np.uint16
                ids = to_id[np.frombuffer(batch.column("codes")[k].as_buffer(), kind)]
                for begin in range(0, len(ids), chunk_tokens):  # a very long text is counted part by part
                    head, tail = phrases_of(ids[begin : begin + chunk_tokens + MOST_WORDS], bits, chunk_tokens, sizes, shared.value)
                    heads.append(head)
                    tails.append(tail)
                    pending += len(head)
                    if pending >= most_pending:
                        yield _filled(layout, heads, tails)
                        pending = 0
        if pending:
            yield _filled(layout, heads, tails)

    def merge(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        filters = [QuotientFilter.from_bytes(layout, blob.as_py()) for blob in group.column("filter")]
        whole = QuotientFilter.merged(layout, filters)
        enough = whole.counts >= least
        hi, lo = whole.hi[enough] | np.uint64(shard << layout.rest), whole.lo[enough]
        hi, lo = unscramble(hi, lo, half)
        mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
        ids = [hi >> shift, hi & mask, lo >> shift, lo & mask]
        return pa.table({name: w.astype(np.int64) for name, w in zip(_IDS, ids)} | {"f": whole.counts[enough]})

    filters = ready.mapInArrow(fill, "shard long, filter binary")
    return filters.groupBy("shard").applyInArrow(merge, "w1 long, w2 long, w3 long, w4 long, f long")


# -- scores ------------------------------------------------------------------------------------------


def _size() -> Column:
    return F.lit(2) + (F.col("w3") > 0).cast("int") + (F.col("w4") > 0).cast("int")


def _part(begin: int, end: int) -> list[Column]:
    """The words ``begin .. end - 1`` of a phrase as a phrase of its own."""
    inside = [F.col(w) for w in _IDS[begin:end]]
    return [c.alias(f"p{k + 1}") for k, c in enumerate([*inside, *[F.lit(0).cast("long")] * (MOST_WORDS - len(inside))])]


_PART = ["p1", "p2", "p3", "p4"]


def scored_phrases(grams: DataFrame, words: DataFrame) -> DataFrame:
    """``w1 .. w4, lang, a, l, r, score``: every phrase by its lowest-scoring cut, covered ones dropped."""
    sized = grams.withColumn("size", _size())
    single = words.select(F.col("id").alias("p1"), *[F.lit(0).cast("long").alias(p) for p in _PART[1:]], F.col("f").alias("pf"), "lang")
    known = single.unionByName(grams.select(*[F.col(w).alias(p) for w, p in zip(_IDS, _PART)], F.col("f").alias("pf"), F.lit(None).cast("string").alias("lang")))
    cuts_of = {
        size: F.array(*[F.struct(F.lit(k).alias("k"), F.lit(left).alias("left"), *(_part(0, k) if left else _part(k, size))) for k in range(1, size) for left in (True, False)])
        for size in (2, 3, 4)
    }
    chosen = F.when(F.col("size") == 2, cuts_of[2]).when(F.col("size") == 3, cuts_of[3]).otherwise(cuts_of[4])
    cuts = sized.select(*_IDS, F.col("f").alias("a"), F.explode(chosen).alias("c")).select(*_IDS, "a", "c.*")
    measured = cuts.join(known, _PART).groupBy(*_IDS, "a", "k").agg(
        F.max(F.when(F.col("left"), F.col("pf"))).alias("l"),
        F.max(F.when(~F.col("left"), F.col("pf"))).alias("r"),
        F.max(F.when(F.col("left") & (F.col("k") == 1), F.col("lang"))).alias("lang"),
    )
    score = F.expr(f"cast({SCALE} * cast(a AS decimal(20, 0)) div cast(l + r AS decimal(20, 0)) AS bigint)")
    lowest = measured.withColumn("score", score).groupBy(*_IDS, "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("m"), F.max("lang").alias("lang")
    )
    inner = {3: [(0, 2), (1, 3)], 4: [(0, 2), (1, 3), (2, 4), (0, 3), (1, 4)]}
    held = F.when(F.col("size") == 3, F.array(*[F.struct(*_part(*s)) for s in inner[3]])).otherwise(F.array(*[F.struct(*_part(*s)) for s in inner[4]]))
    covers = (
        sized.filter("size > 2").select("f", F.explode(held).alias("s")).groupBy(*[F.col(f"s.{p}").alias(w) for p, w in zip(_PART, _IDS)])
        .agg(F.max("f").alias("longer"))
    )
    wide = "decimal(20, 0)"
    covered = F.coalesce(F.col("longer").cast(wide) * 100 >= F.col("a").cast(wide) * COVERED, F.lit(False))
    return lowest.join(covers, list(_IDS), "left").filter(~covered).select(*_IDS, "lang", "a", "m.l", "m.r", "m.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, words, a, l, r, n, score``: the first ``top`` phrases of each language by score,
    count (both descending) and phrase."""
    chunks = encoded(docs)
    words, totals = vocabulary(chunks, least)
    grams = cut_lineage(frequent_phrases(chunks, words, least), "phrases")
    scored = scored_phrases(grams, words)
    # Ties of the last place stay until the words themselves can order them.
    near = cut_lineage(scored.withColumn("place", F.rank().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).filter(F.col("place") <= top), "phrase-top")
    spelled = near.select(*_IDS, F.posexplode(F.array(*_IDS)).alias("pos", "id")).join(words.select("id", "word"), "id")
    phrase = spelled.groupBy(*_IDS).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]).alias("words"))
    ready = near.join(phrase, list(_IDS)).join(totals, "lang").withColumn("phrase", F.array_join("words", " "))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    ranked = ready.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "words", "a", "l", "r", "n", "score")

