"""Embedding near-duplicates by spherical-cap filters.

Filters are directions of a structured random code: after a random rotation a vector is cut into three
blocks, each block has its own small book of unit vectors, and every triple of entries is a direction.
A vector belongs to all directions whose product with it exceeds a threshold; the sorted block products
make it possible to list them without trying all. Close vectors share directions with high
probability. Vectors are joined on directions and each pair is verified in double precision. A pair that
meets on several directions counts on the smallest one only, so links are counted exactly without listing
pairs; links between groups come out as spanning forests.

The number of directions follows the number of vectors, and the directions a vector keeps follow that
number: after the random rotation any pair at the contract's cosine meets like a random pair at that
cosine, so ``SIMULATED`` random pairs tell how many best directions of each vector let the share ``RECALL``
of them meet (closer pairs meet more often). The threshold is fitted on the same vectors, and each
vector goes down from it until it has its directions. Equal
vectors are one row with a count before anything is emitted. A direction of more than ``CHUNK`` vectors is split
into chunks that are compared two by two, each in its own task. Vectors are compared within their
length, each length with a code of its own.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing, as do
rows without vec_id; vectors of different lengths never link; rows that repeat a
vec_id are each returned and count as vectors; other columns, labels too, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from publedger.llm.common import map_batches
from publedger.llm.components import components
from publedger.llm.simhash import spanning_forest
from publedger.session import cut_lineage

COSINE = 0.9
BLOCKS, SEED = 3, 11
#: Share of the pairs at exactly the cosine of the contract that meet, and random pairs it is simulated with.
RECALL, SIMULATED = 0.995, 2000
#: Directions that a vector keeps at least, and directions of the code for each vector of the table.
LEAST_DIRECTIONS = 24
DIRECTIONS_PER_VECTOR = 1
#: A code that asks more directions of each vector gets smaller books; fewer directions are wider apart.
MANY_DIRECTIONS = 512
STEP = 0.02
#: Emitted rows of one Arrow batch.
EMITTED_AT_ONCE = 24_000
CHUNK = 2048
#: Rows of an emitted table that one task verifies.
ROWS_PER_TASK = 100_000


def valid_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, v``: rows with a usable vector, as the bytes of its components (as doubles)."""

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for values in batch.column("embedding"):
            v = values.as_py()
            array = np.array(v, dtype="<f8") if v and None not in v else np.zeros(0)
            out.append(array.tobytes() if len(array) and np.isfinite(array).all() and array.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "v"])

    packed = map_batches(rows.select(F.col("vec_id").cast("long"), "embedding"), pack, "vec_id long, v binary")
    return cut_lineage(packed.filter("vec_id is not null and v is not null"), "vectors")


def simulated_pairs(dimensions: int, count: int, cosine: float, seed: int = SEED + 1) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors and for each another one at exactly this cosine."""
    rng = np.random.default_rng(seed)
    a = _unit(rng.normal(size=(count, dimensions)))
    if dimensions == 1:
        return a, a
    b = rng.normal(size=(count, dimensions))
    b = _unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    return a, cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * b


@dataclass
class ProductCode:
    """Books of block vectors behind a rotation, how many directions a vector keeps, and the threshold
    from which it looks for them."""

    rotation: np.ndarray
    books: list[np.ndarray]
    want: int = 1
    threshold: float = 0.0

    @classmethod
    def planned(cls, dimensions: int, count: int, cosine: float = COSINE) -> ProductCode:
        """The code for ``count`` vectors, of which pairs at ``cosine`` meet in the share ``RECALL``."""
        blocks = max(1, min(BLOCKS, dimensions // 2))  # a block of no component would tell nothing apart
        size = max(2, math.ceil((DIRECTIONS_PER_VECTOR * count) ** (1 / BLOCKS)))
        size = size if blocks == BLOCKS else min(size, 16)
        a, b = simulated_pairs(dimensions, SIMULATED, cosine)
        while True:
            code = cls.random(dimensions, size, blocks).fitted(a, b)
            if code.want <= MANY_DIRECTIONS or size == 2:
                return code
            size = max(2, size // 2)

    @classmethod
    def random(cls, dimensions: int, size: int, blocks: int = BLOCKS, seed: int = SEED) -> ProductCode:
        rng = np.random.default_rng(seed)
        rotation = np.linalg.qr(rng.normal(size=(dimensions, dimensions)))[0]
        books = []
        for part in np.array_split(np.arange(dimensions), blocks):
            book = rng.normal(size=(size, len(part)))
            books.append(book / (np.linalg.norm(book, axis=1, keepdims=True) * math.sqrt(blocks)) if len(part) else book)
        return cls(rotation, books)

    def products(self, unit: np.ndarray) -> list[np.ndarray]:
        parts = np.array_split(unit @ self.rotation, len(self.books), axis=1)
        return [p @ b.T for p, b in zip(parts, self.books)]

    @staticmethod
    def decode(products: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, direction, score) of all triples at the threshold. Partial triples that no ending can
        lift over it are dropped."""
        best = [p.max(axis=1) for p in products]
        count = len(products[0])
        rows, code, score = np.arange(count), np.zeros(count, dtype=np.int64), np.zeros(count)
        for k, product in enumerate(products):
            rest = sum(best[k + 1 :], np.zeros(count))
            sums = score[:, None] + product[rows]
            at, entry = np.nonzero(sums + rest[rows][:, None] >= threshold)
            score = sums[at, entry]
            code = code[at] * product.shape[1] + entry
            rows = rows[at]
        return rows, code, score

    def members(self, unit: np.ndarray) -> np.ndarray:
        """The ``want`` best directions of every row, ascending."""
        return np.sort(self.best(unit, self.want), axis=1)

    def best(self, unit: np.ndarray, want: int) -> np.ndarray:
        """The ``want`` best directions of every row, the best first. The threshold goes down from the
        fitted one for the rows that have too few, so close vectors go down together."""
        products = self.products(unit)
        out, left, threshold = np.zeros((len(unit), want), dtype=np.int64), np.arange(len(unit)), self.threshold
        while len(left):
            rows, codes, scores = self.decode([p[left] for p in products], threshold)
            order = np.lexsort((codes, -scores, rows))
            rows, codes = rows[order], codes[order]
            sizes = np.bincount(rows, minlength=len(left))
            enough = sizes >= want
            nth = np.arange(len(rows)) - (np.cumsum(sizes) - sizes)[rows]
            taken = enough[rows] & (nth < want)
            out[left[enough]] = codes[taken].reshape(-1, want)
            left, threshold = left[~enough], threshold - STEP
        return out

    def lowered(self, unit: np.ndarray, want: int) -> ProductCode:
        """With the threshold at which about one of four of these vectors has ``want`` directions."""
        products = self.products(unit)
        threshold = max(sum(p.max(axis=1) for p in products))
        while np.quantile(np.bincount(self.decode(products, threshold)[0], minlength=len(unit)), 0.75) < want and threshold > -1:
            threshold -= STEP
        return ProductCode(self.rotation, self.books, want, threshold)

    def fitted(self, a: np.ndarray, b: np.ndarray) -> ProductCode:
        """With as many directions of each vector as let the share ``RECALL`` of the pairs (a, b) meet."""
        every, want = math.prod(map(len, self.books)), LEAST_DIRECTIONS
        while True:
            code = self.lowered(a, min(want, every))
            needed = np.quantile(_meeting(code.best(a, code.want), code.best(b, code.want)), RECALL, method="higher")
            if needed <= code.want:
                return self.lowered(a, min(every, max(LEAST_DIRECTIONS, int(needed))))
            if code.want >= min(every, 2 * MANY_DIRECTIONS):
                return code  # all directions there are, or more than ``planned`` takes
            want *= 2


def _meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For every pair how many of their best directions let the two meet; more than there are if none."""
    want = a.shape[1]
    out = np.full(len(a), want + 1)
    for k, (x, y) in enumerate(zip(a, b)):
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        if len(i):
            out[k] = 1 + np.maximum(i, j).min()
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    cells = column.to_pylist()
    return np.frombuffer(bytearray().join(cells), dtype="<f8").reshape(len(cells), -1) if cells else np.zeros((0, 1))


def _counted_pairs(unit: np.ndarray, lists: np.ndarray, direction: int, middle: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Close pairs among the rows of one direction that have no smaller direction in common. With
    ``middle`` only pairs across it, else all."""
    low = middle or 0
    top = middle or len(unit)
    close = unit[:top] @ unit[low:].T >= cosine
    if not middle:
        close = np.triu(close, 1)
    if not close.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    smaller = lists < direction
    codes, where, count = np.unique(lists[smaller], return_inverse=True, return_counts=True)
    has = np.zeros((len(unit), len(codes)), dtype=np.float32)
    has[np.nonzero(smaller)[0], where] = 1
    has = has[:, count > 1]
    i, j = np.nonzero(close & (has[:top] @ has[low:].T == 0))
    return i, j + low


def links(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``rep, weight, root`` over ``classes`` (``rep, size, v``): rows whose weights sum to the vectors
    linked with those of ``rep`` (other than its copies), and whose (rep, root) connect what is linked."""
    lengths = classes.groupBy(F.length("v").alias("n")).agg(F.count("*").alias("rows")).collect()
    counts = {r["n"]: r["rows"] for r in lengths if r["rows"] > 1}
    codes = {n: ProductCode.planned(n // 8, rows, cosine) for n, rows in counts.items()}
    count = sum(counts.values())
    sent = classes.sparkSession.sparkContext.broadcast(codes)
    spread = cut_lineage(classes.repartition(max(classes.sparkSession.sparkContext.defaultParallelism, count // 20_000)), "vector-classes")

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
        """Rows of one length, and the directions of each."""
        sizes = pc.binary_length(batch.column("v")).to_numpy(zero_copy_only=False)
        for n in sorted(set(sizes.tolist()) & sent.value.keys()):
            some, code = batch.take(pa.array(np.flatnonzero(sizes == n))), sent.value[n]
            step = max(1, EMITTED_AT_ONCE // code.want)
            for start in range(0, some.num_rows, step):
                part = some.slice(start, step)
                yield n, part, code.members(_unit(_matrix(part.column("v"))))

    def directions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for n, _, found in parts(batch):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(found.size, n, dtype=np.int32)), pa.array(found.ravel())], ["n", "direction"])

    named = map_batches(spread.select("v"), directions, "n int, direction long")
    sizes = named.groupBy("n", "direction").agg(F.count("*").alias("rows"))
    heavy = cut_lineage(sizes.filter(F.col("rows") > CHUNK).select("n", "direction", F.ceil(F.col("rows") / CHUNK).cast("int").alias("chunks")), "heavy-directions")

    def emit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for n, part, found in parts(batch):
            lists = pa.array([row.tobytes() for row in found], pa.binary())
            at = pa.array(np.repeat(np.arange(len(found)), found.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(found.size, n, dtype=np.int32)), pa.array(found.ravel()), part.column("rep").take(at), part.column("size").take(at), part.column("v").take(at), lists.take(at)],
                ["n", "direction", "rep", "size", "v", "list"],
            )

    emitted = map_batches(spread.select("rep", "size", "v"), emit, "n int, direction long, rep long, size long, v binary, list binary")
    chunked = emitted.join(heavy, ["n", "direction"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    others = F.sequence(F.lit(0), F.col("chunks") - 1)
    dealt = chunked.withColumn("own", own).withColumn("other", F.explode(others))
    dealt = dealt.select(
        "n", "direction", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "size", "v", "list",
    )
    tasks = max(classes.sparkSession.sparkContext.defaultParallelism, sum(counts[n] * codes[n].want for n in codes) // ROWS_PER_TASK)
    keys = ["n", "direction", "i", "j"]
    together = dealt.repartition(tasks, *keys).sortWithinPartitions(*keys, "side")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            bounds = _bounds(held)
            if len(bounds) > 2:  # the last group may go on in the next batch
                yield from _linked_by_length(held.slice(0, int(bounds[-2])), bounds[:-1], cosine)
                held = held.slice(int(bounds[-2]))
        if held is not None and held.num_rows:
            yield from _linked_by_length(held, _bounds(held), cosine)

    return together.mapInArrow(verify, "rep long, weight long, root long")


def _bounds(rows: pa.Table) -> np.ndarray:
    keys = np.stack([rows.column(c).to_numpy() for c in ("n", "direction", "i", "j")])
    return np.concatenate([[0], 1 + np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)), [rows.num_rows]])


def _linked_by_length(rows: pa.Table, bounds: np.ndarray, cosine: float) -> Iterator[pa.RecordBatch]:
    n = rows.column("n").to_numpy()
    cuts = [0, *(1 + np.flatnonzero(n[1:] != n[:-1])).tolist(), len(n)]
    for start, end in zip(cuts[:-1], cuts[1:]):
        yield _linked(rows.slice(start, end - start), bounds[(bounds >= start) & (bounds <= end)] - start, cosine)


def _linked(rows: pa.Table, bounds: np.ndarray, cosine: float) -> pa.RecordBatch:
    unit = _unit(_matrix(rows.column("v")))
    i, j, side, direction = (rows.column(c).to_numpy() for c in ("i", "j", "side", "direction"))
    lists = np.frombuffer(bytearray().join(rows.column("list").to_pylist()), dtype=np.int64).reshape(rows.num_rows, -1)
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if end - start > 1:
            across = i[start] != j[start]
            middle = int((side[start:end] == 0).sum()) if across else 0
            if not across or 0 < middle < end - start:
                a, b = _counted_pairs(unit[start:end], lists[start:end], int(direction[start]), middle, cosine)
                left.append(a + start)
                right.append(b + start)
    a, b = np.concatenate(left), np.concatenate(right)
    rep, size = rows.column("rep").to_numpy(), rows.column("size").to_numpy()
    nodes, where = np.unique(np.concatenate([rep[a], rep[b]]), return_inverse=True)
    weight = np.zeros(len(nodes), dtype=np.int64)
    np.add.at(weight, where, np.concatenate([size[b], size[a]]))
    leaf, root = spanning_forest(rep[a], rep[b])
    roots = nodes.copy()
    roots[np.searchsorted(nodes, leaf)] = root
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(weight), pa.array(roots, pa.int64())], ["rep", "weight", "root"])


def near_duplicates(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``rows`` (``vec_id, embedding``)."""
    vectors = valid_vectors(rows)
    classes = cut_lineage(vectors.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("size")).withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    found = cut_lineage(links(classes, cosine), "vector-links")
    weights = found.groupBy("rep").agg(F.sum("weight").alias("others"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    rooted = cut_lineage(classes.join(roots, "rep", "left").join(weights, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "vector-roots")
    first = cut_lineage(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "vector-components")
    told = rooted.join(first, "root").select("v", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    linked = vectors.join(cut_lineage(told, "vector-groups"), "v").select("vec_id", "n_links", "component_id")
    alone = _alone(rows, vectors)
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _alone(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows whose vector cannot be compared: as many of each id as are not among ``vectors``."""
    all_ids = rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.count("*").alias("n"))
    used = vectors.groupBy("vec_id").agg(F.count("*").alias("m"))
    left = all_ids.join(used, "vec_id", "left").withColumn("n", F.col("n") - F.coalesce("m", F.lit(0))).filter("n > 0")
    repeated = left.select("vec_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return repeated.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
