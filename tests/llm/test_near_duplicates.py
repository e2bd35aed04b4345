"""SimHash groups, embedding links and components beside brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from publedger.llm import components, embedding_dedup, simhash
from tests.llm.helpers import documents, groups, lower, words


def print_by_hand(text, n=4):
    w = lower(text or "").split()
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) > n else [" ".join(w)] if w else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def near_texts():
    base = words(400, 7)
    rows = [(100 - k, " ".join(base[:k] + ["changed"] + base[k + 1 :])) for k in range(0, 40, 4)]
    rows += [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (5, "ONE  two"), (6, " ".join(words(50, 8))), (7, " ".join(words(20_000, 9)))]
    rows += [(50 + k, " ".join(words(30, 20 + k))) for k in range(20)] + [(None, "one two"), (6, " ".join(words(50, 8))), (None, "alone it stands here now")]
    return rows


def test_simhash_equals_brute_force(spark):
    rows = near_texts()
    prints = [print_by_hand(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i, len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 4]
    group = groups(links)
    smallest = {}
    for i, g in group.items():
        ids = [rows[k][0] for k, h in group.items() if h == g and rows[k][0] is not None]
        smallest[i] = min(ids) if ids else None
    expected = Counter((rows[i][0], prints[i], smallest[i]) for i in range(len(rows)))
    found = simhash.near_duplicates(documents(spark, rows, clashing=True))
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in found.collect()) == expected
    kept = simhash.one_of_each(documents(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter(d for i, (d, _) in enumerate(rows) if d is None or d == smallest[i])
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_balls_meet_for_every_pair_within_the_distance():
    rng = random.Random(1)
    masks = {int(m) for m in simhash.ball(2)}
    assert len(masks) == 2081
    for d in range(5):
        for _ in range(20):
            flip = sum(1 << b for b in rng.sample(range(64), d))
            assert any((flip ^ m) in masks for m in masks)


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(60)] + [(200, k) for k in range(201, 240)] + [(300, 301), (301, 302), (302, 300), (5, 5), (400, 400)]
    links += [(rng.randint(500, 560), rng.randint(500, 560)) for _ in range(40)]
    table = spark.createDataFrame([(b, a) if rng.random() < 0.5 else (a, b) for a, b in links], "a long, b long")
    rows = components.components(table).collect()
    by_root = {}
    for r in rows:
        by_root.setdefault(r["root"], set()).add(r["node"])
    expected = groups([(a, b) for a, b in links if a != b])
    sets = {}
    for x, g in expected.items():
        sets.setdefault(g, set()).add(x)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, sets.values()))
    assert components.components(table.limit(0)).count() == 0


def vectors(seed=3, n=700, d=32):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, d))
    rows = []
    for k in range(n):
        v = centres[k % 30] + rng.normal(size=d) * 0.28 if k % 3 else rng.normal(size=d)
        rows.append((k, [float(np.float32(x)) for x in v], k % 5))
    rows += [(1000 + k, rows[4][1], 0) for k in range(60)]  # copies
    rows += [(2000, [2 * x for x in rows[7][1]], 0), (2001, None, 1), (2002, [0.0] * d, 1), (2003, [None] + [1.0] * (d - 1), 1), (2004, [float("nan")] * d, 1)]
    rows += [(2005, [1.0, 2.0], 1), (2006, [], 0), (None, rows[4][1], 0), (2007, [1e300 * x for x in rows[7][1]], 0), (4, rows[4][1], 1)]
    return rows


def test_embedding_links_equal_brute_force(spark):
    rows = vectors()
    usable = [
        i for i, (k, v, _) in enumerate(rows)
        if k is not None and v is not None and len(v) == 32 and None not in v and np.isfinite(v).all() and any(v)
    ]
    m = np.array([rows[i][1] for i in usable])
    m = m / np.abs(m).max(axis=1, keepdims=True)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    close = m @ m.T >= 0.9
    np.fill_diagonal(close, False)
    ids = [rows[i][0] for i in usable]
    group = groups([(i, i) for i in range(len(ids))] + [tuple(map(int, p)) for p in np.argwhere(close)])
    first = {}
    for i, g in group.items():
        first[g] = min(first.get(g, ids[i]), ids[i])
    expected = Counter((ids[i], int(close[i].sum()), first[group[i]], ids[i] == first[group[i]]) for i in range(len(ids)))
    expected += Counter((rows[i][0], 0, rows[i][0], True) for i in range(len(rows)) if i not in set(usable))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = Counter(tuple(r) for r in embedding_dedup.near_duplicates(table).select("vec_id", "n_links", "component_id", "kept").collect())
    links = sum(n for (_, n, _, _), c in expected.items() for _ in range(c))
    got = sum(n for (_, n, _, _), c in found.items() for _ in range(c))
    assert 0.98 * links <= got <= links > 1000
    assert sum((found & expected).values()) >= 0.97 * len(rows) and sum(found.values()) == len(rows)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_directions_split_into_chunks_count_the_same(spark, monkeypatch):
    rows = vectors(n=300)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    read = lambda: sorted(map(tuple, embedding_dedup.near_duplicates(table).collect()), key=str)
    whole = read()
    monkeypatch.setattr(embedding_dedup, "CHUNK", 3)
    assert read() == whole


@pytest.mark.parametrize("count, dimensions", [(10_000, 64), (1_000_000, 32), (30_000_000, 64)])
def test_pairs_at_the_threshold_meet_at_every_table_size(count, dimensions):
    code = embedding_dedup.ProductCode.planned(dimensions, count)
    a, b = embedding_dedup.simulated_pairs(dimensions, 1000, 0.9, seed=77)
    assert np.allclose((a * b).sum(axis=1), 0.9)
    met = np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(code.members(a), code.members(b))])
    assert met >= 0.98


def test_every_vector_length_is_compared_within_itself(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=16)]) for k in range(60)]
    rows += [(100 + k, [float(x) for x in rng.normal(size=8)]) for k in range(40)]
    rows += [(200, rows[3][1]), (201, rows[70][1]), (202, [x * 1.01 for x in rows[71][1]])]
    rows += [(300, [1.0]), (301, [2.0]), (302, [-1.0]), (310, [1.0, 0.0]), (311, [1.0, 0.1]), (312, [0.0, 1.0]), (3, rows[75][1])]
    unit = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    close = lambda i, j: len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9
    links = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if close(i, j) or i == j]
    group, degree = groups(links), Counter(i for i, j in links if i != j)
    first = {}
    for i, g in group.items():
        first[g] = min(first.get(g, rows[i][0]), rows[i][0])
    expected = Counter((rows[i][0], degree[i], first[group[i]]) for i in range(len(rows)))
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in found.collect()) == expected
    assert sum(degree.values()) >= 12
