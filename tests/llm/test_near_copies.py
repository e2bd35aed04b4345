"""Near copies at a similarity of 0.8 beside brute force over all pairs of shingle sets."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from publedger.llm import near_copies
from publedger.llm.simhash import shingle_hashes
from tests.llm.helpers import documents, groups, lower, words

FOLDER = "/root/testdata/sf0.001"


def shingles(text, n=5):
    tokens = lower(text or "").encode().split()
    return frozenset(zip(*(tokens[k:] for k in range(n)))) if len(tokens) > n else frozenset([tuple(tokens)] if tokens else [])


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def groups_by_hand(rows):
    """Smallest doc_id of the group of every row with an id, by comparing all pairs of distinct sets."""
    named = [(d, shingles(t)) for d, t in rows if d is not None]
    first = {}
    for d, s in named:
        first[s] = min(d, first.get(s, d))
    pairs = [(s, s) for s in first] + [(s, t) for s, t in combinations(first, 2) if similarity(s, t) >= 0.8]
    index = {s: k for k, s in enumerate(sorted(first, key=first.get))}
    roots = groups((index[a], index[b]) for a, b in pairs)
    order = sorted(first, key=first.get)
    return [(d, first[order[roots[index[s]]]]) for d, s in named]


def changed(text, share, rng):
    """Copies of some words replaced, one in a run of five at most."""
    tokens = text.split()
    for k in range(0, len(tokens), 5):
        if rng.random() < share * 5:
            tokens[k] = tokens[k] + "x"
    return " ".join(tokens)


def test_groups_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    base = [" ".join(words(200, seed)) for seed in range(12)]
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + k, changed(base[k % 12], 0.01, rng)) for k in range(60)]
    rows += [(200 + k, changed(base[k % 12], 0.12, rng)) for k in range(12)]  # far under 0.8
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "ONE"), (305, "one two"), (306, base[0].upper()), (None, base[0])]
    rows += [(7, base[7]), (310, "w " * 20_000), (311, " ".join(words(30_000, 99)))]
    found = Counter((r["doc_id"], r["component_id"]) for r in near_copies.near_copies(documents(spark, rows, clashing=True)).collect() if r["doc_id"] is not None)
    assert found == Counter(groups_by_hand(rows))
    kept = near_copies.one_of_each(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([d for d, c in groups_by_hand(rows) if d == c] + [None])


def test_nothing_and_missing_ids(spark):
    assert near_copies.one_of_each(documents(spark, [])).count() == 0
    assert near_copies.one_of_each(documents(spark, [(None, "a b"), (None, "a b"), (None, None)])).count() == 3


@pytest.mark.parametrize("texts", [1_000, 250_000, 30_000_000])
def test_fingerprints_reach_the_similarity(texts):
    """Share of random pairs at a similarity just over 0.8 with a fingerprint within 2 bits."""
    bits, count = near_copies.shape(texts)
    rng, met = np.random.default_rng(texts), 0
    for _ in range(200):
        shared, own = rng.integers(0, 2**63, 240, dtype=np.uint64), rng.integers(0, 2**63, 60, dtype=np.uint64)
        a, b = np.concatenate([shared, own[:30]]), np.concatenate([shared, own[30:]])
        assert near_copies.jaccard(np.unique(a), np.unique(b)) == 0.8
        one, other = (near_copies.fingerprints(s, bits, count) for s in (a, b))
        met += int((np.bitwise_count(one ^ other) <= 2).any())
        assert np.bitwise_count(one ^ other).sum() <= (near_copies.differing_share(0.8) + near_copies.SLACK) * bits * count
    assert met >= 0.9 * 200


def test_stage_drops_only_what_all_pairs_drop(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    expected = groups_by_hand([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == Counter(d for d, c in expected if d == c)


def test_shingles_are_those_of_the_stage():
    assert len(np.unique(shingle_hashes(b"a b c d e f A B c d e f", 5))) == len(shingles("a b c d e f A B c d e f"))


def linked_by_hand(spark, hashes):
    """Groups that ``links`` finds in nodes with these sets of hashes, all of which meet on every point, and those of all pairs."""
    bits, count = near_copies.shape(len(hashes))
    prints = np.arange(count, dtype=np.uint64).tobytes()
    rows = [(node, node, node, prints, np.array(sorted(some), dtype=np.uint64).tobytes()) for node, some in hashes.items()]
    scanned = spark.createDataFrame(rows, "row long, doc_id long, node long, prints binary, hashes binary")
    sets = scanned.select("row", "prints", "node", scanned.doc_id.alias("first_doc"))
    found = near_copies.links(scanned, sets, len(rows), bits, count).collect()
    alike = [(a, b) for a, b in combinations(hashes, 2) if similarity(hashes[a], hashes[b]) >= 0.8]
    loners = [(a, a) for a in hashes]
    assert all(similarity(hashes[r["a"]], hashes[r["b"]]) >= 0.8 for r in found)
    return groups(loners + [(r["a"], r["b"]) for r in found]), groups(loners + alike)


def test_a_link_between_neither_the_smallest_nor_the_largest_of_a_point(spark):
    """Two strangers are the smallest and the largest text of every point at which two near copies meet."""
    copy = frozenset(range(100, 200))
    found, expected = linked_by_hand(spark, {1: frozenset(range(50)), 2: copy, 3: copy | {200}, 4: frozenset(range(300, 350))})
    assert found == expected == {1: 1, 2: 2, 3: 2, 4: 4}


def test_links_of_a_crowded_point_are_those_of_all_pairs(spark):
    """600 texts on one point, in blocks: pairs of near copies, chains of them and strangers, in random order."""
    rng = random.Random(9)
    nodes = rng.sample(range(1, 10**9), 600)
    hashes = {}
    for k, node in enumerate(nodes):
        family, place = (k // 2, k % 2) if k < 300 else (1000 + (k - 300) // 10, k % 10) if k < 500 else (2000 + k, 0)
        hashes[node] = frozenset(range(family * 1000 + 5 * place, family * 1000 + 5 * place + 60))  # neighbours at 0.85, others less
    found, expected = linked_by_hand(spark, hashes)
    assert found == expected
    assert Counter(Counter(expected.values()).values()) == {2: 150, 10: 20, 1: 100}
