"""Toxicity and language model: their parts exactly, and held-out results on the test tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from publedger.llm import language_model as lm
from publedger.llm import queries
from publedger.llm import toxicity as tox
from tests.llm.helpers import documents, lower, words

FOLDER = "/root/testdata/sf0.01"


def swaps_distance(a, b):
    """Edits with a swap of neighbours as one edit."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_finds_exactly_the_words_in_reach():
    rng = random.Random(5)
    terms = ["rotten", "filth", "abominable", "muck", "scoundrel"]
    machine = tox.LexiconAutomaton(terms, ["vermi"])
    tried = set(terms)
    for term in terms:
        for _ in range(400):
            w = list(term)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(w) + 1)
                kind = rng.randrange(4)
                if kind == 0:
                    w.insert(at, rng.choice("abcdefgmnorst"))
                elif at < len(w) and kind == 1:
                    w.pop(at)
                elif at < len(w) and kind == 2:
                    w[at] = rng.choice("abcdefgmnorst")
                elif at + 1 < len(w):
                    w[at], w[at + 1] = w[at + 1], w[at]
            tried.add("".join(w))
    for word in tried:
        distances = [(swaps_distance(word, t), t) for t in terms if swaps_distance(word, t) <= tox.edits_allowed(t)]
        found = machine.match(word)
        assert (found is not None) == bool(distances), word
        if found:
            assert found[1] == min(distances)[0]
    assert machine.match("vermin") == (5, 0) and machine.match("vermillion") == (5, 0) and machine.match("verm") is None
    assert machine.match("") is None


def test_quoted_hits_count_apart():
    scanner = tox.Scanner(tox.Lexicon({"rotten": 3.0}, {}))
    assert scanner.figures("you rotten thing")[0] > 0 and scanner.figures("you rotten thing")[2] == 0
    quoted = scanner.figures('she said "rotten" and left')
    assert quoted[0] == 0 and quoted[2] > 0
    assert scanner.figures("you roten thing")[1] > 0
    assert scanner.figures("") == scanner.figures("nothing here") == [0.0] * tox.FEATURES


def toxic_rows(n=240):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(n):
        w = words(40, 1000 + k)
        bad = k % 4 == 0
        for _ in range(4 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["rotten", "scoundrel", "filthy"]))
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(bad)))
    return rows, labels


def test_toxicity_learns_and_scores_every_row(spark):
    rows, labels = toxic_rows()
    rows += [(900, None), (901, ""), (902, "a scoundrell and a rottenn filthy scoundrel"), (903, " ".join(words(20_000, 3))), (903, "plain"), (None, "rotten filthy scoundrel")]
    known = spark.createDataFrame([*labels, (901, 1, None), (None, 1, 1), (77777, 0, 1)], "doc_id long, quality int, toxic int")
    out = tox.toxicity(documents(spark, rows, clashing=True), known).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    truth = {d: t for d, _, t in labels}
    wrong = [r for r in out if r["doc_id"] in truth and r["predicted"] != truth[r["doc_id"]]]
    assert len(wrong) <= 2
    assert [r["predicted"] for r in out if r["doc_id"] == 902] == [1]
    assert [r["predicted"] for r in out if r["doc_id"] in (900, 901)] == [0, 0]


def test_toxicity_without_labels(spark):
    rows, labels = toxic_rows(20)
    known = spark.createDataFrame([(d, q, 0) for d, q, _ in labels], "doc_id long, quality int, toxic int")
    for table in (known, known.limit(0)):
        assert all(r["predicted"] == 0 for r in tox.toxicity(documents(spark, rows), table).collect())
    assert tox.toxicity(documents(spark, []), known).count() == 0


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic")
    rows = queries.QUERIES["op4_toxicity"](spark, FOLDER).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    toxic, clean = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.6 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.05 * len(clean)


def test_lexicon_keeps_every_term_of_enough_evidence_at_any_size():
    rare = {f"=term{k:05}": (40, 0) for k in range(20_500)}
    kept = tox._lexicon(rare, 25_000, 25_000, tried=50_000)
    assert len(kept.words) == len(rare)
    assert tox._lexicon({"=scoundrel": (3, 0)}, 600, 60_000, tried=1000).words.keys() == {"scoundrel"}
    assert not tox._lexicon({"=chance": (20, 0)}, 25_000, 25_000, tried=10**9).words  # one of so many has this by chance
    assert tox._lexicon({"=chance": (20, 0)}, 25_000, 25_000, tried=10**5).words


def base_by_hand(rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [*lower(t or "").replace("\xa0", "ÿ").split(), ""]
    counts = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        w = tokens(t)
        score = sum(math.log10((counts[x] + 1) / (n + 1 * (v + 1))) for x in w)
        out.append((d, len(w), sum(counts[x] > 0 for x in w), round(score, 6)))
    return Counter(out)


@pytest.mark.parametrize("frequent", [200_000, 12])
def test_base_scores_equal_hand(spark, frequent):
    rows = [(k, " ".join(words(30, k % 25))) for k in range(60)] + [(70, None), (71, ""), (72, "NEW Words"), (73, " ".join(words(20_000, 2))), (None, "a b"), (72, "NEW Words")]
    docs = documents(spark, rows, clashing=True)
    model = lm.train(docs.filter(~lm.is_held_out()), words=5, frequent=frequent)
    out = lm.score(docs, model).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out) == base_by_hand(rows)
    assert all(r["score"] < 0 for r in out)


def test_end_of_text_counts_when_many_words_are_as_frequent(spark):
    rows = [(k, " ".join(words(30, 1) * 20)) for k in range(6)]
    docs = documents(spark, rows)
    model = lm.train(docs.filter(~lm.is_held_out()), words=5, frequent=8)
    out = lm.score(docs, model).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out) == base_by_hand(rows)


def test_language_model_of_nothing(spark):
    docs = documents(spark, [(1, "some text"), (2, None)])
    out = lm.score(docs, lm.train(docs.limit(0))).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["base_score"]) for r in out) == [(1, 0, 0.0), (3, 0, 0.0)]
    assert lm.score(docs.limit(0), lm.train(docs)).count() == 0


def test_network_is_normalised_and_learns_its_counts():
    rng = np.random.default_rng(7)
    counts = rng.integers(0, 30, size=(6, 6, 5)).astype(float)
    counts[2, 3] = [500, 0, 0, 0, 20]
    network = lm.train_nce(counts, dimensions=8)
    table = 10 ** network.log10_table()
    assert np.allclose(table.sum(axis=1), 1)
    assert table[2 * 6 + 3].argmax() == 0
    unigram = counts.sum(axis=(0, 1)) / counts.sum()
    loss = lambda p: -(counts.reshape(36, 5) * np.log(p)).sum()
    assert loss(table) < loss(np.tile(unigram, (36, 1)))


def test_language_model_beats_the_base_on_held_out_texts(spark):
    rows = [r for r in queries.QUERIES["op10_lm_scoring"](spark, FOLDER).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
