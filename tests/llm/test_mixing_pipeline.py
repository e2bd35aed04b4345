"""The mix beside a version by hand, and the pipeline stage by stage."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from publedger.llm import mixing, queries
from tests.compare import difference, duck
from tests.llm.helpers import documents, words

FOLDER = "/root/testdata/sf0.001"


def targets_by_hand(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, still = {}, set(names)
    left = sum(sizes.values())
    while True:
        total = sum(weight[s] for s in still)
        share = {s: left * weight[s] / total for s in still} if total else {}
        above = [s for s in still if share[s] > most * sizes[s] + 1e-9]
        if not above:
            return target | share
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
            still.discard(s)


def mix_by_hand(rows):
    size = [len((t or "").replace("\xa0", "x").replace(" ", "x").split()) for _, t, _ in rows]
    sums = {}
    for (_, _, s), n in zip(rows, size):
        sums[s] = sums.get(s, 0) + n
    target = targets_by_hand(sums)
    key = lambda d: int(hashlib.md5(f"{mixing.SEED}:{'' if d is None else d}".encode()).hexdigest()[:15], 16)
    out, at = [], dict.fromkeys(sums, 0)
    for i in sorted(range(len(rows)), key=lambda i: (key(rows[i][0]), size[i], i)):
        d, _, s = rows[i]
        taken = sum(max(0, min(size[i], math.floor(target[s] + 1e-9) - at[s] - e * sums[s])) for e in range(3))
        at[s] += size[i]
        out.append((d, s, size[i], sums[s], round(target[s], 6), taken))
    return Counter(out)


def mixed(df):
    return Counter((r["doc_id"], r["source"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in df.collect())


ROWS = [(k, " ".join(words(5 + k % 40, k)), "abc"[k % 3] if k % 7 else "tiny") for k in range(120)]
ROWS += [(500, None, "a"), (501, "", None), (502, "no\xa0break here", None), (503, "x " * 3000, "Z"), (503, "x " * 3000, "Z"), (None, "lost id text", "b"), (504, " \n\t ", "empty")]


def test_mix_equals_hand(spark):
    assert mixed(mixing.mix_sources(documents(spark, ROWS, clashing=True))) == mix_by_hand(ROWS)


def test_mix_reaches_targets_and_never_thrice(spark):
    rows = mixing.mix_sources(documents(spark, ROWS)).collect()
    for s in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) < 1
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert sum(r["target"] for r in {r["source"]: r for r in rows}.values()) == pytest.approx(sum(r["size"] for r in rows))


def test_queue_is_in_virtual_finish_order_and_ends_at_the_budget(spark):
    _, queue = mixing.queue(documents(spark, ROWS))
    rows = sorted(queue.collect(), key=lambda r: r["served_before"])
    finish = [min(1.0, r["virtual_finish"]) for r in rows]
    assert finish == sorted(finish)
    total = 0
    for r in rows:
        assert r["served_before"] == total
        total += r["words"]
    budget = sum(len((t or "").replace("\xa0", "x").split()) for _, t, _ in ROWS)
    assert budget - 6 < total <= budget


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(documents(spark, [])).count() == 0
    empty = mixing.mix_sources(documents(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    assert difference(spark, duck(FOLDER), queries.QUERIES[name], queries.ORACLE[name], FOLDER) is None


def test_stages_work_on_what_their_predecessor_kept(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == columns, name
        kept = spark.createDataFrame(out.collect(), out.schema)
        assert {r[0] for r in kept.select("doc_id").collect()} <= {r[0] for r in docs.select("doc_id").collect()}
        docs = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r[0] for r in last.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}
    assert mixed(last) == mixed(corpus_pipeline.run(spark, FOLDER))
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "mixing sources"]


def test_stages_keep_columns_named_as_results_and_count_characters_again(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    clashing = ["score", "predicted", "n_words", "contaminated", "n_dropped", "kept"]
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in clashing})
    for _, stage in [corpus_pipeline.STAGES[k] for k in (0, 1, 3)]:
        docs = stage(spark, docs, FOLDER)
        rows = docs.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" and r["n_chars"] == len(r["text"]) for r in rows for c in clashing)


def test_near_duplicate_stage_keeps_any_columns(spark):
    names = ["gone", "of", "h", "fp", "text_hash", "component_id", "__row"]
    text = " ".join(words(60, 1))
    docs = documents(spark, [(1, text), (2, text), (3, " ".join(words(60, 2))), (None, text), (1, text)]).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in names})
    kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["gone"], r["of"]) for r in kept.collect()) == [(0, None, None), (1, "gone1", "of1"), (1, "gone1", "of1"), (3, "gone3", "of3")]
