"""Name search, quoted CSV in byte ranges, pointer jumping and grouping sets beside brute force."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from publedger.operators import contracts, hierarchy, matching, ranking
from publedger.sources import tables

SPLITS = "spark.sql.files.maxPartitionBytes"


@pytest.mark.parametrize("min_length", [1, 4, 6])
def test_search_equals_brute_force(spark, min_length):
    rng = random.Random(min_length)
    syllables = ["ab", "c", "dé", "אב", "ן", "of", "x" * 20, "1:1"]

    def phrase(n):
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(1, n)))

    texts = [(k, "AB"[k % 2], phrase(12)) for k in range(80)] + [(900, "A", ""), (901, "A", None), (902, "B", "y" * 3000)]
    needles = [("AB"[rng.randrange(2)], phrase(5)) for _ in range(60)]
    for _, by, text in texts[:60]:  # pieces of texts, cut anywhere
        begin = rng.randrange(len(text))
        needles.append((by, text[begin : begin + rng.randint(1, 25)].strip()))
    needles += [("A", ""), ("A", None), ("B", "y" * 40), ("A", "of of"), ("A", "x" * 25)]
    found = matching.substring_matches(
        spark.createDataFrame(texts, "text_id int, by string, text string"), spark.createDataFrame(needles, "by string, needle string"), ["by"], min_length
    )
    got = sorted((r["text_id"], r["by"], r["needle"]) for r in found.collect())
    want = {(k, b, n) for k, b, t in texts for c, n in needles if b == c and n and t and len(n) >= min_length and n in t}
    assert got == sorted(want)


def test_search_without_needles_or_texts(spark):
    texts = spark.createDataFrame([(1, "some text")], "text_id int, text string")
    none = spark.createDataFrame([], "needle string")
    assert matching.substring_matches(texts, none).count() == 0
    assert matching.substring_matches(texts.limit(0), spark.createDataFrame([("some text",)], "needle string")).count() == 0


def test_search_lists_no_words_that_only_whole_needles_leave_out(spark):
    texts = spark.createDataFrame([(1, "one two three four five six")], "text_id int, text string")
    words = texts.select("text_id", F.explode(F.split("text", " ")).alias("word"))
    asked = spark.createDataFrame([("n", "whole", "three")], "needle string, kind string, piece string")
    listed = matching._listed_words(words, asked, matching._lengths_in_use(asked), [])
    assert [tuple(r) for r in listed.collect()] == [("three", 1)]


@pytest.mark.parametrize("size", ["128m", "3k", "200"])
def test_quoted_csv_in_byte_ranges(spark, tmp_path, size):
    rng, want = random.Random(3), []
    for f in range(2):
        cells = ["a", 'x"y', "l1\nl2", '"', "", "a,b", "é\r\nz", "long " * 60 + "\n" * 3]
        rows = [[str(k), rng.choice(cells), rng.choice(["q", "", "\n"])] for k in range(60)]
        rows[30][1] = 'in "quotes"\n' * 300  # over many ranges
        with open(tmp_path / f"{f}.csv", "w", newline="", encoding="utf-8") as out:
            out.write("﻿")
            writer = csv.writer(out, lineterminator="\r\n" if f else "\n")
            writer.writerows([["n", "t", "z"], *rows])
        want += [tuple(c or None for c in r) for r in rows]
    before = spark.conf.get(SPLITS)
    spark.conf.set(SPLITS, size)
    try:
        read = tables.read_csv_table(spark, str(tmp_path))
        assert read.columns == ["n", "t", "z"]
        assert sorted(map(str, map(tuple, read.collect()))) == sorted(map(str, want))
        assert tables.read_csv_grid(spark, str(tmp_path)).filter("_c0 = 'n' AND _c2 = 'z'").count() == 2
        if size == "200":
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set(SPLITS, before)


def test_csv_without_a_last_line_end_and_with_an_open_quote(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h,i\n1,2\n\n3,"4\n5"')
    assert sorted(map(tuple, tables.read_csv_table(spark, str(tmp_path / "a.csv")).collect())) == [("1", "2"), ("3", "4\n5")]
    (tmp_path / "b.csv").write_text('h,i\n1,"open\nto the end')
    assert tables.read_csv_table(spark, str(tmp_path / "b.csv")).count() == 1


def test_paths_of_trees_and_circles(spark):
    parents = {f"c{k}": f"c{k - 1}" if k else None for k in range(40)} | {"r1": "r2", "r2": "r3", "r3": "r1", "tail": "r1", "lost": "nowhere", "self": "self"}
    rows = [("S", 2024, code, code.upper(), parent) for code, parent in parents.items()]
    df = spark.createDataFrame(rows, "section_id string, fiscal_year int, code string, title string, parent_code string")

    def walk(code):
        seen, path, up = {code}, [code.upper()], parents[code]
        while up in parents and up not in seen:
            seen.add(up)
            path.insert(0, up.upper())
            up = parents[up]
        return path

    assert {r["code"]: r["path"] for r in hierarchy.hierarchy_path(df).collect()} == {c: walk(c) for c in parents}


def test_years_are_laid_out_for_every_group(spark):
    rows = [("a", 2023, 5.0), ("a", 2030, 1.0), ("b", None, 2.0)]
    shape = "section_id string, fiscal_year int, original double"
    df = spark.createDataFrame(rows, shape).selectExpr(
        "*", "original AS updated", "CAST(NULL AS DOUBLE) AS actual", "original AS estimated", "'x' AS code", "1 AS level", "true AS is_leaf", "'estimate' AS status"
    )
    got = {(r["section_id"], r["fiscal_year"]): (r["original"], r["execution"], r["record_count"]) for r in hierarchy.aggregate_by_year(df, [2022, 2023], ["section_id"]).collect()}
    assert got == {("a", 2022): (None, None, 0), ("a", 2023): (5.0, 5.0, 1), ("b", 2022): (None, None, 0), ("b", 2023): (None, None, 0)}


def test_cube_equals_separate_totals(spark):
    rng = random.Random(4)
    rows = [
        (rng.choice(["S1", "S2", None]), rng.choice(["x", "y", None]), rng.choice(["e", None]), "k", rng.choice(["m", "n", None]), rng.choice([None, 1.0, 7.0]), 1.0)
        for _ in range(200)
    ]
    df = spark.createDataFrame(rows, "section_id string, supplier string, entity_id string, entity_kind string, method string, volume double, executed double")
    cube = contracts.contract_cube(df)

    def rows_of(frame):
        return sorted(map(str, (tuple(r) for r in frame.collect())))

    assert rows_of(contracts.supplier_totals(df, cube)) == rows_of(contracts.supplier_totals(df))
    assert rows_of(contracts.contract_totals(df, cube=cube)) == rows_of(contracts.contract_totals(df))
    assert rows_of(contracts.method_mix(df, cube=cube)) == rows_of(contracts.method_mix(df))


def test_a_hot_group_is_ranked_in_ranges(spark):
    rows = [("hot", float(k % 50), k) for k in range(900)] + [("cold", 1.0, 1), ("cold", None, 2), ("cold", float("nan"), 3), ("cold", 4.0, 0)]
    ranked = ranking.rank_of(spark.createDataFrame(rows, "g string, v double, k int"), ["g"], "v", "k").collect()
    want = {}
    for g in ("hot", "cold"):
        usable = sorted((-v, k) for h, v, k in rows if h == g and v is not None and v == v)
        want |= {(g, k): (place, len(usable)) for place, (_, k) in enumerate(usable, 1)}
    assert {(r["g"], r["k"]): (r["rank"], r["out_of"]) for r in ranked} == want
