"""What the findings of round three asked for."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from publedger.operators import classify, extract, matching
from publedger.plans import load, texts
from publedger.plans.registry import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
load()


def test_rows_of_the_word_search_carry_numbers_and_no_texts(spark, monkeypatch):
    seen, real = [], classify.word_matches
    monkeypatch.setattr(classify, "word_matches", lambda texts, needles: seen.append(dict(texts.dtypes)["text_id"]) or real(texts, needles))
    lexicon = spark.createDataFrame([(0, "שלום רב", "a", 1, "high"), (1, "בית", "b", 2, "low"), (2, "|", "c", 3, "low")], "seq int, keyword string, category string, priority int, confidence string")
    subjects = ["שלום רב לבית", "הבית", None, "הבית", "x | y", "", "שלום", "z | y"]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(subjects)], "id int, subject string")
    got = {r["id"]: (r["category"], r["matched_keyword"]) for r in classify.classify_subject(rows, lexicon, [], []).collect()}
    want = [("a", "שלום רב"), ("b", "בית"), ("unspecified", None), ("b", "בית"), ("c", "|"), ("unspecified", None), ("unclassified", None), ("c", "|")]
    assert got == dict(enumerate(want))
    distinct = classify.classify_distinct(rows.filter(F.col("subject").isNotNull()), lexicon, [], [])
    assert distinct.count() == 6 and distinct.columns == ["subject", "category", "matched_keyword", "matched_confidence", "rule"]
    audited = {r["keyword"]: (r["hits"], r["examples"]) for r in classify.audit_lexicon(rows, lexicon).collect()}
    assert audited == {"שלום רב": (1, "שלום רב לבית"), "בית": (3, "הבית || שלום רב לבית"), "|": (2, "x | y || z | y")}
    assert seen == ["bigint"] * 3


def test_a_window_year_inside_a_name_counts_in_query_and_sql(spark, tmp_path):
    names = ["Customer#000002023", "Customer#000000007"]
    spark.createDataFrame(list(enumerate(names)), "c_custkey long, c_name string").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    orders = [(8 * c + k, c, dt.date(1997, 1, 1)) for c in range(2) for k in range(8)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    connection = duckdb.connect()
    for table in ("customer", "orders"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["t12_is_relevant"](spark, str(tmp_path)).collect())
    assert got == sorted(connection.sql(ORACLE["t12_is_relevant"]).fetchall())
    assert dict(got)[7] and not dict(got)[15]


def test_fields_of_every_kind_are_mapped(spark):
    targets = {r["target"] for r in QUERIES["t23_map_fields"](spark, SMALL).collect()}
    assert targets == {"subject", "start_date", "start_time", "end_date", "end_time", "location", "participants"}


def test_meetings_of_one_entity_look_for_its_names_alone(spark, monkeypatch):
    day, looked = dt.date(2024, 1, 1), []
    pool = spark.createDataFrame([("S", n, 1, "supplier", n.replace("/", " ")) for n in ("Alpha/One", "Alpha Two", "Beta Ltd")], "section_id string, name string, amount int, kind string, needle string")
    rows = [("1", "S", "p", "r", "k", day, "meet Alpha/One", "t"), ("2", "S", "p", "r", "k", day, "meet Beta Ltd", "t")]
    entries = spark.createDataFrame(rows, "entry_id string, section_id string, person_label string, role_label string, person_key string, date date, subject string, title string")
    entries = entries.withColumn("subject", F.replace("subject", F.lit("/"), F.lit(" ")))
    deals = spark.createDataFrame([("S", "Alpha/One", day, 1), ("S", "Beta Ltd", day, 2)], "section_id string, supplier string, order_date date, seq int")
    real = matching.cross_reference
    every = real(entries, pool)
    monkeypatch.setattr(matching, "cross_reference", lambda e, p: looked.extend(r["name"] for r in p.collect()) or real(e, p))
    matches, timed = matching.entity_meetings(entries, pool, deals, "Alpha-One")
    assert looked == ["Alpha/One"] and every.count() == 2
    want = [tuple(r) for r in matching.meeting_timing(every, deals).collect() if r["matched_name"] == "Alpha/One"]
    assert [tuple(r) for r in timed.collect()] == want and len(want) == matches.count() == 1


def test_occurrences_read_the_written_evidence(spark, monkeypatch):
    seen, real = [], texts.inference.name_occurrences
    monkeypatch.setattr(texts.inference, "name_occurrences", lambda *parts: seen.append(len(parts)) or real(*parts))
    QUERIES["x8_name_occurrences"](spark, SMALL)
    assert seen == [3]


def test_grids_are_read_from_what_was_written(spark, monkeypatch):
    written, real = [], extract.cut_lineage
    monkeypatch.setattr(extract, "cut_lineage", lambda df, name: written.append(name) or real(df, name))
    cells = [("d", 0, 0, "נושא"), ("d", 0, 1, "תאריך"), ("d", 1, 0, "talk"), ("d", 2, 1, "1.1.2024"), ("e", 0, 0, "x")]
    rows, report = extract.extract_grid(spark.createDataFrame(cells, "doc string, row int, col int, value string"))
    assert written == ["grid-headers", "grid-values"] and rows.count() == 2
    assert sorted(tuple(r) for r in report.collect()) == [("d", True, 2, 0, 0), ("e", False, 0, 1, 0)]
