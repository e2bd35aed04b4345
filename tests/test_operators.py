"""Edge cases of the DataFrame operators, with exact rows."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from publedger.operators import calendar as cal
from publedger.operators import classify, common, contracts, extract, hierarchy, inference, matching, quality, ranking, rules
from publedger.sources import sinks, tables

ITEM = "section_id string, fiscal_year int, code string, parent_code string, title string, level int, is_leaf boolean, original double, updated double, actual double, estimated double, status string"


def items(spark, *rows):
    return spark.createDataFrame([("S", y, c, p, c, lv, leaf, o, u, a, e, "partial") for y, c, p, lv, leaf, o, u, a, e in rows], ITEM)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=str)


def test_leaves_are_summed_without_their_parent(spark):
    df = items(
        spark,
        (2024, "1", None, 1, False, 100.0, 100.0, None, None),
        (2024, "11", "1", 2, True, 60.0, 70.0, 5.0, None),
        (2024, "12", "1", 2, True, None, 40.0, None, None),
        (2023, "1", None, 1, False, 10.0, None, None, None),
        (2023, "11", "1", 2, False, 7.0, 7.0, None, None),
    )
    total = hierarchy.sum_no_double_count(df, ["fiscal_year"])
    got = rows_of(total, "fiscal_year", "level_used", "original", "original_records", "updated", "actual", "estimated")
    assert got == [(2023, "1", 10.0, 1, None, None, None), (2024, "leaf", 60.0, 1, 110.0, 5.0, None)]


def test_missing_years_stay_null(spark):
    df = items(spark, (2024, "1", None, 1, True, 1.0, 2.0, None, 3.0))
    got = rows_of(hierarchy.aggregate_by_year(df, [2023, 2024]), "fiscal_year", "updated", "execution", "execution_is_estimate", "execution_status", "record_count")
    assert got == [(2023, None, None, False, "unavailable", 0), (2024, 2.0, 3.0, True, "partial", 1)]


def test_path_stops_at_a_cycle(spark):
    df = items(spark, (2024, "a", "b", 1, True, None, None, None, None), (2024, "b", "a", 1, True, None, None, None, None))
    assert rows_of(hierarchy.hierarchy_path(df), "code", "path") == [("a", ["b", "a"]), ("b", ["a", "b"])]


def test_waterfall_closes_and_keeps_nulls(spark):
    df = items(spark, (2024, "1", None, 1, True, 1000.0, 1500.0, 1200.0, None), (2023, "1", None, 1, True, None, None, None, None))
    requests = spark.createDataFrame([("S", 2024, 200.0), ("S", 2024, None)], "section_id string, year int, net double")
    steps = hierarchy.waterfall(df, requests)
    got = rows_of(steps.filter("fiscal_year = 2024"), "step", "kind", "value", "start", "end", "unexplained")
    assert got == [
        (1, "base", 1000.0, 0.0, 1000.0, 300.0), (2, "increase", 500.0, 1000.0, 1500.0, 300.0), (3, "total", 1500.0, 0.0, 1500.0, 300.0),
        (4, "decrease", -300.0, 1500.0, 1200.0, 300.0), (5, "total", 1200.0, 0.0, 1200.0, 300.0),
    ]
    assert {r["value"] for r in steps.filter("fiscal_year = 2023").collect()} == {None}


def test_hhi(spark):
    suppliers = spark.createDataFrame([("a", "x", 100.0), ("b", "x", 80.0), ("b", "y", 20.0), ("c", "x", 5.0)], "section_id string, supplier string, volume double")
    totals = spark.createDataFrame([("a", 100.0), ("b", 100.0), ("c", 0.0)], "section_id string, total_volume double")
    assert rows_of(contracts.supplier_hhi(suppliers, totals), "section_id", "hhi") == [("a", 10000), ("b", 6800), ("c", None)]


LINE = "section_id string, code string, title string, year int, econ2 string, allocated double, revised double, executed double"
M = 1_000_000.0


@pytest.mark.parametrize(
    "cells, expected",
    [
        ((2024, None, None, 0.0, 0.9 * M), set()),
        ((2024, None, None, 0.0, 1.1 * M), {"executed_without_budget"}),
        ((2024, None, 10 * M, 10 * M, 20 * M), {"overspend"}),
        ((2024, None, 3 * M, 3 * M, 4 * M), set()),
        ((2024, None, 11 * M, 11 * M, 0.0), {"unexecuted_budget"}),
        ((2024, None, 11 * M, 11 * M, None), set()),
        ((2026, None, 11 * M, 11 * M, 0.0), set()),
        ((2024, None, 5 * M, 30 * M, 30 * M), {"in_year_reinforcement"}),
        ((2024, rules.RESERVE, 9 * M, 9 * M, 2 * M), {"reserve_executed"}),
    ],
)
def test_budget_rules(spark, cells, expected):
    year, econ2, allocated, revised, executed = cells
    df = spark.createDataFrame([("S", "1", "t", year, econ2, allocated, revised, executed)], LINE)
    assert {r.rule_id for r in rules.scan_anomalies(df, 2025).collect()} == expected


def test_jump_compares_allocations_of_adjacent_years(spark):
    rows = [("S", "1", "t", 2023, None, 5 * M, 90 * M, 1.0), ("S", "1", "t", 2024, None, 40 * M, 40 * M, 40 * M), ("S", "2", "t", 2022, None, 5 * M, None, None), ("S", "2", "t", 2024, None, 40 * M, None, None)]
    found = rules.scan_anomalies(spark.createDataFrame(rows, LINE), 2022)
    assert rows_of(found.filter("rule_id = 'enacted_jump'"), "code", "year") == [("1", 2024)]


ENTRY = "person_key string, entry_id string, seq long, date date, start_time string, end_time string, category string"


def test_overlaps_equal_the_pairs(spark):
    random.seed(5)
    day = dt.date(2024, 1, 1)
    rows, expected = [], 0
    for d in range(6):
        spans = [(s, s + random.choice([0, 5, 30, 200])) for s in (random.randrange(1, 1200, 5) for _ in range(40))]
        spans.append((0, 90))  # starts at 00:00, the all-day marker: never counted
        for i, (s, e) in enumerate(spans):
            clock = lambda m: f"{m // 60:02d}:{m % 60:02d}"
            rows.append(("p", f"{d}-{i}", len(rows), day + dt.timedelta(d), clock(s), clock(e), "diplomacy"))
        real = [(s, e) for s, e in spans if e > s and s > 0]
        expected += sum(a[0] < b[1] and b[0] < a[1] for a, b in itertools.combinations(real, 2))
    got = cal.double_booked(spark.createDataFrame(rows, ENTRY), ["person_key"]).first()
    assert got.double_booked_count == expected


def test_late_night_counts_through_05_59_and_marathons_need_two_timed_rows(spark):
    day = dt.date(2024, 1, 1)
    rows = [
        ("p", "1", 1, day, "05:59", "20:00", "diplomacy"), ("p", "2", 2, day, "06:00", None, "diplomacy"),
        ("p", "3", 3, day, "22:00", None, "diplomacy"), ("q", "4", 4, day, "01:00", "23:00", "diplomacy"), ("q", "5", 5, None, "23:00", None, "diplomacy"),
    ]
    df = spark.createDataFrame(rows, ENTRY)
    assert rows_of(cal.late_night(df, ["person_key"]), "person_key", "late_night_count") == [("p", 2), ("q", 1)]
    assert rows_of(cal.marathon_days(df, ["person_key"]), "person_key", "span") == [("p", 961)]


def test_middle_values_are_exact(spark):
    random.seed(3)
    data = {"a": [random.randint(-50, 50) for _ in range(501)], "b": [7] * 300 + [1e9], "c": [1.5, 2.5], "d": [4.0]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "g string, v double")
    for r in common.middle_values(df, ["g"], "v").collect():
        ordered = sorted(data[r.g])
        assert (r.n, r.lo, r.hi) == (len(ordered), ordered[(len(ordered) - 1) // 2], ordered[len(ordered) // 2])


def test_salted_cap_is_exact(spark):
    df = spark.range(5000).select(F.lit("hot").alias("g"), F.col("id"))
    kept = common.first_per_group(df, ["g"], [F.desc("id")], 1500)
    assert kept.count() == 1500 and kept.agg(F.min("id")).first()[0] == 3500


def test_diary_strength_uses_the_upper_median(spark):
    df = spark.createDataFrame([("r", 10.0), ("r", 20.0), ("r", None), ("z", 0.0)], "rule_id string, value double")
    assert rows_of(ranking.rank_diary_findings(df), "rule_id", "value", "strength") == [("r", 10.0, 0.5), ("r", 20.0, 1.0), ("r", None, 1.0), ("z", 0.0, 1.0)]


TENURE = "tenure_id string, person_name string, role string, section_id string, start_date date, end_date date"


def test_windows_split_between_holders(spark):
    d = dt.date
    rows = [("1", "A", "m", "S", d(2023, 1, 1), d(2023, 6, 30)), ("2", "B", "m", "S", d(2023, 7, 1), None), ("3", "C", "m", "S", None, None), ("4", "D", "m", "T", d(2023, 7, 1), d(2023, 12, 31)), ("5", "E", "m", "T", d(2023, 8, 1), d(2023, 9, 1))]
    windows = spark.createDataFrame([("S", d(2023, 1, 1), d(2023, 12, 31)), ("T", d(2023, 1, 1), d(2023, 12, 31)), ("U", d(2023, 1, 1), d(2023, 12, 31))], "section_id string, window_start date, window_end date")
    got = rows_of(matching.attribute_window(spark.createDataFrame(rows, TENURE), windows), "section_id", "segments", "is_split", "uncovered_days", "main_holder", "main_days")
    assert got == [("S", 2, True, 0, "B", 184), ("T", 2, True, 181, "D", 184), ("U", 0, False, 365, None, None)]


def test_meeting_meets_the_nearest_order(spark):
    d = dt.date
    matches = spark.createDataFrame([("S", 'בזק בע"מ', d(2024, 5, 1), "1"), ("S", "בזק", None, "2"), ("S", "אחר", d(2024, 5, 1), "3")], "section_id string, matched_name string, date date, entry_id string")
    held = spark.createDataFrame([("S", 'בזק בע"מ', d(2024, 6, 1), 1), ("S", "x", d(2024, 5, 2), 2), ("S", 'בזק בע"מ', d(2020, 1, 1), 3), ("S", "y", None, 4)], "section_id string, supplier string, order_date date, seq long")
    timed = matching.meeting_timing(matches, held)
    assert rows_of(timed, "entry_id", "contract_seq", "days_before_order", "within_window") == [("1", 1, 31, True)]
    got = matching.timing_summary(matches, held, timed).first()
    assert (got.timed, got.unplaceable, got.median_days_before, got.contracts_without_match, got.contracts_held) == (1, 2, 31.0, 2, 3)


ALIASES = [("learn", 0, "משרד החינוך"), ("road", 1, "משרד התחבורה"), ("works", 2, "המשרד לתשתיות"), ("sea", 3, "המשרד לתשתיות ימיות")]


def test_longest_alias_wins(spark):
    aliases = spark.createDataFrame(ALIASES, "section_id string, seq int, alias string")
    titles = spark.createDataFrame([("לוח השר לתשתיות ימיות, אביב",), ("לוח השר לתשתיות, סתיו",), ("לוח שרת התחבורה, פלונית",), ("לוח השר אלמוני",)], "title string")
    got = dict(rows_of(matching.match_title(titles, "title", aliases), "title", "section_id"))
    assert list(got.values()).count(None) == 1 and set(got.values()) == {"sea", "works", "road", None}


def test_anchored_search_equals_the_plain_one(spark):
    random.seed(9)
    letters = "abcדה "
    texts = [(i, " ".join("".join(random.choices(letters, k=60)).split())) for i in range(150)]
    pieces = {" ".join(t[a : a + n].split()) for _, t in texts[:40] for a, n in [(random.randrange(0, 30), random.choice([6, 9, 14, 25]))]}
    needles = sorted(p for p in pieces if len(p) >= 6)
    a = spark.createDataFrame(texts, "text_id int, text string")
    b = spark.createDataFrame([(n,) for n in needles], "needle string")
    want = sorted((i, n) for i, t in texts for n in needles if n in t)
    assert rows_of(matching.substring_matches(a, b), "text_id", "needle") == sorted(want, key=str)


LEXICON = [(0, "ישיבת ממשלה", "government_cabinet", 1, "high"), (1, "ישיבת הנהלה", "internal_management", 4, "high"), (2, 'בע"מ', "private_sector", 6, "high"), (3, "חברת", "private_sector", 6, "medium"), (4, "טלפוני", "meeting_without_subject", 90, "low"), (5, "ראיון", "media_pr", 7, "high"), (6, "ביקור ב", "field_visits", 8, "high")]


def test_subject_classification(spark):
    lexicon = spark.createDataFrame(LEXICON, "seq int, keyword string, category string, priority int, confidence string")
    cases = {
        "ישיבת ממשלה מיוחדת": "government_cabinet", 'פגישה עם נציגי חברת בזק בע״מ': "private_sector", "פגישה": "unspecified", "": "no_subject_recorded",
        "ללא נושא רשום": "no_subject_recorded", "דיון בנושא רפורמת הכשרות": "unclassified", "ראיון טלפוני": "media_pr", "שיחה טלפוני": "meeting_without_subject",
        None: "no_subject_recorded", "דיון חברתי": "unclassified", "FW: ביקור במרכז הרפואי": "field_visits",
    }
    rows = spark.createDataFrame([(s,) for s in cases], "subject string")
    got = classify.classify_subject(rows, lexicon, ["פגישה"], ["ללא נושא רשום"])
    assert {r.subject: r.category for r in got.collect()} == cases
    assert got.filter("rule = 'keyword_match' AND matched_keyword IS NULL").count() == 0


def test_panel_merge(spark):
    schema = "expert string, keyword string, category string, confidence string, reasoning string"
    rows = [
        ("media", "שגריר", "ceremonies", "low", ""), ("foreign", "שגריר", "diplomacy", "high", ""),
        ("foreign", "ועידה", "diplomacy", "medium", ""), ("media", "ועידה", "ceremonies", "medium", ""), ("politics", "ועידה", "ceremonies", "medium", ""),
        ("politics", "כינוס", "politics_party", "high", ""), ("foreign", "כינוס", "diplomacy", "high", ""), ("law", 'או״ם', "diplomacy", "high", "ב"), ("foreign", 'או"ם', "diplomacy", "high", "א"),
    ]
    ranks = spark.createDataFrame([("diplomacy", 11), ("politics_party", 12), ("ceremonies", 13)], "category string, priority int")
    none = spark.createDataFrame([], "keyword string, action string, to_category string")
    merged, _ = classify.merge_lexicon(spark.createDataFrame(rows, schema), ranks, none)
    got = {r.keyword: (r.category, r.resolved_by, r.experts) for r in merged.collect()}
    assert got == {
        "שגריר": ("diplomacy", "confidence", "foreign"), "ועידה": ("ceremonies", "majority", "media, politics"),
        "כינוס": ("diplomacy", "priority", "foreign"), 'או"ם': ("diplomacy", None, "foreign, law"),
    }


def test_name_decisions(spark):
    rows = [("a", "local_government", 5), ("a", "ceremonies", 1), ("b", "government_cabinet", 4), ("c", "diplomacy", 6), ("c", "media_pr", 5), ("d", "unclassified", 50)]
    tally = spark.createDataFrame(rows, "name string, category string, n long")
    assert rows_of(inference.decide_name_field(tally), "name", "category", "supporting_rows", "dominance") == [("a", "local_government", 5, 83.3)]


def test_overreach_limit(spark):
    def rows(n):
        return spark.createDataFrame([("דני כהן", "unclassified")] * n, "subject string, category string")

    decided = spark.createDataFrame([("דני כהן", "diplomacy", 5, 5, 100.0)], "name string, category string, supporting_rows long, classified_appearances long, dominance double")
    assert inference.refuse_overreach(rows(40), decided).count() == 0
    assert inference.refuse_overreach(rows(41), decided).count() == 1


def test_fields(spark):
    names = ["_id", "nvsh", "tryk htkhlh", "sh`t htkhlh", "עמודה מסתורית", "נושא"]
    df = spark.createDataFrame([("r", i, n) for i, n in enumerate(names)], "resource string, pos int, field_id string")
    mapped, unknown = extract.map_fields(df)
    assert rows_of(mapped, "field_id", "target") == [("nvsh", "subject"), ("sh`t htkhlh", "start_time"), ("tryk htkhlh", "start_date")]
    assert rows_of(unknown, "field_id") == [("עמודה מסתורית",)]


def test_grid(spark):
    def cells(doc, grid):
        return [(doc, r, c, v) for r, row in grid.items() for c, v in enumerate(row) if v is not None]

    good = {0: ["נושא", "תאריך התחלה", "שעת התחלה"], 1: ["ישיבת ממשלה", "45292", "09:30"], 2: [None, None, "10:00"], 4: ["אחרי רווח", None, None], 40: ["אחרי סוף", None, None]}
    bad = {0: ["ישיבה", "2024-01-01"], 1: ["פגישה", "2024-01-02"]}
    dates_only = {0: ["תאריך", "שעה"]}
    df = spark.createDataFrame(cells("good", good) + cells("bad", bad) + cells("dates", dates_only), "doc string, row int, col int, value string")
    rows, report = extract.extract_grid(df)
    assert rows_of(rows, "doc", "row", "subject", "start_date", "start_time") == [("good", 1, "ישיבת ממשלה", "45292", "09:30"), ("good", 4, "אחרי רווח", None, None)]
    assert rows_of(report, "doc", "header_found", "rows", "unparsed") == [("bad", False, 0, 2), ("dates", False, 0, 1), ("good", True, 2, 1)]


def test_text_lines(spark):
    text = "\n".join(["יומן השר לשנת 2025", "12.05.2025", '08:30 פורום מטכ"ל', "10:00-11:30 סיור בנמל חיפה", "13.05.2025", "09:00 ועדת הכספים", "01/03/2024 09:00-10:30 ישיבת הנהלה", "עמוד 1 מתוך 4"])
    rows, report = extract.extract_lines(spark.createDataFrame([("d", text)], "doc string, text string"))
    assert rows_of(rows, "start_date", "start_time", "end_time", "subject") == [
        ("01/03/2024", "09:00", "10:30", "ישיבת הנהלה"), ("12.05.2025", "08:30", None, 'פורום מטכ"ל'), ("12.05.2025", "10:00", "11:30", "סיור בנמל חיפה"), ("13.05.2025", "09:00", None, "ועדת הכספים"),
    ]
    assert report.first().unparsed == 2


def test_csv_bytes(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', ["x", "y"], None)], "n int, t string, l array<string>, z string").coalesce(1)
    sinks.write_csv(df, str(tmp_path / "out"))
    data = next((tmp_path / "out").glob("part-*.csv")).read_bytes().decode()
    assert data == '﻿n,t,l,z\r\n1,"a ""q"", b",x; y,\r\n'


def test_shards(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "section_id string, n int")
    index = sinks.write_shards(df, "section_id", str(tmp_path / "s"))
    assert rows_of(index, "shard_key", "entry_count") == [("a", 2), ("unattributed", 1)]
    assert tables.load_shard(spark, str(tmp_path / "s"), "a").count() == 2 and tables.load_shard(spark, str(tmp_path / "s"), "none").count() == 0


def test_truncated_pages_are_refused(spark):
    pages = spark.createDataFrame([("q",)] * 3, "query string")
    tables.require_complete(pages, spark.createDataFrame([("q", 3), ("r", None)], "query string, total long"))
    with pytest.raises(tables.IncompletePages):
        tables.require_complete(pages, spark.createDataFrame([("q", 4)], "query string, total long"))


def test_gate(spark):
    df = items(spark, (2024, "1", None, 1, False, 1.0, 10.0, None, None), (2024, "11", "1", 2, True, 1.0, 10.0, None, None))
    quality.gate({"leaf_sum": quality.leaf_sum_violations(df)})
    broken = df.withColumn("updated", F.when(F.col("level") == 1, 12.0).otherwise(F.col("updated")))
    with pytest.raises(quality.GateFailed):
        quality.gate({"leaf_sum": quality.leaf_sum_violations(broken)})
