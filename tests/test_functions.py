"""Exact values of the column functions, with a null case and a threshold case each."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from publedger.functions import dates, labels, numbers, text, titles, web


def check(spark, schema, cases, column):
    """``cases``: rows whose last cell is the expected value of ``column``."""
    df = spark.createDataFrame([c[:-1] for c in cases], schema)
    got = [r[0] for r in df.select(column).collect()]
    assert got == [c[-1] for c in cases]


def test_half_up_goes_towards_plus_infinity(spark):
    check(spark, "x double", [(-2.5, -2), (2.5, 3), (-2.51, -3)], numbers.half_up(F.col("x")))


def test_shares_and_changes(spark):
    cases = [(1.0, 3.0, 33.3), (1.0, 0.0, None), (1.0, -5.0, None), (None, 3.0, None), (float("nan"), 3.0, None)]
    check(spark, "a double, b double", cases, numbers.share_of("a", "b"))
    changes = [(100.0, 150.0, 50.0), (-100.0, -50.0, 50.0), (0.0, 5.0, None), (None, 5.0, None)]
    check(spark, "a double, b double", changes, numbers.change_percent("a", "b"))
    signed = [(-100.0, -50.0, -50.0), (0.0, 5.0, None)]
    check(spark, "a double, b double", signed, numbers.budget_change_percent("a", "b"))


def test_execution_rate_prefers_actual_and_needs_a_positive_budget(spark):
    cases = [(90.0, 50.0, 100.0, 90.0), (None, 50.0, 100.0, 50.0), (None, None, 100.0, None), (5.0, None, 0.0, None), (5.0, None, -1.0, None)]
    check(spark, "a double, e double, u double", cases, numbers.execution_rate("a", "e", "u"))


def test_large_change_needs_both_limits(spark):
    m = 1_000_000.0
    cases = [(250 * m, 300 * m, True), (1000 * m, 1050 * m, False), (10 * m, 20 * m, False), (None, 20 * m, False)]
    check(spark, "a double, b double", cases, numbers.is_large_change("a", "b"))


def test_rate_outlier_edges(spark):
    check(spark, "r double", [(150.0, False), (150.1, True), (-0.1, True), (0.0, False), (None, False)], numbers.rate_outlier("r"))


def test_read_measure(spark):
    cases = [("1,234.5", 1234.5), ("-7", -7.0), (" ", None), ("n/a", None), ("1 2", None), (None, None), ("NaN", None)]
    check(spark, "x string", cases, numbers.read_measure("x"))


def test_add_nullable(spark):
    check(spark, "a int, b int", [(None, None, None), (1, None, 1), (None, 2, 2), (1, 2, 3)], numbers.add_nullable("a", "b"))


def test_diary_dates(spark):
    day = dt.date
    cases = [
        ("2023-01-01", day(2023, 1, 1)), ("2023-01-01T09:30:00", day(2023, 1, 1)), ("15/02/2024", day(2024, 2, 15)),
        ("5.3.24", day(2024, 3, 5)), ("45292", day(2024, 1, 1)), ("רבעון ראשון", None), ("", None), ("123", None), (None, None),
        ("2023-02-30", None), ("31/13/2024", None), ("1-2-2024", None),
    ]
    check(spark, "x string", cases, dates.parse_diary_date("x"))


def test_diary_times(spark):
    cases = [("13:30", "13:30"), ("9:05:00", "09:05"), ("2023-01-01T09:05:00", "09:05"), ("0.5", "12:00"), ("99:99", None), ("", None), ("1.5", None), (None, None)]
    check(spark, "x string", cases, dates.parse_diary_time("x"))


def test_periods(spark):
    check(spark, "d date", [(dt.date(2024, 1, 31), "2024-Q1"), (dt.date(2024, 12, 31), "2024-Q4")], dates.quarter_of("d"))
    check(spark, "d date", [(dt.date(2026, 8, 14), True), (dt.date(2026, 8, 15), True), (dt.date(2026, 8, 16), False)], dates.is_weekend("d"))
    cases = [
        ("2025 (רבעון ראשון ושלישי)", ["2025-Q1", "2025-Q2", "2025-Q3"]), ("שנת 2024", [f"2024-Q{q}" for q in range(1, 5)]),
        ("רבעון שני", []), ("2024 לשנים", [f"2024-Q{q}" for q in range(1, 5)]), (None, []),
    ]
    check(spark, "x string", cases, dates.published_quarters("x"))


def test_usable_clock(spark):
    cases = [("09:00", None, True), ("09:00", "09:00", False), ("00:00", "10:00", False), ("00:20", None, True), (None, "10:00", False)]
    check(spark, "s string, e string", cases, dates.usable_clock("s", "e"))


@pytest.mark.parametrize(
    "haystack, needle, expected",
    [
        ("נסיעה לירושלים", "סיעה", False), ("מעקב הוצאות והכנסות", "כנס", False), ("התכנסות מחלקתית", "כנס", False),
        ("דיון בנושא חברתי", "חברת", False), ("כינוס סיעה", "סיעה", True), ("הצבעה בכנסת", "כנסת", True),
        ("דיון ולסיעה הודע", "סיעה", True), ("חברת בזק", "חברת", True), ("ביקור במרכז הרפואי", "ביקור ב", True), ("x", "", False),
    ],
)
def test_whole_words(one, haystack, needle, expected):
    assert one(text.matches_as_word("h", "n"), h=(haystack, "string"), n=(needle, "string")) is expected


def test_text_forms(one):
    assert one(text.norm_text("x", lower=True), x=(" שָׁלוֹם  ABC\n", "string")) == "שלום abc"
    assert one(text.norm_subject("x"), x=("FW:RE: הזמנה: פגישה‏ בע״מ", "string")) == 'פגישה בע"מ'
    assert one(text.norm_entity("x"), x=("קבוצת שלמה (החזקות) בע״מ", "string")) == "קבוצת שלמה"
    assert one(text.person_id("x"), x=(' אב "גד" / ה ', "string")) == "אב-גד---ה"
    assert one(text.person_key("s", "r", "p"), s=(None, "string"), r=("שר", "string"), p=(None, "string")) == "unattributed|שר|—"


def test_government_names(spark):
    cases = [("משרד הבריאות", True), ("רשות המים", True), ("שירותי בריאות כללית", False), ("משרדי", False)]
    check(spark, "x string", cases, text.is_government_name("x"))


def test_generic_subjects(spark):
    cases = [("פגישה", True), ("  ישיבה  ", True), ("פגישה!", True), ("", True), ("פגישה עם ראש העיר", False)]
    check(spark, "x string", cases, text.is_generic("x", ["פגישה", "ישיבה"]))


def test_method_buckets(spark):
    cases = [(None, text.METHOD_UNREPORTED), ("ILS", text.METHOD_UNREPORTED), ("בפטור מלא", text.METHOD_EXEMPT), ("מכרז פומבי", "מכרז פומבי")]
    check(spark, "x string", cases, text.norm_method("x"))


def test_titles(spark):
    df = spark.createDataFrame(
        [('יומן מנכ"ל משרד הבריאות, משה בר סימן טוב, לשנת 2026 (רבעון ראשון)',), ("יומן סגנית שר האוצר לשנת 2023",), ("יומן שר התיירות 2019",), ("יומן מזכיר הממשלה מר יוסי פוקס, לשנת 2025",)],
        "t string",
    )
    rows = df.select(*titles.parse_title("t")).collect()
    assert [r.person_role for r in rows] == ["director_general", "deputy_minister", "minister", "other_senior"]
    assert [r.person_label for r in rows] == ["משה בר סימן טוב", None, None, None]
    assert [r.period_label for r in rows] == ["2026 (רבעון ראשון)", "2023", None, "2025"]
    relevant = [
        ("יומן שר הבריאות, חיים כץ, לשנת 2026 (רבעון ראשון)", True), ("יומן השר יריב לוין 1.1.23-18.6.23", True),
        ("עיריית כפר סבא - יומן קובי פדוה לשנת 2025", False), ("יומן שר התקשורת 2019", False),
    ]
    check(spark, "t string", relevant, titles.is_relevant("t"))
    shared = [
        ('יומן שר הרווחה, יעקב מרגי ויומן מנכ"ל משרד הרווחה, ינון אהרוני', True), ("יומני שרי ממשלת ישראל שנת 2023", True),
        ('יומני השר לביטחון לאומי, איתמר בן גביר ומנכ"ל המשרד, רפאל אנגל', True), ("יומני שר החוץ, אלי כהן, לשנת 2023 (רבעון ראשון)", False),
    ]
    check(spark, "t string", shared, titles.covers_multiple("t"))


def test_addresses(spark):
    cases = [
        ("../a/b?x", "http://h.com/p/q/r.html", "http://h.com/p/a/b?x"), ("/x/../y", "http://h.com/p/", "http://h.com/y"),
        ("?q=1", "http://h.com", "http://h.com/?q=1"), ("http://z.com", "http://h.com", "http://z.com/"),
        ("c.pdf", "http://h.com/d/e", "http://h.com/d/c.pdf"), ("//k.org/a", "https://h.com/d", "https://k.org/a"), ("/é a", "http://h.com/", "http://h.com/%C3%A9%20a"),
    ]
    check(spark, "h string, b string", cases, web.resolve_url(F.col("h"), F.col("b")))
    archived = "https://web.archive.org/web/1id_/https://x.org/dataset/abc/resource/1"
    parsed = spark.createDataFrame([(archived,), ("https://x.org/none",)], "u string").select(web.parse_archive_url("u").alias("a")).collect()
    assert parsed[0].a.dataset_id == "abc" and parsed[1].a is None


def test_source_rules(spark):
    df = spark.createDataFrame(
        [("https://mof.gov.il/about/documents/budget/Budget2024-Health.pdf", "משרד החינוך"), ("https://fs.knesset.gov.il/globaldocs/MMM/1", "משרד החינוך 2025"), ("https://next.obudget.org/i", "כללי")],
        "url string, title string",
    )
    rows = df.select(*web.classify_source("url", "title")).collect()
    assert [r.source_type for r in rows] == ["budget_book", "knesset_research", "secondary_budget_layer"]
    assert [r.section_ids for r in rows] == [["health"], ["education"], []]
    assert [r.fiscal_years for r in rows] == [[2024], [2025], []]
    assert rows[2].reliability == "secondary_helper"


def test_display(spark):
    cases = [(1_250_000_000.0, '1.25 מיליארד ש"ח'), (1_234_567.0, '1.23 מיליון ש"ח'), (-999.5, '־1,000 ש"ח'), (None, "—")]
    check(spark, "v double", cases, labels.fmt_money("v"))
    check(spark, "v double", [(75e9, "75 מיליארד"), (1_250.0, "1.3 אלף"), (None, "—")], labels.fmt_money("v", "axis"))
    check(spark, "v double", [(12.34, "12.3%"), (-0.01, "0.0%"), (None, "—")], labels.fmt_percent("v"))
    check(spark, "a date, b date", [(dt.date(2022, 12, 29), None, "29.12.2022 – מכהן/בתוקף"), (None, None, labels.MISSING_LABEL)], labels.fmt_range("a", "b"))
    check(spark, "c string", [("final", "ביצוע סופי"), ("odd", "odd")], labels.label_of("c", labels.DATA_STATUS))
