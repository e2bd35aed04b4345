"""Queries over rule findings, summaries, insights and the quality gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from publedger.operators import calendar as cal
from publedger.operators import contracts as deals
from publedger.operators import filters, hierarchy, insights, matching, quality, ranking, rules, spending, summary
from publedger.plans import calendars, matches, texts
from publedger.plans.budget import SPINE
from publedger.plans.oracle import group_case, pct, share, values
from publedger.plans.registry import query
from publedger.session import cut_lineage
from publedger.sources import bindings as b
from publedger.sources import sinks

LIMITS = rules.AnomalyLimits(
    executed_without_budget=5_000_000,
    overspend_excess=5_000_000,
    unexecuted=10_000_000,
    jump_size=5_000_000,
    reinforcement_size=5_000_000,
    reserve_executed=20_000_000,
    reserve_label="ECONOMY",
)
CASES = {
    "executed_without_budget": "year <= 2000 AND revised = 0 AND executed > 5000000",
    "overspend": "year <= 2000 AND revised > 0 AND executed > revised * 1.25 AND executed - revised > 5000000",
    "unexecuted_budget": "year <= 2000 AND revised > 10000000 AND executed = 0",
    "enacted_jump": "prior > 0 AND abs(allocated - prior) > prior * 3 AND abs(allocated - prior) > 5000000",
    "in_year_reinforcement": "allocated > 0 AND revised - allocated > allocated * 3 AND revised - allocated > 5000000",
    "reserve_executed": "year <= 2000 AND econ2 = 'ECONOMY' AND executed > 20000000",
}
_M = "format('{:,}', {c}) || ' ש\"ח'"


def _money(c: str) -> str:
    return _M.replace("{c}", c)


EVIDENCE = {
    "executed_without_budget": f"'executed ' || {_money('executed')} || ' against zero'",
    "overspend": f"'executed ' || {_money('executed')} || ' against ' || {_money('revised')}",
    "unexecuted_budget": f"'revised ' || {_money('revised')} || ', executed zero'",
    "enacted_jump": f"'allocated ' || {_money('prior')} || ' then ' || {_money('allocated')}",
    "in_year_reinforcement": f"'from ' || {_money('allocated')} || ' to ' || {_money('revised')}",
    "reserve_executed": f"'executed ' || {_money('executed')} || ' out of a reserve'",
}
PRIOR = "SELECT a.*, p.allocated AS prior FROM regs a LEFT JOIN regs p ON p.section_id = a.section_id AND p.code = a.code AND p.year = a.year - 1"
FOUND = " UNION ALL ".join(
    f"SELECT section_id, code, title, year, econ2, allocated, revised, executed, '{r}' AS rule_id, {EVIDENCE[r]} AS evidence, abs(coalesce(executed, revised, 0)) AS sort_value FROM ({PRIOR}) WHERE {t}"
    for r, t in CASES.items()
)


def anomalies(spark, d):
    return rules.scan_anomalies(b.regulations(spark, d), b.CLOSED_YEAR_MAX, LIMITS)


def _rule_query(rule: str):
    def run(spark, d):
        found = filters.filter_findings(anomalies(spark, d), rule=rule)
        return found.select("section_id", "code", "year", "allocated", "revised", "executed", "evidence")

    return run


for number, name in enumerate(CASES, start=1):
    query(
        f"n{number}_{name}",
        f"SELECT section_id, code, year, allocated, revised, executed, {EVIDENCE[name]} AS evidence FROM ({PRIOR}) WHERE {CASES[name]}",
    )(_rule_query(name))


@query("n7_scan_anomalies", FOUND)
def _(spark, d):
    return anomalies(spark, d)


@query("n7_sorted_findings", f"SELECT rule_id, section_id, code, year, sort_value FROM ({FOUND}) ORDER BY sort_value DESC, section_id, code, year, rule_id")
def _(spark, d):
    return rules.sorted_findings(anomalies(spark, d)).select("rule_id", "section_id", "code", "year", "sort_value")


@query("n7_scanned_counts", "SELECT section_id, count(*) AS scanned FROM regs GROUP BY 1")
def _(spark, d):
    return rules.scanned_counts(b.regulations(spark, d))


HYGIENE = f"""SELECT v.rule_id, v.closed_years_only, count(f.code) AS finding_count, (SELECT count(*) FROM regs) AS scanned_count, floor(count(f.code) / CAST((SELECT count(*) FROM regs) AS DOUBLE) * 1000.0 * 10.0 + 0.5) / 10.0 AS rate_per_thousand,
          count(DISTINCT f.section_id) AS sections_affected FROM (VALUES ('executed_without_budget', true), ('overspend', true), ('unexecuted_budget', true), ('enacted_jump', false), ('in_year_reinforcement', false), ('reserve_executed', true)) v(rule_id, closed_years_only)
        LEFT JOIN ({FOUND}) f ON f.rule_id = v.rule_id AND f.rule_id <> 'unexecuted_budget' GROUP BY 1, 2"""


@query("n8_rule_hygiene", HYGIENE)
def _(spark, d):
    lines = b.regulations(spark, d)
    found = anomalies(spark, d).filter(F.col("rule_id") != "unexecuted_budget")
    return rules.rule_hygiene(found, rules.scanned_counts(lines))


GAP = "greatest(abs(coalesce(executed, 0) - coalesce(revised, 0)), abs(coalesce(revised, 0) - coalesce(allocated, 0)), CASE WHEN abs(coalesce(revised, allocated, 0)) = 0 THEN abs(coalesce(executed, 0)) ELSE 0 END)"
STRENGTH = f"""SELECT rule_id, section_id, code, year, sort_value, floor((CASE WHEN gap = 0 THEN 0.0 ELSE floor((least(1.0, log10(CAST(gap AS DOUBLE) + 1.0) / 10.0) * 0.6 + (CASE WHEN base > 0 THEN least(1.0, CAST(gap AS DOUBLE) / base) ELSE 1.0 END) * 0.4) * 100.0 + 0.5) / 100.0 END * 60.0
      + (CASE WHEN executed IS NOT NULL AND revised IS NOT NULL THEN 1.0 ELSE 0.5 END) * 20.0 + (1.0 - n / total) * 20.0) * 10.0 + 0.5) / 10.0 AS strength FROM (
    SELECT *, {GAP} AS gap, abs(coalesce(revised, allocated, 0)) AS base, count(*) OVER (PARTITION BY rule_id) AS n, count(*) OVER () AS total FROM ({FOUND}))"""


@query("w2_rank_anomalies", STRENGTH)
def _(spark, d):
    return ranking.rank_anomalies(anomalies(spark, d)).select("rule_id", "section_id", "code", "year", "sort_value", "strength")


# ---- summaries -------------------------------------------------------------------


def section_anomalies(spark, d):
    """Findings moved to the sections of the budget, so that both meet in one summary."""
    return anomalies(spark, d).withColumn("section_id", F.replace("section_id", F.lit("B"), F.lit("S")))


LATEST = f"""SELECT y.section_id, y.fiscal_year AS latest_year, y.original, y.updated, y.execution, y.execution_is_estimate, {share("y.execution", "y.updated")} AS execution_rate_percent,
      {share("y.updated", "sum(CASE WHEN y.updated > 0 THEN y.updated END) OVER ()")} AS share_of_total_percent, row_number() OVER (ORDER BY y.updated DESC, y.section_id) AS budget_rank, count(*) OVER () AS budget_rank_out_of
    FROM yearly y JOIN (SELECT section_id, max(fiscal_year) AS ly FROM totals WHERE updated IS NOT NULL GROUP BY 1) l ON l.section_id = y.section_id AND l.ly = y.fiscal_year"""
SUMMARY = f"""SELECT s.section_id, s.display_name, s.kind, l.latest_year, l.original, l.updated, l.execution, l.execution_is_estimate, l.execution_rate_percent, l.share_of_total_percent, l.budget_rank, l.budget_rank_out_of,
      t.score AS transparency_score, coalesce(t.entry_count, 0) AS diary_entry_count, coalesce(t.people_count, 0) AS diary_people_count, p.concentration_score AS procurement_score, p.exempt_volume_percent, p.lead_share_percent,
      coalesce(p.contract_count, 0) AS contract_count, m.share_percent AS subject_matter_percent, st.state, st.published, st.unread, coalesce(a.n, 0) AS activity_count, coalesce(f.n, 0) AS anomaly_count, coalesce(r.n, 0) AS recipient_count, coalesce(x.n, 0) AS match_count
    FROM ({calendars.SECTIONS}) s LEFT JOIN ({LATEST}) l ON l.section_id = s.section_id LEFT JOIN ({calendars.TRANSPARENCY}) t ON t.section_id = s.section_id LEFT JOIN procurement p ON p.section_id = s.section_id
    LEFT JOIN ({calendars.MATTER}) m ON m.section_id = s.section_id LEFT JOIN ({calendars.STATES}) st ON st.section_id = s.section_id LEFT JOIN (SELECT section_id, count(*) AS n FROM acts GROUP BY 1) a ON a.section_id = s.section_id
    LEFT JOIN (SELECT replace(section_id, 'B', 'S') AS section_id, count(*) AS n FROM ({FOUND}) GROUP BY 1) f ON f.section_id = s.section_id LEFT JOIN (SELECT section_id, count(*) AS n FROM all_recipients GROUP BY 1) r ON r.section_id = s.section_id
    LEFT JOIN (SELECT section_id, count(*) AS n FROM ({matches.CROSS}) GROUP BY 1) x ON x.section_id = s.section_id"""


def summarise(spark, d):
    diary = b.diary(spark, d)
    profiles = cal.person_profile(diary)
    contracts = b.contracts(spark, d)
    cube = deals.contract_cube(contracts)
    recipients = cut_lineage(deals.recipient_totals(b.payments(spark, d)), "recipients")
    pool = matching.name_pool(deals.supplier_totals(contracts, cube), recipients)
    sections = calendars.sections(spark, d)
    return summary.section_summary(
        sections,
        b.budget_items(spark, d),
        SPINE,
        cal.transparency_score(profiles),
        deals.procurement_index(contracts, cube=cube),
        cal.subject_matter_share(cal.category_counts(diary, ["section_id"]), ["section_id"]),
        cal.publication_state(sections, b.publications(spark, d)),
        b.activities(spark, d),
        section_anomalies(spark, d),
        recipients,
        matching.cross_reference(diary, pool),
    )


@query("s1_section_summary", SUMMARY)
def _(spark, d):
    return summary.sorted_sections(summarise(spark, d))


def summary_tables(spark, d):
    return {
        "sections": calendars.sections(spark, d),
        "budget_items": b.budget_items(spark, d),
        "activities": b.activities(spark, d),
        "diary_entries": b.diary(spark, d),
        "profiles": cal.person_profile(b.diary(spark, d)),
        "sources": b.sources(spark, d),
        "tenures": b.tenures(spark, d),
        "anomalies": anomalies(spark, d),
        "contracts": b.contracts(spark, d),
    }


@query(
    "s2_site_summary",
    f"""SELECT 'sections' AS name, count(*) AS n FROM nation UNION ALL SELECT 'budget_items', count(*) FROM items UNION ALL SELECT 'activities', count(*) FROM acts UNION ALL SELECT 'diary_entries', count(*) FROM diary
        UNION ALL SELECT 'profiles', count(*) FROM prof UNION ALL SELECT 'sources', count(*) FROM srcs UNION ALL SELECT 'tenures', count(*) FROM tenures UNION ALL SELECT 'anomalies', count(*) FROM ({FOUND}) UNION ALL SELECT 'contracts', count(*) FROM contracts""",
)
def _(spark, d):
    return summary.site_summary(summary_tables(spark, d))


@query(
    "s2_site_trend",
    """SELECT g.y AS fiscal_year, CAST(sum(t.original) AS BIGINT) AS original, CAST(sum(t.updated) AS BIGINT) AS updated FROM (SELECT unnest(range(1995, 2004)) AS y) g
       LEFT JOIN (SELECT fiscal_year, original, updated FROM items WHERE is_leaf) t ON t.fiscal_year = g.y GROUP BY 1""",
)
def _(spark, d):
    return hierarchy.aggregate_by_year(b.budget_items(spark, d), SPINE).select("fiscal_year", "original", "updated")


@query("s3_compare_sections", f"SELECT section_id, display_name, procurement_score AS value FROM ({SUMMARY}) WHERE kind = 'ministry'")
def _(spark, d):
    return summary.compare_sections(summarise(spark, d), "procurement", "ministry")


COVERED = f"""SELECT s.section_id, coalesce(c.n, 0) AS sources, coalesce(c.r, 0) AS retrieved, coalesce(i.n, 0) AS budget_records, coalesce(a.n, 0) AS activities, coalesce(i.years, '') AS years, coalesce(i.ny, 0) AS ny FROM ({calendars.SECTIONS} UNION ALL SELECT 'S99', 'none', 'other') s
    LEFT JOIN (SELECT sid, count(*) AS n, count(*) FILTER (retrieval_status = 'retrieved') AS r FROM (SELECT unnest(section_ids) AS sid, retrieval_status FROM cat) GROUP BY 1) c ON c.sid = s.section_id
    LEFT JOIN (SELECT section_id, count(*) AS n, string_agg(DISTINCT CAST(fiscal_year AS VARCHAR), ', ' ORDER BY CAST(fiscal_year AS VARCHAR)) AS years, count(DISTINCT fiscal_year) AS ny FROM items GROUP BY 1) i ON i.section_id = s.section_id
    LEFT JOIN (SELECT section_id, count(*) AS n FROM acts GROUP BY 1) a ON a.section_id = s.section_id"""


def covered(spark, d):
    sections = calendars.sections(spark, d)
    extra = spark.createDataFrame([("S99", "none", "other")], sections.schema)
    return summary.coverage(
        sections.unionByName(extra), b.catalogue(spark, d), b.budget_items(spark, d), b.activities(spark, d), SPINE
    )


@query(
    "s4_coverage",
    f"""SELECT section_id, sources, retrieved, budget_records, activities, years, concat_ws(', ', CASE WHEN budget_records = 0 THEN 'no_budget_records' END, CASE WHEN activities = 0 THEN 'no_activities' END,
          CASE WHEN retrieved = 0 AND sources > 0 THEN 'no_source_retrieved' END, CASE WHEN ny > 0 AND ny < 9 THEN 'some_years_only' END) AS limitations FROM ({COVERED})""",
)
def _(spark, d):
    return covered(spark, d)


@query(
    "s5_version_counts",
    f"""WITH c AS ({COVERED}), t AS (SELECT unnest(topics) AS topic FROM acts)
        SELECT 'sections' AS name, count(*) AS n FROM c UNION ALL SELECT 'sections_with_budget', count(*) FILTER (budget_records > 0) FROM c UNION ALL SELECT 'sections_with_activity', count(*) FILTER (activities > 0) FROM c
        UNION ALL SELECT 'budget_items', CAST(sum(budget_records) AS BIGINT) FROM c UNION ALL SELECT 'activity_items', CAST(sum(activities) AS BIGINT) FROM c UNION ALL SELECT 'tenures', count(*) FROM tenures UNION ALL SELECT 'tenures_ended', count(end_date) FROM tenures
        UNION ALL SELECT 'sources', count(*) FROM srcs UNION ALL SELECT 'sources_retrieved', count(*) FILTER (retrieval_status = 'retrieved') FROM srcs UNION ALL SELECT 'topics_defined', 4 UNION ALL SELECT 'topics_with_activity', count(DISTINCT topic) FILTER (topic IN ('en', 'fr', 'long', 'nobody')) FROM t""",
)
def _(spark, d):
    from publedger.operators.classify import topic_counts

    topics = topic_counts(b.activities(spark, d), ["en", "fr", "long", "nobody"])
    return summary.version_counts(covered(spark, d), b.tenures(spark, d), b.sources(spark, d), topics)


@query(
    "s6_theme_counts",
    "SELECT t.theme_id, count(a.code) AS line_count FROM themes t LEFT JOIN (SELECT DISTINCT i.section_id, i.code, a.theme_id FROM items i JOIN assigned a ON a.section_id = i.section_id AND a.code = i.code WHERE i.level IN (2, 3)) a ON a.theme_id = t.theme_id GROUP BY 1",
)
def _(spark, d):
    return summary.theme_counts(b.themes(spark, d), b.assignments(spark, d), b.budget_items(spark, d))


@query("s6_covered_sections", "SELECT DISTINCT section_id FROM assigned")
def _(spark, d):
    return summary.covered_sections(b.assignments(spark, d))


@query("s7_sources_by_publisher", "SELECT publisher, count(*) AS sources FROM cat GROUP BY 1")
def _(spark, d):
    return summary.sources_by_publisher(b.catalogue(spark, d))


@query(
    "s8_person_profiles",
    """SELECT person_name, count(*) AS tenures, string_agg(DISTINCT section_id, ', ' ORDER BY section_id) AS section_ids, string_agg(DISTINCT role, ', ' ORDER BY role) AS roles, CAST(min(start_date) AS VARCHAR) AS first_start,
         CASE WHEN bool_and(end_date IS NOT NULL) THEN CAST(max(end_date) AS VARCHAR) END AS last_end, bool_and(end_date IS NOT NULL) AS has_ended, replace(person_name, ' ', '-') AS person_id FROM tenures GROUP BY 1""",
)
def _(spark, d):
    return summary.person_profiles(b.tenures(spark, d))


@query(
    "s9_collection_totals",
    """SELECT 'method_' || method AS name, count(*) AS n FROM diary GROUP BY 1 UNION ALL SELECT 'publications', count(*) FROM pubs UNION ALL SELECT 'publications_with_rows', count(*) FILTER (readable_entries > 0) FROM pubs
       UNION ALL SELECT 'publications_unattributed', count(*) FILTER (section_id IS NULL) FROM pubs UNION ALL SELECT 'unreadable_files', CAST(sum(unreadable) AS BIGINT) FROM pubs""",
)
def _(spark, d):
    return summary.collection_totals(b.diary(spark, d), b.publications(spark, d))


@query(
    "s10_archive_reads",
    """SELECT * FROM (SELECT url, 'https://odata.org.il/dataset/' || (seq % 40) || '/resource/' || (seq % 3) AS resource_url, CAST(seq % 40 AS VARCHAR) AS dataset_id, min(attempted_at) AS attempted_at FROM att WHERE seq % 5 = 0 GROUP BY ALL)""",
)
def _(spark, d):
    return summary.archive_reads(b.attempts(spark, d))[0].drop("bytes")


@query("s10_archive_totals", "SELECT count(*) AS reads, count(DISTINCT url) AS distinct_copies FROM att WHERE seq % 5 = 0")
def _(spark, d):
    return summary.archive_reads(b.attempts(spark, d))[1]


@query(
    "s11_headline_context",
    f"""WITH k AS (SELECT * FROM yearly WHERE updated IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY fiscal_year DESC) AS newest, lead(updated) OVER (PARTITION BY section_id ORDER BY fiscal_year DESC) AS prev,
          row_number() OVER (PARTITION BY fiscal_year ORDER BY updated DESC, section_id) AS rank, count(*) OVER (PARTITION BY fiscal_year) AS out_of, sum(CASE WHEN updated > 0 THEN updated END) OVER (PARTITION BY fiscal_year) AS tot FROM k)
        SELECT section_id, fiscal_year, updated, {share("updated", "tot")} AS share_percent, {pct("updated - prev", "abs(prev)")} AS change_percent, rank, out_of FROM r WHERE newest = 1""",
)
def _(spark, d):
    return summary.headline_context(b.budget_items(spark, d), SPINE)


# ---- insights -------------------------------------------------------------------


def _insight(insight, kind, section, figure, second, size, strength, source):
    return f"SELECT '{insight}' AS insight_id, '{kind}' AS kind, CAST({section} AS VARCHAR) AS section_id, CAST({figure} AS DOUBLE) AS figure, CAST({second} AS DOUBLE) AS second_figure, CAST({size} AS BIGINT) AS field_size, CAST({strength} AS DOUBLE) AS strength FROM {source}"


I1 = _insight(
    "unused_balance", "execution", "section_id", "u", share("u", "updated"), "n", 92,
    "(SELECT *, row_number() OVER (ORDER BY u DESC, section_id) AS rn, count(*) OVER () AS n FROM (SELECT section_id, updated, updated - actual AS u FROM totals WHERE fiscal_year = 2000 AND updated > 0 AND updated - actual > 0)) WHERE rn = 1",
)
I2 = _insight(
    "in_year_growth", "budget", "section_id", "u", share("u", "original"), "(SELECT count(*) FROM requests r WHERE r.year = 2001 AND r.section_id = z.section_id)", 84,
    "(SELECT *, row_number() OVER (ORDER BY u DESC, section_id) AS rn FROM (SELECT section_id, original, updated - original AS u FROM totals WHERE fiscal_year = 2001 AND original > 0 AND updated - original > 0)) z WHERE rn = 1",
)
I3 = _insight(
    "exempt_tender", "procurement", "section_id", "exempt_volume_percent", "contract_count", "n", 78,
    "(SELECT *, row_number() OVER (ORDER BY exempt_volume_percent DESC, section_id) AS rn, count(*) OVER () AS n FROM procurement WHERE contract_count >= 200 AND exempt_volume_percent > 0) WHERE rn = 1",
)
I4 = _insight("no_topic", "diary", "NULL", "no_topic_percent", "entries", "(SELECT count(*) FROM prof)", 74, f"({calendars.SHARES}) WHERE no_topic_percent IS NOT NULL")
I5 = _insight(
    "unread", "coverage", "NULL", "q", "s", "s", 70,
    f"(SELECT (SELECT count(*) FROM gaps WHERE unread) AS q, (SELECT count(*) FROM ({calendars.STATES}) WHERE state = 'published_not_read') AS s) WHERE q > 0 OR s > 0",
)
I6 = _insight(
    "anomaly", "budget", "section_id", "strength", "sort_value", "n", "least(90.0, strength)",
    f"(SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY strength DESC, sort_value DESC, section_id, code, year, rule_id) AS rn FROM ({STRENGTH})) WHERE rn = 1",
)
I7 = _insight(
    "transparency_spread", "diary", "best", "floor(hi - lo + 0.5)", "lo", "n", 66,
    f"(SELECT max(score) AS hi, min(score) AS lo, count(*) AS n, arg_min(section_id, {{'a': -score, 'b': section_id}}) AS best FROM ({calendars.TRANSPARENCY}) WHERE section_id IS NOT NULL AND score IS NOT NULL AND entry_count > 500) WHERE n >= 3",
)


def _scores(spark, d):
    return cal.transparency_score(cal.person_profile(b.diary(spark, d)))


def _gaps(spark, d):
    from publedger.operators.sets import publication_gaps

    return publication_gaps(b.order_entries(spark, d), b.order_publications(spark, d))


def _states(spark, d):
    return cal.publication_state(calendars.sections(spark, d), b.publications(spark, d))


GENERATORS = {
    "i1_insight_unused": (I1, lambda s, d: insights.insight_unused(b.budget_items(s, d), 2000)),
    "i2_insight_growth": (I2, lambda s, d: insights.insight_growth(b.budget_items(s, d), b.requests(s, d), 2001)),
    "i3_insight_exempt": (I3, lambda s, d: insights.insight_exempt(deals.procurement_index(b.contracts(s, d)))),
    "i4_insight_no_topic": (
        I4,
        lambda s, d: insights.insight_no_topic(cal.corpus_shares(b.diary(s, d)), cal.person_profile(b.diary(s, d))),
    ),
    "i5_insight_unread": (I5, lambda s, d: insights.insight_unread(_states(s, d), _gaps(s, d))),
    "i6_insight_anomaly": (I6, lambda s, d: insights.insight_anomaly(anomalies(s, d))),
    "i7_insight_spread": (I7, lambda s, d: insights.insight_spread(_scores(s, d))),
}
for key, (sql, generator) in GENERATORS.items():
    query(key, sql)(generator)


def every_insight(spark, d, diary, found):
    """All insights over a written diary and written anomalies; what several of them read is written once."""
    items = cut_lineage(b.budget_items(spark, d), "budget-items")
    profiles = cut_lineage(cal.person_profile(diary), "profiles")
    return insights.insights(
        [
            insights.insight_unused(items, 2000),
            insights.insight_growth(items, b.requests(spark, d), 2001),
            insights.insight_exempt(deals.procurement_index(b.contracts(spark, d))),
            insights.insight_no_topic(cal.corpus_shares(diary), profiles),
            insights.insight_unread(_states(spark, d), _gaps(spark, d)),
            insights.insight_anomaly(found),
            insights.insight_spread(cal.transparency_score(profiles)),
        ]
    )


@query("i8_insights", " UNION ALL ".join(sql for sql, _ in GENERATORS.values()))
def _(spark, d):
    return every_insight(spark, d, cut_lineage(b.diary(spark, d), "diary"), cut_lineage(anomalies(spark, d), "anomalies"))


HUNDRED_LATEST = f"""SELECT *, {pct("amount", "sum(amount) OVER ()")} AS per_hundred FROM (SELECT fiscal_year, econ1, CAST(sum(revised) AS BIGINT) AS amount FROM usage WHERE revised > 0
      AND fiscal_year = (SELECT max(fiscal_year) FROM usage WHERE revised > 0) GROUP BY 1, 2)"""
CORPUS_GROUPS = f"""SELECT g AS reading_group, count(*) AS n, {pct("count(*)", "sum(count(*)) OVER ()")} AS share_percent FROM (SELECT {group_case("category")} AS g FROM diary) WHERE g IS NOT NULL GROUP BY 1"""
OVERVIEW = f"""SELECT 'hundred' AS part, econ1 AS name, amount AS n, CAST(per_hundred AS DOUBLE) AS percent FROM ({HUNDRED_LATEST})
    UNION ALL SELECT 'group', reading_group, n, share_percent FROM ({CORPUS_GROUPS})
    UNION ALL SELECT 'category', category, count(*), NULL FROM diary GROUP BY category
    UNION ALL SELECT 'diary', v.name, entries, CASE v.name WHEN 'classified' THEN classified_percent WHEN 'no_topic' THEN no_topic_percent WHEN 'unclassified' THEN unclassified_percent ELSE unspecified_percent END
      FROM ({calendars.SHARES}), (VALUES ('classified'), ('no_topic'), ('unclassified'), ('unspecified')) v(name)
    UNION ALL SELECT 'hygiene', rule_id, finding_count, rate_per_thousand FROM ({HYGIENE})
    UNION ALL SELECT 'publications', v.name, CAST(CASE v.name WHEN 'published' THEN (SELECT sum(published) FROM ({calendars.STATES})) ELSE (SELECT sum(unread) FROM ({calendars.STATES})) END AS BIGINT), NULL FROM (VALUES ('published'), ('unread')) v(name)
    UNION ALL SELECT 'insight', insight_id, NULL, CAST(strength AS DOUBLE) FROM ({" UNION ALL ".join(sql for sql, _ in GENERATORS.values())})"""


@query("s2_site_overview", OVERVIEW)
def _(spark, d):
    diary = cut_lineage(b.diary(spark, d), "diary")
    categories = cut_lineage(cal.category_counts(diary), "categories")
    lines = cut_lineage(b.regulations(spark, d), "regulations")
    every = cut_lineage(rules.scan_anomalies(lines, b.CLOSED_YEAR_MAX, LIMITS), "anomalies")
    found = every.filter(F.col("rule_id") != "unexecuted_budget")
    return summary.site_overview(
        spending.per_hundred_latest(b.usage(spark, d)),
        categories,
        cal.group_counts(categories),
        cal.corpus_shares(diary),
        rules.rule_hygiene(found, rules.scanned_counts(lines)),
        cal.publication_state(calendars.sections(spark, d), b.publications(spark, d)),
        every_insight(spark, d, diary, every),
    )


@query(
    "s7_topics_with_items",
    "SELECT CAST(4 AS BIGINT) AS topics_defined, count(*) AS topics_with_items FROM (VALUES ('en'), ('fr'), ('long'), ('nobody')) v(topic) WHERE topic IN (SELECT unnest(topics) FROM acts)",
)
def _(spark, d):
    from publedger.operators.classify import topic_counts

    return summary.topics_with_items(topic_counts(b.activities(spark, d), ["en", "fr", "long", "nobody"]))


# ---- quality gate -----------------------------------------------------------------


def _violation(check: str, key: str, detail: str, source: str) -> str:
    return f"SELECT '{check}' AS \"check\", CAST({key} AS VARCHAR) AS key, CAST({detail} AS VARCHAR) AS detail FROM {source}"


def checked_items(spark, d):
    """Items with stored rates, some of them wrong, some amounts broken, some notes missing."""
    from publedger.functions.numbers import execution_rate, outlier_note

    rate = execution_rate("actual", "estimated", "updated")
    n = F.col("fiscal_year") + F.length("code")
    items = b.budget_items(spark, d).withColumn("rate", rate).withColumn("notes", outlier_note("rate"))
    return items.select(
        "*",
        F.when(F.col("code").endswith("-PROMO"), F.col("rate") + 1).when(F.col("code").endswith("-SMALL"), F.lit(200.0)).otherwise(F.col("rate")).alias("stored"),
        F.when(n % 2 == 0, "ILS").otherwise("USD").alias("currency"),
    ).drop("rate").withColumnRenamed("stored", "rate")


CHECKED = f"""SELECT *, CASE WHEN code LIKE '%-PROMO' THEN r + 1 WHEN code LIKE '%-SMALL' THEN 200.0 ELSE r END AS rate, CASE WHEN r < 0 OR r > 150 THEN 'חריגה:' ELSE '' END AS notes,
    CASE WHEN (fiscal_year + length(code)) % 2 = 0 THEN 'ILS' ELSE 'USD' END AS currency FROM (SELECT *, {share("coalesce(actual, estimated)", "updated")} AS r FROM items)"""


@query(
    "q1_schema",
    " UNION ALL ".join(
        [
            _violation("schema", "entry_id", "'category: null'", "drows WHERE category IS NULL"),
            _violation("schema", "entry_id", "'category: value'", "drows WHERE category IS NOT NULL AND category = 'mystery'"),
            _violation("schema", "entry_id", "'start_time: pattern'", "drows WHERE NOT regexp_matches(start_time, '^(0[1-9]|1[0-9]|2[0-3]):')"),
        ]
    ),
)
def _(spark, d):
    from publedger.schemas import ENTRIES

    rows = b.diary_rows(spark, d)
    for missing in ("matched_keyword", "matched_confidence", "inferred_from"):
        rows = rows.withColumn(missing, F.lit(None).cast("string"))
    known = [c for group in cal.CATEGORY_GROUPS.values() for c in group]
    return quality.schema_violations(
        rows, ENTRIES, "entry_id", {"category": tuple(known)}, {"start_time": "^(0[1-9]|1[0-9]|2[0-3]):"}
    )


@query("q2_duplicate_keys", _violation("duplicate lines.line", "line", "n", "(SELECT l_orderkey || '/' || l_linenumber AS line, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1)"))
def _(spark, d):
    lines = b.read(spark, d, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("line"))
    return quality.duplicate_keys(lines, "line", "lines")


@query("q3_missing_source", _violation("source_url", "seq", "coalesce(u, 'missing')", "(SELECT seq, CASE seq % 7 WHEN 0 THEN NULL WHEN 1 THEN 'ftp://x' ELSE url END AS u FROM srcs) WHERE u IS NULL OR NOT starts_with(u, 'http')"))
def _(spark, d):
    s = F.col("seq")
    rows = b.sources(spark, d).withColumn("url", F.when(s % 7 == 1, F.lit("ftp://x")).when(s % 7 != 0, F.col("url")))
    return quality.missing_source(rows, "seq")


@query(
    "q4_invalid_dates",
    " UNION ALL ".join(
        [
            _violation("date", "event_id", "'a: invalid'", "events WHERE event_id % 4 = 1"),
            _violation("date", "event_id", "'b: invalid'", "events WHERE event_id % 4 IN (2, 3)"),
        ]
    ),
)
def _(spark, d):
    k = F.col("event_id") % 4
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = b.read(spark, d, "events").select(
        "event_id",
        F.when(k == 1, F.lit("2023-02-30")).when(k == 2, F.lit(None).cast("string")).otherwise(day).alias("a"),
        F.when(k == 2, F.lit("5.3.2024")).when(k == 3, F.concat(day, F.lit("T00"))).otherwise(day).alias("b"),
    )
    return quality.invalid_dates(rows, "event_id", ["a", "b"])


@query("q4_end_before_start", _violation("tenure_order", "tenure_id", "e", "(SELECT tenure_id, start_date, CASE WHEN right(tenure_id, 1) = '7' THEN start_date - 1 ELSE end_date END AS e FROM tenures) WHERE e < start_date"))
def _(spark, d):
    early = F.when(F.col("tenure_id").endswith("7"), F.date_sub("start_date", 1)).otherwise(F.col("end_date"))
    return quality.end_before_start(b.tenures(spark, d).withColumn("end_date", early))


@query(
    "q5_bad_amounts",
    " UNION ALL ".join(
        [
            _violation("amount", "item_id", "'updated: not finite'", "items WHERE level = 2 AND fiscal_year = 1999"),
            _violation("amount", "item_id", "'unexplained zero'", "items WHERE level = 3 AND fiscal_year = 1998 AND code LIKE '%1-LARGE'"),
        ]
    ),
)
def _(spark, d):
    items = b.budget_items(spark, d)
    nan = F.when((F.col("level") == 2) & (F.col("fiscal_year") == 1999), F.lit(float("nan"))).otherwise(F.col("updated").cast("double"))
    zero = (F.col("level") == 3) & (F.col("fiscal_year") == 1998) & F.col("code").endswith("1-LARGE")
    original = F.when(zero | F.col("code").endswith("2-LARGE"), F.lit(0)).otherwise(F.col("original"))
    notes = F.when(F.col("code").endswith("2-LARGE"), F.lit("explained")).otherwise(F.lit(" "))
    return quality.bad_amounts(items.withColumns({"updated": nan, "original": original, "notes": notes}))


@query(
    "q6_rate_mismatch",
    " UNION ALL ".join(
        [
            _violation("rate", "item_id", "'rate differs'", f"({CHECKED}) WHERE abs(rate - r) > 0.1"),
            _violation("rate", "item_id", "'outlier without marker'", f"({CHECKED}) WHERE (rate < 0 OR rate > 150) AND notes = ''"),
        ]
    ),
)
def _(spark, d):
    return quality.rate_mismatch(checked_items(spark, d))


@query("q7_leaf_under_leaf", _violation("leaf_under_leaf", "item_id", "parent_code", "items WHERE is_leaf AND code LIKE '%-SMALL' AND fiscal_year <= 1997"))
def _(spark, d):
    wrong = (F.col("level") == 2) & (F.col("fiscal_year") <= 1997)
    items = b.budget_items(spark, d).withColumn("is_leaf", F.col("is_leaf") & F.col("code").endswith("-SMALL") | wrong)
    return quality.leaf_under_leaf(items)


@query(
    "q8_dangling",
    " UNION ALL ".join(
        [
            _violation("activity_topic", "id", "t", "(SELECT id, unnest(topics) AS t FROM acts) WHERE t NOT IN ('en', 'long')"),
            _violation("activity_section", "id", "section_id", "acts WHERE section_id NOT IN (SELECT 'S' || n_nationkey FROM nation WHERE n_nationkey <> 3)"),
        ]
    ),
)
def _(spark, d):
    acts = b.activities(spark, d)
    topics = spark.createDataFrame([("en",), ("long",)], "topic string")
    sections = calendars.sections(spark, d).filter(F.col("section_id") != "S3")
    return quality.dangling(acts, "id", "topics", topics, "topic", "activity_topic").unionByName(
        quality.dangling(acts, "id", "section_id", sections, "section_id", "activity_section")
    )


@query(
    "q9_topic_count_mismatch",
    _violation("topic_count", "v.topic", "v.item_count || '/' || coalesce(c.n, 0)", "(VALUES ('en', 7), ('nobody', 0), ('ghost', 3)) v(topic, item_count) LEFT JOIN (SELECT t, count(*) AS n FROM (SELECT unnest(topics) AS t FROM acts) GROUP BY 1) c ON c.t = v.topic WHERE v.item_count <> coalesce(c.n, 0)"),
)
def _(spark, d):
    topics = spark.createDataFrame([("en", 7), ("nobody", 0), ("ghost", 3)], "topic string, item_count int")
    return quality.topic_count_mismatch(topics, b.activities(spark, d))


@query(
    "q10_uncovered_hosts",
    _violation("host", "seq", "h", "(SELECT seq, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS h FROM srcs) WHERE NOT (h = 'knesset.gov.il' OR ends_with(h, '.knesset.gov.il') OR h = 'obudget.org' OR ends_with(h, '.obudget.org'))"),
)
def _(spark, d):
    listed = spark.createDataFrame([("https://www.knesset.gov.il/x",), ("http://obudget.org",)], "url string")
    return quality.uncovered_hosts(b.sources(spark, d), "seq", "url", listed)


STORED_COVERAGE = f"SELECT section_id, CASE WHEN section_id = 'S1' THEN sources + 1 ELSE sources END AS sources, CASE WHEN section_id = 'S2' THEN sources + 5 ELSE retrieved END AS retrieved, budget_records, CASE WHEN section_id = 'S4' THEN 0 ELSE activities END AS activities, sources AS s0, retrieved AS r0, activities AS a0 FROM ({COVERED})"


@query(
    "q11_coverage_mismatch",
    " UNION ALL ".join(
        [
            _violation("coverage", "section_id", "'sources differs'", f"({STORED_COVERAGE}) WHERE sources <> s0"),
            _violation("coverage", "section_id", "'retrieved differs'", f"({STORED_COVERAGE}) WHERE retrieved <> r0"),
            _violation("coverage", "section_id", "'activities differs'", f"({STORED_COVERAGE}) WHERE activities <> a0"),
            _violation("coverage", "section_id", "'more retrieved than defined'", f"({STORED_COVERAGE}) WHERE retrieved > sources"),
            _violation("coverage", "section_id", "'no budget and no limitation'", f"({STORED_COVERAGE}) WHERE budget_records = 0"),
        ]
    ),
)
def _(spark, d):
    actual = covered(spark, d)
    s = F.col("section_id")
    stored = actual.withColumns(
        {
            "retrieved": F.when(s == "S2", F.col("sources") + 5).otherwise(F.col("retrieved")),
            "sources": F.when(s == "S1", F.col("sources") + 1).otherwise(F.col("sources")),
            "activities": F.when(s == "S4", F.lit(0)).otherwise(F.col("activities")),
            "limitations": F.array().cast("array<string>"),
        }
    )
    return quality.coverage_mismatch(stored, actual)


@query("q12_sections_without_coverage", _violation("coverage_missing", "'S' || n_nationkey", "'no row'", "nation WHERE n_nationkey NOT IN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_suppkey % 5 = 0)"))
def _(spark, d):
    some = b.read(spark, d, "supplier").filter(F.col("s_suppkey") % 5 == 0)
    held = some.select(F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("section_id"))
    return quality.sections_without_coverage(calendars.sections(spark, d), held)


USAGE_COVERAGE = f"""SELECT section_id, fiscal_year, section_id || '/' || fiscal_year AS k, CASE WHEN section_id = 'S5' THEN classified_sum * 2 WHEN section_id = 'S6' THEN classified_sum + 2 ELSE classified_sum END AS classified_sum, section_total,
    CASE WHEN section_id = 'S7' THEN -1.0 ELSE coverage_percent END AS coverage_percent, classified_sum AS c0 FROM ({{coverage}})"""


def _usage_sql() -> str:
    from publedger.plans.budget import COVERAGE

    source = USAGE_COVERAGE.format(coverage=COVERAGE)
    return " UNION ALL ".join(
        [
            _violation("usage", "k", "'over section total'", f"({source}) WHERE section_total > 0 AND classified_sum > section_total * CASE WHEN fiscal_year >= 2001 THEN 1.2 ELSE 1.000001 END"),
            _violation("usage", "k", "'implausible percent'", f"({source}) WHERE coverage_percent < 0 OR coverage_percent > CASE WHEN fiscal_year >= 2001 THEN 120 ELSE 100.5 END"),
            _violation("usage", "k", "'sum differs'", f"({source}) WHERE abs(c0 - classified_sum) > 1"),
            _violation("usage_section", "section_id || '/' || fiscal_year || '/' || econ1 || '/' || econ2", "section_id", "usage WHERE section_id = 'S9'"),
        ]
    )


@query("q13_usage_violations", _usage_sql())
def _(spark, d):
    usage = b.usage(spark, d)
    coverage = spending.usage_coverage(usage, b.budget_items(spark, d), SPINE)
    s = F.col("section_id")
    stored = coverage.withColumns(
        {
            "classified_sum": F.when(s == "S5", F.col("classified_sum") * 2).when(s == "S6", F.col("classified_sum") + 2).otherwise(F.col("classified_sum")),
            "coverage_percent": F.when(s == "S7", F.lit(-1.0)).otherwise(F.col("coverage_percent")),
        }
    )
    sections = calendars.sections(spark, d).filter(F.col("section_id") != "S9")
    return quality.usage_violations(usage, stored, sections, 2001)


@query(
    "q14_theme_violations",
    """WITH lines AS (SELECT section_id, code, arg_max(title, fiscal_year) AS title FROM items WHERE level IN (2, 3) GROUP BY 1, 2), th AS (SELECT theme_id FROM themes WHERE theme_id <> 'T-PROMO')
       SELECT 'theme_unknown' AS "check", section_id || ':' || code AS key, theme_id AS detail FROM assigned WHERE theme_id NOT IN (SELECT theme_id FROM th)
       UNION ALL SELECT 'theme_section', section_id || ':' || code, section_id FROM assigned WHERE section_id = 'S2'
       UNION ALL SELECT 'theme_line', l.section_id || ':' || l.code, 'missing' FROM lines l WHERE NOT EXISTS (SELECT 1 FROM assigned a WHERE a.section_id = l.section_id AND a.code = l.code)
       UNION ALL SELECT 'theme_line', l.section_id || ':' || l.code, 'retitled' FROM lines l JOIN assigned a ON a.section_id = l.section_id AND a.code = l.code WHERE a.title <> l.title
       UNION ALL SELECT 'theme_count', t.theme_id, '5' FROM th t LEFT JOIN (SELECT theme_id, count(*) AS n FROM assigned GROUP BY 1) c ON c.theme_id = t.theme_id WHERE coalesce(c.n, 0) <> 5""",
)
def _(spark, d):
    themes = b.themes(spark, d).filter(F.col("theme_id") != "T-PROMO").withColumn("line_count", F.lit(5))
    sections = calendars.sections(spark, d).filter(F.col("section_id") != "S2")
    return quality.theme_violations(themes, b.assignments(spark, d), b.budget_items(spark, d), sections)


@query(
    "q15_finding_violations",
    f"""SELECT 'finding_rule' AS "check", rule_id || ':' || code || ':' || year AS key, rule_id AS detail FROM ({FOUND}) WHERE rule_id = 'overspend'
        UNION ALL SELECT 'finding_section', rule_id || ':' || code || ':' || year, section_id FROM ({FOUND}) WHERE replace(section_id, 'B', 'S') NOT IN (SELECT 'S' || n_nationkey FROM nation)""",
)
def _(spark, d):
    known = tuple(r for r, _ in rules.BUDGET_RULES if r != "overspend")
    sections = calendars.sections(spark, d).select(F.replace("section_id", F.lit("S"), F.lit("B")).alias("section_id"))
    return quality.finding_violations(anomalies(spark, d), known, sections)


@query(
    "q16_shard_violations",
    """WITH idx AS (SELECT coalesce(section_id, 'unattributed') AS k, count(*) + CASE WHEN coalesce(section_id, 'unattributed') = 'S4' THEN 1 ELSE 0 END AS n FROM diary GROUP BY 1, coalesce(section_id, 'unattributed')),
       e AS (SELECT * REPLACE (CASE WHEN entry_id LIKE '%0007' THEN '0000000000' ELSE entry_id END AS entry_id, CASE WHEN entry_id LIKE '%005' THEN NULL ELSE method END AS method) FROM diary), p AS (SELECT * FROM pubs WHERE dataset_id <> 'ds-3')
       SELECT 'shard_count' AS "check", 'S4' AS key, i.n || '/' || (i.n - 1) AS detail FROM idx i WHERE i.k = 'S4'
       UNION ALL SELECT 'duplicate entries.entry_id', entry_id, CAST(count(*) AS VARCHAR) FROM e GROUP BY entry_id HAVING count(*) > 1
       UNION ALL SELECT 'entry_publication', entry_id, dataset_id FROM e WHERE dataset_id = 'ds-3'
       UNION ALL SELECT 'publication_count', p.dataset_id, CAST(p.readable_entries AS VARCHAR) FROM p WHERE p.readable_entries <> (SELECT count(*) FROM e WHERE e.dataset_id = p.dataset_id)
       UNION ALL SELECT 'entry_window', entry_id, CAST(date AS VARCHAR) FROM e WHERE date < DATE '2024-01-03'
       UNION ALL SELECT 'entry_method', entry_id, 'missing' FROM e WHERE method IS NULL
       UNION ALL SELECT 'entry_total', method, n || '/' || m FROM (SELECT method, count(*) AS n, count(*) FILTER (entry_id NOT LIKE '%005') AS m FROM diary WHERE method IS NOT NULL GROUP BY 1) WHERE n <> m
       UNION ALL SELECT 'entry_total', 'entries', (count(*) + 2) || '/' || count(*) FROM diary""",
)
def _(spark, d):
    diary = b.diary(spark, d)
    index = sinks.shard_index(diary, "section_id").withColumn(
        "entry_count", F.col("entry_count") + F.when(F.col("shard_key") == "S4", 1).otherwise(0)
    )
    entries = diary.withColumns(
        {
            "entry_id": F.when(F.col("entry_id").endswith("0007"), F.lit("0000000000")).otherwise(F.col("entry_id")),
            "method": F.when(~F.col("entry_id").endswith("005"), F.col("method")),
        }
    )
    publications = b.publications(spark, d).filter(F.col("dataset_id") != "ds-3")
    methods = diary.groupBy(F.col("method").alias("name")).agg(F.count("*").alias("declared"))
    overall = methods.agg((F.sum("declared") + 2).alias("declared")).select(F.lit("entries").alias("name"), "declared")
    totals = methods.filter(F.col("name").isNotNull()).unionByName(overall)
    return quality.shard_violations(entries, publications, index, "2024-01-03", totals=totals)


@query(
    "q17_category_violations",
    f"""WITH {texts.SUBJ}, dec AS ({texts.DECIDED}), c AS (SELECT l.entry_id, dec.category, CASE WHEN l.entry_id LIKE '%7-0' THEN NULL ELSE dec.matched_keyword END AS kw, dec.matched_confidence AS conf FROM slines l JOIN dec ON dec.subject = l.subject),
        known AS (SELECT category FROM (VALUES {values([(x,) for x in texts.CATEGORIES if x != "legal_judicial"])}) v(category))
        SELECT 'category' AS "check", entry_id AS key, 'content without keyword' AS detail FROM c WHERE category NOT IN ('unclassified', 'no_subject_recorded', 'unspecified') AND coalesce(kw, '') = ''
        UNION ALL SELECT 'category', entry_id, 'keyword and confidence differ' FROM c WHERE (coalesce(kw, '') <> '') <> (conf IS NOT NULL)
        UNION ALL SELECT 'category_unknown', entry_id, category FROM c WHERE category NOT IN (SELECT category FROM known)
        UNION ALL SELECT 'category_count', k.category, '0' FROM known k WHERE k.category IN (SELECT category FROM c)""",
)
def _(spark, d):
    decided = texts.classified(spark, d).select("entry_id", "category", "matched_keyword", "matched_confidence", "inferred_from")
    entries = cut_lineage(decided, "classified").withColumn(
        "matched_keyword", F.when(~F.col("entry_id").endswith("7-0"), F.col("matched_keyword"))
    )
    known = texts.categories(spark).filter(F.col("category") != "legal_judicial").withColumn("entry_count", F.lit(0))
    return quality.category_violations(entries, known)


@query(
    "q18_profile_violations",
    f"""WITH f AS ({calendars.ALL_FINDINGS}) SELECT 'finding_shared_file' AS "check", p.person_key AS key, 'late_night_meetings' AS detail FROM prof p WHERE covers_multiple
        UNION ALL SELECT 'named_shared_file', person_key, 'x' FROM prof WHERE covers_multiple
        UNION ALL SELECT 'profile_sum', 'corpus', (SELECT count(*) FROM diary WHERE section_id <> 'S1' OR section_id IS NULL) || '/' || (SELECT count(*) FROM diary)""",
)
def _(spark, d):
    diary = b.diary(spark, d)
    profiles = cal.person_profile(diary)
    shared = profiles.filter("covers_multiple").select("person_key", F.lit("late_night_meetings").alias("rule_id"))
    named = profiles.withColumn("person_label", F.when(F.col("covers_multiple"), F.lit("x")).otherwise(F.col("person_label")))
    part = named.filter((F.col("section_id") != "S1") | F.col("section_id").isNull() | F.col("covers_multiple"))
    kept = part.withColumn("entry_count", F.when(F.coalesce(F.col("section_id"), F.lit("")) == "S1", 0).otherwise(F.col("entry_count")))
    return quality.profile_violations(kept, shared, cal.corpus_shares(diary), diary)


@query(
    "q19_leaf_sum",
    """SELECT 'leaf_sum' AS "check", section_id || '/' || fiscal_year AS key, CAST(sum(CASE WHEN level = 1 THEN updated + CASE WHEN fiscal_year = 1997 THEN 7 ELSE 0 END ELSE 0 END) - sum(CASE WHEN is_leaf THEN updated ELSE 0 END) AS VARCHAR) AS detail
       FROM items GROUP BY section_id, fiscal_year HAVING bool_or(is_leaf) AND abs(sum(CASE WHEN level = 1 THEN updated + CASE WHEN fiscal_year = 1997 THEN 7 ELSE 0 END ELSE 0 END) - sum(CASE WHEN is_leaf THEN updated ELSE 0 END)) >= 1""",
)
def _(spark, d):
    off = F.when((F.col("level") == 1) & (F.col("fiscal_year") == 1997), F.lit(7)).otherwise(F.lit(0))
    return quality.leaf_sum_violations(b.budget_items(spark, d).withColumn("updated", F.col("updated") + off))


@query(
    "q20_honesty",
    f"""SELECT 'honesty' AS "check", item_id AS key, 'open year final' AS detail FROM items WHERE fiscal_year >= 1996 AND status = 'final'
        UNION ALL SELECT 'honesty', item_id, 'open year actual' FROM items WHERE fiscal_year >= 1996 AND actual IS NOT NULL
        UNION ALL SELECT 'honesty', item_id, 'currency' FROM ({CHECKED}) WHERE currency <> 'ILS'
        UNION ALL SELECT 'activity_window', id, CAST(date AS VARCHAR) FROM acts WHERE date < DATE '2022-12-29'""",
)
def _(spark, d):
    return quality.honesty_violations(b.activities(spark, d), checked_items(spark, d), b.WINDOW_START, 1996)


@query(
    "q_gate_counts",
    """SELECT 'leaf_sum' AS "group", CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'leaf_under_leaf', 0 UNION ALL SELECT 'publication_refs', (SELECT count(*) FROM drows r WHERE NOT EXISTS (SELECT 1 FROM pubs p WHERE p.dataset_id = r.dataset_id))
       UNION ALL SELECT 'tenure_order', 0""",
)
def _(spark, d):
    items = b.budget_items(spark, d)
    return quality.violation_counts(
        {
            "leaf_sum": quality.leaf_sum_violations(items),
            "leaf_under_leaf": quality.leaf_under_leaf(items),
            "publication_refs": quality.dangling(
                b.diary_rows(spark, d), "entry_id", "dataset_id", b.publications(spark, d), "dataset_id", "entry_publication"
            ),
            "tenure_order": quality.end_before_start(b.tenures(spark, d)),
        }
    )


