"""Queries over office calendars: filters, measures, profiles and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from publedger.operators import calendar as cal
from publedger.operators import filters, matching, ranking, rules, sets
from publedger.plans import matches
from publedger.plans.oracle import group_case, pct, share
from publedger.plans.registry import query
from publedger.sources import bindings as b

PERSON = ["person_key"]


@query("c1_category_counts", "SELECT person_key, category, count(*) AS n FROM diary GROUP BY 1, 2")
def _(spark, d):
    return cal.category_counts(b.diary(spark, d), PERSON)


@query("c1_category_totals", "SELECT category, count(*) AS n FROM diary GROUP BY 1")
def _(spark, d):
    return cal.category_counts(b.diary(spark, d))


@query(
    "c2_monthly_series",
    "SELECT person_key, strftime(date, '%Y-%m') AS period, category, count(*) AS n FROM diary WHERE date IS NOT NULL GROUP BY 1, 2, 3",
)
def _(spark, d):
    return cal.period_series(b.diary(spark, d), "month", PERSON)


@query(
    "c2_quarterly_series",
    """SELECT 'C' || o_custkey AS person_key, strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS period, o_orderpriority AS category, count(*) AS n FROM orders GROUP BY 1, 2, 3""",
)
def _(spark, d):
    rows = b.read(spark, d, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("person_key"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("category"),
    )
    return cal.period_series(rows, "quarter", PERSON)


PROFILE = [
    "person_key", "section_id", "person_label", "person_role", "role_label", "covers_multiple", "entry_count", "dated_count",
    "timed_count", "usable_count", "first_date", "last_date", "dataset_count", "opacity_percent", "no_subject_percent",
    "unclassified_percent", "unspecified_count", "no_subject_count", "unclassified_count",
]


@query(
    "c3_person_profile",
    "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" if c.endswith("_date") else c for c in PROFILE) + " FROM prof",
)
def _(spark, d):
    return cal.person_profile(b.diary(spark, d)).select(*PROFILE)


@query("c3_profile_datasets", "SELECT person_key, dataset_id, count(*) AS entry_count FROM diary WHERE dataset_id IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return cal.profile_datasets(b.diary(spark, d))


@query("c4_weekend_counts", "SELECT person_key, weekend_count, friday_count, saturday_count, weekend_other_count FROM prof")
def _(spark, d):
    return cal.weekend_counts(b.diary(spark, d), PERSON)


@query(
    "c5_late_night",
    "SELECT person_key, count(*) FILTER (s // 60 >= 22 OR s // 60 <= 5) AS late_night_count FROM clocked WHERE date IS NOT NULL GROUP BY 1",
)
def _(spark, d):
    return cal.late_night(b.diary(spark, d), PERSON)


@query(
    "c6_long_meetings",
    "SELECT person_key, count(*) FILTER (e - s >= 240) AS long_meeting_count FROM clocked WHERE date IS NOT NULL GROUP BY 1",
)
def _(spark, d):
    return cal.long_meetings(b.diary(spark, d), PERSON)


MARATHON = "(meetings >= 12 OR (timed > 1 AND span >= 840))"


@query(
    "c7_marathon_days",
    f"SELECT person_key, CAST(date AS VARCHAR) AS date, meetings, timed, CAST(span AS BIGINT) AS span FROM days WHERE {MARATHON}",
)
def _(spark, d):
    return cal.marathon_days(b.diary(spark, d), PERSON)


@query(
    "c8_double_booked",
    """SELECT p.person_key, CAST(coalesce(max(pairs.n), 0) AS BIGINT) AS double_booked_count FROM (SELECT DISTINCT person_key FROM clocked WHERE date IS NOT NULL AND e > s) p
       LEFT JOIN pairs ON pairs.person_key = p.person_key GROUP BY 1""",
)
def _(spark, d):
    return cal.double_booked(b.diary(spark, d), PERSON)


@query(
    "c9_busiest_day",
    """SELECT person_key, CAST(date AS VARCHAR) AS busiest_date, n_rows AS busiest_count FROM (
         SELECT *, row_number() OVER (PARTITION BY person_key ORDER BY n_rows DESC, first_seq) AS rn FROM days) WHERE rn = 1""",
)
def _(spark, d):
    return cal.busiest_day(b.diary(spark, d), PERSON)


@query(
    "c10_repeated_subjects",
    """SELECT * FROM (SELECT section_id, subject, count(*) AS n, row_number() OVER (PARTITION BY section_id ORDER BY count(*) DESC, subject) AS position
         FROM diary WHERE length(subject) >= 4 GROUP BY 1, 2 HAVING count(*) >= 3) WHERE position <= 15""",
)
def _(spark, d):
    return cal.repeated_subjects(b.diary(spark, d), ["section_id"])


@query(
    "c10_repeated_lines",
    """SELECT * FROM (SELECT lang, s AS subject, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, s) AS position
         FROM (SELECT lang, regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS s FROM documents) WHERE length(s) >= 4 GROUP BY 1, 2 HAVING count(*) >= 3) WHERE position <= 15""",
)
def _(spark, d):
    lines = b.read(spark, d, "documents").select("lang", F.explode(F.split("text", "\n")).alias("subject"))
    return cal.repeated_subjects(lines, ["lang"])


SHARES = f"""SELECT count(*) AS entries, {share("count(*) FILTER (category = 'unspecified')", "count(*)")} AS unspecified_percent, {share("count(*) FILTER (category = 'unclassified')", "count(*)")} AS unclassified_percent,
    {share("count(*) FILTER (category IN ('meeting_without_subject', 'named_person_meeting'))", "count(*)")} AS no_topic_percent, {share("count(*) FILTER (category = 'no_subject_recorded')", "count(*)")} AS no_subject_percent,
    {share("count(*) FILTER (category NOT IN ('unclassified', 'unspecified', 'no_subject_recorded', 'meeting_without_subject', 'named_person_meeting'))", "count(*)")} AS classified_percent FROM diary"""


@query("c11_corpus_shares", SHARES)
def _(spark, d):
    return cal.corpus_shares(b.diary(spark, d))


@query(
    "c12_group_counts",
    f"""SELECT section_id, reading_group, CAST(sum(n) AS BIGINT) AS n, string_agg(category, ', ' ORDER BY n DESC, category) AS categories, {pct("sum(n)", "sum(sum(n)) OVER (PARTITION BY section_id)")} AS share_percent FROM (
          SELECT section_id, {group_case("category")} AS reading_group, category, count(*) AS n FROM diary GROUP BY 1, 2, 3) WHERE reading_group IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, d):
    return cal.group_counts(cal.category_counts(b.diary(spark, d), ["section_id"]), ["section_id"])


MATTER = f"""SELECT section_id, count(*) FILTER (g IS NOT NULL) AS classified_rows, count(*) FILTER (g IN ('governing', 'policy_field', 'stakeholders', 'public_facing')) AS subject_matter_rows,
   {share("count(*) FILTER (g IN ('governing', 'policy_field', 'stakeholders', 'public_facing'))", "count(*) FILTER (g IS NOT NULL)")} AS share_percent FROM (SELECT section_id, {group_case("category")} AS g FROM diary) GROUP BY 1"""


@query("c13_subject_matter_share", MATTER)
def _(spark, d):
    return cal.subject_matter_share(cal.category_counts(b.diary(spark, d), ["section_id"]), ["section_id"])


@query(
    "c14_mix_series",
    """WITH s AS (SELECT strftime(date, '%Y-%m') AS period, category, count(*) AS n FROM diary WHERE section_id = 'S3' AND date IS NOT NULL GROUP BY 1, 2),
       t AS (SELECT category FROM s GROUP BY 1 ORDER BY sum(n) DESC, category LIMIT 8) SELECT * FROM s WHERE category IN (SELECT category FROM t)""",
)
def _(spark, d):
    return cal.mix_series(b.diary(spark, d).filter(F.col("section_id") == "S3"), "month")


@query(
    "c15_opacity_ranking",
    "SELECT person_key, entry_count, opacity_percent FROM prof WHERE entry_count >= 20 ORDER BY opacity_percent DESC, person_key LIMIT 12",
)
def _(spark, d):
    return cal.opacity_ranking(cal.person_profile(b.diary(spark, d))).select("person_key", "entry_count", "opacity_percent")


@query(
    "c16_section_ranking",
    """SELECT section_id, count(*) AS entry_count, section_id IS NOT NULL AND row_number() OVER (PARTITION BY section_id IS NOT NULL ORDER BY count(*) DESC, section_id) = 1 AS is_default FROM diary GROUP BY 1""",
)
def _(spark, d):
    return cal.section_ranking(b.diary(spark, d))


FULL = f"""SELECT p.*, coalesce(m.marathon_count, 0) AS marathon_count, coalesce(pairs.n, 0) AS double_booked_count FROM prof p
    LEFT JOIN (SELECT person_key, count(*) FILTER {MARATHON.replace("(", "(WHERE (", 1)}) AS marathon_count FROM days GROUP BY 1) m ON m.person_key = p.person_key
    LEFT JOIN pairs ON pairs.person_key = p.person_key"""


def _finding(rule: str, test: str, value: str, source: str = "full_profile") -> str:
    return f"SELECT '{rule}' AS rule_id, person_key, section_id, person_label, role_label, CAST({value} AS DOUBLE) AS value FROM {source} WHERE NOT covers_multiple AND {test}"


def _share100(c: str) -> str:
    return f"({c} / entry_count * 100.0)"


FINDINGS = " UNION ALL ".join(
    [
        _finding("opaque_diary", "entry_count >= 20 AND opacity_percent >= 25", "opacity_percent"),
        _finding("private_sector_heavy", f"entry_count >= 20 AND {_share100('private_sector_count')} >= 20", f"floor({_share100('private_sector_count')} * 10.0 + 0.5) / 10.0"),
        _finding("media_heavy", f"entry_count >= 20 AND {_share100('media_count')} >= 20", f"floor({_share100('media_count')} * 10.0 + 0.5) / 10.0"),
        _finding("late_night_meetings", "late_night_count >= 3", "late_night_count"),
        _finding("weekend_meetings", "weekend_count >= 3", "weekend_count"),
        _finding("marathon_day", "marathon_count > 0", "marathon_count"),
        _finding("double_booked", "double_booked_count >= 5", "double_booked_count"),
    ]
)
ALL_FINDINGS = f"WITH full_profile AS ({FULL}) {FINDINGS}"
LIMITS = rules.DiaryLimits(opacity=25, private_sector=20, media=20)


def findings_of(spark, d):
    diary = b.diary(spark, d)
    gaps = sets.publication_gaps(diary, diary.select("person_key", F.lit(None).cast("string").alias("period_label")))
    return rules.diary_findings(cal.full_profile(diary), gaps, LIMITS)


def _one_rule(rule: str):
    def run(spark, d):
        return filters.filter_findings(findings_of(spark, d), rule=rule)

    return run


for number, rule in (
    (1, "opaque_diary"),
    (2, "private_sector_heavy"),
    (3, "media_heavy"),
    (5, "late_night_meetings"),
    (6, "weekend_meetings"),
    (7, "marathon_day"),
    (8, "double_booked"),
):
    query(f"d{number}_{rule}", f"SELECT * FROM ({ALL_FINDINGS}) WHERE rule_id = '{rule}'")(_one_rule(rule))


@query("d_all_diary_findings", ALL_FINDINGS)
def _(spark, d):
    return findings_of(spark, d)


@query(
    "d4_publication_gap",
    "SELECT person_key, count(*) FILTER (NOT unread) AS missing_quarters FROM gaps GROUP BY 1 HAVING count(*) FILTER (NOT unread) > 0",
)
def _(spark, d):
    entries = b.order_entries(spark, d)
    gaps = sets.publication_gaps(entries, b.order_publications(spark, d))
    people = entries.select("person_key").distinct()
    profiles = people.select(
        "person_key",
        *[F.lit(None).cast("string").alias(c) for c in ("section_id", "person_label", "role_label")],
        F.lit(False).alias("covers_multiple"),
        *[
            F.lit(0).cast("bigint").alias(c)
            for c in (
                "entry_count", "opacity_percent", "private_sector_count", "media_count", "late_night_count", "weekend_count",
                "marathon_count", "double_booked_count",
            )
        ],
    )
    found = rules.diary_findings(profiles, gaps)
    return found.select("person_key", F.col("value").cast("bigint").alias("missing_quarters"))


@query("u2_publication_gaps", "SELECT * FROM gaps")
def _(spark, d):
    return sets.publication_gaps(b.order_entries(spark, d), b.order_publications(spark, d))


@query(
    "c17_person_rollup",
    f"""WITH full_profile AS ({FULL}), f AS ({FINDINGS}), matter AS (SELECT person_label, {share("count(*) FILTER (g IN ('governing', 'policy_field', 'stakeholders', 'public_facing'))", "count(*) FILTER (g IS NOT NULL)")} AS s FROM (
          SELECT p.person_label, {group_case("d.category")} AS g FROM diary d JOIN prof p ON p.person_key = d.person_key WHERE p.person_label IS NOT NULL) GROUP BY 1)
        SELECT replace(p.person_label, ' ', '-') AS person_id, count(*) AS profiles, CAST(sum(entry_count) AS BIGINT) AS entries, CAST(min(first_date) AS VARCHAR) AS first_date, CAST(max(last_date) AS VARCHAR) AS last_date,
          bool_or(covers_multiple) AS shared_file, any_value(m.s) AS share_percent, coalesce(max(x.n), 0) AS findings, coalesce(max(y.n), 0) AS matches
        FROM prof p LEFT JOIN matter m ON m.person_label = p.person_label LEFT JOIN (SELECT person_label, count(*) AS n FROM f WHERE person_label IS NOT NULL GROUP BY 1) x ON x.person_label = p.person_label
        LEFT JOIN (SELECT person_label, count(*) AS n FROM ({matches.CROSS}) WHERE person_label IS NOT NULL GROUP BY 1) y ON y.person_label = p.person_label
        WHERE p.person_label IS NOT NULL GROUP BY p.person_label""",
)
def _(spark, d):
    diary = b.diary(spark, d)
    met = matching.cross_reference(diary, matches.pool(spark, d))
    return cal.person_rollup(cal.person_profile(diary), diary, findings_of(spark, d), met)


@query(
    "c17_person_mix",
    f"""WITH r AS (SELECT replace(p.person_label, ' ', '-') AS person_id, {group_case("d.category")} AS g, strftime(d.date, '%Y-%m') AS m FROM diary d JOIN prof p ON p.person_key = d.person_key WHERE p.person_label IS NOT NULL)
        SELECT person_id, 'group' AS part, g AS name, count(*) AS n, {pct("count(*)", "sum(count(*)) OVER (PARTITION BY person_id)")} AS share_percent FROM r WHERE g IS NOT NULL GROUP BY person_id, g
        UNION ALL SELECT person_id, 'month', m, count(*), NULL FROM r WHERE m IS NOT NULL GROUP BY person_id, m""",
)
def _(spark, d):
    diary = b.diary(spark, d)
    return cal.person_mix(cal.person_profile(diary), diary)


TRANSPARENCY = f"""SELECT *, floor((coalesce(topic_score * 0.40, 0.0) + coalesce(clock_score * 0.25, 0.0) + coalesce(single_person_score * 0.20, 0.0) + coalesce(dated_score * 0.15, 0.0))
      / nullif((CASE WHEN topic_score IS NOT NULL THEN 0.40 ELSE 0.0 END) + (CASE WHEN clock_score IS NOT NULL THEN 0.25 ELSE 0.0 END) + (CASE WHEN single_person_score IS NOT NULL THEN 0.20 ELSE 0.0 END)
      + (CASE WHEN dated_score IS NOT NULL THEN 0.15 ELSE 0.0 END), 0) * 10.0 + 0.5) / 10.0 AS score FROM (
    SELECT section_id, CAST(sum(entry_count) AS BIGINT) AS entry_count, count(*) AS people_count, {share("greatest(0, sum(entry_count) - sum(no_subject_count) - sum(unspecified_count))", "sum(entry_count)")} AS topic_score,
      {share("sum(usable_count)", "sum(entry_count)")} AS clock_score, {share("sum(CASE WHEN covers_multiple THEN 0 ELSE entry_count END)", "sum(entry_count)")} AS single_person_score,
      {share("count(*) FILTER (dated_count > 0)", "count(*)")} AS dated_score FROM prof GROUP BY 1)"""


@query("c18_transparency_score", TRANSPARENCY)
def _(spark, d):
    return cal.transparency_score(cal.person_profile(b.diary(spark, d)))


def sections(spark, d):
    return b.read(spark, d, "nation").select(
        F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("section_id"),
        F.col("n_name").alias("display_name"),
        F.when(F.col("n_nationkey") % 3 != 2, "ministry").otherwise("other").alias("kind"),
    )


SECTIONS = "SELECT 'S' || n_nationkey AS section_id, n_name AS display_name, CASE WHEN n_nationkey % 3 <> 2 THEN 'ministry' ELSE 'other' END AS kind FROM nation"
STATES = f"""SELECT s.section_id, s.kind, CASE WHEN coalesce(c.n, 0) = 0 THEN CASE WHEN s.kind = 'ministry' THEN 'nothing_published' ELSE 'no_diary_expected' END
      WHEN c.n > c.u THEN 'published_and_read' ELSE 'published_not_read' END AS state, coalesce(c.n, 0) AS published, coalesce(c.u, 0) AS unread
    FROM ({SECTIONS}) s LEFT JOIN (SELECT section_id, count(*) AS n, count(*) FILTER (readable_entries = 0) AS u FROM pubs GROUP BY 1) c ON c.section_id = s.section_id"""


@query("c19_publication_state", STATES)
def _(spark, d):
    return cal.publication_state(sections(spark, d), b.publications(spark, d))


@query("c19_publication_matrix", f"SELECT state, count(*) AS sections FROM ({STATES}) GROUP BY 1")
def _(spark, d):
    return cal.publication_matrix(cal.publication_state(sections(spark, d), b.publications(spark, d)))


# ---- filters, joins and de-duplication of calendar rows --------------------------


@query(
    "p6_filter_diary",
    "SELECT entry_id FROM diary WHERE category = 'private_sector' AND contains(lower(subject || ' ' || coalesce(location, '') || ' ' || coalesce(participants, '')), 'room 3')",
)
def _(spark, d):
    return filters.filter_diary(b.diary(spark, d), category="private_sector", query=" Room 3 ").select("entry_id")


@query("p7_filter_findings", f"SELECT * FROM ({ALL_FINDINGS}) WHERE rule_id = 'weekend_meetings' AND section_id = 'S4'")
def _(spark, d):
    return filters.filter_findings(findings_of(spark, d), rule="weekend_meetings", section="S4")


@query(
    "p10_window_filter",
    """SELECT dataset_id, count(*) FILTER (o = 'k') AS kept, count(*) FILTER (o = 'e') AS empty_rows, count(*) FILTER (o = 'x') AS out_of_window_rows FROM (
         SELECT dataset_id, CASE WHEN date IS NULL AND subject = 'ללא נושא רשום' THEN 'e' WHEN date IS NULL AND subject IS NULL THEN 'e' WHEN date < DATE '2024-01-05' OR date > DATE '2024-01-25' THEN 'x'
           WHEN date IS NULL AND k99 THEN 'e' ELSE 'k' END AS o FROM (SELECT *, date IS NULL AND user_id % 2 = 0 AS k99 FROM drows)) GROUP BY 1""",
)
def _(spark, d):
    rows = b.diary_rows(spark, d)
    user = F.regexp_extract("dataset_id", r"(\d+)", 1).cast("bigint")
    blank = F.when(F.col("date").isNull() & (user % 2 == 0), F.lit(" ")).otherwise(F.col("subject"))
    return filters.window_filter(rows.withColumn("subject", blank), "2024-01-05", "2024-01-25")[1]


@query("p12_unread_publications", "SELECT dataset_id FROM pubs WHERE readable_entries = 0 AND unreadable > 0")
def _(spark, d):
    return cal.unread_publications(b.publications(spark, d)).select("dataset_id")


@query(
    "j1_join_meta",
    "SELECT entry_id, section_id, person_key, category, role_label FROM diary",
)
def _(spark, d):
    return b.diary(spark, d).select("entry_id", "section_id", "person_key", "category", "role_label")


@query("j1_orphans", "SELECT count(*) AS orphan_rows FROM drows r WHERE NOT EXISTS (SELECT 1 FROM pubs p WHERE p.dataset_id = r.dataset_id)")
def _(spark, d):
    return cal.join_meta(b.diary_rows(spark, d), b.publications(spark, d))[1]


DEDUPE = """SELECT *, row_number() OVER (PARTITION BY coalesce(section_id, '—'), role_label, coalesce(person_label, '—'), coalesce(CAST(date AS VARCHAR), '—'), coalesce(start_time, '—'), subject ORDER BY entry_id) AS rn
    FROM (SELECT * REPLACE (CASE WHEN start_time < '12:00' THEN '00:00' ELSE start_time END AS start_time, regexp_extract(subject, '^[a-z]*', 0) AS subject) FROM diary)"""


def _coarse(spark, d):
    """Coarser subjects and times, so that rows coincide."""
    diary = b.diary(spark, d)
    return diary.withColumns(
        {
            "start_time": F.when(F.col("start_time") < "12:00", "00:00").otherwise(F.col("start_time")),
            "subject": F.regexp_extract("subject", "^[a-z]*", 0),
        }
    )


@query("w5_dedupe_entries", f"SELECT entry_id FROM ({DEDUPE}) WHERE rn = 1")
def _(spark, d):
    return ranking.dedupe_entries(_coarse(spark, d))[0].select("entry_id")


@query(
    "w5_dedupe_counts",
    f"SELECT dataset_id, count(*) FILTER (rn = 1) AS kept, count(*) FILTER (rn > 1) AS removed FROM ({DEDUPE}) GROUP BY 1",
)
def _(spark, d):
    return ranking.dedupe_entries(_coarse(spark, d))[1]


@query(
    "w3_rank_diary_findings",
    f"""WITH f AS ({ALL_FINDINGS}), m AS (SELECT rule_id, value AS med FROM (SELECT rule_id, value, row_number() OVER (PARTITION BY rule_id ORDER BY value) AS rn, count(*) OVER (PARTITION BY rule_id) AS n FROM f) WHERE rn = n // 2 + 1)
        SELECT f.rule_id, f.person_key, f.value, coalesce(CASE WHEN m.med > 0 THEN f.value / m.med END, 1.0) AS strength FROM f LEFT JOIN m ON m.rule_id = f.rule_id""",
)
def _(spark, d):
    return ranking.rank_diary_findings(findings_of(spark, d)).select("rule_id", "person_key", "value", "strength")

