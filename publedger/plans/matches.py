"""Queries that join by name, interval and nearest date, and rank or cap what is joined."""

from __future__ import annotations

from pyspark.sql import functions as F

from publedger.operators import contracts as deals
from publedger.operators import filters, matching, ranking, sets
from publedger.plans.oracle import matches_query, norm_entity, norm_name, squeeze
from publedger.plans.registry import query
from publedger.sources import bindings as b


def aliases(spark, d):
    """Aliases of the sections: the nation's name, and each region's name for its first nation."""
    n = b.read(spark, d, "nation")
    key = F.col("n_nationkey")
    section = F.concat(F.lit("S"), key.cast("string")).alias("section_id")
    own = n.select(section, key.alias("seq"), F.concat(F.lit("משרד ה"), "n_name").alias("alias"))
    short = n.select(section, key.alias("seq"), F.col("n_name").alias("alias"))
    return own.unionByName(short)


ALIASES = """SELECT 'S' || n_nationkey AS section_id, n_nationkey AS seq, 'משרד ה' || n_name AS alias FROM nation UNION ALL SELECT 'S' || n_nationkey, n_nationkey, n_name FROM nation"""


def offices(spark, d):
    """Customers with the office text their publications would carry."""
    k = F.col("c_custkey")
    rows = b.read(spark, d, "customer").join(b.read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    office = (
        F.when(k % 5 == 0, F.concat(F.lit('"'), "n_name", F.lit('"  office '), (k % 30).cast("string")))
        .when(k % 5 == 1, F.lit("NATION"))
        .when(k % 5 == 2, F.concat(F.lit("unit "), (k % 40).cast("string")))
        .when(k % 5 == 3, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("משרד   ה"), "n_name"))
    )
    return rows.select("c_custkey", office.alias("office"))


OFFICES = """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '"' || n_name || '"  office ' || (c_custkey % 30) WHEN 1 THEN 'NATION' WHEN 2 THEN 'unit ' || (c_custkey % 40) WHEN 3 THEN NULL ELSE 'משרד   ה' || n_name END AS office
    FROM customer JOIN nation ON c_nationkey = n_nationkey"""
MATCHED = f"""SELECT o.c_custkey, o.office, (SELECT arg_min(section_id, seq) FROM ({ALIASES}) a WHERE length({norm_name("a.alias")}) >= 4
      AND (contains({norm_name("o.office")}, {norm_name("a.alias")}) OR contains({norm_name("a.alias")}, {norm_name("o.office")}))) AS section_id FROM ({OFFICES}) o WHERE o.office IS NOT NULL"""


@query("j2_match_office", f"SELECT * FROM ({MATCHED}) WHERE section_id IS NOT NULL")
def _(spark, d):
    return matching.match_office(offices(spark, d), "office", aliases(spark, d))[0]


@query("j2_unmatched_offices", f"SELECT office, count(*) AS n FROM ({MATCHED}) WHERE section_id IS NULL GROUP BY 1")
def _(spark, d):
    return matching.match_office(offices(spark, d), "office", aliases(spark, d))[1].withColumnRenamed("rows", "n")


@query(
    "j3_match_title",
    f"""WITH v AS (SELECT DISTINCT section_id, seq, needle FROM (SELECT section_id, seq, {norm_name("alias")} AS needle FROM ({ALIASES}) UNION ALL
          SELECT section_id, seq, regexp_replace({norm_name("alias")}, '^(?:המשרד ל|משרד ה|משרד )', '') FROM ({ALIASES})) WHERE length(needle) >= 4),
        t AS (SELECT DISTINCT office AS title FROM ({OFFICES}))
        SELECT t.title, (SELECT section_id FROM v WHERE contains({norm_name("t.title")}, v.needle) ORDER BY length(needle) DESC, seq LIMIT 1) AS section_id FROM t""",
)
def _(spark, d):
    return matching.match_title(offices(spark, d).withColumnRenamed("office", "title"), "title", aliases(spark, d))


@query(
    "j4_match_exact",
    f"""SELECT o.c_custkey, o.office, n.section_id FROM ({OFFICES}) o LEFT JOIN (SELECT {squeeze("alias")} AS name, arg_min(section_id, seq) AS section_id FROM ({ALIASES}) GROUP BY 1) n ON n.name = {squeeze("o.office")}""",
)
def _(spark, d):
    return matching.match_exact(offices(spark, d), "office", aliases(spark, d).withColumnRenamed("alias", "name"))


def positions(spark, d):
    k = F.col("c_custkey")
    return offices(spark, d).select(
        k.alias("position_id"),
        F.when(k % 14 == 13, F.lit(-1)).otherwise(k % 700).alias("person_id"),  # nobody has the id -1
        F.when(k % 9 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" duty "), (k % 4).cast("string"))).alias("duty"),
        F.col("office").alias("ministry_name"),
        F.when(k % 6 != 0, F.concat(F.lit("2023-0"), (k % 9 + 1).cast("string"), F.lit("-15T00:00:00"))).alias("start_date"),
        F.when(k % 2 == 0, F.lit("2024-02-30")).otherwise(F.lit("2024-05-06T10:00:00")).alias("finish_date"),
    )


def persons(spark, d):
    k = F.col("p_partkey")
    return b.read(spark, d, "part").select(
        k.alias("person_id"),
        F.when(k % 8 == 0, F.lit(" ")).otherwise(F.col("p_type")).alias("first_name"),
        F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand")).alias("last_name"),
    )


POSITIONS = f"""SELECT c_custkey AS position_id, CASE WHEN c_custkey % 14 = 13 THEN -1 ELSE c_custkey % 700 END AS person_id, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'duty ' || (c_custkey % 4) END AS duty, office,
    CASE WHEN c_custkey % 6 <> 0 THEN '2023-0' || (c_custkey % 9 + 1) || '-15' END AS start_date, CASE WHEN c_custkey % 2 <> 0 THEN '2024-05-06' END AS end_date FROM ({OFFICES})"""
BUILT = f"""SELECT *, CASE WHEN person_name = '' OR person_name IS NULL THEN 'without_name' WHEN section_id IS NULL THEN 'without_section' WHEN duty = '' THEN 'without_role' ELSE 'tenure' END AS outcome FROM (
    SELECT p.*, n.section_id, q.person_name FROM ({POSITIONS}) p LEFT JOIN (SELECT {squeeze("alias")} AS name, arg_min(section_id, seq) AS section_id FROM ({ALIASES}) GROUP BY 1) n ON n.name = {squeeze("p.office")}
    LEFT JOIN (SELECT p_partkey, concat_ws(' ', CASE WHEN p_partkey % 8 <> 0 THEN p_type END, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END) AS person_name FROM part) q ON q.p_partkey = p.person_id)"""


@query(
    "j5_build_tenures",
    f"SELECT 'tenure-' || position_id AS tenure_id, person_name, duty AS role, section_id, start_date, end_date FROM ({BUILT}) WHERE outcome = 'tenure'",
)
def _(spark, d):
    names = aliases(spark, d).withColumnRenamed("alias", "name")
    return matching.build_tenures(positions(spark, d), persons(spark, d), names)[0]


@query("j5_appointment_counts", f"SELECT outcome, count(*) AS appointments FROM ({BUILT}) GROUP BY 1")
def _(spark, d):
    names = aliases(spark, d).withColumnRenamed("alias", "name")
    return matching.build_tenures(positions(spark, d), persons(spark, d), names)[1]


@query(
    "j6_tenure_segments",
    "SELECT tenure_id, section_id, CAST(window_start AS VARCHAR) AS window_start, CAST(from_date AS VARCHAR) AS from_date, CAST(to_date AS VARCHAR) AS to_date, days, share_percent FROM segs",
)
def _(spark, d):
    segments = matching.tenure_segments(b.tenures(spark, d), b.tenure_windows(spark, d))
    return segments.select("tenure_id", "section_id", "window_start", "from_date", "to_date", "days", "share_percent")


@query(
    "j6_attribute_window",
    """WITH covered AS (SELECT section_id, window_start, count(DISTINCT day) AS n FROM (SELECT section_id, window_start, unnest(range(from_date, to_date + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day FROM segs) GROUP BY 1, 2),
       best AS (SELECT *, row_number() OVER (PARTITION BY section_id, window_start ORDER BY days DESC, from_date, tenure_id) AS rn, count(*) OVER (PARTITION BY section_id, window_start) AS segments FROM segs),
       split AS (SELECT section_id, window_start, count(DISTINCT person_name) > 1 AS is_split FROM segs GROUP BY 1, 2)
       SELECT w.section_id, CAST(w.window_start AS VARCHAR) AS window_start, CAST(w.window_end AS VARCHAR) AS window_end, coalesce(b.segments, 0) AS segments, coalesce(s.is_split, false) AS is_split,
         date_diff('day', w.window_start, w.window_end) + 1 - coalesce(c.n, 0) AS uncovered_days, b.person_name AS main_holder, b.days AS main_days, b.share_percent AS main_share_percent
       FROM wins w LEFT JOIN best b ON b.section_id = w.section_id AND b.window_start = w.window_start AND b.rn = 1
       LEFT JOIN covered c ON c.section_id = w.section_id AND c.window_start = w.window_start LEFT JOIN split s ON s.section_id = w.section_id AND s.window_start = w.window_start""",
)
def _(spark, d):
    return matching.attribute_window(b.tenures(spark, d), b.tenure_windows(spark, d))


# ---- names in subjects ---------------------------------------------------------


def pool(spark, d):
    return matching.name_pool(
        deals.supplier_totals(b.contracts(spark, d)), deals.recipient_totals(b.payments(spark, d))
    )


CROSS = f"""SELECT CASE WHEN kind = 'supplier' THEN 'supplier_meeting' ELSE 'support_recipient_meeting' END AS rule_id, d.entry_id, d.section_id, CASE WHEN NOT d.shared THEN d.person_label END AS person_label, d.role_label, d.person_key,
      CAST(d.date AS VARCHAR) AS date, d.subject, p.name AS matched_name, p.amount, p.kind
    FROM diary d JOIN (SELECT section_id, supplier AS name, volume AS amount, 'supplier' AS kind FROM sup UNION ALL SELECT section_id, recipient, approved, 'support' FROM all_recipients) p
      ON p.section_id = d.section_id AND length({norm_entity("p.name")}) >= 6 AND contains({norm_entity("d.subject")}, {norm_entity("p.name")})"""


@query("j7_cross_reference", CROSS)
def _(spark, d):
    return matching.cross_reference(b.diary(spark, d), pool(spark, d))


@query("j7_cross_reference_anchored", CROSS)
def _(spark, d):
    return matching.cross_reference(b.diary(spark, d), pool(spark, d))


@query("d9_supplier_meeting", f"SELECT rule_id, entry_id, person_key, section_id, person_label, matched_name, amount FROM ({CROSS}) WHERE kind = 'supplier'")
def _(spark, d):
    from publedger.operators import rules

    return rules.match_findings(matching.cross_reference(b.diary(spark, d), pool(spark, d)), "supplier")


@query("d10_support_recipient_meeting", f"SELECT rule_id, entry_id, person_key, section_id, person_label, matched_name, amount FROM ({CROSS}) WHERE kind = 'support'")
def _(spark, d):
    from publedger.operators import rules

    return rules.match_findings(matching.cross_reference(b.diary(spark, d), pool(spark, d)), "support")


def passages(spark, d):
    """The benchmark texts, as names to find in whole documents."""
    return b.read(spark, d, "benchmark").select(F.col("text").alias("needle"))


PASSAGES = "SELECT DISTINCT d.doc_id AS text_id, n.needle FROM documents d, (SELECT DISTINCT text AS needle FROM benchmark) n WHERE contains(d.text, n.needle)"


@query("j7_passages_in_documents", PASSAGES)
def _(spark, d):
    texts = b.read(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return matching.substring_matches(texts, passages(spark, d))


@query("j7_passages_anchored", PASSAGES)
def _(spark, d):
    texts = b.read(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return matching.substring_matches(texts, passages(spark, d))


# ---- nearest in time -------------------------------------------------------------


def meetings(spark, d):
    """Sign-ups as meetings, one name per ten users; some undated, some of nobody known."""
    e = b.read(spark, d, "events").filter(F.col("event_type") == "signup")
    u, k = F.col("user_id"), F.col("event_id")
    return e.select(
        F.concat(F.lit("S"), (u % 5).cast("string")).alias("section_id"),
        F.when(k % 31 == 0, F.lit("Nobody")).otherwise(F.concat(F.lit('Customer "'), (u % 50).cast("string"), F.lit('" Ltd'))).alias("matched_name"),
        F.when(k % 17 != 0, F.to_date("ts")).alias("date"),
        k.alias("entry_id"),
    )


def orders_held(spark, d):
    e = b.read(spark, d, "events").filter(F.col("event_type") == "purchase")
    u, k = F.col("user_id"), F.col("event_id")
    return e.select(
        F.concat(F.lit("S"), (u % 5).cast("string")).alias("section_id"),
        F.concat(F.lit("CUSTOMER "), (u % 50).cast("string"), F.lit(" ltd group")).alias("supplier"),
        F.when(k % 3 == 0, F.to_date("ts")).when(k % 3 == 1, F.date_add(F.to_date("ts"), (k % 200).cast("int"))).alias("order_date"),
        k.alias("seq"),
    )


MEET = """SELECT 'S' || (user_id % 5) AS section_id, CASE WHEN event_id % 31 = 0 THEN 'nobody' ELSE 'customer ' || (user_id % 50) || ' ltd' END AS target, CASE WHEN event_id % 17 <> 0 THEN CAST(ts AS DATE) END AS date, event_id AS entry_id FROM events WHERE event_type = 'signup'"""
HELD = """SELECT 'S' || (user_id % 5) AS section_id, 'customer ' || (user_id % 50) || ' ltd group' AS supplier, CASE event_id % 3 WHEN 0 THEN CAST(ts AS DATE) WHEN 1 THEN CAST(ts AS DATE) + CAST(event_id % 200 AS INT) END AS order_date, event_id AS seq FROM events WHERE event_type = 'purchase'"""
TIMED = f"""SELECT * FROM (SELECT m.section_id, m.entry_id, h.seq AS contract_seq, date_diff('day', m.date, h.order_date) AS days_before_order, date_diff('day', m.date, h.order_date) BETWEEN 0 AND 90 AS within_window,
      row_number() OVER (PARTITION BY m.entry_id ORDER BY abs(date_diff('day', m.date, h.order_date)), h.seq) AS rn
    FROM ({MEET}) m JOIN ({HELD}) h ON h.section_id = m.section_id AND contains(h.supplier, m.target) WHERE m.date IS NOT NULL AND h.order_date IS NOT NULL) WHERE rn = 1"""


@query("j8_meeting_timing", f"SELECT section_id, entry_id, contract_seq, days_before_order, within_window FROM ({TIMED})")
def _(spark, d):
    timed = matching.meeting_timing(meetings(spark, d), orders_held(spark, d))
    return timed.select("section_id", "entry_id", "contract_seq", "days_before_order", "within_window")


@query(
    "j8_timing_summary",
    f"""WITH t AS ({TIMED}), m AS (SELECT section_id, count(*) AS n FROM ({MEET}) GROUP BY 1), h AS (SELECT section_id, count(*) AS n FROM ({HELD}) WHERE order_date IS NOT NULL GROUP BY 1)
        SELECT m.section_id, count(t.entry_id) AS timed, any_value(m.n) - count(t.entry_id) AS unplaceable, count(*) FILTER (t.within_window) AS within_window,
          floor(median(t.days_before_order) FILTER (t.days_before_order >= 0) * 10.0 + 0.5) / 10.0 AS median_days_before, any_value(h.n) - count(DISTINCT t.contract_seq) AS contracts_without_match, any_value(h.n) AS contracts_held
        FROM m LEFT JOIN t ON t.section_id = m.section_id LEFT JOIN h ON h.section_id = m.section_id GROUP BY 1""",
)
def _(spark, d):
    held = orders_held(spark, d)
    found = meetings(spark, d)
    return matching.timing_summary(found, held, matching.meeting_timing(found, held))


@query(
    "j9_person_join",
    """SELECT t.tenure_id, replace(t.person_name, ' ', '-') AS person_id, p.person_key, p.entry_count FROM tenures t
       LEFT JOIN (SELECT 'Holder-' || user_id AS person_id, 'S' || (user_id % 5) || '|' || user_id AS person_key, count(*) AS entry_count FROM events GROUP BY 1, 2, user_id) p ON p.person_id = replace(t.person_name, ' ', '-')""",
)
def _(spark, d):
    u = F.col("user_id")
    profiles = b.read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("entry_count")).select(
        F.concat(F.lit("Holder "), u.cast("string")).alias("person_label"),
        F.concat(F.lit("S"), (u % 5).cast("string"), F.lit("|"), u.cast("string")).alias("person_key"),
        "entry_count",
    )
    return matching.person_join(b.tenures(spark, d), profiles).select("tenure_id", "person_id", "person_key", "entry_count")


@query(
    "j10_prior_year",
    "SELECT a.section_id, a.code, a.year, a.allocated, p.allocated AS prior_allocated FROM regs a LEFT JOIN regs p ON p.section_id = a.section_id AND p.code = a.code AND p.year = a.year - 1",
)
def _(spark, d):
    return matching.prior_year(b.regulations(spark, d), ["allocated"]).select("section_id", "code", "year", "allocated", "prior_allocated")


# ---- activities and sources: filters, caps, de-duplication, union ---------------------

ACTIVITY_TEXT = matches_query(
    ["title || ' ' || summary || ' ' || array_to_string(topics, ' ') || CASE WHEN len(people) > 0 THEN ' ' || array_to_string(people, ' ') ELSE '' END || CASE WHEN len(organizations) > 0 THEN ' ' || array_to_string(organizations, ' ') ELSE '' END"],
    "the  that long",
)


@query("p1_matches_query", f"SELECT id FROM acts WHERE {ACTIVITY_TEXT}")
def _(spark, d):
    from publedger.functions.text import matches_query as search

    rows = b.activities(spark, d)
    return rows.filter(search(["title", "summary", "topics", "people", "organizations"], " The  that LONG ")).select("id")


@query(
    "p2_filter_activities",
    f"SELECT id FROM acts WHERE section_id = 'S3' AND year(date) = 2023 AND list_contains(topics, 'en') AND source_type = 'government_page' AND {ACTIVITY_TEXT}",
)
def _(spark, d):
    rows = b.activities(spark, d)
    return filters.filter_activities(rows, "S3", "2023", "en", "government_page", "the that long").select("id")


@query("p3_filter_activities_entity", "SELECT id FROM acts WHERE list_contains(list_concat(people, organizations), 'O2') AND date IS NOT NULL AND year(date) = 2024")
def _(spark, d):
    return filters.filter_activities(b.activities(spark, d), year="2024", entity="O2").select("id")


@query(
    "p4_filter_sources",
    f"""SELECT seq, 'section' AS kind FROM cat WHERE list_contains(section_ids, 'S2') AND list_contains(fiscal_years, 2025) AND publisher = 'pub-2' AND source_type = 'other'
        UNION ALL SELECT seq, 'cross' FROM cat WHERE len(section_ids) = 0 AND {matches_query(["coalesce(title || ' ', '') || publisher || ' ' || source_type_label || ' ' || url"], "pub gov")}""",
)
def _(spark, d):
    rows = b.catalogue(spark, d)
    one = filters.filter_sources(rows, "S2", "2025", "other", "pub-2").select("seq", F.lit("section").alias("kind"))
    cross = filters.filter_sources(rows, filters.CROSS_CUTTING, query="pub GOV").select("seq", F.lit("cross").alias("kind"))
    return one.unionByName(cross)


@query("p13_sources_for_section", "SELECT seq FROM cat WHERE list_contains(section_ids, 'S5')")
def _(spark, d):
    return filters.for_section(b.catalogue(spark, d), "S5", "section_ids").select("seq")


@query(
    "p9_search_entities",
    "SELECT * FROM (SELECT c_custkey AS seq, c_name AS label FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'customer') AND contains(lower(c_name || ' ' || c_mktsegment), 'machin') ORDER BY c_custkey LIMIT 12)",
)
def _(spark, d):
    rows = b.read(spark, d, "customer").select(
        F.col("c_custkey").alias("seq"), F.col("c_name").alias("label"), F.array("c_mktsegment").alias("keywords")
    )
    return filters.search_entities(rows, "Customer  machin").select("seq", "label")


@query(
    "p8_data_backed_topics",
    "SELECT t AS topic, count(*) AS item_count FROM (SELECT unnest(topics) AS t FROM acts) GROUP BY 1",
)
def _(spark, d):
    from publedger.operators.classify import topic_counts

    return filters.data_backed_topics(topic_counts(b.activities(spark, d), ["en", "fr", "de", "es", "long", "nobody"]))


CAPPED = "SELECT *, row_number() OVER (PARTITION BY section_id, feed ORDER BY date DESC NULLS LAST, seq) AS rn, count(*) OVER (PARTITION BY section_id, feed) AS n FROM acts"


@query("w4_cap_per_feed", f"SELECT id, section_id, feed FROM ({CAPPED}) WHERE rn <= 20")
def _(spark, d):
    return ranking.cap_per_feed(b.activities(spark, d), 20)[0].select("id", "section_id", "feed")


@query("w4_cap_counts", f"SELECT section_id, feed, least(any_value(n), 20) AS kept, greatest(any_value(n) - 20, 0) AS dropped FROM ({CAPPED}) GROUP BY 1, 2")
def _(spark, d):
    return ranking.cap_per_feed(b.activities(spark, d), 20)[1]


@query("w6_dedupe_activities", "SELECT section_id, url, max(seq) AS seq FROM acts GROUP BY 1, 2")
def _(spark, d):
    return ranking.dedupe_activities(b.activities(spark, d)).select("section_id", "url", "seq")


@query("w7_dedupe_sources", "SELECT text AS url, min(doc_id) AS seq FROM documents GROUP BY 1")
def _(spark, d):
    rows = b.read(spark, d, "documents").select(F.col("text").alias("url"), F.col("doc_id").alias("seq"))
    return ranking.dedupe_sources(rows)


@query(
    "u1_union_feeds",
    """SELECT id, feed, section_id, title, CASE WHEN feed = 'bids' THEN NULL ELSE source_type END AS source_type, CASE WHEN feed = 'bids' THEN CAST(date + 30 AS VARCHAR) END AS claim_date FROM acts""",
)
def _(spark, d):
    rows = b.activities(spark, d)
    common = ["id", "section_id", "title"]
    decisions = rows.filter(F.col("feed") == "decisions").select(*common, "source_type")
    publications = rows.filter(F.col("feed") == "publications").select(*common, "source_type")
    bids = rows.filter(F.col("feed") == "bids").select(*common, F.date_add("date", 30).alias("claim_date"))
    return sets.union_feeds({"decisions": decisions, "publications": publications, "bids": bids})


