"""Queries that classify short texts, infer fields from names, and extract calendar rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from publedger.operators import classify, extract, inference
from publedger.plans.oracle import bare, non_topic, norm_subject, pct, squeeze, values, word_match
from publedger.plans.registry import query
from publedger.session import cut_lineage
from publedger.sources import bindings as b

TOPICS = [("articles", ["the ", "der ", "las"]), ("links", [" and ", " und ", "  et  "]), ("rare", ["|", "thought"]), ("none", ["zzzzqq"])]
OVERRIDES = [("^act-1[0-9]*5$", ["manual"], "ends in five"), ("7$", ["links", "seven"], "ends in seven")]


def _topic_sql(topic: str, keywords: list[str]) -> str:
    hits = ", ".join(f"CASE WHEN contains(t, '{' '.join(k.split())}') THEN '{k}' END" for k in keywords)
    return f"CASE WHEN concat_ws(', ', {hits}) <> '' THEN 'keyword_match({topic}): ' || concat_ws(', ', {hits}) END"


TOPIC_TEXT = squeeze("regexp_replace(title || ' ' || summary, '[֑-ׇ]', '', 'g')")


@query(
    "x1_match_topics",
    f"""SELECT id, concat_ws(', ', {", ".join(f"CASE WHEN {_topic_sql(t, k)} IS NOT NULL THEN '{t}' END" for t, k in TOPICS)}) AS topics,
          concat_ws(' | ', {", ".join(_topic_sql(t, k) for t, k in TOPICS)}) AS topic_rule FROM (SELECT id, {TOPIC_TEXT} AS t FROM acts)""",
)
def _(spark, d):
    return classify.match_topics(b.activities(spark, d), TOPICS).select("id", "topics", "topic_rule")


CLASSED = f"""SELECT id, list_sort(list_distinct(list_filter([{", ".join(f"CASE WHEN {_topic_sql(t, k)} IS NOT NULL THEN '{t}' END" for t, k in TOPICS)},
      CASE WHEN regexp_matches(id, '^act-1[0-9]*5$') THEN 'manual' END, CASE WHEN regexp_matches(id, '7$') THEN 'links' END, CASE WHEN regexp_matches(id, '7$') THEN 'seven' END], lambda x: x IS NOT NULL))) AS topics,
    notes || ' || סיווג נושאים: ' || concat_ws(' | ', {", ".join(_topic_sql(t, k) for t, k in TOPICS)}, CASE WHEN regexp_matches(id, '^act-1[0-9]*5$') THEN 'manual_override: ends in five' END,
      CASE WHEN regexp_matches(id, '7$') THEN 'manual_override: ends in seven' END) AS notes FROM (SELECT id, notes, {TOPIC_TEXT} AS t FROM acts)"""


@query("x2_classify_topics", f"SELECT id, array_to_string(topics, ', ') AS topics, notes FROM ({CLASSED})")
def _(spark, d):
    once = classify.classify_topics(b.activities(spark, d), TOPICS, OVERRIDES)
    again = classify.classify_topics(once, TOPICS, OVERRIDES)  # running twice changes nothing
    return again.select("id", "topics", "notes")


DECLARED = ["articles", "links", "manual", "none", "rare", "seven", "unused"]


@query(
    "x2_topic_counts",
    f"""SELECT v.topic, count(c.t) AS item_count FROM (VALUES {values([(t,) for t in DECLARED])}) v(topic) LEFT JOIN (SELECT unnest(topics) AS t FROM ({CLASSED})) c ON c.t = v.topic GROUP BY 1""",
)
def _(spark, d):
    return classify.topic_counts(classify.classify_topics(b.activities(spark, d), TOPICS, OVERRIDES), DECLARED)


def _in(terms: list[str]) -> str:
    return ", ".join(f"'{t}'" for t in terms)


DECIDED = f"""SELECT s.subject, CASE WHEN s.bare = '' OR s.bare IN ({_in(b.sentinel_terms())}) THEN 'no_subject_recorded' WHEN s.bare IN ({_in(b.generic_terms())}) THEN 'unspecified' ELSE coalesce(w.category, 'unclassified') END AS category,
      w.needle AS matched_keyword, w.confidence AS matched_confidence, CASE WHEN s.bare = '' OR s.bare IN ({_in(b.sentinel_terms())}) THEN 'no_subject_recorded' WHEN s.bare IN ({_in(b.generic_terms())}) THEN 'generic_subject'
        WHEN w.category IS NOT NULL THEN 'keyword_match' ELSE 'no_match' END AS rule
    FROM subj s LEFT JOIN (SELECT * FROM (SELECT h.subject, l.category, l.keyword AS needle, l.confidence, row_number() OVER (PARTITION BY h.subject ORDER BY l.category IN ({non_topic()}), length(l.keyword) DESC, l.priority, l.seq) AS rn
        FROM (SELECT subject, hay FROM subj WHERE bare <> '' AND bare NOT IN ({_in(b.sentinel_terms() + b.generic_terms())})) h JOIN lex l ON {word_match("h.hay", "l.keyword")}) WHERE rn = 1) w ON w.subject = s.subject"""
SUBJ = f"subj AS (SELECT subject, lower({norm_subject('subject')}) AS hay, {bare('subject')} AS bare FROM (SELECT DISTINCT subject FROM slines))"


def classified(spark, d):
    return classify.classify_subject(b.subject_lines(spark, d), b.lexicon(spark), b.generic_terms(), b.sentinel_terms())


@query("x3_classify_subject", f"WITH {SUBJ}, dec AS ({DECIDED}) SELECT l.entry_id, dec.category, dec.matched_keyword, dec.matched_confidence, dec.rule FROM slines l JOIN dec ON dec.subject = l.subject")
def _(spark, d):
    return classified(spark, d).select("entry_id", "category", "matched_keyword", "matched_confidence", "rule")


CATEGORIES = sorted({c for _, c, _, _ in b.LEXICON} | {"unclassified", "unspecified", "no_subject_recorded", "war_recovery"})


def categories(spark):
    return spark.createDataFrame([(c,) for c in CATEGORIES], "category string")


@query(
    "x4_category_report",
    f"""WITH {SUBJ}, dec AS ({DECIDED}), n AS (SELECT dec.category, count(*) AS n FROM slines l JOIN dec ON dec.subject = l.subject GROUP BY 1),
        k AS (SELECT category, count(*) AS n, count(*) FILTER (confidence = 'high') AS h, count(*) FILTER (confidence = 'medium') AS m, count(*) FILTER (confidence = 'low') AS l FROM lex GROUP BY 1)
        SELECT v.category, coalesce(n.n, 0) AS entry_count, coalesce(k.n, 0) AS keyword_count, coalesce(k.h, 0) AS keywords_high, coalesce(k.m, 0) AS keywords_medium, coalesce(k.l, 0) AS keywords_low
        FROM (VALUES {values([(c,) for c in CATEGORIES])}) v(category) LEFT JOIN n ON n.category = v.category LEFT JOIN k ON k.category = v.category""",
)
def _(spark, d):
    return classify.category_report(classified(spark, d), categories(spark), b.lexicon(spark))


@query(
    "x4_confidence_totals",
    f"WITH {SUBJ}, dec AS ({DECIDED}) SELECT dec.matched_confidence, count(*) AS n FROM slines l JOIN dec ON dec.subject = l.subject WHERE dec.matched_confidence IS NOT NULL GROUP BY 1",
)
def _(spark, d):
    return classify.confidence_totals(classified(spark, d))


@query(
    "x5_audit_lexicon",
    f"""WITH t AS (SELECT lower({norm_subject('subject')}) AS text, count(*) AS w FROM slines GROUP BY 1), h AS (SELECT l.keyword, t.text, t.w, row_number() OVER (PARTITION BY l.keyword ORDER BY t.w DESC, t.text) AS rn FROM lex l JOIN t ON {word_match("t.text", "l.keyword")})
        SELECT l.keyword, l.category, l.confidence, coalesce(x.hits, 0) AS hits, coalesce(x.examples, '') AS examples FROM lex l
        LEFT JOIN (SELECT keyword, CAST(sum(w) AS BIGINT) AS hits, string_agg(text, ' || ' ORDER BY rn) FILTER (rn <= 3) AS examples FROM h GROUP BY 1) x ON x.keyword = l.keyword""",
)
def _(spark, d):
    return classify.audit_lexicon(b.subject_lines(spark, d), b.lexicon(spark))


def proposals(spark, d):
    """Keyword proposals out of line items: part names as keywords, ship modes as experts."""
    rows = b.read(spark, d, "lineitem").join(b.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    q = F.col("l_quantity").cast("int")
    return rows.select(
        F.concat(F.lit("expert-"), (F.col("l_suppkey") % 7).cast("string")).alias("expert"),
        F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  "))).alias("keyword"),
        F.concat(F.lit("cat-"), (q % 5).cast("string")).alias("category"),
        F.when(q == 17, "high").when(q % 2 == 0, "medium").otherwise("low").alias("confidence"),
        F.col("p_type").alias("reasoning"),
    ).distinct()


PROPOSALS = """SELECT DISTINCT 'expert-' || (l_suppkey % 7) AS expert, p_name AS keyword, 'cat-' || (CAST(l_quantity AS INT) % 5) AS category,
    CASE WHEN l_quantity = 17 THEN 'high' WHEN CAST(l_quantity AS INT) % 2 = 0 THEN 'medium' ELSE 'low' END AS confidence, p_type AS reasoning FROM lineitem JOIN part ON l_partkey = p_partkey"""
PRIORITIES = [("cat-0", 3), ("cat-1", 1), ("cat-2", 2), ("cat-3", 4)]
FIXES = [("hot rod", "drop", ""), ("red  plate", "remap", "cat-3"), ("old rod", "remap", "cat-9")]
CURATED = ["blue ring"]
MARKED = f"""SELECT p.expert, p.keyword, CASE WHEN o.action = 'remap' THEN o.target ELSE p.category END AS category, p.confidence, p.reasoning, c.priority,
      CASE WHEN o.action = 'drop' THEN 'dropped' WHEN c.priority IS NULL THEN 'unknown_category' WHEN p.keyword = 'blue ring' THEN 'already_curated' ELSE 'merged' END AS outcome
    FROM ({PROPOSALS}) p LEFT JOIN (VALUES ('hot rod', 'drop', ''), ('red plate', 'remap', 'cat-3'), ('old rod', 'remap', 'cat-9')) o(keyword, action, target) ON o.keyword = p.keyword
    LEFT JOIN (VALUES {values(PRIORITIES)}) c(category, priority) ON c.category = CASE WHEN o.action = 'remap' THEN o.target ELSE p.category END"""


def merged(spark, d):
    ranks = spark.createDataFrame(PRIORITIES, "category string, priority int")
    fixes = spark.createDataFrame(FIXES, "keyword string, action string, to_category string")
    curated = spark.createDataFrame([(k,) for k in CURATED], "keyword string")
    return classify.merge_lexicon(proposals(spark, d), ranks, fixes, curated)


@query(
    "x6_merge_lexicon",
    f"""WITH u AS (SELECT *, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS r FROM ({MARKED}) WHERE outcome = 'merged'),
        v AS (SELECT keyword, category, confidence, r, priority, count(*) AS n, string_agg(DISTINCT expert, ', ' ORDER BY expert) AS experts, string_agg('[' || expert || '] ' || reasoning, ' | ' ORDER BY '[' || expert || '] ' || reasoning) AS reasoning FROM u GROUP BY 1, 2, 3, 4, 5),
        p AS (SELECT v.*, row_number() OVER (PARTITION BY keyword ORDER BY n DESC, priority, category) AS place FROM v WHERE r = (SELECT max(r) FROM u WHERE u.keyword = v.keyword)),
        x AS (SELECT u.keyword, string_agg(u.expert || ':' || u.category || ':' || u.confidence, ', ' ORDER BY u.expert || ':' || u.category || ':' || u.confidence) AS rejected FROM u JOIN p ON p.keyword = u.keyword AND p.place = 1 WHERE u.category <> p.category GROUP BY 1)
        SELECT w.keyword, w.category, w.confidence, w.experts, w.reasoning, x.rejected, CASE WHEN x.rejected IS NULL THEN NULL WHEN s.n IS NULL THEN 'confidence' WHEN s.n = w.n THEN 'priority' ELSE 'majority' END AS resolved_by
        FROM p w LEFT JOIN p s ON s.keyword = w.keyword AND s.place = 2 LEFT JOIN x ON x.keyword = w.keyword WHERE w.place = 1""",
)
def _(spark, d):
    return merged(spark, d)[0]


@query("x6_merge_counts", f"SELECT outcome, count(*) AS proposals FROM ({MARKED}) GROUP BY 1")
def _(spark, d):
    return merged(spark, d)[1]


@query(
    "x7_merge_categories",
    """SELECT category, label, description, experts, 8 + row_number() OVER (ORDER BY category) AS priority FROM (
         SELECT p_name AS category, arg_min(p_brand, e) AS label, arg_min(p_type, e) AS description, string_agg(DISTINCT e, ', ' ORDER BY e) AS experts FROM (SELECT *, 'expert-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS e FROM part) WHERE p_name <> 'hot rod' GROUP BY 1)""",
)
def _(spark, d):
    existing = spark.createDataFrame([("hot rod", 3), ("other", 8), ("unspecified", 99)], "category string, priority int")
    proposed = b.read(spark, d, "part").select(
        F.concat(F.lit("expert-"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("expert"),
        F.col("p_name").alias("category"),
        F.col("p_brand").alias("label"),
        F.col("p_type").alias("description"),
    )
    return classify.merge_categories(existing, proposed, limit=2**31 - 1)  # more names than a lexicon has


# ---- names ---------------------------------------------------------------------

NAME = "^[א-ת\"''\\- ]{4,40}$"
WORDS = "len(list_filter(string_split(name, ' '), lambda x: x <> ''))"
CAND = f"""cand AS (SELECT DISTINCT name FROM (SELECT {norm_subject("subject")} AS name FROM nrows WHERE category IN ({non_topic()})) s WHERE {WORDS} BETWEEN 2 AND 4 AND regexp_matches(name, '{NAME}')
      AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(string_split(keyword, ' ')) AS w FROM lex) v WHERE length(v.w) > 1 AND list_contains(string_split(s.name, ' '), v.w))
    UNION SELECT DISTINCT {norm_subject("person_label")} AS name FROM holders WHERE len(list_filter(string_split(person_label, ' '), lambda x: x <> '')) BETWEEN 2 AND 4 AND regexp_matches(person_label, '{NAME}'))"""
WSUB = f"wsub AS (SELECT {norm_subject('subject')} AS text, category, count(*) AS w FROM nrows GROUP BY 1, 2)"
TALLY = f"""tally AS (SELECT c.name, w.category, CAST(sum(w.w) AS BIGINT) AS n FROM cand c JOIN wsub w ON {word_match("w.text", "c.name")}
      AND list_has_all(string_split(w.text, ' '), list_filter(string_split(c.name, ' '), lambda x: length(x) > 1)) GROUP BY 1, 2)"""
DECISION = f"""decided AS (SELECT name, category, n AS supporting_rows, tot AS classified_appearances, {pct("n", "tot")} AS dominance FROM (
      SELECT *, CAST(sum(n) OVER (PARTITION BY name) AS BIGINT) AS tot, row_number() OVER (PARTITION BY name ORDER BY n DESC, category) AS rn FROM tally WHERE category NOT IN ({non_topic()})) WHERE rn = 1 AND n >= 5 AND n / tot >= 0.7)"""
OPEN = f"opened AS (SELECT text, sum(w) AS w FROM wsub WHERE category IN ({non_topic()}) AND category NOT IN ('no_subject_recorded', 'unspecified') GROUP BY 1)"


def _longest(source: str) -> str:
    return f"""SELECT text, name, category, supporting_rows, w FROM (SELECT o.text, o.w, r.*, row_number() OVER (PARTITION BY o.text ORDER BY length(r.name) DESC, r.name) AS rn FROM opened o JOIN {source} r ON {word_match("o.text", "r.name")}) WHERE rn = 1"""


REFUSED = f"refused AS (SELECT name, any_value(supporting_rows) AS supporting_rows, CAST(sum(w) AS BIGINT) AS would_touch FROM ({_longest('decided')}) GROUP BY 1 HAVING sum(w) > any_value(supporting_rows) * 8)"
BASE = f"WITH {CAND}, {WSUB}, {TALLY}, {DECISION}, {OPEN}, {REFUSED}"


def candidates(spark, d):
    return inference.name_candidates(b.named_rows(spark, d), b.lexicon(spark), b.office_holders(spark, d))


@query("x8_name_candidates", f"WITH {CAND} SELECT name FROM cand")
def _(spark, d):
    return candidates(spark, d)


@query("x8_name_occurrences", f"WITH {CAND}, {WSUB}, {TALLY} SELECT * FROM tally")
def _(spark, d):
    return inference.name_occurrences(*evidence(spark, d))


def evidence(spark, d):
    return inference.name_evidence(b.named_rows(spark, d), b.lexicon(spark), b.office_holders(spark, d))


@query("x9_decide_name_field", f"{BASE} SELECT * FROM decided")
def _(spark, d):
    return inference.decide_name_field(inference.name_occurrences(*evidence(spark, d)))


@query("x10_refuse_overreach", f"{BASE} SELECT * FROM refused")
def _(spark, d):
    weighed, names, matches = evidence(spark, d)
    decided = cut_lineage(inference.decide_name_field(inference.name_occurrences(weighed, names, matches)), "decided")
    return inference.refuse_overreach(weighed, decided, matches=matches)


APPLIED = f"""{BASE}, hit AS ({_longest("(SELECT * FROM decided WHERE name NOT IN (SELECT name FROM refused))")}),
    out AS (SELECT n.subject, n.category AS old, CASE WHEN o.ok AND h.name IS NOT NULL THEN h.category WHEN n.category = 'unclassified' AND p.name IS NOT NULL THEN 'named_person_meeting' ELSE n.category END AS category,
      CASE WHEN o.ok AND h.name IS NOT NULL THEN h.name WHEN n.category = 'unclassified' AND p.name IS NOT NULL THEN {norm_subject("n.subject")} END AS matched_keyword,
      CASE WHEN (o.ok AND h.name IS NOT NULL) OR (n.category = 'unclassified' AND p.name IS NOT NULL) THEN 'low' END AS matched_confidence,
      CASE WHEN o.ok AND h.name IS NOT NULL THEN 'name_cooccurrence' WHEN n.category = 'unclassified' AND p.name IS NOT NULL THEN 'name_without_field' END AS inferred_from
    FROM nrows n JOIN (SELECT DISTINCT category, category IN ({non_topic()}) AND category NOT IN ('no_subject_recorded', 'unspecified') AS ok FROM nrows) o ON o.category = n.category
    LEFT JOIN hit h ON h.text = {norm_subject("n.subject")} LEFT JOIN (SELECT name FROM cand WHERE name NOT IN (SELECT name FROM decided)) p ON p.name = {norm_subject("n.subject")})"""


def inferred(spark, d):
    return inference.infer_names(b.named_rows(spark, d), b.lexicon(spark), b.office_holders(spark, d))


@query(
    "x11_apply_inference",
    f"{APPLIED} SELECT subject, category, matched_keyword, matched_confidence, inferred_from, count(*) AS n FROM out GROUP BY ALL",
)
def _(spark, d):
    columns = ("subject", "category", "matched_keyword", "matched_confidence", "inferred_from")
    return inferred(spark, d).groupBy(*columns).agg(F.count("*").alias("n"))


@query("x11_inference_totals", f"{APPLIED} SELECT coalesce(inferred_from, 'none') AS inferred_from, count(*) AS n FROM out GROUP BY 1")
def _(spark, d):
    return inference.inference_totals(inferred(spark, d))


# ---- extraction -----------------------------------------------------------------

FIELD_SETS = (
    ("מיקום", "צבע הרשומה", "_id", "תאריך_התחלה", "נושא"),
    ("sh`t htkhlh", "nvsh'", "sh`t syvm", "_id", "tryk htkhlh", "tryk syvm", "myqvmx"),
    ("mshttpym;myqvm;nvsh",),
    ("_full_text", "נושא הפגישה", "נושא", "שעה", "משתתפים", "mshttpym"),
)
FIELD_ANSWERS = (
    (("נושא", "subject"), ("תאריך_התחלה", "start_date"), ("מיקום", "location")),
    (("nvsh'", "subject"), ("tryk htkhlh", "start_date"), ("sh`t htkhlh", "start_time"), ("tryk syvm", "end_date"), ("sh`t syvm", "end_time"), ("myqvmx", "location")),
    (),
    (("נושא הפגישה", "subject"), ("שעה", "start_time"), ("משתתפים", "participants")),
)
UNKNOWN = ((0, "צבע הרשומה"), (2, "mshttpym;myqvm;nvsh"))


def fields(spark, d):
    p = F.col("page_id")
    chosen = F.element_at(F.array(*[F.array(*[F.lit(f) for f in s]) for s in FIELD_SETS]), (p % 4 + 1).cast("int"))
    return b.read(spark, d, "pages").select(p.alias("resource"), F.posexplode(chosen).alias("pos", "field_id"))


@query(
    "t23_map_fields",
    f"""SELECT p.page_id AS resource, v.field_id, v.target FROM pages p JOIN (VALUES {values([(i, f, t) for i, a in enumerate(FIELD_ANSWERS) for f, t in a])}) v(k, field_id, target) ON v.k = p.page_id % 4""",
)
def _(spark, d):
    return extract.map_fields(fields(spark, d))[0].select("resource", "field_id", "target")


@query(
    "t23_unknown_fields",
    f"SELECT p.page_id AS resource, v.field_id FROM pages p JOIN (VALUES {values(list(UNKNOWN))}) v(k, field_id) ON v.k = p.page_id % 4",
)
def _(spark, d):
    return extract.map_fields(fields(spark, d))[1].select("resource", "field_id")


GRID = """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
    g AS (SELECT o_custkey AS doc, r + 1 + CASE WHEN r > 4 AND o_custkey % 7 = 0 THEN 35 WHEN r > 4 THEN 3 ELSE 0 END AS row, o_orderkey AS k, o_orderpriority, o_orderdate, r FROM o),
    v AS (SELECT doc, row, r, CASE WHEN k % 8 <> 0 AND row % 9 <> 0 THEN 'talk ' || o_orderpriority END AS subject, CASE WHEN k % 8 <> 1 AND row % 9 <> 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS start_date,
      '09:30' AS start_time, CASE WHEN k % 3 = 0 AND doc % 2 = 0 THEN 'hall' END AS location FROM g WHERE doc % 11 <> 0 AND NOT (doc % 7 = 0 AND r > 4))"""


@query("t24_extract_grid", f"{GRID} SELECT doc, row, subject, start_date, start_time, CAST(NULL AS VARCHAR) AS end_time, location, CAST(NULL AS VARCHAR) AS participants FROM v WHERE subject IS NOT NULL OR start_date IS NOT NULL")
def _(spark, d):
    return extract.extract_grid(b.grid_cells(spark, d))[0]


@query(
    "t24_grid_report",
    f"""{GRID} SELECT g.doc, g.doc % 11 <> 0 AS header_found, count(v.row) FILTER (v.subject IS NOT NULL OR v.start_date IS NOT NULL) AS rows, CASE WHEN g.doc % 11 <> 0 THEN count(v.row) FILTER (v.subject IS NULL AND v.start_date IS NULL) ELSE max(g.row) + 1 END AS unparsed,
          count(*) FILTER (g.doc % 11 <> 0 AND g.doc % 7 = 0 AND g.r > 4) AS rows_after_stop
        FROM g LEFT JOIN v ON v.doc = g.doc AND v.row = g.row GROUP BY 1""",
)
def _(spark, d):
    return extract.extract_grid(b.grid_cells(spark, d))[1]


def _clk(c: str) -> str:
    return f"(lpad(CAST({c} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({c} % 60 AS VARCHAR), 2, '0'))"


PARSED = f"""WITH e AS (SELECT user_id || '/' || strftime(ts, '%Y%m%d') AS doc, event_id AS pos, k % 10 AS m, sm, least(sm + 30, 1439) AS um, event_type, ts FROM ev),
    h AS (SELECT doc, CASE WHEN count(*) % 5 <> 0 THEN strftime(any_value(ts), '%-d.%-m.%Y') END AS day FROM e GROUP BY 1),
    p AS (SELECT e.doc, e.pos, CASE WHEN m = 0 THEN 'unparsed' WHEN m = 1 THEN 'row' WHEN m = 3 THEN 'row' WHEN m = 4 THEN 'unparsed' WHEN h.day IS NOT NULL THEN 'row' ELSE 'unparsed' END AS kind,
      CASE m WHEN 1 THEN strftime(ts, '%d/%m/%Y') WHEN 3 THEN strftime(ts, '%Y-%m-%d') ELSE h.day END AS start_date, CASE m WHEN 0 THEN NULL WHEN 3 THEN NULL ELSE {_clk("sm")} END AS start_time,
      CASE WHEN m IN (1, 2) THEN {_clk("um")} END AS end_time, CASE m WHEN 0 THEN 'page footer' WHEN 1 THEN event_type WHEN 2 THEN event_type WHEN 3 THEN event_type || ' all day long' WHEN 4 THEN 'x' ELSE event_type || ' room' END AS subject
      FROM e JOIN h ON h.doc = e.doc)"""


@query("t25_extract_lines", f"{PARSED} SELECT doc, pos, start_date, start_time, end_time, subject FROM p WHERE kind = 'row'")
def _(spark, d):
    return extract.parse_lines(b.text_lines(spark, d).withColumn("line", F.regexp_replace("line", " +", " "))).filter("kind = 'row'").drop("kind")


@query(
    "t25_line_counts",
    f"""{PARSED} SELECT p.doc, count(*) FILTER (kind = 'row') AS n_rows, count(*) FILTER (kind = 'unparsed') + any_value(CASE WHEN h.day IS NULL THEN 1 ELSE 0 END) AS unparsed FROM p JOIN h ON h.doc = p.doc GROUP BY 1""",
)
def _(spark, d):
    lines = b.text_lines(spark, d).withColumn("line", F.regexp_replace("line", " +", " "))
    parsed = extract.parse_lines(lines)
    return parsed.groupBy("doc").agg(
        F.count_if(F.col("kind") == "row").alias("n_rows"), F.count_if(F.col("kind") == "unparsed").alias("unparsed")
    )


def printed_texts(spark, d):
    """The printed calendars as texts; one holds the lines of a user's day."""
    line = F.struct("pos", "line")
    lines = b.text_lines(spark, d).groupBy("doc").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return lines.select("doc", F.array_join("lines.line", "\n").alias("text"))


ORDERED = f"{PARSED}, o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS place FROM p)"


@query("t25_extract_texts", f"{ORDERED} SELECT doc, place AS pos, start_date, start_time, end_time, subject FROM o WHERE kind = 'row'")
def _(spark, d):
    return extract.extract_lines(printed_texts(spark, d))[0].withColumn("pos", F.col("pos").cast("long"))


@query(
    "t25_text_report",
    f"""{PARSED} SELECT p.doc, count(*) FILTER (kind = 'row') AS rows, count(*) FILTER (kind = 'unparsed') + any_value(CASE WHEN h.day IS NULL THEN 1 ELSE 0 END) AS unparsed FROM p JOIN h ON h.doc = p.doc GROUP BY 1""",
)
def _(spark, d):
    return extract.extract_lines(printed_texts(spark, d))[1]


@query(
    "t25_build_entries",
    f"""{ORDERED} SELECT doc, place AS pos, strftime(strptime(split_part(doc, '/', 2), '%Y%m%d'), '%Y-%m-%d') AS date, start_time, end_time, subject, false AS is_empty FROM o WHERE kind = 'row'""",
)
def _(spark, d):
    entries = extract.build_entries(extract.extract_lines(printed_texts(spark, d))[0])
    return entries.select("doc", F.col("pos").cast("long").alias("pos"), "date", "start_time", "end_time", "subject", "is_empty")


@query(
    "t25_document_lines",
    f"""SELECT doc_id AS doc, count(*) AS n_lines FROM (SELECT doc_id, {squeeze("unnest(string_split_regex(text, chr(13) || '?' || chr(10)))")} AS line FROM documents) WHERE line <> '' GROUP BY 1""",
)
def _(spark, d):
    docs = b.read(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return extract.split_lines(docs).groupBy("doc").agg(F.count("*").alias("n_lines"))


