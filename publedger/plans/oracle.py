"""The bindings of ``publedger.sources.bindings`` written as SQL, for the check statements."""

from __future__ import annotations

from publedger.sources.bindings import HEBREW, LATIN, LEXICON, hebraize_text

SP = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def heb(c: str) -> str:
    return f"translate(lower({c}), '{LATIN}', '{HEBREW}')"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SP}+', ' ', 'g'))"


def pct(a: str, b: str) -> str:
    """Percent of ``a`` in ``b`` at one decimal, null over zero."""
    return f"(floor((CAST(({a}) AS DOUBLE) / nullif(CAST(({b}) AS DOUBLE), 0)) * 1000.0 + 0.5) / 10.0)"


def share(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN {pct(a, b)} END)"


def norm_subject(c: str) -> str:
    text = f"""regexp_replace({c}, '["''״׳]', '"', 'g')"""
    text = f"regexp_replace({text}, '[\\x{{200e}}\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2066}}-\\x{{2069}}]', '', 'g')"
    text = f"regexp_replace({text}, '(^|[^A-Za-z0-9_])(?:FW|RE|Fwd){SP}*:', '\\1 ', 'gi')"
    wrap = r"_x000D_|הזמנה עודכנה|הזמנה מבוטלת|הזמנה:|Canceled\s*:?|Cancelled\s*:?"
    text = f"regexp_replace({text}, '(?:{wrap})', ' ', 'gi')"
    return squeeze(text)


def bare(c: str) -> str:
    return f"lower({squeeze(f'''regexp_replace({norm_subject(c)}, '["''.,:;!?()\\-–—*]', ' ', 'g')''')})"


def norm_entity(c: str) -> str:
    text = f"""regexp_replace({c}, 'בע["״'']?מ', ' ', 'g')"""
    text = f"regexp_replace({text}, '\\(.*?\\)', ' ', 'g')"
    return squeeze(f"""regexp_replace({text}, '["''״׳.,\\-–—]', ' ', 'g')""")


def norm_name(c: str) -> str:
    return f"""trim(regexp_replace(regexp_replace({c}, '{SP}+', ' ', 'g'), '["''״׳]', '', 'g'))"""


def word_match(h: str, n: str) -> str:
    """The word test of the library as one SQL condition."""
    right = f"CASE WHEN regexp_matches({n}, '{SP}[ובלכמ]$') THEN '\\E' ELSE '\\E([^א-ת]|$)' END"
    pattern = f"'(^|[^א-ת])[והבלכמש]{{0,3}}\\Q' || {n} || {right}"
    return f"(contains({h}, {n}) AND regexp_matches({h}, {pattern}))"


def matches_query(columns: list[str], query: str) -> str:
    """All words of ``query`` in the joined columns, for plain ASCII queries."""
    joined = f"lower({squeeze(' || '.join(columns))})"
    return " AND ".join(f"contains({joined}, '{t}')" for t in query.lower().split())


def group_case(c: str) -> str:
    from publedger.operators.calendar import CATEGORY_GROUPS

    whens = []
    for group, categories in CATEGORY_GROUPS.items():
        listed = ", ".join(f"'{x}'" for x in categories)
        whens.append(f"WHEN {c} IN ({listed}) THEN '{group}'")
    return "CASE " + " ".join(whens) + " END"


def non_meeting() -> str:
    from publedger.functions.text import NON_MEETING_CATEGORIES

    return ", ".join(f"'{c}'" for c in NON_MEETING_CATEGORIES)


def non_topic() -> str:
    from publedger.operators.classify import NON_TOPIC_CATEGORIES

    return ", ".join(f"'{c}'" for c in NON_TOPIC_CATEGORIES)


def values(rows: list[tuple]) -> str:
    def lit(v):
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


def gov_url(c: str) -> str:
    for a, b in (
        ("example.com", "knesset.gov.il"),
        ("example.net", "data.gov.il"),
        ("example.org", "obudget.org"),
        ("/en/7", "/News/PressReleases/7"),
        ("/en/8", "/Budget2024-Health/8"),
    ):
        c = f"replace({c}, '{a}', '{b}')"
    return c


def decode(c: str) -> str:
    for a, b in (("&amp;", "&"), ("&quot;", '"'), ("&#0?39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        c = f"regexp_replace({c}, '{a}', '{b}', 'g')"
    return c


def js_trim(c: str) -> str:
    return f"regexp_replace({c}, '^{SP}+|{SP}+$', '', 'g')"


def html_title(c: str) -> str:
    pattern = "(?is)<title[^>]*>(.*?)</title>"
    text = js_trim(f"regexp_extract({c}, '{pattern}', 1)")
    return f"(CASE WHEN regexp_matches({c}, '{pattern}') THEN substr({decode(text)}, 1, 200) END)"


CLOCK = "lpad(CAST({m} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({m} % 60 AS VARCHAR), 2, '0')"


def clock(m: str) -> str:
    return "(" + CLOCK.format(m=f"({m})") + ")"


def clock_min(c: str) -> str:
    return f"(CAST(substr({c}, 1, 2) AS INT) * 60 + CAST(substr({c}, 4, 2) AS INT))"


COMMON: dict[str, str] = {
    "money": """
        SELECT l.*, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
               CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax,
               CAST(year(l_shipdate) AS BIGINT) AS yr
        FROM lineitem l""",
    "leaf": """
        SELECT s_nationkey, p_brand, p_type, yr, CAST(sum(cents) AS BIGINT) AS original,
               CAST(sum(cents * (100 - disc) * (100 + tax) // 10000) AS BIGINT) AS updated,
               CAST(sum(CASE WHEN l_linestatus = 'F' THEN cents END) AS BIGINT) AS executed
        FROM money JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "nodes": """
        SELECT s_nationkey, yr, CAST(1 AS BIGINT) AS level, lpad(CAST(s_nationkey + 1 AS VARCHAR), 4, '0') AS code, CAST(NULL AS VARCHAR) AS parent_code,
               'Section ' || s_nationkey AS title, original, updated, executed FROM leaf
        UNION ALL
        SELECT s_nationkey, yr, 2, lpad(CAST(s_nationkey + 1 AS VARCHAR), 4, '0') || lpad(substr(p_brand, 7), 2, '0'),
               lpad(CAST(s_nationkey + 1 AS VARCHAR), 4, '0'), p_brand, original, updated, executed FROM leaf
        UNION ALL
        SELECT s_nationkey, yr, 3, lpad(CAST(s_nationkey + 1 AS VARCHAR), 4, '0') || lpad(substr(p_brand, 7), 2, '0') || '-' || p_type,
               lpad(CAST(s_nationkey + 1 AS VARCHAR), 4, '0') || lpad(substr(p_brand, 7), 2, '0'), p_brand || ' ' || p_type,
               original, updated, executed FROM leaf""",
    "items": """
        SELECT 'budget-S' || s_nationkey || '-' || yr || '-' || code AS item_id, 'S' || s_nationkey AS section_id, yr AS fiscal_year,
               code, parent_code, title, level, (level = 3 AND s_nationkey <> 24) AS is_leaf,
               CASE WHEN level = 3 AND regexp_matches(code, '07-SMALL$') THEN NULL ELSE CAST(sum(original) AS BIGINT) END AS original,
               CAST(sum(updated) AS BIGINT) AS updated,
               CASE WHEN yr <= 2000 THEN CAST(sum(executed) AS BIGINT) END AS actual,
               CASE WHEN yr > 2000 THEN CAST(sum(executed) AS BIGINT) END AS estimated,
               CASE WHEN yr > 2000 THEN 'estimate' WHEN yr <= 1996 THEN 'final' ELSE 'partial' END AS status
        FROM nodes GROUP BY s_nationkey, yr, level, code, parent_code, title""",
    "flags": "SELECT section_id, fiscal_year, bool_or(is_leaf) AS has_leaf, min(level) AS top FROM items GROUP BY 1, 2",
    "scope": """
        SELECT i.* FROM items i JOIN flags f ON i.section_id = f.section_id AND i.fiscal_year = f.fiscal_year
        WHERE CASE WHEN f.has_leaf THEN i.is_leaf ELSE i.level = f.top END""",
    "totals": """
        SELECT s.section_id, s.fiscal_year, CASE WHEN any_value(f.has_leaf) THEN 'leaf' ELSE CAST(any_value(f.top) AS VARCHAR) END AS level_used,
               CAST(sum(original) AS BIGINT) AS original, CAST(sum(updated) AS BIGINT) AS updated,
               CAST(sum(actual) AS BIGINT) AS actual, CAST(sum(estimated) AS BIGINT) AS estimated,
               count(original) AS original_records, count(updated) AS updated_records, count(actual) AS actual_records, count(estimated) AS estimated_records
        FROM scope s JOIN flags f ON s.section_id = f.section_id AND s.fiscal_year = f.fiscal_year GROUP BY 1, 2""",
    "yearly": """
        SELECT sp.section_id, sp.y AS fiscal_year, t.original, t.updated, coalesce(t.actual, t.estimated) AS execution,
               coalesce(t.actual IS NULL AND t.estimated IS NOT NULL, false) AS execution_is_estimate,
               CASE WHEN coalesce(t.actual, t.estimated) IS NULL THEN 'unavailable' WHEN c.est > 0 THEN 'estimate'
                    WHEN c.fin = c.n THEN 'final' ELSE 'partial' END AS execution_status,
               coalesce(c.n, 0) AS record_count
        FROM (SELECT section_id, y FROM (SELECT DISTINCT section_id FROM items), (SELECT unnest(range(1995, 2004)) AS y)) sp
        LEFT JOIN totals t ON t.section_id = sp.section_id AND t.fiscal_year = sp.y
        LEFT JOIN (SELECT section_id, fiscal_year, count(*) AS n, count(*) FILTER (status = 'estimate') AS est,
                          count(*) FILTER (status = 'final') AS fin FROM items GROUP BY 1, 2) c
          ON c.section_id = sp.section_id AND c.fiscal_year = sp.y""",
    "regs": """
        SELECT 'B' || substr(p_brand, 7) AS section_id, CAST(l_partkey AS VARCHAR) AS code, p_name AS title, yr AS year, p_type AS econ2,
               CAST(sum(CASE WHEN l_returnflag = 'A' THEN cents END) AS BIGINT) AS allocated,
               CAST(sum(CASE WHEN l_returnflag <> 'R' THEN cents ELSE 0 END) AS BIGINT) AS revised,
               CAST(sum(CASE WHEN l_linestatus = 'F' THEN cents ELSE 0 END) AS BIGINT) AS executed
        FROM money JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "usage_lines": """
        SELECT 'S' || s_nationkey AS section_id, yr AS fiscal_year, CASE WHEN l_linenumber = 7 THEN '2' ELSE '1' END AS kind,
               CASE WHEN l_quantity = 50 THEN 3 ELSE 4 END AS depth, (l_quantity = 1) AS is_proposal, l_returnflag AS econ1,
               CASE WHEN tax = 8 AND l_returnflag = 'N' THEN NULL ELSE l_linestatus END AS econ2, cents AS allocated,
               (CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN -1 ELSE 1 END) * (cents * (100 - disc) // 100) AS revised,
               CASE WHEN l_linestatus = 'F' THEN cents END AS executed
        FROM money JOIN supplier ON l_suppkey = s_suppkey""",
    "usage": """
        SELECT section_id, fiscal_year, econ1, coalesce(econ2, 'X') AS econ2, CAST(sum(allocated) AS BIGINT) AS allocated,
               CAST(sum(revised) AS BIGINT) AS revised, CAST(sum(executed) AS BIGINT) AS executed, count(*) AS line_count
        FROM usage_lines GROUP BY 1, 2, 3, 4""",
    "themes": "SELECT DISTINCT 'T-' || p_type AS theme_id FROM part UNION ALL SELECT 'T-UNUSED'",
    "assigned": """
        SELECT DISTINCT section_id, code, CASE WHEN starts_with(title, 'Brand#8 ') THEN title || '*' ELSE title END AS title,
               'T-' || string_split(title, ' ')[-1] AS theme_id
        FROM items WHERE level = 3 AND NOT starts_with(title, 'Brand#9 ')""",
    "contracts": """
        SELECT 'S' || s_nationkey AS section_id,
               lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || cents AS seq,
               s_name AS supplier, CAST(s_suppkey AS VARCHAR) AS entity_id, 'company' AS entity_kind, p_name AS purpose,
               CASE WHEN l_quantity <> 13 THEN cents END AS volume, cents * (100 - disc) // 100 AS executed, CAST(o_orderdate AS DATE) AS order_date,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'פטור ממכרז - דחוף' WHEN '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS method,
               lpad(CAST(s_nationkey + 1 AS VARCHAR), 4, '0') || lpad(substr(p_brand, 7), 2, '0') || '-' || p_type AS budget_code, p_type AS budget_title
        FROM money JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
    "capped": """
        SELECT c.*, c.volume IS NULL OR c.volume <= coalesce(p.cap, s.cap, 1) AS within_cap
        FROM contracts c
        LEFT JOIN (SELECT section_id, code, greatest(1, CAST(floor(greatest(max(updated), 0) * 0.1 + 0.5) AS BIGINT)) AS cap FROM items WHERE level = 2 GROUP BY 1, 2) p
          ON p.section_id = c.section_id AND p.code = substr(c.budget_code, 1, 6)
        LEFT JOIN (SELECT section_id, greatest(1, CAST(floor(greatest(max(updated), 0) * 0.1 + 0.5) AS BIGINT)) AS cap FROM items WHERE level = 1 GROUP BY 1) s
          ON s.section_id = c.section_id""",
    "sup": """
        SELECT section_id, supplier, entity_id, entity_kind, count(*) AS contract_count, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(executed) AS BIGINT) AS executed,
               row_number() OVER (PARTITION BY section_id ORDER BY sum(volume) DESC NULLS LAST, supplier, entity_id) AS position
        FROM contracts GROUP BY 1, 2, 3, 4""",
    "ctotals": f"""
        SELECT t.section_id, t.contract_count, t.total_volume, {share("coalesce(l.lead, 0)", "t.total_volume")} AS lead_share_percent
        FROM (SELECT section_id, count(*) AS contract_count, coalesce(CAST(sum(volume) AS BIGINT), 0) AS total_volume FROM contracts GROUP BY 1) t
        LEFT JOIN (SELECT section_id, sum(volume) AS lead FROM sup WHERE position <= 5 GROUP BY 1) l ON l.section_id = t.section_id""",
    "mix": f"""
        SELECT section_id, bucket, contract_count, total_volume, {share("total_volume", "sum(total_volume) OVER (PARTITION BY section_id)")} AS share_percent FROM (
          SELECT section_id, CASE WHEN method IS NULL OR method IN ('ILS', 'אחר') THEN 'לא דווח / אחר' WHEN contains(method, 'פטור') THEN 'פטור ממכרז' ELSE method END AS bucket,
                 CAST(sum(n) AS BIGINT) AS contract_count, CAST(sum(coalesce(v, 0)) AS BIGINT) AS total_volume
          FROM (SELECT section_id, method, count(*) AS n, sum(volume) AS v FROM contracts GROUP BY 1, 2) GROUP BY 1, 2)""",
    "exempt": f"""
        SELECT section_id, {share("sum(CASE WHEN bucket = 'פטור ממכרז' THEN total_volume ELSE 0 END)", "sum(total_volume)")} AS exempt_volume_percent,
               {share("sum(CASE WHEN bucket = 'פטור ממכרז' THEN contract_count ELSE 0 END)", "sum(contract_count)")} AS exempt_count_percent
        FROM mix GROUP BY 1""",
    "hhi": """
        SELECT t.section_id, CAST(floor(sum((CAST(s.volume AS DOUBLE) / t.total_volume * 100.0) * (CAST(s.volume AS DOUBLE) / t.total_volume * 100.0)) + 0.5) AS BIGINT) AS hhi
        FROM ctotals t LEFT JOIN sup s ON s.section_id = t.section_id AND s.volume > 0 AND t.total_volume > 0 GROUP BY 1""",
    "procurement": """
        SELECT t.*, h.hhi, e.exempt_volume_percent, e.exempt_count_percent,
          floor((coalesce(least(100.0, h.hhi / 100.0) * 0.4, 0.0) + coalesce(t.lead_share_percent * 0.35, 0.0) + coalesce(e.exempt_volume_percent * 0.25, 0.0))
            / nullif((CASE WHEN h.hhi IS NOT NULL THEN 0.4 ELSE 0.0 END) + (CASE WHEN t.lead_share_percent IS NOT NULL THEN 0.35 ELSE 0.0 END)
                 + (CASE WHEN e.exempt_volume_percent IS NOT NULL THEN 0.25 ELSE 0.0 END), 0) * 10.0 + 0.5) / 10.0 AS concentration_score,
          CAST((h.hhi IS NOT NULL)::INT + (t.lead_share_percent IS NOT NULL)::INT + (e.exempt_volume_percent IS NOT NULL)::INT AS BIGINT) AS measured_parts
        FROM ctotals t LEFT JOIN hhi h ON h.section_id = t.section_id LEFT JOIN exempt e ON e.section_id = t.section_id""",
    "payments": """
        SELECT 'S' || c_nationkey AS section_id, c_name AS recipient, CAST(c_custkey AS VARCHAR) AS entity_id, CAST(round(o_totalprice * 100) AS BIGINT) AS approved,
               CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS paid, c_mktsegment AS title
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "all_recipients": """
        SELECT section_id, recipient, CAST(count(*) AS BIGINT) AS request_count, CAST(sum(approved) AS BIGINT) AS approved, CAST(sum(paid) AS BIGINT) AS paid
        FROM payments GROUP BY section_id, recipient, entity_id""",
    "recipients": """
        SELECT * FROM (SELECT section_id, recipient, entity_id, count(*) AS request_count, CAST(sum(approved) AS BIGINT) AS approved, CAST(sum(paid) AS BIGINT) AS paid,
               max(title) AS example_title, row_number() OVER (PARTITION BY section_id ORDER BY sum(paid) DESC NULLS LAST, recipient, entity_id) AS position
        FROM payments GROUP BY 1, 2, 3) WHERE position <= 15""",
    "requests": """
        SELECT 'S' || c_nationkey AS section_id, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS req_title, o_orderstatus AS change_type,
               CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CAST(round(o_totalprice * 100) AS BIGINT)
                    ELSE -CAST(round(o_totalprice * 100) AS BIGINT) END AS net,
               lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS transaction_id, '  change ' || chr(10) || ' of ' || o_orderpriority || chr(9) || ' for ' || c_name AS explanation
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "ev": """
        SELECT e.*, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(hour(ts) * 60 + minute(ts) AS BIGINT) AS sm,
               least(CAST(hour(ts) * 60 + minute(ts) AS BIGINT) + CAST(floor(value * 4) AS BIGINT), 1439) AS em FROM events e""",
    "drows": f"""
        SELECT lpad(CAST(event_id AS VARCHAR), 10, '0') AS entry_id, 'ds-' || user_id AS dataset_id,
               CASE WHEN k = 33 THEN 'ללא נושא רשום' WHEN k = 34 THEN 'פגישה'
                    ELSE event_type || ' with ' || coalesce(CASE WHEN k < 50 THEN s_name ELSE c_name END, 'staff') || ' (HQ)' END AS subject,
               CASE WHEN k <> 99 THEN CAST(ts AS DATE) END AS date,
               CASE WHEN k % 10 = 9 THEN NULL WHEN k % 10 = 7 THEN '00:00' ELSE {clock("sm")} END AS start_time,
               CASE WHEN k % 10 <> 8 THEN {clock("em")} END AS end_time,
               CASE WHEN k % 5 <> 0 THEN 'room ' || (k % 7) END AS location, CASE WHEN k % 3 <> 0 THEN 'p' || (user_id % 11) END AS participants,
               ['datastore', 'spreadsheet', 'pdf_text', 'pdf_ocr'][k % 4 + 1] AS method,
               CASE WHEN k % 25 = 3 THEN 'meeting_without_subject' WHEN k = 4 THEN NULL WHEN k % 25 = 5 THEN 'no_subject_recorded' WHEN k % 25 = 6 THEN 'travel_logistics'
                    WHEN k % 25 = 7 THEN 'holidays_calendar' WHEN k = 8 THEN 'mystery' WHEN event_type = 'error' THEN 'unspecified' WHEN event_type = 'click' THEN 'private_sector'
                    WHEN event_type = 'purchase' THEN 'media_pr' WHEN event_type = 'view' THEN 'unclassified' ELSE 'government_cabinet' END AS category,
               event_id AS seq, user_id
        FROM ev LEFT JOIN supplier ON s_suppkey = k LEFT JOIN customer ON c_custkey = k""",
    "pubs": """
        SELECT 'ds-' || user_id AS dataset_id,
               CASE WHEN user_id % 17 = 0 THEN 'יומן שר א ויומן מנכ"ל ב, לשנת 2024' ELSE 'יומן שר א, פלוני, לשנת 2024 (רבעון ראשון)' END AS title, (user_id % 17 = 0) AS shared,
               CASE WHEN user_id % 10 <> 9 THEN 'S' || (user_id % 10) END AS section_id, CASE WHEN user_id % 13 <> 12 THEN 'Person ' || user_id END AS person_label,
               ['minister', 'deputy_minister', 'director_general', 'other_senior'][user_id % 4 + 1] AS person_role, 'role ' || (user_id % 4) AS role_label,
               CASE WHEN user_id % 7 <> 0 THEN '2024 (רבעון ראשון)' END AS period_label,
               CASE WHEN user_id % 23 = 1 THEN 0 ELSE count(*) END AS readable_entries, CASE WHEN user_id % 5 = 0 THEN 2 ELSE 0 END AS unreadable
        FROM events WHERE user_id % 50 <> 49 GROUP BY user_id""",
    "diary": """
        SELECT r.entry_id, r.dataset_id, r.subject, r.date, r.start_time, r.end_time, r.location, r.participants, r.method, coalesce(r.category, 'unspecified') AS category, r.seq,
               p.section_id, p.person_label, p.person_role, p.role_label, p.title, p.shared,
               coalesce(p.section_id, 'unattributed') || '|' || p.role_label || '|' || coalesce(p.person_label, '—') AS person_key
        FROM drows r JOIN pubs p ON p.dataset_id = r.dataset_id""",
    "clocked": f"""
        SELECT d.*, u.usable, CASE WHEN u.usable THEN {clock_min("d.start_time")} END AS s, CASE WHEN u.usable THEN {clock_min("d.end_time")} END AS e
        FROM diary d JOIN (SELECT entry_id, (start_time IS NOT NULL AND start_time IS DISTINCT FROM end_time AND start_time <> '00:00') AS usable FROM diary) u
          ON u.entry_id = d.entry_id""",
    "days": f"""
        SELECT person_key, date, count(*) AS n_rows, count(*) FILTER (category NOT IN ({non_meeting()})) AS meetings, count(s) AS timed,
               max(coalesce(e, s)) - min(s) AS span, min(seq) AS first_seq FROM clocked WHERE date IS NOT NULL GROUP BY 1, 2""",
    "pairs": """
        SELECT a.person_key, count(*) AS n FROM clocked a JOIN clocked b ON a.person_key = b.person_key AND a.date = b.date AND a.entry_id < b.entry_id
          AND a.s < b.e AND b.s < a.e WHERE a.e > a.s AND b.e > b.s GROUP BY 1""",
    "prof": f"""
        SELECT c.person_key, arg_min(section_id, seq) AS section_id_x, any_value(section_id) AS section_id, any_value(role_label) AS role_label, arg_min(person_role, seq) AS person_role,
               CASE WHEN arg_min(shared, seq) THEN NULL ELSE any_value(person_label) END AS person_label, arg_min(shared, seq) AS covers_multiple,
               count(*) AS entry_count, count(date) AS dated_count, count(start_time) AS timed_count, count(*) FILTER (usable) AS usable_count,
               min(date) AS first_date, max(date) AS last_date, count(DISTINCT dataset_id) AS dataset_count,
               count(*) FILTER (category = 'unspecified') AS unspecified_count, count(*) FILTER (category = 'no_subject_recorded') AS no_subject_count,
               count(*) FILTER (category = 'unclassified') AS unclassified_count, count(*) FILTER (category = 'private_sector') AS private_sector_count,
               count(*) FILTER (category = 'media_pr') AS media_count,
               count(*) FILTER (dayofweek(date) IN (5, 6) AND category NOT IN ({non_meeting()})) AS weekend_count,
               count(*) FILTER (dayofweek(date) = 5 AND category NOT IN ({non_meeting()})) AS friday_count,
               count(*) FILTER (dayofweek(date) = 6 AND category NOT IN ({non_meeting()})) AS saturday_count,
               count(*) FILTER (dayofweek(date) IN (5, 6) AND category IN ({non_meeting()})) AS weekend_other_count,
               count(*) FILTER (date IS NOT NULL AND (s // 60 >= 22 OR s // 60 <= 5)) AS late_night_count,
               count(*) FILTER (date IS NOT NULL AND e - s >= 240) AS long_meeting_count,
               {share("count(*) FILTER (category = 'unspecified')", "count(*)")} AS opacity_percent,
               {share("count(*) FILTER (category = 'no_subject_recorded')", "count(*)")} AS no_subject_percent,
               {share("count(*) FILTER (category = 'unclassified')", "count(*)")} AS unclassified_percent
        FROM clocked c GROUP BY c.person_key""",
    "oq": "SELECT DISTINCT 'C' || o_custkey AS person_key, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS q FROM orders",
    "oqp": """
        SELECT 'C' || c_custkey AS person_key, unnest(CASE c_custkey % 4 WHEN 0 THEN [1997 * 4 + 1, 1997 * 4 + 2] WHEN 1 THEN [1998 * 4, 1998 * 4 + 1, 1998 * 4 + 2, 1998 * 4 + 3] ELSE [] END) AS q
        FROM customer""",
    "gaps": """
        SELECT s.person_key, CAST(s.q // 4 AS VARCHAR) || '-Q' || (s.q % 4 + 1) AS quarter, p.person_key IS NOT NULL AS unread
        FROM (SELECT person_key, unnest(range(min(q), max(q) + 1)) AS q FROM oq GROUP BY 1) s
        LEFT JOIN oq ON oq.person_key = s.person_key AND oq.q = s.q
        LEFT JOIN oqp p ON p.person_key = s.person_key AND p.q = s.q
        WHERE oq.q IS NULL""",
    "tenures": """
        SELECT 'T' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS tenure_id, 'Holder ' || (c_custkey % 400) AS person_name, 'role ' || (c_custkey % 3) AS role, 'S' || c_nationkey AS section_id,
               CASE WHEN c_custkey % 97 <> 0 THEN CAST(min(o_orderdate) AS DATE) END AS start_date, CASE WHEN c_acctbal >= 0 THEN CAST(max(o_orderdate) AS DATE) END AS end_date
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey, c_acctbal""",
    "wins": """
        SELECT section_id, make_date(y, 1, 1) AS window_start, make_date(y, 12, 31) AS window_end
        FROM (SELECT DISTINCT section_id FROM tenures), (SELECT unnest(range(1995, 2002)) AS y)""",
    "segs": f"""
        SELECT *, {share("days", "window_days")} AS share_percent FROM (
          SELECT t.tenure_id, t.person_name, w.*, greatest(t.start_date, w.window_start) AS from_date, least(coalesce(t.end_date, w.window_end), w.window_end) AS to_date,
                 date_diff('day', greatest(t.start_date, w.window_start), least(coalesce(t.end_date, w.window_end), w.window_end)) + 1 AS days,
                 date_diff('day', w.window_start, w.window_end) + 1 AS window_days
          FROM tenures t JOIN wins w ON w.section_id = t.section_id
          WHERE t.start_date IS NOT NULL AND t.start_date <= w.window_end AND coalesce(t.end_date, w.window_end) >= w.window_start)""",
    "acts": """
        SELECT 'act-' || doc_id AS id, 'S' || (doc_id % 10) AS section_id, CASE WHEN doc_id % 29 <> 0 THEN DATE '2022-01-01' + CAST(doc_id * 7 % 1400 AS INT) END AS date,
               ['decisions', 'publications', 'bids'][doc_id % 3 + 1] AS feed, string_split(text, chr(10))[1] AS title, text AS summary,
               ['policy_document', 'government_page', 'other_official'][doc_id % 3 + 1] AS source_type, 'https://www.' || source || '.example.org/' || (n_chars % 50) AS url,
               CASE WHEN n_chars > 2000 THEN [lang, 'long'] ELSE [lang] END AS topics, CASE WHEN doc_id % 2 = 0 THEN ['P' || (doc_id % 7)] ELSE CAST([] AS VARCHAR[]) END AS people,
               CASE WHEN doc_id % 3 = 0 THEN ['O' || (doc_id % 5)] ELSE CAST([] AS VARCHAR[]) END AS organizations, 'note ' || doc_id AS notes, doc_id AS seq
        FROM documents""",
    "srcs": f"""
        SELECT page_id AS seq, {gov_url("url")} AS url, {html_title("html")} AS title,
               CASE page_id % 3 WHEN 0 THEN 'retrieved' WHEN 1 THEN 'not_retrieved_error' ELSE 'not_retrieved_egress_blocked' END AS retrieval_status FROM pages""",
    "cat": """
        SELECT *, 'pub-' || (seq % 6) AS publisher, ['budget_book', 'press_release', 'other'][seq % 3 + 1] AS source_type, 'label' AS source_type_label,
               CASE seq % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['S' || (seq % 10)] ELSE ['S' || (seq % 10), 'S' || ((seq + 3) % 10)] END AS section_ids,
               [CAST(seq % 4 + 2023 AS INT)] AS fiscal_years FROM srcs""",
    "att": f"""
        SELECT page_id AS seq, CASE WHEN page_id % 5 = 0 THEN 'https://web.archive.org/web/2024id_/https://odata.org.il/dataset/' || (page_id % 40) || '/resource/' || (page_id % 3)
                 ELSE {gov_url("url")} END AS url, CASE WHEN page_id % 5 = 0 THEN 'collect: internet archive snapshot' ELSE 'retrieve page' END AS purpose,
               ['ok', 'http_error', 'blocked', 'network_error', 'ok'][page_id % 5 + 1] AS outcome,
               CASE WHEN page_id % 5 = 1 THEN CASE WHEN page_id % 2 = 0 THEN 403 ELSE 304 END WHEN page_id % 5 = 0 THEN 200 END AS http_status,
               length(html) AS bytes, '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS attempted_at FROM pages""",
    "lex": "SELECT * FROM (VALUES "
    + values([(i, hebraize_text(k), c, p, conf) for i, (k, c, p, conf) in enumerate(LEXICON)])
    + ") t(seq, keyword, category, priority, confidence)",
    "slines": f"""
        SELECT doc_id || '-' || (i - 1) AS entry_id, parts[i] AS subject FROM (
          SELECT doc_id, string_split({heb("text")}, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)""",
    "nrows": f"""
        SELECT CASE WHEN l_linenumber <= 2 THEN name WHEN ln % 4 = 0 AND l_linenumber > 3 AND l_quantity <> 2 THEN '{hebraize_text("meet ")} 7' WHEN l_linenumber = 3 THEN '{hebraize_text("call ")}ל' || name WHEN l_linenumber = 4 THEN name || '{hebraize_text(" and team")}'
                 ELSE '{hebraize_text("meet ")}' || name || ' 7' END AS subject,
               CASE WHEN l_linenumber <= 2 THEN 'unclassified' WHEN l_linenumber = 3 THEN 'meeting_without_subject' WHEN l_quantity > 40 THEN 'ceremonies'
                 WHEN ln % 5 = 0 AND l_quantity > 15 THEN 'media_pr' ELSE ['diplomacy', 'budget_finance', 'local_government'][ln % 3 + 1] END AS category
        FROM lineitem JOIN (SELECT p_partkey, {heb("p_name")} AS name, length(p_name) AS ln FROM part) ON p_partkey = l_partkey""",
    "holders": f"""
        SELECT '{hebraize_text("head nation ")}' || translate(CAST(n_nationkey AS VARCHAR), '0123456789', 'אבגדהוזחטי') AS person_label FROM nation""",
}
