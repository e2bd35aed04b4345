"""Queries over contracts, suppliers, support payments and transfers."""

from __future__ import annotations

from publedger.operators import contracts as c
from publedger.operators import matching
from publedger.plans.oracle import squeeze
from publedger.plans.registry import query
from publedger.sources import bindings as b

FACTOR = 0.10  # the reference value of 1.5 sets nothing aside on these tables


@query("a11_split_by_cap", "SELECT seq, section_id, volume, within_cap FROM capped")
def _(spark, d):
    flagged = c.flag_by_cap(b.contracts(spark, d), b.budget_items(spark, d), FACTOR)
    return flagged.select("seq", "section_id", "volume", "within_cap")


@query(
    "a11_contract_caps",
    """SELECT section_id, code, greatest(1, CAST(floor(greatest(max(updated), 0) * 1.5 + 0.5) AS BIGINT)) AS programme_cap FROM items WHERE level = 2 GROUP BY 1, 2""",
)
def _(spark, d):
    return c.contract_caps(b.budget_items(spark, d))[0]


@query("a12_leading_suppliers", "SELECT * FROM sup WHERE position <= 15")
def _(spark, d):
    return c.top_suppliers(b.contracts(spark, d))


@query("a13_contract_totals", "SELECT * FROM ctotals")
def _(spark, d):
    return c.contract_totals(b.contracts(spark, d))


@query("a14_method_mix", "SELECT * FROM mix")
def _(spark, d):
    return c.method_mix(b.contracts(spark, d))


@query(
    "a15_notable_contracts",
    """SELECT * FROM (SELECT section_id, seq, supplier, volume, order_date::VARCHAR AS order_date,
         CASE WHEN method IS NULL THEN 'לא דווח / אחר' WHEN contains(method, 'פטור') THEN 'פטור ממכרז' ELSE method END AS method,
         row_number() OVER (PARTITION BY section_id ORDER BY volume DESC, seq) AS position FROM contracts WHERE volume IS NOT NULL) WHERE position <= 10""",
)
def _(spark, d):
    top = c.notable_contracts(b.contracts(spark, d))
    return top.select("section_id", "seq", "supplier", "volume", "order_date", "method", "position")


@query(
    "a16_excluded_contracts",
    """SELECT section_id, count(*) FILTER (NOT within_cap) AS excluded_count, CAST(sum(CASE WHEN within_cap THEN 0 ELSE coalesce(volume, 0) END) AS BIGINT) AS excluded_volume,
         sum(CASE WHEN within_cap THEN 0 ELSE coalesce(volume, 0) END) > sum(CASE WHEN within_cap THEN coalesce(volume, 0) ELSE 0 END) AS data_suspect FROM capped GROUP BY 1""",
)
def _(spark, d):
    return c.excluded_contracts(b.contracts(spark, d), b.budget_items(spark, d), FACTOR)


@query(
    "a16_excluded_examples",
    """SELECT * FROM (SELECT section_id, seq, supplier, purpose, volume, budget_code, row_number() OVER (PARTITION BY section_id ORDER BY volume DESC NULLS LAST, seq) AS position FROM capped WHERE NOT within_cap) WHERE position <= 6""",
)
def _(spark, d):
    rows = c.excluded_examples(b.contracts(spark, d), b.budget_items(spark, d), FACTOR)
    return rows.select("section_id", "seq", "supplier", "purpose", "volume", "budget_code", "position")


@query("a17_support_recipients", "SELECT * FROM recipients")
def _(spark, d):
    return c.support_recipients(b.payments(spark, d))


@query(
    "a18_largest_transfers",
    f"""SELECT section_id, year, transaction_id, net, req_title, change_type, substr({squeeze("explanation")}, 1, 600) AS explanation, position FROM (
          SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY abs(net) DESC NULLS LAST, transaction_id) AS position FROM requests) WHERE position <= 8""",
)
def _(spark, d):
    top = c.top_transfers(b.requests(spark, d))
    return top.select("section_id", "year", "transaction_id", "net", "req_title", "change_type", "explanation", "position")


@query("a19_supplier_hhi", "SELECT * FROM hhi")
def _(spark, d):
    rows = b.contracts(spark, d)
    cube = c.contract_cube(rows)
    return c.supplier_hhi(c.supplier_totals(rows, cube), c.contract_totals(rows, cube=cube))


@query(
    "a19_supplier_hhi_limited",
    """SELECT t.section_id, CAST(floor(sum((CAST(s.volume AS DOUBLE) / t.total_volume * 100.0) * (CAST(s.volume AS DOUBLE) / t.total_volume * 100.0)) + 0.5) AS BIGINT) AS hhi
       FROM ctotals t LEFT JOIN sup s ON s.section_id = t.section_id AND s.volume > 0 AND s.position <= 2 GROUP BY 1""",
)
def _(spark, d):
    rows = b.contracts(spark, d)
    return c.supplier_hhi(c.supplier_totals(rows), c.contract_totals(rows), n=2)


@query("a20_exempt_shares", "SELECT * FROM exempt")
def _(spark, d):
    return c.exempt_shares(c.method_mix(b.contracts(spark, d)))


@query("a21_procurement_index", "SELECT * FROM procurement")
def _(spark, d):
    return c.procurement_index(b.contracts(spark, d))


APPEAR = """SELECT supplier AS name_id, section_id, 'supplier' AS kind, contract_count AS n, volume, executed FROM sup
            UNION ALL SELECT recipient, section_id, 'support', request_count, approved, paid FROM all_recipients"""


@query("a22_entity_appearances", APPEAR)
def _(spark, d):
    return c.entity_appearances(c.supplier_totals(b.contracts(spark, d)), c.recipient_totals(b.payments(spark, d)))


@query(
    "a22_entity_profile",
    f"""WITH pool AS (SELECT section_id, supplier AS name, volume AS amount, 'supplier' AS kind FROM sup UNION ALL SELECT section_id, recipient, approved, 'support' FROM all_recipients),
        m AS (SELECT d.section_id, d.date, p.name FROM diary d JOIN pool p ON p.section_id = d.section_id AND contains(replace(d.subject, '(HQ)', ''), p.name)),
        c AS (SELECT section_id, supplier, order_date, seq FROM contracts),
        t AS (SELECT m.section_id, m.name, m.date, min(abs(date_diff('day', m.date, c.order_date))) AS gap FROM m JOIN c ON c.section_id = m.section_id AND c.supplier = m.name WHERE m.date IS NOT NULL GROUP BY ALL)
        SELECT a.*, (SELECT count(*) FROM m WHERE m.section_id = a.section_id AND m.name = a.name_id) AS match_count,
          (SELECT count(*) FROM m WHERE m.section_id = a.section_id AND m.name = a.name_id AND m.date IS NOT NULL AND a.kind = 'supplier') AS timed_count, CAST(0 AS BIGINT) AS window_count
        FROM ({APPEAR}) a WHERE a.name_id = 'Supplier#000000000'""",
)
def _(spark, d):
    deals = b.contracts(spark, d)
    suppliers, recipients = c.supplier_totals(deals), c.recipient_totals(b.payments(spark, d))
    appearances = c.entity_appearances(suppliers, recipients)
    pool = matching.name_pool(suppliers, recipients)
    matches, timed = matching.entity_meetings(b.diary(spark, d), pool, deals, "Supplier#000000000")
    return c.entity_profile(appearances, matches, timed, "Supplier#000000000")


