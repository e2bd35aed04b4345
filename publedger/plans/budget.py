"""Queries over the budget hierarchy and the use of money."""

from __future__ import annotations

from pyspark.sql import functions as F

from publedger.operators import filters, hierarchy, ranking, sets, spending
from publedger.plans.oracle import matches_query, pct, share
from publedger.plans.registry import query
from publedger.sources import bindings as b

SPINE = [*b.YEARS, 2002, 2003]  # two years nobody has rows for


# ---- hierarchy -------------------------------------------------------------


@query(
    "h1_mark_leaves",
    """SELECT i.item_id, p.parent_code IS NULL AS is_leaf FROM items i
       LEFT JOIN (SELECT DISTINCT section_id, fiscal_year, parent_code FROM items WHERE parent_code IS NOT NULL) p
         ON p.section_id = i.section_id AND p.fiscal_year = i.fiscal_year AND p.parent_code = i.code""",
)
def _(spark, d):
    return hierarchy.mark_leaves(b.budget_items(spark, d).drop("is_leaf")).select("item_id", "is_leaf")


@query(
    "h2_hierarchy_path",
    """SELECT i.item_id, concat_ws(', ', g.title, p.title, i.title) AS path FROM items i
       LEFT JOIN items p ON p.section_id = i.section_id AND p.fiscal_year = i.fiscal_year AND p.code = i.parent_code
       LEFT JOIN items g ON g.section_id = i.section_id AND g.fiscal_year = i.fiscal_year AND g.code = p.parent_code""",
)
def _(spark, d):
    return hierarchy.hierarchy_path(b.budget_items(spark, d)).select("item_id", "path")


@query(
    "h3_normalize_budget",
    f"""SELECT i.item_id, i.section_id, i.fiscal_year, i.code, i.parent_code, i.title, i.level, p.parent_code IS NULL AS is_leaf, CAST(i.original AS DOUBLE) AS original, CAST(i.updated AS DOUBLE) AS updated,
          CAST(i.actual AS DOUBLE) AS actual, CAST(i.estimated AS DOUBLE) AS estimated, {share("coalesce(i.actual, i.estimated)", "i.updated")} AS rate,
          CASE WHEN i.fiscal_year > 2000 THEN 'estimate' ELSE 'partial' END AS status
        FROM items i LEFT JOIN (SELECT DISTINCT section_id, fiscal_year, parent_code FROM items WHERE parent_code IS NOT NULL AND NOT regexp_matches(code, '13-LARGE$')) p
          ON p.section_id = i.section_id AND p.fiscal_year = i.fiscal_year AND p.parent_code = i.code
        WHERE NOT regexp_matches(i.code, '13-LARGE$')""",
)
def _(spark, d):
    return hierarchy.normalize_budget(b.raw_budget(spark, d), current_year=2001).drop("path", "notes")


@query(
    "h4_sum_no_double_count",
    """SELECT t.section_id, t.fiscal_year, t.level_used, c.row_count, t.original, t.original_records, t.updated, t.updated_records, t.actual, t.actual_records, t.estimated, t.estimated_records
       FROM totals t JOIN (SELECT section_id, fiscal_year, count(*) AS row_count FROM items GROUP BY 1, 2) c ON c.section_id = t.section_id AND c.fiscal_year = t.fiscal_year""",
)
def _(spark, d):
    return hierarchy.sum_no_double_count(b.budget_items(spark, d), hierarchy.YEAR_KEY)


@query("h5_aggregate_by_year", "SELECT * FROM yearly")
def _(spark, d):
    return hierarchy.aggregate_by_year(b.budget_items(spark, d), SPINE, ["section_id"])


@query(
    "h6_to_series",
    """SELECT section_id, fiscal_year, 'original' AS measure, original AS value FROM yearly UNION ALL SELECT section_id, fiscal_year, 'updated', updated FROM yearly
       UNION ALL SELECT section_id, fiscal_year, 'execution', execution FROM yearly""",
)
def _(spark, d):
    return hierarchy.to_series(hierarchy.aggregate_by_year(b.budget_items(spark, d), SPINE, ["section_id"]), ["section_id"])


@query("h7_latest_year_with", "SELECT section_id, max(CASE WHEN actual IS NOT NULL THEN fiscal_year END) AS latest_year FROM totals GROUP BY 1")
def _(spark, d):
    return hierarchy.latest_year_with(b.budget_items(spark, d), ["section_id"], "actual")


@query(
    "h8_waterfall",
    """WITH w AS (SELECT t.*, coalesce(actual, estimated) AS execution, r.net AS requests_net FROM totals t
         LEFT JOIN (SELECT section_id, year, CAST(sum(net) AS BIGINT) AS net FROM requests GROUP BY 1, 2) r ON r.section_id = t.section_id AND r.year = t.fiscal_year),
       steps AS (
         SELECT *, 1 AS step, 'original' AS step_id, 'base' AS kind, original AS value, 0 AS start_at, original AS end_at FROM w
         UNION ALL SELECT *, 2, 'transfer', CASE WHEN updated - original < 0 THEN 'decrease' ELSE 'increase' END, updated - original, original, updated FROM w
         UNION ALL SELECT *, 3, 'updated', 'total', updated, 0, updated FROM w
         UNION ALL SELECT *, 4, 'unused', CASE WHEN execution - updated > 0 THEN 'increase' ELSE 'decrease' END, execution - updated, updated, execution FROM w
         UNION ALL SELECT *, 5, 'execution', 'total', execution, 0, execution FROM w)
       SELECT section_id, fiscal_year, requests_net, updated - original - requests_net AS unexplained, actual IS NULL AND estimated IS NOT NULL AS execution_is_estimate,
         CAST(step AS BIGINT) AS step, step_id, kind, value, CASE WHEN value IS NOT NULL THEN CAST(start_at AS BIGINT) END AS start, CASE WHEN value IS NOT NULL THEN end_at END AS "end" FROM steps""",
)
def _(spark, d):
    return hierarchy.waterfall(b.budget_items(spark, d), b.requests(spark, d))


@query(
    "h9_composition",
    "SELECT section_id, updated AS size FROM totals WHERE fiscal_year = 1999 AND updated > 0 ORDER BY updated DESC, section_id LIMIT 24",
)
def _(spark, d):
    return hierarchy.composition(b.budget_items(spark, d), 1999)


@query(
    "h9_section_composition",
    """WITH r AS (SELECT * FROM items WHERE fiscal_year = 1999 AND (level = 2 OR is_leaf) AND updated > 0 AND (level <> 2 OR section_id <> 'S3')),
       two AS (SELECT section_id, bool_or(level = 2) AS t FROM r GROUP BY 1)
       SELECT * FROM (SELECT r.section_id, code, title, level, updated AS size, row_number() OVER (PARTITION BY r.section_id ORDER BY updated DESC, code) AS tile
         FROM r JOIN two ON two.section_id = r.section_id WHERE NOT two.t OR level = 2) WHERE tile <= 24""",
)
def _(spark, d):
    items = b.budget_items(spark, d).filter((F.col("level") != 2) | (F.col("section_id") != "S3"))
    return hierarchy.section_composition(items, 1999)


@query(
    "h10_slope",
    """SELECT a.section_id, a.updated AS from_value, z.updated AS to_value FROM totals a JOIN totals z ON z.section_id = a.section_id
       WHERE a.fiscal_year = (SELECT min(fiscal_year) FROM items WHERE updated IS NOT NULL) AND z.fiscal_year = (SELECT max(fiscal_year) FROM items WHERE updated IS NOT NULL)
       ORDER BY z.updated DESC, a.section_id LIMIT 12""",
)
def _(spark, d):
    return hierarchy.slope(b.budget_items(spark, d))


# ---- use of money ----------------------------------------------------------


@query(
    "a1_usage_breakdown",
    """SELECT section_id, fiscal_year, econ1, econ2, CAST(sum(allocated) AS BIGINT) AS allocated, CAST(sum(revised) AS BIGINT) AS revised, CAST(sum(executed) AS BIGINT) AS executed, count(*) AS line_count
       FROM usage_lines WHERE kind = '1' AND depth = 4 AND NOT is_proposal AND econ2 IS NOT NULL GROUP BY 1, 2, 3, 4""",
)
def _(spark, d):
    return spending.usage_breakdown(b.usage_lines(spark, d))[0]


@query(
    "a1_usage_rejected",
    "SELECT section_id, count(*) AS rejected_lines FROM usage_lines WHERE kind = '1' AND depth = 4 AND NOT is_proposal AND econ2 IS NULL GROUP BY 1",
)
def _(spark, d):
    return spending.usage_breakdown(b.usage_lines(spark, d))[1]


COVERAGE = f"""SELECT sp.section_id, sp.y AS fiscal_year, coalesce(u.s, 0) AS classified_sum, i.updated AS section_total, {share("coalesce(u.s, 0)", "i.updated")} AS coverage_percent
  FROM (SELECT section_id, y FROM (SELECT DISTINCT section_id FROM items), (SELECT unnest(range(1995, 2004)) AS y)) sp
  LEFT JOIN (SELECT section_id, fiscal_year, CAST(sum(coalesce(revised, 0)) AS BIGINT) AS s FROM usage GROUP BY 1, 2) u ON u.section_id = sp.section_id AND u.fiscal_year = sp.y
  LEFT JOIN (SELECT * FROM items WHERE level = 1) i ON i.section_id = sp.section_id AND i.fiscal_year = sp.y"""


@query("a2_usage_coverage", COVERAGE)
def _(spark, d):
    return spending.usage_coverage(b.usage(spark, d), b.budget_items(spark, d), SPINE)


@query(
    "a3_usage_series",
    """WITH y AS (SELECT econ1, fiscal_year, CAST(sum(coalesce(revised, 0)) AS BIGINT) AS v FROM usage WHERE section_id = 'S3' GROUP BY 1, 2),
       o AS (SELECT econ1, row_number() OVER (ORDER BY sum(v) DESC, econ1) AS position FROM y GROUP BY 1)
       SELECT o.econ1, o.position, g.fy AS fiscal_year, y.v AS value FROM o CROSS JOIN (SELECT unnest(range(1995, 2004)) AS fy) g LEFT JOIN y ON y.econ1 = o.econ1 AND y.fiscal_year = g.fy""",
)
def _(spark, d):
    return spending.usage_series(b.usage(spark, d), "S3", SPINE)


@query(
    "a3_usage_pivot",
    """SELECT g.fy AS fiscal_year, CAST(sum(CASE WHEN econ1 = 'A' THEN coalesce(revised, 0) END) AS BIGINT) AS A, CAST(sum(CASE WHEN econ1 = 'N' THEN coalesce(revised, 0) END) AS BIGINT) AS N,
         CAST(sum(CASE WHEN econ1 = 'R' THEN coalesce(revised, 0) END) AS BIGINT) AS R FROM (SELECT unnest(range(1995, 2004)) AS fy) g LEFT JOIN usage u ON u.fiscal_year = g.fy GROUP BY 1""",
)
def _(spark, d):
    return spending.usage_pivot(b.usage(spark, d), spending.ALL, SPINE, ["A", "N", "R"])


@query(
    "a4_usage_detail",
    f"""SELECT *, CASE WHEN revised > 0 THEN {pct("revised", "sum(CASE WHEN revised > 0 THEN revised END) OVER ()")} END AS share FROM (
          SELECT fiscal_year, econ1, econ2, CAST(sum(allocated) AS BIGINT) AS allocated, CAST(sum(revised) AS BIGINT) AS revised, CAST(sum(executed) AS BIGINT) AS executed, CAST(sum(line_count) AS BIGINT) AS line_count
          FROM usage WHERE fiscal_year = 1998 GROUP BY 1, 2, 3)""",
)
def _(spark, d):
    return spending.usage_detail(b.usage(spark, d), spending.ALL, 1998)


HUNDRED = f"""SELECT *, {pct("amount", "sum(amount) OVER (PARTITION BY section_id, fiscal_year)")} AS per_hundred FROM (
    SELECT section_id, fiscal_year, econ1, CAST(sum(revised) AS BIGINT) AS amount FROM usage WHERE revised > 0 GROUP BY 1, 2, 3)"""


@query("a5_per_hundred", HUNDRED)
def _(spark, d):
    return spending.per_hundred(b.usage(spark, d), ["section_id", "fiscal_year"])


@query(
    "a6_per_hundred_latest",
    f"""SELECT *, {pct("amount", "sum(amount) OVER ()")} AS per_hundred FROM (SELECT fiscal_year, econ1, CAST(sum(revised) AS BIGINT) AS amount FROM usage WHERE revised > 0
          AND fiscal_year = (SELECT max(fiscal_year) FROM usage WHERE revised > 0) GROUP BY 1, 2)""",
)
def _(spark, d):
    return spending.per_hundred_latest(b.usage(spark, d))


@query(
    "a7_scale_split",
    f"SELECT section_id, fiscal_year, econ1, floor(10000.0 * per_hundred / (sum(per_hundred) OVER (PARTITION BY section_id, fiscal_year)) * 100.0 + 0.5) / 100.0 AS scaled FROM ({HUNDRED})",
)
def _(spark, d):
    by = ["section_id", "fiscal_year"]
    scaled = spending.scale_split(spending.per_hundred(b.usage(spark, d), by), 10_000, by)
    cents = F.floor(F.col("scaled") * 100.0 + 0.5) / 100.0
    return scaled.select(*by, "econ1", cents.alias("scaled"))


@query(
    "a8_theme_aggregates",
    f"""SELECT *, CASE WHEN updated > 0 THEN {pct("updated", "sum(CASE WHEN updated > 0 THEN updated END) OVER (PARTITION BY section_id, fiscal_year)")} END AS share FROM (
          SELECT i.section_id, i.fiscal_year, a.theme_id, CAST(sum(original) AS BIGINT) AS original, CAST(sum(updated) AS BIGINT) AS updated, CAST(sum(coalesce(actual, estimated)) AS BIGINT) AS execution, count(*) AS members
          FROM items i JOIN assigned a ON a.section_id = i.section_id AND a.code = i.code WHERE i.is_leaf GROUP BY 1, 2, 3)""",
)
def _(spark, d):
    return spending.theme_aggregates(b.budget_items(spark, d), b.assignments(spark, d), b.themes(spark, d), ["section_id", "fiscal_year"])


@query(
    "a9_largest_shifts",
    f"""SELECT t.section_id, t.code, t.title, t.delta, t.delta_percent, a.theme_id FROM (
          SELECT *, updated - original AS delta, {pct("updated - original", "original")} AS delta_percent FROM items
          WHERE is_leaf AND fiscal_year = 1999 AND original IS NOT NULL AND updated <> original ORDER BY abs(updated - original) DESC, section_id, code LIMIT 25) t
        LEFT JOIN assigned a ON a.section_id = t.section_id AND a.code = t.code""",
)
def _(spark, d):
    shifts = spending.top_shifts(b.budget_items(spark, d), b.assignments(spark, d), 1999, 25)
    return shifts.select("section_id", "code", "title", "delta", "delta_percent", "theme_id")


VOLATILITY = f"""SELECT *, {share("sum_abs_delta", "sum_original")} AS index_percent FROM (
    SELECT section_id, fiscal_year, CAST(sum(abs(updated - original)) AS BIGINT) AS sum_abs_delta, CAST(sum(abs(original)) AS BIGINT) AS sum_original, count(*) AS leaf_count
    FROM items WHERE is_leaf AND original IS NOT NULL AND updated IS NOT NULL GROUP BY 1, 2)"""


@query("a10_volatility", VOLATILITY)
def _(spark, d):
    return spending.volatility(b.budget_items(spark, d))


@query(
    "a10_volatility_ranking",
    f"SELECT *, row_number() OVER (ORDER BY index_percent DESC, section_id) AS position FROM ({VOLATILITY}) WHERE fiscal_year = 1999 AND index_percent IS NOT NULL",
)
def _(spark, d):
    return spending.volatility_ranking(b.budget_items(spark, d), 1999)


# ---- filters, lookups and set operations on budget lines ---------------------


@query(
    "p5_filter_budget",
    f"""SELECT item_id FROM items WHERE section_id <> 'none' AND fiscal_year = 1999 AND level = 3 AND coalesce(abs({pct("updated - original", "original")}) >= 0.5 AND abs(updated - original) >= 50000, false)
          AND {matches_query(["title || ' ' || code || ' ' || title"], "brand large")}""",
)
def _(spark, d):
    items = b.budget_items(spark, d).withColumn("path", F.array("title"))
    return filters.filter_budget(
        items, year="1999", level="3", large_only=True, query="BRAND  large", percent=0.5, absolute=50_000
    ).select("item_id")


@query("p11_coverage_gaps", f"SELECT * FROM ({COVERAGE}) WHERE coverage_percent < 99.5 OR coverage_percent > 100.5")
def _(spark, d):
    return spending.coverage_gaps(spending.usage_coverage(b.usage(spark, d), b.budget_items(spark, d), SPINE))


@query("p13_for_section", "SELECT item_id, updated FROM items WHERE section_id = 'S7'")
def _(spark, d):
    return filters.for_section(b.budget_items(spark, d), "S7").select("item_id", "updated")


@query("p13_years_available", "SELECT DISTINCT fiscal_year FROM items WHERE section_id = 'S7'")
def _(spark, d):
    return filters.years_available(b.budget_items(spark, d), "S7")


@query(
    "u3_reconcile_keys",
    """WITH collected AS (SELECT section_id, code, max(title) AS title FROM items WHERE level IN (2, 3) AND code NOT LIKE '%05-PROMO' GROUP BY 1, 2),
       a AS (SELECT section_id, code, max(title) AS title, count(*) AS n FROM (SELECT section_id, code, title FROM assigned UNION ALL SELECT section_id, code, title FROM assigned WHERE code LIKE '%-ECONOMY') GROUP BY 1, 2),
       j AS (SELECT coalesce(a.section_id, c.section_id) AS section_id, coalesce(a.code, c.code) AS code, a.n, a.title AS ta, c.title AS tc, c.code AS cc FROM a FULL JOIN collected c ON a.section_id = c.section_id AND a.code = c.code)
       SELECT section_id, code, 'duplicate' AS reason FROM j WHERE n > 1 UNION ALL SELECT section_id, code, 'missing' FROM j WHERE n IS NULL
       UNION ALL SELECT section_id, code, 'stale' FROM j WHERE cc IS NULL UNION ALL SELECT section_id, code, 'retitled' FROM j WHERE ta <> tc""",
)
def _(spark, d):
    items = b.budget_items(spark, d).filter(F.col("level").isin(2, 3) & ~F.col("code").endswith("05-PROMO"))
    collected = items.select("section_id", "code", "title").distinct()
    assigned = b.assignments(spark, d)
    doubled = assigned.unionByName(assigned.filter(F.col("code").endswith("-ECONOMY")))
    return sets.reconcile_keys(doubled, collected, ["section_id", "code"])


# ---- rankings and distributions over budget lines ------------------------------


@query(
    "w1_rank_of",
    """SELECT section_id, fiscal_year, original, row_number() OVER (PARTITION BY fiscal_year ORDER BY original DESC, section_id) AS rank, count(*) OVER (PARTITION BY fiscal_year) AS out_of
       FROM totals WHERE original IS NOT NULL""",
)
def _(spark, d):
    totals = hierarchy.sum_no_double_count(b.budget_items(spark, d), hierarchy.YEAR_KEY)
    return ranking.rank_of(totals, ["fiscal_year"], "original", "section_id").select("section_id", "fiscal_year", "original", "rank", "out_of")


@query(
    "w8_sort_page",
    """SELECT item_id, original FROM items ORDER BY original DESC NULLS LAST, item_id LIMIT 50 OFFSET 50""",
)
def _(spark, d):
    return ranking.sort_page(b.budget_items(spark, d).select("item_id", "original"), "original", True, "item_id", page=1)


@query("w8_sort_page_ascending", "SELECT item_id, actual FROM items ORDER BY actual ASC NULLS LAST, item_id LIMIT 50")
def _(spark, d):
    return ranking.sort_page(b.budget_items(spark, d).select("item_id", "actual"), "actual", False, "item_id")


@query("w9_unique_sorted", "SELECT DISTINCT title FROM items")
def _(spark, d):
    return ranking.unique_sorted(b.budget_items(spark, d), "title")


@query(
    "w10_minmax_scale",
    """SELECT section_id, fiscal_year, updated, CASE WHEN count(updated) OVER w >= 2 THEN CAST(updated - min(updated) OVER w AS DOUBLE) / (CASE WHEN max(updated) OVER w = min(updated) OVER w THEN 1 ELSE max(updated) OVER w - min(updated) OVER w END) END AS scaled
       FROM yearly WINDOW w AS (PARTITION BY section_id)""",
)
def _(spark, d):
    yearly = hierarchy.aggregate_by_year(b.budget_items(spark, d), SPINE, ["section_id"])
    return ranking.minmax_scale(yearly, "updated", ["section_id"]).select("section_id", "fiscal_year", "updated", "scaled")


@query(
    "w10_minmax_shared_scale",
    """SELECT section_id, fiscal_year, CAST(updated - min(updated) OVER () AS DOUBLE) / (max(updated) OVER () - min(updated) OVER ()) AS scaled FROM yearly""",
)
def _(spark, d):
    yearly = hierarchy.aggregate_by_year(b.budget_items(spark, d), SPINE, ["section_id"])
    return ranking.minmax_scale(yearly, "updated").select("section_id", "fiscal_year", "scaled")


@query(
    "w11_spread",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY fiscal_year ORDER BY original DESC, section_id) AS rn, count(*) OVER (PARTITION BY fiscal_year) AS n FROM totals WHERE original IS NOT NULL)
       SELECT fiscal_year, any_value(n) AS n, max(original) AS high, max(CASE WHEN rn = 1 THEN section_id END) AS high_label, min(original) AS low, max(CASE WHEN rn = n THEN section_id END) AS low_label,
         CAST(max(CASE WHEN rn = n // 2 + 1 THEN original END) AS DOUBLE) AS median FROM r GROUP BY 1 HAVING any_value(n) >= 2""",
)
def _(spark, d):
    totals = hierarchy.sum_no_double_count(b.budget_items(spark, d), hierarchy.YEAR_KEY)
    return ranking.spread(totals, ["fiscal_year"], "section_id", "original")


@query(
    "w11_spread_of_lines",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY updated DESC, item_id) AS rn, count(*) OVER (PARTITION BY section_id) AS n FROM items WHERE updated IS NOT NULL)
       SELECT section_id, any_value(n) AS n, max(updated) AS high, max(CASE WHEN rn = 1 THEN item_id END) AS high_label, min(updated) AS low, max(CASE WHEN rn = n THEN item_id END) AS low_label,
         CAST(max(CASE WHEN rn = n // 2 + 1 THEN updated END) AS DOUBLE) AS median FROM r GROUP BY 1 HAVING any_value(n) >= 2""",
)
def _(spark, d):
    return ranking.spread(b.budget_items(spark, d), ["section_id"], "item_id", "updated")


@query(
    "w12_concentration",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY fiscal_year ORDER BY updated DESC, section_id) AS rn FROM totals WHERE updated > 0)
        SELECT fiscal_year, count(*) AS components, max(CASE WHEN rn = 1 THEN section_id END) AS top_label, {share("max(CASE WHEN rn = 1 THEN updated END)", "sum(updated)")} AS top_share,
          CASE WHEN count(*) > 3 THEN {share("sum(CASE WHEN rn <= 3 THEN updated END)", "sum(updated)")} END AS lead_share FROM r GROUP BY 1""",
)
def _(spark, d):
    totals = hierarchy.sum_no_double_count(b.budget_items(spark, d), hierarchy.YEAR_KEY)
    return ranking.concentration(totals, ["fiscal_year"], "section_id", "updated")


@query(
    "w13_trend_summary",
    f"""WITH e AS (SELECT section_id, min(fiscal_year) FILTER (updated IS NOT NULL) AS first_year, max(fiscal_year) FILTER (updated IS NOT NULL) AS last_year,
          max(fiscal_year) FILTER (execution IS NOT NULL) AS execution_year FROM yearly GROUP BY 1)
        SELECT e.section_id, first_year, last_year, CASE WHEN last_year > first_year THEN {pct("z.updated - a.updated", "abs(a.updated)")} END AS change_percent, execution_year,
          {share("x.execution", "x.updated")} AS execution_rate, x.execution_is_estimate FROM e JOIN yearly a ON a.section_id = e.section_id AND a.fiscal_year = first_year
          JOIN yearly z ON z.section_id = e.section_id AND z.fiscal_year = last_year LEFT JOIN yearly x ON x.section_id = e.section_id AND x.fiscal_year = execution_year""",
)
def _(spark, d):
    yearly = hierarchy.aggregate_by_year(b.budget_items(spark, d), SPINE, ["section_id"])
    return ranking.trend_summary(yearly, ["section_id"])
