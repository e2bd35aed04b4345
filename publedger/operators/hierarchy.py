"""Budget hierarchy: normalise lines, and sum one level without counting money twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from publedger.functions.numbers import execution_rate, finite, outlier_note, read_measure
from publedger.functions.text import js_trim
from publedger.operators.common import first_per_group, fixed_rows
from publedger.session import cut_lineage

#: A deeper tree is refused, not cut.
MOST_LEVELS = 64
MEASURES = ("original", "updated", "actual", "estimated")
YEAR_KEY = ["section_id", "fiscal_year"]


def mark_leaves(df: DataFrame, by: list[str] = YEAR_KEY) -> DataFrame:
    """``is_leaf``: no collected row of the same group names the code as its parent."""
    parents = (
        df.filter(F.col("parent_code").isNotNull())
        .select(*by, F.col("parent_code").alias("code"))
        .distinct()
        .withColumn("__named", F.lit(True))
    )
    return df.join(parents, [*by, "code"], "left").withColumn("is_leaf", F.col("__named").isNull()).drop("__named")


def ancestor_chains(nodes: DataFrame, by: list[str], most: int) -> DataFrame:
    """``*by, code, codes, titles`` of every node: itself and all above it, nearest first.

    ``nodes``: *by, code, title, parent_code, one row a code. Chains double by pointer jumping: a round
    appends to each chain the chain of its last code's parent, so ``most`` levels take log2(most) rounds.
    A chain that meets a code twice ends before it; one that is still open after all rounds is refused.
    """
    chains = nodes.select(
        *by, "code", F.array("code").alias("codes"), F.array("title").alias("titles"), F.col("parent_code").alias("next")
    )
    reach = 1
    while True:
        # The other side of the jump, so that a chain is looked up by the code it goes on with.
        above = chains.select(*by, F.col("code").alias("next"), F.struct("codes", "titles", "next").alias("up"))
        joined = chains.join(above, [*by, "next"], "left")
        codes = F.concat("codes", F.coalesce("up.codes", F.array().cast("array<string>")))
        titles = F.concat("titles", F.coalesce("up.titles", F.array().cast("array<string>")))
        # A chain runs into a circle only once, so its distinct codes are its beginning.
        distinct = F.array_distinct(codes)
        circles = F.size(distinct) < F.size(codes)
        jumped = joined.select(
            *by, "code", distinct.alias("codes"), F.slice(titles, F.lit(1), F.size(distinct)).alias("titles"),
            F.when(~circles, F.col("up.next")).alias("next"),
        )
        chains, reach = cut_lineage(jumped, "budget-chains"), 2 * reach
        if not chains.filter(F.col("next").isNotNull()).limit(1).count():
            return chains.drop("next")
        if reach >= most:
            raise ValueError(f"the hierarchy is deeper than {most} levels")


def hierarchy_path(df: DataFrame, by: list[str] = YEAR_KEY, most: int = MOST_LEVELS) -> DataFrame:
    """``path``: titles from the root to the row; a code met twice ends the walk.

    Codes, not rows, walk up; deeper trees than ``most`` levels are refused. Of rows that repeat a
    code the last by title names it.
    """
    node = F.max(F.struct("title", "parent_code"))
    nodes = df.filter(F.col("title").isNotNull()).groupBy(*by, "code").agg(node.alias("__node"))
    nodes = cut_lineage(nodes.select(*by, "code", "__node.*"), "budget-codes")
    chains = ancestor_chains(nodes, by, most).select(*by, F.col("code").alias("parent_code"), F.col("codes").alias("__codes"), F.col("titles").alias("__titles"))
    walked = df.join(chains, [*by, "parent_code"], "left")
    own = F.array_position("__codes", F.col("code"))
    above = F.when(own > 0, F.slice("__titles", F.lit(1), (own - 1).cast("int"))).otherwise(F.col("__titles"))
    path = F.concat(F.reverse(F.coalesce(above, F.array().cast("array<string>"))), F.array("title"))
    return walked.withColumn("path", path).select(*[F.col(f"`{c}`") for c in df.columns if c != "path"], "path")


def _text(name: str) -> Column:
    text = js_trim(name)
    return F.when(text != F.lit(""), text)


def normalize_budget(raw: DataFrame, current_year: int, years: list[int] | None = None) -> DataFrame:
    """Budget items out of raw text rows.

    ``raw``: section_id, code, title, parent, depth, year, net_allocated, net_revised,
    net_executed (all text). Rows without code, title, depth or year are dropped. Executed
    money is an actual figure in a closed year and an estimate in an open one.
    """
    rows = raw.select(
        "section_id",
        read_measure("year").cast("int").alias("fiscal_year"),
        _text("code").alias("code"),
        _text("title").alias("title"),
        _text("parent").alias("parent_code"),
        read_measure("depth").cast("int").alias("level"),
        read_measure("net_allocated").alias("original"),
        read_measure("net_revised").alias("updated"),
        read_measure("net_executed").alias("__executed"),
    ).filter(F.col("fiscal_year").isNotNull() & F.col("code").isNotNull() & F.col("title").isNotNull())
    if years is not None:
        rows = rows.filter(F.col("fiscal_year").isin(*years))
    rows = cut_lineage(rows, "budget-rows")  # read by the leaves, the codes and the paths
    # A row without a depth is dropped, but it still counts as someone's parent or title.
    rows = mark_leaves(hierarchy_path(rows)).filter(F.col("level").isNotNull())
    is_open = F.col("fiscal_year") >= current_year
    rows = rows.withColumn("actual", F.when(~is_open, F.col("__executed"))).withColumn(
        "estimated", F.when(is_open, F.col("__executed"))
    )
    rate = execution_rate("actual", "estimated", "updated")
    return rows.withColumn("rate", rate).select(
        F.concat_ws("-", F.lit("budget"), "section_id", "fiscal_year", "code").alias("item_id"),
        "section_id",
        "fiscal_year",
        "code",
        "parent_code",
        "title",
        "path",
        "level",
        "is_leaf",
        *MEASURES,
        "rate",
        F.when(is_open, F.lit("estimate")).otherwise(F.lit("partial")).alias("status"),
        outlier_note("rate").alias("notes"),
    )


def sum_no_double_count(
    df: DataFrame, by: list[str], measures: dict[str, Column] | None = None, extra: list[Column] | None = None
) -> DataFrame:
    """Sum each measure over leaves, or over the shallowest level where a group has no leaf.

    Columns per measure ``m``: ``m`` (null without a value) and ``m_records``; plus
    ``level_used`` (``leaf`` or the level number) and ``row_count``. The first aggregation is
    per group and level, so a huge group is already reduced to a few rows when it shuffles.
    """
    measures = measures or {m: F.col(m) for m in MEASURES}
    per_level = []
    for name, measure in measures.items():
        value = finite(measure)
        at_leaf = F.when(F.col("is_leaf"), value)
        per_level += [
            F.sum(at_leaf).alias(f"__leaf_{name}"),
            F.count(at_leaf).alias(f"__leafn_{name}"),
            F.sum(value).alias(f"__all_{name}"),
            F.count(value).alias(f"__alln_{name}"),
        ]
    levels = df.groupBy(*by, "level").agg(
        F.max(F.col("is_leaf")).alias("__has_leaf"), F.count("*").alias("__rows"), *per_level, *(extra or [])
    )
    extra_names = [c for c in levels.columns if not c.startswith("__") and c not in (*by, "level")]
    merged = [F.max("__has_leaf").alias("__has_leaf"), F.min("level").alias("__top"), F.sum("__rows").alias("row_count")]
    for name in measures:
        merged += [
            F.sum(f"__leaf_{name}").alias(f"__leaf_{name}"),
            F.sum(f"__leafn_{name}").alias(f"__leafn_{name}"),
            F.min_by(F.struct(f"__all_{name}", f"__alln_{name}"), "level").alias(f"__top_{name}"),
        ]
    # Extra aggregates are flags counted per level; they add up over levels.
    merged += [F.sum(name).alias(name) for name in extra_names]
    total = levels.groupBy(*by).agg(*merged) if by else levels.agg(*merged)
    out = []
    for name in measures:
        out += [
            F.when(F.col("__has_leaf"), F.col(f"__leaf_{name}"))
            .otherwise(F.col(f"__top_{name}.__all_{name}"))
            .alias(name),
            F.when(F.col("__has_leaf"), F.col(f"__leafn_{name}"))
            .otherwise(F.col(f"__top_{name}.__alln_{name}"))
            .alias(f"{name}_records"),
        ]
    level_used = F.when(F.col("__has_leaf"), F.lit("leaf")).otherwise(F.col("__top").cast("string"))
    return total.select(*by, level_used.alias("level_used"), "row_count", *out, *extra_names)


def yearly_totals(df: DataFrame, by: list[str]) -> DataFrame:
    """Original, updated and execution of every year that has rows."""
    totals = sum_no_double_count(
        df,
        [*by, "fiscal_year"],
        extra=[
            F.count_if(F.col("status") == "estimate").alias("estimates"),
            F.count_if(F.col("status") == "final").alias("finals"),
        ],
    )
    use_estimate = F.col("actual").isNull() & F.col("estimated").isNotNull()
    execution = F.coalesce("actual", "estimated")
    weakest = (
        F.when(execution.isNull(), F.lit("unavailable"))
        .when(F.col("estimates") > 0, F.lit("estimate"))
        .when(F.col("finals") == F.col("row_count"), F.lit("final"))
        .otherwise(F.lit("partial"))
    )
    return totals.select(
        *by,
        "fiscal_year",
        "original",
        "updated",
        execution.alias("execution"),
        use_estimate.alias("execution_is_estimate"),
        weakest.alias("execution_status"),
        F.col("row_count").alias("record_count"),
    )


def aggregate_by_year(df: DataFrame, years: list[int], by: list[str] | None = None) -> DataFrame:
    """Original, updated and execution for every year of ``years``, also years without rows.

    The years of a group, at most ``years``, are gathered into one row and laid out again, so the
    table is read once and no list of groups has to be joined back.
    """
    by = by or []
    totals = yearly_totals(df, by)
    values = [c for c in totals.columns if c not in (*by, "fiscal_year")]
    cell = F.struct("fiscal_year", *values)
    held = totals.groupBy(*by).agg(F.collect_list(F.when(F.col("fiscal_year").isin(*years), cell)).alias("__cells"))
    laid = held.select(*by, "__cells", F.explode(F.array(*[F.lit(y) for y in years])).alias("fiscal_year"))
    own = F.element_at(F.filter("__cells", lambda c: c["fiscal_year"] == F.col("fiscal_year")), 1)
    missing = {"execution_is_estimate": F.lit(False), "execution_status": F.lit("unavailable"), "record_count": F.lit(0)}
    found = laid.withColumn("__own", F.when(F.exists("__cells", lambda c: c["fiscal_year"] == F.col("fiscal_year")), own))
    columns = [F.coalesce(F.col("__own")[c], missing[c]).alias(c) if c in missing else F.col("__own")[c].alias(c) for c in values]
    return found.select(*by, "fiscal_year", *columns)


def to_series(aggregates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per year and measure."""
    keys = [*(by or []), "fiscal_year"]
    return aggregates.unpivot(keys, ["original", "updated", "execution"], "measure", "value")


def latest_year_with(df: DataFrame, by: list[str], measure: str = "updated") -> DataFrame:
    """Latest year whose one-level total of ``measure`` is known; null when none is."""
    totals = sum_no_double_count(df, [*by, "fiscal_year"], {measure: F.col(measure)})
    latest = F.max(F.when(F.col(measure).isNotNull(), F.col("fiscal_year"))).alias("latest_year")
    return totals.groupBy(*by).agg(latest)


def waterfall(items: DataFrame, requests: DataFrame) -> DataFrame:
    """Bridge original → transfer → updated → unused → execution per section and year.

    A step without its inputs keeps null value, start and end. ``requests_net`` is what the
    held transfer requests explain and ``unexplained`` the rest of the transfer step.
    """
    held = requests.groupBy("section_id", F.col("year").alias("fiscal_year")).agg(F.sum("net").alias("requests_net"))
    levels = sum_no_double_count(items, YEAR_KEY).join(held, YEAR_KEY, "left")
    execution = F.coalesce("actual", "estimated")
    transfer = F.col("updated") - F.col("original")
    unused = execution - F.col("updated")
    zero = F.when(F.lit(True), F.lit(0)).cast(dict(levels.dtypes)["updated"])

    def step(order: int, name: str, kind: Column, value: Column, start: Column, end: Column) -> Column:
        known = value.isNotNull()
        return F.struct(
            F.lit(order).alias("step"),
            F.lit(name).alias("step_id"),
            kind.alias("kind"),
            value.alias("value"),
            F.when(known, start).alias("start"),
            F.when(known, end).alias("end"),
        )

    steps = F.array(
        step(1, "original", F.lit("base"), F.col("original"), zero, F.col("original")),
        step(
            2,
            "transfer",
            F.when(transfer < 0, F.lit("decrease")).otherwise(F.lit("increase")),
            transfer,
            F.col("original"),
            F.col("updated"),
        ),
        step(3, "updated", F.lit("total"), F.col("updated"), zero, F.col("updated")),
        step(
            4,
            "unused",
            F.when(unused > 0, F.lit("increase")).otherwise(F.lit("decrease")),
            unused,
            F.col("updated"),
            execution,
        ),
        step(5, "execution", F.lit("total"), execution, zero, execution),
    )
    return levels.select(
        *YEAR_KEY,
        "requests_net",
        (transfer - F.col("requests_net")).alias("unexplained"),
        (F.col("actual").isNull() & F.col("estimated").isNotNull()).alias("execution_is_estimate"),
        F.inline(steps),
    )


def composition(items: DataFrame, year: int, n: int = 24) -> DataFrame:
    """Largest sections of one year by updated budget, positive totals only."""
    totals = sum_no_double_count(
        items.filter(F.col("fiscal_year") == year), ["section_id"], {"updated": F.col("updated")}
    )
    return (
        totals.filter(F.col("updated") > 0)
        .select("section_id", F.col("updated").alias("size"))
        .orderBy(F.desc("size"), "section_id")
        .limit(n)
    )


def section_composition(items: DataFrame, year: int, n: int = 24) -> DataFrame:
    """Per section its level-2 programmes, or its leaves where it has none; positive only."""
    rows = items.filter(
        (F.col("fiscal_year") == year) & ((F.col("level") == 2) | F.col("is_leaf")) & (F.col("updated") > 0)
    ).select("section_id", "code", "title", "level", F.col("updated").alias("size"))
    has_programmes = rows.groupBy("section_id").agg(F.max(F.col("level") == 2).alias("__two"))
    kept = rows.join(has_programmes, "section_id").filter(~F.col("__two") | (F.col("level") == 2))
    return first_per_group(kept.drop("__two"), ["section_id"], [F.desc("size"), F.col("code")], n, rank="tile")


def slope(items: DataFrame, n: int = 12) -> DataFrame:
    """Sections in the first and last year that carry any figure, both known; largest last."""
    totals = sum_no_double_count(items, YEAR_KEY, {"updated": F.col("updated")})
    edges = items.filter(F.col("updated").isNotNull()).agg(
        F.min("fiscal_year").alias("__from"), F.max("fiscal_year").alias("__to")
    )
    year = F.col("fiscal_year")
    edge = totals.join(F.broadcast(edges), (year == F.col("__from")) | (year == F.col("__to")))
    return (
        edge.filter(F.col("__to") > F.col("__from"))
        .groupBy("section_id")
        .agg(
            F.max(F.when(year == F.col("__from"), F.col("updated"))).alias("from_value"),
            F.max(F.when(year == F.col("__to"), F.col("updated"))).alias("to_value"),
        )
        .filter(F.col("from_value").isNotNull() & F.col("to_value").isNotNull())
        .orderBy(F.desc("to_value"), "section_id")
        .limit(n)
    )
