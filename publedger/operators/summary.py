"""Section and site summaries, coverage, and counts for the report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from publedger.functions.numbers import change_percent, share_of
from publedger.functions.text import person_id
from publedger.functions.web import parse_archive_url
from publedger.operators.common import first_per_group, fixed_rows
from publedger.operators.hierarchy import aggregate_by_year, yearly_totals

MEASURES = {
    "transparency": "transparency_score",
    "procurement": "procurement_score",
    "execution": "execution_rate_percent",
    "budget": "share_of_total_percent",
}


def _left(base: DataFrame, parts: list[DataFrame], key: str = "section_id") -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, "left"), parts, base)


def _counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("section_id").agg(F.count("*").alias(name))


def latest_budget(items: DataFrame, years: list[int]) -> DataFrame:
    """Each section's latest year with an updated budget, its money, share of all and rank."""
    known = yearly_totals(items, ["section_id"]).filter(F.col("fiscal_year").isin(*years) & F.col("updated").isNotNull())
    row = F.max_by(F.struct(*known.columns), "fiscal_year").alias("row")
    rows = known.groupBy("section_id").agg(row).select("row.*")
    everyone = W.partitionBy(F.lit(0))
    total = F.sum(F.when(F.col("updated") > 0, F.col("updated"))).over(everyone)
    return rows.select(
        "section_id",
        F.col("fiscal_year").alias("latest_year"),
        "original",
        "updated",
        "execution",
        "execution_is_estimate",
        share_of("execution", "updated").alias("execution_rate_percent"),
        share_of(F.col("updated"), total).alias("share_of_total_percent"),
        F.row_number().over(everyone.orderBy(F.desc("updated"), "section_id")).alias("budget_rank"),
        F.count("*").over(everyone).alias("budget_rank_out_of"),
    )


def section_summary(
    sections: DataFrame,
    items: DataFrame,
    years: list[int],
    transparency: DataFrame,
    procurement: DataFrame,
    subject_matter: DataFrame,
    states: DataFrame,
    activities: DataFrame,
    anomalies: DataFrame,
    recipients: DataFrame,
    matches: DataFrame,
) -> DataFrame:
    """One row per section with money, scores, counts and publication state.

    Sort with :func:`sorted_sections`. Every part is already one row per section.
    """
    parts = [
        latest_budget(items, years),
        transparency.select(
            "section_id",
            F.col("score").alias("transparency_score"),
            F.col("entry_count").alias("diary_entry_count"),
            F.col("people_count").alias("diary_people_count"),
        ),
        procurement.select(
            "section_id",
            F.col("concentration_score").alias("procurement_score"),
            "exempt_volume_percent",
            "lead_share_percent",
            "contract_count",
        ),
        subject_matter.select("section_id", F.col("share_percent").alias("subject_matter_percent")),
        states.select("section_id", "state", "published", "unread"),
        _counts(activities, "activity_count"),
        _counts(anomalies, "anomaly_count"),
        _counts(recipients, "recipient_count"),
        _counts(matches, "match_count"),
    ]
    joined = _left(sections.select("section_id", "display_name", "kind"), parts)
    zero = F.lit(0)
    counted = (
        "activity_count", "anomaly_count", "recipient_count", "match_count", "contract_count",
        "diary_entry_count", "diary_people_count",
    )
    return joined.withColumns({c: F.coalesce(c, zero) for c in counted})


def sorted_sections(summary: DataFrame) -> DataFrame:
    """Ministries first, then by updated budget, then by name."""
    return summary.orderBy(
        F.when(F.col("kind") == "ministry", 0).otherwise(1), F.desc_nulls_last("updated"), "display_name"
    )


def site_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of counts for the front page. ``tables`` holds the tables that are counted.

    Each table is counted by its own aggregation; the one-row results are put side by side.
    """
    counts = [df.select(F.lit(name).alias("name")).groupBy("name").agg(F.count("*").alias("n")) for name, df in tables.items()]
    names = fixed_rows(next(iter(tables.values())), [(n,) for n in tables], "name string")
    stacked = reduce(DataFrame.unionByName, counts)
    return names.join(stacked, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def site_overview(
    split: DataFrame, categories: DataFrame, groups: DataFrame, shares: DataFrame, hygiene: DataFrame, states: DataFrame, insights: DataFrame
) -> DataFrame:
    """The rest of the front page as one long relation: ``part, name, n, percent``.

    ``hundred``: a hundred of the latest budget by kind of spending; ``group`` and ``category``: calendar
    rows by reading group and category; ``diary``: shares of the rows by what their subjects say;
    ``hygiene``: findings of each rule and their rate in a thousand lines; ``publications``: published
    and unread ones; ``insight``: strength of each. All inputs are small aggregates.
    """
    none = F.lit(None)

    def part(df: DataFrame, label: str, name, n, percent) -> DataFrame:
        return df.select(F.lit(label).alias("part"), name.alias("name"), n.cast("long").alias("n"), percent.cast("double").alias("percent"))

    listed = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"{k}_percent").alias("percent")) for k in ("classified", "no_topic", "unclassified", "unspecified")]))
    counted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("n")) for k in ("published", "unread")]))
    publications = states.agg(F.sum("published").alias("published"), F.sum("unread").alias("unread")).select(counted.alias("s"))
    parts = [
        part(split, "hundred", F.col("econ1"), F.col("amount"), F.col("per_hundred")),
        part(groups, "group", F.col("reading_group"), F.col("n"), F.col("share_percent")),
        part(categories, "category", F.col("category"), F.col("n"), none),
        part(shares.select("entries", listed.alias("s")), "diary", F.col("s.name"), F.col("entries"), F.col("s.percent")),
        part(hygiene, "hygiene", F.col("rule_id"), F.col("finding_count"), F.col("rate_per_thousand")),
        part(publications, "publications", F.col("s.name"), F.col("s.n"), none),
        part(insights, "insight", F.col("insight_id"), none, F.col("strength")),
    ]
    return reduce(DataFrame.unionByName, parts)


def topics_with_items(topics: DataFrame) -> DataFrame:
    """Topics defined, and those that items stand behind. ``topics``: topic, item_count."""
    return topics.agg(F.count("*").alias("topics_defined"), F.count_if(F.col("item_count") > 0).alias("topics_with_items"))


def compare_sections(summary: DataFrame, measure: str, kind: str = "all") -> DataFrame:
    """Sections on one measure, unknown values last."""
    rows = summary if kind == "all" else summary.filter(F.col("kind") == kind)
    value = F.col(MEASURES[measure])
    return rows.select("section_id", "display_name", value.alias("value")).orderBy(
        F.desc_nulls_last("value"), "section_id"
    )


def coverage(sections: DataFrame, sources: DataFrame, items: DataFrame, activities: DataFrame, years: list[int]) -> DataFrame:
    """What was collected for each section, and the limitations that follow from it."""
    per_source = (
        sources.select("retrieval_status", F.explode("section_ids").alias("section_id"))
        .groupBy("section_id")
        .agg(F.count("*").alias("sources"), F.count_if(F.col("retrieval_status") == "retrieved").alias("retrieved"))
    )
    budget = items.groupBy("section_id").agg(
        F.count("*").alias("budget_records"), F.sort_array(F.collect_set("fiscal_year")).alias("years")
    )
    joined = _left(sections.select("section_id"), [per_source, budget, _counts(activities, "activities")])
    zero = F.lit(0)
    filled = joined.withColumns(
        {c: F.coalesce(c, zero) for c in ("sources", "retrieved", "budget_records", "activities")}
    ).withColumn("years", F.coalesce("years", F.array().cast("array<int>")))
    some_years = (F.size("years") > 0) & (F.size("years") < len(years))
    limits = F.array_compact(
        F.array(
            F.when(F.col("budget_records") == 0, F.lit("no_budget_records")),
            F.when(F.col("activities") == 0, F.lit("no_activities")),
            F.when((F.col("retrieved") == 0) & (F.col("sources") > 0), F.lit("no_source_retrieved")),
            F.when(some_years, F.lit("some_years_only")),
        )
    )
    return filled.withColumn("limitations", limits)


def version_counts(coverage_rows: DataFrame, tenures: DataFrame, sources: DataFrame, topics: DataFrame) -> DataFrame:
    """The counters published with a data version, as name and value."""

    def stacked(df: DataFrame, **aggregates) -> DataFrame:
        row = df.agg(*[a.cast("bigint").alias(n) for n, a in aggregates.items()])
        return row.unpivot([], list(aggregates), "name", "n")

    parts = [
        stacked(
            coverage_rows,
            sections=F.count("*"),
            sections_with_budget=F.count_if(F.col("budget_records") > 0),
            sections_with_activity=F.count_if(F.col("activities") > 0),
            budget_items=F.sum("budget_records"),
            activity_items=F.sum("activities"),
        ),
        stacked(tenures, tenures=F.count("*"), tenures_ended=F.count("end_date")),
        stacked(
            sources, sources=F.count("*"), sources_retrieved=F.count_if(F.col("retrieval_status") == "retrieved")
        ),
        stacked(topics, topics_defined=F.count("*"), topics_with_activity=F.count_if(F.col("item_count") > 0)),
    ]
    return reduce(DataFrame.unionByName, parts)


def theme_counts(themes: DataFrame, assignments: DataFrame, items: DataFrame) -> DataFrame:
    """Collected level-2 and level-3 lines per theme, themes without a line included."""
    lines = items.filter(F.col("level").isin(2, 3)).select("section_id", "code").distinct()
    used = lines.join(assignments.select("section_id", "code", "theme_id"), ["section_id", "code"])
    counts = used.groupBy("theme_id").agg(F.count("*").alias("n"))
    return themes.join(counts, "theme_id", "left").select("theme_id", F.coalesce("n", F.lit(0)).alias("line_count"))


def covered_sections(assignments: DataFrame) -> DataFrame:
    return assignments.select("section_id").distinct()


def sources_by_publisher(sources: DataFrame) -> DataFrame:
    return sources.groupBy("publisher").agg(F.count("*").alias("sources"))


def person_profiles(tenures: DataFrame) -> DataFrame:
    """One row per person: sections, roles, first start, and last end only if all have ended."""
    ended = F.bool_and(F.col("end_date").isNotNull())
    return tenures.groupBy("person_name").agg(
        F.count("*").alias("tenures"),
        F.array_sort(F.collect_set("section_id")).alias("section_ids"),
        F.array_sort(F.collect_set("role")).alias("roles"),
        F.min("start_date").alias("first_start"),
        F.when(ended, F.max("end_date")).alias("last_end"),
        ended.alias("has_ended"),
    ).withColumn("person_id", person_id("person_name"))


def collection_totals(entries: DataFrame, publications: DataFrame) -> DataFrame:
    """Rows by extraction method and the state of the publications, as name and value."""
    methods = entries.groupBy(F.concat(F.lit("method_"), "method").alias("name")).agg(F.count("*").alias("n"))
    state = publications.agg(
        F.count("*").alias("publications"),
        F.count_if(F.col("readable_entries") > 0).alias("publications_with_rows"),
        F.count_if(F.col("section_id").isNull()).alias("publications_unattributed"),
        F.coalesce(F.sum(F.size("unreadable_files").cast("bigint")), F.lit(0)).alias("unreadable_files"),
    )
    names = state.columns
    return methods.unionByName(state.unpivot([], names, "name", "n"))


def archive_reads(attempts: DataFrame, purpose: str = "internet archive snapshot") -> tuple[DataFrame, DataFrame]:
    """Distinct archived copies that were read, and how many reads there were."""
    reads = (
        attempts.filter(F.contains("purpose", F.lit(purpose)) & (F.col("outcome") == "ok"))
        .withColumn("__a", parse_archive_url("url"))
        .filter(F.col("__a").isNotNull())
        .select("url", "__a.resource_url", "__a.dataset_id", "bytes", "attempted_at")
    )
    copies = first_per_group(reads, ["dataset_id", "url"], [F.col("attempted_at")], 1)
    totals = reads.agg(F.count("*").alias("reads"), F.countDistinct("url").alias("distinct_copies"))
    return copies, totals


def headline_context(items: DataFrame, years: list[int]) -> DataFrame:
    """Per section: latest figure, its share of all sections that year, change and rank."""
    yearly = aggregate_by_year(items, years, ["section_id"]).filter(F.col("updated").isNotNull())
    own = W.partitionBy("section_id").orderBy(F.desc("fiscal_year"))
    previous = F.lead("updated").over(own)
    same_year = W.partitionBy("fiscal_year")
    total = F.sum(F.when(F.col("updated") > 0, F.col("updated"))).over(same_year)
    rows = (
        yearly.withColumn("__newest", F.row_number().over(own))
        .withColumn("previous", previous)
        .withColumn("rank", F.row_number().over(same_year.orderBy(F.desc("updated"), "section_id")))
        .withColumn("out_of", F.count("*").over(same_year))
        .withColumn("share_percent", share_of(F.col("updated"), total))
    )
    return rows.filter(F.col("__newest") == 1).select(
        "section_id",
        "fiscal_year",
        "updated",
        "share_percent",
        change_percent("previous", "updated").alias("change_percent"),
        "rank",
        "out_of",
    )
