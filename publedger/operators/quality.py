"""The data-quality gate. Every check returns violation rows ``check, key, detail``; none is good."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from publedger.functions.numbers import OUTLIER_MARKER, execution_rate, rate_outlier
from publedger.functions.web import url_host
from publedger.operators.sets import reconcile_keys

RATE_TOLERANCE = 0.1
OPEN_OVERSHOOT, CLOSED_OVERSHOOT = 1.2, 1.000001
OPEN_PERCENT_MAX, CLOSED_PERCENT_MAX = 120.0, 100.5
SHARE_TOLERANCE = 0.5
PURE_FALLBACKS = ("unclassified", "no_subject_recorded")


class GateFailed(ValueError):
    """At least one check of the gate found a violation."""


def _as_violation(df: DataFrame, check: str, key: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(check).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail")
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _flagged(df: DataFrame, check: str, key: str, tests: dict[str, Column]) -> DataFrame:
    """One pass over ``df`` with all tests; a row may violate several."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in tests.items()]))
    rows = df.select(F.col(key).alias("__key"), F.explode(hits).alias("__hit"))
    return _as_violation(rows, check, F.col("__key"), F.col("__hit"))


def schema_tests(df: DataFrame, schema: StructType, allowed: dict[str, tuple] | None = None) -> dict[str, Column]:
    tests: dict[str, Column] = {}
    held = set(df.columns)
    for field in schema.fields:
        if field.name not in held:
            tests[f"{field.name}: absent"] = F.lit(True)
            continue
        c = F.col(field.name)
        if not field.nullable:
            tests[f"{field.name}: null"] = c.isNull()
            if isinstance(field.dataType, StringType) and field.name != "notes":
                tests[f"{field.name}: empty"] = c == ""
            if isinstance(field.dataType, ArrayType):
                tests[f"{field.name}: null element"] = F.exists(c, lambda x: x.isNull())
    for name, values in (allowed or {}).items():
        if name in held:
            tests[f"{name}: value"] = ~F.col(name).isin(*values)
    return tests


def schema_violations(
    df: DataFrame, schema: StructType, key: str, allowed: dict[str, tuple] | None = None,
    patterns: dict[str, str] | None = None,
) -> DataFrame:
    """Nulls, empty required texts, values outside an enumeration, texts that miss a pattern."""
    tests = schema_tests(df, schema, allowed)
    for name, pattern in (patterns or {}).items():
        tests[f"{name}: pattern"] = ~F.col(name).rlike(pattern)
    return _flagged(df, "schema", key, tests)


def duplicate_keys(df: DataFrame, key: str, table: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > 1)
    return _as_violation(counts, f"duplicate {table}.{key}", F.col(key), F.col("__n"))


def source_tests(url: str) -> dict[str, Column]:
    return {"no web address": F.col(url).isNull() | ~F.startswith(url, F.lit("http"))}


def missing_source(df: DataFrame, key: str, url: str = "url") -> DataFrame:
    bad = df.filter(source_tests(url)["no web address"])
    return _as_violation(bad, "source_url", F.col(key), F.coalesce(url, F.lit("missing")))


def invalid_dates(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Texts that are no calendar day in ``YYYY-MM-DD``."""
    tests = {
        f"{c}: invalid": F.col(c).isNotNull()
        & (~F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_date(c, "yyyy-MM-dd").isNull())
        for c in columns
    }
    return _flagged(df, "date", key, tests)


def end_before_start(tenures: DataFrame) -> DataFrame:
    bad = tenures.filter(F.col("end_date") < F.col("start_date"))
    return _as_violation(bad, "tenure_order", F.col("tenure_id"), F.col("end_date"))


def amount_tests() -> dict[str, Column]:
    measures = ("original", "updated", "actual", "estimated")

    def broken(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.isnan(v) | (F.abs(v) == F.lit(float("inf")))

    tests = {f"{c}: not finite": broken(c) for c in measures}
    zero = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) == 0, F.lit(False)) for c in measures[:3]])
    tests["unexplained zero"] = zero & (F.trim("notes") == "")
    return tests


def bad_amounts(items: DataFrame, key: str = "item_id") -> DataFrame:
    """Amounts that are no number, and zeros without a note that explains them."""
    return _flagged(items, "amount", key, amount_tests())


def rate_tests() -> dict[str, Column]:
    expected = execution_rate("actual", "estimated", "updated")
    return {
        "rate differs": F.abs(F.col("rate") - expected) > RATE_TOLERANCE,
        "outlier without marker": rate_outlier("rate") & ~F.contains("notes", F.lit(OUTLIER_MARKER)),
    }


def rate_mismatch(items: DataFrame, key: str = "item_id") -> DataFrame:
    """Stored rates that differ from the formula, and outliers without their marker."""
    return _flagged(items, "rate", key, rate_tests())


def leaf_under_leaf(items: DataFrame) -> DataFrame:
    """Leaves whose parent is marked a leaf too — the shape that counts money twice."""
    by = ["section_id", "fiscal_year"]
    leaves = items.filter("is_leaf")
    parents = leaves.select(*by, F.col("code").alias("parent_code")).distinct()
    bad = leaves.join(parents, [*by, "parent_code"], "left_semi")
    return _as_violation(bad, "leaf_under_leaf", F.col("item_id"), F.col("parent_code"))


def dangling(df: DataFrame, key: str, column: str, target: DataFrame, target_key: str, check: str) -> DataFrame:
    """Ids (single or in an array) that the target table does not hold."""
    if isinstance(df.schema[column].dataType, ArrayType):
        refs = df.select(F.col(key).alias("__key"), F.explode(column).alias("__ref"))
    else:
        refs = df.select(F.col(key).alias("__key"), F.col(column).alias("__ref")).filter(F.col("__ref").isNotNull())
    known = target.select(F.col(target_key).alias("__ref")).distinct()
    lost = refs.join(known, "__ref", "left_anti")
    return _as_violation(lost, check, F.col("__key"), F.col("__ref"))


def topic_count_mismatch(topics: DataFrame, activities: DataFrame) -> DataFrame:
    """Stored topic counts against the items that carry the topic."""
    actual = activities.select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("__n"))
    joined = topics.join(actual, "topic", "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    bad = joined.filter(F.col("item_count") != F.col("__n"))
    return _as_violation(bad, "topic_count", F.col("topic"), F.concat_ws("/", "item_count", "__n"))


def uncovered_hosts(df: DataFrame, key: str, url: str, catalogue: DataFrame) -> DataFrame:
    """Rows whose host the catalogue lists neither itself nor by a parent domain.

    Hosts are compared once each; a parent is found by meeting every suffix of the host, so
    the comparison is an equi-join and not hosts × catalogue.
    """
    listed = catalogue.select(F.regexp_replace(url_host("url"), r"^www\.", "").alias("__domain")).distinct()
    hosts = df.select(url_host(url).alias("__host")).filter(F.col("__host").isNotNull()).distinct()
    parts = F.split("__host", r"\.")
    tails = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."),
    )
    covered = (
        hosts.select("__host", F.explode(tails).alias("__domain"))
        .join(listed, "__domain", "left_semi")
        .select("__host")
        .distinct()
    )
    whole = catalogue.select(url_host("url").alias("__host")).distinct()
    bad = hosts.join(covered, "__host", "left_anti").join(whole, "__host", "left_anti")
    rows = df.withColumn("__host", url_host(url)).join(bad, "__host", "left_semi")
    return _as_violation(rows, "host", F.col(key), F.col("__host"))


def coverage_mismatch(coverage: DataFrame, actual: DataFrame) -> DataFrame:
    """Stored coverage counters against recounted ones; and gaps without a stated limitation."""
    counters = ("sources", "retrieved", "budget_records", "activities")
    renamed = actual.select("section_id", *[F.col(c).alias(f"__{c}") for c in counters])
    joined = coverage.join(renamed, "section_id", "left")
    tests = {f"{c} differs": F.col(c) != F.coalesce(f"__{c}", F.lit(0)) for c in counters}
    tests["more retrieved than defined"] = F.col("retrieved") > F.col("sources")
    tests["no budget and no limitation"] = (F.col("budget_records") == 0) & (F.size("limitations") == 0)
    return _flagged(joined, "coverage", "section_id", tests)


def sections_without_coverage(sections: DataFrame, coverage: DataFrame) -> DataFrame:
    lost = sections.join(coverage.select("section_id"), "section_id", "left_anti")
    return _as_violation(lost, "coverage_missing", F.col("section_id"), F.lit("no row"))


def usage_violations(usage: DataFrame, usage_coverage: DataFrame, sections: DataFrame, current_year: int) -> DataFrame:
    """Unknown sections, classified sums over the section's own, odd percents, sums that differ."""
    key = ["section_id", "fiscal_year"]
    sums = usage.groupBy(*key).agg(F.sum(F.coalesce("revised", F.lit(0))).alias("__sum"))
    joined = usage_coverage.join(sums, key, "left").withColumn(
        "__key", F.concat_ws("/", *key)
    )
    is_open = F.col("fiscal_year") >= current_year
    factor = F.when(is_open, F.lit(OPEN_OVERSHOOT)).otherwise(F.lit(CLOSED_OVERSHOOT))
    most = F.when(is_open, F.lit(OPEN_PERCENT_MAX)).otherwise(F.lit(CLOSED_PERCENT_MAX))
    total, percent = F.col("section_total"), F.col("coverage_percent")
    tests = {
        "over section total": (total > 0) & (F.col("classified_sum") > total * factor),
        "implausible percent": (percent < 0) | (percent > most),
        "sum differs": F.abs(F.coalesce("__sum", F.lit(0)) - F.col("classified_sum")) > 1,
    }
    unknown = dangling(
        usage.withColumn("__key", F.concat_ws("/", *key, "econ1", "econ2")),
        "__key", "section_id", sections, "section_id", "usage_section",
    )
    return _flagged(joined, "usage", "__key", tests).unionByName(unknown)


def theme_violations(
    themes: DataFrame, assignments: DataFrame, items: DataFrame, sections: DataFrame
) -> DataFrame:
    """Unknown themes or sections, lines not assigned, retitled lines, wrong counts."""
    covered = assignments.select("section_id").distinct()
    lines = (
        items.filter(F.col("level").isin(2, 3))
        .join(covered, "section_id", "left_semi")
        .groupBy("section_id", "code")
        .agg(F.max_by("title", "fiscal_year").alias("title"))
    )
    keys = ["section_id", "code"]
    problems = reconcile_keys(assignments, lines, keys).filter(F.col("reason").isin("missing", "retitled"))
    keyed = assignments.withColumn("__key", F.concat_ws(":", *keys))
    counts = assignments.groupBy("theme_id").agg(F.count("*").alias("__n"))
    stored = themes.join(counts, "theme_id", "left").filter(
        F.col("line_count") != F.coalesce("__n", F.lit(0))
    )
    return _union(
        [
            dangling(keyed, "__key", "theme_id", themes, "theme_id", "theme_unknown"),
            dangling(keyed, "__key", "section_id", sections, "section_id", "theme_section"),
            _as_violation(problems, "theme_line", F.concat_ws(":", *keys), F.col("reason")),
            _as_violation(stored, "theme_count", F.col("theme_id"), F.col("line_count")),
        ]
    )


def finding_violations(findings: DataFrame, rules: tuple, sections: DataFrame) -> DataFrame:
    """Findings of an unknown rule or an unknown section."""
    keyed = findings.withColumn("__key", F.concat_ws(":", "rule_id", "code", "year"))
    unknown = keyed.filter(~F.col("rule_id").isin(*rules))
    return _as_violation(unknown, "finding_rule", F.col("__key"), F.col("rule_id")).unionByName(
        dangling(keyed, "__key", "section_id", sections, "section_id", "finding_section")
    )


def total_violations(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """Declared totals (``name``: a method, or ``entries`` for all; ``declared``) against the rows."""
    methods = entries.groupBy("method").agg(F.count("*").alias("__n"))
    held = methods.filter(F.col("method").isNotNull()).withColumnRenamed("method", "name").unionByName(
        methods.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__n")).withColumn("name", F.lit("entries"))
    )
    said, found = F.coalesce("declared", F.lit(0)), F.coalesce("__n", F.lit(0))
    wrong = totals.join(held, "name", "full_outer").filter(said != found)
    return _as_violation(wrong, "entry_total", F.col("name"), F.concat_ws("/", said, found))


def shard_violations(
    entries: DataFrame, publications: DataFrame, index: DataFrame, window_start: str, shard: str = "section_id",
    totals: DataFrame | None = None,
) -> DataFrame:
    """Shard and publication counts, duplicate ids, unknown publications, rows before the window,
    and the declared totals by method and overall where they are given."""
    held = entries.groupBy(F.coalesce(F.col(shard).cast("string"), F.lit("unattributed")).alias("shard_key")).agg(
        F.count("*").alias("__n")
    )
    shards = index.join(held, "shard_key", "full_outer").filter(
        F.coalesce("entry_count", F.lit(0)) != F.coalesce("__n", F.lit(0))
    )
    per_dataset = entries.groupBy("dataset_id").agg(F.count("*").alias("__n"))
    datasets = publications.join(per_dataset, "dataset_id", "left").filter(
        F.col("readable_entries") != F.coalesce("__n", F.lit(0))
    )
    early = entries.filter(F.col("date") < F.lit(window_start).cast("date"))
    methods = entries.filter(F.col("method").isNull() | ~F.col("method").isin("datastore", "spreadsheet", "pdf_text", "pdf_ocr"))
    return _union(
        [
            _as_violation(shards, "shard_count", F.col("shard_key"), F.concat_ws("/", "entry_count", "__n")),
            duplicate_keys(entries, "entry_id", "entries"),
            dangling(entries, "entry_id", "dataset_id", publications, "dataset_id", "entry_publication"),
            _as_violation(datasets, "publication_count", F.col("dataset_id"), F.col("readable_entries")),
            _as_violation(early, "entry_window", F.col("entry_id"), F.col("date")),
            _as_violation(methods, "entry_method", F.col("entry_id"), F.coalesce("method", F.lit("missing"))),
            *([total_violations(entries, totals)] if totals is not None else []),
        ]
    )


def keyword_tests() -> dict[str, Column]:
    keyword = F.coalesce("matched_keyword", F.lit("")) != ""
    fallback = F.col("category").isin(*PURE_FALLBACKS)
    return {
        "no category": F.col("category").isNull(),
        "fallback with keyword": fallback & F.col("matched_keyword").isNotNull(),
        "content without keyword": ~fallback & (F.col("category") != "unspecified") & ~keyword,
        "inference not low": F.col("inferred_from").isNotNull()
        & (F.coalesce("matched_confidence", F.lit("")) != "low"),
        "keyword and confidence differ": keyword != F.col("matched_confidence").isNotNull(),
    }


def category_violations(entries: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows without a known category, counts that differ, keyword and confidence that do not agree."""
    tests = keyword_tests()
    counts = entries.groupBy("category").agg(F.count("*").alias("__n"))
    stored = categories.join(counts, "category", "left").filter(
        F.col("entry_count") != F.coalesce("__n", F.lit(0))
    )
    return _union(
        [
            _flagged(entries, "category", "entry_id", tests),
            dangling(entries, "entry_id", "category", categories, "category", "category_unknown"),
            _as_violation(stored, "category_count", F.col("category"), F.col("entry_count")),
        ]
    )


def profile_violations(profiles: DataFrame, findings: DataFrame, shares: DataFrame, entries: DataFrame) -> DataFrame:
    """Findings of files with several people, names on such files, shares and sums that do not close."""
    shared = profiles.filter("covers_multiple")
    personal = findings.join(shared.select("person_key"), "person_key", "left_semi")
    named = shared.filter(F.col("person_label").isNotNull())
    parts = ("classified_percent", "no_topic_percent", "unclassified_percent", "unspecified_percent", "no_subject_percent")
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    open_shares = shares.withColumn("__sum", total).filter(
        (F.col("entries") > 0) & (F.abs(F.col("__sum") - 100.0) > SHARE_TOLERANCE)
    )
    sums = profiles.agg(F.coalesce(F.sum("entry_count"), F.lit(0)).alias("__profiles"))
    rows = entries.agg(F.count("*").alias("__rows"))
    unequal = sums.join(F.broadcast(rows), F.lit(True)).filter(F.col("__profiles") != F.col("__rows"))
    return _union(
        [
            _as_violation(personal, "finding_shared_file", F.col("person_key"), F.col("rule_id")),
            _as_violation(named, "named_shared_file", F.col("person_key"), F.col("person_label")),
            _as_violation(open_shares, "share_sum", F.lit("corpus"), F.col("__sum")),
            _as_violation(unequal, "profile_sum", F.lit("corpus"), F.concat_ws("/", "__profiles", "__rows")),
        ]
    )


def leaf_sum_violations(items: DataFrame, measure: str = "updated", tolerance: float = 1.0) -> DataFrame:
    """Section-years whose leaves do not add up to their level-1 lines."""
    value = F.coalesce(F.col(measure), F.lit(0))
    root = F.col("level") == 1
    sums = items.groupBy("section_id", "fiscal_year").agg(
        F.sum(F.when(root, value).otherwise(F.lit(0))).alias("__root"),
        F.sum(F.when(F.col("is_leaf"), value).otherwise(F.lit(0))).alias("__leaf"),
        F.count_if(root).alias("__roots"),
        F.count_if("is_leaf").alias("__leaves"),
    )
    bad = sums.filter(
        (F.col("__roots") > 0) & (F.col("__leaves") > 0) & (F.abs(F.col("__root") - F.col("__leaf")) >= tolerance)
    )
    return _as_violation(
        bad, "leaf_sum", F.concat_ws("/", "section_id", "fiscal_year"), F.col("__root") - F.col("__leaf")
    )


def open_year_tests(items: DataFrame, current_year: int) -> dict[str, Column]:
    is_open = F.col("fiscal_year") >= current_year
    tests = {
        "open year final": is_open & (F.col("status") == "final"),
        "open year actual": is_open & F.col("actual").isNotNull(),
    }
    if "currency" in items.columns:
        tests["currency"] = F.col("currency") != "ILS"
    if "unit" in items.columns:
        tests["unit"] = ~F.col("unit").isin("ILS", "ILS_thousands")
    return tests


def honesty_violations(activities: DataFrame, items: DataFrame, window_start: str, current_year: int) -> DataFrame:
    """Activities before the window, open years shown as final or actual, odd unit or currency."""
    early = activities.filter(F.col("date") < F.lit(window_start).cast("date"))
    tests = open_year_tests(items, current_year)
    return _flagged(items, "honesty", "item_id", tests).unionByName(
        _as_violation(early, "activity_window", F.col("id"), F.col("date"))
    )


def run_checks(checks: dict[str, DataFrame]) -> DataFrame:
    """All violations of all checks, each tagged with the group it belongs to."""
    return _union([df.withColumn("group", F.lit(name)) for name, df in checks.items()])


def violation_counts(checks: dict[str, DataFrame]) -> DataFrame:
    """Violations per group, groups without one included."""
    found = run_checks(checks).groupBy("group").agg(F.count("*").alias("n"))
    first = next(iter(checks.values()))
    names = first.sparkSession.createDataFrame([(n,) for n in checks], "group string")
    return names.join(found, "group", "left").select("group", F.coalesce("n", F.lit(0)).alias("violations"))


def gate(checks: dict[str, DataFrame]) -> None:
    """Stop publication when any check found something; shows the first few."""
    first = run_checks(checks).limit(10).collect()
    if first:
        raise GateFailed("; ".join(f"{r['group']}/{r['check']}: {r['key']} ({r['detail']})" for r in first))

