"""Measures over office calendars: load, overlap, night and weekend work, publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from publedger.functions.dates import is_weekend, minutes_of, month_of, quarter_of, usable_clock
from publedger.functions.numbers import one_decimal_percent, share_of
from publedger.functions.text import is_meeting, js_trim, person_id, person_key
from publedger.functions.titles import covers_multiple
from publedger.operators.common import first_per_group
from publedger.operators.contracts import weighted_mean

LATE_FROM_HOUR, LATE_UNTIL_HOUR = 22, 5
LONG_MEETING_MINUTES = 4 * 60
MARATHON_MEETINGS, MARATHON_SPAN_MINUTES = 12, 14 * 60
REPEATED_MIN_LENGTH, REPEATED_MIN_COUNT, REPEATED_TOP = 4, 3, 15
OPACITY_MIN_ROWS, OPACITY_TOP = 20, 12
MIX_CATEGORIES = 8

# The eight reading groups of the thirty categories.
CATEGORY_GROUPS = {
    "governing": (
        "government_cabinet",
        "knesset_legislation",
        "budget_finance",
        "legal_judicial",
        "regulation_licensing",
    ),
    "policy_field": (
        "security_emergency",
        "diplomacy",
        "local_government",
        "settlement_periphery",
        "sectoral_affairs",
        "war_recovery",
        "diaspora_jewish_world",
        "comms_telecom_regulation",
    ),
    "stakeholders": ("private_sector", "civil_society", "named_person_meeting"),
    "public_facing": ("media_pr", "ceremonies", "field_visits"),
    "internal": ("internal_management", "calendar_admin", "politics_party"),
    "travel_personal": ("travel_logistics", "religious_lifecycle", "holidays_calendar", "personal_private"),
    "no_topic": ("meeting_without_subject", "unspecified", "no_subject_recorded"),
    "unclassified": ("unclassified",),
}
SUBJECT_MATTER_GROUPS = ("governing", "policy_field", "stakeholders", "public_facing")
TRANSPARENCY_WEIGHTS = {"topic": 0.40, "clock": 0.25, "single_person": 0.20, "dated": 0.15}


def join_meta(rows: DataFrame, publications: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their publication's identity, and the count of rows without one."""
    meta = publications.select(
        "dataset_id", "section_id", "person_label", "person_role", "role_label", "title", "url"
    ).withColumn("__known", F.lit(True))
    joined = rows.join(meta, "dataset_id", "left")
    orphans = joined.agg(F.count_if(F.col("__known").isNull()).alias("orphan_rows"))
    entries = (
        joined.filter("__known")
        .drop("__known")
        .withColumn("category", F.coalesce("category", F.lit("unspecified")))
        .withColumn("person_key", person_key("section_id", "role_label", "person_label"))
    )
    return entries, orphans


def _group_expr(category: Column) -> Column:
    result = F.when(F.lit(False), F.lit(""))
    for group, categories in CATEGORY_GROUPS.items():
        result = result.when(category.isin(*categories), F.lit(group))
    return result


def category_counts(entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    return entries.groupBy(*(by or []), "category").agg(F.count("*").alias("n"))


def period_series(entries: DataFrame, grain: str, by: list[str] | None = None) -> DataFrame:
    """Dated rows per ``month`` or ``quarter`` and category."""
    period = month_of("date") if grain == "month" else quarter_of("date")
    dated = entries.filter(F.col("date").isNotNull()).withColumn("period", period)
    return dated.groupBy(*(by or []), "period", "category").agg(F.count("*").alias("n"))


def clock_columns(entries: DataFrame) -> DataFrame:
    """``usable``, ``start_min`` and ``end_min``; the minutes are null when not usable."""
    usable = usable_clock()
    return (
        entries.withColumn("usable", usable)
        .withColumn("start_min", F.when(usable, minutes_of("start_time")))
        .withColumn("end_min", F.when(usable, minutes_of("end_time")))
    )


def _night(start: Column) -> Column:
    hour = F.floor(start / 60)
    return (hour >= LATE_FROM_HOUR) | (hour <= LATE_UNTIL_HOUR)


def weekend_counts(entries: DataFrame, by: list[str]) -> DataFrame:
    return entries.groupBy(*by).agg(*_weekend_aggregates())


def _weekend_aggregates() -> list[Column]:
    meeting = is_meeting("category")
    weekday = F.dayofweek("date")
    return [
        F.count_if(is_weekend("date") & meeting).alias("weekend_count"),
        F.count_if((weekday == 6) & meeting).alias("friday_count"),
        F.count_if((weekday == 7) & meeting).alias("saturday_count"),
        F.count_if(is_weekend("date") & ~meeting).alias("weekend_other_count"),
    ]


def late_night(entries: DataFrame, by: list[str]) -> DataFrame:
    clocked = clock_columns(entries.filter(F.col("date").isNotNull()))
    return clocked.groupBy(*by).agg(F.count_if(_night(F.col("start_min"))).alias("late_night_count"))


def long_meetings(entries: DataFrame, by: list[str]) -> DataFrame:
    clocked = clock_columns(entries.filter(F.col("date").isNotNull()))
    length = F.col("end_min") - F.col("start_min")
    return clocked.groupBy(*by).agg(F.count_if(length >= LONG_MEETING_MINUTES).alias("long_meeting_count"))


def day_measures(entries: DataFrame, by: list[str]) -> DataFrame:
    """One row per group and day: rows, meetings, timed rows and the span they cover."""
    clocked = clock_columns(entries.filter(F.col("date").isNotNull()))
    days = clocked.groupBy(*by, "date").agg(
        F.count("*").alias("rows"),
        F.count_if(is_meeting("category")).alias("meetings"),
        F.count("start_min").alias("timed"),
        (F.max(F.coalesce("end_min", "start_min")) - F.min("start_min")).alias("span"),
        F.min("seq").alias("first_seq"),
    )
    marathon = (F.col("meetings") >= MARATHON_MEETINGS) | (
        (F.col("timed") > 1) & (F.col("span") >= MARATHON_SPAN_MINUTES)
    )
    return days.withColumn("is_marathon", F.coalesce(marathon, F.lit(False)))


def marathon_days(entries: DataFrame, by: list[str]) -> DataFrame:
    return day_measures(entries, by).filter("is_marathon").select(*by, "date", "meetings", "timed", "span")


def busiest_day(entries: DataFrame, by: list[str]) -> DataFrame:
    """Day with most rows; of equal days the one seen first."""
    order = F.struct(F.col("rows"), -F.col("first_seq"))
    return day_measures(entries, by).groupBy(*by).agg(
        F.max_by("date", order).alias("busiest_date"), F.max("rows").alias("busiest_count")
    )


def double_booked(entries: DataFrame, by: list[str]) -> DataFrame:
    """Number of row pairs of one day that overlap in time, without forming the pairs.

    Overlapping pairs are all pairs less the disjoint ones, and a disjoint pair is counted
    once, at the start of its later row, among the rows that ended by then. Days are first
    reduced to counts per minute, so a day never weighs more than 1,440 rows.
    """
    clocked = clock_columns(entries.filter(F.col("date").isNotNull()))
    one = F.lit(1).cast("bigint")
    none = F.lit(0).cast("bigint")
    closed = F.col("end_min") > F.col("start_min")
    # The test stands inside the generator: as a filter it would be pushed down and have the
    # clock texts read once more.
    marks = clocked.select(
        *by,
        "date",
        F.inline(
            F.array(
                F.when(closed, F.struct(F.col("start_min").alias("minute"), one.alias("starts"), none.alias("ends"))),
                F.when(closed, F.struct(F.col("end_min").alias("minute"), none.alias("starts"), one.alias("ends"))),
            )
        ),
    ).filter(F.col("minute").isNotNull())
    minutes = marks.groupBy(*by, "date", "minute").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"))
    so_far = W.partitionBy(*by, "date").orderBy("minute").rowsBetween(W.unboundedPreceding, 0)
    disjoint = minutes.withColumn("__ended", F.sum("ends").over(so_far)).withColumn(
        "__disjoint", F.col("starts") * F.col("__ended")
    )
    days = disjoint.groupBy(*by, "date").agg(F.sum("starts").alias("__n"), F.sum("__disjoint").alias("__disjoint"))
    pairs = F.expr("__n * (__n - 1) div 2") - F.col("__disjoint")
    return days.groupBy(*by).agg(F.sum(pairs).alias("double_booked_count"))


def repeated_subjects(entries: DataFrame, by: list[str], n: int = REPEATED_TOP) -> DataFrame:
    """Subjects a group repeats, most frequent first and ties by text."""
    counted = (
        entries.withColumn("subject", js_trim("subject"))
        .filter(F.length("subject") >= REPEATED_MIN_LENGTH)
        .groupBy(*by, "subject")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= REPEATED_MIN_COUNT)
    )
    return first_per_group(counted, by, [F.desc("n"), F.col("subject")], n, rank="position")


def person_profile(entries: DataFrame) -> DataFrame:
    """Everything one pass over the rows can say of each person."""
    clocked = clock_columns(entries)
    dated = F.col("date").isNotNull()
    start = F.col("start_min")

    def of(category: str) -> Column:
        return F.count_if(F.col("category") == category)

    first = F.min_by(
        F.struct("section_id", "person_label", "person_role", "role_label", "title", "url"), F.col("seq")
    ).alias("__first")
    profile = clocked.groupBy("person_key").agg(
        first,
        F.count("*").alias("entry_count"),
        F.count("date").alias("dated_count"),
        F.count("start_time").alias("timed_count"),
        F.count_if("usable").alias("usable_count"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_distinct("dataset_id").alias("dataset_count"),
        of("unspecified").alias("unspecified_count"),
        of("no_subject_recorded").alias("no_subject_count"),
        of("unclassified").alias("unclassified_count"),
        of("private_sector").alias("private_sector_count"),
        of("media_pr").alias("media_count"),
        *_weekend_aggregates(),
        F.count_if(dated & _night(start)).alias("late_night_count"),
        F.count_if(dated & (F.col("end_min") - start >= LONG_MEETING_MINUTES)).alias("long_meeting_count"),
    )
    shared = covers_multiple(F.col("__first.title"))
    return profile.select(
        "person_key",
        "__first.section_id",
        F.when(~shared, F.col("__first.person_label")).alias("person_label"),
        "__first.person_role",
        "__first.role_label",
        "__first.title",
        "__first.url",
        shared.alias("covers_multiple"),
        *[c for c in profile.columns if c not in ("person_key", "__first")],
        share_of("unspecified_count", "entry_count").alias("opacity_percent"),
        share_of("no_subject_count", "entry_count").alias("no_subject_percent"),
        share_of("unclassified_count", "entry_count").alias("unclassified_percent"),
    )


def profile_datasets(entries: DataFrame) -> DataFrame:
    """The publications behind each profile, one row each with the rows they give."""
    named = entries.filter(F.col("dataset_id").isNotNull())
    return named.groupBy("person_key", "dataset_id").agg(F.count("*").alias("entry_count"))


def full_profile(entries: DataFrame) -> DataFrame:
    """The profile with the day measures the findings need."""
    by = ["person_key"]
    days = day_measures(entries, by)
    marathon = days.groupBy(*by).agg(
        F.count_if("is_marathon").alias("marathon_count"),
        F.max_by("date", F.struct(F.col("rows"), -F.col("first_seq"))).alias("busiest_date"),
        F.max("rows").alias("busiest_count"),
    )
    profile = person_profile(entries).join(marathon, by, "left").join(double_booked(entries, by), by, "left")
    zero = F.lit(0)
    return profile.withColumns({c: F.coalesce(c, zero) for c in ("marathon_count", "double_booked_count")})


def corpus_shares(entries: DataFrame) -> DataFrame:
    """Shares of the whole corpus by what its subjects say; together they make 100."""
    total = F.count("*")

    def share(*categories: str) -> Column:
        return share_of(F.count_if(F.col("category").isin(*categories)), total)

    outside = (
        "unclassified",
        "unspecified",
        "no_subject_recorded",
        "meeting_without_subject",
        "named_person_meeting",
    )
    return entries.agg(
        total.alias("entries"),
        share("unspecified").alias("unspecified_percent"),
        share("unclassified").alias("unclassified_percent"),
        share("meeting_without_subject", "named_person_meeting").alias("no_topic_percent"),
        share("no_subject_recorded").alias("no_subject_percent"),
        share_of(F.count_if(~F.col("category").isin(*outside)), total).alias("classified_percent"),
    )


def group_counts(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Category counts rolled up to the reading groups; unmapped categories are left out."""
    by = by or []
    mapped = counts.withColumn("reading_group", _group_expr(F.col("category"))).filter(
        F.col("reading_group").isNotNull() & (F.col("n") > 0)
    )
    members = F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("category").alias("c")))),
            lambda m: m["c"],
        ),
        ", ",
    )
    # At most thirty categories stand behind a group, so the member list stays short.
    per_category = mapped.groupBy(*by, "reading_group", "category").agg(F.sum("n").alias("n"))
    groups = per_category.groupBy(*by, "reading_group").agg(F.sum("n").alias("n"), members.alias("categories"))
    total = F.sum("n").over(W.partitionBy(*by) if by else W.partitionBy(F.lit(0)))
    return groups.withColumn("share_percent", one_decimal_percent(F.col("n"), total))


def subject_matter_share(counts: DataFrame, by: list[str]) -> DataFrame:
    """Share of rows in the four subject-matter groups among all rows of a known group."""
    group = _group_expr(F.col("category"))
    mapped = F.when(group.isNotNull(), F.col("n")).otherwise(F.lit(0))
    matter = F.when(group.isin(*SUBJECT_MATTER_GROUPS), F.col("n")).otherwise(F.lit(0))
    sums = counts.groupBy(*by).agg(F.sum(mapped).alias("classified_rows"), F.sum(matter).alias("subject_matter_rows"))
    return sums.withColumn("share_percent", share_of("subject_matter_rows", "classified_rows"))


def mix_series(entries: DataFrame, grain: str, n: int = MIX_CATEGORIES) -> DataFrame:
    """Category mix over time of the given rows, largest categories only."""
    series = period_series(entries, grain)
    largest = (
        series.groupBy("category").agg(F.sum("n").alias("__n")).orderBy(F.desc("__n"), "category").limit(n)
    )
    return series.join(largest, "category", "left_semi")


def opacity_ranking(profiles: DataFrame, n: int = OPACITY_TOP) -> DataFrame:
    return (
        profiles.filter(F.col("entry_count") >= OPACITY_MIN_ROWS)
        .orderBy(F.desc("opacity_percent"), "person_key")
        .limit(n)
    )


def section_ranking(entries: DataFrame) -> DataFrame:
    """Sections by rows, with the largest attributed one marked as the default."""
    counts = entries.groupBy("section_id").agg(F.count("*").alias("entry_count"))
    attributed = F.col("section_id").isNotNull()
    order = W.partitionBy(attributed).orderBy(F.desc("entry_count"), "section_id")
    return counts.withColumn("is_default", attributed & (F.row_number().over(order) == 1))


def person_rollup(profiles: DataFrame, entries: DataFrame, findings: DataFrame, matches: DataFrame) -> DataFrame:
    """Per person id over all of that person's profiles: rows, sections, findings, matches."""
    named = profiles.filter(F.col("person_label").isNotNull()).withColumn("person_id", person_id("person_label"))
    base = named.groupBy("person_id").agg(
        F.count("*").alias("profiles"),
        F.sum("entry_count").alias("entries"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.max("covers_multiple").alias("shared_file"),
    )
    ids = named.select("person_key", "person_id")
    counts = category_counts(entries, ["person_key"]).join(ids, "person_key")
    groups = subject_matter_share(counts, ["person_id"]).select("person_id", "share_percent")

    def per_person(df: DataFrame, name: str) -> DataFrame:
        labelled = df.filter(F.col("person_label").isNotNull())
        return labelled.groupBy(person_id("person_label").alias("person_id")).agg(F.count("*").alias(name))

    zero = F.lit(0)
    return (
        base.join(groups, "person_id", "left")
        .join(per_person(findings, "findings"), "person_id", "left")
        .join(per_person(matches, "matches"), "person_id", "left")
        .withColumns({c: F.coalesce(c, zero) for c in ("findings", "matches")})
    )


def person_mix(profiles: DataFrame, entries: DataFrame) -> DataFrame:
    """``person_id, part, name, n, share_percent``: a person's rows by reading group and by month.

    Rows are counted per profile, category and month where they are read; both parts then come from one
    pass of grouping sets over those counts. Rows of no group, or without a date, are left out of that part.
    """
    named = profiles.filter(F.col("person_label").isNotNull()).select("person_key", person_id("person_label").alias("person_id"))
    counts = entries.groupBy("person_key", "category", month_of("date").alias("month")).agg(F.count("*").alias("n"))
    keyed = counts.join(named, "person_key").select("person_id", _group_expr(F.col("category")).alias("reading_group"), "month", "n")
    person, group, month = F.col("person_id"), F.col("reading_group"), F.col("month")
    sums = keyed.groupingSets([[person, group], [person, month]], person, group, month).agg(F.grouping("month").alias("by_group"), F.sum("n").alias("n"))
    by_group = F.col("by_group") == 1
    parts = sums.select(
        "person_id", F.when(by_group, F.lit("group")).otherwise(F.lit("month")).alias("part"), F.when(by_group, group).otherwise(month).alias("name"), "n"
    ).filter(F.col("name").isNotNull())
    total = F.sum("n").over(W.partitionBy("person_id", "part"))
    return parts.withColumn("share_percent", F.when(F.col("part") == "group", one_decimal_percent(F.col("n"), total)))


def transparency_score(profiles: DataFrame) -> DataFrame:
    """How usable a section's publication is, 0–100, from four weighted parts.

    Rows our own vocabulary failed to classify still count as having a topic.
    """
    entries = F.sum("entry_count")
    with_topic = F.greatest(F.lit(0), entries - F.sum("no_subject_count") - F.sum("unspecified_count"))
    single = F.sum(F.when(F.col("covers_multiple"), F.lit(0)).otherwise(F.col("entry_count")))
    parts = profiles.groupBy("section_id").agg(
        entries.alias("entry_count"),
        F.count("*").alias("people_count"),
        share_of(with_topic, entries).alias("topic_score"),
        share_of(F.sum("usable_count"), entries).alias("clock_score"),
        share_of(single, entries).alias("single_person_score"),
        share_of(F.count_if(F.col("dated_count") > 0), F.count("*")).alias("dated_score"),
    )
    score, _ = weighted_mean([(F.col(f"{part}_score"), w) for part, w in TRANSPARENCY_WEIGHTS.items()])
    return parts.withColumn("score", score)


def publication_state(sections: DataFrame, publications: DataFrame) -> DataFrame:
    """Per section: what was published, and whether it could be read."""
    counts = publications.groupBy("section_id").agg(
        F.count("*").alias("published"), F.count_if(F.col("readable_entries") == 0).alias("unread")
    )
    joined = sections.join(counts, "section_id", "left")
    published, unread = F.coalesce("published", F.lit(0)), F.coalesce("unread", F.lit(0))
    state = (
        F.when(
            published == 0,
            F.when(F.col("kind") == "ministry", F.lit("nothing_published")).otherwise(F.lit("no_diary_expected")),
        )
        .when(published > unread, F.lit("published_and_read"))
        .otherwise(F.lit("published_not_read"))
    )
    return joined.select(
        "section_id", "kind", state.alias("state"), published.alias("published"), unread.alias("unread")
    )


def publication_matrix(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.count("*").alias("sections"))


def unread_publications(publications: DataFrame) -> DataFrame:
    """Publications without one readable row although files are listed."""
    return publications.filter((F.col("readable_entries") == 0) & (F.size("unreadable_files") > 0))


