"""Rule engines: budget-line anomalies and calendar findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from publedger.functions.labels import fmt_money
from publedger.functions.numbers import half_up
from publedger.operators.common import fixed_rows
from publedger.operators.matching import prior_year

MILLION = 1_000_000
# Rule ids, in the order they are tested, and whether a rule needs a closed year.
BUDGET_RULES = (
    ("executed_without_budget", True),
    ("overspend", True),
    ("unexecuted_budget", True),
    ("enacted_jump", False),
    ("in_year_reinforcement", False),
    ("reserve_executed", True),
)
DIARY_RULES = (
    "opaque_diary",
    "private_sector_heavy",
    "media_heavy",
    "publication_gap",
    "late_night_meetings",
    "weekend_meetings",
    "marathon_day",
    "double_booked",
    "supplier_meeting",
    "support_recipient_meeting",
)
RESERVE = "רזרבה"


@dataclass(frozen=True)
class AnomalyLimits:
    """Published thresholds of the budget rules."""

    executed_without_budget: float = MILLION
    overspend_ratio: float = 1.25
    overspend_excess: float = 5 * MILLION
    unexecuted: float = 10 * MILLION
    jump_ratio: float = 3
    jump_size: float = 20 * MILLION
    reinforcement_ratio: float = 3
    reinforcement_size: float = 20 * MILLION
    reserve_executed: float = MILLION
    reserve_label: str = RESERVE


@dataclass(frozen=True)
class DiaryLimits:
    """Published thresholds of the calendar rules."""

    min_rows: int = 20
    opacity: float = 50
    private_sector: float = 25
    media: float = 15
    late_night: int = 3
    weekend: int = 3
    double_booked: int = 5


def _money(c: Column) -> Column:
    return fmt_money(c, "full")


def scan_anomalies(lines: DataFrame, closed_year_max: int, limits: AnomalyLimits = AnomalyLimits()) -> DataFrame:
    """One row per line and rule that holds, with the numbers that satisfied the rule.

    ``lines``: section_id, code, title, year, econ2, allocated, revised, executed. All rules are
    tested in one pass over the lines; only the year-over-year rule needs a self-join.
    """
    rows = prior_year(lines, ["allocated"])
    closed = F.col("year") <= closed_year_max
    allocated, revised, executed = F.col("allocated"), F.col("revised"), F.col("executed")
    prior = F.col("prior_allocated")
    jump, excess, added = F.abs(allocated - prior), executed - revised, revised - allocated
    tests = {
        "executed_without_budget": closed & (revised == 0) & (executed > limits.executed_without_budget),
        "overspend": closed
        & (revised > 0)
        & (executed > revised * limits.overspend_ratio)
        & (excess > limits.overspend_excess),
        "unexecuted_budget": closed & (revised > limits.unexecuted) & (executed == 0),
        "enacted_jump": (prior > 0) & (jump > prior * limits.jump_ratio) & (jump > limits.jump_size),
        "in_year_reinforcement": (allocated > 0)
        & (added > allocated * limits.reinforcement_ratio)
        & (added > limits.reinforcement_size),
        "reserve_executed": closed
        & (F.col("econ2") == limits.reserve_label)
        & (executed > limits.reserve_executed),
    }
    evidence = {
        "executed_without_budget": F.concat(F.lit("executed "), _money(executed), F.lit(" against zero")),
        "overspend": F.concat(F.lit("executed "), _money(executed), F.lit(" against "), _money(revised)),
        "unexecuted_budget": F.concat(F.lit("revised "), _money(revised), F.lit(", executed zero")),
        "enacted_jump": F.concat(F.lit("allocated "), _money(prior), F.lit(" then "), _money(allocated)),
        "in_year_reinforcement": F.concat(F.lit("from "), _money(allocated), F.lit(" to "), _money(revised)),
        "reserve_executed": F.concat(F.lit("executed "), _money(executed), F.lit(" out of a reserve")),
    }
    fired = F.array_compact(
        F.array(
            *[
                F.when(tests[rule], F.struct(F.lit(rule).alias("rule_id"), evidence[rule].alias("evidence")))
                for rule, _ in BUDGET_RULES
            ]
        )
    )
    hits = rows.withColumn("__fired", fired).filter(F.size("__fired") > 0)
    return hits.select(
        "section_id",
        "code",
        "title",
        "year",
        "econ2",
        "allocated",
        "revised",
        "executed",
        F.inline("__fired"),
        F.abs(F.coalesce(executed, revised, F.lit(0))).alias("sort_value"),
    )


def sorted_findings(findings: DataFrame) -> DataFrame:
    """Findings by the size of the money they are about, largest first."""
    return findings.orderBy(F.desc("sort_value"), "section_id", "code", "year", "rule_id")


def scanned_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("section_id").agg(F.count("*").alias("scanned"))


def rule_hygiene(findings: DataFrame, scanned: DataFrame) -> DataFrame:
    """How often each rule fires per 1,000 scanned lines, rules without a finding included."""
    rules = fixed_rows(findings, list(BUDGET_RULES), "rule_id string, closed_years_only boolean")
    counts = findings.groupBy("rule_id").agg(
        F.count("*").alias("finding_count"), F.countDistinct("section_id").alias("sections_affected")
    )
    total = scanned.agg(F.coalesce(F.sum("scanned"), F.lit(0)).alias("scanned_count"))
    n = F.coalesce("finding_count", F.lit(0))
    rate = half_up(F.try_divide(n.cast("double"), F.col("scanned_count").cast("double")) * 1000.0, 1)
    return (
        rules.join(counts, "rule_id", "left")
        .join(F.broadcast(total), F.lit(True))
        .select(
            "rule_id",
            "closed_years_only",
            n.alias("finding_count"),
            "scanned_count",
            rate.alias("rate_per_thousand"),
            F.coalesce("sections_affected", F.lit(0)).alias("sections_affected"),
        )
    )


def diary_findings(profiles: DataFrame, gaps: DataFrame, limits: DiaryLimits = DiaryLimits()) -> DataFrame:
    """Findings about one person's calendar; files that hold several people give none.

    ``profiles`` come from ``calendar.full_profile`` and ``gaps`` from ``sets.publication_gaps``.
    """
    missing = gaps.filter(~F.col("unread")).groupBy("person_key").agg(F.count("*").alias("missing_quarters"))
    rows = profiles.filter(~F.col("covers_multiple")).join(missing, "person_key", "left")
    enough = F.col("entry_count") >= limits.min_rows

    def share(c: str) -> Column:
        return F.col(c) / F.col("entry_count") * 100.0

    def finding(rule: str, test: Column, value: Column) -> Column:
        return F.when(test, F.struct(F.lit(rule).alias("rule_id"), value.cast("double").alias("value")))

    private, media = share("private_sector_count"), share("media_count")
    fired = F.array(
        finding("opaque_diary", enough & (F.col("opacity_percent") >= limits.opacity), F.col("opacity_percent")),
        finding("private_sector_heavy", enough & (private >= limits.private_sector), half_up(private, 1)),
        finding("media_heavy", enough & (media >= limits.media), half_up(media, 1)),
        finding("publication_gap", F.col("missing_quarters") > 0, F.col("missing_quarters")),
        finding("late_night_meetings", F.col("late_night_count") >= limits.late_night, F.col("late_night_count")),
        finding("weekend_meetings", F.col("weekend_count") >= limits.weekend, F.col("weekend_count")),
        finding("marathon_day", F.col("marathon_count") > 0, F.col("marathon_count")),
        finding("double_booked", F.col("double_booked_count") >= limits.double_booked, F.col("double_booked_count")),
    )
    return rows.select(
        "person_key", "section_id", "person_label", "role_label", F.inline(F.array_compact(fired))
    )


def match_findings(matches: DataFrame, kind: str) -> DataFrame:
    """One finding per match of a kind (``supplier`` or ``support``), valued by its amount."""
    return matches.filter(F.col("kind") == kind).select(
        "rule_id", "entry_id", "person_key", "section_id", "person_label", "matched_name", "amount"
    )

