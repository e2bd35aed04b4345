"""The two batch runs from end to end: the refresh with its gate, and the calendar analysis.

Each is one driver program whose stages hand DataFrames to one another. A table that feeds
several stages is written once to the shared folder, so later stages read it instead of
computing it again, also after an executor is lost. Nothing is published past a failing gate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from publedger.functions.text import person_key
from publedger.operators import calendar as cal
from publedger.operators import classify, contracts, gate, hierarchy, inference, matching, quality, ranking, rules, sets, spending
from publedger.session import cut_lineage
from publedger.sources import sinks

#: Rows before this day do not belong to the corpus of a run that names no other.
WINDOW_START = "1900-01-01"
#: A year that no calendar run has open budgets in.
OPEN_END = 9999
#: Tables that readers fetch by section.
SHARDED = ("entries", "contracts", "items")


def refresh(
    raw_budget: DataFrame,
    usage_lines: DataFrame,
    regulations: DataFrame,
    deals: DataFrame,
    payments: DataFrame,
    sections: DataFrame,
    years: list[int],
    current_year: int,
    limits: rules.AnomalyLimits = rules.AnomalyLimits(),
    more: dict[str, DataFrame] | None = None,
    window_start: str = WINDOW_START,
    publish_to: str | None = None,
) -> dict[str, DataFrame]:
    """Budget items, usage, contracts and anomalies, checked by the whole gate before they are returned.

    ``more``: further tables of the corpus (see ``gate.SHAPES`` and ``gate.table_checks``), which the gate
    checks with the others. ``publish_to``: folder the tables are written to once the gate has passed.
    """
    items = cut_lineage(hierarchy.normalize_budget(raw_budget, current_year, years), "items")
    usage, rejected = spending.usage_breakdown(usage_lines)
    usage = cut_lineage(usage, "usage")
    kept, excluded = contracts.split_by_cap(deals, items)
    kept = cut_lineage(kept, "contracts")
    findings = cut_lineage(rules.scan_anomalies(regulations, current_year - 1, limits), "anomalies")
    usage_coverage = cut_lineage(spending.usage_coverage(usage, items, years), "usage-coverage")
    tables = {
        "items": items,
        "usage": usage,
        "usage_rejected": rejected,
        "usage_coverage": usage_coverage,
        "contracts": kept,
        "contracts_excluded": excluded,
        "suppliers": contracts.top_suppliers(kept),
        "recipients": contracts.support_recipients(payments),
        "procurement": contracts.procurement_index(kept),
        "anomalies": findings,
        "hygiene": rules.rule_hygiene(findings, rules.scanned_counts(regulations)),
    }
    lines = regulations.select("section_id").distinct()
    held = {"items": items, "usage": usage, "usage_coverage": usage_coverage, "contracts": kept, "regulations": regulations}
    held |= {"anomalies": findings, "sections": sections, "regulation_sections": lines}
    quality.gate(gate.all_checks(held | (more or {}), current_year, window_start))
    if publish_to is not None:
        publish(tables, publish_to)
    return tables


def publish(tables: dict[str, DataFrame], folder: str) -> None:
    """Write every table of a run; sections that are read on their own get a folder each."""
    for name, df in tables.items():
        if name in SHARDED and "section_id" in df.columns:
            sinks.write_shards(df, "section_id", f"{folder}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


def diary_analysis(
    rows: DataFrame,
    publications: DataFrame,
    lexicon: DataFrame,
    generic: list[str],
    sentinels: list[str],
    pool: DataFrame,
    limits: rules.DiaryLimits = rules.DiaryLimits(),
    more: dict[str, DataFrame] | None = None,
    window_start: str = WINDOW_START,
    publish_to: str | None = None,
) -> dict[str, DataFrame]:
    """Join → de-duplicate → classify → infer → measure → find, for one body of calendar rows.

    ``more`` and ``publish_to`` as in :func:`refresh`.
    """
    joined, orphans = cal.join_meta(rows, publications)
    unique, dropped = ranking.dedupe_entries(joined)
    classified = cut_lineage(classify.classify_subject(unique, lexicon, generic, sentinels), "classified")
    entries = cut_lineage(inference.infer_names(classified, lexicon, publications.select("person_label")), "entries")
    profiles = cut_lineage(cal.full_profile(entries), "profiles")
    owners = publications.withColumn(
        "person_key",
        person_key("section_id", "role_label", "person_label"),
    )
    gaps = sets.publication_gaps(entries, owners.select("person_key", "period_label"))
    shares = cal.corpus_shares(entries)
    findings = cut_lineage(rules.diary_findings(profiles, gaps, limits), "findings")
    held = {"entries": entries, "profiles": profiles, "findings": findings, "shares": shares}
    quality.gate(gate.all_checks(held | (more or {}), OPEN_END, window_start))
    tables = {
        "entries": entries,
        "orphans": orphans,
        "dropped": dropped,
        "profiles": profiles,
        "gaps": gaps,
        "findings": findings,
        "matches": matching.cross_reference(entries, pool),
        "shares": shares,
        "transparency": cal.transparency_score(profiles),
    }
    if publish_to is not None:
        publish(tables, publish_to)
    return tables
