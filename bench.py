"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
Each query is planned and run twice over its whole tables; the better time counts, so that
class loading is not charged to whichever query comes first.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from publedger.plans import load  # noqa: E402
from publedger.plans.registry import QUERIES  # noqa: E402
from publedger.session import local_session  # noqa: E402

HEADLINE = (
    "h3_normalize_budget",
    "h4_sum_no_double_count",
    "h5_aggregate_by_year",
    "h8_waterfall",
    "a8_theme_aggregates",
    "a10_volatility",
    "a11_split_by_cap",
    "a12_leading_suppliers",
    "a21_procurement_index",
    "n7_scan_anomalies",
    "w2_rank_anomalies",
    "c3_person_profile",
    "c7_marathon_days",
    "c8_double_booked",
    "d_all_diary_findings",
    "u2_publication_gaps",
    "w5_dedupe_entries",
    "j6_attribute_window",
    "j7_cross_reference",
    "j7_passages_in_documents",
    "j8_meeting_timing",
    "x1_match_topics",
    "x3_classify_subject",
    "x11_apply_inference",
    "t20_html_links",
    "t24_extract_grid",
    "t25_extract_lines",
    "s1_section_summary",
    "q13_usage_violations",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or list(HEADLINE)
    spark = local_session("bench", cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    load()
    times = {}
    for name in names:
        best = None
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            elapsed = time.perf_counter() - started
            best = elapsed if best is None else min(best, elapsed)
        times[name] = round(best, 3)
        print(f"{name}: {best:.2f}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
