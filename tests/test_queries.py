"""A selection of registered queries beside their check SQL, and both batch runs.

``python tests/compare.py`` runs all of them; this keeps the suite short.
"""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from publedger.operators import contracts, matching, quality
from publedger import plans
from publedger.plans import calendars, lifecycle, registry
from publedger.sources import bindings as b
from tests.compare import difference, duck

FOLDER = "/root/testdata/sf0.001"
CHOSEN = (
    "h4_sum_no_double_count", "a10_volatility", "a21_procurement_index", "n7_scan_anomalies", "w2_rank_anomalies",
    "c3_person_profile", "c8_double_booked", "u2_publication_gaps", "w5_dedupe_counts", "j6_attribute_window",
    "j7_cross_reference", "j8_timing_summary", "x3_classify_subject", "t20_html_links", "t24_grid_report", "q13_usage_violations",
)


@pytest.fixture(scope="module")
def tables():
    return duck(FOLDER)


def test_every_query_of_the_library_has_a_check():
    plans.load()
    assert registry.QUERIES.keys() == registry.ORACLE.keys()
    assert registry.QUERIES.keys() <= entry.queries().keys() and registry.ORACLE.keys() <= entry.oracle_sql().keys()
    assert len(registry.QUERIES) > 250


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, tables, name):
    assert difference(spark, tables, entry.queries()[name], entry.oracle_sql()[name], FOLDER) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_refresh_and_its_gate(spark, tmp_path):
    sections = calendars.sections(spark, FOLDER)
    inputs = [
        b.raw_budget(spark, FOLDER), b.usage_lines(spark, FOLDER), b.regulations(spark, FOLDER),
        b.contracts(spark, FOLDER), b.payments(spark, FOLDER),
    ]
    # Lines without a title are dropped, so what is left does not add up and the gate says so.
    with pytest.raises(quality.GateFailed, match="leaf"):
        lifecycle.refresh(*inputs, sections, b.YEARS, 2001, publish_to=str(tmp_path / "untitled"))
    assert not (tmp_path / "untitled").exists()
    inputs[0] = inputs[0].withColumn("title", F.when(F.trim("title") == "", F.col("code")).otherwise(F.col("title")))
    out = lifecycle.refresh(*inputs, sections, b.YEARS, 2001, publish_to=str(tmp_path / "whole"))
    assert out["items"].count() > 0 and out["procurement"].count() > 0
    assert {p.name for p in (tmp_path / "whole").iterdir()} == set(out)
    assert spark.read.parquet(str(tmp_path / "whole" / "items")).count() == out["items"].count()
    with pytest.raises(quality.GateFailed):
        lifecycle.refresh(*inputs, sections.limit(1), b.YEARS, 2001)
    # A table handed in beside is held to its checks too.
    tenures = spark.createDataFrame([("t", "p", "r", "S1", "2024-02-01", "2024-01-01", "http://x")], "tenure_id string, person_name string, role string, section_id string, start_date string, end_date string, source_url string")
    with pytest.raises(quality.GateFailed, match="order"):
        lifecycle.refresh(*inputs, sections, b.YEARS, 2001, more={"tenures": tenures})


def test_diary_analysis(spark):
    pool = matching.name_pool(
        contracts.top_suppliers(b.contracts(spark, FOLDER)), contracts.support_recipients(b.payments(spark, FOLDER))
    )
    out = lifecycle.diary_analysis(
        b.diary_rows(spark, FOLDER), b.publications(spark, FOLDER), b.lexicon(spark), b.generic_terms(), b.sentinel_terms(), pool
    )
    entries = out["entries"].count()
    assert out["profiles"].groupBy().sum("entry_count").first()[0] == entries > 0
    assert {"rule_id", "value"} <= set(out["findings"].columns)
