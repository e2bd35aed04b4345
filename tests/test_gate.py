"""The gate finds a violation of every group and stops on it."""

import pytest

from publedger import schemas
from publedger.operators import gate, quality
from publedger.operators.rules import BUDGET_RULES


def table(spark, shape, rows, defaults):
    """Rows of a shape from the cells that matter."""
    full = [tuple((defaults | row).get(f.name) for f in shape.fields) for row in rows]
    for f in shape.fields:
        f.nullable = True
    return spark.createDataFrame(full, shape)


@pytest.fixture
def corpus(spark):
    """A corpus without a violation, as rows that tests may spoil."""
    item = {
        "fiscal_year": 2023, "section_id": "S1", "title": "t", "path": ["t"], "is_leaf": False, "original": 10.0, "updated": 10.0, "actual": 5.0, "rate": 50.0,
        "currency": "ILS", "unit": "ILS", "status": "final", "source_url": "http://a", "notes": "",
    }
    return {
        "sections": [{"section_id": "S1", "official_name": "o", "display_name": "d", "kind": "ministry", "aliases": [], "budget_codes": [], "source_url": "http://a"}],
        "tenures": [{"tenure_id": "t1", "person_name": "p", "role": "r", "section_id": "S1", "source_url": "http://a"}],
        "items": [item | {"item_id": "i1", "code": "1", "level": 1}, item | {"item_id": "i2", "code": "2", "parent_code": "1", "level": 2, "is_leaf": True}],
        "activities": [{"id": "a1", "section_id": "S1", "title": "t", "summary": "s", "source_type": "calendar", "url": "http://x.gov/1", "topics": ["tax"], "people": [], "organizations": [], "notes": ""}],
        "topics": [("tax", 1)],
        "catalogue": [("http://x.gov",)],
        "coverage": [("S1", 1, 1, 2, 1, [])],
        "anomalies": [(BUDGET_RULES[0][0], "1", 2023, "B1")],
        "themes": [("h1", 1)],
        "assignments": [("S1", "2", "t", "h1")],
    }


def tables(spark, rows):
    shaped = {n: table(spark, type(s)([type(f)(f.name, f.dataType, f.nullable) for f in s.fields]), rows[n], {}) for n, (s, _) in gate.SHAPES.items() if n in rows}
    return shaped | {
        "topics": spark.createDataFrame(rows["topics"], "topic string, item_count long"),
        "catalogue": spark.createDataFrame(rows["catalogue"], "url string"),
        "coverage": spark.createDataFrame(rows["coverage"], "section_id string, sources int, retrieved int, budget_records int, activities int, limitations array<string>"),
        "recount": spark.createDataFrame([("S1", 1, 1, 2, 1)], "section_id string, sources int, retrieved int, budget_records int, activities int"),
        "anomalies": spark.createDataFrame(rows["anomalies"], "rule_id string, code string, year int, section_id string"),
        "regulation_sections": spark.createDataFrame([("B1",)], "section_id string"),
        "themes": spark.createDataFrame(rows["themes"], "theme_id string, line_count long"),
        "assignments": spark.createDataFrame(rows["assignments"], "section_id string, code string, title string, theme_id string"),
    }


def test_a_clean_corpus_passes(spark, corpus):
    quality.gate(gate.all_checks(tables(spark, corpus), 2025, "2023-01-01"))


def test_every_group_is_found_and_stops(spark, corpus):
    (section,), (tenure,), (top, leaf), (activity,) = corpus["sections"], corpus["tenures"], corpus["items"], corpus["activities"]
    corpus["sections"] = [section, section | {"kind": "odd"}, section | {"section_id": "S2"}]
    corpus["tenures"] = [tenure, tenure | {"section_id": "S9", "role": ""}]
    corpus["items"] = [top, leaf | {"rate": 7.0}, leaf | {"item_id": "i3", "code": "3", "parent_code": "2", "section_id": "S1"}, leaf | {"section_id": "S8", "updated": 0.0, "title": None}]
    corpus["activities"] = [activity, activity | {"url": "ftp://y", "section_id": "S7", "topics": ["none"]}]
    corpus["topics"], corpus["coverage"] = [("tax", 5)], [("S1", 9, 10, 0, 0, [])]
    corpus["anomalies"], corpus["themes"] = [("no rule", "1", 2023, "B7")], [("h1", 4)]
    corpus["assignments"] = [("S1", "9", "t", "h2")]
    checks = gate.all_checks(tables(spark, corpus), 2025, "2023-01-01")
    found = {r["group"] for r in quality.violation_counts(checks).filter("violations > 0").collect()}
    assert found == {
        "rows of sections", "rows of tenures", "rows of items", "rows of activities", "duplicate sections", "duplicate tenures", "duplicate items", "duplicate activities",
        "items section_id", "tenures section_id", "activities section_id", "activities topics", "leaf under leaf", "leaf sums", "topic counts", "hosts", "coverage",
        "coverage missing", "findings", "themes",
    }
    for group in found:
        with pytest.raises(quality.GateFailed):
            quality.gate({group: checks[group]})


def test_row_checks_read_a_table_once(spark, corpus):
    df = tables(spark, corpus)["items"]
    plan = gate.row_violations("items", df, 2025, "2023-01-01")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_every_shape_has_row_checks(spark):
    for name, (shape, key) in gate.SHAPES.items():
        assert set(key) <= set(shape.names)
        empty = spark.createDataFrame([], shape)
        assert gate.row_violations(name, empty, 2025, "2023-01-01").count() == 0
    assert {id(s) for s, _ in gate.SHAPES.values()} >= {id(schemas.ATTEMPTS), id(schemas.USAGE)}
