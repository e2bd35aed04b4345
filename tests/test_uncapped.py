"""Nothing is cut: more groups, levels, names and methods than any list would show."""

import pytest
from pyspark.sql import functions as F

from publedger import session
from publedger.operators import classify, contracts, hierarchy, matching, spending
from publedger.operators.common import first_per_group, middle_values
from publedger.sources.sinks import write_csv
from publedger.sources.tables import one_header, read_csv_grid


def test_categories_are_numbered_without_a_cap_and_refused_at_the_limit(spark):
    existing = spark.createDataFrame([("kept", 7)], "category string, priority int")
    proposed = spark.range(1001).select(
        F.lit("e1").alias("expert"), F.format_string("c%04d", "id").alias("category"), F.lit("l").alias("label"), F.lit("d").alias("description")
    )
    rows = classify.merge_categories(existing, proposed, limit=10_000).collect()
    assert len(rows) == 1001 and max(r["priority"] for r in rows) == 1008
    with pytest.raises(Exception, match="no priority is left"):
        classify.merge_categories(existing, proposed).collect()


def test_volatility_ranks_every_section(spark):
    items = spark.range(1001).select(
        F.col("id").cast("string").alias("section_id"), F.lit(2020).alias("fiscal_year"), F.lit(True).alias("is_leaf"),
        F.lit(100.0).alias("original"), (F.col("id") + 100.0).alias("updated"),
    )
    assert spending.volatility_ranking(items, 2020).agg(F.max("position")).first()[0] == 1001


def test_paths_reach_the_root_of_deep_trees(spark):
    chain = [("s", 2020, str(k), f"t{k}", str(k - 1) if k else None) for k in range(7)]
    rows = hierarchy.hierarchy_path(spark.createDataFrame(chain, "section_id string, fiscal_year int, code string, title string, parent_code string"))
    assert {r["code"]: r["path"] for r in rows.collect()}["6"] == [f"t{k}" for k in range(7)]
    with pytest.raises(ValueError, match="deeper"):
        hierarchy.hierarchy_path(rows.drop("path"), most=3)


def test_all_methods_count(spark):
    rows = [("s", f"m{k}", 1 + k) for k in range(40)]
    table = spark.createDataFrame(rows, "section_id string, method string, volume long")
    assert contracts.method_mix(table).agg(F.sum("total_volume")).first()[0] == sum(r[2] for r in rows)
    assert contracts.method_mix(table, raw_methods=30).count() == 30


def test_every_supplier_is_looked_for(spark):
    deals = [("s", f"vendor number {k:02d} ltd", f"e{k}", "co", 1000 - k, 0) for k in range(20)]
    suppliers = contracts.supplier_totals(
        spark.createDataFrame(deals, "section_id string, supplier string, entity_id string, entity_kind string, volume long, executed long")
    )
    assert suppliers.count() == 20


def test_names_that_share_their_beginning_meet_only_their_texts(spark):
    names = spark.range(2000).select(F.format_string("municipal-%05d", "id").alias("needle"))
    texts = spark.range(0, 2000, 40).select("id", F.col("id").alias("text_id"), F.format_string("visit to municipal-%05d today", "id").alias("text"))
    pairs = matching.substring_matches(texts, names).collect()
    assert {(r["text_id"], r["needle"]) for r in pairs} == {(k, f"municipal-{k:05d}") for k in range(0, 2000, 40)}


def test_short_and_long_needles_are_found(spark):
    texts = spark.createDataFrame([(1, "ab cd efgh ijkl mnop"), (2, "zzabz"), (3, "a"), (4, "")], "text_id long, text string")
    needles = spark.createDataFrame([("a",), ("ab",), ("abc",), ("cd efgh ijkl",), ("efgh i",), ("zzabz",), ("q",)], "needle string")
    found = {(r["text_id"], r["needle"]) for r in matching.substring_matches(texts, needles, min_length=1).collect()}
    every = {(i, n) for i, t in texts.collect() for (n,) in needles.collect() if n in t}
    assert found == every


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_median_of_a_heavy_tail_is_exact_in_its_own_type(spark):
    values = [*range(1, 2001), 2**53 + 1, 2**60, 2**61]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7), ("b", None)], "g string, v long")
    found = {r["g"]: (r["n"], r["lo"], r["hi"]) for r in middle_values(df, ["g"], "v").collect()}
    assert found == {"a": (2003, 1002.0, 1002.0), "b": (1, 7.0, 7.0)}


def test_first_rows_of_a_group_spread_over_many_tasks(spark):
    df = spark.range(5000).select(F.lit("hot").alias("g"), "id").repartition(16)
    kept = first_per_group(df, ["g"], [F.desc("id")], 300, rank="place").collect()
    assert sorted((r["place"], r["id"]) for r in kept) == [(k + 1, 4999 - k) for k in range(300)]


def test_header_of_several_part_files_is_kept_once(spark, tmp_path):
    write_csv(spark.range(9).select("id", F.lit("x").alias("text")).repartition(3), str(tmp_path / "grid"))
    grid = one_header(read_csv_grid(spark, str(tmp_path / "grid")), ["id", "text"])
    assert sorted(r[0] for r in grid.collect()) == [*map(str, range(9)), "id"]
