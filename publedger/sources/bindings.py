"""Domain tables derived from the star-schema test tables, one function per table.

Every binding grows with its source tables. Money is whole cents, so sums are exact. Nulls,
open years, undated rows, duplicates and unmatched names are put in on purpose, by rules over
the data's own columns, so that each operator meets the cases it has to get right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from publedger.functions.web import html_title
from publedger.operators.calendar import join_meta

LATIN = "abcdefghijklmnopqrstuvwxyz"
HEBREW = "אבגדהוזחטיכלמנסעפצקרשתאבגד"
CLOSED_YEAR_MAX = 2000
YEARS = list(range(1995, 2002))
WINDOW_START = "2022-12-29"
# A small lexicon for the derived Hebrew-letter texts (Latin spelling here).
LEXICON = (
    ("of the", "government_cabinet", 1, "high"),
    ("in the", "knesset_legislation", 2, "high"),
    ("that", "diplomacy", 3, "medium"),
    ("with", "media_pr", 4, "high"),
    ("from", "budget_finance", 5, "low"),
    ("der", "private_sector", 6, "medium"),
    ("die", "civil_society", 7, "high"),
    ("und", "field_visits", 8, "medium"),
    ("la", "ceremonies", 9, "low"),
    ("de la", "ceremonies", 9, "high"),
    ("les", "local_government", 10, "medium"),
    ("el", "local_government", 10, "low"),
    ("was", "legal_judicial", 11, "medium"),
    ("this", "legal_judicial", 11, "high"),
    ("of e", "travel_logistics", 12, "low"),
    ("|", "calendar_admin", 13, "low"),
    ("red", "internal_management", 14, "medium"),
    ("the", "meeting_without_subject", 91, "low"),
    ("and", "meeting_without_subject", 91, "medium"),
    ("is", "named_person_meeting", 92, "low"),
)
GENERIC = ("the", "of", "and the", "the the", "that it")
SENTINELS = ("von", "el")


def hebraize_text(text: str) -> str:
    return text.lower().translate(str.maketrans(LATIN, HEBREW))


def hebraize(c: Column | str) -> Column:
    """Latin letters as Hebrew letters one for one, so word rules for Hebrew apply."""
    return F.translate(F.lower(c), LATIN, HEBREW)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def _section(c: str) -> Column:
    return F.concat(F.lit("S"), F.col(c).cast("string"))


def _section_code(c: str) -> Column:
    return F.lpad((F.col(c) + 1).cast("string"), 4, "0")


def _brand_number() -> Column:
    return F.regexp_extract("p_brand", r"(\d+)", 1)


def _brand_code() -> Column:
    return F.lpad(_brand_number(), 2, "0")


def money_lines(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").withColumns(
        {
            "cents": cents("l_extendedprice"),
            "disc": cents("l_discount"),
            "tax": cents("l_tax"),
            "year": F.year("l_shipdate"),
        }
    )


def budget_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Section × brand × type × year money, the finest level of the budget."""
    updated = F.expr("cents * (100 - disc) * (100 + tax) div 10000")
    return (
        money_lines(spark, folder)
        .join(read(spark, folder, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(read(spark, folder, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("s_nationkey", "p_brand", "p_type", F.col("year").alias("fiscal_year"))
        .agg(
            F.sum("cents").alias("original"),
            F.sum(updated).alias("updated"),
            F.sum(F.when(F.col("l_linestatus") == "F", F.col("cents"))).alias("executed"),
        )
    )


def budget_items(spark: SparkSession, folder: str) -> DataFrame:
    """Three-level budget: section, brand, type. Section S24 has no leaf marked."""
    one = _section_code("s_nationkey")
    two = F.concat(one, _brand_code())
    three = F.concat(two, F.lit("-"), F.col("p_type"))
    section_title = F.concat(F.lit("Section "), F.col("s_nationkey").cast("string"))

    def node(level: int, code: Column, parent: Column, title: Column) -> Column:
        return F.struct(
            F.lit(level).alias("level"), code.alias("code"), parent.alias("parent_code"), title.alias("title")
        )

    nodes = F.array(
        node(1, one, F.lit(None).cast("string"), section_title),
        node(2, two, one, F.col("p_brand")),
        node(3, three, two, F.concat_ws(" ", "p_brand", "p_type")),
    )
    leaves = budget_leaves(spark, folder)
    unknown = (F.col("level") == 3) & F.col("code").rlike("07-SMALL$")
    is_open = F.col("fiscal_year") > CLOSED_YEAR_MAX
    summed = (
        leaves.select("s_nationkey", "fiscal_year", "original", "updated", "executed", F.inline(nodes))
        .groupBy("s_nationkey", "fiscal_year", "level", "code", "parent_code", "title")
        .agg(F.sum("original").alias("original"), F.sum("updated").alias("updated"), F.sum("executed").alias("executed"))
    )
    return summed.select(
        F.concat_ws("-", F.lit("budget"), _section("s_nationkey"), "fiscal_year", "code").alias("item_id"),
        _section("s_nationkey").alias("section_id"),
        "fiscal_year",
        "code",
        "parent_code",
        "title",
        "level",
        ((F.col("level") == 3) & (F.col("s_nationkey") != 24)).alias("is_leaf"),
        F.when(~unknown, F.col("original")).alias("original"),
        "updated",
        F.when(~is_open, F.col("executed")).alias("actual"),
        F.when(is_open, F.col("executed")).alias("estimated"),
        F.when(is_open, F.lit("estimate"))
        .when(F.col("fiscal_year") <= 1996, F.lit("final"))
        .otherwise(F.lit("partial"))
        .alias("status"),
    )


def raw_budget(spark: SparkSession, folder: str) -> DataFrame:
    """The same lines as raw text rows, some with thousands commas, some without a title."""
    items = budget_items(spark, folder)

    def text(c: str) -> Column:
        grouped = F.format_number(c, 0)
        return F.when(F.col("level") == 2, grouped).otherwise(F.col(c).cast("string"))

    return items.select(
        "section_id",
        "code",
        F.when(F.col("code").rlike("13-LARGE$"), F.lit(" ")).otherwise(F.col("title")).alias("title"),
        F.col("parent_code").alias("parent"),
        F.col("level").cast("string").alias("depth"),
        F.col("fiscal_year").cast("string").alias("year"),
        text("original").alias("net_allocated"),
        text("updated").alias("net_revised"),
        F.coalesce(F.coalesce("actual", "estimated").cast("string"), F.lit("n/a")).alias("net_executed"),
    )


def regulations(spark: SparkSession, folder: str) -> DataFrame:
    """Part × year lines; zero where nothing was revised or executed, null where never allocated."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    zero = F.lit(0).cast("bigint")
    lines = money_lines(spark, folder).groupBy("l_partkey", "year").agg(
        F.sum(F.when(flag == "A", F.col("cents"))).alias("allocated"),
        F.sum(F.when(flag != "R", F.col("cents")).otherwise(zero)).alias("revised"),
        F.sum(F.when(status == "F", F.col("cents")).otherwise(zero)).alias("executed"),
    )
    return lines.join(read(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("B"), _brand_number()).alias("section_id"),
        F.col("l_partkey").cast("string").alias("code"),
        F.col("p_name").alias("title"),
        "year",
        F.col("p_type").alias("econ2"),
        "allocated",
        "revised",
        "executed",
    )


def usage_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Economic lines; returned money is negative, and some second labels are ambiguous."""
    lines = money_lines(spark, folder).join(
        read(spark, folder, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")
    )
    sign = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), F.lit(-1)).otherwise(F.lit(1))
    return lines.select(
        _section("s_nationkey").alias("section_id"),
        F.col("year").alias("fiscal_year"),
        F.when(F.col("l_linenumber") == 7, F.lit("2")).otherwise(F.lit("1")).alias("kind"),
        F.when(F.col("l_quantity") == 50, F.lit(3)).otherwise(F.lit(4)).alias("depth"),
        (F.col("l_quantity") == 1).alias("is_proposal"),
        F.col("l_returnflag").alias("econ1"),
        F.when((F.col("tax") == 8) & (F.col("l_returnflag") == "N"), F.lit(None).cast("string"))
        .otherwise(F.col("l_linestatus"))
        .alias("econ2"),
        F.col("cents").alias("allocated"),
        (sign * F.expr("cents * (100 - disc) div 100")).cast("bigint").alias("revised"),
        F.when(F.col("l_linestatus") == "F", F.col("cents")).alias("executed"),
    )


def usage(spark: SparkSession, folder: str) -> DataFrame:
    return (
        usage_lines(spark, folder)
        .groupBy("section_id", "fiscal_year", "econ1", F.coalesce("econ2", F.lit("X")).alias("econ2"))
        .agg(
            F.sum("allocated").alias("allocated"),
            F.sum("revised").alias("revised"),
            F.sum("executed").alias("executed"),
            F.count("*").alias("line_count"),
        )
    )


def themes(spark: SparkSession, folder: str) -> DataFrame:
    """One theme per part type, and one nobody uses."""
    types = read(spark, folder, "part").select(F.concat(F.lit("T-"), F.col("p_type")).alias("theme_id")).distinct()
    return types.unionByName(spark.createDataFrame([("T-UNUSED",)], "theme_id string"))


def assignments(spark: SparkSession, folder: str) -> DataFrame:
    """Theme of each leaf code by its type; brand 9 is left unassigned, brand 8 is retitled."""
    return (
        budget_items(spark, folder)
        .filter(F.col("level") == 3)
        .select("section_id", "code", "title")
        .distinct()
        .filter(~F.col("title").startswith("Brand#9 "))
        .select(
            "section_id",
            "code",
            F.when(F.col("title").startswith("Brand#8 "), F.concat("title", F.lit("*"))).otherwise(F.col("title")).alias("title"),
            F.concat(F.lit("T-"), F.element_at(F.split("title", " "), -1)).alias("theme_id"),
        )
    )


def contracts(spark: SparkSession, folder: str) -> DataFrame:
    lines = (
        money_lines(spark, folder)
        # The small table first, so that a wish for some suppliers leaves few lines to meet their orders.
        .join(read(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(read(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    method = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("פטור ממכרז - דחוף"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None).cast("string"))
        .otherwise(F.col("o_orderpriority"))
    )
    code = F.concat(_section_code("s_nationkey"), _brand_code(), F.lit("-"), F.col("p_type"))
    return lines.select(
        _section("s_nationkey").alias("section_id"),
        F.concat_ws(
            "-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_linenumber", "l_partkey", "l_suppkey", "cents"
        ).alias("seq"),
        F.col("s_name").alias("supplier"),
        F.col("s_suppkey").cast("string").alias("entity_id"),
        F.lit("company").alias("entity_kind"),
        F.col("p_name").alias("purpose"),
        F.when(F.col("l_quantity") != 13, F.col("cents")).alias("volume"),
        F.expr("cents * (100 - disc) div 100").alias("executed"),
        F.to_date("o_orderdate").alias("order_date"),
        method.alias("method"),
        code.alias("budget_code"),
        F.col("p_type").alias("budget_title"),
    )


def payments(spark: SparkSession, folder: str) -> DataFrame:
    joined = read(spark, folder, "orders").join(
        read(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    approved = cents("o_totalprice")
    return joined.select(
        _section("c_nationkey").alias("section_id"),
        F.col("c_name").alias("recipient"),
        F.col("c_custkey").cast("string").alias("entity_id"),
        approved.alias("approved"),
        F.when(F.col("o_orderstatus") == "F", approved).alias("paid"),
        F.col("c_mktsegment").alias("title"),
        F.year("o_orderdate").alias("year"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    joined = read(spark, folder, "orders").join(
        read(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    amount = cents("o_totalprice")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return joined.select(
        _section("c_nationkey").alias("section_id"),
        F.year("o_orderdate").alias("year"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("req_title"),
        F.col("o_orderstatus").alias("change_type"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("bigint"))
        .when(urgent, amount)
        .otherwise(-amount)
        .alias("net"),
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("transaction_id"),
        F.concat(F.lit("  change \n of "), F.col("o_orderpriority"), F.lit("\t for "), F.col("c_name")).alias("explanation"),
    )


def _event_rows(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, folder, "events").withColumn("k", k)


def _clock(minutes: Column) -> Column:
    return F.concat(
        F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0")
    )


def diary_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Calendar rows out of events, before they meet their publication."""
    suppliers = read(spark, folder, "supplier").select(F.col("s_suppkey").alias("__s"), "s_name")
    customers = read(spark, folder, "customer").select(F.col("c_custkey").alias("__c"), "c_name")
    k = F.col("k")
    start = F.hour("ts") * 60 + F.minute("ts")
    end = F.least(start + F.floor(F.col("value") * 4), F.lit(1439))
    who = F.when(k < 50, F.col("s_name")).otherwise(F.col("c_name"))
    subject = (
        F.when(k == 33, F.lit("ללא נושא רשום"))
        .when(k == 34, F.lit("פגישה"))
        .otherwise(F.concat("event_type", F.lit(" with "), F.coalesce(who, F.lit("staff")), F.lit(" (HQ)")))
    )
    by_type = (
        F.when(F.col("event_type") == "error", F.lit("unspecified"))
        .when(F.col("event_type") == "click", F.lit("private_sector"))
        .when(F.col("event_type") == "purchase", F.lit("media_pr"))
        .when(F.col("event_type") == "view", F.lit("unclassified"))
        .otherwise(F.lit("government_cabinet"))
    )
    category = (
        F.when(k % 25 == 3, F.lit("meeting_without_subject"))
        .when(k == 4, F.lit(None).cast("string"))
        .when(k % 25 == 5, F.lit("no_subject_recorded"))
        .when(k % 25 == 6, F.lit("travel_logistics"))
        .when(k % 25 == 7, F.lit("holidays_calendar"))
        .when(k == 8, F.lit("mystery"))
        .otherwise(by_type)
    )
    method = F.element_at(
        F.array(*[F.lit(m) for m in ("datastore", "spreadsheet", "pdf_text", "pdf_ocr")]), k % 4 + 1
    )
    rows = (
        _event_rows(spark, folder)
        .join(suppliers, k == F.col("__s"), "left")
        .join(customers, k == F.col("__c"), "left")
    )
    return rows.select(
        F.lpad(F.col("event_id").cast("string"), 10, "0").alias("entry_id"),
        F.concat(F.lit("ds-"), F.col("user_id").cast("string")).alias("dataset_id"),
        subject.alias("subject"),
        F.when(k != 99, F.to_date("ts")).alias("date"),
        F.when(k % 10 == 9, F.lit(None).cast("string")).when(k % 10 == 7, F.lit("00:00")).otherwise(_clock(start)).alias("start_time"),
        F.when(k % 10 != 8, _clock(end)).alias("end_time"),
        F.when(k % 5 != 0, F.concat(F.lit("room "), (k % 7).cast("string"))).alias("location"),
        F.when(k % 3 != 0, F.concat(F.lit("p"), (F.col("user_id") % 11).cast("string"))).alias("participants"),
        method.alias("method"),
        category.alias("category"),
        F.col("event_id").alias("seq"),
    )


def publications(spark: SparkSession, folder: str) -> DataFrame:
    """One publication per user; every fiftieth user's is missing, some hold several people."""
    u = F.col("user_id")
    users = read(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("__n")).filter(u % 50 != 49)
    several = u % 17 == 0
    return users.select(
        F.concat(F.lit("ds-"), u.cast("string")).alias("dataset_id"),
        F.when(several, F.lit('יומן שר א ויומן מנכ"ל ב, לשנת 2024')).otherwise(F.lit("יומן שר א, פלוני, לשנת 2024 (רבעון ראשון)")).alias("title"),
        F.concat(F.lit("https://data.example.org/dataset/"), u.cast("string")).alias("url"),
        F.when(u % 10 != 9, F.concat(F.lit("S"), (u % 10).cast("string"))).alias("section_id"),
        F.when(u % 13 != 12, F.concat(F.lit("Person "), u.cast("string"))).alias("person_label"),
        F.element_at(
            F.array(*[F.lit(r) for r in ("minister", "deputy_minister", "director_general", "other_senior")]),
            (u % 4 + 1).cast("int"),
        ).alias("person_role"),
        F.concat(F.lit("role "), (u % 4).cast("string")).alias("role_label"),
        F.when(u % 7 != 0, F.lit("2024 (רבעון ראשון)")).alias("period_label"),
        F.when(u % 23 == 1, F.lit(0)).otherwise(F.col("__n")).cast("bigint").alias("readable_entries"),
        F.when(u % 5 == 0, F.array(F.lit("a.pdf"), F.lit("b.pdf"))).otherwise(F.array().cast("array<string>")).alias("unreadable_files"),
    )


def diary(spark: SparkSession, folder: str) -> DataFrame:
    """Calendar rows with their publication's identity."""
    entries, _ = join_meta(diary_rows(spark, folder), publications(spark, folder))
    return entries


def order_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as dated rows of a person, for publication gaps over several years."""
    return read(spark, folder, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("person_key"),
        F.to_date("o_orderdate").alias("date"),
    )


def order_publications(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("c_custkey")
    label = (
        F.when(c % 4 == 0, F.lit("1997 (רבעון שני ושלישי)"))
        .when(c % 4 == 1, F.lit("לשנת 1998"))
        .when(c % 4 == 2, F.lit("רבעון ראשון"))
    )
    return read(spark, folder, "customer").select(
        F.concat(F.lit("C"), c.cast("string")).alias("person_key"), label.alias("period_label")
    )


def tenures(spark: SparkSession, folder: str) -> DataFrame:
    spans = read(spark, folder, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("__from"), F.max("o_orderdate").alias("__to")
    )
    c = F.col("c_custkey")
    return spans.join(read(spark, folder, "customer"), F.col("o_custkey") == c).select(
        F.concat(F.lit("T"), F.lpad(c.cast("string"), 9, "0")).alias("tenure_id"),
        F.concat(F.lit("Holder "), (c % 400).cast("string")).alias("person_name"),
        F.concat(F.lit("role "), (c % 3).cast("string")).alias("role"),
        _section("c_nationkey").alias("section_id"),
        F.when(c % 97 != 0, F.to_date("__from")).alias("start_date"),
        F.when(F.col("c_acctbal") >= 0, F.to_date("__to")).alias("end_date"),
    )


def tenure_windows(spark: SparkSession, folder: str) -> DataFrame:
    years = F.explode(F.array(*[F.lit(y) for y in YEARS]))
    return tenures(spark, folder).select("section_id").distinct().select("section_id", years.alias("y")).select(
        "section_id",
        F.make_date(F.col("y"), F.lit(1), F.lit(1)).alias("window_start"),
        F.make_date(F.col("y"), F.lit(12), F.lit(31)).alias("window_end"),
    )


def activities(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("doc_id")
    none = F.array().cast("array<string>")
    return read(spark, folder, "documents").select(
        F.concat(F.lit("act-"), d.cast("string")).alias("id"),
        F.concat(F.lit("S"), (d % 10).cast("string")).alias("section_id"),
        F.when(d % 29 != 0, F.date_add(F.lit("2022-01-01").cast("date"), (d * 7 % 1400).cast("int"))).alias("date"),
        F.element_at(F.array(F.lit("decisions"), F.lit("publications"), F.lit("bids")), (d % 3 + 1).cast("int")).alias("feed"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("summary"),
        F.element_at(
            F.array(F.lit("policy_document"), F.lit("government_page"), F.lit("other_official")), (d % 3 + 1).cast("int")
        ).alias("source_type"),
        F.concat(F.lit("https://www."), "source", F.lit(".example.org/"), (F.col("n_chars") % 50).cast("string")).alias("url"),
        F.when(F.col("n_chars") > 2000, F.array(F.col("lang"), F.lit("long"))).otherwise(F.array("lang")).alias("topics"),
        F.when(d % 2 == 0, F.array(F.concat(F.lit("P"), (d % 7).cast("string")))).otherwise(none).alias("people"),
        F.when(d % 3 == 0, F.array(F.concat(F.lit("O"), (d % 5).cast("string")))).otherwise(none).alias("organizations"),
        F.concat(F.lit("note "), d.cast("string")).alias("notes"),
        d.alias("seq"),
    )


def gov_url(c: Column | str) -> Column:
    """Example addresses moved to the hosts the source rules know."""
    text = F.col(c) if isinstance(c, str) else c
    for example, host in (
        ("example.com", "knesset.gov.il"),
        ("example.net", "data.gov.il"),
        ("example.org", "obudget.org"),
        ("/en/7", "/News/PressReleases/7"),
        ("/en/8", "/Budget2024-Health/8"),
    ):
        text = F.replace(text, F.lit(example), F.lit(host))
    return text


def sources(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("page_id")
    return read(spark, folder, "pages").select(
        p.alias("seq"),
        gov_url("url").alias("url"),
        html_title("html").alias("title"),
        F.when(p % 3 == 0, F.lit("retrieved"))
        .when(p % 3 == 1, F.lit("not_retrieved_error"))
        .otherwise(F.lit("not_retrieved_egress_blocked"))
        .alias("retrieval_status"),
    )


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Sources with sections and years by page number, as the catalogue would hold them."""
    p = F.col("seq")
    none = F.array().cast("array<string>")
    return sources(spark, folder).select(
        "*",
        F.concat(F.lit("pub-"), (p % 6).cast("string")).alias("publisher"),
        F.element_at(F.array(F.lit("budget_book"), F.lit("press_release"), F.lit("other")), (p % 3 + 1).cast("int")).alias("source_type"),
        F.lit("label").alias("source_type_label"),
        F.when(p % 4 == 0, none)
        .when(p % 4 == 1, F.array(F.concat(F.lit("S"), (p % 10).cast("string"))))
        .otherwise(F.array(F.concat(F.lit("S"), (p % 10).cast("string")), F.concat(F.lit("S"), ((p + 3) % 10).cast("string"))))
        .alias("section_ids"),
        F.array((p % 4 + 2023).cast("int")).alias("fiscal_years"),
    )


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Collection attempts: one per page, and archived copies among those that worked."""
    p = F.col("page_id")
    archive = F.concat(
        F.lit("https://web.archive.org/web/2024id_/https://odata.org.il/dataset/"),
        (p % 40).cast("string"),
        F.lit("/resource/"),
        (p % 3).cast("string"),
    )
    return read(spark, folder, "pages").select(
        p.alias("seq"),
        F.when(p % 5 == 0, archive).otherwise(gov_url("url")).alias("url"),
        F.when(p % 5 == 0, F.lit("collect: internet archive snapshot")).otherwise(F.lit("retrieve page")).alias("purpose"),
        F.element_at(
            F.array(*[F.lit(o) for o in ("ok", "http_error", "blocked", "network_error", "ok")]), (p % 5 + 1).cast("int")
        ).alias("outcome"),
        F.when(p % 5 == 1, F.when(p % 2 == 0, F.lit(403)).otherwise(F.lit(304))).when(p % 5 == 0, F.lit(200)).alias("http_status"),
        F.length("html").cast("bigint").alias("bytes"),
        F.concat(F.lit("2024-01-"), F.lpad((p % 28 + 1).cast("string"), 2, "0")).alias("attempted_at"),
    )


def lexicon(spark: SparkSession) -> DataFrame:
    rows = [(i, hebraize_text(k), c, p, conf) for i, (k, c, p, conf) in enumerate(LEXICON)]
    return spark.createDataFrame(rows, "seq int, keyword string, category string, priority int, confidence string")


def generic_terms() -> list[str]:
    return [hebraize_text(t) for t in GENERIC]


def sentinel_terms() -> list[str]:
    return [hebraize_text(t) for t in SENTINELS]


def subject_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every document in Hebrew letters, as subjects to classify."""
    lines = read(spark, folder, "documents").select(
        "doc_id", F.posexplode(F.split(hebraize("text"), "\n")).alias("pos", "subject")
    )
    return lines.withColumn("entry_id", F.concat_ws("-", "doc_id", "pos"))


def named_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that hold a name alone, rows that hold it beside a classified topic, and rows without one.

    Some names have few classified rows that mention them, so that inference has to refuse them.
    """
    parts = read(spark, folder, "part").select("p_partkey", hebraize("p_name").alias("name"), F.length("p_name").alias("len"))
    rows = read(spark, folder, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    alone = n <= 2
    few = F.col("len") % 4 == 0
    field = F.element_at(
        F.array(F.lit("diplomacy"), F.lit("budget_finance"), F.lit("local_government")), (F.col("len") % 3 + 1).cast("int")
    )
    category = (
        F.when(alone, F.lit("unclassified"))
        .when(n == 3, F.lit("meeting_without_subject"))
        .when(q > 40, F.lit("ceremonies"))
        .when((F.col("len") % 5 == 0) & (q > 15), F.lit("media_pr"))
        .otherwise(field)
    )
    subject = (
        F.when(alone, F.col("name"))
        .when(few & (n > 3) & (q != 2), F.lit(hebraize_text("meet ") + " 7"))
        .when(n == 3, F.concat(F.lit(hebraize_text("call ") + "ל"), F.col("name")))
        .when(n == 4, F.concat(F.col("name"), F.lit(hebraize_text(" and team"))))
        .otherwise(F.concat(F.lit(hebraize_text("meet ")), F.col("name"), F.lit(" 7")))
    )
    return rows.select(
        subject.alias("subject"),
        category.alias("category"),
        F.lit(None).cast("string").alias("matched_keyword"),
        F.lit(None).cast("string").alias("matched_confidence"),
        F.lit(None).cast("string").alias("inferred_from"),
    )


def office_holders(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "nation").select(
        F.concat(F.lit(hebraize_text("head nation ")), F.translate(F.col("n_nationkey").cast("string"), "0123456789", "אבגדהוזחטי")).alias("person_label")
    )


def published_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Period texts of every kind, one per order."""
    o = F.col("o_orderkey")
    year = F.year("o_orderdate").cast("string")
    label = (
        F.when(o % 6 == 0, year)
        .when(o % 6 == 1, F.concat(year, F.lit(" (רבעון ראשון ושני)")))
        .when(o % 6 == 2, F.concat(year, F.lit(" (רבעון שלישי)")))
        .when(o % 6 == 3, F.concat(F.lit("שנים "), year, F.lit(" רבעון רביעי")))
        .when(o % 6 == 4, F.lit("רבעון שני"))
    )
    return read(spark, folder, "orders").select("o_orderkey", label.alias("label"))


def grid_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Order books as spreadsheet grids: a junk row, a header, rows, and a long blank stretch."""
    from pyspark.sql import Window as W

    orders = read(spark, folder, "orders")
    c, r = F.col("o_custkey"), F.col("__r")
    numbered = orders.withColumn("__r", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    gap = F.when((r > 4) & (c % 7 == 0), F.lit(35)).otherwise(F.when(r > 4, F.lit(3)).otherwise(F.lit(0)))
    row = r + 1 + gap
    key = F.col("o_orderkey")
    body = numbered.select(
        c.alias("doc"),
        row.cast("int").alias("row"),
        F.posexplode(
            F.array(
                F.when(key % 8 != 0, F.concat(F.lit(" talk  "), F.col("o_orderpriority"))),
                F.when(key % 8 != 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.when(key % 16 == 1, F.lit(" "))),
                F.lit("09:30"),
                F.when(key % 3 == 0, F.lit("hall ")),
            )
        ).alias("col", "value"),
    )
    # Some rows keep only the time: with neither subject nor date they count as unparsed.
    body = body.withColumn(
        "value",
        F.when((F.col("row") % 9 == 0) & (F.col("col") < 2), F.lit(None).cast("string")).otherwise(F.col("value")),
    )
    heads = orders.select("o_custkey").distinct()
    plain = heads.select(
        c.alias("doc"),
        F.lit(1).alias("row"),
        F.posexplode(
            F.array(
                F.when(c % 11 == 0, F.lit("מספר")).otherwise(F.lit("נושא הפגישה:")),
                F.lit('תאריך "התחלה"'),
                F.lit("שעת התחלה"),
                F.when(c % 2 == 0, F.lit("מיקום")).otherwise(F.lit("תאריך")),
            )
        ).alias("col", "value"),
    )
    junk = heads.select(
        c.alias("doc"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit("יומן פעילות").alias("value")
    )
    return plain.unionByName(junk).unionByName(body).filter(F.col("value").isNotNull())


def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Printed calendars, one per user and day: a date heading, timed lines, and page noise."""
    e = _event_rows(spark, folder)
    k = F.col("k")
    start = F.hour("ts") * 60 + F.minute("ts")
    doc = F.concat_ws("/", "user_id", F.date_format("ts", "yyyyMMdd"))
    heading = e.groupBy(doc.alias("doc"), F.to_date("ts").alias("__d")).agg(F.count("*").alias("__n")).select(
        "doc",
        F.lit(-1).cast("bigint").alias("pos"),
        F.when(F.col("__n") % 5 == 0, F.lit("page 1 of 4")).otherwise(F.date_format("__d", "d.M.yyyy")).alias("line"),
    )
    until = F.least(start + 30, F.lit(1439))
    line = (
        F.when(k % 10 == 0, F.lit("page  footer"))
        .when(k % 10 == 1, F.concat(F.date_format("ts", "dd/MM/yyyy"), F.lit(" "), _clock(start), F.lit("-"), _clock(until), F.lit(" | "), F.col("event_type")))
        .when(k % 10 == 2, F.concat(_clock(start), F.lit(" – "), _clock(until), F.lit("  "), F.col("event_type"), F.lit(" *")))
        .when(k % 10 == 3, F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" "), F.col("event_type"), F.lit(" all day long")))
        .when(k % 10 == 4, F.concat(_clock(start), F.lit(" x")))
        .otherwise(F.concat(F.lit("• "), _clock(start), F.lit(" "), F.col("event_type"), F.lit(" "), F.lit("room")))
    )
    return heading.unionByName(e.select(doc.alias("doc"), F.col("event_id").alias("pos"), line.alias("line")))


