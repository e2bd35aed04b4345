"""Contracts, suppliers, support payments and budget transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from publedger.functions.numbers import half_up, one_decimal_percent, share_of
from publedger.functions.text import METHOD_EXEMPT, norm_method, squeeze, supplier_id
from publedger.operators.common import first_per_group
from publedger.session import cut_lineage

CAP_FACTOR = 1.5
CAP_CODE_LENGTH = 6
SUPPLIERS, CONTRACTS, RECIPIENTS, REQUESTS, EXAMPLES, LEADERS = 15, 10, 15, 8, 6, 5
EXPLANATION_LENGTH = 600
WEIGHTS = {"hhi": 0.40, "first_five": 0.35, "exempt": 0.25}


def contract_caps(items: DataFrame, factor: float = CAP_FACTOR) -> tuple[DataFrame, DataFrame]:
    """Volume caps: per level-2 programme, and per section for codes without a programme."""

    def cap(largest):
        return F.greatest(F.lit(1), half_up(largest * F.lit(factor)))

    known = items.filter(F.col("updated").isNotNull())
    largest = F.greatest(F.max("updated"), F.lit(0))
    programmes = (
        known.filter(F.col("level") == 2).groupBy("section_id", "code").agg(cap(largest).alias("programme_cap"))
    )
    sections = known.filter(F.col("level") == 1).groupBy("section_id").agg(cap(largest).alias("section_cap"))
    return programmes, sections


def flag_by_cap(contracts: DataFrame, items: DataFrame, factor: float = CAP_FACTOR) -> DataFrame:
    """``within_cap``: the contract's volume is missing or plausible for its programme."""
    programmes, sections = contract_caps(items, factor)
    coded = contracts.withColumn("__code", F.substring("budget_code", 1, CAP_CODE_LENGTH))
    joined = coded.join(
        programmes.withColumnRenamed("code", "__code"), ["section_id", "__code"], "left"
    ).join(sections, "section_id", "left")
    limit = F.coalesce("programme_cap", "section_cap", F.lit(1))
    return joined.withColumn("within_cap", F.col("volume").isNull() | (F.col("volume") <= limit)).drop(
        "__code", "programme_cap", "section_cap"
    )


def split_by_cap(contracts: DataFrame, items: DataFrame, factor: float = CAP_FACTOR) -> tuple[DataFrame, DataFrame]:
    flagged = flag_by_cap(contracts, items, factor)
    return (
        flagged.filter("within_cap").drop("within_cap"),
        flagged.filter(~F.col("within_cap")).drop("within_cap"),
    )


#: Grouping sets of the cube by what they leave open.
CUBE_KEYS = ("section_id", "supplier", "entity_id", "entity_kind", "method")
CUBE_LEVELS = {"section": ("section_id",), "supplier": CUBE_KEYS[:4], "method": ("section_id", "method")}


def contract_cube(contracts: DataFrame) -> DataFrame:
    """Contract count, volume and executed money of every section, supplier of a section, and method of a section.

    One pass over the contracts by grouping sets, aggregated in the tasks that read them and written once:
    totals, leaders, concentration and mix of methods are all read from it. ``level`` names the set.
    """
    level = F.lit(None).cast("string")
    for name, keys in CUBE_LEVELS.items():
        open_keys = sum(1 << (len(CUBE_KEYS) - 1 - k) for k, c in enumerate(CUBE_KEYS) if c not in keys)
        level = F.when(F.grouping_id() == open_keys, F.lit(name)).otherwise(level)
    columns = [F.col(c) for c in CUBE_KEYS]
    sets = [[F.col(c) for c in keys] for keys in CUBE_LEVELS.values()]
    grouped = contracts.select(*CUBE_KEYS, "volume", "executed").groupingSets(sets, *columns)
    sums = grouped.agg(
        level.alias("level"), F.count("*").alias("contract_count"), F.sum("volume").alias("volume"), F.sum("executed").alias("executed")
    )
    return cut_lineage(sums, "contract-cube")


def supplier_totals(contracts: DataFrame, cube: DataFrame | None = None) -> DataFrame:
    keys = ("section_id", "supplier", "entity_id", "entity_kind")
    if cube is not None:
        named = cube.filter((F.col("level") == "supplier") & F.col("supplier").isNotNull())
        return named.select(*keys, "contract_count", "volume", "executed")
    return (
        contracts.filter(F.col("supplier").isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("contract_count"),
            F.sum("volume").alias("volume"),
            F.sum("executed").alias("executed"),
        )
    )


def top_suppliers(contracts: DataFrame, n: int = SUPPLIERS, cube: DataFrame | None = None) -> DataFrame:
    order = [F.desc_nulls_last("volume"), F.col("supplier"), F.col("entity_id")]
    return first_per_group(supplier_totals(contracts, cube), ["section_id"], order, n, rank="position")


def contract_totals(contracts: DataFrame, leaders: int = LEADERS, cube: DataFrame | None = None) -> DataFrame:
    """Contract count and volume per section, and the share of its largest suppliers."""
    if cube is None:
        totals = contracts.groupBy("section_id").agg(F.count("*").alias("contract_count"), F.sum("volume").alias("volume"))
    else:
        totals = cube.filter(F.col("level") == "section")
    totals = totals.select("section_id", "contract_count", F.coalesce("volume", F.lit(0)).alias("total_volume"))
    lead = top_suppliers(contracts, leaders, cube).groupBy("section_id").agg(F.sum("volume").alias("__lead"))
    joined = totals.join(lead, "section_id", "left")
    percent = share_of(F.coalesce("__lead", F.lit(0)), "total_volume")
    return joined.withColumn("lead_share_percent", percent).drop("__lead")


def method_mix(contracts: DataFrame, raw_methods: int | None = None, cube: DataFrame | None = None) -> DataFrame:
    """Count, volume and share per method bucket, out of all raw methods or the largest ones."""
    if cube is None:
        raw = contracts.groupBy("section_id", "method").agg(F.count("*").alias("contract_count"), F.sum("volume").alias("volume"))
    else:
        raw = cube.filter(F.col("level") == "method")
    raw = raw.select("section_id", "method", F.col("contract_count").alias("__n"), F.col("volume").alias("__volume"))
    order = [F.desc_nulls_last("__volume"), F.col("method")]
    kept = raw if raw_methods is None else first_per_group(raw, ["section_id"], order, raw_methods)
    buckets = kept.groupBy("section_id", norm_method("method").alias("bucket")).agg(
        F.sum("__n").alias("contract_count"), F.sum(F.coalesce("__volume", F.lit(0))).alias("total_volume")
    )
    total = F.sum("total_volume").over(W.partitionBy("section_id"))
    return buckets.withColumn(
        "share_percent", F.when(total > 0, one_decimal_percent(F.col("total_volume"), total))
    )


def notable_contracts(contracts: DataFrame, n: int = CONTRACTS) -> DataFrame:
    valued = contracts.filter(F.col("volume").isNotNull()).withColumn("method", norm_method("method"))
    return first_per_group(valued, ["section_id"], [F.desc("volume"), F.col("seq")], n, rank="position")


def excluded_contracts(contracts: DataFrame, items: DataFrame, factor: float = CAP_FACTOR) -> DataFrame:
    """What the cap set aside per section, and whether it outweighs what was kept."""
    flagged = flag_by_cap(contracts, items, factor)
    volume = F.coalesce("volume", F.lit(0))
    sums = flagged.groupBy("section_id").agg(
        F.count_if(~F.col("within_cap")).alias("excluded_count"),
        F.sum(F.when(F.col("within_cap"), F.lit(0)).otherwise(volume)).alias("excluded_volume"),
        F.sum(F.when(F.col("within_cap"), volume).otherwise(F.lit(0))).alias("__kept"),
    )
    return sums.withColumn("data_suspect", F.col("excluded_volume") > F.col("__kept")).drop("__kept")


def excluded_examples(contracts: DataFrame, items: DataFrame, factor: float = CAP_FACTOR, n: int = EXAMPLES) -> DataFrame:
    _, excluded = split_by_cap(contracts, items, factor)
    return first_per_group(excluded, ["section_id"], [F.desc_nulls_last("volume"), F.col("seq")], n, rank="position")


def recipient_totals(payments: DataFrame) -> DataFrame:
    return (
        payments.filter(F.col("recipient").isNotNull())
        .groupBy("section_id", "recipient", "entity_id")
        .agg(
            F.count("*").alias("request_count"),
            F.sum("approved").alias("approved"),
            F.sum("paid").alias("paid"),
            F.max("title").alias("example_title"),
        )
    )


def support_recipients(payments: DataFrame, n: int = RECIPIENTS) -> DataFrame:
    order = [F.desc_nulls_last("paid"), F.col("recipient"), F.col("entity_id")]
    return first_per_group(recipient_totals(payments), ["section_id"], order, n, rank="position")


def top_transfers(requests: DataFrame, n: int = REQUESTS) -> DataFrame:
    """Largest budget transfers by absolute size, explanation squeezed for display."""
    order = [F.desc_nulls_last(F.abs("net")), F.col("transaction_id")]
    top = first_per_group(requests, ["section_id"], order, n, rank="position")
    text = F.coalesce(F.substring(squeeze("explanation"), 1, EXPLANATION_LENGTH), F.lit(""))
    return top.withColumn("explanation", text)


def supplier_hhi(suppliers: DataFrame, totals: DataFrame, n: int | None = None) -> DataFrame:
    """Sum of squared volume shares per section, 0–10,000; null without a positive total.

    ``n`` limits the sum to the largest suppliers of a section.
    """
    usable = suppliers.filter(F.col("volume") > 0)
    if n is not None:
        usable = first_per_group(usable, ["section_id"], [F.desc("volume"), F.col("supplier")], n)
    share = F.try_divide(F.col("volume").cast("double"), F.col("total_volume").cast("double")) * 100.0
    squares = (
        usable.join(totals.select("section_id", "total_volume"), "section_id")
        .filter(F.col("total_volume") > 0)
        .groupBy("section_id")
        .agg(half_up(F.sum(share * share)).alias("hhi"))
    )
    return totals.select("section_id").join(squares, "section_id", "left")


def exempt_shares(mix: DataFrame) -> DataFrame:
    """Share of volume and of count bought without a tender; 0 when methods exist but none is."""
    exempt = F.col("bucket") == METHOD_EXEMPT

    def part(c: str):
        return F.sum(F.when(exempt, F.col(c)).otherwise(F.lit(0)))

    return mix.groupBy("section_id").agg(
        share_of(part("total_volume"), F.sum("total_volume")).alias("exempt_volume_percent"),
        share_of(part("contract_count"), F.sum("contract_count")).alias("exempt_count_percent"),
    )


def weighted_mean(parts: list[tuple]) -> tuple:
    """Weighted mean over the known parts, and how many are known.

    ``parts`` are (column, weight); a null part gives its weight to the others.
    """
    weight = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for v, w in parts), F.lit(0.0))
    total = sum((F.coalesce(v * F.lit(w), F.lit(0.0)) for v, w in parts), F.lit(0.0))
    known = sum((F.when(v.isNotNull(), F.lit(1)).otherwise(F.lit(0)) for v, _ in parts), F.lit(0))
    return half_up(F.try_divide(total, weight), 1), known


def procurement_index(contracts: DataFrame, n: int | None = None, cube: DataFrame | None = None) -> DataFrame:
    """Concentration of a section's contracting from three weighted parts, all of one cube."""
    cube = contract_cube(contracts) if cube is None else cube
    totals = contract_totals(contracts, cube=cube)
    hhi = supplier_hhi(supplier_totals(contracts, cube), totals, n)
    joined = totals.join(hhi, "section_id", "left").join(exempt_shares(method_mix(contracts, cube=cube)), "section_id", "left")
    score, known = weighted_mean(
        [
            (F.least(F.lit(100.0), F.col("hhi") / 100.0), WEIGHTS["hhi"]),
            (F.col("lead_share_percent"), WEIGHTS["first_five"]),
            (F.col("exempt_volume_percent"), WEIGHTS["exempt"]),
        ]
    )
    return joined.withColumn("concentration_score", score).withColumn("measured_parts", known)


def entity_appearances(suppliers: DataFrame, recipients: DataFrame) -> DataFrame:
    """Every section in which a name is a supplier or a support recipient, by name id."""
    a = suppliers.select(
        supplier_id("supplier").alias("name_id"),
        "section_id",
        F.lit("supplier").alias("kind"),
        F.col("contract_count").alias("n"),
        "volume",
        "executed",
    )
    b = recipients.select(
        supplier_id("recipient").alias("name_id"),
        "section_id",
        F.lit("support").alias("kind"),
        F.col("request_count").alias("n"),
        F.col("approved").alias("volume"),
        F.col("paid").alias("executed"),
    )
    return a.unionByName(b)


def entity_profile(appearances: DataFrame, matches: DataFrame, timings: DataFrame, name: str) -> DataFrame:
    """One entity: its appearances with the matches and timed meetings of each section."""
    own = appearances.filter(F.col("name_id") == name)
    matched = (
        matches.filter(supplier_id("matched_name") == name)
        .groupBy("section_id")
        .agg(F.count("*").alias("match_count"))
    )
    timed = (
        timings.filter(supplier_id("matched_name") == name)
        .groupBy("section_id")
        .agg(F.count("*").alias("timed_count"), F.count_if("within_window").alias("window_count"))
    )
    zero = F.lit(0)
    return (
        own.join(matched, "section_id", "left")
        .join(timed, "section_id", "left")
        .withColumns({c: F.coalesce(c, zero) for c in ("match_count", "timed_count", "window_count")})
    )
