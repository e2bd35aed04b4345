"""Field of a person's name, inferred from the rows it appears in; and its limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from publedger.functions.numbers import one_decimal_percent
from publedger.functions.text import norm_subject
from publedger.operators.classify import NON_TOPIC_CATEGORIES, word_matches
from publedger.session import cut_lineage

MIN_SUPPORT, MIN_DOMINANCE, MAX_EXTRAPOLATION = 5, 0.7, 8
MIN_WORDS, MAX_WORDS = 2, 4
# Fixed value: the shape of a name.
NAME_SHAPE = "^[א-ת\"'\\- ]{4,40}$"
#: Rows the office left blank or vague hold no name to read.
CLOSED_CATEGORIES = ("no_subject_recorded", "unspecified")


def _words(c: str):
    return F.filter(F.split(c, " "), lambda w: w != "")


def _named(df: DataFrame) -> DataFrame:
    n = F.size(_words("name"))
    return df.filter((n >= MIN_WORDS) & (n <= MAX_WORDS) & F.col("name").rlike(NAME_SHAPE))


def vocabulary_words(lexicon: DataFrame) -> DataFrame:
    words = lexicon.select(F.explode(F.split(norm_subject("keyword"), " ")).alias("word"))
    return words.filter(F.length("word") > 1).distinct()


def weigh_subjects(rows: DataFrame) -> DataFrame:
    """``text, category, weight``: distinct normalised subjects and the rows behind them.

    Rows are counted by raw subject first, so only distinct subjects are normalised. A table
    that already has this shape is used as it is.
    """
    if "weight" in rows.columns:
        return rows
    raw = rows.groupBy("subject", "category").agg(F.count("*").alias("__n"))
    return raw.groupBy(norm_subject("subject").alias("text"), "category").agg(F.sum("__n").alias("weight"))


def name_candidates(rows: DataFrame, lexicon: DataFrame, holders: DataFrame) -> DataFrame:
    """Subjects shaped like a name without a known word, and the office holders' own names.

    ``rows``: subject, category (or weighed subjects). ``holders``: person_label.
    """
    weighed = weigh_subjects(rows).filter(F.col("category").isin(*NON_TOPIC_CATEGORIES))
    shaped = _named(weighed.select(F.col("text").alias("name")).distinct())
    known = (
        shaped.select("name", F.explode(_words("name")).alias("word"))
        .join(vocabulary_words(lexicon), "word", "left_semi")
        .select("name")
    )
    labels = _named(holders.filter(F.col("person_label").isNotNull()).select(norm_subject("person_label").alias("name")))
    return shaped.join(known, "name", "left_anti").unionByName(labels.distinct()).distinct()


def name_matches(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``text, name``: every distinct subject with the names that stand in it as words.

    Tally, refusal and the longest name all read this relation; write it once where several do.
    """
    texts = weigh_subjects(rows).select(F.col("text").alias("text_id"), "text").distinct()
    pairs = word_matches(texts, names.select(F.col("name").alias("needle")))
    return pairs.select(F.col("text_id").alias("text"), F.col("needle").alias("name"))


def name_occurrences(rows: DataFrame, names: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """``name, category, n``: rows in which the name stands as a phrase of whole words.

    ``matches``: a written :func:`name_matches` of these names.
    """
    weighed = weigh_subjects(rows)
    pairs = name_matches(weighed, names) if matches is None else matches
    long_words = F.filter(F.split("name", " "), lambda w: F.length(w) > 1)
    whole = (F.size(long_words) > 0) & (F.size(F.array_except(long_words, F.split("text", " "))) == 0)
    return pairs.filter(whole).join(weighed, "text").groupBy("name", "category").agg(F.sum("weight").alias("n"))


def decide_name_field(
    tally: DataFrame, min_support: int = MIN_SUPPORT, min_dominance: float = MIN_DOMINANCE
) -> DataFrame:
    """Names whose rows point clearly to one field: enough rows, and a clear majority of them."""
    topical = tally.filter(~F.col("category").isin(*NON_TOPIC_CATEGORIES) & (F.col("category") != ""))
    total = topical.groupBy("name").agg(F.sum("n").alias("classified_appearances"))
    best = topical.groupBy("name").agg(
        F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("category"),
        F.max("n").alias("supporting_rows"),
    )
    joined = best.join(total, "name")
    ratio = F.col("supporting_rows") / F.col("classified_appearances")
    kept = joined.filter((F.col("supporting_rows") >= min_support) & (ratio >= min_dominance))
    return kept.withColumn("dominance", one_decimal_percent(F.col("supporting_rows"), F.col("classified_appearances")))


def _is_open() -> Column:
    """Rows an inference may change: no topic, yet not left blank or vague by the office."""
    return F.col("category").isin(*NON_TOPIC_CATEGORIES) & ~F.col("category").isin(*CLOSED_CATEGORIES)


def longest_name(rows: DataFrame, names: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """``text, name``: the longest of the names that stands in each open subject.

    ``matches``: a written :func:`name_matches` of these names, or of more of them.
    """
    open_texts = weigh_subjects(rows).filter(_is_open()).select("text").distinct()
    if matches is None:
        pairs = name_matches(open_texts.select("text", F.lit(1).alias("weight")), names)
    else:
        pairs = matches.join(names.select("name"), "name", "left_semi").join(open_texts, "text", "left_semi")
    return pairs.groupBy("text").agg(F.min_by("name", F.struct(-F.length("name"), F.col("name"))).alias("name"))


def refuse_overreach(
    rows: DataFrame, decided: DataFrame, limit: int = MAX_EXTRAPOLATION, matches: DataFrame | None = None
) -> DataFrame:
    """Decided names that would relabel more rows than ``limit`` times their evidence."""
    weighed = weigh_subjects(rows)
    hits = longest_name(weighed, decided, matches)
    weights = weighed.filter(_is_open()).groupBy("text").agg(F.sum("weight").alias("__w"))
    reach = hits.join(weights, "text").groupBy("name").agg(F.sum("__w").alias("would_touch"))
    return (
        decided.join(reach, "name")
        .filter(F.col("would_touch") > F.col("supporting_rows") * limit)
        .select("name", "supporting_rows", "would_touch")
    )


def apply_inference(
    rows: DataFrame,
    candidates: DataFrame,
    decided: DataFrame,
    refused: DataFrame,
    weighed: DataFrame | None = None,
    matches: DataFrame | None = None,
) -> DataFrame:
    """Rows with the field of the longest accepted name in them, at low confidence.

    A row that is exactly an unresolved candidate becomes a meeting with a named person. What
    to do is settled per distinct subject and then joined to the rows.
    """
    accepted = decided.join(refused.select("name"), "name", "left_anti")
    fields = accepted.select("name", F.col("category").alias("__field"))
    hits = longest_name(rows if weighed is None else weighed, accepted, matches).join(fields, "name")
    people = candidates.join(decided.select("name"), "name", "left_anti").select(
        F.col("name").alias("text"), F.lit(True).alias("__person")
    )
    marks = hits.withColumnRenamed("name", "__name").join(people, "text", "full_outer")
    subjects = rows.select("subject").distinct().withColumn("text", norm_subject("subject")).join(marks, "text")
    joined = rows.join(subjects, "subject", "left")
    by_field = _is_open() & F.col("__name").isNotNull()
    by_person = ~by_field & (F.col("category") == "unclassified") & F.coalesce("__person", F.lit(False))
    changed = by_field | by_person
    columns = {
        "category": F.when(by_field, F.col("__field"))
        .when(by_person, F.lit("named_person_meeting"))
        .otherwise(F.col("category")),
        "matched_keyword": F.when(by_field, F.col("__name"))
        .when(by_person, F.col("text"))
        .otherwise(F.col("matched_keyword")),
        "matched_confidence": F.when(changed, F.lit("low")).otherwise(F.col("matched_confidence")),
        "inferred_from": F.when(by_field, F.lit("name_cooccurrence"))
        .when(by_person, F.lit("name_without_field"))
        .otherwise(F.col("inferred_from")),
    }
    return joined.withColumns(columns).drop("text", "__name", "__field", "__person")


def inference_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("inferred_from", F.lit("none")).alias("inferred_from")).agg(F.count("*").alias("n"))


def name_evidence(rows: DataFrame, lexicon: DataFrame, holders: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Weighed subjects, candidates, and the one relation of their matches, each written once."""
    weighed = cut_lineage(weigh_subjects(rows), "subjects")
    candidates = cut_lineage(name_candidates(weighed, lexicon, holders), "candidates")
    return weighed, candidates, cut_lineage(name_matches(weighed, candidates), "name-matches")


def infer_names(rows: DataFrame, lexicon: DataFrame, holders: DataFrame) -> DataFrame:
    """Candidates → occurrences → decisions → refusals → rows, in one call."""
    weighed, candidates, matches = name_evidence(rows, lexicon, holders)
    decided = cut_lineage(decide_name_field(name_occurrences(weighed, candidates, matches)), "decided")
    refused = refuse_overreach(weighed, decided, matches=matches)
    return apply_inference(rows, candidates, decided, refused, weighed, matches)
