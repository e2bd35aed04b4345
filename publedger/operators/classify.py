"""Keyword classification of short texts, topics, and upkeep of the lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from publedger.functions.text import (
    MAX_PROCLITICS,
    PROCLITICS,
    QUOTES,
    bare_terms,
    bare_text,
    matches_as_word,
    norm_subject,
    norm_text,
    squeeze,
)
from publedger.operators.common import first_per_group
from publedger.operators.matching import candidate_pairs
from publedger.session import cut_lineage

# Categories that say a subject is absent, and confidence order.
NON_TOPIC_CATEGORIES = (
    "meeting_without_subject",
    "named_person_meeting",
    "unclassified",
    "unspecified",
    "no_subject_recorded",
)
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}
FIRST_RUN = "^([א-ת]+)"
TOPIC_NOTE = "סיווג נושאים:"
SENTINEL_PRIORITY = 90
UNKNOWN_PRIORITY = 999


def match_topics(rows: DataFrame, topics: list[tuple[str, list[str]]]) -> DataFrame:
    """``topics`` and ``topic_rule`` of rows with title and summary: every topic with a keyword in the text."""
    text = F.col("__text")
    hits = []
    for topic, keywords in topics:
        found = F.array_compact(
            F.array(*[F.when(F.contains(text, norm_text(F.lit(k))), F.lit(k)) for k in keywords])
        )
        rule = F.concat(F.lit(f"keyword_match({topic}): "), F.array_join(found, ", "))
        hits.append(F.when(F.size(found) > 0, F.struct(F.lit(topic).alias("id"), rule.alias("rule"))))
    return (
        rows.withColumn("__text", norm_text(F.concat_ws(" ", "title", "summary")))
        .withColumn("__fired", F.array_compact(F.array(*hits)))
        .withColumn("topics", F.col("__fired.id"))
        .withColumn("topic_rule", F.array_join(F.col("__fired.rule"), " | "))
        .drop("__text", "__fired")
    )


def classify_topics(
    activities: DataFrame, topics: list[tuple[str, list[str]]], overrides: list[tuple[str, list[str], str]]
) -> DataFrame:
    """Activities with their topics; patterns on the id add topics, the note is rebuilt whole."""
    matched = match_topics(activities.drop("topics"), topics)
    nothing = F.array().cast("array<string>")
    added, notes = nothing, nothing
    for pattern, topic_ids, reason in overrides:
        hit = F.col("id").rlike(pattern)
        added = F.concat(added, F.when(hit, F.array(*[F.lit(t) for t in topic_ids])).otherwise(nothing))
        notes = F.concat(notes, F.when(hit, F.array(F.lit(f"manual_override: {reason}"))).otherwise(nothing))
    by_keyword = F.when(F.col("topic_rule") != "", F.array("topic_rule")).otherwise(nothing)
    base = F.split_part(F.col("notes"), F.lit(f" || {TOPIC_NOTE}"), F.lit(1))
    return (
        matched.withColumn("topics", F.array_sort(F.array_union("topics", added)))
        .withColumn(
            "notes", F.concat(base, F.lit(f" || {TOPIC_NOTE} "), F.array_join(F.concat(by_keyword, notes), " | "))
        )
        .drop("topic_rule")
    )


def topic_counts(classified: DataFrame, topics: list[str]) -> DataFrame:
    """Items per declared topic, topics without an item included."""
    declared = classified.sparkSession.createDataFrame([(t,) for t in topics], "topic string")
    counts = classified.select(F.explode_outer("topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))
    return declared.join(counts, "topic", "left").select("topic", F.coalesce("n", F.lit(0)).alias("item_count"))


def word_matches(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """Pairs ``text_id, needle`` where the needle stands as a word of its own in the text.

    ``texts``: text_id (unique), text. ``needles``: needle. A needle that starts with a Hebrew
    letter run meets a text run equal to it once up to three leading particles are taken off,
    so candidates come from an equi-join and only they are verified. Other needles go through
    the substring search. Every run and word of a text is a row with its text_id, so it should be short.
    """
    pool = needles.select("needle").filter(F.col("needle") != "").distinct()
    run = F.regexp_extract("needle", FIRST_RUN, 1)
    # Written, so that its true size decides how the runs of all texts meet it.
    lettered = cut_lineage(pool.withColumn("anchor", run).filter(F.col("anchor") != ""), "needle-runs")
    others = pool.filter(run == "")
    held = texts.select("text_id", "text")
    runs = F.array_distinct(F.regexp_extract_all("text", F.lit("([א-ת]+)")))
    lead = f"^[{PROCLITICS}]"

    def versions(word: Column) -> Column:
        kept = [word]
        for k in range(1, MAX_PROCLITICS + 1):
            kept.append(F.when(word.rlike(f"{lead}{{{k}}}."), F.substr(word, F.lit(k + 1))))
        return F.array_compact(F.array(*kept))

    anchors = F.array_distinct(F.flatten(F.transform(runs, versions)))
    # explode_outer: an inner explode would have its array computed once more in a pushed filter.
    # A needle that is one run is proved by its anchor; only longer ones need the text, which meets its
    # candidates once and is carried by none of the rows before.
    by_run = (
        held.select("text_id", F.explode_outer(anchors).alias("anchor"))
        .join(lettered, "anchor")
        .select("text_id", "needle", (F.col("needle") == F.col("anchor")).alias("__proved"))
    )
    by_word = candidate_pairs(held, others, [], 1).withColumn("__proved", F.lit(False))
    pairs = cut_lineage(by_run.unionByName(by_word), "word-candidates")
    found = held.join(pairs.filter(~F.col("__proved")), "text_id").filter(matches_as_word("text", "needle"))
    return pairs.filter("__proved").select("text_id", "needle").unionByName(found.select("text_id", "needle"))


def _prepared_lexicon(lexicon: DataFrame) -> DataFrame:
    """One row per normalised keyword of the best claim: tier, priority, list order."""
    tier = F.when(F.col("category").isin(*NON_TOPIC_CATEGORIES), F.lit(2)).otherwise(F.lit(1))
    rows = lexicon.withColumn("needle", F.lower(norm_subject("keyword"))).withColumn("tier", tier)
    order = F.struct("tier", "priority", "seq")
    return (
        rows.filter(F.col("needle") != "")
        .groupBy("needle")
        .agg(F.min_by(F.struct("tier", "priority", "seq", "category", "confidence"), order).alias("__best"))
        .select("needle", "__best.*")
    )


def _subject_key(c: str) -> Column:
    """Digest that stands for a subject in joins; a missing subject has the empty one."""
    return F.coalesce(F.unhex(F.sha2(c, 256)), F.lit(bytearray()))


def _decisions(subjects: DataFrame, lexicon: DataFrame, generic: list[str], sentinels: list[str]) -> DataFrame:
    """The decisions of :func:`classify_distinct` by ``__key`` in place of the subject."""
    # One lookup says what a bare text is, so the text is normalised once per distinct subject.
    kinds = {t: "unspecified" for t in ["", *bare_terms(generic)]}
    if sentinels:
        kinds.update({t: "no_subject_recorded" for t in ["", *bare_terms(sentinels)]})
    listed = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    texts = (
        subjects.select("subject")
        .distinct()
        .withColumn("__key", _subject_key("subject"))
        .withColumn("text", norm_subject(F.coalesce("subject", F.lit(""))))
        .withColumn("__kind", F.try_element_at(listed, bare_text("text")))
        .withColumn("text", F.when(F.col("__kind").isNull(), F.lower("text")))
    )
    # Several joins below read the normalised subjects, so they are written once. In those joins a number
    # stands for a subject, since a row for every word of it could not carry the text itself.
    texts = cut_lineage(texts.select("__key", "text", "__kind", F.monotonically_increasing_id().alias("text_id")), "subjects")
    words = _prepared_lexicon(lexicon)
    best = F.struct("tier", (-F.length("needle")).alias("size"), "priority", "seq")
    winners = (
        word_matches(texts, words)
        .join(words, "needle")
        .groupBy("text_id")
        .agg(F.min_by(F.struct("category", "needle", "confidence"), best).alias("__win"))
    )
    won = F.col("__win")
    return texts.drop("text").join(winners, "text_id", "left").select(
        "__key",
        F.coalesce("__kind", won["category"], F.lit("unclassified")).alias("category"),
        won["needle"].alias("matched_keyword"),
        won["confidence"].alias("matched_confidence"),
        F.when(F.col("__kind") == "unspecified", F.lit("generic_subject"))
        .when(F.col("__kind").isNotNull(), F.col("__kind"))
        .when(won.isNotNull(), F.lit("keyword_match"))
        .otherwise(F.lit("no_match"))
        .alias("rule"),
    )


def classify_distinct(
    subjects: DataFrame, lexicon: DataFrame, generic: list[str], sentinels: list[str]
) -> DataFrame:
    """One decision per distinct ``subject``: category, matched_keyword, matched_confidence, rule.

    No text at all, then a generic phrase, then the longest keyword among topic categories,
    then the longest among the others; equal lengths fall to the lower priority number.
    """
    keyed = subjects.select("subject").distinct().withColumn("__key", _subject_key("subject"))
    return keyed.join(_decisions(subjects, lexicon, generic, sentinels), "__key").drop("__key")


def classify_subject(
    rows: DataFrame, lexicon: DataFrame, generic: list[str], sentinels: list[str] | None = None
) -> DataFrame:
    """Rows with the decision on their subject; any earlier inference is cleared."""
    old = ("category", "matched_keyword", "matched_confidence", "rule", "inferred_from")
    clean = rows.drop(*old)
    decided = _decisions(clean, lexicon, generic, sentinels or [])
    joined = clean.withColumn("__key", _subject_key("subject")).join(decided, "__key").drop("__key")
    return joined.withColumn("inferred_from", F.lit(None).cast("string"))


def category_report(classified: DataFrame, categories: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rows per category, and how many keywords of each confidence stand behind it."""
    counts = classified.groupBy("category").agg(F.count("*").alias("__rows"))
    words = lexicon.groupBy("category").agg(
        F.count("*").alias("__words"),
        *[F.count_if(F.col("confidence") == c).alias(f"__{c}") for c in CONFIDENCE_RANK],
    )
    joined = categories.join(counts, "category", "left").join(words, "category", "left")
    zero = F.lit(0)
    return joined.select(
        "category",
        F.coalesce("__rows", zero).alias("entry_count"),
        F.coalesce("__words", zero).alias("keyword_count"),
        *[F.coalesce(f"__{c}", zero).alias(f"keywords_{c}") for c in CONFIDENCE_RANK],
    )


def confidence_totals(classified: DataFrame) -> DataFrame:
    known = classified.filter(F.col("matched_confidence").isNotNull())
    return known.groupBy("matched_confidence").agg(F.count("*").alias("n"))


def audit_lexicon(rows: DataFrame, lexicon: DataFrame, samples: int = 3) -> DataFrame:
    """Rows every keyword catches on its own, with a few subjects; a dead keyword has 0."""
    weights = rows.groupBy(F.lower(norm_subject("subject")).alias("text")).agg(F.count("*").alias("__w"))
    # Numbered in the order that samples are shown in, so that no hit carries its text.
    ordered = weights.orderBy(F.desc("__w"), "text").select(F.monotonically_increasing_id().alias("text_id"), "text", "__w")
    texts = cut_lineage(ordered, "weighed-texts")
    words = lexicon.select("category", "confidence", F.lower(norm_subject("keyword")).alias("needle")).distinct()
    hits = cut_lineage(word_matches(texts, words).join(texts.select("text_id", "__w"), "text_id"), "keyword-hits")
    counts = hits.groupBy("needle").agg(F.sum("__w").alias("__hits"))
    shown = cut_lineage(first_per_group(hits, ["needle"], [F.col("text_id")], samples, rank="__r"), "samples")
    examples = shown.join(texts.select("text_id", "text"), "text_id").groupBy("needle").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("__r", "text")))["text"], " || ").alias("examples")
    )
    joined = words.join(counts, "needle", "left").join(examples, "needle", "left")
    return joined.select(
        F.col("needle").alias("keyword"),
        "category",
        "confidence",
        F.coalesce("__hits", F.lit(0)).alias("hits"),
        F.coalesce("examples", F.lit("")).alias("examples"),
    )


def norm_keyword(c: Column | str) -> Column:
    text = F.regexp_replace(c if isinstance(c, Column) else F.col(c), QUOTES, '"')
    return squeeze(F.regexp_replace(text, r"[\x{200e}\x{200f}]", ""))


def merge_lexicon(
    proposals: DataFrame, categories: DataFrame, overrides: DataFrame, curated: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Experts' keyword proposals merged to one category each, and the counts of what was left out.

    ``proposals``: expert, keyword, category, confidence, reasoning. ``categories``: category,
    priority. ``overrides``: keyword, action (drop / remap), to_category. Highest confidence
    wins, then most experts, then lower priority. Keywords already curated are left alone.
    """
    fixes = overrides.select(norm_keyword("keyword").alias("keyword"), "action", "to_category")
    rows = (
        proposals.withColumn("keyword", norm_keyword("keyword"))
        .filter(F.col("keyword") != "")
        .join(fixes, "keyword", "left")
        .withColumn(
            "category",
            F.when(F.col("action") == "remap", F.coalesce("to_category", "category")).otherwise(F.col("category")),
        )
        .join(categories, "category", "left")
    )
    if curated is None:
        marked = rows.withColumn("__curated", F.lit(None).cast("boolean"))
    else:
        listed = curated.select(norm_keyword("keyword").alias("keyword"), F.lit(True).alias("__curated")).distinct()
        marked = rows.join(listed, "keyword", "left")
    outcome = (
        F.when(F.col("action") == "drop", F.lit("dropped"))
        .when(F.col("priority").isNull(), F.lit("unknown_category"))
        .when(F.col("__curated"), F.lit("already_curated"))
        .otherwise(F.lit("merged"))
    )
    marked = marked.withColumn("outcome", F.coalesce(outcome, F.lit("merged")))
    rank = F.lit(0)
    for name, value in CONFIDENCE_RANK.items():
        rank = F.when(F.col("confidence") == name, F.lit(value)).otherwise(rank)
    used = marked.filter(F.col("outcome") == "merged").withColumn("__rank", rank)
    votes = used.groupBy("keyword", "category", "priority", "__rank", "confidence").agg(
        F.count("*").alias("__votes"),
        F.array_join(F.array_sort(F.collect_set("expert")), ", ").alias("experts"),
        F.array_join(
            F.array_sort(F.collect_list(F.concat(F.lit("["), "expert", F.lit("] "), "reasoning"))), " | "
        ).alias("reasoning"),
    )
    tops = used.groupBy("keyword").agg(F.max("__rank").alias("__top"))
    contest = votes.join(tops, "keyword").filter(F.col("__rank") == F.col("__top"))
    order = [F.desc("__votes"), F.coalesce("priority", F.lit(UNKNOWN_PRIORITY)), F.col("category")]
    placed = first_per_group(contest, ["keyword"], order, 2, rank="__place")
    winners = placed.filter(F.col("__place") == 1).drop("__place", "__top", "__rank", "priority")
    seconds = placed.filter(F.col("__place") == 2).select("keyword", F.col("__votes").alias("__second"))
    rejected = (
        used.join(winners.select("keyword", F.col("category").alias("__won")), "keyword")
        .filter(F.col("category") != F.col("__won"))
        .groupBy("keyword")
        .agg(
            F.array_join(
                F.array_sort(F.collect_list(F.concat_ws(":", "expert", "category", "confidence"))), ", "
            ).alias("rejected")
        )
    )
    resolved = (
        F.when(F.col("rejected").isNull(), F.lit(None).cast("string"))
        .when(F.col("__second").isNull(), F.lit("confidence"))
        .when(F.col("__second") == F.col("__votes"), F.lit("priority"))
        .otherwise(F.lit("majority"))
    )
    merged = (
        winners.join(seconds, "keyword", "left")
        .join(rejected, "keyword", "left")
        .select("keyword", "category", "confidence", "experts", "reasoning", "rejected", resolved.alias("resolved_by"))
    )
    return merged, marked.groupBy("outcome").agg(F.count("*").alias("proposals"))


def merge_categories(existing: DataFrame, proposed: DataFrame, limit: int = SENTINEL_PRIORITY) -> DataFrame:
    """New categories of the experts: one per id, described by the first expert, next priorities.

    Priorities continue after the largest one below the sentinels; a number that would reach
    ``limit`` is an error, since it would collide with them.
    """
    new = proposed.join(existing.select("category"), "category", "left_anti")
    described = new.groupBy("category").agg(
        F.min_by("label", "expert").alias("label"),
        F.min_by("description", "expert").alias("description"),
        F.array_join(F.array_sort(F.collect_set("expert")), ", ").alias("experts"),
    )
    last = existing.filter(F.col("priority") < SENTINEL_PRIORITY).agg(
        F.greatest(F.coalesce(F.max("priority"), F.lit(0)), F.lit(0)).alias("__last")
    )
    # One row for each category of a lexicon that people write, so one ordering over them is small.
    numbered = described.withColumn("__n", F.row_number().over(W.orderBy("category"))).join(F.broadcast(last), F.lit(True))
    priority = F.col("__last") + F.col("__n")
    refused = F.raise_error(F.concat(F.lit("no priority is left for category "), F.col("category"))).cast("int")
    return numbered.select(
        "category", "label", "description", "experts", F.when(priority < limit, priority).otherwise(refused).alias("priority")
    )
