"""Joins by name, by interval and by nearest date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from publedger.functions.dates import iso_day
from publedger.functions.numbers import half_up, share_of
from publedger.functions.text import (
    QUOTES,
    SPACE,
    is_government_name,
    js_trim,
    norm_entity,
    norm_name,
    person_id,
    squeeze,
    supplier_id,
)
from publedger.functions.titles import covers_multiple
from publedger.operators.common import middle_values
from publedger.session import cut_lineage

#: Characters of the runs that names of one word are anchored on.
RUN = 6
#: Characters of a word that its beginnings and ends are listed up to.
EDGE = 16
ALIAS_MIN_LENGTH = 4
NAME_MIN_LENGTH = 6
TIMING_WINDOW_DAYS = 90
# Fixed value: leading words a ministry alias may also be met without.
MINISTRY_LEAD = "^(?:המשרד ל|משרד ה|משרד )"


def _piece(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("piece"))


def _needle_pieces(needle: str) -> Column:
    """Pieces that any text with the needle has a word for. An inner word stands whole, the first word
    ends a word of the text, the last one begins one; a needle of one word lies inside a word. Where
    there are several inner words the edges are not needed."""
    words = F.split(needle, " ")
    inner = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda w: _piece("whole", w))
    edges = F.array(_piece("ends", F.right(F.element_at(words, 1), F.lit(EDGE))), _piece("begins", F.left(F.element_at(words, -1), F.lit(EDGE))))
    length = F.least(F.length(needle), F.lit(RUN))
    starts = F.sequence(F.lit(1), F.greatest(F.length(needle) - length + 1, F.lit(1)))
    single = F.transform(starts, lambda i: _piece("run", F.substring(F.col(needle), i, length)))
    pieces = F.when(F.size(words) > 3, inner).when(F.size(words) > 1, F.concat(inner, edges)).otherwise(single)
    return F.filter(F.array_distinct(pieces), lambda p: p["piece"] != "")


def _lengths_in_use(asked: DataFrame) -> DataFrame:
    """One row: the lengths of the pieces asked for, at most ``EDGE`` numbers a kind."""
    kinds = ("whole", "begins", "ends", "run")
    return asked.agg(*[F.collect_set(F.when(F.col("kind") == k, F.least(F.length("piece"), F.lit(EDGE)))).alias(f"__{k}") for k in kinds])


def _listed_words(in_text: DataFrame, asked: DataFrame, used: DataFrame, by: list[str]) -> DataFrame:
    """``*by, word, n``: distinct words of the texts that can be met, and the number of texts they stand in.

    Where only whole words are asked for, all others are gone before anything is counted.
    """
    whole = asked.filter(F.col("kind") == "whole").select(*by, F.col("piece").alias("word"), F.lit(True).alias("__asked")).distinct()
    by_part = F.size("__begins") + F.size("__ends") + F.size("__run") > 0
    met = in_text.filter("word <> ''").join(F.broadcast(used), F.lit(True)).join(whole, [*by, "word"], "left")
    return met.filter(by_part | F.col("__asked").isNotNull()).groupBy(*by, "word").agg(F.count("*").alias("n"))


def _word_pieces(words: DataFrame, used: DataFrame) -> DataFrame:
    """``words`` with one row for each ``kind, piece`` a word can be met by, of the kinds and lengths in use."""
    word, size = F.col("word"), F.length("word")

    def fitting(kind: str) -> Column:
        return F.filter(f"__{kind}", lambda n: n <= size)

    def runs(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: _piece("run", F.substring(word, i, n)))

    pieces = F.concat(
        F.filter(F.array(_piece("whole", word)), lambda p: F.array_contains("__whole", F.least(size, F.lit(EDGE)))),
        F.transform(fitting("begins"), lambda n: _piece("begins", F.substring(word, F.lit(1), n))),
        F.transform(fitting("ends"), lambda n: _piece("ends", F.substring(word, -n, n))),
        F.flatten(F.transform(fitting("run"), runs)),
    )
    kept = [F.col(f"`{c}`") for c in words.columns]
    return words.join(F.broadcast(used), F.lit(True)).select(*kept, F.explode(pieces).alias("p")).select(*words.columns, "p.*")


def _stands_for(word: str, needle: str) -> Column:
    """Whether a word with the needle's piece can be its place in a text."""
    words, kind = F.split(needle, " "), F.col("kind")
    return (
        F.when(kind == "begins", F.startswith(F.col(word), F.element_at(words, -1)))
        .when(kind == "ends", F.endswith(F.col(word), F.element_at(words, 1)))
        .when(kind == "run", F.contains(F.col(word), F.col(needle)))
        .otherwise(F.lit(True))
    )


def substring_matches(
    texts: DataFrame, needles: DataFrame, by: list[str] | None = None, min_length: int = NAME_MIN_LENGTH
) -> DataFrame:
    """Pairs ``text_id, *by, needle`` where the text contains the needle, within equal ``by``.

    ``texts``: text_id (unique), *by, text. ``needles``: *by, needle (distinct here). Text and needles must
    have single spaces; needles have at least ``min_length`` characters.

    Only distinct words of the texts are cut into pieces. They are listed once with the number of texts
    they stand in; every needle is resolved to the words that its rarest piece can stand for (an inner
    word itself, words that end with its first or begin with its last word, words that hold a run of a
    one-word needle), and texts meet needles through those words alone. A text gives at most one row for
    each of its words, and only candidates are verified. Those rows carry the text_id, so it should be short.
    """
    by = by or []
    held = texts.select("text_id", *by, "text")
    pairs = candidate_pairs(texts, needles, by, min_length)
    verified = held.join(pairs, "text_id").filter(F.contains("text", F.col("needle")))
    return verified.select("text_id", *by, "needle")


def candidate_pairs(texts: DataFrame, needles: DataFrame, by: list[str], min_length: int) -> DataFrame:
    """Distinct pairs ``text_id, needle`` of :func:`substring_matches` before they are verified."""
    pool = needles.select(*by, "needle").filter(F.length("needle") >= min_length).distinct()
    # explode_outer: an inner explode would have its array computed once more in a pushed filter.
    in_text = texts.select("text_id", *by, F.explode_outer(F.array_distinct(F.split("text", " "))).alias("word"))
    asked = pool.select(*by, "needle", F.explode(_needle_pieces("needle")).alias("p")).select(*by, "needle", "p.*")
    asked = cut_lineage(asked, "needle-pieces")
    used = _lengths_in_use(asked)
    key = [*by, "kind", "piece"]
    pieces = _word_pieces(_listed_words(in_text, asked, used, by), used)
    met = cut_lineage(pieces.join(asked.select(*key).distinct(), key, "left_semi"), "word-pieces")
    costs = met.groupBy(*key).agg(F.sum("n").alias("cost"))
    # A piece that no word has leaves its needle without a match, so it costs nothing to choose it.
    priced = asked.join(costs, key, "left").withColumn("cost", F.coalesce("cost", F.lit(0)))
    rarest = priced.groupBy(*by, "needle").agg(F.min_by(F.struct("kind", "piece"), F.struct("cost", "kind", "piece")).alias("p"))
    chosen = rarest.select(*by, "needle", "p.*")
    stands = met.select(*key, "word").join(chosen, key).filter(_stands_for("word", "needle")).select(*by, "word", "needle")
    # Written, so that its true size decides how the words of all texts meet it.
    return in_text.join(cut_lineage(stands, "needle-words"), [*by, "word"]).select("text_id", "needle").distinct()


def match_office(rows: DataFrame, office: str, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Section of each office name by alias, and the counts of unmatched offices.

    ``aliases``: section_id, seq, alias. Either text may contain the other; of several sections
    the first in list order wins. Only distinct office names are matched.
    """
    usable = aliases.select("section_id", "seq", norm_name("alias").alias("needle")).filter(
        F.length("needle") >= ALIAS_MIN_LENGTH
    )
    offices = (
        rows.filter(F.col(office).isNotNull()).groupBy(F.col(office).alias("text_id")).agg(F.count("*").alias("rows"))
    )
    offices = offices.withColumn("text", norm_name("text_id"))
    forward = substring_matches(offices, usable, min_length=ALIAS_MIN_LENGTH)
    # The other direction, an office name that is a piece of an alias: aliases are short, so
    # all their pieces are listed once and met by equality.
    length = F.length("needle")
    pieces = F.flatten(
        F.transform(
            F.sequence(F.lit(1), length),
            lambda i: F.transform(
                F.sequence(F.lit(1), length - i + 1), lambda n: F.substring(F.col("needle"), i, n)
            ),
        )
    )
    spoken = usable.select("needle").distinct()
    listed = spoken.select("needle", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), pieces))).alias("text"))
    backward = offices.select("text_id", "text").join(listed, "text").select("text_id", "needle")
    winners = (
        forward.unionByName(backward)
        .join(usable, "needle")
        .groupBy("text_id")
        .agg(F.min_by("section_id", "seq").alias("section_id"))
        .withColumnRenamed("text_id", office)
    )
    unmatched = offices.withColumnRenamed("text_id", office).join(winners, office, "left_anti").select(office, "rows")
    return rows.join(winners, office), unmatched


def alias_variants(aliases: DataFrame) -> DataFrame:
    """Each alias with and without the leading ministry word, at least four characters long."""
    name = norm_name("alias")
    short = F.regexp_replace(name, MINISTRY_LEAD, "")
    return (
        aliases.filter(F.length(name) >= ALIAS_MIN_LENGTH)
        .select("section_id", "seq", F.explode(F.array_distinct(F.array(name, short))).alias("needle"))
        .filter(F.length("needle") >= ALIAS_MIN_LENGTH)
    )


def match_title(rows: DataFrame, title: str, aliases: DataFrame) -> DataFrame:
    """``title`` and ``section_id`` by the longest alias variant a title contains; null if none."""
    variants = alias_variants(aliases)
    titles = rows.select(F.col(title).alias("text_id")).distinct().withColumn("text", norm_name("text_id"))
    longest = F.struct(-F.length("needle"), F.col("seq"))
    winners = (
        substring_matches(titles, variants, min_length=ALIAS_MIN_LENGTH)
        .join(variants, "needle")
        .groupBy("text_id")
        .agg(F.min_by("section_id", longest).alias("section_id"))
    )
    return titles.select("text_id").join(winners, "text_id", "left").withColumnRenamed("text_id", title)


def match_exact(rows: DataFrame, name: str, names: DataFrame) -> DataFrame:
    """``section_id`` by exact name after collapsing spaces; null when nothing is equal.

    ``names``: section_id, seq, name; the first section in list order wins.
    """
    listed = names.groupBy(squeeze("name").alias("__name")).agg(F.min_by("section_id", "seq").alias("section_id"))
    keyed = rows.withColumn("__name", squeeze(name))
    return keyed.join(listed.filter(F.col("__name") != ""), "__name", "left").drop("__name")


def build_tenures(positions: DataFrame, persons: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tenures out of appointments, and the counts of appointments that gave none.

    ``positions``: position_id, person_id, duty, ministry_name, start_date, finish_date (text).
    ``persons``: person_id, first_name, last_name.
    """
    full = F.concat_ws(" ", F.nullif(js_trim("first_name"), F.lit("")), F.nullif(js_trim("last_name"), F.lit("")))
    people = persons.select("person_id", F.nullif(full, F.lit("")).alias("person_name"))
    joined = match_exact(positions.join(people, "person_id", "left"), "ministry_name", names)
    role = js_trim(F.coalesce("duty", F.lit("")))
    outcome = (
        F.when(F.col("person_name").isNull(), F.lit("without_name"))
        .when(F.col("section_id").isNull(), F.lit("without_section"))
        .when(role == "", F.lit("without_role"))
        .otherwise(F.lit("tenure"))
    )
    marked = joined.withColumn("outcome", outcome).withColumn("role", role)
    tenures = marked.filter(F.col("outcome") == "tenure").select(
        F.concat(F.lit("tenure-"), F.col("position_id").cast("string")).alias("tenure_id"),
        "person_name",
        "role",
        "section_id",
        iso_day("start_date").alias("start_date"),
        iso_day("finish_date").alias("end_date"),
    )
    return tenures, marked.groupBy("outcome").agg(F.count("*").alias("appointments"))


def tenure_segments(tenures: DataFrame, windows: DataFrame) -> DataFrame:
    """Each tenure clipped to each window of its section it overlaps.

    ``windows``: section_id, window_start, window_end. A tenure without a start cannot be
    placed and is left out; one without an end runs to the end of the window.
    """
    spans = windows.filter(F.col("window_end") >= F.col("window_start"))
    reach = spans.groupBy("section_id").agg(F.min("window_start").alias("__first"), F.max("window_end").alias("__last"))
    since, until = F.greatest("start_date", "__first"), F.coalesce(F.least("end_date", "__last"), "__last")
    dated = tenures.filter(F.col("start_date").isNotNull()).join(reach, "section_id").filter(since <= until)
    # A tenure and a window meet in the year of their first common day, and only there.
    placed = dated.withColumn("__year", F.explode(F.sequence(F.year(since), F.year(until)))).drop("__first", "__last")
    yearly = spans.withColumn("__year", F.explode(F.sequence(F.year("window_start"), F.year("window_end"))))
    end = F.coalesce("end_date", "window_end")
    overlap = (F.col("start_date") <= F.col("window_end")) & (end >= F.col("window_start"))
    first_common = F.year(F.greatest("start_date", "window_start"))
    joined = placed.join(yearly, ["section_id", "__year"]).filter(overlap & (F.col("__year") == first_common)).drop("__year")
    window_days = F.datediff("window_end", "window_start") + 1
    clipped = joined.withColumn("from_date", F.greatest("start_date", "window_start")).withColumn(
        "to_date", F.least(end, F.col("window_end"))
    )
    days = F.datediff("to_date", "from_date") + 1
    return (
        clipped.filter(F.col("to_date") >= F.col("from_date"))
        .withColumn("days", days)
        .withColumn("share_percent", share_of(days, window_days))
    )


def attribute_window(tenures: DataFrame, windows: DataFrame) -> DataFrame:
    """Who held the office in each window: segments, split flag, uncovered days, main holder.

    Uncovered days are counted on the union of the segments. Segments are first reduced to
    one per start day, so a window never weighs more than its own number of days.
    """
    key = ["section_id", "window_start", "window_end"]
    segments = tenure_segments(tenures, windows)
    holders = segments.groupBy(*key).agg(
        F.count("*").alias("segments"),
        (F.min("person_name") != F.max("person_name")).alias("is_split"),
        F.min_by(
            F.struct("person_name", "days", "share_percent"),
            F.struct(-F.col("days"), F.col("from_date"), F.col("tenure_id")),
        ).alias("__main"),
    )
    starts = segments.groupBy(*key, "from_date").agg(F.max("to_date").alias("to_date"))
    earlier = W.partitionBy(*key).orderBy("from_date").rowsBetween(W.unboundedPreceding, -1)
    reached = F.max("to_date").over(earlier)
    new_from = F.greatest(F.col("from_date"), F.coalesce(F.date_add(reached, 1), F.col("from_date")))
    covered = (
        starts.withColumn("__new", F.greatest(F.datediff(F.col("to_date"), new_from) + 1, F.lit(0)))
        .groupBy(*key)
        .agg(F.sum("__new").alias("__covered"))
    )
    joined = windows.select(*key).join(holders, key, "left").join(covered, key, "left")
    valid = F.col("window_end") >= F.col("window_start")
    total = F.datediff("window_end", "window_start") + 1
    uncovered = F.when(valid, F.greatest(F.lit(0), total - F.coalesce("__covered", F.lit(0)))).otherwise(F.lit(0))
    return joined.select(
        *key,
        F.coalesce("segments", F.lit(0)).alias("segments"),
        F.coalesce("is_split", F.lit(False)).alias("is_split"),
        uncovered.alias("uncovered_days"),
        F.col("__main.person_name").alias("main_holder"),
        F.col("__main.days").alias("main_days"),
        F.col("__main.share_percent").alias("main_share_percent"),
    )


def name_pool(suppliers: DataFrame, recipients: DataFrame) -> DataFrame:
    """Names worth looking for: suppliers and support recipients, no government bodies."""
    a = suppliers.select(
        "section_id", F.col("supplier").alias("name"), F.col("volume").alias("amount"), F.lit("supplier").alias("kind")
    )
    b = recipients.select(
        "section_id", F.col("recipient").alias("name"), F.col("approved").alias("amount"), F.lit("support").alias("kind")
    )
    return (
        a.unionByName(b)
        .filter(~is_government_name("name"))
        .withColumn("needle", norm_entity("name"))
        .filter(F.length("needle") >= NAME_MIN_LENGTH)
    )


def cross_reference(entries: DataFrame, pool: DataFrame) -> DataFrame:
    """Calendar rows whose subject names a supplier or support recipient of the same section."""
    distinct_subjects = (
        entries.filter(F.col("section_id").isNotNull())
        .select("section_id", "subject")
        .distinct()
        .withColumn("text", norm_entity("subject"))
        .filter(F.length("text") >= NAME_MIN_LENGTH)
        .withColumn("text_id", F.struct("section_id", "subject"))
    )
    # Subjects are listed, met and verified, names cut into pieces and joined back.
    distinct_subjects, pool = cut_lineage(distinct_subjects, "subjects"), cut_lineage(pool, "names")
    pairs = substring_matches(distinct_subjects, pool, ["section_id"])
    named = pairs.select("section_id", F.col("text_id.subject").alias("subject"), "needle").join(
        pool, ["section_id", "needle"]
    )
    shared = covers_multiple("title")
    return entries.join(named, ["section_id", "subject"]).select(
        F.when(F.col("kind") == "supplier", F.lit("supplier_meeting"))
        .otherwise(F.lit("support_recipient_meeting"))
        .alias("rule_id"),
        "entry_id",
        "section_id",
        F.when(~shared, F.col("person_label")).alias("person_label"),
        "role_label",
        "person_key",
        "date",
        "subject",
        F.col("name").alias("matched_name"),
        "amount",
        "kind",
    )


def timing_name(c: Column | str) -> Column:
    """Name form of the timing join: quotes dropped, spaces collapsed, lower case."""
    text = F.regexp_replace(c if isinstance(c, Column) else F.col(c), QUOTES, "")
    return F.lower(F.trim(F.regexp_replace(text, SPACE + "+", " ")))


def meeting_timing(matches: DataFrame, contracts: DataFrame, window_days: int = TIMING_WINDOW_DAYS) -> DataFrame:
    """Each dated match with the contract closest in time of the same name and section.

    ``matches``: section_id, matched_name, date, entry_id. ``contracts``: section_id, supplier,
    order_date, seq. Names are paired first, then both sides are reduced to days, and the
    neighbours before and after each day are looked up; no meeting meets every contract.
    """
    targets = matches.filter(F.col("date").isNotNull()).withColumn("__target", timing_name("matched_name"))
    held = contracts.filter(F.col("order_date").isNotNull()).withColumn("__supplier", timing_name("supplier"))
    names = held.select("section_id", F.col("__supplier").alias("text")).distinct()
    wanted = targets.select("section_id", F.col("__target").alias("needle")).filter(F.col("needle") != "").distinct()
    pairs = substring_matches(
        names.withColumn("text_id", F.struct("section_id", "text")), wanted, ["section_id"], min_length=1
    ).select("section_id", F.col("text_id.text").alias("__supplier"), F.col("needle").alias("__target"))
    contract_days = (
        held.groupBy("section_id", "__supplier", "order_date")
        .agg(F.min("seq").alias("__seq"))
        .join(pairs, ["section_id", "__supplier"])
        .groupBy("section_id", "__target", F.col("order_date").alias("day"))
        .agg(F.min("__seq").alias("__seq"))
    )
    meeting_days = targets.select("section_id", "__target", F.col("date").alias("day")).distinct()
    key = ["section_id", "__target"]
    days = (
        contract_days.withColumn("__meeting", F.lit(False))
        .unionByName(meeting_days.withColumn("__meeting", F.lit(True)), allowMissingColumns=True)
        .groupBy(*key, "day")
        .agg(F.max("__meeting").alias("__meeting"), F.min("__seq").alias("__seq"))
        .withColumn("__c", F.when(F.col("__seq").isNotNull(), F.struct("day", "__seq")))
    )
    order = W.partitionBy(*key).orderBy("day")
    before = F.last("__c", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    after = F.first("__c", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))

    def scored(c: str) -> Column:
        gap = F.datediff(F.col(f"{c}.day"), F.col("day"))
        return F.when(
            F.col(c).isNotNull(),
            F.struct(F.abs(gap).alias("size"), F.col(f"{c}.__seq").alias("seq"), gap.alias("gap")),
        )

    nearest = (
        days.withColumn("__b", before)
        .withColumn("__a", after)
        .filter("__meeting")
        .withColumn("__best", F.least(scored("__b"), scored("__a")))
        .select(*key, F.col("day").alias("date"), "__best")
    )
    gap = F.col("__best.gap")
    return (
        targets.join(nearest, [*key, "date"])
        .filter(F.col("__best").isNotNull())
        .drop("__target")
        .withColumn("contract_seq", F.col("__best.seq"))
        .withColumn("days_before_order", gap)
        .withColumn("within_window", (gap >= 0) & (gap <= window_days))
        .drop("__best")
    )


def entity_meetings(entries: DataFrame, pool: DataFrame, contracts: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The matches of one entity (by :func:`supplier_id`), written, and their timing.

    A name is matched and timed apart from all others, so only the entity's names are looked for, and only
    contracts whose supplier can hold one of them are read further.
    """
    matches = cut_lineage(cross_reference(entries, pool.filter(supplier_id("name") == name)), "matches")
    spoken = timing_name(F.replace("supplier", F.lit("/"), F.lit("-")))
    held = contracts.filter(F.contains(spoken, timing_name(F.lit(name))))
    return matches, meeting_timing(matches, held)


def timing_summary(matches: DataFrame, contracts: DataFrame, timed: DataFrame) -> DataFrame:
    """Per section: timed and unplaceable matches, median lead, contracts without a match."""
    total = matches.groupBy("section_id").agg(F.count("*").alias("matches"))
    held = contracts.filter(F.col("order_date").isNotNull()).groupBy("section_id").agg(
        F.count("*").alias("contracts_held")
    )
    placed = timed.groupBy("section_id").agg(
        F.count("*").alias("timed"), F.count_if("within_window").alias("within_window")
    )
    used = timed.select("section_id", "contract_seq").distinct().groupBy("section_id").agg(
        F.count("*").alias("__used")
    )
    leads = middle_values(timed.filter(F.col("days_before_order") >= 0), ["section_id"], "days_before_order")
    median = leads.select("section_id", half_up((F.col("lo") + F.col("hi")) / 2, 1).alias("median_days_before"))
    zero = F.lit(0)
    joined = total.join(held, "section_id", "left").join(placed, "section_id", "left")
    joined = joined.join(used, "section_id", "left").join(median, "section_id", "left")
    return joined.select(
        "section_id",
        F.coalesce("timed", zero).alias("timed"),
        (F.col("matches") - F.coalesce("timed", zero)).alias("unplaceable"),
        F.coalesce("within_window", zero).alias("within_window"),
        "median_days_before",
        (F.coalesce("contracts_held", zero) - F.coalesce("__used", zero)).alias("contracts_without_match"),
        F.coalesce("contracts_held", zero).alias("contracts_held"),
    )


def person_join(tenures: DataFrame, profiles: DataFrame) -> DataFrame:
    """Tenures with the calendar profiles of the same person id."""
    named = profiles.filter(F.col("person_label").isNotNull()).withColumn("person_id", person_id("person_label"))
    side = named.select("person_id", "person_key", "entry_count")
    return tenures.withColumn("person_id", person_id("person_name")).join(side, "person_id", "left")


def prior_year(lines: DataFrame, measures: list[str]) -> DataFrame:
    """Each line with the same code's figures of the year before, null where there is none.

    A self-join on code and year, because the year before may be missing.
    """
    previous = lines.select(
        "section_id", "code", (F.col("year") + 1).alias("year"), *[F.col(m).alias(f"prior_{m}") for m in measures]
    )
    return lines.join(previous, ["section_id", "code", "year"], "left")

