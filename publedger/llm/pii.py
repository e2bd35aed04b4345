"""Personal data: base patterns, and bootstrapped contextual extraction, in DataFrame functions only.

Base spans come from four fixed patterns with their checks. They are the seeds: the word before and the
word after a seed are lexical patterns, and what else stands in those places are instances. Patterns and
instances form a graph that is scored in rounds: a pattern's confidence is the scored share of all places
in the corpus where its word stands in that role, an instance's score is the chance that one of its patterns is
right. Instances that end above ``ACCEPT`` become spans of the kind; base spans always stay.

Positions come without user code: what a pattern leaves when it splits the text, and what it extracts, are
laid end to end, in code points. The patterns are the contract's in possessive form and start only where a match
can start, so they run in linear time on texts of any length.

Defined cases: null text is empty; rows that repeat a doc_id are each returned; a null doc_id is returned
like any other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from publedger.llm.common import union_all
from publedger.session import cut_lineage

#: Kinds in the order of the result, each with the characters without which it cannot occur.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
#: What may be an identifier: a token with a digit or an at sign.
CANDIDATE = (r"(?:\G|(?<![^\x20\x09-\x0D]))[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+", "[0-9@]")
SPACES = r"[\x20\x09-\x0D]+"
BYTE = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: A pattern needs so many distinct seeds; an instance so much score, and so many digits or an at sign.
LEAST_SEEDS, ACCEPT, LEAST_DIGITS = 3, 0.9, 5
ROUNDS = 3
LUHN = (
    "aggregate(transform(sequence(1, length(digits)), i -> cast(substr(reverse(digits), i, 1) as int) * if(i % 2 = 0, 2, 1)),"
    " 0, (total, x) -> total + if(x > 9, x - 9, x)) % 10 = 0"
)


def _places(text: Column, pattern: str, needs: str) -> tuple[Column, Callable[[Column, Column], Column]]:
    """The text cut by a pattern, and the struct of a match in it: the code points since the last match, the
    match, the words beside it."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    plain = lambda c: F.translate(c, "\t\n\x0b\x0c\r", "     ")
    before = lambda c: F.substring_index(F.rtrim(plain(c)), " ", -1)
    after = lambda c: F.substring_index(F.ltrim(plain(c)), " ", 1)

    def place(match: Column, i: Column) -> Column:
        left, right = F.get(F.col("parts"), i), F.get(F.col("parts"), i + 1)
        return F.struct(F.length(left).alias("gap"), match.alias("match"), F.lower(before(left)).alias("left"), F.lower(after(right)).alias("right"))

    return F.when(text.rlike(needs), F.struct(parts.alias("parts"), found.alias("found"))), place


def _with_places(docs: DataFrame) -> DataFrame:
    """``row, doc_id`` and one array of places for each kind and for the candidates; written once."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    for kind, (pattern, needs) in {**KINDS, "token": CANDIDATE}.items():
        cut, place = _places(F.col("text"), pattern, needs)
        rows = rows.withColumn("cut", cut).withColumn("parts", F.col("cut.parts")).withColumn(kind, F.transform("cut.found", place)).drop("cut", "parts")
    return cut_lineage(rows.drop("text"), "places")


def _exploded(found: DataFrame, kind: str) -> DataFrame:
    rows = found.filter(F.size(kind) > 0).select("row", F.lit(kind).alias("kind"), F.posexplode(kind).alias("pos", "p")).select("row", "kind", "pos", "p.*")
    size = F.length("match")
    through = W.partitionBy("row").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("gap") + size).over(through)
    return rows.select("row", "kind", (end - size).alias("start"), end.alias("end"), "match", "left", "right")


def _valid(spans: DataFrame) -> DataFrame:
    digits = spans.withColumn("digits", F.regexp_replace("match", "[^0-9]", ""))
    count = F.length("digits")
    checks = {
        "email": F.lit(True),
        "ip": F.col("match").rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
        "card": F.when(count.between(13, 19), F.expr(LUHN)).otherwise(False),
        "phone": count.between(9, 15),
    }
    right = F.lit(False)
    for kind, check in checks.items():
        right = F.when(F.col("kind") == kind, check).otherwise(right)
    return digits.filter(right).drop("digits")


def base_spans(found: DataFrame) -> DataFrame:
    """``row, kind, start, end, match, left, right`` of the fixed patterns."""
    return _valid(union_all([_exploded(found, kind) for kind in KINDS]))


def free_tokens(found: DataFrame, spans: DataFrame) -> DataFrame:
    """Candidate tokens that touch no base span, less the punctuation around them."""
    tokens = _exploded(found, "token")
    head = F.length("match") - F.length(F.regexp_replace("match", "^[^A-Za-z0-9@+]+", ""))
    bare = F.regexp_replace(F.regexp_replace("match", "^[^A-Za-z0-9@+]+", ""), "[^A-Za-z0-9]+$", "")
    tokens = tokens.withColumn("start", F.col("start") + head).withColumn("match", bare).withColumn("end", F.col("start") + F.length("match"))
    enough = (F.length(F.regexp_replace("match", "[^0-9]", "")) >= LEAST_DIGITS) | F.col("match").contains("@")
    both = tokens.filter(enough).withColumn("base", F.lit(False)).unionByName(spans.withColumn("base", F.lit(True)))
    line = W.partitionBy("row").orderBy("start", "end")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(line.rowsBetween(W.unboundedPreceding, -1))
    following = F.min(F.when(F.col("base"), F.col("start"))).over(line.rowsBetween(1, W.unboundedFollowing))
    marked = both.withColumn("reach", reach).withColumn("next", following)
    free = ~F.col("base") & (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next") >= F.col("end"), F.lit(True)))
    return marked.filter(free).drop("base", "reach", "next", "kind")


def _edges(rows: DataFrame, *keep: str) -> DataFrame:
    """``pattern, instance, n``: how often each instance stands beside each pattern word."""
    sides = F.array(F.concat(F.lit("<"), F.col("left")), F.concat(F.lit(">"), F.col("right")))
    paired = rows.select(*keep, F.lower("match").alias("instance"), F.explode(sides).alias("pattern")).filter(F.length("pattern") > 1)
    return paired.groupBy(*keep, "pattern", "instance").agg(F.count("*").alias("n"))


def learned_instances(docs: DataFrame, spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """``instance, kind``: the tokens that high-confidence patterns find."""
    seeds = cut_lineage(_edges(spans, "kind"), "seed-edges")
    telling = seeds.groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).filter(F.col("seeds") >= LEAST_SEEDS)
    words = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), SPACES)).alias("word")).groupBy("word").agg(F.count("*").alias("total"))
    patterns = cut_lineage(telling.withColumn("word", F.expr("substr(pattern, 2)")).join(words, "word").select("pattern", "kind", "total"), "patterns")
    known = seeds.select("instance").distinct()
    fresh = _edges(tokens).join(known, "instance", "left_anti")
    edges = cut_lineage(fresh.join(patterns.select("pattern").distinct(), "pattern", "left_semi"), "instance-edges")
    seeded = cut_lineage(seeds.join(patterns, ["pattern", "kind"]).groupBy("pattern", "kind", "total").agg(F.sum("n").alias("seeded")), "seeded-patterns")
    scores = None
    for _ in range(ROUNDS):
        told = seeded.withColumn("found", F.lit(0.0))
        if scores is not None:
            more = edges.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("found"))
            told = seeded.join(more, ["pattern", "kind"], "left").withColumn("found", F.coalesce("found", F.lit(0.0)))
        confidence = F.least((F.col("seeded") + F.col("found")) / (F.col("total") + 1), F.lit(0.999))
        confident = cut_lineage(told.select("pattern", "kind", confidence.alias("confidence")), "pattern-scores")
        missed = F.sum(F.log(1 - F.col("confidence")))
        scores = cut_lineage(edges.join(confident, "pattern").groupBy("instance", "kind").agg((1 - F.exp(missed)).alias("score")), "instance-scores")
    best = scores.filter(F.col("score") >= ACCEPT).groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    return cut_lineage(best, "learned-instances")


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` for every row: (order, start, end, kind, match, base) in the order of the kinds."""
    found = _with_places(docs)
    spans = cut_lineage(base_spans(found), "base-spans")
    tokens = cut_lineage(free_tokens(found, spans), "free-tokens")
    learned = tokens.join(learned_instances(docs, spans, tokens), F.lower("match") == F.col("instance"))
    both = spans.select("row", "kind", "start", "end", "match", F.lit(True).alias("base")).unionByName(
        learned.select("row", "kind", "start", "end", "match", F.lit(False).alias("base"))
    )
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    listed = both.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(order.alias("order"), "start", "end", "kind", "match", "base"))).alias("all"))
    return found.select("row", "doc_id").join(listed, "row", "left").select("doc_id", F.coalesce("all", F.array()).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
