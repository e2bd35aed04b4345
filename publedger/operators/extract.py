"""Calendar rows out of tables of fields, grid cells, text lines and HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from publedger.functions.dates import parse_diary_date, parse_diary_time
from publedger.functions.text import SPACE, js_trim, squeeze
from publedger.functions.web import (
    ANCHOR,
    LINK_TEXT_LENGTH,
    decode_entities,
    is_file_address,
    resolve_url,
)
from publedger.operators.common import first_per_group
from publedger.session import cut_lineage

# Header words of a table's fields, in the order they are tried.
FIELD_TARGETS = (
    ("נושא", "subject"),
    ("נושא הפגישה", "subject"),
    ("nvsh", "subject"),
    ("תאריך התחלה", "start_date"),
    ("תאריך", "start_date"),
    ("tryk htkhlh", "start_date"),
    ("tryk", "start_date"),
    ("שעת התחלה", "start_time"),
    ("שעה", "start_time"),
    ("sht htkhlh", "start_time"),
    ("תאריך סיום", "end_date"),
    ("tryk syvm", "end_date"),
    ("שעת סיום", "end_time"),
    ("sht syvm", "end_time"),
    ("מיקום", "location"),
    ("myqvm", "location"),
    ("משתתפים", "participants"),
    ("mshttpym", "participants"),
)
SYSTEM_FIELDS = ("_id", "_full_text")
PREFIX_MIN_LENGTH, PREFIX_SLACK = 4, 2
# Header patterns of a grid, in the order they are tried.
HEADER_PATTERNS = (
    ("^נושא|נושא הפגישה|נושא הפעילות|תיאור|פעילות$", "subject"),
    (f"תאריך{SPACE}*(?:התחלה|הפגישה|יום)?$|^תאריך", "start_date"),
    (f"שעת{SPACE}*התחלה|^שעה|משעה", "start_time"),
    (f"שעת{SPACE}*סיום|עד שעה|^סיום", "end_time"),
    ("מיקום|מקום|כתובת|אולם", "location"),
    ("משתתפים|נוכחים|מוזמנים|עם מי", "participants"),
)
GRID_FIELDS = ("subject", "start_date", "start_time", "end_time", "location", "participants")
HEADER_ROWS, BLANK_RUN, ROW_BLOCK = 20, 30, 10_000
DATE_IN_LINE = r"(\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{2}-\d{2})"
TIME_IN_LINE = r"(\d{1,2}:\d{2})"
RANGE_IN_LINE = rf"((\d{{1,2}}:\d{{2}}){SPACE}*(?:-|–|—|עד){SPACE}*(\d{{1,2}}:\d{{2}}))"
HEADING_MAX_LENGTH, SUBJECT_MIN_LENGTH = 12, 2
LINE_EDGE = r"[\s|:•\-–—*]"
NO_SUBJECT = "ללא נושא רשום"


def norm_field(c: Column | str) -> Column:
    text = F.lower(c if isinstance(c, Column) else F.col(c))
    return squeeze(F.regexp_replace(F.replace(text, F.lit("_"), F.lit(" ")), "[׳״\"'`]", ""))


def field_target(c: Column | str, targets: tuple = FIELD_TARGETS) -> Column:
    """Target of a field name: an exact synonym, else one of nearly equal length that shares a start."""
    name = norm_field(c)
    exact = F.when(F.lit(False), F.lit(""))
    near = F.when(F.lit(False), F.lit(""))
    for synonym, target in targets:
        word = F.lit(synonym)
        exact = exact.when(name == word, F.lit(target))
        if len(synonym) >= PREFIX_MIN_LENGTH:
            longer = F.startswith(name, word) & (F.length(name) <= len(synonym) + PREFIX_SLACK)
            shorter = F.startswith(word, name) & (F.length(name) >= len(synonym) - PREFIX_SLACK)
            near = near.when(longer | shorter, F.lit(target))
    return F.coalesce(exact, F.when(~F.contains(name, F.lit(",")), near))


def map_fields(fields: DataFrame, targets: tuple = FIELD_TARGETS) -> tuple[DataFrame, DataFrame]:
    """Fields mapped to calendar columns, one per target and resource; and the unknown ones.

    ``fields``: resource, pos, field_id. The first field of a target wins.
    """
    named = fields.filter(~F.col("field_id").isin(*SYSTEM_FIELDS)).withColumn("target", field_target("field_id", targets))
    mapped = first_per_group(named.filter(F.col("target").isNotNull()), ["resource", "target"], [F.col("pos")], 1)
    return mapped, named.filter(F.col("target").isNull()).drop("target")


def grid_headers(cells: DataFrame) -> DataFrame:
    """``doc, header_row, columns``: the first of the leading rows that reads as a header.

    A header names a subject column and at least one more. A cell takes the first target it
    fits that no earlier cell of its row took.
    """
    text = F.regexp_replace(squeeze("value"), "[\"'״׳:]", "")
    any_pattern = "|".join(f"(?:{p})" for p, _ in HEADER_PATTERNS)
    fits = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(t)) for p, t in HEADER_PATTERNS]))
    # Only cells that fit something are gathered, and one row holds few of them.
    rows = (
        cells.filter((F.col("row") < HEADER_ROWS) & text.rlike(any_pattern))
        .withColumn("__fits", fits)
        .groupBy("doc", "row")
        .agg(F.sort_array(F.collect_list(F.struct("col", "__fits"))).alias("__cells"))
    )
    start = F.array().cast("array<struct<col:int,target:string>>")

    def take(taken: Column, cell: Column) -> Column:
        used = F.transform(taken, lambda t: t["target"])
        free = F.filter(cell["__fits"], lambda f: ~F.array_contains(used, f))
        new = F.struct(cell["col"].cast("int").alias("col"), F.get(free, F.lit(0)).alias("target"))
        return F.when(F.size(free) > 0, F.concat(taken, F.array(new))).otherwise(taken)

    mapped = rows.withColumn("columns", F.aggregate("__cells", start, take))
    has_subject = F.exists("columns", lambda c: c["target"] == "subject")
    return (
        mapped.filter((F.size("columns") >= 2) & has_subject)
        .groupBy("doc")
        .agg(F.min("row").alias("header_row"), F.min_by("columns", "row").alias("columns"))
    )


def _grid_values(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows below the header with one column per target; wholly blank rows are absent."""
    columns = headers.select("doc", "header_row", F.inline("columns"))
    placed = cells.join(columns, ["doc", "col"]).filter(F.col("row") > F.col("header_row"))
    filled = placed.filter(squeeze("value") != "")
    return filled.groupBy("doc", "header_row", "row").agg(
        *[F.max(F.when(F.col("target") == t, F.col("value"))).alias(t) for t in GRID_FIELDS]
    )


def _first_long_gap(rows: DataFrame) -> DataFrame:
    """``doc, stop_row``: the first row that follows a run of blank rows long enough to end a table.

    Neighbours are found inside blocks of rows and then between blocks, so a very long grid is
    not ordered by one task.
    """
    block = F.floor(F.col("row") / ROW_BLOCK)
    keyed = rows.select("doc", "header_row", "row", block.alias("__block"))
    blocks = keyed.groupBy("doc", "__block").agg(F.max("row").alias("__last"))
    before = F.lag("__last").over(W.partitionBy("doc").orderBy("__block"))
    joined = keyed.join(blocks.withColumn("__prev_block", before).drop("__last"), ["doc", "__block"])
    inside = F.lag("row").over(W.partitionBy("doc", "__block").orderBy("row"))
    previous = F.coalesce(F.col("__inside"), F.col("__prev_block"), F.col("header_row"))
    gaps = joined.withColumn("__inside", inside).filter(F.col("row") - previous - 1 >= BLANK_RUN)
    return gaps.groupBy("doc").agg(F.min("row").alias("stop_row"))


def extract_grid(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calendar rows of every grid, and per grid whether a header was found and what was not read.

    ``cells``: doc, row, col, value (rows and columns from 0). Dates and times stay raw.
    """
    # Each is read several times below, and cells are many more than the rows they make.
    headers = cut_lineage(grid_headers(cells), "grid-headers")
    values = cut_lineage(_grid_values(cells, headers), "grid-values")
    marked = values.join(_first_long_gap(values), "doc", "left").withColumn(
        "__after", F.coalesce(F.col("row") >= F.col("stop_row"), F.lit(False))
    )
    kept = ~F.col("__after")
    named = marked.filter(kept).filter(F.col("subject").isNotNull() | F.col("start_date").isNotNull())
    rows = named.select(
        "doc", "row", squeeze("subject").alias("subject"), "start_date", *[squeeze(c).alias(c) for c in GRID_FIELDS[2:]]
    )
    unread = marked.groupBy("doc").agg(
        F.count_if(kept & F.col("subject").isNull() & F.col("start_date").isNull()).alias("__unparsed"),
        F.count_if(kept & (F.col("subject").isNotNull() | F.col("start_date").isNotNull())).alias("__rows"),
        F.count_if("__after").alias("__after_stop"),
    )
    sizes = cells.groupBy("doc").agg((F.max("row") + 1).alias("__size"))
    found = F.col("header_row").isNotNull()
    report = (
        sizes.join(headers.select("doc", "header_row"), "doc", "left")
        .join(unread, "doc", "left")
        .select(
            "doc",
            found.alias("header_found"),
            F.coalesce("__rows", F.lit(0)).alias("rows"),
            F.when(found, F.coalesce("__unparsed", F.lit(0))).otherwise(F.col("__size")).alias("unparsed"),
            F.coalesce("__after_stop", F.lit(0)).alias("rows_after_stop"),
        )
    )
    return rows, report


def _cut(text: Column, piece: Column) -> Column:
    """``text`` with the first occurrence of ``piece`` replaced by a space."""
    at = F.instr(text, piece)
    return F.when(
        (piece != "") & (at > 0),
        F.concat(F.substring(text, F.lit(1), at - 1), F.lit(" "), F.substring(text, at + F.length(piece), F.length(text))),
    ).otherwise(text)


def split_lines(docs: DataFrame) -> DataFrame:
    """``doc, pos, line``: the lines of each text, spaces collapsed, blank ones left out."""
    lines = docs.select("doc", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))
    return lines.withColumn("line", squeeze("line")).filter(F.col("line") != "")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Each line with its kind (``heading``, ``row``, ``unparsed``) and what it states.

    A line that is only a date is a heading for the lines below it; a row needs a date of its
    own or from a heading, and a time or a date in the line.
    """
    found = (
        lines.withColumn("__date", F.regexp_extract("line", DATE_IN_LINE, 1))
        .withColumn("__range", F.regexp_extract("line", RANGE_IN_LINE, 1))
        .withColumn("__from", F.regexp_extract("line", RANGE_IN_LINE, 2))
        .withColumn("__to", F.regexp_extract("line", RANGE_IN_LINE, 3))
        .withColumn("__time", F.regexp_extract("line", TIME_IN_LINE, 1))
    )
    no_date, no_range, no_time = (F.col(c) == "" for c in ("__date", "__range", "__time"))
    without_date = F.trim(_cut(F.col("line"), F.col("__date")))
    heading = ~no_date & no_time & (F.length(without_date) <= HEADING_MAX_LENGTH)
    carried = F.last(F.when(heading, F.col("__date")), ignorenulls=True).over(
        W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    )
    dated = found.withColumn("__heading", heading).withColumn(
        "start_date", F.coalesce(F.nullif("__date", F.lit("")), carried)
    )
    rest = _cut(F.col("line"), F.col("__date"))
    rest = _cut(rest, F.when(no_range, F.col("__time")).otherwise(F.col("__range")))
    subject = squeeze(F.regexp_replace(rest, f"^{LINE_EDGE}+|{LINE_EDGE}+$", ""))
    readable = (
        F.col("start_date").isNotNull() & ~(no_time & no_date) & (F.length("subject") >= SUBJECT_MIN_LENGTH)
    )
    return dated.withColumn("subject", subject).select(
        "doc",
        "pos",
        F.when(F.col("__heading"), F.lit("heading")).when(readable, F.lit("row")).otherwise(F.lit("unparsed")).alias("kind"),
        "start_date",
        F.nullif(F.when(no_range, F.col("__time")).otherwise(F.col("__from")), F.lit("")).alias("start_time"),
        F.nullif("__to", F.lit("")).alias("end_time"),
        "subject",
    )


def extract_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calendar rows of texts, and per text how many lines gave none. ``docs``: doc, text."""
    parsed = parse_lines(split_lines(docs))
    rows = parsed.filter(F.col("kind") == "row").drop("kind")
    report = parsed.groupBy("doc").agg(
        F.count_if(F.col("kind") == "row").alias("rows"), F.count_if(F.col("kind") == "unparsed").alias("unparsed")
    )
    return rows, report


def build_entries(rows: DataFrame) -> DataFrame:
    """Raw extracted rows with parsed dates and times and a stated text where no subject is."""
    subject = js_trim("subject")
    known = F.when(subject != "", subject)
    return (
        rows.withColumn("date", parse_diary_date("start_date"))
        .withColumn("start_time", parse_diary_time("start_time"))
        .withColumn("end_time", parse_diary_time("end_time"))
        .withColumn("is_empty", known.isNull() & F.col("date").isNull())
        .withColumn("subject", F.coalesce(known, F.lit(NO_SUBJECT)))
    )


def html_links(pages: DataFrame, html: str = "html", base: str = "url") -> DataFrame:
    """Every anchor of every page: address, text, and whether it leads to a file or a page."""
    anchors = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(ANCHOR), 1).alias("href"),
        F.regexp_extract_all(html, F.lit(ANCHOR), 2).alias("body"),
    )
    # explode_outer: an inner explode would scan the page once more in a pushed filter.
    listed = pages.withColumn("__a", F.explode_outer(anchors)).filter(F.col("__a.href").isNotNull())
    text = decode_entities(js_trim(F.regexp_replace(F.col("__a.body"), "<[^>]+>", "")))
    href = resolve_url(decode_entities(F.col("__a.href")), F.col(base))
    return (
        listed.withColumn("href", href)
        .withColumn("text", F.substring(text, 1, LINK_TEXT_LENGTH))
        .withColumn("kind", F.when(is_file_address(F.col("href")), F.lit("file")).otherwise(F.lit("page")))
        .drop("__a", html)
    )
