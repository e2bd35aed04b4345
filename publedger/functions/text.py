"""Text normalisation and whole-word matching for Hebrew and mixed text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from publedger.functions.numbers import col

# Character classes and word lists that decide results.
#: Every character that counts as white space (wider than Java's ``\s``).
SPACE = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
NIQQUD = r"[\x{0591}-\x{05c7}]"
BIDI = r"[\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]"
QUOTES = "[\"'״׳]"
PUNCTUATION = "[\"'.,:;!?()\\-–—*]"
MAIL_PREFIXES = "FW|RE|Fwd"
SUBJECT_WRAPPERS = r"_x000D_|הזמנה עודכנה|הזמנה מבוטלת|הזמנה:|Canceled\s*:?|Cancelled\s*:?"
PROCLITICS = "והבלכמש"
MAX_PROCLITICS = 3
CORPORATE_SUFFIX = "בע[\"״']?מ"
GOVERNMENT_LEADS = "משרד|המשרד|מדינת ישראל|רשות|הרשות|לשכת|נציבות"
NON_MEETING_CATEGORIES = (
    "personal_private",
    "holidays_calendar",
    "religious_lifecycle",
    "travel_logistics",
    "calendar_admin",
    "meeting_without_subject",
    "named_person_meeting",
    "unclassified",
    "unspecified",
    "no_subject_recorded",
)
METHOD_UNREPORTED = "לא דווח / אחר"
METHOD_EXEMPT = "פטור ממכרז"
METHOD_OTHER_VALUES = ("ILS", "אחר")
EXEMPT_WORD = "פטור"


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(col(c), SPACE + "+", " "))


def js_trim(c: Column | str) -> Column:
    """Trim every kind of white space, not only U+0020."""
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def norm_text(c: Column | str, lower: bool = False) -> Column:
    """Search form: vowel points removed, spaces collapsed, optionally lower case."""
    plain = squeeze(F.regexp_replace(col(c), NIQQUD, ""))
    return F.lower(plain) if lower else plain


def norm_subject(c: Column | str) -> Column:
    """A calendar subject without quote variants, direction marks and mail wrappers."""
    text = F.regexp_replace(col(c), QUOTES, '"')
    text = F.regexp_replace(text, BIDI, "")
    text = F.regexp_replace(text, f"(?i)(?<![A-Za-z0-9_])(?:{MAIL_PREFIXES}){SPACE}*:", " ")
    text = F.regexp_replace(text, f"(?i)(?:{SUBJECT_WRAPPERS})", " ")
    return squeeze(text)


def bare_text(c: Column | str) -> Column:
    """Lower case without punctuation, the form generic terms are compared in."""
    return F.lower(squeeze(F.regexp_replace(col(c), PUNCTUATION, " ")))


def _bare_term(term: str) -> str:
    return " ".join(re.sub("[\"'.,:;!?()\\-–—*]", " ", term).split()).lower()


def bare_terms(terms: list[str] | tuple[str, ...]) -> list[str]:
    """Listed terms in the form :func:`bare_text` gives, without blanks and repeats."""
    return sorted({t for t in (_bare_term(term) for term in terms) if t})


def is_generic(c: Column | str, terms: list[str] | tuple[str, ...]) -> Column:
    """Whether a subject, once bare, *is* one of the listed terms or nothing at all."""
    bare = bare_text(norm_subject(c))
    listed = bare_terms(terms)
    empty = bare == F.lit("")
    return empty | bare.isin(listed) if listed else empty


def ends_attaching(needle: Column) -> Column:
    """Whether a keyword ends in a particle meant to attach to the next word."""
    return needle.rlike(SPACE + "[ובלכמ]$")


def word_pattern(needle: Column) -> Column:
    """Regular expression that finds ``needle`` as a word of its own.

    Up to three one-letter particles may stand before it and no Hebrew letter may follow,
    unless the keyword itself ends in an attaching particle.
    """
    left = f"(^|[^א-ת])[{PROCLITICS}]{{0,{MAX_PROCLITICS}}}\\Q"
    right = F.when(ends_attaching(needle), F.lit("\\E")).otherwise(F.lit("\\E([^א-ת]|$)"))
    return F.concat(F.lit(left), needle, right)


def matches_as_word(haystack: Column | str, needle: Column | str) -> Column:
    h, n = col(haystack), col(needle)
    # The plain substring test settles nearly every pair before the pattern is compiled.
    return (n != F.lit("")) & F.contains(h, n) & F.rlike(h, word_pattern(n))


def norm_entity(c: Column | str) -> Column:
    """Company or association name without suffix, parentheses, quotes and dashes."""
    text = F.regexp_replace(col(c), CORPORATE_SUFFIX, " ")
    text = F.regexp_replace(text, r"\(.*?\)", " ")
    return squeeze(F.regexp_replace(text, "[\"'״׳.,\\-–—]", " "))


def is_government_name(c: Column | str) -> Column:
    return js_trim(c).rlike(f"^(?:{GOVERNMENT_LEADS})({SPACE}|$)")


def norm_name(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), SPACE + "+", " "), QUOTES, ""))


def person_id(c: Column | str) -> Column:
    """Stable address part of a person's name."""
    text = F.regexp_replace(js_trim(c), SPACE + "+", "-")
    return F.replace(F.regexp_replace(text, QUOTES, ""), F.lit("/"), F.lit("-"))


def supplier_id(c: Column | str) -> Column:
    text = F.regexp_replace(js_trim(c), SPACE + "+", " ")
    return F.replace(text, F.lit("/"), F.lit("-"))


def person_key(section: Column | str, role_label: Column | str, person: Column | str) -> Column:
    return F.concat_ws(
        "|",
        F.coalesce(col(section).cast("string"), F.lit("unattributed")),
        F.coalesce(col(role_label), F.lit("")),
        F.coalesce(col(person), F.lit("—")),
    )


def or_fallback(c: Column | str, fallback: str) -> Column:
    """The text, or a stated fallback where it is missing or blank."""
    text = js_trim(c)
    return F.coalesce(F.when(text != F.lit(""), text), F.lit(fallback))


def is_meeting(category: Column | str) -> Column:
    return ~col(category).isin(*NON_MEETING_CATEGORIES)


def norm_method(c: Column | str) -> Column:
    """Purchase method in a few honest buckets."""
    method = col(c)
    return (
        F.when(method.isNull() | method.isin(*METHOD_OTHER_VALUES), F.lit(METHOD_UNREPORTED))
        .when(F.contains(method, F.lit(EXEMPT_WORD)), F.lit(METHOD_EXEMPT))
        .otherwise(method)
    )


def contains_all_terms(haystack: Column, query: str) -> Column:
    """Whether every word of ``query`` occurs in ``haystack``; a blank query always does."""
    terms = _search_terms(query)
    hit = F.lit(True)
    for term in terms:
        hit = hit & F.contains(haystack, F.lit(term))
    return hit


def _search_terms(query: str) -> list[str]:
    return re.sub("[֑-ׇ]", "", query).lower().split()


def matches_query(columns: list[Column | str], query: str) -> Column:
    """All-terms search over several columns; array columns contribute their elements."""
    joined = F.concat_ws(" ", *[col(c) for c in columns])
    return contains_all_terms(norm_text(joined, lower=True), query)
