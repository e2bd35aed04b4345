"""What a publication's title states: role, person, period, relevance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from publedger.functions.numbers import col
from publedger.functions.text import SPACE, js_trim

# The patterns that read a title.
DIARY_LEAD = f"^{SPACE}*יומ(?:ן|ני){SPACE}+"
DEPUTY = "סגן|סגנית"
DIRECTOR = 'מנכ["״]?ל'
MINISTER = f"(?:^|{SPACE})(?:שר|שרה|שרת|השר|השרה)(?:{SPACE}|$)|^שר[הת]?{SPACE}|שרת?{SPACE}"
NAMED_PERSON = f",{SPACE}*([^,]+?){SPACE}*,?{SPACE}*לשנ(?:ת|ים){SPACE}"
NAMED_PERIOD = f"לשנ(?:ת|ים){SPACE}+(.+)$"
DATE_RANGE = rf"(\d{{1,2}}\.\d{{1,2}}\.\d{{2,4}}{SPACE}*[-–]{SPACE}*\d{{1,2}}\.\d{{1,2}}\.\d{{2,4}})"
ROLE_NOT_STATED = "תפקיד לא צוין בכותרת"
DIARY_WORD = "יומן|יומני"
MUNICIPAL = "עיריי?ת|עירייה|מועצה (?:מקומית|אזורית|דתית)|ראש העיר|רשות מקומית"
ROLE_WORDS = (
    f'(?:^|{SPACE}|")(?:יומן|יומני){SPACE}|'
    '(?:שר[הת]?|השר[ה]?|סגן|סגנית|מנכ["״]?ל|מנכ["״]?לית|מזכיר הממשלה|החשב הכללי|ראש הממשלה)'
)
WINDOW_YEARS = r"202[3-6]|(?<![A-Za-z0-9_])[01]?\d\.2[3-6](?![A-Za-z0-9_])|-2[3-6](?![A-Za-z0-9_])"
SECOND_DIARY = "ויומן|ו יומן"
PLURAL_OFFICE = f'(^|{SPACE})שרי{SPACE}|(^|{SPACE})סגני{SPACE}|מנכ"לים'
JOINED_ROLE = f'{SPACE}ו(מנכ"ל|מנכ"לית|סמנכ"ל|יו"ר|סגן|ראש)'


def _extract(text: Column, pattern: str) -> Column:
    """First group of the pattern, trimmed; null when absent or blank."""
    found = js_trim(F.regexp_extract(text, pattern, 1))
    return F.when(found != F.lit(""), found)


def role_label(title: Column | str) -> Column:
    head = js_trim(F.split_part(F.regexp_replace(col(title), DIARY_LEAD, ""), F.lit(","), F.lit(1)))
    return F.when(head != F.lit(""), head).otherwise(F.lit(ROLE_NOT_STATED))


def person_role(title: Column | str) -> Column:
    """Role class; a deputy is tested before a director and a director before a minister."""
    label = role_label(title)
    return (
        F.when(label.rlike(DEPUTY), F.lit("deputy_minister"))
        .when(label.rlike(DIRECTOR), F.lit("director_general"))
        .when(label.rlike(MINISTER), F.lit("minister"))
        .otherwise(F.lit("other_senior"))
    )


def person_label(title: Column | str) -> Column:
    """The named person, only when the title states one before its period."""
    name = _extract(col(title), NAMED_PERSON)
    return F.when(F.length(name) > 1, name)


def period_label(title: Column | str) -> Column:
    text = col(title)
    stated = F.when(text.rlike(NAMED_PERIOD), _extract(text, NAMED_PERIOD)).otherwise(_extract(text, DATE_RANGE))
    return stated


def parse_title(title: Column | str) -> list[Column]:
    """The four columns a title yields, ready for ``select``."""
    return [
        person_role(title).alias("person_role"),
        role_label(title).alias("role_label"),
        person_label(title).alias("person_label"),
        period_label(title).alias("period_label"),
    ]


def is_relevant(title: Column | str) -> Column:
    """A diary of an office in the window, and not a municipal one."""
    text = col(title)
    return text.rlike(DIARY_WORD) & ~text.rlike(MUNICIPAL) & text.rlike(ROLE_WORDS) & text.rlike(WINDOW_YEARS)


def covers_multiple(title: Column | str) -> Column:
    """Whether one publication holds several people's diaries, on strong signals only."""
    text = F.regexp_replace(F.regexp_replace(col(title), "[״”“]", '"'), SPACE + "+", " ")
    twice = text.rlike("יומן.*יומן")
    return text.rlike(SECOND_DIARY) | twice | text.rlike(PLURAL_OFFICE) | text.rlike(JOINED_ROLE)
