"""How figures are displayed. Rounding is half away from zero, missing is a dash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from publedger.functions.dates import iso_day
from publedger.functions.numbers import col, finite, half_away

# Display words and label dictionaries.
MISSING_SHORT = "—"
MISSING_LABEL = "אין נתון זמין במקור שנאסף"
CURRENCY = 'ש"ח'
BILLION, MILLION, THOUSAND = "מיליארד", "מיליון", "אלף"
MINUS = "־"
OPEN_END = "מכהן/בתוקף"
DATA_STATUS = {"final": "ביצוע סופי", "partial": "נתון חלקי", "estimate": "אומדן", "unavailable": "אין נתון"}
ACTIVITY_SOURCE = {
    "calendar": "יומן פומבי",
    "ministry_news": "הודעת משרד",
    "government_page": "עמוד ממשלתי",
    "committee_protocol": "פרוטוקול ועדה",
    "policy_document": "מסמך מדיניות",
    "other_official": "מקור רשמי אחר",
}
COVERAGE_LEVEL = {"direct": "ישיר", "indirect": "עקיף", "partial": "חלקי"}
RETRIEVAL = {
    "retrieved": "גוף המסמך אוחזר",
    "not_retrieved_egress_blocked": "לא אוחזר — מתחם חסום בסביבת הבנייה",
    "not_retrieved_error": "לא אוחזר — שגיאה",
}


def _grouped(whole: Column) -> Column:
    return F.format_number(whole.cast("bigint"), 0)


def _decimals(amount: Column, digits: int, keep_zero: bool) -> Column:
    """Non-negative amount with ``digits`` decimals, rounded on the scaled whole number."""
    scale = 10**digits
    scaled = F.floor(amount * F.lit(float(scale)) + F.lit(0.5))
    whole, rest = F.floor(scaled / scale), scaled % scale
    text = F.concat(_grouped(whole), F.lit("."), F.lpad(rest.cast("string"), digits, "0"))
    return text if keep_zero else F.when(rest == 0, _grouped(whole)).otherwise(text)


def fmt_number(c: Column | str) -> Column:
    v = finite(c)
    return F.coalesce(_grouped(half_away(v.cast("double"))), F.lit(MISSING_SHORT))


def fmt_money(c: Column | str, style: str = "short") -> Column:
    """Money as ``full``, ``short`` (bn / m / plain) or ``axis`` (no currency word)."""
    v = finite(c).cast("double")
    size = F.abs(v)
    sign = F.when(v < 0, F.lit(MINUS)).otherwise(F.lit(""))
    plain = _grouped(F.floor(size + F.lit(0.5)))
    if style == "full":
        shown = F.concat(_grouped(half_away(v)), F.lit(" " + CURRENCY))
    elif style == "short":
        shown = (
            F.when(size >= 1e9, F.concat(sign, _decimals(size / 1e9, 2, True), F.lit(f" {BILLION} {CURRENCY}")))
            .when(size >= 1e6, F.concat(sign, _decimals(size / 1e6, 2, True), F.lit(f" {MILLION} {CURRENCY}")))
            .when(size.isNotNull(), F.concat(sign, plain, F.lit(" " + CURRENCY)))
        )
    else:
        shown = (
            F.when(size >= 1e9, F.concat(sign, _decimals(size / 1e9, 1, False), F.lit(" " + BILLION)))
            .when(size >= 1e6, F.concat(sign, _decimals(size / 1e6, 1, False), F.lit(" " + MILLION)))
            .when(size >= 1e3, F.concat(sign, _decimals(size / 1e3, 1, False), F.lit(" " + THOUSAND)))
            .when(size.isNotNull(), F.concat(sign, plain))
        )
    return F.coalesce(shown, F.lit(MISSING_SHORT))


def fmt_percent(c: Column | str) -> Column:
    v = finite(c).cast("double")
    sign = F.when((v < 0) & (F.abs(v) >= 0.05), F.lit("-")).otherwise(F.lit(""))
    return F.coalesce(F.concat(sign, _decimals(F.abs(v), 1, True), F.lit("%")), F.lit(MISSING_SHORT))


def fmt_date(c: Column | str) -> Column:
    return F.coalesce(F.date_format(iso_day(col(c).cast("string")), "dd.MM.yyyy"), F.lit(MISSING_SHORT))


def fmt_range(start: Column | str, end: Column | str) -> Column:
    """``from – to`` where a missing end is still open; nothing known gives the long label."""
    first = fmt_date(start)
    last = F.when(col(end).isNull(), F.lit(OPEN_END)).otherwise(fmt_date(end))
    return F.when((first == MISSING_SHORT) & col(end).isNull(), F.lit(MISSING_LABEL)).otherwise(
        F.concat(first, F.lit(" – "), last)
    )


def fmt_count(c: Column | str, one: str, many: str) -> Column:
    n = col(c)
    return F.when(n == 1, F.lit(one)).otherwise(F.concat(fmt_number(n), F.lit(" " + many)))


def label_of(c: Column | str, labels: dict[str, str]) -> Column:
    """Label of a code; an unknown code passes through."""
    code = col(c)
    result = F.when(F.lit(False), code)
    for key, label in labels.items():
        result = result.when(code == F.lit(key), F.lit(label))
    return result.otherwise(code)
