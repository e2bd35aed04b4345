"""Number rules shared by every operator.

Three of them hold everywhere: a missing measure is null and never 0, a ratio with an
unusable denominator is null, and rounding is half-up towards +infinity (so -2.5 -> -2),
which is not what Spark's ``round`` does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGE_CHANGE_PERCENT = 20
LARGE_CHANGE_ABSOLUTE = 50_000_000
RATE_OUTLIER_MAX = 150
OUTLIER_MARKER = "חריגה:"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(x: Column, digits: int = 0) -> Column:
    """Half-up towards +infinity at ``digits`` decimals."""
    scale = 10**digits
    if digits == 0:
        return F.floor(x + F.lit(0.5))
    return F.floor(x * F.lit(float(scale)) + F.lit(0.5)) / F.lit(float(scale))


def half_away(x: Column) -> Column:
    """Whole number, halves away from zero — how amounts are displayed."""
    return F.when(x < 0, -F.floor(F.abs(x) + F.lit(0.5))).otherwise(F.floor(F.abs(x) + F.lit(0.5)))


def finite(c: Column | str) -> Column:
    """``c``, or null where it is NaN or infinite."""
    value = col(c)
    as_double = value.cast("double")
    return F.when(~F.isnan(as_double) & (F.abs(as_double) < F.lit(float("inf"))), value)


def one_decimal_percent(part: Column, whole: Column) -> Column:
    """``part / whole`` in percent at one decimal; null when ``whole`` is 0 or either is null."""
    ratio = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.floor(ratio * F.lit(1000.0) + F.lit(0.5)) / F.lit(10.0)


def share_of(value: Column | str, total: Column | str) -> Column:
    """Share in percent, only over a positive total."""
    v, t = finite(value), finite(total)
    return F.when(t > 0, one_decimal_percent(v, t))


def change_percent(start: Column | str, end: Column | str) -> Column:
    """Change in percent against the size of the first figure."""
    a, b = finite(start), finite(end)
    return one_decimal_percent(b - a, F.abs(a))


def budget_change(original: Column | str, updated: Column | str) -> Column:
    return finite(updated) - finite(original)


def budget_change_percent(original: Column | str, updated: Column | str) -> Column:
    """Change against the signed original figure."""
    a, b = finite(original), finite(updated)
    return one_decimal_percent(b - a, a)


def execution_rate(actual: Column | str, estimated: Column | str, updated: Column | str) -> Column:
    execution = F.coalesce(col(actual), col(estimated))
    return F.when(finite(updated) > 0, one_decimal_percent(finite(execution), finite(updated)))


def execution_basis(actual: Column | str, estimated: Column | str) -> Column:
    return (
        F.when(col(actual).isNotNull(), F.lit("actual"))
        .when(col(estimated).isNotNull(), F.lit("estimate"))
        .otherwise(F.lit("none"))
    )


def is_large_change(
    original: Column | str,
    updated: Column | str,
    percent: float = LARGE_CHANGE_PERCENT,
    absolute: float = LARGE_CHANGE_ABSOLUTE,
) -> Column:
    """Both limits must be reached; unknown change is not large."""
    both = (F.abs(budget_change_percent(original, updated)) >= percent) & (
        F.abs(budget_change(original, updated)) >= absolute
    )
    return F.coalesce(both, F.lit(False))


def rate_outlier(rate: Column | str, limit: float = RATE_OUTLIER_MAX) -> Column:
    r = finite(rate)
    return F.coalesce((r < 0) | (r > limit), F.lit(False))


def outlier_note(rate: Column | str, limit: float = RATE_OUTLIER_MAX) -> Column:
    """The marker an out-of-band rate must carry, with the rate; empty otherwise."""
    return F.when(
        rate_outlier(rate, limit), F.concat(F.lit(OUTLIER_MARKER + " "), col(rate).cast("string"), F.lit("%"))
    ).otherwise(F.lit(""))


def add_nullable(a: Column | str, b: Column | str) -> Column:
    """Sum that is null only when both sides are."""
    a, b = col(a), col(b)
    zero = F.lit(0)
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, zero) + F.coalesce(b, zero))


def read_measure(c: Column | str) -> Column:
    """Number from text that may hold thousands commas; anything else is null."""
    text = F.trim(F.regexp_replace(col(c), ",", ""))
    plain = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text)
    return finite(plain.try_cast("double"))


def read_label(c: Column | str, strict: bool = True) -> Column:
    """Label out of an array cell.

    ``strict`` accepts exactly one element and collapses its spaces; otherwise the first of
    many is taken. Other shapes are ambiguous and become null.
    """
    from publedger.functions.text import js_trim, squeeze

    cell = col(c)
    if strict:
        return F.when(F.size(cell) == 1, squeeze(F.get(cell, F.lit(0))))
    return F.when(F.size(cell) >= 1, js_trim(F.get(cell, F.lit(0))))
