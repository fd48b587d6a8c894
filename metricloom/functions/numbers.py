"""Number reading and the missing-value rules.

Three policies exist and are never mixed: *zero* (unknown counts as 0), *unknown*
(NULL stays NULL through sums and ratios) and *covered zero* (a missing date is 0
only inside a proven date range, see ``operators.coverage``).
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, clean_text

_PLAIN = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_UNSIGNED = r"^\+?(\d+(\.\d*)?|\.\d+)$"
_CURRENCY = r"(?i)人民币|RMB|CNY|万元|亿元|元|￥|¥|\$"


def finite(c: Column) -> Column:
    """NULL for NaN and the infinities."""
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(~bad, c)


def _has_percent(text: Column) -> Column:
    return text.rlike("[%％]")


def norm_number(c: Column) -> Column:
    """Text to double: separators, currency words, (negative) and percent; else NULL."""
    return bind(clean_text(c), _read_number)


def _read_number(text: Column) -> Column:
    negative = text.startswith("(") & text.endswith(")")
    bare = F.regexp_replace(text, "[,，%％]", "")
    bare = F.regexp_replace(F.regexp_replace(bare, _CURRENCY, ""), r"^[ ()]+|[ ()]+$", "")
    number = bind(bare, lambda b: F.when(b.rlike(_PLAIN), b.try_cast("double")))
    return bind(F.when(negative, -number).otherwise(number), lambda n: finite(F.when(_has_percent(text), n / 100).otherwise(n)))


def norm_rate(text: Column, number: Column = None, fmt: Column = None) -> Column:
    """A share: percent text, percent format, or a bare value (over 1.5 means percent)."""
    from_text = bind(clean_text(text), lambda t: bind(
        _read_number(t), lambda n: F.when(~_has_percent(t) & (F.abs(n) > 1.5), n / 100).otherwise(n)
    ))
    if number is None:
        return from_text
    style = F.coalesce(fmt, F.lit("")) if fmt is not None else F.lit("")
    scaled = F.when(~style.contains("%") & (F.abs(number) > 1.5), number / 100).otherwise(number)
    return F.coalesce(finite(scaled), from_text)


def strict_number(text: Column) -> Column:
    """Non-negative number without percent sign; anything else is unknown."""
    bare = F.regexp_replace(clean_text(text), "[,，]", "")
    return F.when(bare.rlike(_UNSIGNED), bare.try_cast("double"))


def strict_rate(text: Column, fmt: Column = None) -> Column:
    """Share between 0 and 1; percent text or format, or bare percent; else unknown."""
    bare = F.regexp_replace(clean_text(text), "[,，]", "")
    percent = bare.rlike("[%％]$")
    body = F.trim(F.regexp_replace(bare, "[%％]$", ""))
    number = F.when(body.rlike(_UNSIGNED), body.try_cast("double"))
    styled = F.coalesce(fmt, F.lit("")).rlike("[%％]") if fmt is not None else F.lit(False)
    rate = F.when(percent | (~styled & (number > 1.5)), number / 100).otherwise(number)
    return F.when(rate <= 1, rate)


def observed(c: Column) -> Column:
    """A known quantity: finite and not negative."""
    value = finite(c)
    return F.when(value >= 0, value)


def cardinality(c: Column) -> Column:
    """A known whole number of distinct things."""
    value = observed(c)
    return F.when(value == F.floor(value), value)


def safe_rate(num: Column, den: Column) -> Column:
    """Zero policy: unknown numerator, unknown or zero denominator give 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def observed_rate(num: Column, den: Column) -> Column:
    """Unknown policy: NULL unless both sides are known and the denominator positive."""
    return F.when(den > 0, F.try_divide(num.cast("double"), den.cast("double")))


def relative_change(now: Column, before: Column) -> Column:
    """(now - before) / |before|, NULL without a non-zero base."""
    return F.when(before != 0, F.try_divide(now - before, F.abs(before)))


def complete_sum(c: Column) -> Column:
    """Aggregate: the sum, or NULL as soon as one value of the group is unknown."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def same_value(a: Column, b: Column) -> Column:
    """Equality for reporting: relative or absolute difference within 1e-12."""
    near = F.abs(a - b) <= F.greatest(
        F.lit(1e-12), F.lit(1e-12) * F.greatest(F.abs(a), F.abs(b))
    )
    return (a == b) | F.coalesce(near, F.lit(False))
