"""Numeric column functions with engine-independent results.

Averages of percentages are carried as integer *tenths* (``upheld_tenths = pct * 10``) so that a
rounded mean is an exact rational computation: the same in Spark, DuckDB or SQLite, whatever the
summation order. Every helper here is a native Spark expression (whole-stage codegen, no UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def idiv(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Exact integral division (SQL ``a div b``) of two integral columns."""
    return F.call_function("div", _c(a), _c(b))


def round_ratio_int(num: ColumnOrName, den: ColumnOrName, dp: int = 1, scale: int = 1) -> Column:
    """``round(scale * num / den, dp) * 10**dp`` as an exact bigint (half away from zero)."""
    n, d = _c(num).cast("bigint"), _c(den).cast("bigint")
    k = 10 ** dp
    sign = F.when((n < 0) != (d < 0), F.lit(-1)).otherwise(F.lit(1))
    mag = idiv(F.abs(n) * F.lit(2 * k * scale) + F.abs(d), F.abs(d) * 2)
    return F.when(d != 0, sign * mag)


def round_ratio(num: ColumnOrName, den: ColumnOrName, dp: int = 1, scale: int = 1) -> Column:
    """``round(scale * num / den, dp)``, half away from zero, computed exactly in integers.

    ``num`` and ``den`` are integral. Null when ``den`` is 0 or null (SQL semantics of a division
    by zero under the non-ANSI engines the queries were written for).
    """
    return round_ratio_int(num, den, dp, scale).cast("double") / F.lit(10 ** dp)


def pct_change(new: ColumnOrName, old: ColumnOrName, dp: int = 1) -> Column:
    """Percentage change ``(new - old) / old * 100`` rounded to ``dp``; null when ``old`` is 0."""
    return round_ratio(_c(new) - _c(old), old, dp=dp, scale=100)


def rounded_mean(x: ColumnOrName, unit: int = 1, dp: int = 1) -> Column:
    """Aggregate: mean of integral column ``x`` (values ``x / unit``), rounded half away to ``dp``.

    ``rounded_mean("upheld_tenths", unit=10, dp=1)`` equals ``ROUND(AVG(upheld_pct), 1)`` in exact
    arithmetic. Null when the group has no non-null value.
    """
    col = _c(x)
    return round_ratio(F.sum(col), F.count(col) * F.lit(unit), dp=dp)


def rounded_mean_int(x: ColumnOrName, unit: int = 1, dp: int = 1) -> Column:
    """Aggregate: ``rounded_mean`` scaled by ``10**dp`` as an exact bigint (e.g. tenths)."""
    col = _c(x)
    return round_ratio_int(F.sum(col), F.count(col) * F.lit(unit), dp=dp)


def exact_mean(x: ColumnOrName, unit: int = 1) -> Column:
    """Aggregate: unrounded mean of integral ``x / unit`` as one correctly rounded double division."""
    col = _c(x)
    return F.sum(col).cast("double") / (F.count(col) * F.lit(unit))


def mean_at_least(x: ColumnOrName, threshold: float, unit: int = 1) -> Column:
    """Aggregate predicate ``AVG(x / unit) >= threshold`` evaluated exactly (no float average)."""
    col = _c(x)
    return F.sum(col) >= F.count(col) * F.lit(int(round(threshold * unit)))


def tenths_to_pct(x: ColumnOrName) -> Column:
    return _c(x).cast("double") / F.lit(10)


def rint_dp(x: ColumnOrName, dp: int = 1) -> Column:
    """Round half to even at ``dp`` decimals, as numpy's ``round`` does on ``x * 10**dp``."""
    k = float(10 ** dp)
    return F.rint(_c(x) * F.lit(k)) / F.lit(k)


# A decimal number as a spreadsheet or CSV cell holds it: optional sign, digits with an optional
# fraction, optional exponent. Excludes '1,234', '12%', '*', '1d', '1f', 'NaN', 'inf'.
NUMERIC_PATTERN = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def coerce_numeric(x: ColumnOrName) -> Column:
    """Lenient string -> double: null for anything that is not a plain decimal number.

    ``try_cast`` alone accepts Java suffixes ('1d', '1f') and yields NaN for 'NaN'; the regex guard
    keeps exactly the numbers a spreadsheet reader would coerce, and NaN never enters the data.
    """
    s = _c(x).cast("string")
    return F.when(s.rlike(NUMERIC_PATTERN), F.trim(s).try_cast("double"))


def nan_to_null(x: ColumnOrName) -> Column:
    col = _c(x)
    return F.when(~F.isnan(col), col)


def clip(x: ColumnOrName, lo: ColumnOrName, hi: ColumnOrName) -> Column:
    """Winsorise ``x`` to ``[lo, hi]`` keeping nulls null (bare greatest/least skip nulls)."""
    col = _c(x)
    return F.when(col.isNotNull(), F.greatest(F.least(col, _c(hi)), _c(lo)))


def minmax_scale(x: ColumnOrName, lo: ColumnOrName, hi: ColumnOrName, out_lo: float = 0.0,
                 out_hi: float = 100.0) -> Column:
    """Scale ``x`` from ``[lo, hi]`` to ``[out_lo, out_hi]``; a constant column maps to ``out_lo``."""
    col, l, h = _c(x), _c(lo), _c(hi)
    return F.when(h > l, (col - l) / (h - l) * F.lit(out_hi - out_lo) + F.lit(out_lo)).otherwise(
        F.when(col.isNotNull(), F.lit(out_lo))
    )
