"""Side-by-side comparisons: before/after a cutover, first vs last period.

Both replace self-joins of an aggregate with one grouped pass (conditional aggregation and
``min_by``/``max_by``), so the plan has a single exchange on the entity key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import contract as K


def compare_sides(
    df: DataFrame,
    by: Sequence[str],
    values: Mapping[str, str],
    side_col: str = K.DUTY,
    sides: tuple[str, str] = (K.PRE_LABEL, K.POST_LABEL),
    prefixes: tuple[str, str] = ("pre_", "post_"),
    require_both: Sequence[str] = (),
) -> DataFrame:
    """Pivot per-side values into columns: ``MAX(CASE WHEN side = s THEN v END)``.

    ``df`` holds at most one row per (by, side); ``values`` maps an output suffix to the input column.
    ``require_both`` lists suffixes whose pre and post values must both be present (HAVING).
    """
    aggs: list[Column] = []
    for suffix, col in values.items():
        for side, prefix in zip(sides, prefixes):
            aggs.append(F.max(F.when(F.col(side_col) == side, F.col(col))).alias(prefix + suffix))
    out = df.groupBy(*by).agg(*aggs)
    for suffix in require_both:
        out = out.filter(F.col(prefixes[0] + suffix).isNotNull() & F.col(prefixes[1] + suffix).isNotNull())
    return out


def first_last(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    values: Mapping[str, str],
    count_name: str | None = "periods_present",
) -> DataFrame:
    """Values at the first and last ``order`` of each group, in one pass.

    ``values`` maps output names to ``("first"|"last", column)`` encoded as ``"first:col"``.
    Requires (by, order) unique, as after a group-by on them.
    """
    aggs: list[Column] = []
    for out_name, spec in values.items():
        which, col = spec.split(":", 1)
        fn = F.min_by if which == "first" else F.max_by
        aggs.append(fn(F.col(col), F.col(order)).alias(out_name))
    if count_name:
        aggs.append(F.countDistinct(order).alias(count_name))
    return df.groupBy(*by).agg(*aggs)
