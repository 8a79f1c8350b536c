"""Per-entity window operators: previous period, change metrics, running stacks.

Windows here are partitioned by the entity (firm, or firm x category), whose size is bounded by
categories x periods in the fact grain, so no window partition can grow with the data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.numeric import rint_dp, round_ratio


def period_over_period(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    values: Sequence[str],
    prefix: str = "prev_",
) -> DataFrame:
    """Add ``LAG(v) OVER (PARTITION BY by ORDER BY order)`` for each ``v`` as ``prefix + v``.

    Row based: a missing period is compared with the last present one. All lags share one window,
    so the plan has one exchange and one sort.
    """
    w = Window.partitionBy(*by).orderBy(order)
    return df.select("*", *[F.lag(v).over(w).alias(prefix + v) for v in values])


def add_changes(
    df: DataFrame,
    by: Sequence[str] = ("firm_name", "product_category"),
    order: str = "period_order",
    value: str = "complaints_opened",
    rate_tenths: str = "upheld_tenths",
) -> DataFrame:
    """Master change metrics against the previous row of the same (firm, category).

    complaints_change_abs = value - prev (double); complaints_change_pct = (value - prev) / prev * 100
    rounded half-to-even at 1 dp (as the cleaning stage's numpy rounding), null unless prev > 0;
    upheld_change_ppts = rate - prev rate (from integer tenths, so exact).
    """
    w = Window.partitionBy(*by).orderBy(order)
    prev_v, prev_r = F.lag(value).over(w), F.lag(rate_tenths).over(w)
    out = df.select("*", prev_v.alias("__prev_v"), prev_r.alias("__prev_r"))
    return out.select(
        *df.columns,
        (F.col(value) - F.col("__prev_v")).cast("double").alias("complaints_change_abs"),
        F.when(
            F.col("__prev_v") > 0,
            rint_dp((F.col(value) - F.col("__prev_v")).cast("double") / F.col("__prev_v").cast("double") * F.lit(100.0), 1),
        ).alias("complaints_change_pct"),
        round_ratio(F.col(rate_tenths) - F.col("__prev_r"), F.lit(10), dp=1).alias("upheld_change_ppts"),
    )


def stack_offsets(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    value: str,
    base: str = "stack_base",
    top: str = "stack_top",
) -> DataFrame:
    """Running total inside each ``by`` group in ``order``: bar base (before) and top (after)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.sum(value).over(w)
    return df.select("*", (running - F.col(value)).alias(base), running.alias(top))
