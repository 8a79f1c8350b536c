"""Dashboard marts (executive page, firm page, regime page) and the findings report table.

The published dashboard file is not shipped with the original; its pages are re-aimed as tables
a BI tool reads directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom import contract as K
from riskloom.functions.numeric import pct_change, round_ratio, round_ratio_int, rounded_mean, rounded_mean_int, tenths_to_pct
from riskloom.functions.rules import direction
from riskloom.operators.compare import compare_sides
from riskloom.operators.ranking import global_row_number
from riskloom.plans import named_queries as Q
from riskloom.session import materialise


def exec_top_firms(fact: DataFrame, top: int = 12) -> DataFrame:
    """Executive page: the top firms by volume with their rounded mean uphold rate."""
    return (
        fact.groupBy(K.FIRM, K.TYPE)
        .agg(F.sum(K.OPENED).alias("total_opened"), rounded_mean(K.UPHELD_T, 10, 1).alias("avg_upheld_pct"))
        .orderBy(F.desc("total_opened"), K.FIRM, K.TYPE)
        .limit(top)
    )


def exec_sector_share(fact: DataFrame) -> DataFrame:
    """Executive page: each sector's share of all complaints (1 dp), in one pass over the table: the grand total is a
    window over the sectors' rows."""
    return (
        fact.groupBy(K.TYPE)
        .agg(F.sum(K.OPENED).alias("total_opened"), F.countDistinct(K.FIRM).alias("firms"))
        .withColumn("grand", F.sum("total_opened").over(Window.partitionBy()))
        .select(K.TYPE, "total_opened", "firms",
                round_ratio(F.col("total_opened"), F.col("grand"), dp=1, scale=100).alias("share_pct"))
        .orderBy(F.desc("total_opened"), K.TYPE)
    )


def firm_category(fact: DataFrame, firm: str | None = None) -> DataFrame:
    """Firm page: volume, share of the firm's volume and mean uphold rate by category, for one firm or for all of them."""
    rows = fact if firm is None else fact.filter(F.col(K.FIRM) == firm)
    per = rows.groupBy(K.FIRM, K.TYPE, K.CAT).agg(
        F.sum(K.OPENED).alias("total_opened"),
        rounded_mean(K.UPHELD_T, 10, 1).alias("avg_upheld_pct"),
        F.countDistinct(K.LABEL).alias("periods"),
    )
    whole = F.sum("total_opened").over(Window.partitionBy(K.FIRM))  # at most one row for each category and type
    return per.select("*", round_ratio(F.col("total_opened"), whole, dp=1, scale=100).alias("share_pct"))


def firm_drilldown(fact: DataFrame, firm: str | None = None) -> DataFrame:
    """Firm page: per firm and period, volume, mean uphold rate and change against the previous reported period, with a
    direction arrow; ``firm`` selects one firm (the filter reaches the scan of a stored master)."""
    fact = fact if firm is None else fact.filter(F.col(K.FIRM) == firm)
    per = fact.groupBy(K.FIRM, K.TYPE, K.LABEL, K.ORDER, K.DUTY).agg(
        F.sum(K.OPENED).alias("total_opened"),
        rounded_mean_int(K.UPHELD_T, 10, 1).alias("__t"),
        F.countDistinct(K.CAT).alias("categories"),
    )
    w = Window.partitionBy(K.FIRM).orderBy(K.ORDER)
    prev_v, prev_t = F.lag("total_opened").over(w), F.lag("__t").over(w)
    out = per.select("*", prev_v.alias("__pv"), prev_t.alias("__pt"))
    return out.select(
        K.FIRM,
        K.TYPE,
        K.LABEL,
        K.ORDER,
        K.DUTY,
        "categories",
        "total_opened",
        tenths_to_pct("__t").alias("avg_upheld_pct"),
        (F.col("total_opened") - F.col("__pv")).alias("change_absolute"),
        pct_change("total_opened", "__pv").alias("change_pct"),
        tenths_to_pct(F.col("__t") - F.col("__pt")).alias("upheld_change_ppts"),
        direction(F.col("total_opened") - F.col("__pv")).alias("volume_direction"),
    )


def diagonal_pairs(fact: DataFrame) -> DataFrame:
    """Regime page: per firm, rounded mean uphold rate before and after the cutover (both needed)
    and the side of the diagonal."""
    sides = Q.firm_side_upheld(fact)
    d = F.col("post_t") - F.col("pre_t")
    return sides.select(
        K.FIRM,
        K.TYPE,
        tenths_to_pct("pre_t").alias("pre_upheld"),
        tenths_to_pct("post_t").alias("post_upheld"),
        tenths_to_pct(d).alias("change_ppts"),
        F.when(d > 0, F.lit("worse")).when(d < 0, F.lit("improved")).otherwise(F.lit("equal")).alias("side"),
        direction(d).alias("direction"),
    )


def regime_base(fact: DataFrame) -> DataFrame:
    """Per firm, type and regime: volume of all rows and of the rated ones, sum and number of the rates (in tenths).

    One grouped pass over the fact, from which all four findings follow: sums add up, and distinct firms are counted over its
    rows. It has at most two rows for each firm and type.
    """
    rated = F.col(K.UPHELD_T).isNotNull()
    return fact.groupBy(K.FIRM, K.TYPE, K.DUTY).agg(
        F.sum(K.OPENED).alias("opened"),
        F.sum(F.when(rated, F.col(K.OPENED))).alias("rated_opened"),
        F.sum(K.UPHELD_T).alias("t"),
        F.count(K.UPHELD_T).alias("n"),
    )


def findings_table(fact: DataFrame, min_total: int = K.MIN_TOTAL) -> DataFrame:
    """The four key findings as one table ``(finding, ord, row_json)`` in report order.

    The fact is read once (:func:`regime_base`, stored: each finding reads its columns of it). Regime summaries (one row per
    regime) and the top-10 list are numbered with a plain window; the danger list grows with the number of firms, so it gets the
    numbering by slices.
    """
    base = materialise(regime_base(fact), "regime-base")
    rated = base.filter(F.col("n") > 0)
    tenths = F.sum("n") * F.lit(10)
    overview = base.groupBy(K.DUTY).agg(
        F.sum("opened").alias("total_opened"), round_ratio(F.sum("t"), tenths, dp=1).alias("avg_upheld_pct"),
        F.countDistinct(K.FIRM).alias("unique_firms"),
    )
    summary = rated.groupBy(K.FIRM, K.TYPE).agg(
        F.sum("rated_opened").alias("total_opened"), round_ratio(F.sum("t"), tenths, dp=1).alias("avg_upheld_pct")
    ).filter(F.col("total_opened") > min_total)
    shift = rated.groupBy(K.DUTY).agg(
        round_ratio(F.sum("t"), tenths, dp=2).alias("avg_upheld_pct"), F.countDistinct(K.FIRM).alias("firms")
    )
    rates = rated.groupBy(K.FIRM, K.DUTY).agg(round_ratio_int(F.sum("t"), tenths, dp=1).alias("avg_t"))
    sides = compare_sides(rates, [K.FIRM], {"t": "avg_t"}, require_both=["t"])
    parts = [
        ("industry_overview", overview, [K.DUTY], True),
        ("danger_quadrant", Q.danger_list(summary), [F.desc("avg_upheld"), K.FIRM, K.TYPE], False),
        ("duty_uphold_shift", shift, [K.DUTY], True),
        ("worsened_post_duty", Q.worsened(sides), [F.desc("change_ppts"), K.FIRM], True),
    ]
    out = None
    for name, df, order, bounded in parts:
        cols = df.columns
        if bounded:
            numbered = df.withColumn("ord", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
        else:
            numbered = global_row_number(df, order, name="ord")
        one = numbered.select(
            F.lit(name).alias("finding"),
            "ord",
            F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"}).alias("row_json"),
        )
        out = one if out is None else out.unionByName(one)
    return out
