"""The named analyses of the SQL module (A1-A4, B1-B2, C1-C4, D1-D2) and the four key findings
(K1-K4), as DataFrame compositions over the master fact.

Conventions shared by all of them:

* ``ROUND(AVG(pct), 1)`` is computed from integer tenths (``rounded_mean``) - exact, so it cannot
  depend on summation order; band thresholds on the *unrounded* mean compare sums with counts.
* Every ``ORDER BY`` carries unique tie-breaks (firm_name, firm_type) so LIMIT and NTILE are
  deterministic.
* Divisions by zero yield null (``round_ratio``), as in the SQL engine the queries target.
* Global NTILE uses the range-partitioned form (``operators.ranking.ntile``); global RANK is only
  needed inside a top-k and is computed there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import contract as K
from riskloom.functions.numeric import (
    exact_mean,
    mean_at_least,
    pct_change,
    round_ratio,
    rounded_mean,
    rounded_mean_int,
    tenths_to_pct,
)
from riskloom.operators.compare import compare_sides, first_last
from riskloom.operators.ranking import global_row_number, ntile, ntile_of, rank_within_top
from riskloom.operators.windows import period_over_period
from riskloom.session import materialise

FT = [K.FIRM, K.TYPE]


def _r1(col: str = K.UPHELD_T):
    return rounded_mean(col, unit=10, dp=1)


def _tenths_mean_int(col: str = K.UPHELD_T):
    """Rounded 1-dp mean kept as integer tenths (for later exact differences/comparisons)."""
    return rounded_mean_int(col, unit=10, dp=1)


# ----------------------------------------------------------------------------- module A: volume


def a1_volume_by_firm(fact: DataFrame, top: int = 30) -> DataFrame:
    per_firm = fact.groupBy(*FT).agg(
        F.countDistinct(K.LABEL).alias("periods_reported"),
        F.sum(K.OPENED).alias("total_complaints"),
        rounded_mean(K.OPENED, unit=1, dp=0).alias("avg_per_period"),
        _r1().alias("avg_upheld_pct"),
    )
    return rank_within_top(per_firm, top, "total_complaints", FT, "volume_rank").select(
        *FT, "periods_reported", "total_complaints", "avg_per_period", "avg_upheld_pct", "volume_rank"
    )


def firm_period_totals(fact: DataFrame) -> DataFrame:
    return fact.groupBy(*FT, K.LABEL, K.ORDER, K.DUTY).agg(F.sum(K.OPENED).alias("total_opened"))


def a2_period_on_period(fact: DataFrame) -> DataFrame:
    totals = firm_period_totals(fact)
    lagged = period_over_period(totals, [K.FIRM], K.ORDER, ["total_opened", K.LABEL])
    return (
        lagged.filter(F.col("prev_total_opened").isNotNull())
        .select(
            *FT,
            F.col(K.LABEL).alias("current_period"),
            K.DUTY,
            F.col("total_opened").alias("complaints_this_period"),
            F.col("prev_" + K.LABEL).alias("prev_label"),
            F.col("prev_total_opened").alias("complaints_prev_period"),
            (F.col("total_opened") - F.col("prev_total_opened")).alias("change_absolute"),
            pct_change("total_opened", "prev_total_opened").alias("change_pct"),
            K.ORDER,
        )
        .orderBy(F.desc_nulls_last("change_pct"), K.FIRM, K.ORDER)
        .drop(K.ORDER)
    )


def a3_fastest_growing(fact: DataFrame, min_first: int = K.MIN_FIRST_VOLUME, top: int = 15) -> DataFrame:
    totals = firm_period_totals(fact)
    fl = first_last(
        totals,
        FT,
        K.ORDER,
        {
            "first_vol": "first:total_opened",
            "first_label": "first:" + K.LABEL,
            "last_vol": "last:total_opened",
            "last_label": "last:" + K.LABEL,
            "latest_duty": "last:" + K.DUTY,
        },
        count_name="periods_present",
    ).filter(F.col("periods_present") >= 2)
    growing = F.col("last_vol") > F.col("first_vol")
    out = fl.filter(F.col("first_vol") > min_first).select(
        *FT,
        "first_label",
        "last_label",
        "latest_duty",
        "periods_present",
        "first_vol",
        "last_vol",
        (F.col("last_vol") - F.col("first_vol")).alias("absolute_growth"),
        pct_change("last_vol", "first_vol").alias("growth_pct"),
        F.when(growing & (F.col("latest_duty") == K.POST_LABEL), F.lit(K.A3_FLAGS[0]))
        .when(growing, F.lit(K.A3_FLAGS[1]))
        .otherwise(F.lit(K.A3_FLAGS[2]))
        .alias("trend_flag"),
    )
    return out.orderBy(F.desc_nulls_last("growth_pct"), *FT).limit(top)


def a4_industry(fact: DataFrame) -> DataFrame:
    return (
        fact.groupBy(K.DUTY, K.LABEL, K.ORDER)
        .agg(
            F.countDistinct(K.FIRM).alias("firms_reporting"),
            F.sum(K.OPENED).alias("total_opened"),
            _r1(K.UPHELD_T).alias("avg_upheld_pct"),
            _r1(K.CLOSED3_T).alias("avg_pct_closed_3days"),
        )
        .orderBy(K.ORDER)
    )


# ------------------------------------------------------------------------- module B: categories


def b1_category_volume(fact: DataFrame) -> DataFrame:
    return (
        fact.groupBy(K.CAT)
        .agg(
            F.countDistinct(K.FIRM).alias("firms_in_category"),
            F.sum(K.OPENED).alias("total_opened"),
            _r1().alias("avg_upheld_pct"),
            F.sum(F.when(F.col(K.DUTY) == K.PRE_LABEL, F.col(K.OPENED))).alias("total_pre_duty"),
            F.sum(F.when(F.col(K.DUTY) == K.POST_LABEL, F.col(K.OPENED))).alias("total_post_duty"),
        )
        .orderBy(F.desc("total_opened"), K.CAT)
    )


def b2_category_shift(fact: DataFrame) -> DataFrame:
    cat_duty = fact.groupBy(K.CAT, K.DUTY).agg(
        F.sum(K.OPENED).alias("total_opened"), _tenths_mean_int().alias("avg_t")
    )
    both = compare_sides(cat_duty, [K.CAT], {"opened": "total_opened", "t": "avg_t", "present": K.DUTY},
                         require_both=["present"])
    pre_v, post_v, pre_t, post_t = (F.col(c) for c in ("pre_opened", "post_opened", "pre_t", "post_t"))
    verdict = (
        F.when((post_v > pre_v) & (post_t > pre_t), F.lit(K.B2_VERDICTS[0]))
        .when((post_v < pre_v) & (post_t < pre_t), F.lit(K.B2_VERDICTS[1]))
        .when(post_v > pre_v, F.lit(K.B2_VERDICTS[2]))
        .otherwise(F.lit(K.B2_VERDICTS[3]))
    )
    return both.select(
        K.CAT,
        pre_v.alias("pre_duty_opened"),
        post_v.alias("post_duty_opened"),
        (post_v - pre_v).alias("volume_change"),
        pct_change("post_opened", "pre_opened").alias("volume_change_pct"),
        tenths_to_pct(pre_t).alias("pre_duty_upheld"),
        tenths_to_pct(post_t).alias("post_duty_upheld"),
        tenths_to_pct(post_t - pre_t).alias("upheld_change_ppts"),
        verdict.alias("consumer_duty_verdict"),
    ).orderBy(F.desc_nulls_last("upheld_change_ppts"), K.CAT)


# --------------------------------------------------------------------------- module C: upheld


def c1_upheld_ranked(fact: DataFrame, min_total: int = K.MIN_TOTAL, min_periods: int = 2, top: int = 25) -> DataFrame:
    t = K.UPHELD_T
    per_firm = (
        fact.filter(F.col(t).isNotNull())
        .groupBy(*FT)
        .agg(
            F.countDistinct(K.LABEL).alias("periods_reported"),
            _r1().alias("avg_upheld_pct"),
            tenths_to_pct(F.min(t)).alias("min_upheld_pct"),
            tenths_to_pct(F.max(t)).alias("max_upheld_pct"),
            F.sum(K.OPENED).alias("total_complaints"),
            F.when(mean_at_least(t, 70, 10), F.lit(K.C1_BANDS[0]))
            .when(mean_at_least(t, 50, 10), F.lit(K.C1_BANDS[1]))
            .when(mean_at_least(t, 35, 10), F.lit(K.C1_BANDS[2]))
            .otherwise(F.lit(K.C1_BANDS[3]))
            .alias("risk_band"),
        )
        .filter((F.col("periods_reported") >= min_periods) & (F.col("total_complaints") > min_total))
    )
    return per_firm.orderBy(F.desc_nulls_last("avg_upheld_pct"), *FT).limit(top)


def firm_period_upheld(fact: DataFrame) -> DataFrame:
    """Per (firm, period) rounded mean upheld, kept as integer tenths ``avg_t``."""
    return (
        fact.filter(F.col(K.UPHELD_T).isNotNull())
        .groupBy(*FT, K.LABEL, K.ORDER)
        .agg(_tenths_mean_int().alias("avg_t"))
    )


def c2_rising_upheld(fact: DataFrame, top: int = 20, mode: str = "reference") -> DataFrame:
    """Firms whose uphold rate rose.

    ``mode="reference"``: earliest/latest are the text MIN of the previous label and MAX of the
    label, start/latest the MIN of previous and MAX of current values (a range, as the original
    query computes). ``mode="chronological"``: true first and last by period order.
    """
    lagged = period_over_period(firm_period_upheld(fact), [K.FIRM], K.ORDER, ["avg_t", K.LABEL])
    steps = lagged.filter(F.col("prev_avg_t").isNotNull())
    diff = F.col("avg_t") - F.col("prev_avg_t")
    if mode == "reference":
        first_label, last_label = F.min("prev_" + K.LABEL), F.max(K.LABEL)
        start, latest = F.min("prev_avg_t"), F.max("avg_t")
    elif mode == "chronological":
        first_label, last_label = F.min_by("prev_" + K.LABEL, K.ORDER), F.max_by(K.LABEL, K.ORDER)
        start, latest = F.min_by("prev_avg_t", K.ORDER), F.max_by("avg_t", K.ORDER)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    summary = steps.groupBy(*FT).agg(
        first_label.alias("earliest_period"),
        last_label.alias("latest_period"),
        start.alias("start_t"),
        latest.alias("latest_t"),
        round_ratio(F.sum(diff), F.count(diff) * 10, dp=2).alias("avg_change_per_period"),
    )
    change = F.col("latest_t") - F.col("start_t")
    out = summary.filter(change > 0).select(
        *FT,
        "earliest_period",
        "latest_period",
        tenths_to_pct("start_t").alias("upheld_pct_start"),
        tenths_to_pct("latest_t").alias("upheld_pct_latest"),
        tenths_to_pct(change).alias("total_change_ppts"),
        "avg_change_per_period",
        F.when(change > 100, F.lit(K.C2_VERDICTS[0]))
        .when(change > 50, F.lit(K.C2_VERDICTS[1]))
        .when(change > 0, F.lit(K.C2_VERDICTS[2]))
        .otherwise(F.lit(K.C2_VERDICTS[3]))
        .alias("trend_verdict"),
    )
    return out.orderBy(F.desc_nulls_last("total_change_ppts"), *FT).limit(top)


def firm_upheld_summary(fact: DataFrame, min_total: int = K.MIN_TOTAL) -> DataFrame:
    """Firms with total volume (over rows with an uphold rate) above ``min_total``."""
    return (
        fact.filter(F.col(K.UPHELD_T).isNotNull())
        .groupBy(*FT)
        .agg(
            F.sum(K.OPENED).alias("total_opened"),
            _r1().alias("avg_upheld_pct"),
            F.countDistinct(K.LABEL).alias("periods_reported"),
        )
        .filter(F.col("total_opened") > min_total)
    )


def with_quartiles(summary: DataFrame, scalable: bool = True) -> DataFrame:
    """Quartiles (NTILE 4) of the firms by volume and by uphold rate, ties broken by firm.

    The narrow (measure, value, firm) keys are numbered once for both measures; only the first key of each of the upper quartiles
    comes to the driver (six rows), and a firm's quartile is the number of those keys that it reaches.
    """
    if not scalable:
        q = ntile(summary, 4, [F.asc("total_opened"), *FT], name="volume_quartile", scalable=False)
        return ntile(q, 4, [F.asc("avg_upheld_pct"), *FT], name="uphold_quartile", scalable=False)
    # numbering reads its input a few times: store the (firm-sized) summary once instead of aggregating the fact each time
    summary = materialise(summary, "firm-summary")
    of = {"total_opened": "volume_quartile", "avg_upheld_pct": "uphold_quartile"}
    keys = summary.select(*FT, *[F.col(c).cast("double").alias(c) for c in of]).unpivot(FT, list(of), "measure", "v")
    ranked = global_row_number(keys, [F.asc("v"), *FT], name="rn", total_name="n", partition_by=["measure"])
    quartile = ntile_of("rn", "n", 4)
    before = ntile_of(F.col("rn") - 1, "n", 4)
    first = (F.col("rn") > 1) & (quartile != before)
    cuts = ranked.filter(first).select("measure", "v", *FT).collect()
    for column, name in of.items():
        me = F.struct(F.col(column).cast("double").alias("v"), *FT)
        reached = [
            (me >= F.struct(F.lit(c["v"]).alias("v"), *[F.lit(c[k]).alias(k) for k in FT])).cast("bigint")
            for c in cuts if c["measure"] == column
        ]
        summary = summary.withColumn(name, sum(reached, F.lit(1).cast("bigint")))
    return summary


def c3_danger_quadrant(fact: DataFrame, min_total: int = K.MIN_TOTAL, scalable: bool = True) -> DataFrame:
    wq = with_quartiles(firm_upheld_summary(fact, min_total), scalable)
    vq, uq = F.col("volume_quartile"), F.col("uphold_quartile")
    cls = (
        F.when((vq == 4) & (uq == 4), F.lit(K.C3_CLASSES[0]))
        .when((vq == 4) & (uq >= 3), F.lit(K.C3_CLASSES[1]))
        .when((vq >= 3) & (uq == 4), F.lit(K.C3_CLASSES[2]))
        .when(vq == 4, F.lit(K.C3_CLASSES[3]))
        .when(uq == 4, F.lit(K.C3_CLASSES[4]))
        .otherwise(F.lit(K.C3_CLASSES[5]))
    )
    return wq.select(
        *FT, "total_opened", "avg_upheld_pct", "periods_reported", "volume_quartile", "uphold_quartile",
        (vq + uq).alias("combined_risk_score"), cls.alias("quadrant_classification"),
    ).orderBy(F.desc("combined_risk_score"), F.desc("total_opened"), *FT)


def firm_side_upheld(fact: DataFrame, by=tuple(FT)) -> DataFrame:
    per_side = (
        fact.filter(F.col(K.UPHELD_T).isNotNull())
        .groupBy(*by, K.DUTY)
        .agg(_tenths_mean_int().alias("avg_t"), F.sum(K.OPENED).alias("total_opened"))
    )
    return compare_sides(per_side, list(by), {"t": "avg_t", "volume": "total_opened"}, require_both=["t"])


def c4_pre_post(fact: DataFrame) -> DataFrame:
    sides = firm_side_upheld(fact)
    d = F.col("post_t") - F.col("pre_t")
    return sides.select(
        *FT,
        tenths_to_pct("pre_t").alias("pre_upheld"),
        tenths_to_pct("post_t").alias("post_upheld"),
        tenths_to_pct(d).alias("change_ppts"),
        "pre_volume",
        "post_volume",
        F.when(d > 50, F.lit(K.C4_RESPONSES[0]))
        .when(d > 0, F.lit(K.C4_RESPONSES[1]))
        .when(d > -50, F.lit(K.C4_RESPONSES[2]))
        .otherwise(F.lit(K.C4_RESPONSES[3]))
        .alias("consumer_duty_response"),
    ).orderBy(F.desc("change_ppts"), *FT)


# ------------------------------------------------------------------------ module D: resolution


def d1_resolution(fact: DataFrame, min_total: int = K.MIN_TOTAL, top: int = 25) -> DataFrame:
    t = K.CLOSED3_T
    per_firm = (
        fact.filter(F.col(t).isNotNull())
        .groupBy(*FT)
        .agg(
            F.countDistinct(K.LABEL).alias("periods_reported"),
            _r1(t).alias("avg_pct_closed_3days"),
            _r1(K.UPHELD_T).alias("avg_upheld_pct"),
            F.sum(K.OPENED).alias("total_opened"),
            F.when(mean_at_least(t, 70, 10), F.lit(K.D1_BANDS[0]))
            .when(mean_at_least(t, 40, 10), F.lit(K.D1_BANDS[1]))
            .otherwise(F.lit(K.D1_BANDS[2]))
            .alias("resolution_band"),
        )
        .filter(F.col("total_opened") > min_total)
    )
    return per_firm.orderBy(F.desc_nulls_last("avg_pct_closed_3days"), *FT).limit(top)


def d2_resolution_duty(fact: DataFrame) -> DataFrame:
    return (
        fact.filter(F.col(K.CLOSED3_T).isNotNull() & F.col(K.UPHELD_T).isNotNull())
        .groupBy(K.TYPE, K.DUTY)
        .agg(
            F.countDistinct(K.FIRM).alias("firms_count"),
            _r1(K.CLOSED3_T).alias("avg_pct_closed_3days"),
            _r1(K.UPHELD_T).alias("avg_upheld_pct"),
            F.sum(K.OPENED).alias("total_opened"),
        )
        .orderBy(K.TYPE, K.DUTY)
    )


# ---------------------------------------------------------------------------- key findings K1-K4


def k1_overview(fact: DataFrame) -> DataFrame:
    return fact.groupBy(K.DUTY).agg(
        F.sum(K.OPENED).alias("total_opened"),
        _r1().alias("avg_upheld_pct"),
        F.countDistinct(K.FIRM).alias("unique_firms"),
    )


def k2_danger_list(fact: DataFrame, min_total: int = K.MIN_TOTAL, scalable: bool = True) -> DataFrame:
    return danger_list(firm_upheld_summary(fact, min_total), scalable)


def danger_list(summary: DataFrame, scalable: bool = True) -> DataFrame:
    """Firms of a summary (total_opened, avg_upheld_pct) in the top quartile of both."""
    wq = with_quartiles(summary, scalable)
    return (
        wq.filter((F.col("volume_quartile") == 4) & (F.col("uphold_quartile") == 4))
        .select(*FT, "total_opened", F.col("avg_upheld_pct").alias("avg_upheld"))
        .orderBy(F.desc("avg_upheld"), *FT)
    )


def k3_duty_shift(fact: DataFrame) -> DataFrame:
    return (
        fact.filter(F.col(K.UPHELD_T).isNotNull())
        .groupBy(K.DUTY)
        .agg(rounded_mean(K.UPHELD_T, unit=10, dp=2).alias("avg_upheld_pct"), F.countDistinct(K.FIRM).alias("firms"))
    )


def k4_worsened(fact: DataFrame, min_change: float = 5.0, top: int = 10) -> DataFrame:
    return worsened(firm_side_upheld(fact, by=(K.FIRM,)), min_change, top)


def worsened(sides: DataFrame, min_change: float = 5.0, top: int = 10) -> DataFrame:
    """The firms whose uphold rate rose most, from their rates before and after the cutover (pre_t, post_t in tenths)."""
    d = F.col("post_t") - F.col("pre_t")
    return (
        sides.filter(d > int(round(min_change * 10)))
        .select(
            K.FIRM,
            tenths_to_pct("pre_t").alias("pre_upheld"),
            tenths_to_pct("post_t").alias("post_upheld"),
            tenths_to_pct(d).alias("change_ppts"),
        )
        .orderBy(F.desc("change_ppts"), K.FIRM)
        .limit(top)
    )
