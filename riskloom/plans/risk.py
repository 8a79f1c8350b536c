"""Composite conduct-risk index and the median-based danger quadrant.

Risk index: firms with total volume > ``min_total`` (over rows with an uphold rate) get four
measures - total volume, mean uphold rate, uphold-rate slope over the period ordinal, first->last
volume growth - each winsorised to its own 5th/95th percentile, min-max scaled to 0-100 and
combined with weights 0.30/0.35/0.20/0.15; the index is rounded half-to-even at 1 dp.

Plan: the firm base (volume, mean, periods, slope moments, first/last volume) is one two-level
aggregation of the fact - per (firm, period), then per firm - with no join and, over the master
bucketed by firm, no shuffle; it is then written once to the shared checkpoint folder and
feeds one ranking pass for all eight clip bounds (exact quantiles of four measures) and one
min/max aggregate - two bounded rows read back and applied as literals. The original per-firm loops
(two full scans per firm) become two grouped passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import contract as K
from riskloom.functions.numeric import exact_mean, rint_dp
from riskloom.session import materialise
from riskloom.operators.stats import minmax, multi_quantiles, winsorise

MEASURES = ("total_opened", "avg_upheld", "upheld_trend", "volume_growth")
SCORES = tuple(m + "_score" for m in MEASURES)


def _materialise(df: DataFrame, checkpoint: bool) -> DataFrame:
    return materialise(df, "risk-base") if checkpoint else df


def firm_periods(fact: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Per (firm, period, type, and ``more``): volume of all rows, and the rated rows' volume, count and sum of tenths.

    Fixed-width buffers only: the type depends on the firm, so it is a grouping key here (a string in a buffer would make
    the aggregate sort). A period's rows depend on that period only, so they can be stored and replaced period by period.
    """
    t = F.col(K.UPHELD_T)
    return fact.groupBy(K.FIRM, K.ORDER, K.TYPE, *more).agg(
        F.sum(K.OPENED).alias("v_all"),
        F.sum(F.when(t.isNotNull(), F.col(K.OPENED))).alias("v_rated"),
        F.count(t).alias("n"),
        F.sum(t).alias("sy"),
    )


def risk_base(fact: DataFrame, min_total: int = K.MIN_TOTAL, degenerate: str = "min_norm") -> DataFrame:
    """Per firm: volume and mean uphold rate over rated rows, periods, slope and growth.

    One pass over the fact: it is aggregated per (firm, period) once - volume of all rows, and the
    rated rows' volume, count and integer moments - then per firm. The slope comes from the exact
    moments (``operators.stats.trend_slope`` semantics, including the degenerate rule), the growth
    from the first and last period volume of all rows (``growth_pct`` semantics). No join.
    """
    return base_from_periods(firm_periods(fact), min_total, degenerate)


def base_from_periods(per_type: DataFrame, min_total: int = K.MIN_TOTAL, degenerate: str = "min_norm") -> DataFrame:
    """:func:`risk_base` from the rows of :func:`firm_periods`."""
    per_period = per_type.groupBy(K.FIRM, K.ORDER).agg(
        *[F.sum(c).alias(c) for c in ("v_all", "v_rated", "n", "sy")], F.min(K.TYPE).alias(K.TYPE)
    )
    o = F.col(K.ORDER).cast("bigint")
    has = F.col("n") > 0
    m = per_period.groupBy(K.FIRM).agg(
        F.sum("v_rated").alias("total_opened"),
        F.sum("sy").alias("__sy"),
        F.sum("n").alias("__n"),
        F.sum(o * F.col("n")).alias("__sx"),
        F.sum(o * o * F.col("n")).alias("__sxx"),
        F.sum(o * F.col("sy")).alias("__sxy"),
        F.min(F.when(has, o)).alias("__xmin"),
        F.count(F.when(has, F.lit(1))).alias("periods"),
        F.min(F.when(has, F.col(K.TYPE))).alias(K.TYPE),
        F.min_by("v_all", K.ORDER).alias("__first"),
        F.max_by("v_all", K.ORDER).alias("__last"),
        F.count(F.lit(1)).alias("__k"),
    )
    n, sx, sy, sxx, sxy = (F.col(c) for c in ("__n", "__sx", "__sy", "__sxx", "__sxy"))
    den = n * sxx - sx * sx
    regular = (n * sxy - sx * sy).cast("double") / den.cast("double") / F.lit(10.0)
    if degenerate == "min_norm":
        degen = sy.cast("double") / (n * F.col("__xmin") * F.lit(20)).cast("double")
    elif degenerate == "zero":
        degen = F.lit(0.0)
    else:
        raise ValueError(f"unknown degenerate rule {degenerate!r}")
    first, last = F.col("__first"), F.col("__last")
    growth = (last - first).cast("double") / first.cast("double") * F.lit(100.0)
    return m.filter((n > 0) & (F.col("total_opened") > min_total)).select(
        K.FIRM,
        "total_opened",
        (sy.cast("double") / (n * F.lit(10))).alias("avg_upheld"),
        K.TYPE,
        "periods",
        F.when(n < 2, F.lit(0.0)).when(den == 0, degen).otherwise(regular).alias("upheld_trend"),
        F.when((F.col("__k") < 2) | (first == 0), F.lit(0.0)).otherwise(growth).alias("volume_growth"),
    )


def risk_index(
    fact: DataFrame,
    min_total: int = K.MIN_TOTAL,
    weights: tuple[float, float, float, float] = K.RISK_WEIGHTS,
    clip_q: tuple[float, float] = K.RISK_CLIP,
    high: float = K.RISK_HIGH,
    checkpoint: bool = True,
) -> DataFrame:
    """All firms of the base with clipped measures, scores, the index and the high-risk flag."""
    base = _materialise(prepared_base(fact, min_total), checkpoint)
    return index_from_base(base, weights=weights, clip_q=clip_q, high=high)


def prepared_base(fact: DataFrame, min_total: int = K.MIN_TOTAL) -> DataFrame:
    return prepared_from_periods(firm_periods(fact), min_total)


def prepared_from_periods(per_type: DataFrame, min_total: int = K.MIN_TOTAL) -> DataFrame:
    base = base_from_periods(per_type, min_total)
    return base.withColumn("total_opened", F.col("total_opened").cast("double"))


def index_from_base(
    base: DataFrame,
    weights: tuple[float, float, float, float] = K.RISK_WEIGHTS,
    clip_q: tuple[float, float] = K.RISK_CLIP,
    high: float = K.RISK_HIGH,
    bounds=None,
) -> DataFrame:
    """Clip -> scale -> weight over a (materialised) firm base. ``bounds`` may carry the clip
    quantiles already computed (``<measure>__lo`` / ``__hi``) to skip the ranking pass."""
    clipped = winsorise(base, MEASURES, *clip_q, bounds=bounds)
    scored = minmax(clipped, MEASURES)
    w = [F.lit(float(x)) for x in weights]
    idx = (
        F.col(SCORES[0]) * w[0] + F.col(SCORES[1]) * w[1] + F.col(SCORES[2]) * w[2] + F.col(SCORES[3]) * w[3]
    )
    return scored.withColumn("risk_index", rint_dp(idx, 1)).withColumn(
        "high_risk", (F.col("risk_index") >= F.lit(float(high))).cast("int")
    ).select(K.FIRM, K.TYPE, "periods", *MEASURES, *SCORES, "risk_index", "high_risk")


def summary_from_base(base: DataFrame, clip_q: tuple[float, float] = K.RISK_CLIP) -> dict:
    """Danger count by medians and the top risk firm, from one ranking pass over the base.

    The median quadrant of the notebook summary uses the same firms (rated rows, volume above the
    threshold, grouped by firm) and the same two measures as the risk base, so its medians come
    from the same ranking as the clip bounds.
    """
    lo, hi = clip_q
    q = multi_quantiles(base, list(MEASURES), [lo, 0.5, hi], names=["lo", "m", "hi"]).first()
    mv, mu = q["total_opened__m"], q["avg_upheld__m"]
    danger = base.filter((F.col("total_opened") > F.lit(mv)) & (F.col("avg_upheld") > F.lit(mu))).count() if mv is not None else 0
    top = risk_table(index_from_base(base, clip_q=clip_q, bounds=q), 1).first()
    return {"danger_count": danger, "top_risk_firm": top[K.FIRM] if top else None,
            "top_risk_index": top["risk_index"] if top else None}


def risk_table(index: DataFrame, top: int = 15) -> DataFrame:
    """The saved top table: clipped inputs next to the index, highest first."""
    return (
        index.orderBy(F.desc("risk_index"), K.FIRM)
        .limit(top)
        .select(K.FIRM, K.TYPE, "risk_index", "avg_upheld", "total_opened", "upheld_trend")
    )


def firm_scatter(fact: DataFrame, min_total: int = K.MIN_TOTAL, by=(K.FIRM, K.TYPE)) -> DataFrame:
    """Per firm over rows with an uphold rate: volume, mean uphold rate, periods; volume > min_total."""
    return (
        fact.filter(F.col(K.UPHELD_T).isNotNull())
        .groupBy(*by)
        .agg(
            F.sum(K.OPENED).alias("total_opened"),
            exact_mean(K.UPHELD_T, 10).alias("avg_upheld"),
            F.countDistinct(K.LABEL).alias("periods"),
        )
        .filter(F.col("total_opened") > min_total)
    )


def median_quadrant(fact: DataFrame, min_total: int = K.MIN_TOTAL, by=(K.FIRM, K.TYPE)) -> DataFrame:
    """Danger quadrant by medians: strictly above the median volume and the median uphold rate."""
    # stored once: the ranking samples and shuffles it, and the flags read it again
    scatter = materialise(firm_scatter(fact, min_total, by), "scatter")
    med = multi_quantiles(scatter, ["total_opened", "avg_upheld"], [0.5], names=["m"]).first()
    mv, mu = F.lit(med["total_opened__m"]), F.lit(med["avg_upheld__m"])
    return scatter.select(
        "*",
        mv.alias("vol_threshold"),
        mu.alias("upheld_threshold"),
        ((F.col("total_opened") > mv) & (F.col("avg_upheld") > mu)).cast("int").alias("in_danger"),
    )


def danger_quadrant(fact: DataFrame, min_total: int = K.MIN_TOTAL, method: str = "quartile") -> DataFrame:
    """Both published definitions: ``"quartile"`` (top volume and top uphold quartile, the SQL
    module) or ``"median"`` (strictly above both medians, the notebook)."""
    if method == "quartile":
        from riskloom.plans.named_queries import k2_danger_list

        return k2_danger_list(fact, min_total)
    if method == "median":
        q = median_quadrant(fact, min_total)
        return q.filter(F.col("in_danger") == 1).select(K.FIRM, K.TYPE, "total_opened", "avg_upheld")
    raise ValueError(f"unknown method {method!r}")
