"""Analytical datasets of the exploratory notebook (the data behind each chart), N1-N11.

Means that the notebook leaves unrounded are exact single divisions of integer-tenth sums
(``exact_mean``); the row mean of a heat-map row adds its cell means in sorted order, so the value
does not depend on arrival order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom import contract as K
from riskloom.functions.numeric import exact_mean
from riskloom.functions.rules import replace_chain, traffic_light
from riskloom.operators.compare import compare_sides
from riskloom.operators.reshape import pivot_measure
from riskloom.operators.windows import stack_offsets
from riskloom.plans import risk as R
from riskloom.operators.stats import box_summary
from riskloom.session import materialise


def period_labels(fact: DataFrame) -> list[str]:
    """Chronological period labels (driver round trip bounded by the number of periods)."""
    rows = fact.select(K.LABEL, K.ORDER).distinct().orderBy(K.ORDER).collect()
    return [r[0] for r in rows]


def categories(fact: DataFrame) -> list[str]:
    """Distinct categories, sorted (bounded by the category list)."""
    return [r[0] for r in fact.select(K.CAT).distinct().orderBy(K.CAT).collect()]


def regime_records(fact: DataFrame) -> DataFrame:
    """Rows and total volume per regime (the notebook's load check)."""
    return fact.groupBy(K.DUTY).agg(F.count(K.OPENED).alias("records"), F.sum(K.OPENED).alias("total_complaints"))


def n1_period_totals(fact: DataFrame) -> DataFrame:
    return (
        fact.groupBy(K.LABEL, K.ORDER, K.DUTY)
        .agg(F.sum(K.OPENED).alias(K.OPENED))
        .orderBy(K.ORDER)
    )


def n2_top_firms(fact: DataFrame, top: int = 15) -> DataFrame:
    per = fact.groupBy(K.FIRM, K.TYPE).agg(
        F.sum(K.OPENED).alias("total_opened"),
        exact_mean(K.UPHELD_T, 10).alias("avg_upheld"),
    )
    return (
        per.orderBy(F.desc("total_opened"), K.FIRM, K.TYPE)
        .limit(top)
        .select(
            K.FIRM,
            K.TYPE,
            replace_chain(K.FIRM).alias("short_name"),
            "total_opened",
            "avg_upheld",
            traffic_light("avg_upheld").alias("traffic_light"),  # a missing mean is green
        )
    )


def n3_box_by_type(fact: DataFrame) -> DataFrame:
    box = box_summary(fact, [K.TYPE], K.UPHELD_T, scale=10)
    mean = fact.filter(F.col(K.UPHELD_T).isNotNull()).agg(exact_mean(K.UPHELD_T, 10).alias("m")).scalar()
    # sectors ordered by median, highest first (the box table has one row per sector)
    order = Window.orderBy(F.desc("median"), K.TYPE)
    return box.select("*", mean.alias("industry_mean")).withColumn("median_rank", F.row_number().over(order).cast("bigint"))


def n4_category_pre_post(fact: DataFrame) -> DataFrame:
    """Category x regime volume and mean uphold rate side by side, 0 where a side is absent."""
    cat_duty = fact.groupBy(K.CAT, K.DUTY).agg(
        F.sum(K.OPENED).alias("total_opened"), exact_mean(K.UPHELD_T, 10).alias("avg_upheld")
    )
    sides = compare_sides(cat_duty, [K.CAT], {"volume": "total_opened", "upheld": "avg_upheld"})
    return sides.select(
        K.CAT,
        F.coalesce("pre_volume", F.lit(0).cast("bigint")).alias("pre_volume"),
        F.coalesce("post_volume", F.lit(0).cast("bigint")).alias("post_volume"),
        F.coalesce("pre_upheld", F.lit(0.0)).alias("pre_upheld"),
        F.coalesce("post_upheld", F.lit(0.0)).alias("post_upheld"),
    )


def n5_heat_matrix(fact: DataFrame, top: int = 20, labels: Sequence[str] | None = None) -> DataFrame:
    labels = list(labels) if labels is not None else period_labels(fact)
    top_firms = (
        fact.groupBy(K.FIRM).agg(F.sum(K.OPENED).alias("__tot")).orderBy(F.desc("__tot"), K.FIRM).limit(top)
    )
    cells = (
        fact.join(F.broadcast(top_firms.select(K.FIRM)), K.FIRM, "left_semi")  # top-k: at most `top` rows
        .groupBy(K.FIRM, K.LABEL)
        .agg(exact_mean(K.UPHELD_T, 10).alias("cell"))
    )
    row_mean = (
        cells.filter(F.col("cell").isNotNull())
        .groupBy(K.FIRM)
        .agg(F.array_sort(F.collect_list("cell")).alias("__cells"))  # at most one value per period
        .select(
            K.FIRM,
            (F.aggregate("__cells", F.lit(0.0), lambda acc, v: acc + v) / F.size("__cells")).alias("row_mean"),
        )
    )
    matrix = pivot_measure(cells, [K.FIRM], K.LABEL, labels, "cell", agg="first")
    rank = Window.orderBy(F.desc_nulls_last("row_mean"), K.FIRM)
    return (
        matrix.join(row_mean, K.FIRM, "left")
        .withColumn("row_order", F.row_number().over(rank).cast("bigint"))
        .select(K.FIRM, "row_order", "row_mean", *[F.col(f"`{lab}`") for lab in labels])
    )


def n6_median_quadrant(fact: DataFrame, min_total: int = K.MIN_TOTAL) -> DataFrame:
    return R.median_quadrant(fact, min_total)


def n7_group_trajectory(fact: DataFrame, firms: Sequence[str] | None = None) -> DataFrame:
    """Per firm and period: volume and mean uphold rate; ``firms`` restricts to a named list."""
    src = fact.filter(F.col(K.FIRM).isin(list(firms))) if firms is not None else fact
    return (
        src.groupBy(K.GROUP, K.FIRM, K.LABEL, K.ORDER, K.DUTY)
        .agg(F.sum(K.OPENED).alias("total_opened"), exact_mean(K.UPHELD_T, 10).alias("avg_upheld"))
        .orderBy(K.ORDER, K.GROUP, K.FIRM)
    )


def n9_type_pre_post(fact: DataFrame) -> DataFrame:
    per = (
        fact.filter(F.col(K.UPHELD_T).isNotNull())
        .groupBy(K.TYPE, K.DUTY)
        .agg(exact_mean(K.UPHELD_T, 10).alias("avg_upheld"))
    )
    piv = pivot_measure(per, [K.TYPE], K.DUTY, [K.PRE_LABEL, K.POST_LABEL], "avg_upheld", agg="first", require_all=True)
    pre, post = F.col(f"`{K.PRE_LABEL}`"), F.col(f"`{K.POST_LABEL}`")
    return piv.select(
        K.TYPE,
        pre.alias("pre_upheld"),
        post.alias("post_upheld"),
        (post - pre).alias("change_ppts"),
        (post < pre).cast("int").alias("improved"),
    ).orderBy("post_upheld", K.TYPE)


def n10_category_stack(fact: DataFrame, cats: Sequence[str] | None = None) -> DataFrame:
    """Period x category volumes, zero-filled, with stacked-bar offsets.

    Bars are stacked in ``cats`` order as far as the data has those categories, then the others by name.
    """
    present = categories(fact)
    cats = [c for c in cats or () if c in present]
    cats += [c for c in present if c not in cats]
    per = fact.groupBy(K.LABEL, K.ORDER, K.CAT).agg(F.sum(K.OPENED).alias(K.OPENED))
    wide = pivot_measure(per, [K.LABEL, K.ORDER], K.CAT, cats, K.OPENED, agg="first", fill=0)
    long = wide.unpivot([K.LABEL, K.ORDER], [F.col(f"`{c}`") for c in cats], K.CAT, K.OPENED)
    pos = F.array_position(F.array(*[F.lit(c) for c in cats]), F.col(K.CAT)).cast("int")
    return stack_offsets(long.withColumn("cat_pos", pos), [K.LABEL], "cat_pos", K.OPENED).orderBy(K.ORDER, "cat_pos")


def n11_summary(fact: DataFrame, min_total: int = K.MIN_TOTAL, risk: DataFrame | None = None) -> DataFrame:
    pre = F.col(K.DUTY) == K.PRE_LABEL
    post = F.col(K.DUTY) == K.POST_LABEL
    # the fact is read once: it is reduced to firm x period, from which the totals and the firm base follow
    per = R.firm_periods(fact, [K.LABEL, K.DUTY])
    if risk is None:
        per = materialise(per, "firm-periods")
    side = lambda on, c: F.sum(F.when(on, F.col(c)))
    totals = per.agg(
        F.sum("v_all").alias("total_complaints"),
        F.countDistinct(K.FIRM).alias("firms"),
        F.countDistinct(K.LABEL).alias("periods"),
        side(pre, "v_all").alias("pre_total"),
        side(post, "v_all").alias("post_total"),
        (side(pre, "sy").cast("double") / (side(pre, "n") * 10)).alias("pre_upheld"),
        (side(post, "sy").cast("double") / (side(post, "n") * 10)).alias("post_upheld"),
    )
    # danger count and top risk firm: one firm base, one ranking pass (bounded rows read back)
    if risk is None:
        base = materialise(R.prepared_from_periods(per, min_total), "summary-base")
        extra = R.summary_from_base(base)
    else:
        quad = R.median_quadrant(fact, min_total, by=(K.FIRM,))
        top1 = R.risk_table(risk, 1).first()
        extra = {"danger_count": quad.agg(F.sum("in_danger")).first()[0] or 0,
                 "top_risk_firm": top1[K.FIRM] if top1 else None,
                 "top_risk_index": top1["risk_index"] if top1 else None}
    return totals.select(
        "*",
        ((F.col("post_total") - F.col("pre_total")).cast("double") / F.col("pre_total").cast("double") * F.lit(100.0)).alias(
            "change_pct"
        ),
        (F.col("post_upheld") - F.col("pre_upheld")).alias("upheld_change_ppts"),
        F.lit(extra["danger_count"]).cast("bigint").alias("danger_count"),
        F.lit(extra["top_risk_firm"]).cast("string").alias("top_risk_firm"),
        F.lit(extra["top_risk_index"]).cast("double").alias("top_risk_index"),
    )
