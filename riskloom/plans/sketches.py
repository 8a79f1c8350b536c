"""Mart of mergeable sketches: distinct firms and uphold quantiles without the fact.

A mart row (firm type, period, regime) holds a HyperLogLog sketch of its firms and a KLL sketch of its uphold rates (integer
tenths), both of fixed size, beside exact sums. Any coarser grouping merges mart rows: the fact is not read again, and a new
period only adds rows. Stated errors: ``FIRMS_ERROR`` relative on distinct firms (three standard errors of 2**LG_FIRMS registers,
rounded up), ``RANK_ERROR`` in rank on quantiles (a KLL sketch with ``K_RATES``: normalised rank error under 0.01 with 99 %
confidence; the bound leaves twice that).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import contract as K

LG_FIRMS, FIRMS_ERROR = 12, 0.05
K_RATES, RANK_ERROR = 400, 0.02
QUARTILES = (0.25, 0.5, 0.75)
GRAIN = [K.TYPE, K.LABEL, K.ORDER, K.DUTY]


def sketch_mart(fact: DataFrame, by: Sequence[str] = GRAIN) -> DataFrame:
    """One row per ``by``: n_rows, opened, n_rated, and the sketches of firms and of rates (null without a rate)."""
    rated = F.col(K.UPHELD_T)
    return fact.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(K.OPENED).alias("opened"),
        F.count(rated).alias("n_rated"),
        F.hll_sketch_agg(K.FIRM, LG_FIRMS).alias("firms_sketch"),
        F.kll_sketch_agg_bigint(rated, K_RATES).alias("rates_sketch"),
    ).withColumn("rates_sketch", F.when(F.col("n_rated") > 0, F.col("rates_sketch")))


def roll_up(mart: DataFrame, by: Sequence[str]) -> DataFrame:
    """The mart at a coarser grain (the same columns, so it can be rolled up again)."""
    return mart.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("n_rows", "opened", "n_rated")],
        F.hll_union_agg("firms_sketch").alias("firms_sketch"),
        F.kll_merge_agg_bigint("rates_sketch", K_RATES).alias("rates_sketch"),
    ).withColumn("rates_sketch", F.when(F.col("n_rated") > 0, F.col("rates_sketch")))


def estimates(mart: DataFrame, probs: Sequence[float] = QUARTILES) -> DataFrame:
    """``mart`` with firms_estimate and rate_quantiles (tenths, an array in the order of ``probs``; null without a rate)."""
    qs = F.kll_sketch_get_quantile_bigint("rates_sketch", F.array(*[F.lit(float(p)) for p in probs]))
    return mart.withColumns({"firms_estimate": F.hll_sketch_estimate("firms_sketch"), "rate_quantiles": qs}).drop(
        "firms_sketch", "rates_sketch"
    )


def sketch_audit(mart: DataFrame, fact: DataFrame, by: Sequence[str], probs: Sequence[float] = QUARTILES) -> DataFrame:
    """Estimates beside the exact answers: firms, n_rated, firms_within, quantiles_within (by the stated errors).

    A quantile is within its error when the ranks that its value takes in the data (from the share of smaller values to the
    share of values up to it) come within RANK_ERROR of the rank asked for. ``by`` must hold few groups: they are broadcast
    if Spark measures them small, and joined by a shuffle if not.
    """
    got = estimates(roll_up(mart, by), probs)
    exact = fact.groupBy(*by).agg(F.countDistinct(K.FIRM).alias("firms"))
    values = fact.filter(F.col(K.UPHELD_T).isNotNull()).groupBy(*by, K.UPHELD_T).agg(F.count(F.lit(1)).alias("c"))
    ranks = []
    for i, _ in enumerate(probs):
        q = F.col("rate_quantiles")[i]
        ranks += [
            F.sum(F.when(F.col(K.UPHELD_T) < q, F.col("c")).otherwise(0)).alias(f"under{i}"),
            F.sum(F.when(F.col(K.UPHELD_T) <= q, F.col("c")).otherwise(0)).alias(f"upto{i}"),
        ]
    placed = values.join(got.select(*by, "rate_quantiles"), list(by)).groupBy(*by).agg(*ranks)
    n = F.col("n_rated").cast("double")
    near = F.lit(True)
    for i, p in enumerate(probs):
        near &= (F.col(f"under{i}") / n <= p + RANK_ERROR) & (F.col(f"upto{i}") / n >= p - RANK_ERROR)
    off = F.abs(F.col("firms_estimate") - F.col("firms")) <= F.col("firms") * F.lit(FIRMS_ERROR)
    return got.join(exact, list(by)).join(placed, list(by), "left").select(
        *by, "n_rows", "opened", "n_rated", "firms", off.alias("firms_within"), F.coalesce(near, F.lit(True)).alias("quantiles_within")
    )
