"""Statistics over entity tables: exact quantiles, box summaries, trend slope, first->last growth,
winsorising and min-max scaling.

Scale notes
-----------
* ``quantiles`` is exact and distributed: histograms of fixed size narrow the range around each wanted order statistic until
  it holds one value - no buffer and no shuffle of all distinct values. Result: a one-row DataFrame.
* ``box_summary`` derives everything from the counts per (group, value): one pass over the table.
* The slope is computed from exact integer moments, so it does not depend on summation order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.numeric import clip, minmax_scale
from riskloom.session import materialise

#: Buckets of one bracket in one pass of the quantile selection.
BUCKETS = 1 << 14


def _pname(p: float) -> str:
    return ("p" + f"{p:.4f}".rstrip("0").rstrip(".").replace(".", "_")) if p not in (0, 1) else f"p{int(p)}"


def quantiles(df: DataFrame, column: str, probs: Sequence[float], names: Sequence[str] | None = None,
              buckets: int = BUCKETS) -> DataFrame:
    """Exact linear-interpolation quantiles of ``column`` (nulls ignored) as a one-row DataFrame.

    For N values sorted ascending (0-based ``x[i]``), ``pos = (N - 1) * p``, ``lo = floor(pos)``,
    ``hi = ceil(pos)``: ``q = x[lo] + (x[hi] - x[lo]) * (pos - lo)``.
    """
    names = list(names) if names else [_pname(p) for p in probs]
    wide = multi_quantiles(df, [column], probs, names, buckets)
    return wide.select(*[F.col(f"{column}__{nm}").alias(nm) for nm in names])


def multi_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    names: Sequence[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Exact quantiles of several columns: one row, ``<column>__<name>`` (null where a column has no value).

    Selection by narrowing histograms. A bracket is a range of values that holds a wanted order statistic; at first these are a
    column's negative values, zeros and positive values. Each pass deals the values of all open brackets into ``buckets`` buckets
    that follow the order of values (linear, or logarithmic where a bracket spans more than a factor of two), counts them with
    map-side aggregation, and keeps the buckets that hold wanted ranks, down to their true least and largest value; a
    bracket with one value is closed. A shuffle carries at most ``buckets`` counts a bracket, however many distinct values there
    are, and the driver gets one row for each wanted rank. Two or three passes are usual. Infinite values raise, NaN counts as null.
    """
    names = list(names) if names else [_pname(p) for p in probs]
    spark = df.sparkSession
    typed = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = typed.unpivot([], list(columns), "__m", "__v").filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    long = materialise(long, "values")  # narrow rows that every pass reads
    found = _order_statistics(long, lambda n: {i for p in probs for i in _places(n, p)[:2]}, buckets)
    row = []
    for c in columns:
        n, at = found.get(c, (0, {}))
        for p in probs:
            lo, hi, share = _places(n, p)
            row.append(at[lo] + (at[hi] - at[lo]) * share if n else None)
    out = [f"{c}__{nm}" for c in columns for nm in names]
    return spark.range(1).select(*[F.lit(v).cast("double").alias(c) for v, c in zip(row, out, strict=True)])


def _places(n: int, p: float) -> tuple[int, int, float]:
    """The two ranks (from 0) around a quantile of n values, and the share of the way between them."""
    pos = max(n - 1, 0) * float(p)
    return math.floor(pos), math.ceil(pos), pos - math.floor(pos)


def _order_statistics(long: DataFrame, wanted, buckets: int) -> dict[str, tuple[int, dict[int, float]]]:
    """Number of values and the values of the wanted ranks for each measure of ``long`` (``__m``, ``__v``)."""
    sign = F.signum("__v").cast("int").alias("__sign")
    stats = long.groupBy("__m", sign).agg(
        F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")
    )
    signs: dict[str, list] = {}
    for r in sorted(stats.collect(), key=lambda r: (r["__m"], r["__sign"])):  # at most three rows a measure
        if math.isinf(r.lo) or math.isinf(r.hi):
            raise ValueError(f"{r['__m']} holds an infinite value")
        signs.setdefault(r["__m"], []).append(r)
    found, open_ = {}, []
    for m, parts in signs.items():
        total = sum(r.n for r in parts)
        found[m], below = (total, {}), 0
        for r in parts:
            open_.append((m, r.lo, r.hi, below, [i for i in wanted(total) if below <= i < below + r.n]))
            below += r.n
    while True:
        for m, lo, hi, _, ranks in open_:
            found[m][1].update({i: lo for i in ranks if lo == hi})
        open_ = [b for b in open_ if b[4] and b[1] < b[2]]
        if not open_:
            return found
        open_ = _narrower(long, open_, buckets)


def _narrower(long: DataFrame, brackets: list, buckets: int) -> list:
    """The buckets of the brackets (measure, lo, hi, values below, ranks) that hold a wanted rank, as brackets."""
    spark = long.sparkSession
    kind = "m string, lo double, hi double, below bigint, ranks array<bigint>"
    known = spark.createDataFrame(brackets, kind).coalesce(1)  # a row for each wanted rank at most
    met = long.join(F.broadcast(known), (F.col("__m") == F.col("m")) & F.col("__v").between(F.col("lo"), F.col("hi")))
    small, large = F.least(F.abs("lo"), F.abs("hi")), F.greatest(F.abs("lo"), F.abs("hi"))
    size = F.abs("__v")
    share = F.when(large / F.lit(2.0) > small, (F.log(size) - F.log(small)) / (F.log(large) - F.log(small))).otherwise(
        (size - small) / (large - small)
    )
    up = F.least(F.floor(share * F.lit(buckets)), F.lit(buckets - 1))
    bucket = F.when(F.col("__v") < 0, F.lit(buckets - 1) - up).otherwise(up)
    counted = met.groupBy("m", F.col("below").alias("base"), bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min("__v").alias("least"), F.max("__v").alias("most")
    )
    # at most ``buckets`` rows a bracket
    before = Window.partitionBy("m", "base").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("start", F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranks = known.select("m", F.col("below").alias("base"), "ranks")
    inside = F.filter("ranks", lambda i: (i >= F.col("start")) & (i < F.col("start") + F.col("n")))
    hit = placed.join(F.broadcast(ranks), ["m", "base"]).withColumn("ranks", inside).filter(F.size("ranks") > 0)
    return [(r.m, r.least, r.most, r.start, list(r.ranks)) for r in hit.collect()]


def box_summary(df: DataFrame, by: Sequence[str], value: str, whis: float = 1.5, scale: float = 1.0) -> DataFrame:
    """Per-group five-number box summary (matplotlib ``boxplot`` defaults).

    q1/median/q3 by linear interpolation; whiskers at the most extreme values within ``whis * IQR`` of the box;
    ``n_outliers`` beyond them. ``value`` is divided by ``scale`` on output (pass integer tenths with ``scale=10`` for exact
    quartiles).

    The table is read once: everything follows from the counts per (group, value), which are pre-aggregated and, for integer
    tenths of a percentage, at most 1,001 rows a group. For a value without such a bound, round it first.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(
        F.count(F.lit(1)).alias("__c")
    )
    group = Window.partitionBy(*by)
    placed = counted.withColumns({"__upto": F.sum("__c").over(group.orderBy("__v")), "__n": F.sum("__c").over(group)})
    quartiles = {}
    for name, p in (("__q1", 0.25), ("__q2", 0.5), ("__q3", 0.75)):
        pos = (F.col("__n") - 1).cast("double") * F.lit(p)
        at = lambda i: F.min(F.when(F.col("__upto") > i, F.col("__v"))).over(group)
        low, high = at(F.floor(pos)), at(F.ceil(pos))
        quartiles[name] = low + (high - low) * (pos - F.floor(pos))
    boxed = placed.withColumns(quartiles)
    reach = F.lit(whis) * (F.col("__q3") - F.col("__q1"))
    inside = (F.col("__v") >= F.col("__q1") - reach) & (F.col("__v") <= F.col("__q3") + reach)
    s = F.lit(float(scale))
    return boxed.groupBy(*by).agg(
        F.sum("__c").alias("n"),
        *[(F.first(q) / s).alias(name) for q, name in (("__q1", "q1"), ("__q2", "median"), ("__q3", "q3"))],
        (F.min(F.when(inside, F.col("__v"))) / s).alias("whisker_low"),
        (F.max(F.when(inside, F.col("__v"))) / s).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("__c"))), F.lit(0)).alias("n_outliers"),
    )


def trend_slope(
    df: DataFrame,
    by: Sequence[str],
    x: str,
    y: str,
    y_scale: int = 10,
    min_points: int = 2,
    degenerate: str = "min_norm",
    name: str = "upheld_trend",
) -> DataFrame:
    """Least-squares slope of integral ``y / y_scale`` over integral ``x`` per group.

    Exact moments: ``slope = (n*Sxy - Sx*Sy) / (n*Sxx - Sx^2) / y_scale``. Fewer than
    ``min_points`` rows -> 0. All x equal (>= 2 rows): ``degenerate="min_norm"`` returns the
    minimum-norm least-squares answer ``mean(y) / (2 * x)`` (what a rank-deficient polynomial fit
    returns); ``"zero"`` returns 0.
    """
    xs, ys = F.col(x).cast("bigint"), F.col(y).cast("bigint")
    pts = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = pts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"),
        F.sum(xs).alias("__sx"),
        F.sum(ys).alias("__sy"),
        F.sum(xs * xs).alias("__sxx"),
        F.sum(xs * ys).alias("__sxy"),
        F.min(xs).alias("__xmin"),
    )
    n, sx, sy, sxx, sxy = (F.col(c) for c in ("__n", "__sx", "__sy", "__sxx", "__sxy"))
    num = n * sxy - sx * sy
    den = n * sxx - sx * sx
    regular = num.cast("double") / den.cast("double") / F.lit(float(y_scale))
    if degenerate == "min_norm":
        degen = sy.cast("double") / (n * F.col("__xmin") * F.lit(2 * y_scale)).cast("double")
    elif degenerate == "zero":
        degen = F.lit(0.0)
    else:
        raise ValueError(f"unknown degenerate rule {degenerate!r}")
    slope = F.when(n < min_points, F.lit(0.0)).when(den == 0, degen).otherwise(regular)
    return m.select(*by, slope.alias(name), n.alias("n_points"))


def growth_pct(df: DataFrame, by: Sequence[str], order: str, value: str, name: str = "volume_growth") -> DataFrame:
    """First -> last growth in % of per-(group, order) sums; < 2 orders or first = 0 -> 0."""
    per = df.groupBy(*by, order).agg(F.sum(value).alias("__v"))
    fl = per.groupBy(*by).agg(
        F.min_by("__v", order).alias("__first"),
        F.max_by("__v", order).alias("__last"),
        F.count(F.lit(1)).alias("__k"),
    )
    first, last = F.col("__first"), F.col("__last")
    g = (last - first).cast("double") / first.cast("double") * F.lit(100.0)
    return fl.select(*by, F.when((F.col("__k") < 2) | (first == 0), F.lit(0.0)).otherwise(g).alias(name))


def winsorise(df: DataFrame, columns: Sequence[str], lo: float = 0.05, hi: float = 0.95, bounds=None) -> DataFrame:
    """Clip each column to its own exact ``lo``/``hi`` quantiles.

    The 2 x columns bounds come from one ranking pass and are read back as one small row (a
    bounded driver round trip), then applied as literals. ``bounds`` (a row or mapping with
    ``<column>__lo`` / ``<column>__hi``) skips the pass when the caller already has them.
    """
    b = bounds if bounds is not None else multi_quantiles(df, columns, [lo, hi], names=["lo", "hi"]).first()
    return df.select(
        *[clip(c, F.lit(b[f"{c}__lo"]), F.lit(b[f"{c}__hi"])).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def minmax(df: DataFrame, columns: Sequence[str], suffix: str = "_score", lo: float = 0.0, hi: float = 100.0) -> DataFrame:
    """Min-max scale each column to ``[lo, hi]`` as ``column + suffix``; constant column -> ``lo``.

    Column minima and maxima are one aggregate row read back once and applied as literals.
    """
    b = df.agg(*[F.min(c).alias(f"{c}__min") for c in columns], *[F.max(c).alias(f"{c}__max") for c in columns]).first()
    return df.select(
        "*",
        *[minmax_scale(c, F.lit(b[f"{c}__min"]), F.lit(b[f"{c}__max"]), lo, hi).alias(c + suffix) for c in columns],
    )
