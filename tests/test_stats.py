"""Statistics operators against numpy on hand-made inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators.stats import box_summary, growth_pct, minmax, quantiles, trend_slope, winsorise


def test_quantiles_linear_interpolation(spark):
    vals = [1.0, 2.0, 9.0, 4.0, 4.0, 7.5, 3.25]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
    got = quantiles(df, "x", [0.05, 0.5, 0.95], names=["a", "b", "c"]).first()
    for name, p in zip("abc", (0.05, 0.5, 0.95)):
        assert got[name] == pytest.approx(float(np.quantile(vals, p)), rel=1e-12)


def test_quantiles_tiny_inputs(spark):
    one = spark.createDataFrame([(3.0,)], "x double")
    assert quantiles(one, "x", [0.05, 0.95], names=["lo", "hi"]).first() == (3.0, 3.0)
    three = spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "x double")
    assert quantiles(three, "x", [0.05], names=["q"]).first()[0] == pytest.approx(1.1)


def test_box_summary_whiskers_and_outliers(spark):
    vals = [10, 20, 30, 40, 50, 60, 70, 80, 90, 1000]
    df = spark.createDataFrame([("a", v) for v in vals], "g string, t bigint")
    r = box_summary(df, ["g"], "t", scale=10).first()
    q1, q2, q3 = np.percentile(vals, [25, 50, 75])
    iqr = q3 - q1
    inside = [v for v in vals if q1 - 1.5 * iqr <= v <= q3 + 1.5 * iqr]
    assert (r.q1, r.median, r.q3) == (q1 / 10, q2 / 10, q3 / 10)
    assert r.whisker_low == min(inside) / 10 and r.whisker_high == max(inside) / 10
    assert r.n_outliers == 1 and r.n == 10


def test_trend_slope_regular_degenerate_and_single(spark):
    rows = [("reg", x, y) for x, y in [(1, 100), (2, 150), (4, 300), (5, 290)]]
    rows += [("deg", 3, 400), ("deg", 3, 500), ("deg", 3, 600)]  # one period, several categories
    rows += [("one", 2, 555)]
    df = spark.createDataFrame(rows, "f string, x int, y bigint")
    got = {r.f: r.upheld_trend for r in trend_slope(df, ["f"], "x", "y").collect()}
    xs, ys = zip(*[(x, y / 10) for _, x, y in rows[:4]])
    assert got["reg"] == pytest.approx(np.polyfit(xs, ys, 1)[0], rel=1e-9)
    assert got["deg"] == pytest.approx(50 / 6)  # minimum-norm answer: mean(y) / (2 x)
    assert got["one"] == 0.0
    zero = {r.f: r.upheld_trend for r in trend_slope(df, ["f"], "x", "y", degenerate="zero").collect()}
    assert zero["deg"] == 0.0


def test_growth_first_zero_and_single_period(spark):
    rows = [("g", 1, 100), ("g", 1, 50), ("g", 3, 300), ("z", 1, 0), ("z", 2, 10), ("s", 4, 10)]
    df = spark.createDataFrame(rows, "f string, o int, v bigint")
    got = {r.f: r.volume_growth for r in growth_pct(df, ["f"], "o", "v").collect()}
    assert got == {"g": 100.0, "z": 0.0, "s": 0.0}


def test_winsorise_then_minmax(spark):
    vals = [float(v) for v in range(21)]
    df = spark.createDataFrame([(v, 5.0) for v in vals], "a double, c double")
    w = winsorise(df, ["a", "c"], 0.05, 0.95)
    lo, hi = np.quantile(vals, [0.05, 0.95])
    got = sorted(r.a for r in w.collect())
    assert got[0] == lo and got[-1] == hi
    scored = minmax(w, ["a", "c"]).agg(F.min("a_score"), F.max("a_score"), F.max("c_score")).first()
    assert tuple(scored) == (0.0, 100.0, 0.0)


def test_quantiles_of_a_hot_value(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.where(rng.random(20_000) < 0.9, 0.0, rng.normal(size=20_000))
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    probs = [0.0, 0.05, 0.5, 0.95, 0.999, 1.0]
    got = quantiles(df, "v", probs, names=[f"q{i}" for i in range(6)]).first()
    assert np.allclose(list(got), np.quantile(x, probs), rtol=1e-12, atol=1e-12)
