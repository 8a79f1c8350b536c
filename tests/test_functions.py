"""Column functions on hand-made values: coercion, exact rounding, rules, bands, clip/scale."""

from pyspark.sql import functions as F

from riskloom import contract as K
from riskloom.functions import (
    band,
    classify,
    clip,
    coerce_numeric,
    direction,
    flag_at_least,
    minmax_scale,
    pct_change,
    replace_chain,
    rint_dp,
    round_ratio,
    rounded_mean,
    traffic_light,
    upheld_band,
)


def one_col(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {typ}")


def test_coerce_numeric_matches_lenient_spreadsheet_reading(spark):
    vals = ["12", " 12 ", "1.5", ".5", "1e3", "-3", "1,234", "12%", "*", "1d", "1f", "NaN", "inf", "", None, "abc"]
    got = [r[0] for r in one_col(spark, vals).select(coerce_numeric("x")).collect()]
    assert got == [12.0, 12.0, 1.5, 0.5, 1000.0, -3.0, None, None, None, None, None, None, None, None, None, None]


def test_round_ratio_is_half_away_and_exact(spark):
    df = spark.createDataFrame([(1, 8), (-1, 8), (3, 8), (5, 40), (7, 0), (None, 3)], "n bigint, d bigint")
    got = [r[0] for r in df.select(round_ratio("n", "d", dp=2)).collect()]
    # 0.125 -> 0.13, -0.125 -> -0.13, 0.375 -> 0.38, 0.125 -> 0.13, /0 -> null, null -> null
    assert got == [0.13, -0.13, 0.38, 0.13, None, None]


def test_pct_change_null_on_zero_base(spark):
    df = spark.createDataFrame([(110, 100), (5, 0), (90, 100)], "a bigint, b bigint")
    assert [r[0] for r in df.select(pct_change("a", "b")).collect()] == [10.0, None, -10.0]


def test_rounded_mean_of_tenths_avoids_float_ties(spark):
    # mean of 52.2 and 52.3 is 52.25 exactly; ROUND(.., 1) half away -> 52.3
    df = spark.createDataFrame([(522,), (523,)], "t bigint")
    assert df.agg(rounded_mean("t", unit=10, dp=1)).first()[0] == 52.3


def test_rint_dp_is_half_even(spark):
    df = one_col(spark, [52.25, 52.35, 0.05, -2.25], "double")
    got = [r[0] for r in df.select(rint_dp("x", 1)).collect()]
    assert got == [52.2, 52.4, 0.0, -2.2]


def test_classifier_first_rule_wins_and_literal_keywords(spark):
    names = [
        "Lloyds Bank General Insurance Limited",  # bank keyword wins over insurer
        "LV= Liverpool Victoria",  # literal '=' keyword
        "National Westminster Bank Plc",  # no keyword
        "Marks & Spencer Financial Services",
        "Scottish Widows Limited",
        "Capital One (Europe) plc",
        None,
    ]
    got = [r[0] for r in one_col(spark, names).select(classify("x")).collect()]
    assert got == [
        "Retail Bank / Building Society",
        "General Insurance",
        "Other Financial Services",
        "Retail Bank / Building Society",
        "Life & Pensions",
        "Credit Card / Consumer Finance",
        "Other Financial Services",
    ]


def test_upheld_band_edges_and_unknown(spark):
    df = one_col(spark, [70.0, 69.9, 50.0, 35.0, 34.9, None], "double")
    got = [r[0] for r in df.select(upheld_band("x")).collect()]
    assert got == ["Very High (70%+)", "High (50-70%)", "High (50-70%)", "Moderate (35-50%)", "Lower (<35%)", "Unknown"]


def test_flag_traffic_light_direction(spark):
    df = one_col(spark, [50.0, 49.9, 35.0, None], "double")
    rows = df.select(flag_at_least("x"), traffic_light("x"), direction(F.col("x") - 49.9)).collect()
    assert [r[0] for r in rows] == [1, 0, 0, 0]
    assert [r[1] for r in rows] == ["red", "amber", "amber", "green"]
    assert [r[2] for r in rows][:2] == ["▲", "▬"]


def test_band_strict_and_null_label(spark):
    df = one_col(spark, [5.0, 5.1, None], "double")
    got = [r[0] for r in df.select(band("x", [(5, "big")], "small", strict=True)).collect()]
    assert got == ["small", "big", "small"]


def test_clip_keeps_null_and_minmax_constant(spark):
    df = one_col(spark, [1.0, 5.0, 10.0, None], "double")
    got = [r[0] for r in df.select(clip("x", F.lit(2.0), F.lit(8.0))).collect()]
    assert got == [2.0, 5.0, 8.0, None]
    scaled = [r[0] for r in df.select(minmax_scale("x", F.lit(3.0), F.lit(3.0))).collect()]
    assert scaled == [0.0, 0.0, 0.0, None]


def test_replace_chain_shortens_names(spark):
    got = one_col(spark, ["Acme Insurance Services Limited"]).select(replace_chain("x")).first()[0]
    assert got == "Acme Ins. Svcs"
    assert K.SHORT_NAME_REPLACEMENTS[0] == (" Limited", "")


def test_round_ratio_equals_rational_rounding(spark):
    """Property: round_ratio == round-half-away of the exact fraction, for many integer pairs."""
    from fractions import Fraction

    from hypothesis import given, settings
    from hypothesis import strategies as st

    def expected(n, d, dp, scale):
        q = Fraction(n * scale * 10**dp, d)
        mag = (abs(q.numerator) * 2 + abs(q.denominator)) // (2 * abs(q.denominator))
        return (mag if q >= 0 else -mag) / 10**dp

    pairs = st.lists(st.tuples(st.integers(-10**12, 10**12), st.integers(-10**6, 10**6).filter(lambda d: d != 0)),
                     min_size=1, max_size=200)

    @settings(max_examples=5, deadline=None)
    @given(pairs, st.sampled_from([0, 1, 2]), st.sampled_from([1, 100]))
    def check(rows, dp, scale):
        df = spark.createDataFrame(rows, "n bigint, d bigint")
        got = [r[0] for r in df.select(round_ratio("n", "d", dp=dp, scale=scale)).collect()]
        assert got == [expected(n, d, dp, scale) for n, d in rows]

    check()


def test_classify_by_one_pattern_equals_contains(spark, monkeypatch):
    from riskloom.functions import rules as RU

    rules = [("lv", ["lv="]), ("ab", ["bcd", "a.c"]), ("cd", ["cd", "M&S (x)"]), ("b", ["b", "cd"]), ("w", ["über", "\\q$"])]
    texts = [None, "", "abcd", "xcdx", "a.c cd", "abc", "LV=b", "m&s (X)", "ÜBER", "\\q$", "ccd b", "line\nbcd", "none"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for some in (rules, [*rules, ("all", [""])], [("none", [])]):
        monkeypatch.setattr(RU, "PATTERN_FROM", 10**6)
        plain = RU.classify("x", some, "other")
        monkeypatch.setattr(RU, "PATTERN_FROM", 0)
        rows = df.select("x", plain.alias("want"), RU.classify("x", some, "other").alias("got")).collect()
        assert [r.got for r in rows] == [r.want for r in rows]
