"""Named queries and the master on hand-made facts: the quirks and edge values of SURVEY §5."""

from pyspark.sql import functions as F

from riskloom import contract as K
from riskloom.plans import master as M
from riskloom.plans import named_queries as Q
from riskloom.plans import notebook as N
from riskloom.plans import risk as R
from tests.conftest import fact_rows


def test_master_changes_gap_zero_prev_and_bands(spark):
    fact = fact_rows(spark, [
        ("A", "T", "c1", 1, 0, 700),
        ("A", "T", "c1", 2, 10, 500),
        ("A", "T", "c1", 4, 15, 350),  # gap: compares with order 2
        ("A", "T", "c2", 1, 8, None),
        ("B", "T", "c1", 5, 3, 349),
    ])
    rows = {(r.firm_name, r.product_category, r.period_order): r for r in M.master_changes(fact).collect()}
    assert [rows[k].record_id for k in sorted(rows)] == [1, 2, 3, 4, 5]
    assert rows[("A", "c1", 2)].complaints_change_pct is None  # previous volume 0
    assert rows[("A", "c1", 4)].complaints_change_abs == 5.0 and rows[("A", "c1", 4)].complaints_change_pct == 50.0
    assert rows[("A", "c1", 4)].upheld_change_ppts == -15.0
    assert [rows[("A", "c1", o)].upheld_band for o in (1, 2, 4)] == ["Very High (70%+)", "High (50-70%)", "Moderate (35-50%)"]
    assert rows[("A", "c2", 1)].upheld_band == "Unknown" and rows[("A", "c2", 1)].high_uphold_flag == 0
    assert rows[("B", "c1", 5)].upheld_band == "Lower (<35%)"


def test_c2_reference_mode_uses_text_order_of_labels(spark):
    # H2 2022 -> H1 2024: text MAX of labels is 'H2 2023' (beats 'H1 2024'), MIN of prev 'H1 2023'...
    fact = fact_rows(spark, [("A", "T", "c", 2, 100, 300), ("A", "T", "c", 4, 100, 400), ("A", "T", "c", 5, 100, 600)])
    ref = Q.c2_rising_upheld(fact).first()
    chrono = Q.c2_rising_upheld(fact, mode="chronological").first()
    assert (ref.earliest_period, ref.latest_period) == ("H2 2022", "H2 2023")
    assert (chrono.earliest_period, chrono.latest_period) == ("H2 2022", "H1 2024")
    assert ref.total_change_ppts == 30.0 and ref.avg_change_per_period == 15.0
    assert ref.trend_verdict == K.C2_VERDICTS[0]


def test_c4_exact_boundaries(spark):
    fact = fact_rows(spark, [
        ("zero", "T", "c", 1, 10, 400), ("zero", "T", "c", 4, 10, 400),
        ("minus5", "T", "c", 1, 10, 450), ("minus5", "T", "c", 4, 10, 400),
        ("plus5", "T", "c", 1, 10, 400), ("plus5", "T", "c", 4, 10, 450),
        ("pre_only", "T", "c", 1, 10, 400),
    ])
    got = {r.firm_name: r.consumer_duty_response for r in Q.c4_pre_post(fact).collect()}
    assert got == {"zero": K.C4_RESPONSES[2], "minus5": K.C4_RESPONSES[3], "plus5": K.C4_RESPONSES[1]}


def test_a3_growth_and_flags(spark):
    fact = fact_rows(spark, [
        ("up", "T", "c", 1, 600, 1), ("up", "T", "c", 5, 900, 1),
        ("down", "T", "c", 1, 600, 1), ("down", "T", "c", 2, 300, 1),
        ("small", "T", "c", 1, 10, 1), ("small", "T", "c", 5, 900, 1),
        ("single", "T", "c", 1, 900, 1),
    ])
    got = {r.firm_name: (r.growth_pct, r.trend_flag) for r in Q.a3_fastest_growing(fact).collect()}
    assert got == {"up": (50.0, K.A3_FLAGS[0]), "down": (-50.0, K.A3_FLAGS[2])}


def test_quartiles_with_fewer_than_four_firms(spark):
    fact = fact_rows(spark, [("a", "T", "c", 1, 2000, 100), ("b", "T", "c", 1, 3000, 200), ("c", "T", "c", 1, 4000, 300)])
    got = {r.firm_name: (r.volume_quartile, r.uphold_quartile) for r in Q.c3_danger_quadrant(fact).collect()}
    assert got == {"a": (1, 1), "b": (2, 2), "c": (3, 3)}


def test_pivot_upheld_drops_all_missing_firm_and_rounds_half_even(spark):
    fact = fact_rows(spark, [("a", "T", "c1", 1, 5, 522), ("a", "T", "c2", 1, 5, 523), ("b", "T", "c1", 1, 5, None)])
    rows = M.pivot_upheld(fact, ["H1 2022"]).collect()
    assert [(r.firm_name, r["H1 2022"]) for r in rows] == [("a", 52.2)]


def test_risk_index_bounds_and_constant_columns(spark):
    rows = []
    for i in range(12):
        rows += [(f"f{i:02d}", "T", "c", 1, 1000 + 100 * i, 300 + 10 * i), (f"f{i:02d}", "T", "c", 2, 1000, 300 + 5 * i)]
    ri = R.risk_index(fact_rows(spark, rows), min_total=1000)
    stats = ri.agg(F.min("risk_index"), F.max("risk_index"), F.count("*")).first()
    assert 0.0 <= stats[0] <= stats[1] <= 100.0 and stats[2] == 12
    top = R.risk_table(ri, 3).collect()
    assert [r.firm_name for r in top][0] == "f11"


def test_median_quadrant_strictly_above(spark):
    rows = [(f, "T", "c", 1, v, t) for f, v, t in [("a", 2000, 300), ("b", 3000, 400), ("c", 4000, 500), ("d", 5000, 600)]]
    got = {r.firm_name: r.in_danger for r in N.n6_median_quadrant(fact_rows(spark, rows)).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 1}


def test_c2_boundary_exactly_ten_points_is_moderate(spark):
    fact = fact_rows(spark, [("ten", "T", "c", 1, 100, 300), ("ten", "T", "c", 2, 100, 400),
                             ("five", "T", "c", 1, 100, 300), ("five", "T", "c", 2, 100, 350)])
    got = {r.firm_name: r.trend_verdict for r in Q.c2_rising_upheld(fact).collect()}
    assert got == {"ten": K.C2_VERDICTS[1], "five": K.C2_VERDICTS[2]}


def test_results_invariant_under_partitioning_and_input_order(spark, small_fact):
    ref = sorted(Q.c3_danger_quadrant(small_fact).collect())
    shuffled = small_fact.repartition(13, "period_label").orderBy(F.rand(7))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = sorted(Q.c3_danger_quadrant(shuffled).collect())
        master_a = M.master_changes(shuffled).select("record_id", "firm_name", "product_category", "period_order")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    master_b = M.master_changes(small_fact).select("record_id", "firm_name", "product_category", "period_order")
    assert ref == again
    assert master_a.exceptAll(master_b).count() == 0


def test_danger_quadrant_methods(spark):
    rows = [(f"f{i}", "T", "c", 1, 2000 + 500 * i, 300 + 20 * i) for i in range(8)]
    fact = fact_rows(spark, rows)
    quart = {r.firm_name for r in R.danger_quadrant(fact, method="quartile").collect()}
    med = {r.firm_name for r in R.danger_quadrant(fact, method="median").collect()}
    assert quart == {"f6", "f7"} and med == {"f4", "f5", "f6", "f7"}
