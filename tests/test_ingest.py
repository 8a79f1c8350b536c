"""Ingest operators on hand-made sheets: header drift, suppression markers, padded names, null
groups, missing optional sheets, duplicate keys, sheet resolution by keyword."""

import pytest
from pyspark.sql import functions as F

from riskloom import contract as K
from riskloom.operators.reshape import keep_first, keep_first_placed, melt_measure, pivot_measure
from riskloom.plans import master as M
from riskloom.sources import sheets as SH

CATS = ["Banking & Credit Cards", "Home Finance"]


def sheet(spark, header, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in header))


def test_harmonise_columns_rules_and_duplicates(spark):
    df = sheet(spark, [" Firm Name ", "Group Name", "Banking and credit cards", "Insurance & pure protection",
                       "Investments (all)", "Decumulation, pensions", "Home finance", "Other"], [])
    assert SH.harmonise_columns(df).columns == [
        "firm_name", "group", "Banking & Credit Cards", "Insurance & Pure Protection", "Investments",
        "Decumulation & Pensions", "Home Finance", "Other",
    ]
    with pytest.raises(ValueError):
        SH.harmonise_columns(sheet(spark, ["Firm Name", "firm_name"], []))


def test_melt_measure_coerces_and_drops_missing(spark):
    df = sheet(spark, ["firm_name", "group", *CATS, "Ignored"],
               [("A", "G", "1,234", "7", "x"), ("B", None, "*", "12%", "y"), ("C", "G", "3", "", "z")])
    long = melt_measure(df, "v", categories=CATS)
    got = sorted((r.firm_name, r.product_category, r.v) for r in long.collect())
    assert got == [("A", "Home Finance", 7.0), ("C", "Banking & Credit Cards", 3.0)]
    assert melt_measure(df.drop("firm_name"), "v", categories=CATS) is None
    assert melt_measure(df.select("firm_name", "group"), "v", categories=CATS) is None


def _manifest(spark):
    return SH.manifest_df(spark)


def test_assemble_trims_both_sides_and_keeps_optional_measures(spark):
    opened = sheet(spark, ["source", "Firm Name", "Group", *CATS],
                   [("H1 2022", " Monzo Bank ", "", "100", "20"), ("H1 2022", "Hastings Direct", None, "50", "*"),
                    ("H2 2023", "nan", "", "5", "5"), ("H2 2023", "  ", "", "5", "5")])
    upheld = sheet(spark, ["source", "firm_name", "group", *CATS],
                   [("H1 2022", "Monzo Bank  ", "", "0.5225", "0.1"), ("H1 2022", "Hastings Direct", None, "0.3", "0.2")])
    long = SH.melt_sheets({"opened": opened, "upheld": upheld, "closed": None}, categories=CATS,
                          ids=("source", "firm_name", "group"))
    out = SH.assemble_measures(long, _manifest(spark))
    rows = {(r.firm_name, r.product_category): r for r in out.collect()}
    assert set(rows) == {("Monzo Bank", CATS[0]), ("Monzo Bank", CATS[1]), ("Hastings Direct", CATS[0])}
    a = rows[("Monzo Bank", CATS[0])]
    assert a.upheld_pct == 52.2 and a.upheld_tenths == 522  # 52.25 rounds half to even
    assert a.complaints_closed is None and a.pct_closed_3days is None
    assert a.firm_type == "Retail Bank / Building Society" and a.pre_post_duty == "Pre-Duty"
    h = rows[("Hastings Direct", CATS[0])]
    assert h.firm_group == "" and h.upheld_pct == 30.0  # null group matched null-safely
    assert h.firm_type == "General Insurance"
    assert out.columns[:3] == ["firm_name", K.GROUP, K.CAT]


def test_assemble_requires_opened(spark):
    closed = sheet(spark, ["source", "firm_name", *CATS], [("H1 2022", "A", "1", "2")])
    with pytest.raises(ValueError):
        SH.melt_sheets({"closed": closed}, categories=CATS)


def test_resolve_sheets_first_match_in_file_order(spark):
    catalog = spark.createDataFrame(
        [("f1", "Closed in 3 days", 0), ("f1", "Opened", 1), ("f1", "Closed", 2), ("f1", "% Upheld", 3),
         ("f2", "open complaints", 0), ("f2", "closed", 1)],
        "source string, sheet_name string, sheet_pos int",
    )
    got = {(r.source, r.measure): r.sheet_name for r in SH.resolve_sheets(catalog).collect()}
    # the 'closed' keyword also matches the 3-day sheet when it comes first (kept as in the original)
    assert got[("f1", "closed")] == "Closed in 3 days"
    assert got[("f1", "threeday")] == "Closed in 3 days"
    assert got[("f1", "opened")] == "Opened" and got[("f1", "upheld")] == "% Upheld"
    assert got[("f2", "opened")] == "open complaints" and ("f2", "upheld") not in got


def test_keep_first_by_input_position_and_skew(spark):
    rows = [("k", 3, "c"), ("k", 1, "b"), ("k", 1, "a"), ("j", 2, "z")] + [("hot", i, str(i)) for i in range(500, 0, -1)]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "key string, o int, v string, pos bigint")
    got = {r.key: (r.o, r.v) for r in keep_first(df, ["key"], ["o", "pos"]).collect()}
    assert got == {"k": (1, "b"), "j": (2, "z"), "hot": (1, "1")}


def test_keep_first_placed_equals_keep_first(spark):
    """Null keys, a hot key, the extreme places of a bigint, an int before the place that decides first, clashing names."""
    far = 2**63 - 1
    rows = [(None, 1, 5, "a"), (None, 1, 4, "b"), ("k", 2, -far, "c"), ("k", 1, far, "d"), ("k", 1, far - 1, "e"), ("n", -3, 7, "f"), ("n", -2, -9, "g")]
    rows += [("hot", i % 3, i, str(i)) for i in range(3000, 0, -1)]
    df = spark.createDataFrame(rows, "key string, o int, pos bigint, n string").repartition(5)
    got = keep_first_placed(df, ["key"], ["o", "pos"])
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, keep_first(df, ["key"], ["o", "pos"]).collect()))
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and "HashAggregate" in text
    assert keep_first_placed(df.limit(0), ["key"], ["o", "pos"]).collect() == []
    with pytest.raises(ValueError):
        keep_first_placed(df, ["key"], ["n"])


def test_master_keeps_the_first_of_duplicate_rows(spark):
    opened = sheet(spark, ["Firm Name", "Group", *CATS], [("Beta", "Z", "500", "1"), ("Beta", "A", "7", "2"), ("Beta", "Z", "9", "3")])
    closed = sheet(spark, ["Firm Name", "Group", *CATS], [("Beta", "A", "6", "2"), ("Beta", "Z", "499", "1"), ("Beta", "Z", "8", "3")])
    long = SH.stack_sheets({"H1 2022": {"opened": opened, "closed": closed}}, CATS)
    rows = {r.product_category: r for r in M.master_changes(SH.assemble_measures(long, _manifest(spark))).collect()}
    assert (rows[CATS[0]].complaints_opened, rows[CATS[0]].firm_group, rows[CATS[0]].complaints_closed) == (500, "Z", 499.0)
    assert rows[CATS[1]].complaints_opened == 1


def test_shared_keys_are_chosen_for_each_period(spark):
    with_group, without = ["Firm Name", "Group", *CATS], ["Firm Name", *CATS]
    opened = sheet(spark, with_group, [("A", "G", "10", "1"), ("A", "H", "20", "2")])
    long = SH.stack_sheets({
        "H1 2022": {"opened": opened, "closed": sheet(spark, without, [("A", "5", "4")])},
        "H2 2022": {"opened": opened, "closed": sheet(spark, with_group, [("A", "H", "6", "*")])},
        "H1 2023": {"opened": sheet(spark, without, [("A", "3", "3")]), "closed": sheet(spark, with_group, [("A", "G", "1", "1")])},
    }, CATS)
    got = {(r.period_label, r.firm_group, r.product_category): r.complaints_closed
           for r in SH.assemble_measures(long, _manifest(spark)).collect()}
    assert got == {
        ("H1 2022", "G", CATS[0]): 5.0, ("H1 2022", "G", CATS[1]): 4.0, ("H1 2022", "H", CATS[0]): 5.0, ("H1 2022", "H", CATS[1]): 4.0,
        ("H2 2022", "G", CATS[0]): None, ("H2 2022", "G", CATS[1]): None, ("H2 2022", "H", CATS[0]): 6.0, ("H2 2022", "H", CATS[1]): None,
        ("H1 2023", "", CATS[0]): None, ("H1 2023", "", CATS[1]): None,
    }


def test_assembly_is_one_hash_aggregate_shuffle(spark):
    opened = sheet(spark, ["Firm Name", "Group", *CATS], [("A", "G", "10", "1")])
    long = SH.melt_sheets({"opened": opened.withColumn("source", F.lit("H1 2022")), "closed": opened.withColumn("source", F.lit("H1 2022"))},
                          categories=CATS, ids=("source", "firm_name", "group"))
    plan = SH.assemble_measures(long, _manifest(spark))._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan


def test_unusable_sheets_are_reported(spark):
    opened = sheet(spark, ["Firm Name", *CATS], [("A", "1", "2")])
    with pytest.warns(UserWarning, match="without firm or category"):
        SH.stack_sheets({"H1 2022": {"opened": opened, "closed": sheet(spark, ["Nobody", *CATS], [])}}, CATS)
    with pytest.warns(UserWarning, match="without a usable opened sheet"):
        SH.stack_sheets({"H1 2022": {"opened": opened}, "H2 2022": {"closed": opened}}, CATS)


def test_sheet_positions_need_an_order():
    assert SH.sheet_positions(["10 Closed", "2_Opened"], None) == [("Closed", 10), ("Opened", 2)]
    assert SH.sheet_positions(["b", "a"], ["a", "x", "b"]) == [("b", 2), ("a", 0)]
    assert SH.sheet_positions(["Opened"], None) == [("Opened", 0)]
    for names, order in ((["Opened", "Closed"], None), (["a", "b"], ["a"])):
        with pytest.raises(ValueError):
            SH.sheet_positions(names, order)


def test_pivot_then_unpivot_roundtrip(spark, small_fact):
    labels = [r[0] for r in small_fact.select("period_label", "period_order").distinct().orderBy("period_order").collect()]
    wide = pivot_measure(small_fact, ["firm_name", "product_category"], "period_label", labels, "complaints_opened", agg="first")
    back = wide.unpivot(["firm_name", "product_category"], [F.col(f"`{lab}`") for lab in labels], "period_label", "v").filter(
        F.col("v").isNotNull()
    )
    a = small_fact.select("firm_name", "product_category", "period_label", F.col("complaints_opened").alias("v"))
    assert back.exceptAll(a).count() == 0 and a.exceptAll(back).count() == 0


def test_missing_optional_sheets_leave_measures_null(spark):
    opened = sheet(spark, ["source", "Firm Name", *CATS], [("H2 2023", "Tesco Bank", "40", "2")])
    upheld = sheet(spark, ["source", "firm_name", *CATS], [("H2 2023", "Tesco Bank", "0.25", "0.5")])
    long = SH.melt_sheets({"opened": opened, "upheld": upheld}, categories=CATS, ids=("source", "firm_name", "group"))
    rows = {r.product_category: r for r in SH.assemble_measures(long, _manifest(spark)).collect()}
    assert rows[CATS[0]].upheld_pct == 25.0 and rows[CATS[1]].upheld_pct == 50.0
    assert rows[CATS[0]].firm_group == "" and rows[CATS[0]].complaints_closed is None
    assert rows[CATS[0]].pct_closed_3days is None and rows[CATS[0]].pre_post_duty == "Post-Duty"
