"""Scalable ranking equals the single-partition window functions it replaces."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators.ranking import global_rank, global_row_number, ntile, ntile_of, rank_within_top, row_number_by_entity
from riskloom.operators.slices import SortKey, sort_key


def test_ntile_formula_matches_sql_for_small_n(spark):
    rows = [(n, k) for n in range(1, 40) for k in (1, 3, 4, 7)]
    df = spark.createDataFrame(rows, "n bigint, k int").select(
        "n", "k", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("rn")
    )
    for k in (1, 3, 4, 7):
        sub = df.filter(F.col("k") == k)
        expected = sub.withColumn("e", F.ntile(k).over(Window.partitionBy("n").orderBy("rn")))
        bad = expected.filter(F.col("e") != ntile_of("rn", "n", k)).count()
        assert bad == 0, k


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 10**6)), min_size=1, max_size=60, unique_by=lambda t: t[1]))
def test_scalable_ntile_equals_window_ntile(spark, rows):
    df = spark.createDataFrame(rows, "v int, id int")
    order = [F.asc("v"), F.asc("id")]
    got = ntile(df, 4, order, name="q", num_partitions=3).select("id", "q")
    exp = df.withColumn("q", F.ntile(4).over(Window.orderBy(*order)).cast("bigint")).select("id", "q")
    assert sorted(got.collect()) == sorted(exp.collect())


def test_global_row_number_after_shuffle(spark):
    # input coming out of an aggregation (no fixed row order) must still number consistently
    base = spark.range(0, 20000, 1, 6).select((F.col("id") % 997).alias("g"), "id")
    agg = base.groupBy("g").agg(F.count("*").alias("c"), F.max("id").alias("m"))
    got = global_row_number(agg, [F.desc("c"), F.asc("g")], name="rn", total_name="n", num_partitions=5)
    exp = agg.withColumn("e", F.row_number().over(Window.orderBy(F.desc("c"), F.asc("g"))))
    joined = got.join(exp.select("g", "e"), "g")
    assert joined.filter(F.col("rn") != F.col("e")).count() == 0
    assert joined.select(F.max("n")).first()[0] == 997


def test_global_rank_shares_ranks_on_ties(spark):
    df = spark.createDataFrame([("a", 5), ("b", 7), ("c", 5), ("d", 1), ("e", 7)], "k string, v int")
    got = {r.k: r.rank for r in global_rank(df, ["v"], descending=True, tiebreak=["k"], num_partitions=2).collect()}
    assert got == {"b": 1, "e": 1, "a": 3, "c": 3, "d": 5}


def test_rank_within_top_equals_global_rank(spark):
    df = spark.createDataFrame([(f"f{i}", (i * 37) % 11) for i in range(40)], "firm string, total int")
    top = rank_within_top(df, 10, "total", ["firm"], "r").collect()
    full = {r.firm: r.r for r in df.withColumn("r", F.rank().over(Window.orderBy(F.desc("total")))).collect()}
    assert len(top) == 10
    assert all(full[r.firm] == r.r for r in top)


def test_grouped_row_number_equals_partitioned_window(spark):
    df = spark.range(0, 3000, 1, 4).select(
        (F.col("id") % 3).cast("string").alias("g"), ((F.col("id") * 7919) % 1013).alias("v"), "id"
    )
    got = global_row_number(df, [F.asc("v"), F.asc("id")], name="rn", total_name="n", num_partitions=7, partition_by=["g"])
    exp = df.withColumn("e", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    joined = got.join(exp.select("id", "e"), "id")
    assert joined.filter(F.col("rn") != F.col("e")).count() == 0
    assert {r.g: r.n for r in got.select("g", "n").distinct().collect()} == {"0": 1000, "1": 1000, "2": 1000}


def test_row_number_with_adaptive_slices(spark):
    # default slice count: AQE may merge neighbouring range slices; numbering must not change
    base = spark.range(0, 5000, 1, 6).select((F.col("id") % 1201).alias("g"), "id")
    agg = base.groupBy("g").agg(F.count("*").alias("c"))
    got = global_row_number(agg, [F.asc("c"), F.asc("g")], name="rn", total_name="n")
    exp = agg.withColumn("e", F.row_number().over(Window.orderBy("c", "g")))
    joined = got.join(exp.select("g", "e"), "g")
    assert joined.filter(F.col("rn") != F.col("e")).count() == 0 and joined.count() == 1201


def test_row_number_by_entity_moves_counts_only(spark):
    df = spark.range(0, 4000, 1, 5).select((F.col("id") * 7 % 331).cast("string").alias("firm"), ((F.col("id") * 7919) % 4001).alias("v"))
    counts = df.groupBy("firm").agg(F.count("*").alias("n"))
    got = row_number_by_entity(df, "firm", ["v"], counts, num_partitions=6)
    exp = df.withColumn("e", F.row_number().over(Window.orderBy("firm", "v")))
    assert got.join(exp, ["firm", "v"]).filter(F.col("rn") == F.col("e")).count() == 4000


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, "a", "B", "é", "zz", ""]), st.sampled_from([None, -1.5, 0.0, 2.0]), st.integers(0, 10**6)),
                max_size=50, unique_by=lambda t: t[2]), st.integers(1, 40))
def test_slices_are_in_order_with_nulls_and_directions(spark, rows, slices):
    df = spark.createDataFrame(rows, "s string, x double, id int").repartition(3)
    order = ["s DESC", "x", SortKey("id", True)]
    got = global_row_number(df, order, total_name="n", num_partitions=slices).collect()
    exp = df.withColumn("e", F.row_number().over(Window.orderBy(F.desc("s"), F.asc("x"), F.desc("id")))).collect()
    assert {r.id: r.rn for r in got} == {r.id: r.e for r in exp}
    assert all(r.n == len(rows) for r in got)


def test_slices_are_balanced_and_nothing_is_stored(spark):
    from riskloom import session
    from riskloom.operators.slices import boundaries, slice_of

    df = spark.range(0, 50_000, 1, 8).select((F.col("id") % 3).alias("hot"), F.xxhash64("id").alias("u"), "id")
    keys = [sort_key("hot"), sort_key("u"), sort_key("id")]
    bounds = boundaries(df, keys, 20)
    sizes = [r["count"] for r in df.groupBy(slice_of(df, keys, bounds).alias("s")).count().collect()]
    assert len(bounds) == 19 and len(sizes) == 20 and max(sizes) < 2 * 2500
    stored = len(session._STORED)
    plan = global_row_number(df, ["hot", "u", "id"])._jdf.queryExecution().executedPlan().toString()
    assert len(session._STORED) == stored and "rangepartitioning" not in plan and "SinglePartition" not in plan


def test_sort_keys():
    assert sort_key(F.desc("c")) == sort_key("c DESC") == SortKey("c", True)
    assert sort_key(F.asc("c")) == sort_key("c") == sort_key(F.col("c")) == SortKey("c")
