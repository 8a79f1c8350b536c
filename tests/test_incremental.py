"""Loads by period, firm state, sets of tables committed together, sketches, and quantiles by narrowing."""

import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from riskloom import contract as K
from riskloom.operators.stats import multi_quantiles, quantiles
from riskloom.plans import incremental as IN
from riskloom.plans import master as M
from riskloom.plans import risk as R
from riskloom.plans import sketches as SX
from riskloom.sources import sinks as SK
from tests.conftest import fact_rows

FIRMS = ["a", "b", "c", "d", "e"]


def made_rows(seed, periods=5):
    """Rows with gaps: a firm and category miss some periods, so the row after can lie in any later one."""
    r = random.Random(seed)
    return [
        (f, "t", c, o, r.randint(0, 9), r.choice([None, r.randint(0, 1000)]))
        for f in FIRMS for c in ("x", "y") for o in range(1, periods + 1) if r.random() < 0.6
    ]


def listed(df):
    return sorted(map(str, df.select(*M.MASTER_OUT).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_periods_gives_the_full_build(spark, seed):
    rows = made_rows(seed)
    fact = fact_rows(spark, rows).cache()
    path = tempfile.mkdtemp(prefix="riskloom-inc-") + "/m"
    for o in random.Random(seed).sample(range(1, 6), 5):
        IN.load_periods(spark, path, fact.filter(F.col(K.ORDER) == o))
    assert listed(IN.read_loaded(spark, path)) == listed(M.master_changes(fact))


def test_restated_and_emptied_periods(spark):
    rows = made_rows(3)
    path = tempfile.mkdtemp(prefix="riskloom-inc-") + "/m"
    IN.load_periods(spark, path, fact_rows(spark, rows))
    new = [x for x in made_rows(4) if x[3] == 2]
    rows = [x for x in rows if x[3] != 2] + new
    written = IN.load_periods(spark, path, fact_rows(spark, new))
    assert 2 in written and 1 not in written
    assert listed(IN.read_loaded(spark, path)) == listed(M.master_changes(fact_rows(spark, rows)))
    rows = [x for x in rows if x[3] != 3]
    IN.load_periods(spark, path, fact_rows(spark, new).filter("false"), orders=[3])
    assert listed(IN.read_loaded(spark, path)) == listed(M.master_changes(fact_rows(spark, rows)))


def test_a_load_of_the_last_period_writes_one_period(spark):
    fact = fact_rows(spark, made_rows(5)).cache()
    path = tempfile.mkdtemp(prefix="riskloom-inc-") + "/m"
    IN.load_periods(spark, path, fact.filter(F.col(K.ORDER) < 5))
    assert IN.load_periods(spark, path, fact.filter(F.col(K.ORDER) == 5)) == [5]


def test_a_first_load_stores_its_rows_aside_once_and_writes_few_files(spark, monkeypatch):
    """The batch is not stored before, its rows are not dealt anew, and a period still has few files."""
    stored, make = [], IN.stored_path
    monkeypatch.setattr(IN, "materialise", lambda df, name: pytest.fail(name))
    monkeypatch.setattr(IN, "stored_path", lambda s, n: stored.append(n) or make(s, n))
    path = tempfile.mkdtemp(prefix="riskloom-inc-") + "/m"
    assert IN.load_periods(spark, path, fact_rows(spark, made_rows(8))) == [1, 2, 3, 4, 5]
    assert stored == ["load"]
    files = [f.split(f"{K.ORDER}=")[1].split("/")[0] for f in spark.read.parquet(path).inputFiles()]
    assert max(map(files.count, files)) <= IN.FILES


def test_hot_firms_and_null_names_number_alike(spark, monkeypatch):
    """Duplicates of a hot firm are reduced before they move, with the same rows and record ids; null firms come first."""
    rows = made_rows(9)
    fact = fact_rows(spark, [*rows, *rows[:20], (None, "t", "x", 1, 3, 5), (None, "t", "x", 2, 4, 5)])
    want = listed(M.master_changes(fact))
    monkeypatch.setattr(M, "HOT_FIRM", 1)
    assert want == listed(M.master_changes(fact))
    got = M.master_changes(fact).orderBy(F.asc_nulls_first(K.FIRM), K.CAT, K.ORDER).select("record_id", K.FIRM).collect()
    assert [r.record_id for r in got] == list(range(1, len(rows) + 3)) and got[0][K.FIRM] is None


def test_parts_of_a_load_follow_its_rows(spark, monkeypatch):
    """Rows of a load are reduced in parts of bounded size, however few shuffle partitions there are."""
    fact = fact_rows(spark, [*made_rows(4), *made_rows(4)[:9], (None, "t", "x", 1, 3, 5)]).cache()
    want = listed(M.master_changes(fact))
    monkeypatch.setattr(M, "SLICE_ROWS", 2)
    assert M.first_rows(fact).rdd.getNumPartitions() > 8
    path = tempfile.mkdtemp(prefix="riskloom-inc-") + "/m"
    IN.load_periods(spark, path, fact)
    assert listed(IN.read_loaded(spark, path)) == listed(M.master_changes(fact)) == want


def test_state_by_period_equals_the_scan(spark):
    fact = fact_rows(spark, [(*x[:4], x[4] + 1, x[5]) for x in made_rows(6)]).cache()
    path = tempfile.mkdtemp(prefix="riskloom-inc-") + "/s"
    IN.load_state(spark, path, fact.withColumn(K.OPENED, F.col(K.OPENED) * 3))
    for o in (4, 1, 5, 3, 2):
        IN.load_state(spark, path, fact.filter(F.col(K.ORDER) == o))
    want = sorted(map(str, R.risk_index(fact, min_total=0).collect()))
    assert want and sorted(map(str, IN.risk_index_from_state(spark, path, min_total=0).collect())) == want


def test_a_failing_set_leaves_the_old_one(spark):
    base = tempfile.mkdtemp(prefix="riskloom-set-") + "/out"
    with pytest.raises(FileNotFoundError):
        SK.read_set(spark, base)
    one, two = spark.range(3), spark.range(5)
    SK.commit_set({"p": one, "q": one}, base, spark)
    old = SK.read_set(spark, base)
    fails = spark.range(2).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        SK.commit_set({"p": two, "q": fails}, base, spark)
    assert [SK.read_set(spark, base)[t].count() for t in "pq"] == [3, 3]
    SK.commit_set({"p": two, "q": two}, base, spark)
    assert [SK.read_set(spark, base)[t].count() for t in "pq"] == [5, 5]
    assert [old[t].count() for t in "pq"] == [3, 3]  # an open reader keeps its set
    assert SK.drop_old_sets(spark, base) == 2
    assert SK.read_set(spark, base)["q"].count() == 5


def test_outputs_go_on_behind_a_failure(spark):
    base = tempfile.mkdtemp(prefix="riskloom-out-")
    bad = lambda: spark.range(2).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(SK.OutputErrors, match="second") as e:
        SK.run_queries({"first": lambda: spark.range(2), "second": bad, "third": lambda: spark.range(4)}, base)
    assert list(e.value.errors) == ["second"]
    assert spark.read.option("header", True).csv(f"{base}/third").count() == 4


def test_sketches_merge_within_their_errors(spark):
    r = random.Random(7)
    rows = [(f"f{r.randint(0, 4000)}", "t" if i % 3 else "u", "c", 1 + i % 4, 1, r.randint(0, 1000)) for i in range(20_000)]
    rows += [("g", "v", "c", 1, 1, None)]  # a sector without a rate
    fact = fact_rows(spark, rows).cache()
    mart = SX.sketch_mart(fact).cache()
    got = SX.sketch_audit(mart, fact, [K.TYPE]).collect()
    assert len(got) == 3 and all(x.firms_within and x.quantiles_within for x in got)
    none = {x[K.TYPE]: x.rate_quantiles for x in SX.estimates(SX.roll_up(mart, [K.TYPE])).collect()}
    assert none["v"] is None and len(none["t"]) == 3


def exact(values, p):
    x, pos = sorted(values), (len(values) - 1) * p
    lo, hi = math.floor(pos), math.ceil(pos)
    return x[lo] + (x[hi] - x[lo]) * (pos - lo)


@pytest.mark.parametrize("buckets", [2, 16, 1 << 14])
def test_quantiles_by_narrowing(spark, buckets):
    r = random.Random(8)
    sets = {
        "distinct": [r.random() for _ in range(500)],
        "wide": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(500)],
        "hot": [7.0] * 400 + [r.gauss(0, 1) for _ in range(100)],
        "zeros": [0.0] * 300 + [-0.0] * 100 + [float(i) for i in range(100)],
        "close": [1 + i * 2**-52 for i in range(500)],
    }
    df = spark.createDataFrame(list(zip(*sets.values(), strict=True)), ", ".join(f"{c} double" for c in sets))
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = multi_quantiles(df, list(sets), probs, names=[f"q{i}" for i in range(5)], buckets=buckets).first()
    for c, values in sets.items():
        assert [got[f"{c}__q{i}"] for i in range(5)] == [exact(values, p) for p in probs], c


def test_quantiles_of_nothing_nan_and_infinity(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert quantiles(df, "x", [0.5], names=["m"]).first().m is None
    with pytest.raises(ValueError, match="infinite"):
        quantiles(spark.createDataFrame([(float("inf"),)], "x double"), "x", [0.5])
