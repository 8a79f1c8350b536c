"""Shared checkpoint folder and materialisation."""

import os

from riskloom.session import checkpoint_dir, materialise, scratch_path


def test_checkpoint_dir_comes_from_the_session(spark):
    d = checkpoint_dir(spark)
    assert d and spark.sparkContext.getCheckpointDir() == d
    assert scratch_path(spark, "x").startswith(d)


def test_materialise_writes_under_the_checkpoint_folder(spark):
    df = spark.range(0, 1000, 1, 4).selectExpr("id", "id % 7 AS g")
    stored = materialise(df, "unit")
    assert sorted(stored.collect()) == sorted(df.collect())
    paths = [p for p in stored.inputFiles()]
    base = checkpoint_dir(spark).replace("file:", "")
    assert paths and all(base in p for p in paths)
    assert all(os.path.basename(os.path.dirname(p.replace("file:", ""))).startswith("unit-") for p in paths)


def test_stored_tables_can_be_dropped(spark):
    import os

    from riskloom import session as S

    kept = S._STORED[:]
    S._STORED.clear()
    df = S.materialise(spark.range(5))
    path = S._STORED[0].removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(path)
    assert S.drop_stored(spark) == 1 and not os.path.exists(path) and not S._STORED
    S._STORED.extend(kept)
