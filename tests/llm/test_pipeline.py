"""The pipeline's stages on the small tables, against plain checks of what each may drop or change."""

import pytest

import corpus_pipeline as C
from riskloom.session import materialise
from tests.conftest import SF_SMALL
from tests.llm.test_decontamination import brute as hits
from tests.llm.test_jaccard_join import brute as classes
from tests.llm.test_secrets import base


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for name, stage in C.STAGES:
        out.append(materialise(stage(spark, out[-1], SF_SMALL), name))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_clean_rows(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1])
    assert texts(steps[1]) == texts(steps[0])  # every document of the tables is in a language


def test_one_of_each_group_stays(steps):
    before, after = texts(steps[1]), texts(steps[2])
    ids = sorted(before)
    found = classes([before[i] for i in ids], 5, 80)
    assert sorted(after) == sorted(ids[c] for c in {c for _, c in found})


def test_contaminated_documents_go(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    before = texts(steps[2])
    from riskloom.llm.decontamination import item_windows, normal_words

    windows = {w for _, t in items for w in item_windows((t or "").encode(), 10)}
    dirty = {i for i, t in before.items() if any(w in b" " + b" ".join(normal_words((t or "").encode())) + b" " for w in windows)}
    assert dirty and set(texts(steps[3])) == set(before) - dirty
    some = next(iter(dirty))
    assert hits(before[some], items, 10)[1] > 0


def test_secrets_are_masked(steps):
    before, after = texts(steps[3]), texts(steps[4])
    assert set(before) == set(after)
    for i, t in before.items():
        assert not [s for s in base(after[i] or "")]
        if not base(t or "") and "[secret]" not in (after[i] or ""):
            assert after[i] == t


def test_everything_is_packed_once(spark, steps):
    rows = steps[5].collect()
    assert {r.doc_id for r in rows} == set(texts(steps[4]))
    assert {len(r) for r in rows} == {7}
    assert C.run(spark, SF_SMALL).count() == len(rows)
