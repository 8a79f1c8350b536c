"""Language, toxicity and quality: held-out accuracy on the given tables, brute-force parsing, edge cases."""

import numpy as np
import pytest

from riskloom.llm import langid as L
from riskloom.llm import quality_model as Q
from riskloom.llm import toxicity as X
from riskloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
EDGES = [None, "", "123 ... !!!", "x" * 200_000, "é", "the cat sat " * 3]


def brute_phrases(text, reference):
    """Greedy parse into the longest substrings of the reference, block by block; an unknown character is a phrase."""
    count = 0
    for at in range(0, len(text), L.BLOCK):
        block, i = text[at : at + L.BLOCK], 0
        while i < len(block):
            j = i + 1
            if block[i] in reference:
                while j < len(block) and block[i : j + 1] in reference:
                    j += 1
            i, count = j, count + 1
    return count


def test_parse_matches_brute_force():
    rng = np.random.default_rng(4)
    refs = {"xx": "".join(rng.choice(list("abc d"), 400)) + "\n" + "".join(rng.choice(list("abe"), 100)), "yy": "".join(rng.choice(list("aef "), 300))}
    parser = L.Parser(refs)
    texts = ["".join(rng.choice(list("abcdef z"), n)) for n in (1, 2, 30, 511, 512, 513, 1500)]
    got = parser.phrases([np.array([ord(c) for c in t], np.uint32) for t in texts])
    for t, row in zip(texts, got, strict=True):
        assert row.tolist() == [brute_phrases(t, refs[x]) for x in parser.languages]


def test_automaton_holds_exactly_the_substrings():
    text = "abracadabra"
    moves = L.suffix_automaton(text)
    subs = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}

    def paths(state, prefix):
        for c, to in moves[state].items():
            yield prefix + c
            yield from paths(to, prefix + c)

    assert sorted(paths(0, "")) == sorted(subs)


def test_language_held_out_and_edges(spark, frame):
    got = QUERIES["op4_language_id"](spark, SF).toPandas()
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    m = got.merge(truth, on="doc_id")
    assert len(got) == len(truth) and m.held_out.any() and m.score.between(0, 1).all()
    assert (m.lang_pred == m.lang)[m.held_out].mean() > 0.98
    refs = {"aa": "the cat sat on the mat " * 9, "bb": "der hund lief weg und " * 9}
    found, f = L.identify(frame(EDGES), refs)
    rows = {r.doc_id: r[f] for r in found.collect()}
    assert [rows[i].lang_pred for i in range(3)] == ["und"] * 3 and rows[5].lang_pred == "aa"
    nothing, f = L.identify(frame(["abc"]), {})
    assert nothing.first()[f].lang_pred == "und"
    assert L.identify(frame([]), refs)[0].collect() == []


def test_references_skip_held_out_rows(spark):
    rows = [(i, "alpha beta " * 20, "aa") for i in range(40)] + [(i, "gamma delta " * 20, "bb") for i in range(40, 80)]
    docs = spark.createDataFrame([*rows, (90, None, "cc"), (91, "x", None), (92, "123", "dd")], "doc_id bigint, text string, lang string")
    assert set(L.learn_references(docs)) == {"aa", "bb"}
    fold = docs.where(L.held_out("doc_id", 4, 2))
    import zlib

    assert sorted(r.doc_id for r in fold.collect()) == sorted(i for i in [*range(80), 90, 91, 92] if zlib.crc32(str(i).encode()) % 4 == 2)


@pytest.mark.parametrize("name,label", [("op8_quality_classifier", "quality"), ("op3_toxicity", "toxic")])
def test_labels_held_out(spark, name, label):
    got = QUERIES[name](spark, SF).toPandas()
    m = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    held = m[m.held_out]
    assert (held.predicted == held[label]).mean() > (0.94 if label == "quality" else 0.9)


def test_trees_split_what_is_separable():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, len(Q.STATS)))
    y = ((x[:, 3] > 0.2) ^ (x[:, 7] > -0.1)).astype(float)
    trees = Q.train(x[:1500], y[:1500])
    assert ((trees.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert Q.train(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert (Q.train(x[:50], np.ones(50)).score(x[:2]) > 0.9).all()


def test_flat_traversal_equals_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, len(Q.STATS)))
    trees = Q.train(x, (x[:, 0] + x[:, 1] > 0).astype(float))

    def walk(row):
        total = trees.base
        for f, b, leaf in zip(trees.feature, trees.bound, trees.leaf, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + (2 if row[f[k]] > b[k] else 1)
            total += leaf[k - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x), [walk(r) for r in x])


def test_models_take_edge_texts(frame, spark):
    labels = spark.createDataFrame([(0, 1, 0), (5, 0, 1), (5, 0, 1), (None, 1, 1), (77, None, None)], "doc_id bigint, quality int, toxic int")
    for report in (Q.quality_report, X.toxicity_report):
        for known in (labels, labels.limit(0)):
            rows = report(frame(EDGES * 2, ids=[*range(len(EDGES))] * 2), known).collect()
            assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
            by = {}
            for r in rows:
                assert by.setdefault(r.doc_id, r.score) == r.score
        assert report(frame([]), labels).collect() == []


def test_label_model_merges_correlated_voters_and_finds_the_class():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.1
    own = rng.random((4000, 4)) < np.where(y[:, None], 0.5, 0.01)
    votes = np.concatenate([own, own[:, :1], own[:, :1]], 1).astype(float)  # three voters are one
    group = X.correlated_groups(y.sum(), (votes * y[:, None]).T @ votes)
    assert group[0] == group[4] == group[5] and len(set(group.tolist())) == 4
    model = X.LabelModel(0.05, group, np.tile([[0.002], [0.1]], (1, 4)))
    for _ in range(10):
        model = model.refit(model.moments(votes, np.ones(len(y)), model.posterior(votes)))
    sure = model.posterior(votes) > 0.5
    assert (sure == y).mean() > 0.95 and abs(model.prior - 0.1) < 0.03


def test_features_and_votes():
    assert X.word_feature("idiot") in X.features("You IDIOT!".encode()).tolist()
    assert X.word_feature("idiot") not in X.features(b"idiotic").tolist()
    assert len(X.features(b"")) == 0 and X.patterns(b"") == [False] * 4
    assert X.vote_mask(X.features(b"idiot"), [True, False, False, False], X.mine_voters([], np.zeros(0))) == 1 | 1 << len(X.INSULTS)


def test_a_rare_language_cuts_no_other_reference(spark):
    """A stray label and a language with little text: the others keep their references and predictions."""
    rng = np.random.default_rng(8)
    vocabulary = {x: ["".join(rng.choice(list(abc), rng.integers(2, 9))) for _ in range(1500)] for x, abc in (("aa", "abcdeinrst"), ("bb", "aeiouklmnz"), ("cc", "bdfgoprtuv"))}
    prose = lambda x, n: " ".join(rng.choice(vocabulary[x], n))
    rows = [(i, prose("ab"[i % 2] * 2, 300), "ab"[i % 2] * 2) for i in range(120)]
    rows += [(200 + i, prose("cc", 160), "cc") for i in range(4)] + [(300, prose("aa", 20), "stray")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    refs = L.learn_references(docs)
    assert set(refs) == {"aa", "bb", "cc"} and len(refs["aa"]) == len(refs["bb"]) == L.REFERENCE
    assert L.LEAST <= len(refs["cc"]) < 4 * 1_000
    alone = L.learn_references(docs.where("lang in ('aa', 'bb')"))
    assert alone == {x: refs[x] for x in ("aa", "bb")}
    truth = [x for x in ("aa", "bb", "cc") for _ in range(30)]
    langs, scores = L.Parser(refs).predict([prose(x, 40) for x in truth])
    assert langs == truth and min(scores) >= 0 and max(scores) <= 1


def test_languages_meet_at_their_common_length():
    """The same source under two names, one with a long and one with a short reference: length alone decides nothing."""
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words, n))
    parser = L.Parser({"long": prose(8000)[:32_000], "short": prose(1000)[:2_000]})
    langs, _ = parser.predict([prose(60) for _ in range(200)])
    assert 40 <= langs.count("short") <= 160


def test_samples_are_bounded_by_rows(spark):
    from riskloom.llm.common import labelled_sample

    docs = [(1, f"repeated {i}", "aa") for i in range(3000)] + [(k, f"text number {k}", "aa") for k in range(2, 60)]
    kinds = "doc_id bigint, text string, lang string"
    rows = spark.createDataFrame(docs, kinds)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(1, 0)], "doc_id bigint, toxic int")
    got = labelled_sample(rows, labels, "toxic", 1000).collect()
    assert len(got) == 59 and next(r for r in got if r.doc_id == 1)[1:] == ("repeated 0", 1)


def test_references_take_one_row_an_id_and_any_columns(spark):
    docs = [(1, "same words here again and again", "aa", "x", 5, "e", 9)] * 500
    docs += [(k, "other words in other places", "bb", "y", 6, "f", 9) for k in range(2, 30)]
    kinds = "doc_id bigint, text string, lang string, sample_lang string, sample_id int, excerpt string, id int"
    refs = L.learn_references(spark.createDataFrame(docs, kinds))
    assert set(refs) == {"bb"} or refs["aa"].count("same words") == 1
