"""Parity-sketch join against all pairs in plain Python."""

import random

import numpy as np
import pytest

from riskloom.llm import jaccard_join as J
from riskloom.llm.common import text_shingles


def brute(texts, width, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def answer(docs, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar_components(docs, **options).collect()}


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_random_groups_match_all_pairs(frame, width, percent, monkeypatch):
    rng = random.Random(width)
    monkeypatch.setattr(J, "FREQUENT", 4)  # so that frequent keys occur in a small table
    passage = [f"p{k}" for k in range(60)]
    texts = [None, "", " \t\n", "one", "One", "two words", "two  WORDS", "a b c", "é b c"]
    for _ in range(25):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 8, 12, 40, 150, 400]))]
        texts += [edited(rng, words, rng.choice([0, 0, 1, 1, 2, 3, 6])) for _ in range(rng.choice([1, 2, 5]))]
        texts.append(" ".join([*words[:40], *passage]))
    center = [f"c{k}" for k in range(200)]
    texts += [edited(rng, center, rng.randrange(8)) for _ in range(30)]
    texts += ["same text in many rows of the table"] * 20
    assert answer(frame(texts), width=width, percent=percent) == dict(enumerate(brute(texts, width, percent)))


def test_linked_sets_always_share_a_key():
    """The pigeonhole bound itself: sets at the threshold agree in more parts than the slack of their common home."""
    rng = np.random.default_rng(1)
    for percent in (80, 85):
        bands = J.Bands(percent)
        for _ in range(300):
            n = int(rng.integers(1, 3000))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            lost = int(len(a) * (100 - percent) / 100)
            b = a[np.sort(rng.permutation(len(a))[lost:])]
            if not len(b) or 100 * len(b) < percent * len(a) or len(a) == len(b):
                continue
            home = min(bands.band(len(a)), bands.band(len(b)))
            assert max(bands.band(len(a)), bands.band(len(b))) <= home + 1
            same = (J.sketch_keys(a, home, bands) == J.sketch_keys(b, home, bands)).sum()
            assert same >= bands.slack[home] + 1


def test_shingles_follow_ascii_words():
    assert len(text_shingles("a b c".encode(), 1)) == 2  # a no-break space does not separate
    assert (text_shingles(b"A b\x0bC", 2) == text_shingles(b"a\tB c", 2)).all()
    assert len(text_shingles(b"x y", 4)) == 1 and len(text_shingles(b"", 4)) == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "q r s t u v"), (3, "a b c d e f")]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id bigint, text string, id int, component string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in J.similar_components(docs).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 1), (3, 1)]
    kept = J.drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.id) for r in kept.collect()) == [(0, 7), (1, 7)]


def test_ids_with_several_texts_keep_all_links(spark, monkeypatch):
    """An id that is a copy in one class and the smallest id of another: the other class keeps its near copies."""
    text = {x: " ".join(f"{x}{k}" for k in range(60)) for x in "abc"}
    near = {x: t + " end" for x, t in text.items()}
    rows = [(1, text["a"]), (3, text["a"]), (3, text["b"]), (4, near["b"]), (6, text["b"]), (7, text["c"]), (8, near["c"]), (9, ""), (None, text["b"])]
    expected = [(0, 0), (1, 1), (3, 1), (3, 1), (4, 1), (6, 1), (7, 7), (8, 7), (9, 9)]
    for frequent in (J.FREQUENT, 1):  # 1: links are found in families
        monkeypatch.setattr(J, "FREQUENT", frequent)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        assert sorted((r.doc_id or 0, r.component_id or 0) for r in J.similar_components(docs).collect()) == expected


def test_random_groups_with_repeated_ids_match_all_pairs(spark):
    rng = random.Random(21)
    rows = []
    for _ in range(40):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([4, 30, 120]))]
        rows += [(rng.randrange(150), edited(rng, words, rng.choice([0, 0, 1, 2]))) for _ in range(rng.choice([1, 2, 4]))]
    label = [c for _, c in brute([t for _, t in rows], 5, 80)]
    group = {i: i for i, _ in rows}  # ids, joined by linked texts
    changed = True
    while changed:
        changed = False
        least = {}
        for (i, _), c in zip(rows, label, strict=True):
            least[c] = min(least.get(c, i), group[i])
        for (i, _), c in zip(rows, label, strict=True):
            if least[c] < group[i]:
                group[i], changed = least[c], True
    assert len({i for i, _ in rows}) < len(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in J.similar_components(docs).collect()} == group


def test_empty_table(frame):
    assert J.similar_components(frame([])).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_components_of_chains_stars_and_clouds(spark, seed):
    rng = random.Random(seed)
    names = list(range(500))
    rng.shuffle(names)
    chain = [(k, k + 1) for k in range(1000, 1040)]
    star = [(names[0], names[k]) for k in range(1, 80)]
    cloud = [tuple(rng.sample(names[100:400], 2)) for _ in range(250)]
    extra = [(1005, names[3]), (names[420], names[421]), (names[421], names[450]), (names[9], names[9])]

    def frame_of(pairs):
        return spark.createDataFrame(pairs, "a bigint, b bigint")

    def plain(pairs):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in pairs:
            x, y = find(a), find(b)
            if a != b:
                root[max(x, y)] = min(x, y)
        ends = {x for a, b in pairs if a != b for x in (a, b)}
        return {x: find(x) for x in ends}

    first = J.components(frame_of(chain + star + cloud))
    assert {r.id: r.component for r in first.collect()} == plain(chain + star + cloud)
    both = J.more_components(first, frame_of(extra))
    assert {r.id: r.component for r in both.collect()} == plain(chain + star + cloud + extra)
    assert J.components(frame_of([(7, 7)])).collect() == []
