import re

import pytest

from riskloom.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, items, width):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, body in items:
        w = WORD.findall(lower(body))
        if item is None or not w:
            continue
        size = min(width, len(w))
        for k in range(len(w) - size + 1):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == w[k : k + size]:
                    hit.update(range(at, at + size))
                    found.add(str(item))
    return len(words), len(hit), sorted(found), hit


ITEMS = [(1, "One two three four five six."), (2, "FOUR five-six"), (10, "été déjà vu 42"), (3, None), (4, " .. "), (None, "x y"), (5, "one")]
TEXTS = [
    None, "", "nothing here", "zero ONE, two; three four! five six seven", "été\ndéjà vu 42 four five six", "one", "onetwo two one.one",
    "three four five six 😀 one two three four five six" * 3, "stone two three fourfive", "É été déjà vu 421 vu",
]


@pytest.mark.parametrize("block_chars", [10**6, 20])
def test_matches_brute_force(spark, frame, block_chars):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found, f = D.find_contamination(frame(TEXTS * 2, ids=[*range(len(TEXTS))] * 2), bench, width=4, block_chars=block_chars)
    rows = found.select("doc_id", "score", f"{f}.*").collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        text = TEXTS[r.doc_id]
        n, hits, items, where = brute(text, ITEMS, 4)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hits, items), text
        at = [m.span() for m in WORD.finditer(lower(text))]
        covered = {k for k, (a, b) in enumerate(at) if any(s <= a and b <= e for s, e in r.spans)}
        assert covered == where


def test_empty_tables(spark, frame):
    none = spark.createDataFrame([], "item_id bigint, text string")
    rows = D.contamination_report(frame(["a b"]), none).collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows] == [(2, 0, 0, False)]
    some = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert D.contamination_report(frame([]), some).collect() == []
    docs = frame(["x a b y", "clean", None])
    kept = D.drop_contaminated(docs, some)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
