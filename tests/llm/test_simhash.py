"""SimHash near-duplicates against all pairs in plain Python."""

import random

import pytest
import xxhash

from riskloom.llm import simhash as S


def plain_print(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [words[k : k + width] for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(b" ".join(r), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(prints, ids):
    """Component of each row: links of at most four bits, and rows of one id."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 or (ids[i] is not None and ids[i] == ids[j]):
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        r = find(i)
        if k is not None:
            least[r] = min(k, least.get(r, k))
    return [least.get(find(i)) for i in range(len(ids))]


def rows_of(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def expected(texts, ids):
    prints = [plain_print(t) for t in texts]
    return sorted(zip(ids, [f"{p:016x}" for p in prints], closure(prints, ids), strict=True), key=str)


def cluster(rng, size, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(edits):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


TRAPS = [None, "", " \t\n", "one", "One", "two words", "two  WORDS", "\x1cone two", "a b c", "a b c d", "é É b c d", "x " * 30_000]


@pytest.mark.parametrize("paired", [0, 8])
def test_components_match_all_pairs(spark, frame, paired, monkeypatch):
    monkeypatch.setattr(S, "PAIRED", paired)  # zero: every open key goes through its points
    rng = random.Random(paired)
    texts = TRAPS + [t for n in (30, 60, 120, 300) for t in cluster(rng, n, 40)] + ["the same text in many rows of it"] * 30
    ids = list(range(len(texts)))
    assert rows_of(S.simhash_report(frame(texts))) == expected(texts, ids)


def test_repeated_and_missing_ids(spark, frame):
    rng = random.Random(5)
    a, b = cluster(rng, 200, 6), cluster(rng, 200, 6)
    texts = [*a, *b, a[0], "only here without an id", None]
    ids = [5, 6, 7, 8, 9, 10, 20, 21, 21, 22, 23, 24, 20, None, 30]
    assert rows_of(S.simhash_report(frame(texts, ids))) == expected(texts, ids)


def test_points_and_keys_are_complete():
    rng = random.Random(1)
    masks = S.block_masks()
    assert len(masks) == 70 and len(S.ball(2)) == 1 + 64 + 2016
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for k in rng.sample(range(64), rng.randrange(5)):
            y ^= 1 << k
        assert any((x & m) == (y & m) for m in (m % (1 << 64) for m, _ in masks))
        points = {x ^ p % (1 << 64) for p in S.ball(2)}
        assert any(y ^ p % (1 << 64) in points for p in S.ball(2))


def test_planted_clouds_of_fingerprints(spark):
    """Chains, clouds around a centre and pairs at five bits, straight on fingerprints."""
    rng = random.Random(9)
    prints = []
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(25):
            for k in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 5, 6])):
                at ^= (1 << k) * (rng.random() < 0.8)
            prints.append(at)
    prints = list(dict.fromkeys(prints))
    nodes = spark.createDataFrame([(S.signed(p),) for p in prints], "fp bigint")
    rows = S.block_members(nodes).cache()
    stars = S.star_links(rows)
    labels = S.components(stars)
    left = S.open_members(rows, labels)
    links = stars.union(S.pair_links(left)).union(S.point_links(left))
    got = {r.id: r.component for r in S.components(links).collect()}
    want = closure(prints, [S.signed(p) for p in prints])
    assert [got.get(S.signed(p), S.signed(p)) for p in prints] == want


def test_empty_table_and_drop(spark, frame):
    assert S.simhash_report(frame([])).collect() == []
    rng = random.Random(3)
    texts = [*cluster(rng, 400, 3), "another text that stands alone here", *cluster(rng, 400, 1)]
    kept = S.drop_near_duplicates(frame(texts))
    assert kept.columns == ["doc_id", "text", "score", "spans"]
    want = {c for _, _, c in expected(texts, list(range(len(texts))))}
    assert {r.doc_id for r in kept.collect()} == want
