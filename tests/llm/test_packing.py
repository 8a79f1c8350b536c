import zlib

import numpy as np

from riskloom.llm import packing as P


def checked(rows, capacity):
    """Sequences are gapless and no longer than the capacity; returns their number."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by)


def test_pieces_equal_the_tokenizer(frame):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.vocabulary_path())
    texts = [
        None, "", "   ", "Hello, World. it's we'll I'M", "İstanbul ΣΑΣ ﬁne ª", "áb é", "foo.”bar 12.5,3 x's", "<|endoftext|> hi",
        "日本語。テスト a b\x85c", "word, " * 300, "don't " * 2000,
    ]
    rows = P.pack_documents(frame(texts * 2, ids=[*range(len(texts))] * 2), capacity=512).collect()
    checked(rows, 512)
    got = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = []
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k // 512, k, len(ids[k : k + 512]), zlib.crc32(ids[k : k + 512].tobytes())) for k in range(0, len(ids), 512)]
    assert got == sorted(want * 2)


def test_pack_reaches_a_planted_optimum(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ITEMS", 200)
    rng = np.random.default_rng(2)
    sizes = []
    for _ in range(120):  # sequences that are full when packed rightly
        cuts = np.sort(rng.choice(np.arange(1, 100), 3, replace=False))
        sizes += np.diff([0, *cuts, 100]).tolist()
    pieces = spark.createDataFrame([(k, int(s), "x") for k, s in enumerate(sizes)], "doc_id bigint, length bigint, bin_no string")
    rows = P.pack(pieces, 100).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(sizes)))
    assert checked(rows, 100) <= 120 * 1.05


def test_evolution_improves_on_best_fit():
    rng = np.random.default_rng(7)
    better = 0
    for seed in range(6):
        sizes = np.concatenate([np.diff([0, *np.sort(rng.choice(np.arange(15, 85), 2, replace=False)), 100]) for _ in range(60)])
        start = P.best_fit(sizes, np.argsort(-sizes, kind="stable"), 100)
        end = P.evolve(sizes, [start], 100, seed)
        assert np.bincount(end, sizes).max() <= 100 and (np.bincount(end) > 0).all()
        assert P.fitness(end, sizes, 100) <= P.fitness(start, sizes, 100)
        better += P.fitness(end, sizes, 100) < P.fitness(start, sizes, 100)
    assert better >= 3


def test_empty_table(frame):
    assert P.pack_documents(frame([])).collect() == []


def test_clashing_columns_pass_through(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ITEMS", 100)
    rng = np.random.default_rng(3)
    rows = [(k, int(s), "s", 7, 8, k, "r") for k, s in enumerate(rng.integers(20, 80, 300))]
    kinds = "doc_id bigint, length bigint, source string, offset int, sequence_id int, came_from bigint, row_no string"
    got = P.pack(spark.createDataFrame(rows, kinds), 100).collect()
    checked(got, 100)
    assert sorted((r.doc_id, r.length, r.source, r.came_from, r.row_no) for r in got) == [(a, b, c, f, g) for a, b, c, _, _, f, g in rows]


def test_a_full_cache_changes_no_id(frame, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.vocabulary_path())
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(rng.choice(list("abéß."), 6)) + rng.choice(["", "!!", "ﬁ,", "İ."]) for _ in range(50)) for _ in range(40)]
    for size in (0, 30, 10**6):
        monkeypatch.setattr(P, "CACHE_CHUNKS", size)
        cached = P.ChunkTokenizer(P.vocabulary_path())
        for part in (texts[:20], texts[20:], texts[:5]):
            want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in part]
            assert cached.encode([t.encode() for t in part]) == want


def test_a_repeated_chunk_is_looked_up_once():
    class Counted(dict):
        asked = 0

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    cached = P.ChunkTokenizer(P.vocabulary_path())
    cached.known = Counted(cached.known)
    once, many = cached.encode([b"Word"]), cached.encode([b"word " * 1000, b"", b" word"])
    assert many == [once[0] * 1000, b"", once[0]]
    assert Counted.asked < 10


def test_white_space_and_broken_utf8_equal_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.vocabulary_path())
    texts = [b" \t\x0b\x0c\r\n", b"\n a\x1cb\x0bC. \x0c", b"x\xff\xfey abc", "a\u00a0b\u2003c \u0085".encode(), b"ABC abc, 'll ll's", b"aaaa" * 5000]
    want = [np.array(tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert P.ChunkTokenizer(P.vocabulary_path()).encode(texts) == want
