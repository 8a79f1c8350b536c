"""Cross-tokenizer alignment against the tokenizers themselves and plain loops over byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riskloom.llm import alignment as A

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def sides():
    byte_bpe = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    byte_bpe.encode_special_tokens = True
    # the byte-level alphabet: printable bytes stand for themselves, the others for 256 upwards
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    def spans(text):
        if not text:
            return None
        whole = (" " + text).encode()
        a = byte_bpe.encode(" " + text, add_special_tokens=False).ids
        b = pieces.encode(text, num_threads=1)
        words_a = [bytes(byte_of[c] for c in byte_bpe.id_to_token(k)) for k in a]
        words_b = []
        for k in b:
            w = pieces.id_to_piece(k)
            words_b.append(bytes([int(w[3:5], 16)]) if pieces.is_byte(k) else w.replace("▁", " ").encode())
        if b"".join(words_a) != whole or b"".join(words_b) != whole:
            return None
        out = []
        for ids, words in ((a, words_a), (b, words_b)):
            at, side = 0, []
            for k, w in zip(ids, words, strict=True):
                side.append((k, at, at + len(w)))
                at += len(w)
            out.append(side)
        return out

    return spans


def brute(texts, spans):
    docs, held = [], Counter()
    for text in texts:
        both = spans(text)
        if both is None:
            docs.append(None)
            continue
        a, b = both
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        links = [(x, y) for x, s, e in a for y, u, v in b if s < v and u < e] if len(a) < 400 else None
        if links is None:  # long text: walk both sides
            links, j = [], 0
            for x, s, e in a:
                while b[j][2] <= s:
                    j += 1
                k = j
                while k < len(b) and b[k][1] < e:
                    links.append((x, b[k][0]))
                    k += 1
        groups, start = [], 0
        by_group = [defaultdict(list), defaultdict(list)]
        for n, side in enumerate((a, b)):
            group = 0
            for k, _, e in side:
                by_group[n][group].append(str(k))
                group += e == cuts[group]
        groups = ";".join(",".join(by_group[0][g]) + "|" + ",".join(by_group[1][g]) for g in range(len(cuts)))
        assert start == 0
        held.update(set(links))
        docs.append((len(a), len(b), len(cuts), links, groups))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, groups = d
        best = sum(held[p] == most[p[0]] for p in links)
        digest = hashlib.sha256(groups.encode()).hexdigest()
        out.append((n_a, n_b, n_groups, len(links), best, sum(held[p] for p in links), digest))
    return out


TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "a \n b", "\t\tx\r\n y z　w", "\x00\x01\x1c \x1d x", "x\x1c y\x85 z",
    "don't you're I'LL it's '' 's", "naïve café ﬁ é x́", "日本語のテキストです。中文 한국어", "🙂🙃 👩‍👩‍👧 a🙂b", "▁ literal ▁x a▁ b",
    "<s> </s> <unk> <|endoftext|> <0x41>x", "12345 6.78e-9 0x1F", "http://example.com/a?b=c#d", "مرحبا بالعالم", "      indented    code   ",
    "word " * 300, "nospace" * 400, "A" * 3000, "\n" * 50, "...!!!???", "x y  z ﻿ w", "tail\n", "tail \t ",
]


def answer(df):
    return {r.doc_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_report_matches_plain_loops(spark, frame, sides):
    rng = random.Random(3)
    words = ["alpha", "Beta", "the", "of,", "quick.", "über", "naïveté", "42", "foo_bar", "x=1;", "日本", "don't", "\n", "  "]
    texts = TEXTS + [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(60)]
    texts += texts[-3:] + ["a very long text " + " ".join(rng.choices(words, k=8000))]
    want = brute(texts, sides)
    got = answer(A.alignment_report(frame(texts)))
    for k, w in enumerate(want):
        assert got[k] == w, repr(texts[k])[:80]


def test_the_driver_table_agrees_and_shuffled_counts_too(spark, sides, monkeypatch):
    from riskloom.sources.tables import read_table

    docs = read_table(spark, "/root/testdata/sf0.001", "documents", ["doc_id", "text"]).limit(60)
    rows = sorted(docs.collect())
    monkeypatch.setattr(A, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(A, "CACHE_CHUNKS", 50)
    got = answer(A.alignment_report(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert [got[r.doc_id] for r in rows] == brute([r.text for r in rows], sides)


def test_products_match_dense_matrices():
    rng = np.random.default_rng(0)
    for _ in range(30):
        x, y = (rng.integers(0, 2, (rng.integers(1, 9), 7)) for _ in range(2))
        sparse = []
        for m in (x, y):
            rows, columns = np.nonzero(m)
            starts = np.searchsorted(rows, np.arange(len(m) + 1))
            sparse.append(A.CSR.incidence(starts, columns, 7))
        out = np.zeros((len(x), len(y)), int)
        for at, found in A.products(*sparse):
            rows = at + np.repeat(np.arange(len(found.starts) - 1), np.diff(found.starts))
            out[rows, found.columns] = found.values
        assert (out == x @ y.T).all()


def test_shared_groups_and_small_blocks(monkeypatch):
    tokens = A.tokens_of(*A.vocabulary_paths())
    a, b = tokens.encode(" " + "Unbelievable naïveté, 日本語 and tokenization. " * 30)
    found = A.Alignment(a, b, tokens.size_a[a], tokens.size_b[b])
    plain = [(i.tolist(), j.tolist(), v.tolist()) for i, j, v in found.links()]
    monkeypatch.setattr(A, "BLOCK_BYTES", 16)
    small = [np.concatenate(x).tolist() for x in zip(*found.links(), strict=True)]
    assert list(plain[0]) == small
    shared = sum(len(i) for i, _, _ in found.links("groups"))
    assert shared == sum(e.n_shared for e in found.entries(np.array([found.ends_a[-1]])))
    assert sum(small[2]) == found.ends_a[-1]  # each byte is shared once


def test_empty_table_and_repeated_rows(spark, frame):
    assert A.alignment_report(frame([])).collect() == []
    rows = A.alignment_report(frame(["same", "same", "other"], ids=[1, 1, None])).collect()
    assert sorted((str(r.doc_id), r.n_a) for r in rows)[0] == ("1", rows[0].n_a) and len(rows) == 3
    assert {r.count_sum // max(r.n_links, 1) for r in rows if r.doc_id == 1} == {2}
