"""Cross-tokenizer alignment by products of sparse incidence matrices.

Each text is encoded by a byte-level tokenizer (A) and a piece tokenizer (B) over the same bytes: one space and the text. Token x byte
incidence matrices of both sides are built as CSR arrays; a row of A.B^T (Gustavson: the rows of B^T that the row's bytes name, merged)
holds the B tokens whose bytes overlap an A token, and how many bytes they share. Bytes at which tokens of both sides end cut the
tokens into groups; token x group incidence matrices give, by the same product, the links of tokens that share a group.

Where a space follows a word, tokens of both sides end, so the products are block-diagonal: a text's result is the sum of its chunks'.
Each worker keeps a bounded table of chunks it has seen; the new chunks of a few texts are joined, encoded and multiplied together,
in blocks of rows of A of at most ``BLOCK_BYTES`` bytes. (A piece model for which that does not hold gets whole texts as chunks.)

On Spark: a task maps a few texts at a time; each keeps its distinct linked id pairs with their numbers of links. A pair's count over the corpus is a grouped count of those narrow rows, and
each document joins its pairs with the counts: broadcast only where there are at most ``BROADCAST_PAIRS`` of them, else shuffled.

Defined cases: texts that are null or empty, or whose joined tokens on either side differ from one space and the text, have no tokens:
all numbers are zero and the digest is empty; repeated rows and null ids are documents of their own; special tokens' strings in a text
are plain text; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import map_text
from riskloom.session import materialise

BYTE_RANKS, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Pairs are one number, a * SPAN + b; both vocabularies are smaller than this and the number stays below 2**63.
SPAN = 1 << 31
BLOCK_BYTES = 1 << 18
BROADCAST_PAIRS = 1_000_000
#: A space behind a character that is no blank, unless only blanks follow.
AT_BLANKS = re.compile(r"(?<=\S)(?= \s*\S)")
#: Chunks that a worker keeps, the longest one kept, and characters encoded in one call.
CACHE_CHUNKS, CACHED_LENGTH, JOINED = 200_000, 64, 200_000


class Tokens:
    """Both tokenizers of a worker, and tables of their ids' bytes."""

    def __init__(self, ranks: str, pieces: str):
        import public_tokenizers as P
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte_bpe = tiktoken.Encoding("byte level", pat_str=P.PATTERN, mergeable_ranks=known, special_tokens={})
        self.piece_bpe = model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.words_a = [b""] * (max(known.values()) + 1)
        for word, k in known.items():
            self.words_a[k] = word
        names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        self.words_b = [bytes([int(w[3:-1], 16)]) if model.is_byte(k) else w.replace("\u2581", " ").encode() for k, w in enumerate(names)]
        self.size_a = np.array([len(w) for w in self.words_a], np.int64)
        self.size_b = np.array([len(w) for w in self.words_b], np.int64)
        # blanks part words for B if no piece goes on behind a word and blanks stay as they are
        self.parts_at_blanks = not any(re.search("[^\u2581]\u2581", w) for w in names) and all(
            b"".join(self.words_b[k] for k in model.encode(t)) == b" " + t.encode() for t in ("a  b", " a", "a ", "\ufb01 \u0301e")
        )
        self.known: dict[str, Entry | None] = {}

    def encode(self, whole: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides for a text that begins with the added space; None if a side's bytes differ."""
        a = self.byte_bpe.encode_ordinary(whole)
        b = self.piece_bpe.encode(whole[1:], num_threads=1)
        raw = whole.encode()
        if b"".join(map(self.words_a.__getitem__, a)) != raw or b"".join(map(self.words_b.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def chunks(self, text: str) -> list[str]:
        """Parts of a text, with the space put in front, at whose borders tokens of both sides end.

        A space behind a character that is no blank begins a token on the byte-level side, whatever stands before it."""
        return AT_BLANKS.split(" " + text) if self.parts_at_blanks else [" " + text]

    def learn(self, chunks: list[str]) -> dict[str, Entry | None]:
        """Entries of chunks, encoded and aligned together, JOINED characters at a time; those that end in a blank alone."""
        out: dict[str, Entry | None] = {}
        work, size = [], 0
        for chunk in chunks:
            if chunk[-1:].isspace():
                out.update(self.align([chunk]))
                continue
            work.append(chunk)
            size += len(chunk)
            if size >= JOINED:
                out.update(self.align(work))
                work, size = [], 0
        return out | self.align(work)

    def align(self, chunks: list[str]) -> dict[str, Entry | None]:
        if not chunks:
            return {}
        ids = self.encode("".join(chunks))
        if ids is None:
            return {chunks[0]: None} if len(chunks) == 1 else {k: v for c in chunks for k, v in self.align([c]).items()}
        a, b = ids
        found = Alignment(a, b, self.size_a[a], self.size_b[b])
        ends = np.cumsum([len(c.encode()) for c in chunks])
        return dict(zip(chunks, found.entries(ends), strict=True))

    def entries(self, texts: list[bytes]) -> list[list[Entry | None]]:
        """The entries of each text's chunks; short chunks stay known for later texts, as long as there is room."""
        parts = [self.chunks(t.decode("utf-8", "replace")) if t else [] for t in texts]
        known, fresh = self.known, {}
        missing = set().union(*parts).difference(known)
        if missing:
            fresh = self.learn(list(missing))
            known.update(fresh)
        out = [list(map(known.__getitem__, p)) for p in parts]
        full = len(known) > CACHE_CHUNKS
        for chunk in fresh:
            if full or len(chunk) > CACHED_LENGTH:
                del known[chunk]
        return out


_TOKENS: dict = {}  # of this worker process


def tokens_of(ranks: str, pieces: str) -> Tokens:
    key = (ranks, pieces)
    if key not in _TOKENS:
        _TOKENS[key] = Tokens(ranks, pieces)
    return _TOKENS[key]


# -- sparse matrices -----------------------------------------------------------------------------------------------------


class CSR:
    """A sparse matrix by rows: the columns of row i are columns[starts[i]:starts[i + 1]], with their values."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.starts, self.columns, self.values, self.width = starts, columns, values, width

    @classmethod
    def incidence(cls, starts: np.ndarray, columns: np.ndarray, width: int) -> CSR:
        return cls(starts, columns, np.ones(len(columns), np.int64), width)

    def rows(self, lo: int, hi: int) -> CSR:
        a, b = self.starts[lo], self.starts[hi]
        return CSR(self.starts[lo : hi + 1] - a, self.columns[a:b], self.values[a:b], self.width)

    def transposed(self) -> CSR:
        """Counting sort by column."""
        count = np.bincount(self.columns, minlength=self.width)
        order = np.argsort(self.columns, kind="stable")
        owner = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        starts = np.concatenate([[0], np.cumsum(count)])
        return CSR(starts, owner[order], self.values[order], len(self.starts) - 1)

    def times(self, other: CSR) -> CSR:
        """Gustavson's product: row i is the sum of those rows of ``other`` that row i's columns name."""
        sizes = np.diff(other.starts)[self.columns]
        end = np.cumsum(sizes)
        total = int(end[-1]) if len(end) else 0
        place = np.arange(total) + np.repeat(other.starts[self.columns] - (end - sizes), sizes)
        row = np.repeat(np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)), sizes)
        key = row * other.width + other.columns[place]
        value = np.repeat(self.values, sizes) * other.values[place]
        if total and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if total else np.zeros(0, np.int64)
        value = np.add.reduceat(value, first) if total else value
        key = key[first]
        starts = np.searchsorted(key, np.arange(len(self.starts)) * other.width)
        return CSR(starts, key % other.width if other.width else key, value, other.width)


def token_bytes(sizes: np.ndarray) -> CSR:
    """Token x byte incidence of tokens that follow one another."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return CSR.incidence(starts, np.arange(starts[-1]), int(starts[-1]))


def token_groups(sizes: np.ndarray, cuts: np.ndarray) -> CSR:
    """Token x group incidence; ``cuts`` are the common ends, ascending."""
    ends = np.cumsum(sizes)
    return CSR.incidence(np.arange(len(sizes) + 1), np.searchsorted(cuts, ends), len(cuts))


def products(left: CSR, right: CSR):
    """(first row, product) of left . right^T for blocks of rows of ``left`` with at most BLOCK_BYTES entries, or one row."""
    across, at = right.transposed(), 0
    while at < len(left.starts) - 1:
        end = int(np.searchsorted(left.starts, left.starts[at] + BLOCK_BYTES, side="right")) - 1
        end = min(max(end, at + 1), len(left.starts) - 1)
        yield at, left.rows(at, end).times(across)
        at = end


@lru_cache
def id_names(bits: int, ends: str) -> np.ndarray:
    """The decimal names of all ids of so many bits, with one of two signs behind."""
    return np.array([f"{k}{end}" for k in range(1 << bits) for end in ends], object)


class Entry(NamedTuple):
    """What a chunk adds to a text: numbers, its groups as text, its linked id pairs (64-bit numbers as bytes, one for each link)."""

    n_a: int
    n_b: int
    n_groups: int
    n_shared: int
    groups: str
    pairs: bytes


class Alignment:
    """Groups and links of two runs of tokens over the same bytes, by their ids and sizes."""

    def __init__(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray):
        self.a, self.b, self.size_a, self.size_b = a, b, size_a, size_b
        self.ends_a, self.ends_b = np.cumsum(size_a), np.cumsum(size_b)
        self.cuts = np.intersect1d(self.ends_a, self.ends_b, assume_unique=True)

    def links(self, shared: str = "bytes"):
        """(A places, B places, shared bytes or groups) of all links, a block of rows of A at a time."""
        if shared == "bytes":
            left, right = token_bytes(self.size_a), token_bytes(self.size_b)
        else:
            left, right = token_groups(self.size_a, self.cuts), token_groups(self.size_b, self.cuts)
        for at, found in products(left, right):
            yield at + np.repeat(np.arange(len(found.starts) - 1), np.diff(found.starts)), found.columns, found.values

    def group_names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids' names in the order ``a1,a2|b1;a3|b2,b3;``, each with the sign that follows it, and both sides' groups."""
        group_a, group_b = (token_groups(s, self.cuts).columns for s in (self.size_a, self.size_b))
        before_b = np.searchsorted(group_b, group_a)  # B tokens in earlier groups
        before_a = np.searchsorted(group_a, group_b, side="right")
        out = np.empty(len(self.a) + len(self.b), object)
        for ids, group, before, ends in ((self.a, group_a, before_b, ",|"), (self.b, group_b, before_a, ",;")):
            last = np.diff(group, append=-1) != 0
            out[np.arange(len(ids)) + before] = id_names(int(ids.max(initial=0)).bit_length(), ends)[2 * ids + last]
        return out, group_a, group_b

    def entries(self, ends: np.ndarray) -> list[Entry]:
        """An entry for each chunk; ``ends`` are the chunks' last bytes (exclusive), which are cuts."""
        names, group_a, group_b = self.group_names()
        counts = [np.bincount(g, minlength=len(self.cuts)) for g in (group_a, group_b)]
        shared = np.concatenate([[0], np.cumsum(counts[0] * counts[1])])  # token pairs of a group, as the groups' product counts them
        found = [(i, self.a[i] * SPAN + self.b[j]) for i, j, _ in self.links()]
        rows = np.concatenate([i for i, _ in found]) if found else np.zeros(0, np.int64)
        pairs = np.concatenate([p for _, p in found]).tobytes() if found else b""
        at_a, at_b, at_cut = (np.searchsorted(x, ends, side="right") for x in (self.ends_a, self.ends_b, self.cuts))
        at_link = np.searchsorted(rows, at_a)
        places = np.concatenate([np.zeros((4, 1), np.int64), np.stack([at_a, at_b, at_cut, at_link])], axis=1).T.tolist()
        total, out = shared.tolist(), []
        for (a0, b0, c0, l0), (a1, b1, c1, l1) in zip(places, places[1:], strict=False):
            text = "".join(names[a0 + b0 : a1 + b1])[:-1]
            out.append(Entry(a1 - a0, b1 - b0, c1 - c0, total[c1] - total[c0], text, pairs[8 * l0 : 8 * l1]))
        return out


FIELDS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_shared bigint, groups_sha256 string, pairs array<bigint>, links array<int>"
EMPTY = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "n_shared": 0, "groups_sha256": "", "pairs": [], "links": []}


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path(BYTE_RANKS), P.path(PIECES)


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """row, doc_id and :data:`FIELDS` of each document; stored, so that ``row`` stays the same number."""
    own = vocabulary_paths()
    ranks, pieces = ranks or own[0], pieces or own[1]

    def one(entries: list[Entry | None]) -> dict:
        if not entries or None in entries:
            return EMPTY
        n_a, n_b, n_groups, n_shared, groups, links = zip(*entries, strict=True)
        pair, count = np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True)
        numbers = {"n_a": sum(n_a), "n_b": sum(n_b), "n_groups": sum(n_groups), "n_links": int(count.sum()), "n_shared": sum(n_shared)}
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        return numbers | {"groups_sha256": digest, "pairs": pair, "links": count.astype(np.int32)}

    def make():
        tokens = tokens_of(ranks, pieces)

        def apply(texts):
            rows = [one(e) for e in tokens.entries(texts)]
            return {k: [r[k] for r in rows] for k in EMPTY}

        return apply

    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found, f = map_text(named, make, FIELDS, keep=["doc_id"], out="aligned")
    return materialise(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", f"{f}.*"), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, documents (with that link), best (whether no pair of its A id has more); stored."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents"))
    counts = materialise(counts.withColumn("a", F.shiftright("pair", 31)), "pair-counts")
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))  # no more rows than A has ids
    best = counts.join(most, "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))
    return materialise(best, "best-pairs")


def alignment_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared."""
    aligned = align(docs)
    counts = pair_counts(aligned)
    if counts.count() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("link"))
    links = links.select("row", F.col("link.pairs").alias("pair"), F.col("link.links").alias("n"))
    of_best = F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best")
    sums = links.join(counts, "pair").groupBy("row").agg(of_best, F.sum(F.col("n") * F.col("documents")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    return aligned.join(sums, "row", "left").select("doc_id", *numbers, zero("n_best"), zero("count_sum"), "groups_sha256", "n_shared")
