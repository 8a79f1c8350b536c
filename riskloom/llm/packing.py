"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

Tokenising: blanks split a text into chunks that the tokenizer treats independently (its pre-tokenizer never crosses white space
and its normaliser works within a chunk), so each task keeps a bounded cache of chunk -> ids and only asks the tokenizer for
new chunks. Texts that may hold a special token's string go to the tokenizer whole. Token ids never leave the task: a piece
becomes one narrow row (start, length, checksum).

Packing: pieces are dealt into blocks of about ``BLOCK_ITEMS`` by a hash of a stored row number, so every block is a like
sample whatever source or length dominates, and a block is bounded. Best-fit decreasing solves each block; where that misses the
block's lower bound, ``ISLANDS`` populations evolve it: crossover injects whole well-filled bins of one parent into the other,
removes the bins that hold duplicates, and best-fits the displaced pieces. After each round every island sends its elite to the
next one (a shuffle of narrow rows), and in the end the best island wins. No step sees more than one block.

Defined cases: null and empty texts give one piece holding the end token only; longer documents than a sequence give full pieces
and a rest; repeated rows and null ids are packed as documents of their own; an empty table gives no row.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import free_name, map_text
from riskloom.session import materialise

CAPACITY, END_ID = 4096, 1
VOCABULARY = "word_bpe_49k.json"
CACHE_CHUNKS = 1_000_000
BLOCK_ITEMS = 8192
ISLANDS, ROUNDS, POPULATION, GENERATIONS = 3, 2, 6, 10


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_TOKENIZERS: dict = {}  # of this worker process, so that its tasks share the cache


class ChunkTokenizer:
    """Ids (little-endian unsigned 32-bit) of texts, by a cache of white-space-separated chunks.

    Arrow splits a slice of texts and finds its distinct chunks, so the cache is asked once for each of them; ids are laid out by numpy.
    Chunks that are not in the cache lose punctuation behind an ASCII letter (the pre-tokenizer cuts there too). Words of letters only are
    one pre-token each: those of a-z go to the tokenizer's model, others in one call whose ids are dealt out by pre-token. The first
    CACHE_CHUNKS chunks and their parts stay cached, later ones for one slice of texts only.
    """

    MARKS = b".,;:!?%#$&*|"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {b"": b""}

    def each(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text by a call for itself."""
        plain = [t.decode("utf-8", "replace") for t in texts]
        found = self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)  # without character offsets
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def together(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters only, by one call for all."""
        found = self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        owner = np.array(found.word_ids, np.int64)
        ends = np.flatnonzero(np.diff(owner, append=owner[-1] + 1)) + 1
        if len(ends) != len(words):  # lower-casing made a letter into several characters
            return self.each(words)
        ends = (4 * ends).tolist()
        return [ids[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def alone(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of the letters a-z only: normaliser and pre-tokenizer leave these as they are, so the model gets them at once."""
        tokenize, flat, ends = self.tokenizer.model.tokenize, [], []
        for w in words:
            flat += [t.id for t in tokenize(w.decode())]
            ends.append(4 * len(flat))
        ids = np.array(flat, "<u4").tobytes()
        return [ids[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that are not in the cache, and of the parts of those that are cut."""
        known, cut, new = self.known, [], set()
        for c in chunks:
            if not c.isalpha():
                core = c.rstrip(self.MARKS)
                if len(core) < len(c) and core and 97 <= core[-1] <= 122:
                    cut.append((c, core, c[len(core) :]))
                    continue
            new.add(c)
        new.update(w for _, *parts in cut for w in parts if w not in known)
        plain, letters, others = [], [], []
        for w in new:
            (plain if w.isalpha() else letters if w.decode("utf-8", "replace").isalpha() else others).append(w)
        got: dict[bytes, bytes] = {}
        for encode, part in ((self.alone, plain), (self.together, letters), (self.each, others)):
            for at in range(0, len(part), 20_000):
                some = part[at : at + 20_000]
                got.update(zip(some, encode(some), strict=True))
        for c, core, tail in cut:
            got[c] = (got[core] if core in got else known[core]) + (got[tail] if tail in got else known[tail])
        return got

    def encode(self, texts: list[bytes]) -> list[bytes]:
        whole = [b"<|" in t for t in texts]
        lowered = pc.ascii_lower(pa.array([b"" if w else t for t, w in zip(texts, whole, strict=True)], pa.binary()).view(pa.string()))
        lists = pc.ascii_split_whitespace(lowered)  # gives empty chunks where blanks lead or trail
        coded = lists.values.dictionary_encode()
        chunks = distinct_chunks(coded.dictionary)
        known, fresh = self.known, {}
        missing = [c for c in chunks if c not in known]
        if missing:
            fresh = self.learn(missing)
            known.update(fresh)
        ids, ends = laid_out([known[c] for c in chunks], np.asarray(coded.indices))
        ends = (4 * ends[np.asarray(lists.offsets)]).tolist()
        out = [self.each([t])[0] if w else ids[i:j] for t, w, i, j in zip(texts, whole, ends[:-1], ends[1:], strict=True)]
        if len(known) > CACHE_CHUNKS:
            for c in fresh:
                del known[c]
        return out


def distinct_chunks(values: pa.Array) -> list[bytes]:
    """Distinct strings without white space as bytes (splitting their join is faster than converting each)."""
    if not len(values):
        return []
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(values)], values.cast(pa.binary())), b" ")
    out = joined[0].as_py().split()
    empty = pc.index(values, "").as_py()
    if empty >= 0:
        out.insert(empty, b"")
    return out


def laid_out(coded: list[bytes], order: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids ``coded[k]`` for each k of ``order``, one after the other, and the number of ids before each place and at the end."""
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    starts = np.cumsum(sizes) - sizes
    counts = sizes[order]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    at = np.repeat(starts[order] - ends[:-1], counts)
    at += np.arange(len(at))
    return np.frombuffer(b"".join(coded), "<u4")[at].tobytes(), ends


def pieces_of(ids: bytes, capacity: int) -> list[dict]:
    """The pieces of one document's ids (bytes) with the end token put behind."""
    ids += END_ID.to_bytes(4, "little")
    step = 4 * capacity
    return [
        {"piece": k, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
        for k, at in enumerate(range(0, len(ids), step))
        for part in (ids[at : at + step],)
    ]


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    path = path or vocabulary_path()

    def make():
        tokenizer = _TOKENIZERS.get(path) or ChunkTokenizer(path)
        _TOKENIZERS[path] = tokenizer
        return lambda texts: {"pieces": [pieces_of(ids, capacity) for ids in tokenizer.encode(texts)]}

    kind = "pieces array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint>>"
    found, f = map_text(docs, make, kind, text=text, keep=[doc_id], out="tokens")
    return found.select(F.col(doc_id).alias("doc_id"), F.inline(f"{f}.pieces"))


# -- one block ---------------------------------------------------------------------------------------------------------


class Bins:
    """Bins with a best-fit index: bins by free room, and a bit set of the rooms that occur."""

    def __init__(self, capacity: int):
        self.capacity, self.room, self.by_room, self.rooms = capacity, [], {}, 0

    def add_bin(self, room: int) -> int:
        self.room.append(room)
        self.put(len(self.room) - 1)
        return len(self.room) - 1

    def put(self, k: int) -> None:
        self.by_room.setdefault(self.room[k], []).append(k)
        self.rooms |= 1 << self.room[k]

    def place(self, size: int) -> int:
        """The bin that the piece fits best, a new one if none has room."""
        fits = self.rooms >> size
        if not fits:
            return self.add_bin(self.capacity - size)
        room = size + (fits & -fits).bit_length() - 1
        bins = self.by_room[room]
        k = bins.pop()
        if not bins:
            self.rooms &= ~(1 << room)
        self.room[k] = room - size
        self.put(k)
        return k


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int, bins: Bins | None = None, out: np.ndarray | None = None) -> np.ndarray:
    bins = bins or Bins(capacity)
    out = np.full(len(sizes), -1, np.int64) if out is None else out
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        out[i] = bins.place(size)
    return out


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    return max(math.ceil(int(sizes.sum()) / capacity), int((2 * sizes > capacity).sum()))


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Bins of ``b`` among the best filled go whole into ``a``; bins of ``a`` with duplicates go; their other pieces are
    best-fitted, large ones first."""
    load_b = np.bincount(b, sizes)
    good = np.argsort(-load_b, kind="stable")[: max(1, int(len(load_b) * rng.uniform(0.3, 0.7)))]
    picked = np.zeros(len(load_b), bool)
    picked[rng.choice(good, max(1, len(good) // 3), replace=False)] = True
    injected = picked[b]
    load_a = np.bincount(a, sizes)
    broken = np.zeros(len(load_a), bool)
    broken[a[injected]] = True
    worst = np.argsort(load_a, kind="stable")[: 1 + int(rng.integers(4))]  # mutation: the emptiest bins are dissolved
    broken[worst] = True
    child = np.where(injected, len(load_a) + b, np.where(broken[a], -1, a))
    kept = child >= 0
    names, child[kept] = np.unique(child[kept], return_inverse=True)
    bins = Bins(capacity)
    for room in (capacity - np.bincount(child[kept], sizes[kept], minlength=len(names))).astype(int).tolist():
        bins.add_bin(room)
    free = np.flatnonzero(~kept)
    return best_fit(sizes, free[np.argsort(-sizes[free], kind="stable")], capacity, bins, child)


def fitness(x: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """(bins, minus the mean squared filling): smaller is better."""
    load = np.bincount(x, sizes) / capacity
    return len(load), -float((load**2).mean())


def evolve(sizes: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int) -> np.ndarray:
    """The best solution of one island after GENERATIONS, from the elites it was given."""
    rng = np.random.default_rng(seed)
    least = lower_bound(sizes, capacity)
    people = list(elites)
    while len(people) < POPULATION:  # best fit over orders blurred at random
        people.append(best_fit(sizes, np.argsort(-sizes * rng.uniform(0.7, 1.3, len(sizes)), kind="stable"), capacity))
    rank = lambda x: fitness(x, sizes, capacity)
    people.sort(key=rank)
    for _ in range(GENERATIONS):
        if rank(people[0])[0] <= least:
            break
        young = []
        for _ in range(POPULATION // 2):
            i, j = sorted(rng.choice(len(people), 2, replace=False))
            young.append(crossover(people[i], people[j], sizes, capacity, rng))
        people = sorted([*people, *young], key=rank)[:POPULATION]
    return people[0]


# -- all blocks --------------------------------------------------------------------------------------------------------


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a positive `length` of at most ``capacity``) with sequence_id and offset (columns of these names are replaced)."""
    pieces = pieces.drop("sequence_id", "offset")
    own = ("row_no", "block_no", "island_no", "bin_no", "is_done", "came_from")
    row, block, island, bin_no, done, source = (free_name(pieces, c) for c in own)
    names = list(pieces.columns)
    stored = materialise(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    n = stored.count()
    blocks = max(1, math.ceil(n / BLOCK_ITEMS))
    dealt = stored.withColumn(block, F.pmod(F.xxhash64(row), F.lit(blocks)))

    def solve(pdf):
        pdf = pdf.sort_values(["length", row], ascending=[False, True], kind="stable").reset_index(drop=True)
        sizes = pdf["length"].to_numpy()
        pdf[bin_no] = best_fit(sizes, np.arange(len(sizes)), capacity)
        pdf[done] = int(pdf[bin_no].max()) + 1 <= lower_bound(sizes, capacity)
        return pdf

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    types += f", `{bin_no}` bigint"
    first = materialise(dealt.groupBy(block).applyInPandas(solve, f"{types}, `{done}` boolean"), "packed")

    def island_round(pdf):
        """Rows of one block and island: its own elite and those that came in (column ``source``)."""
        pdf = pdf.sort_values([source, row], kind="stable")
        groups = [g for _, g in pdf.groupby(source, sort=True)]
        base = groups[0].drop(columns=[source]).reset_index(drop=True)
        seed = int(base[block].iloc[0]) * 1000 + int(base[island].iloc[0])
        base[bin_no] = evolve(base["length"].to_numpy(), [g[bin_no].to_numpy() for g in groups], capacity, seed)
        return base

    def best_island(pdf):
        return min(
            (g for _, g in pdf.sort_values([island, row], kind="stable").groupby(island, sort=True)),
            key=lambda g: fitness(g[bin_no].to_numpy(), g["length"].to_numpy(), capacity),
        ).drop(columns=[island])

    def offsets(pdf):
        pdf = pdf.sort_values([bin_no, "length", row], ascending=[True, False, True], kind="stable")
        pdf["offset"] = (pdf.groupby(bin_no)["length"].cumsum() - pdf["length"]).astype("int64")
        pdf["sequence_id"] = pdf[block] * (1 << 24) + pdf[bin_no]
        return pdf[[*names, "sequence_id", "offset"]]

    state = first.where(~F.col(done)).drop(done)
    state = state.withColumns({island: F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))), source: F.lit(0)})
    for k in range(ROUNDS):
        state = state.groupBy(block, island).applyInPandas(island_round, f"{types}, `{island}` int")
        if k < ROUNDS - 1:  # each elite stays and goes on to the next island
            to = F.explode(F.array(F.col(island), F.pmod(F.col(island) + 1, F.lit(ISLANDS))))
            state = state.withColumn(source, F.col(island)).withColumn(island, to)
    evolved = state.groupBy(block).applyInPandas(best_island, types)
    packed = first.where(F.col(done)).drop(done).unionByName(evolved)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return packed.groupBy(block).applyInPandas(offsets, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(docs, path, capacity), capacity)
