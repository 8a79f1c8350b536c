"""Language identification by cross-parsing entropy.

Per language, a suffix automaton is built of a bounded sample of labelled text. A text is parsed greedily into the
longest phrases that occur in a language's reference; few phrases mean that the language's text describes it well. The
estimate of the cross entropy is phrases * log2(reference length) / letters and blanks of the text, and the language with the least wins.

The automata are flattened into dense transition tables (state x character class), in which a failed transition
restarts at the root and carries how many phrases it ended. Texts are parsed in blocks of ``BLOCK`` characters, all
blocks of a slice in lockstep, so a character costs a few vector operations whatever the phrase lengths are. Every block
is parsed to its end: whole texts count.

The reference text (at most ``REFERENCE`` characters a language) is what is broadcast; each Python worker builds the
tables once.

Phrases get longer as a reference grows, so two languages are compared at the length of the shorter one's reference. That
cut holds for this comparison only: languages with longer references are compared with each other at their own length, and
the best of them then meets the languages with shorter ones.

Defined cases: null, empty and letterless texts give `und` with score 0, and so do all texts if nothing can be learned;
ties go to the language first in order; languages with null names or without letters are not learned, nor are those with
less than ``LEAST`` characters of reference that is also less than a quarter of the longest one.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import map_text

#: Characters of normalised reference text for each language, and the documents and characters of each they come from.
REFERENCE, SAMPLE_DOCS, SAMPLE_CHARS = 32_000, 96, 1_000
#: A language needs so much reference text, or a quarter of the longest reference.
LEAST = 2_000
BLOCK = 512
UNDETERMINED = "und"
_BREAK = "\n"  # between the excerpts of a reference; never in a normalised text
_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    """Flags of the code points that are letters."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def normalise(text: str) -> np.ndarray:
    """Code points of the text in lower case, each run of other characters than letters being one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first character after a letter becomes the blank
    return np.where(is_letter, points, 32)[keep]


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of a text (state 0 is the root): its paths from the root are the substrings."""
    moves: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


class Parser:
    """Counts the phrases of texts against one reference per language."""

    def __init__(self, references: dict[str, str]):
        self.languages = sorted(references)
        alphabet = sorted({c for r in references.values() for c in r} - {_BREAK})
        self.width = len(alphabet) + 2  # classes: 0 padding, 1 unknown character, then the alphabet
        self.classes = np.ones(0x110000, np.int32)
        for k, c in enumerate(alphabet):
            self.classes[ord(c)] = k + 2
        self.sizes = np.array([len(references[x]) for x in self.languages], np.int64)
        self.tables = [self.table(references[x], alphabet) for x in self.languages]
        #: For each length of a reference, from the longest: a table of it for every language that has as much text.
        self.levels = {
            int(n): {
                k: self.tables[k] if self.sizes[k] == n else self.table(references[x][:n], alphabet)
                for k, x in enumerate(self.languages)
                if self.sizes[k] >= n
            }
            for n in np.unique(self.sizes)[::-1]
        }

    def table(self, reference: str, alphabet: list[str]) -> np.ndarray:
        """Flat table: [state * width + class] -> next state * width + (phrases ended << 29)."""
        moves, n = suffix_automaton(reference), self.width
        column = {c: k + 2 for k, c in enumerate(alphabet)}
        root = np.full(n, 1 << 29, np.int32)  # at the root an unknown character is a phrase of its own
        for c, to in moves[0].items():
            if c in column:
                root[column[c]] = to * n
        restart = root + (1 << 29)
        out = np.tile(restart, (len(moves), 1))
        out[0] = root
        rows = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
        cols = np.array([column.get(c, -1) for m in moves for c in m], np.int64)
        to = np.array([t for m in moves for t in m.values()], np.int64)
        ok = cols >= 0
        out[rows[ok], cols[ok]] = to[ok] * n
        out[:, 0] = np.arange(len(moves)) * n  # padding stays
        return out.ravel()

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrase counts, texts x languages, of normalised texts, against whole references."""
        return self.parse(texts, self.tables)

    def parse(self, texts: list[np.ndarray], tables: list[np.ndarray]) -> np.ndarray:
        """Phrase counts, texts x tables, of normalised texts."""
        sizes = np.array([len(t) for t in texts], np.int64)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        grid = np.zeros((int(blocks.sum()), BLOCK), np.int32)
        flat, first = grid.ravel(), np.concatenate([[0], np.cumsum(blocks)]) * BLOCK
        for t, at in zip(texts, first[:-1], strict=True):
            flat[at : at + len(t)] = self.classes[t]
        steps = np.ascontiguousarray(grid.T)
        out = np.zeros((len(texts), len(tables)), np.int64)
        mask = np.int32((1 << 29) - 1)
        for k, table in enumerate(tables):
            state = np.zeros(len(grid), np.int32)
            count = np.zeros(len(grid), np.int32)
            for classes in steps:
                moved = table.take(state + classes)
                count += moved >> 29
                state = moved & mask
            count += state > 0  # the phrase that the block's end cuts
            out[:, k] = np.bincount(owner, count, minlength=len(texts))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        flat = [normalise(t) for t in texts]
        sizes = np.array([len(t) for t in flat], np.int64)
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        rows = np.arange(len(texts))
        best, entropies = np.full(len(texts), -1), {}
        for n, tables in self.levels.items():
            entropy = np.full((len(texts), len(self.languages)), np.inf)
            entropy[:, list(tables)] = self.parse(flat, list(tables.values())) * math.log2(max(2, n)) / np.maximum(sizes, 1)[:, None]
            entropies[n] = entropy
            rivals = (self.sizes == n)[None, :] | (np.arange(len(self.languages)) == best[:, None])
            best = np.where(rivals, entropy, np.inf).argmin(axis=1)
        # the least distance to another language, each at the length that the two have in common
        score = np.ones(len(texts))
        common = np.minimum(self.sizes[None, :], self.sizes[best][:, None])
        common[rows, best] = -1
        for n, entropy in entropies.items():
            second = np.where(common == n, entropy, np.inf).min(axis=1)
            met = np.isfinite(second)
            score[met] = np.minimum(score[met], 1 - entropy[rows, best][met] / np.maximum(second[met], 1e-9))
        score = np.maximum(score, 0)
        return (
            [self.languages[b] if n else UNDETERMINED for b, n in zip(best, sizes, strict=True)],
            [float(s) if n else 0.0 for s, n in zip(score, sizes, strict=True)],
        )


def learn_references(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, str]:
    """Normalised reference text per language from at most SAMPLE_DOCS excerpts of SAMPLE_CHARS characters each.

    The rows are chosen by a hash of id and language (a ranked window whose limit Spark applies before its shuffle, on
    narrow rows), and excerpts start at a hashed place; of rows that repeat an id and language, the least excerpt counts. The
    driver gets at most SAMPLE_DOCS * SAMPLE_CHARS characters for each language.
    """
    rows = labelled.select(*[F.col(f"`{c}`").alias(n) for c, n in ((doc_id, "id"), (text, "text"), (lang, "lang"))])
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull())
    by = Window.partitionBy("sample_lang").orderBy(F.xxhash64("sample_id"), "sample_id")
    chosen = (
        rows.select(F.col("id").alias("sample_id"), F.col("lang").alias("sample_lang"))
        .withColumn("place", F.row_number().over(by))
        .where(F.col("place") <= SAMPLE_DOCS)
        .select("sample_id", "sample_lang")
        .distinct()
    )
    room = F.greatest(F.lit(1), F.length("text") - F.lit(SAMPLE_CHARS - 1))
    excerpt = F.substr(F.col("text"), (F.lit(1) + F.pmod(F.xxhash64("id"), room)).cast("int"), F.lit(SAMPLE_CHARS))
    match = (F.col("id") == F.col("sample_id")) & (F.col("lang") == F.col("sample_lang"))
    # at most SAMPLE_DOCS narrow rows for each language
    got = rows.join(F.broadcast(chosen), match).groupBy("sample_lang", "sample_id").agg(F.min(excerpt).alias("excerpt"))
    parts: dict[str, list[str]] = {}
    for r in sorted(got.collect(), key=lambda r: (r.sample_lang, r.sample_id, r.excerpt)):
        points = normalise(r.excerpt)
        if len(points):
            parts.setdefault(r.sample_lang, []).append(points.astype("<u4").tobytes().decode("utf-32-le"))
    joined = {k: _BREAK.join(v) for k, v in parts.items()}
    least = min(LEAST, max(map(len, joined.values()), default=0) / 4)
    return {k: v[: reference_size(len(v))] for k, v in joined.items() if len(v) >= least}


def reference_size(n: int) -> int:
    """REFERENCE, or the last quarter power of two up to ``n``: few lengths to compare at, and none is cut by another's."""
    return REFERENCE if n >= REFERENCE else math.floor(2 ** (math.floor(4 * math.log2(max(n, 1))) / 4))


def identify(
    docs: DataFrame, references: dict[str, str], text: str = "text", keep: list[str] | None = None
) -> tuple[DataFrame, str]:
    """``docs`` with a struct column (its name is returned too): lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(references)

    def make():
        parser = Parser(sent.value)

        def apply(texts: list[bytes]) -> dict[str, list]:
            langs, scores = parser.predict([t.decode("utf-8", "replace") for t in texts])
            return {"lang_pred": langs, "score": scores}

        return apply

    return map_text(docs, make, "lang_pred string, score double", text=text, keep=keep, out="language")


def held_out(doc_id: str, folds: int, fold: int):
    """True for the rows of a fold: crc32 of the id as text, modulo the number of folds (null ids: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def language_report(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents outside the fold."""
    references = learn_references(docs.where(~held_out("doc_id", folds, fold)))
    found, f = identify(docs, references, keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), f"{f}.lang_pred", f"{f}.score")
