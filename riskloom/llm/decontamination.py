"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items, texts scanned once.

A text is normalised to its words (A-Z lowered; everything in ASCII but digits and letters separates), joined by single
blanks with a blank at both ends. The automaton holds every window of ``width`` item words in the same form, so a match
is an occurrence of the window on word boundaries. Matches are mapped back to words, and words to code points of the
original text.

Benchmarks are small next to the corpus, but their size is checked: items are dealt into blocks of at most
``block_chars`` characters; one block is broadcast at a time and the scans are chained in one pass without a shuffle
(each scan adds its hits to those found before). A block that is too large for memory therefore never exists, whatever
the benchmark's size (a single longer item is a block of its own).

Defined cases: null or empty texts have no words and are clean; items without words are ignored; equal items share
windows and are both reported; repeated rows are judged alike; an empty benchmark leaves every text clean; null item ids
are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import free_name, map_text

WIDTH = 10
#: Characters of benchmark text in one automaton. Windows repeat each character up to ``WIDTH`` times as trie nodes.
BLOCK_CHARS = 400_000

_TABLE = bytearray(b" " * 128 + bytes(range(128, 256)))
for _c in range(128):
    if chr(_c).isalnum():
        _TABLE[_c] = ord(chr(_c).lower())
_TABLE = bytes(_TABLE)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def normal_words(text: bytes) -> list[bytes]:
    """Words of a text: A-Z lowered, runs of ASCII digits, letters and any non-ASCII characters."""
    return text.translate(_TABLE).split()


def item_windows(text: bytes, width: int) -> set[bytes]:
    words = normal_words(text)
    if not words:
        return set()
    size = min(width, len(words))
    return {b" " + b" ".join(words[i : i + size]) + b" " for i in range(len(words) - size + 1)}


def build_automaton(items: list[tuple[str, bytes]], width: int):
    """Automaton whose values are (window bytes, positions in ``items`` that hold the window); None without windows."""
    import ahocorasick

    owners: dict[bytes, list[int]] = {}
    for k, (_, text) in enumerate(items):
        for window in item_windows(text, width):
            owners.setdefault(window, []).append(k)
    if not owners:
        return None
    automaton = ahocorasick.Automaton()
    for window, ks in owners.items():
        automaton.add_word(window.decode("latin-1"), (len(window), ks))
    automaton.make_automaton()
    return automaton


def scan(automaton, text: bytes) -> tuple[int, list[list[int]], set[int]]:
    """(number of words, merged [first word, end word) intervals that are hit, positions of the items found)."""
    words = normal_words(text)
    if automaton is None or not words:
        return len(words), [], set()
    line = b" " + b" ".join(words) + b" "
    found, ends = set(), []
    for end, (length, ks) in automaton.iter(line.decode("latin-1")):
        ends.append((end - length + 1, end))
        found.update(ks)
    if not ends:
        return len(words), [], found
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    pairs = np.searchsorted(blanks, np.array(ends))
    return len(words), merge([[int(a), int(b)] for a, b in pairs]), found


def merge(intervals: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def original_spans(text: bytes, intervals: list[list[int]]) -> list[list[int]]:
    """Word intervals as [start, end) code points of the original text."""
    if not intervals:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    starts = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)  # code points up to and with each byte
    point = lambda byte: int(starts[byte]) - 1 if byte < len(text) else int(starts[-1])
    return [[point(at[a][0]), point(at[b - 1][1])] for a, b in intervals]


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> list[list[tuple[str, bytes]]]:
    """The benchmark's items as lists, each read for itself and bounded by about ``block_chars`` characters."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("binary").alias("body"))
    items = items.where("item is not null and body is not null")
    total = items.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    if blocks == 1:
        return [[(r.item, bytes(r.body)) for r in items.collect()]]
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    return [
        [(r.item, bytes(r.body)) for r in dealt.where(F.col("block") == k).select("item", "body").collect()]
        for k in range(blocks)
    ]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    keep: list[str] | None = None,
    block_chars: int = BLOCK_CHARS,
) -> tuple[DataFrame, str]:
    """``docs`` with a struct column (its name is returned too): n_words, n_hit, items (ids as strings, sorted),
    spans (hit stretches of the original text as [start, end) code points)."""
    spark = docs.sparkSession
    fields = "n_words bigint, n_hit bigint, items array<string>, hits array<array<bigint>>, spans array<array<bigint>>"
    out, name, earlier = docs, "", []
    for items in item_blocks(benchmark, item_id, item_text, block_chars):
        sent = spark.sparkContext.broadcast(items)

        def make(sent=sent):
            automaton = build_automaton(sent.value, width)
            ids = [x for x, _ in sent.value]

            def apply(texts: list[bytes]) -> dict[str, list]:
                got = [scan(automaton, t) for t in texts]
                return {
                    "n_words": [n for n, _, _ in got],
                    "n_hit": [sum(b - a for a, b in hits) for _, hits, _ in got],
                    "items": [sorted({ids[k] for k in ks}) for _, _, ks in got],
                    "hits": [hits for _, hits, _ in got],
                    "spans": [original_spans(t, hits) for t, (_, hits, _) in zip(texts, got, strict=True)],
                }

            return apply

        carried = (docs.columns if keep is None else keep) if not earlier else [c for c in out.columns if c != raw]
        if not earlier:  # the text itself is carried between the scans under a free name
            raw = free_name(docs, "scan_text")
            out = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text}`").alias(raw))
        out, name = map_text(out, make, fields, text=raw, keep=[*carried, raw], out=f"found{len(earlier)}")
        earlier.append(name)
    out = out.drop(raw)
    if len(earlier) == 1:
        return out, name
    result = free_name(out, "found")
    every = lambda field: F.flatten(F.array(*[F.col(f"`{c}`.{field}") for c in earlier]))
    return out.withColumn(
        result,
        F.struct(
            F.col(f"`{name}`.n_words").alias("n_words"),
            _covered(every("hits")).alias("n_hit"),
            F.array_sort(F.array_distinct(every("items"))).alias("items"),
            F.array_sort(every("hits")).alias("hits"),
            F.array_sort(every("spans")).alias("spans"),
        ),
    ).drop(*earlier), result


def _covered(intervals):
    """Words covered by any of the [a, b) intervals."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to"))
    return F.aggregate(
        F.array_sort(intervals),
        start,
        lambda acc, x: F.struct(
            (acc.n + F.greatest(F.lit(0), x[1] - F.greatest(x[0], acc.to))).alias("n"),
            F.greatest(acc.to, x[1]).alias("to"),
        ),
        lambda acc: acc.n,
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document: the digest columns of :func:`find_contamination`."""
    found, f = find_contamination(docs, benchmark, keep=[doc_id], **options)
    return found.select(
        doc_id,
        F.col(f"{f}.n_words").alias("n_words"),
        F.col(f"{f}.n_hit").alias("n_hit"),
        F.size(f"{f}.items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", f"{f}.items").cast("binary"), 256).alias("items_sha256"),
        (F.col(f"{f}.n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without any hit, columns unchanged."""
    found, f = find_contamination(docs, benchmark, text=text, **options)
    return found.where(F.col(f"`{f}`.n_hit") == 0).drop(f)
