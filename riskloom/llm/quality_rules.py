"""Quality rules as a short-circuit cascade, in Spark SQL expressions only.

Document counts (words, symbols, repeated lines, words in repeated 8-word windows) are array expressions within the row: no shuffle,
however often a line or a window occurs. A cascade of rules is a `CASE WHEN`, which stops at the first rule that rejects a row;
its order does not change the verdict, only its cost. Each rule's cost (time of a job over a stored sample, less the time of an empty
one) and selectivity (share of the sample it rejects) are measured, and rules are ordered by rejections per cost. The sample holds
about ``SAMPLE_ROWS`` rows, chosen by a hash of the id.

Windows are compared by 64-bit hashes of their words' 64-bit hashes (xxhash64), within one document.

Defined cases: null and empty texts have no words and fail the base rules; a text with fewer than 8 words has no window; repeated rows
get the same verdict; an empty table gives no row (rules keep the order they were given in); other columns are carried on or
ignored as the caller selects.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import free_name, hash_share
from riskloom.session import materialise

SPACE = "[\\x20\\x09-\\x0D]+"
SAMPLE_ROWS = 2_000
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition on the columns of :func:`with_counts` (and any others of the table)."""

    name: str
    rejects: Column


def removed(text: Column, pattern: str) -> Column:
    """Number of characters that a pattern matches in a text."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("bigint")


def default_rules(text: str = "text") -> list[Rule]:
    """Thresholds for web prose; each is a plain comparison of integers."""
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.col("n_words")
    return [
        Rule("too_few_words", n < MIN_WORDS),
        Rule("repeated_windows", 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n),
        Rule("short_or_long_words", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        Rule("symbols", 2 * F.col("n_symbols") > n),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.size(F.split(body, "\n", -1))),
        Rule("shouting", 10 * removed(body, "[A-Z]+") > 7 * removed(body, "[A-Za-z]+")),
        Rule("exclamations", 2 * removed(body, "[!?]+") > n),
        Rule("digits", 2 * removed(body, "[0-9]+") > F.col("word_chars")),
    ]


def with_counts(docs: DataFrame, text: str = "text", carried: list[str] | None = None) -> DataFrame:
    """``carried`` columns (default: all) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint).

    Columns of these names that the table has already are replaced.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kept = [F.col(f"`{c}`") for c in (docs.columns if carried is None else carried) if c.lower() not in new]
    words, lines, hashes, windows = (free_name(docs, c) for c in ("words", "lines", "hashes", "windows"))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    step = docs.select(
        *kept,
        F.array_remove(F.split(body, SPACE, -1), "").alias(words),
        F.filter(F.split(body, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias(lines),
        removed(body, "[#*$%&|<>]+").alias("n_symbols"),
    )
    names = [c for c in step.columns if c not in (words, lines)]
    step = step.select(
        *[F.col(f"`{c}`") for c in names],
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size(words) >= WINDOW, F.transform(words, lambda w: F.xxhash64(w))).alias(hashes),
    )
    names = [c for c in step.columns if c != hashes]
    window = lambda i: F.xxhash64(*[F.get(F.col(hashes), i + k) for k in range(WINDOW)])
    step = step.select(
        *[F.col(f"`{c}`") for c in names],
        F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), window).alias(windows),
    )
    repeated = F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_covered_words(F.col(windows)))
    return step.select(
        *[F.col(f"`{c}`") for c in names],
        F.coalesce(F.when(F.col(windows).isNotNull(), repeated), F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


def _covered_words(windows: Column) -> Column:
    """Words in those windows of a row that occur twice or more: sort (hash, place), keep places whose neighbour is equal,
    add up the lengths of their union in one fold over the ordered places."""
    placed = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    # each element with its neighbours, by zipping the sorted array with itself moved by one place either way
    nothing = F.array(F.lit(None).cast("struct<w: bigint, i: int>"))
    n = F.size(placed)
    near = F.arrays_zip(
        placed.alias("me"),
        F.concat(nothing, F.slice(placed, F.lit(1), n - 1)).alias("before"),
        F.concat(F.slice(placed, F.lit(2), n - 1), nothing).alias("after"),
    )
    same = F.filter(
        near,
        lambda x: F.coalesce(x["me"]["w"] == x["before"]["w"], F.lit(False))
        | F.coalesce(x["me"]["w"] == x["after"]["w"], F.lit(False)),
    )
    places = F.array_sort(F.transform(same, lambda x: x["me"]["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    return F.aggregate(
        places,
        start,
        lambda acc, p: F.struct((acc["n"] + p + WINDOW - F.greatest(p, acc["to"])).alias("n"), (p + WINDOW).alias("to")),
        lambda acc: acc["n"],
    )


def cascade(rules: list[Rule]) -> Column:
    """True for rows that no rule rejects; a row is tested until the first rule that rejects it."""
    if not rules:
        return F.lit(True)
    test = F.when(F.coalesce(rules[0].rejects, F.lit(False)), False)
    for r in rules[1:]:
        test = test.when(F.coalesce(r.rejects, F.lit(False)), False)
    return test.otherwise(True)


def measure(sample: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, share of the sample it rejects, seconds it takes over the sample)."""

    def run(what: Column) -> tuple[int, float]:
        took, hits = [], 0
        for _ in range(2):  # the first run compiles the code
            began = time.perf_counter()
            hits = sample.agg(F.count_if(what)).first()[0]
            took.append(time.perf_counter() - began)
        return hits, min(took)

    rows, empty = run(F.lit(True))
    found = []
    for r in rules:
        hits, took = run(r.rejects)
        found.append((r, hits / max(rows, 1), max(took - empty, 1e-4)))
    return found


def order_rules(docs: DataFrame, rules: list[Rule], doc_id: str = "doc_id", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by measured rejections per cost, best first. ``docs`` has text and id; counts are added to the sample."""
    n = docs.count()
    chosen = docs if n <= rows else docs.where(F.coalesce(hash_share(doc_id, rows / n), F.lit(False)))
    sample = materialise(with_counts(chosen), "rule-sample")
    measured = measure(sample, rules)
    return [r for r, share, cost in sorted(measured, key=lambda m: -m[1] / m[2])]


def rules_report(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, the four counts, base_failed, kept."""
    docs = docs.select("doc_id", "text")
    ordered = order_rules(docs, default_rules() if rules is None else rules)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return with_counts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & cascade(ordered)).alias("kept"),
    )


def keep_good(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The rows that no rule rejects, columns unchanged."""
    ordered = order_rules(docs.select("doc_id", "text"), default_rules() if rules is None else rules)
    row = free_name(docs, "whole_row")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), "text")
    return with_counts(packed).where(cascade(ordered)).select(f"{row}.*")
