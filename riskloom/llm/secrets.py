"""Secret scan in Spark SQL expressions only: fixed patterns, and a randomness battery for other tokens.

Fixed patterns (`assign`, `access`, `hex`) give the base spans. Offsets come from splitting the text at the pattern and adding up the
lengths of pieces and matches, so they are exact code points.

Battery: every other run of 20 or more token characters is a candidate, unless it has no letter or is an ordinary word (small letters, the
first may be a capital). Its encoding is inferred (hexadecimal, base32, base64), its characters become digits of that alphabet, and three
tests ask how far it is from random digits: chi-squared uniformity of the alphabet, the runs test about the alphabet's middle, and lag-1
serial correlation. Their squared z-scores add up to one distance (about chi-squared with 3 degrees of freedom for a random token).

False discoveries: the null are made tokens of ordinary letters (:func:`null_shares`: the same for every corpus, of the least length of each
band, in each encoding). A candidate's p-value is the probability that such a token is at least as random, by importance sampling: tokens
are drawn from a mixture of letter frequencies between English and even ones and weighted back, so that the far tail is known too and few
secrets among many candidates can be told. The corpus's own long words can only raise it: their share at least as random, drawn
towards the null's by ``PRIOR_WORDS`` words' worth, so it moves continuously with their number. Within each encoding and band the
Benjamini-Hochberg step-up over the bins gives the largest distance at which the expected share of false findings stays under ``FDR``.
Tokens that overlap a base span are not counted. Only encodings x bands x bins numbers reach the driver.

Defined cases: null = empty text, no span; a token that overlaps a base span is not reported again; repeated rows are scanned alike; an empty table gives no row.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import free_name

KINDS = ("assign", "access", "hex", "random")
ASSIGN = (
    "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"  # a run that is long enough is a whole match of the unbounded pattern
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
MIN_ASSIGNED = 12
FDR, BINS, BIN_WIDTH = 0.05, 120, 0.5
#: Words of the corpus that weigh as much as the made null.
PRIOR_WORDS = 200
BANDS = (20, 24, 32, 40, 48)
#: Elements of an array that are handled together, so that the work in a text with n spans grows with n ** 1.5 at most.
BLOCK = 128
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BASE32, BASE16 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef"
ENCODINGS = (BASE16, BASE32, BASE64)
#: Made tokens of the null for each encoding and band, how even their letters are drawn (0: as in English, 1: all alike), and how often
#: English has the letters a to z (per 10,000).
NULL_TOKENS = 200_000
EVENNESS = (0.0, 0.25, 0.5, 0.75, 1.0)
LETTERS = (817, 149, 278, 425, 1270, 223, 202, 609, 697, 15, 77, 403, 241, 675, 751, 193, 10, 599, 633, 906, 276, 98, 236, 15, 197, 7)
SPAN = "struct<start: int, kind: int, end: int, token: string>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once (inside a lambda an expression is worked out for every element)."""
    return F.get(F.transform(F.array(value), body), 0)


def in_blocks(items: Column) -> Column:
    """An array (worked out already) cut into blocks of BLOCK elements; an empty array has one empty block."""
    last = F.greatest(F.floor((F.size(items) - 1) / F.lit(BLOCK)), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))


def running_sums(lengths: Column) -> Column:
    """Inclusive running sums of an array of int. Appending copies the array, so it is done within blocks and over their sums."""
    grow = lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)
    none = F.array().cast("array<int>")
    within = F.transform(in_blocks(lengths), lambda block: F.aggregate(block, none, grow))
    total = lambda sums: F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0))

    def joined(t: Column) -> Column:
        return F.flatten(F.transform(t["within"], lambda sums, k: F.transform(sums, lambda x: x + F.get(t["upto"], k) - total(sums))))

    def with_totals(sums: Column) -> Column:
        return let(F.struct(sums.alias("within"), F.aggregate(F.transform(sums, total), none, grow).alias("upto")), joined)

    return let(within, with_totals)


def matches(text: Column, pattern: str, kind: int, long_enough=None) -> Column:
    """Spans of a pattern's matches in a text, leftmost and not overlapping; ``long_enough``: condition on group 2."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if long_enough else found
    pieces = F.split(text, pattern, -1)  # one more than the matches
    pairs = F.arrays_zip(pieces.alias("piece"), found.alias("match"), groups.alias("value"))

    def spans(t: Column) -> Column:
        def span(x: Column, k: Column) -> Column:
            end = F.get(t["ends"], k)
            return F.struct((end - F.length(x["match"])).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("token"),
                            (F.lit(True) if long_enough is None else long_enough(x["value"])).alias("keep"))

        kept = F.filter(F.transform(F.filter(t["pairs"], lambda x: x["match"].isNotNull()), span), lambda x: x["keep"])
        return F.transform(kept, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "kind", "end", "token")]))

    def with_ends(t: Column) -> Column:
        return let(F.struct(t["pairs"].alias("pairs"), running_sums(t["lengths"]).alias("ends")), spans)

    def with_lengths(p: Column) -> Column:
        lengths = F.transform(p, lambda x: F.length(x["piece"]) + F.coalesce(F.length(x["match"]), F.lit(0)))
        return let(F.struct(p.alias("pairs"), lengths.alias("lengths")), with_ends)

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(F.size(found) == 0, none).otherwise(let(pairs, with_lengths).cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    return F.array_sort(
        F.concat(
            matches(text, ASSIGN, 0, lambda value: F.length(value) >= MIN_ASSIGNED),
            matches(text, ACCESS, 1),
            matches(text, HEX, 2),
        )
    )


def digits_of(token: Column) -> Column:
    return F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")


def by_encoding(plain: Column, a, b, c) -> Column:
    """The value for hexadecimal, base32 or base64 digits."""
    return F.when(plain.rlike("^([0-9a-f]+|[0-9A-F]+)$"), a).when(plain.rlike("^[A-Z2-7]+$"), b).otherwise(c)


def encoding(token: Column) -> Column:
    """Index in ENCODINGS."""
    return by_encoding(digits_of(token), F.lit(0), F.lit(1), F.lit(2))


def distance(token: Column) -> Column:
    """Sum of the squared z-scores of the three tests against random digits of the inferred alphabet."""
    plain = digits_of(token)
    case = lambda a, b, c: by_encoding(plain, a, b, c)
    body = case(F.lower(plain), plain, plain)
    size = case(F.lit(16.0), F.lit(32.0), F.lit(64.0))
    alphabet = case(F.lit(BASE16), F.lit(BASE32), F.lit(BASE64))
    # one struct, so that the parts are worked out once for each token
    parts = F.transform(
        F.array(F.struct(body.alias("s"), size.alias("k"), alphabet.alias("abc"))),
        lambda t: F.struct(
            F.length(t["s"]).cast("double").alias("n"),
            t["k"].alias("k"),
            # how often each character is there, squared; the one character of a token that no alphabet has is an inner =
            F.aggregate(
                F.split(F.concat(t["abc"], F.lit("=")), ""), F.lit(0.0),
                lambda acc, c: acc + F.pow((F.length(t["s"]) - F.length(F.replace(t["s"], c, F.lit("")))).cast("double"), 2.0),
            ).alias("same"),
            F.transform(F.split(t["s"], ""), lambda c: (F.instr(t["abc"], c) - 1).cast("double")).alias("digits"),
        ),
    )

    def combine(t: Column) -> Column:
        n, k, digits = t["n"], t["k"], t["digits"]
        start = F.struct(
            *[F.lit(0.0).alias(c) for c in ("high", "turns", "product")], F.lit(None).cast("double").alias("last")
        )
        middle = (k - 1) / 2

        def step(acc: Column, d: Column) -> Column:
            known, is_high = acc["last"].isNotNull(), (d > middle).cast("double")
            turn = known & ((d > middle) != (acc["last"] > middle))
            product = F.when(known, (d - middle) * (acc["last"] - middle)).otherwise(0.0)
            return F.struct(
                (acc["high"] + is_high).alias("high"),
                (acc["turns"] + F.when(turn, 1.0).otherwise(0.0)).alias("turns"),
                (acc["product"] + product).alias("product"), d.alias("last"),
            )

        def z_scores(acc: Column) -> Column:
            chi = (k / n * t["same"] - n - (k - 1)) / F.sqrt(2 * (k - 1))
            low = n - acc["high"]
            mean = 2 * acc["high"] * low / n + 1
            var = (mean - 1) * (mean - 2) / (n - 1)
            runs = F.when(var > 0, (acc["turns"] + 1 - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(F.sqrt(n))
            serial = acc["product"] / ((n - 1) * (k * k - 1) / 12) * F.sqrt(n - 1)
            # too even an alphabet is no sign of ordinary text: only an excess counts
            return F.pow(F.greatest(chi, F.lit(0.0)), 2) + F.pow(runs, 2) + F.pow(serial, 2)

        return F.when(n >= 8, F.aggregate(digits, start, step, z_scores)).otherwise(F.lit(BINS * BIN_WIDTH))

    return F.get(F.transform(parts, combine), 0)


def band(token: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(BANDS):
        out = F.when(F.length(token) >= least, F.lit(k)).otherwise(out)
    return out


def bin_of(token: Column) -> Column:
    return F.least(F.floor(distance(token) / BIN_WIDTH), F.lit(BINS - 1)).cast("int")


def is_word(token: Column) -> Column:
    return token.rlike("^[A-Z]?[a-z]+$")


def is_candidate(token: Column) -> Column:
    return token.rlike("[A-Za-z]") & ~is_word(token)


def digit_distances(v: np.ndarray, k: int) -> np.ndarray:
    """What :func:`distance` gives for rows of digits of an alphabet of k characters."""
    rows, n = v.shape
    same = (np.bincount((v + np.arange(rows)[:, None] * k).ravel(), minlength=rows * k).reshape(rows, k) ** 2).sum(axis=1)
    middle = (k - 1) / 2
    up = v > middle
    high, turns = up.sum(axis=1), (up[:, 1:] != up[:, :-1]).sum(axis=1)
    chi = (k / n * same - n - (k - 1)) / np.sqrt(2 * (k - 1))
    mean = 2 * high * (n - high) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = np.where(var > 0, (turns + 1 - mean) / np.sqrt(np.maximum(var, 1e-9)), np.sqrt(n))
    serial = ((v[:, 1:] - middle) * (v[:, :-1] - middle)).sum(axis=1) / ((n - 1) * (k * k - 1) / 12) * np.sqrt(n - 1)
    return np.maximum(chi, 0) ** 2 + runs**2 + serial**2


def letter_shares(alphabet: str, evenness: float = 0.0) -> np.ndarray:
    """Shares of the letters of ordinary words (a to f in base16): English ones to the power 1 - evenness."""
    share = np.array(LETTERS[: 6 if alphabet == BASE16 else 26], float) ** (1 - evenness)
    return share / share.sum()


def first_letter(alphabet: str) -> int:
    return alphabet.index("a" if alphabet != BASE32 else "A")


def null_tokens(rng: np.random.Generator, rows: int, size: int, alphabet: str, evenness: float = 0.0) -> np.ndarray:
    """Digits of made ordinary words, letter by letter as often as in English: capitals in base32, a to f in base16."""
    share = letter_shares(alphabet, evenness)
    return first_letter(alphabet) + rng.choice(len(share), (rows, size), p=share)


def null_weights(digits: np.ndarray, alphabet: str) -> np.ndarray:
    """How much more likely each token is among ordinary words than in the even mixture over EVENNESS that it was drawn from."""
    letters = digits - first_letter(alphabet)
    logs = np.array([np.log(letter_shares(alphabet, e))[letters].sum(axis=1) for e in EVENNESS])
    return np.exp(logs[0] - np.logaddexp.reduce(logs, axis=0)) * len(EVENNESS)


@cache
def null_shares() -> tuple[tuple[tuple[float, ...], ...], ...]:
    """By encoding and band: for each bin the probability that an ordinary token is at least as random. Never 0.

    The weights of the drawn tokens up to the bin, and the largest of them once more (as the one that was not seen), over the number
    drawn. Before the first bin that a token reached, the tail goes on as exp(-distance / 2), like a chi-squared density."""
    rng = np.random.default_rng(20)

    def shares(alphabet: str, size: int) -> tuple[float, ...]:
        sums, most = np.zeros(BINS), np.zeros(BINS)
        for evenness in EVENNESS:
            for _ in range(0, NULL_TOKENS // len(EVENNESS), 20_000):
                digits = null_tokens(rng, 20_000, size, alphabet, evenness)
                bins = np.minimum(digit_distances(digits, len(alphabet)) // BIN_WIDTH, BINS - 1).astype(int)
                weights = null_weights(digits, alphabet)
                sums += np.bincount(bins, weights, minlength=BINS)
                np.maximum.at(most, bins, weights)
        reached = np.maximum.accumulate(most)
        tail = np.minimum((np.cumsum(sums) + reached) / NULL_TOKENS, 1.0)
        first = int(np.argmax(reached > 0))
        beyond = np.exp(-(BIN_WIDTH / 2) * np.maximum(first - np.arange(BINS), 0))
        return tuple((np.where(reached > 0, tail, tail[first]) * beyond).tolist())

    return tuple(tuple(shares(alphabet, size) for size in BANDS) for alphabet in ENCODINGS)


def thresholds(counts: dict[tuple[int, bool, int], int], null: tuple[tuple[float, ...], ...] | None = None) -> list[int]:
    """Per band the last bin whose candidates are accepted (-1: none), from counts by (band, is word, bin).

    ``null``: p-values by band and bin, which the corpus's own words in the band only raise. Without it the words are all there is
    to compare with.
    """
    out = []
    for b in range(len(BANDS)):
        own, tokens = ([counts.get((b, word, k), 0) for k in range(BINS)] for word in (True, False))
        n_own, n, below, found, last = sum(own), sum(tokens), 0, 0, -1
        for k in range(BINS):
            below, found = below + own[k], found + tokens[k]
            p = (1 + below) / (1 + n_own)  # of a candidate in this bin
            if null is not None:
                p = max(null[b][k], (PRIOR_WORDS * null[b][k] + below) / (PRIOR_WORDS + n_own))
            if found and p * n <= FDR * found:
                last = k
        out.append(last)
    return out


def free_tokens(text: Column) -> Column:
    """The tokens of a text that overlap no base span."""
    return F.transform(free_of(matches(text, TOKEN, 3), base_spans(text)), lambda s: s["token"])


def free_of(spans: Column, base: Column) -> Column:
    """The spans that overlap none of the base spans (ordered by start): a block of these is only looked into if the span meets
    the stretch from its first start to its last end."""

    def summed(block: Column) -> Column:
        last = F.aggregate(block, F.lit(0), lambda acc, b: F.greatest(acc, b["end"]))
        return F.struct(F.get(block, 0)["start"].alias("start"), last.alias("end"), block.alias("spans"))

    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    hit = lambda s, blocks: F.exists(blocks, lambda k: meets(k, s) & F.exists(k["spans"], lambda b: meets(b, s)))
    blocks = let(base, lambda b: F.transform(F.when(F.size(b) > 0, in_blocks(b)).otherwise(F.array().cast(f"array<array<{SPAN}>>")), summed))
    return let(F.struct(spans.alias("spans"), blocks.alias("blocks")), lambda t: F.filter(t["spans"], lambda s: ~hit(s, t["blocks"])))


def learn_thresholds(docs: DataFrame, text: str = "text") -> list[int]:
    """Accepted distances by encoding and length band (flat), from the words and candidates of the whole corpus."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    tokens = docs.where(body.rlike(TOKEN)).select(F.explode(free_tokens(body)).alias("token"))
    token = F.col("token")
    tokens = tokens.where(is_word(token) | is_candidate(token))
    grouped = tokens.groupBy("token").count()  # a token that is repeated is tested once
    sums = grouped.groupBy(encoding(token), band(token), is_word(token), bin_of(token)).agg(F.count(F.lit(1)))
    counts: list[dict] = [{} for _ in ENCODINGS]
    for e, *key, n in sums.collect():  # at most encodings x bands x 2 x bins rows
        counts[e][tuple(key)] = n
    return [last for e, null in enumerate(null_shares()) for last in thresholds(counts[e], null)]


def find_secrets(docs: DataFrame, text: str = "text", carried: list[str] | None = None) -> tuple[DataFrame, str]:
    """``carried`` columns (default: all) and an array column (its name is returned too) of the spans, ordered by start and kind."""
    accepted = learn_thresholds(docs, text)
    spans, base = free_name(docs, "spans"), free_name(docs, "base_spans")
    kept = [F.col(f"`{c}`") for c in (docs.columns if carried is None else carried)]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    of_band = lambda token: F.get(F.array(*[F.lit(x) for x in accepted]), encoding(token) * len(BANDS) + band(token))
    tokens = F.lit(None).cast(f"array<{SPAN}>")
    if max(accepted) >= 0:
        tokens = F.filter(
            matches(body, TOKEN, 3),
            lambda s: is_candidate(s["token"]) & (bin_of(s["token"]) <= of_band(s["token"])),
        )
    names = docs.columns if carried is None else carried
    step = docs.select(*kept, base_spans(body).alias(base), tokens.alias(spans))
    free = free_of(F.coalesce(F.col(spans), F.array().cast(f"array<{SPAN}>")), F.col(base))
    return step.select(*[F.col(f"`{c}`") for c in names], F.array_sort(F.concat(F.col(base), free)).alias(spans)), spans


def written(spans: Column) -> Column:
    """Spans as `kind:start:end`, comma-joined."""
    name = lambda k: F.get(F.array(*[F.lit(x) for x in KINDS]), k)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def secrets_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    found, s = find_secrets(docs.select("doc_id", "text"), carried=["doc_id"])
    of = lambda k: F.filter(F.col(s), lambda x: x["kind"] == k)
    count = lambda k: F.size(of(k)).cast("bigint")
    base = F.filter(F.col(s), lambda x: x["kind"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col(s)).alias("spans"),
        count(3).alias("n_random"),
    )


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]", length: str | None = None) -> DataFrame:
    """All rows, columns unchanged; each stretch of the text that spans cover is replaced by ``mask``.

    ``length``: a column that holds the text's length and is set anew where the text changes.
    """
    found, s = find_secrets(docs, text)
    body = F.col(f"`{text}`")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(body, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        put = F.when(x["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"])
        return F.struct(put.alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    clean = F.aggregate(
        F.col(s), start, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body)))
    )
    new = F.when(F.size(s) > 0, clean).otherwise(body)
    out = found.withColumn(text, new)
    if length is not None:
        out = out.withColumn(length, F.when(F.size(s) > 0, F.length(F.col(f"`{text}`")).cast(docs.schema[length].dataType)).otherwise(F.col(f"`{length}`")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
