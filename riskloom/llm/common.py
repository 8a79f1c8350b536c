"""Helpers shared by the llm operators: Arrow text mapping, byte-level words, 64-bit hashes.

Text travels to Python as binary (raw UTF-8), so nothing is decoded twice and offsets can be counted exactly.
Every mapping streams Arrow batches: a task holds one batch, never a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A per-text function gets at most so many texts at once, and no more bytes unless a single text is longer.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20
#: Rows that reach a Python worker at once.
BATCH_ROWS = 2_000


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores put in front until no column of ``df`` has the name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def map_text(
    df: DataFrame,
    make: Callable[[], Callable[[list[bytes]], dict[str, list]]],
    fields: str,
    text: str = "text",
    keep: list[str] | None = None,
    out: str = "found",
) -> tuple[DataFrame, str]:
    """Apply a batch function to a text column; return (``df`` with one struct column more, that column's name).

    ``make`` runs once per task and returns a function from a list of UTF-8 texts (null: empty) to a dict of equally
    long lists, one for each field of the DDL string ``fields``. ``keep``: the columns to carry through (default all).
    The new column's name never clashes with a kept one. Row order, repeated rows and null ids pass unchanged.
    """
    kept = df.columns if keep is None else keep
    bound_batches(df.sparkSession)
    base = df.select(*[F.col(f"`{c}`") for c in kept])
    raw = free_name(base, "raw_text")
    out = free_name(base, out)
    own = text in kept and isinstance(df.schema[text].dataType, T.StringType)  # the text travels once if it is kept
    source = base if own else df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("binary").alias(raw))
    at = list(kept).index(text) if own else len(kept)
    struct = T._parse_datatype_string(fields)
    schema = T.StructType([*base.schema.fields, T.StructField(out, struct, False)])
    names = [f.name for f in struct.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        inner = target.field(out).type
        apply = None
        for batch in batches:
            for part in slices(batch, at):
                texts = [x or b"" for x in part.column(at).cast(pa.binary()).to_pylist()]
                apply = apply or make()
                got = apply(texts)
                new = pa.StructArray.from_arrays(
                    [pa.array(got[n], type=inner.field(n).type) for n in names], fields=list(inner)
                )
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], new], names=target.names)
                texts = got = new = None
        pa.default_memory_pool().release_unused()  # workers that wait for other stages hold no batches

    return source.mapInArrow(run, schema), out


def bound_batches(spark) -> None:
    """Lower the session's rows in an Arrow batch to BATCH_ROWS, if they are more: a batch of texts lies in memory on both sides."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch, bounded by SLICE_ROWS and by SLICE_BYTES of a column of texts."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(total, total[at] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, at + 1), at + SLICE_ROWS, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def hash_share(column, share: float):
    """Condition that holds for about ``share`` of the values of a column, by their hash (the same rows every time)."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 20)) < F.lit(round(share * (1 << 20)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, label) of about ``bound`` labelled documents, chosen by a hash of their ids.

    Rows without id or label are left out; of an id with several labels the largest counts, and of rows that repeat an id the least
    text (an aggregate that is reduced before its shuffle), so the bound on ids is one on rows. The chosen labels are
    at most a little over ``bound`` narrow rows, so they are broadcast; of the documents only the chosen ones are shuffled.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).select(doc_id, label)
    n = known.count()
    if n > bound:
        known = known.where(hash_share(doc_id, bound / n))
    known = known.groupBy(doc_id).agg(F.max(label).cast("int").alias("known_label"))
    rows = docs.select(F.col(doc_id), F.col("text")).join(F.broadcast(known), doc_id)
    first = F.min(F.coalesce("text", F.lit(""))).alias("text")
    return rows.groupBy(doc_id, F.col("known_label").alias("label")).agg(first).select(doc_id, "text", "label")


# -- words and hashes on bytes ---------------------------------------------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POLY = 0xD6E8FEB86659FD93
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift-multiply), elementwise and invertible."""
    x = x + _MULT
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the polynomial's base and of its inverse modulo 2**64 (kept, grown by doubling)."""
    if len(_POWERS["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for key, base in (("up", _POLY), ("down", pow(_POLY, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_bounds(data: np.ndarray, separator: np.ndarray = _ASCII_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of bytes outside ``separator`` (256 flags)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separator[data]
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


class RangeHash:
    """64-bit hashes of byte ranges of one text, without a loop over ranges.

    Prefix sums of byte values times powers of an odd base; a range is the difference of two prefix sums, shifted back
    by the inverse power, and mixed with its length.
    """

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:-1], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = mix64((ends - starts).astype(np.uint64))
        return mix64((self.total[ends] - self.total[starts]) * self.down[starts] + size)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return RangeHash(data)(starts, ends) if len(starts) else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``width`` words; with fewer words, of the whole sequence."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    size = min(n, width)
    acc = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        acc = mix64(acc ^ words[k : n - size + 1 + k])
    return np.unique(mix64(acc ^ np.uint64(size)))


def text_shingles(text: bytes, width: int) -> np.ndarray:
    """Shingle hashes of a text: A-Z lowered, words are runs outside ASCII space and 0x09-0x0D."""
    data = np.frombuffer(text.lower(), np.uint8)
    return shingle_hashes(word_hashes(data, *word_bounds(data)), width)
