"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, verified Hamming distances.

A text's fingerprint has a bit set if more than half of its word shingles' XXH64 values have it. Texts with one fingerprint are one node
(a grouped minimum, so exact copies never meet). 64 bits are cut into ``BLOCKS`` bytes; two fingerprints that differ in at most
``DISTANCE`` = 4 bits agree in at least four of the eight bytes, so they share one of the 70 keys that keep four bytes (32 bits, so a key
that is shared by chance is rare up to billions of fingerprints).

Members of a key are never all paired:

* Stars: each member is compared with the key's least and greatest fingerprint, which a grouped aggregate finds. A key of two members
  is done with that, and large groups of near copies are joined at once. Components are formed of the links.
* Small rest: where at most ``PAIRED`` members of a key are outside its largest component, these meet all its members.
* Large rest: in any other key, each member lists all points within two bits of itself (2,081). Two fingerprints differ in at most four
  bits exactly if they share such a point, so the components that meet in a point are linked: rows grow with the members, not with
  their pairs, and nothing is left out.

Defined cases: texts without words (null, empty) have fingerprint zero and are linked like any other; with fewer words than a shingle the
whole sequence is the one shingle; rows that share an id are one node whatever their texts; rows without id get the component of their
fingerprint (null where only rows without id reach it); extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import free_name, map_text
from riskloom.llm.jaccard_join import components, more_components
from riskloom.session import materialise

WIDTH, SEED = 4, 42
BITS, DISTANCE, BLOCKS = 64, 4, 8
PAIRED = 8
#: Shingle hashes whose bits are counted at once.
HASHES = 1 << 15


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """XXH64 of each word shingle of a text, repeats included."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z only, and the blanks 0x20 and 0x09-0x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined, size = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - size] + 1])
    one = xxhash.xxh64_intdigest
    return np.array([one(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The 64 majority bits, as a signed number."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), HASHES):
        part = hashes[at : at + HASHES].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = WIDTH, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of the one field fp (bigint), and that column's name."""

    def make():
        return lambda texts: {"fp": [fingerprint(shingle_hashes(t, width)) for t in texts]}

    return map_text(docs, make, "fp bigint", text=text, keep=keep, out="simhash")


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def block_masks() -> list[tuple[int, int]]:
    """(mask, tag) of each choice of BLOCKS - DISTANCE blocks; the tag lies in the first block that is masked out."""
    width = BITS // BLOCKS
    out = []
    for n, kept in enumerate(combinations(range(BLOCKS), BLOCKS - DISTANCE)):
        free = next(k for k in range(BLOCKS) if k not in kept)
        out.append((signed(sum(((1 << width) - 1) << (width * k) for k in kept)), signed(n << (width * free))))
    return out


def ball(radius: int) -> list[int]:
    """Bit patterns with at most ``radius`` bits."""
    return [signed(sum(1 << k for k in ks)) for r in range(radius + 1) for ks in combinations(range(BITS), r)]


def distance(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def block_members(nodes: DataFrame) -> DataFrame:
    """(key, fp, lo, hi, members) of keys with several fingerprints; ``nodes`` holds each fp once."""
    keys = [F.col("fp").bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(tag)) for mask, tag in block_masks()]
    rows = nodes.select("fp", F.explode(F.array(*keys)).alias("key"))
    several = rows.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count(F.lit(1)).alias("members"))
    return rows.join(several.where(F.col("lo") != F.col("hi")), "key")


def star_links(rows: DataFrame) -> DataFrame:
    """(a, b): members within the distance of their key's least or greatest fingerprint."""
    ends = rows.select(F.col("fp"), F.explode(F.array("lo", "hi")).alias("end")).where(F.col("fp") != F.col("end"))
    ends = ends.where(distance(F.col("fp"), F.col("end")) <= DISTANCE)
    return ends.select(F.least("fp", "end").alias("a"), F.greatest("fp", "end").alias("b")).distinct()


def open_members(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, fp, component, main, others) of keys of three and more members that are in several components.

    main: whether the member is in the key's largest component; others: how many members of the key are not."""
    known = rows.where(F.col("members") > 2).select("key", "fp").join(labels.withColumnRenamed("id", "fp"), "fp", "left")
    known = known.withColumn("component", F.coalesce("component", "fp"))
    sizes = known.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("members"))
    largest = largest.select("key", F.col("top.component").alias("largest"), (F.col("members") - F.col("top.n")).alias("others"))
    open_keys = known.join(largest.where(F.col("others") > 0), "key")
    return open_keys.select("key", "fp", "component", (F.col("component") == F.col("largest")).alias("main"), "others")


def pair_links(rows: DataFrame) -> DataFrame:
    """(a, b) of different components, within keys with few members outside their largest component: those meet all members."""
    few = rows.where(F.col("others") <= PAIRED)
    left = few.where(~F.col("main")).select("key", F.col("fp").alias("a"), F.col("component").alias("ca"))
    right = few.select("key", F.col("fp").alias("b"), F.col("component").alias("cb"), "main")
    once = F.col("main") | (F.col("a") < F.col("b"))
    near = once & (F.col("ca") != F.col("cb")) & (distance(F.col("a"), F.col("b")) <= DISTANCE)
    return left.join(right, "key").where(near).select("a", "b").distinct()


def point_links(rows: DataFrame) -> DataFrame:
    """(a, b): components with members of the other keys that share a point within two bits."""
    many = rows.where(F.col("others") > PAIRED).select("fp", "component").distinct()
    steps = F.explode(F.lit(ball(DISTANCE // 2)))
    at = many.select("component", "fp", steps.alias("step")).select("component", F.col("fp").bitwiseXOR(F.col("step")).alias("point"))
    at = at.distinct()
    met = at.groupBy("point").agg(F.min("component").alias("a"), F.max("component").alias("top")).where(F.col("a") != F.col("top"))
    both = at.join(met.select("point", "a"), "point").where(F.col("component") != F.col("a"))
    return both.select("a", F.col("component").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; fp is the fingerprint as a bigint."""
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found, f = with_fingerprint(named, width=width, keep=["doc_id"])
    known = materialise(found.select("doc_id", F.col(f"{f}.fp").alias("fp")), "fingerprints")
    nodes = materialise(known.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    rows = materialise(block_members(nodes), "block-members")
    # an id with several fingerprints holds them together
    lead = known.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("top"))
    own = known.join(lead.where(F.col("a") != F.col("top")).select("doc_id", "a"), "doc_id").where(F.col("fp") != F.col("a"))
    links = materialise(star_links(rows).union(own.select("a", F.col("fp").alias("b")).distinct()), "star-links")
    labels = components(links)
    left = materialise(open_members(rows, labels), "open-members")
    if not left.isEmpty():
        more = materialise(pair_links(left).union(point_links(left)), "rest-links")
        if not more.isEmpty():
            labels = more_components(labels, more)
    named = nodes.join(labels.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return known.join(named.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_digits(column):
    """A bigint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def simhash_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    return near_duplicates(docs).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without those documents whose component has a smaller id; columns unchanged, rows without id stay."""
    found = near_duplicates(docs)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    key = free_name(docs, "gone_id")
    gone = gone.withColumnRenamed("doc_id", key)
    return docs.join(gone, docs["doc_id"] == gone[key], "left_anti")
