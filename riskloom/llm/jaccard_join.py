"""N-gram Jaccard join by parity sketches.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents with equal sets are one class, represented by its
smallest id (grouped minimum on a 128-bit fingerprint), so exact copies never meet each other again. Where ids are repeated, an id may
have several classes: then the nodes are numbered classes, and the classes of an id are joined and named at the end.

Sketch: the hashes' range is cut into m parts, and the shingles of a part are XORed into one 64-bit word. A shingle that only one of two sets
holds changes one word, so the number of differing words is a lower bound of the symmetric difference. A pair with Jaccard of at least
t has a symmetric difference of at most d = (1-t)/(1+t) * (a+b). Sets are sorted into size bands such that linked sets lie in
the same or in neighbouring bands; each band is a *home* with its own d and m = d + 1 + s parts, and a set sketches itself for its
own home and the one below. By the pigeonhole principle a linked pair agrees in at least s + 1 words of their common home. The join is on
(home, part, word), one 64-bit key.

Frequent keys (empty parts, passages that many texts share, large groups of near copies) are never expanded into pairs:

* Star rounds: each key has one pivot (the member that shares most keys with others); every member meets only its pivot. That is linear, and
  joins large groups of near copies at once. Components are formed of the verified links.
* Before that, sets that share too few keys with anybody are dropped (a linked set shares more than s). Pairs are only made if the words
  they were seen to agree in, counted while pairing, and those not looked at may add up to more than s.
* Rest: members of one key that still are in different components are paired if the key has at most ``FREQUENT`` members.
* Families: sets with more than s frequent keys in a home are connected by them into families, whose blocks are compared by
  matrix products. Any other set agrees with its partners in a word that is not frequent, so no link is lost.

Candidates are verified by exact intersection of the sets (JVM-side). Everything is a join or a grouped aggregate on a key; the
driver sees counts only. Stored tables (shared checkpoint folder) cut the lineage between steps.

Defined cases: texts without words (null, empty) have an empty set, are linked with nothing and are their own component; with fewer words
than a shingle the whole sequence is the one shingle; rows that share an id are one node; rows without id take no part and have no
component; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import map_text, mix64, text_shingles
from riskloom.session import materialise

WIDTH, PERCENT = 5, 80
FREQUENT = 64
#: Sets and shingles in a block of a family of near copies; two blocks meet in one task.
BLOCK_SETS, BLOCK_SHINGLES = 512, 400_000
STAR_ROUNDS = 1
#: Ids are broadcast up to this many rows (a few MB); beyond it the join shuffles.
BROADCAST_IDS = 500_000
#: No text has more words than this. The low bits of a key name its home and say whether its part holds a shingle.
LARGEST, HOMES, FULL = 1 << 30, 1 << 9, 1 << 9


class Bands:
    """Size bands, and for each home the bound d and the number of parts, for a threshold in percent."""

    def __init__(self, percent: int, largest: int = LARGEST):
        self.percent = percent
        self.first = [1]  # smallest size of each band
        while self.first[-1] <= largest:
            self.first.append(max(self.first[-1] + 1, 100 * (self.first[-1] - 1) // percent + 1))
        if len(self.first) > HOMES:
            raise ValueError(f"{len(self.first)} size bands; a key can name {HOMES} homes: use a lower threshold")
        edge = [*self.first, 100 * (self.first[-1] - 1) // percent + 1]
        self.d = [(100 - percent) * (edge[k + 1] + edge[k + 2] - 2) // (100 + percent) for k in range(len(edge) - 2)]
        self.slack = [2 + d // 6 if d else 0 for d in self.d]
        self.starts = np.array(self.first)

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.starts, size, side="right")) - 1


def sketch_keys(shingles: np.ndarray, home: int, bands: Bands) -> np.ndarray:
    """One key for each part of the set in a home. Low bits of a key: FULL for a part that is not empty, and the home."""
    d, s = bands.d[home], bands.slack[home]
    if d == 0:  # only equal sets can be linked here
        return np.zeros(0, np.uint64)
    m = d + 1 + s
    part = ((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # ascending, as the shingles are
    words = np.zeros(m, np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    words[part[starts]] = np.bitwise_xor.reduceat(mix64(shingles), starts)
    full = np.zeros(m, np.uint64)
    full[part[starts]] = 1
    place = np.arange(m, dtype=np.uint64) + (np.uint64(home + 1) << np.uint64(32))
    return (mix64(words ^ mix64(place)) & ~np.uint64(FULL + HOMES - 1)) | (full * np.uint64(FULL)) | np.uint64(home)


def keys_of(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    if not len(shingles):
        return np.zeros(0, np.uint64)
    band = bands.band(len(shingles))
    return np.concatenate([sketch_keys(shingles, home, bands) for home in ((band - 1, band) if band else (band,))])


def with_sets(docs: DataFrame, width: int, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """The columns to keep, n, and a 128-bit fingerprint of the set."""

    def make():
        def apply(texts):
            sets = [text_shingles(t, width) for t in texts]
            print_ = lambda x, salt: np.add.reduce(mix64(x ^ np.uint64(salt))).view(np.int64) if len(x) else 0
            return {
                "n": [len(x) for x in sets],
                "p1": [int(print_(x, 0x1234567)) for x in sets],
                "p2": [int(print_(x, 0x89ABCDEF01)) for x in sets],
            }

        return apply

    found, f = map_text(docs, make, "n bigint, p1 bigint, p2 bigint", keep=list(keep), out="sets")
    return found.select(*keep, f"{f}.*")


def class_texts(docs: DataFrame, width: int) -> DataFrame:
    """(node, first_id, text, p1, p2, n): a row for each class, with a number of its own; for tables in which ids are repeated."""
    rows = with_sets(docs, width, keep=("id", "text")).where(F.col("id").isNotNull() & (F.col("n") > 0))
    first = rows.groupBy("p1", "p2", "n").agg(F.min(F.struct("id", "text")).alias("first"))
    numbered = first.withColumn("node", F.monotonically_increasing_id())  # stored below, so that it stays the same
    return materialise(numbered.select("node", F.col("first.id").alias("first_id"), "first.text", "p1", "p2", "n"), "class-texts")


def key_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, id): a row for each key of each document."""

    def make():
        bands = Bands(percent)
        return lambda texts: {"keys": [keys_of(text_shingles(t, width), bands).view(np.int64) for t in texts]}

    found, f = map_text(docs, make, "keys array<bigint>", keep=["id"], out="sketch")
    return found.select(F.explode(f"{f}.keys").alias("key"), "id")


def shingle_arrays(docs: DataFrame, width: int) -> DataFrame:
    def make():
        return lambda texts: {"set": [text_shingles(t, width).view(np.int64) for t in texts]}

    found, f = map_text(docs, make, "set array<bigint>", keep=["id"], out="sets")
    return found.select("id", f"{f}.set")


def home_of(key: str = "key"):
    return F.col(key).bitwiseAND(F.lit(HOMES - 1)).cast("int")


def slack_of(home, percent: int):
    return F.get(F.array(*[F.lit(s) for s in Bands(percent).slack]), home)


def shared_keys(rows: DataFrame, percent: int, passes: int = 2) -> DataFrame:
    """(key, id, members, empty, common) of keys with several members, without sets that share too few keys to be linked at all.

    A linked set shares more keys of its home than the home's slack. Dropping the others makes further keys lonely, so the two
    conditions are applied in turn; each pass works on what the one before left. ``empty`` and ``common``: how many keys of empty parts,
    and of empty parts or frequent ones, the set has in the key's home."""
    own = Window.partitionBy("id", "home")
    for _ in range(passes):
        rows = rows.select("key", "id").withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("key")))
        rows = rows.where(F.col("members") > 1).withColumn("home", home_of())
        empty = F.count(F.when(~is_full(), 1)).over(own)
        common = F.count(F.when(is_frequent(), 1)).over(own)
        rows = rows.withColumns({"mine": F.count(F.lit(1)).over(own), "empty": empty, "common": common})
        rows = rows.where(F.col("mine") > slack_of(F.col("home"), percent))
    return rows.select("key", "id", "members", "empty", "common")


def by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on id; the ids (distinct) are broadcast only where there are at most BROADCAST_IDS of them."""
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, "id", how)


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar enough. ``pairs`` is stored."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = materialise(shingle_arrays(by_ids(docs, materialise(ids, "ids"), "left_semi"), width), "sets")
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    common, total = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")
    both = both.select("a", "b", common.alias("common"), total.alias("total"))
    return materialise(both.where((100 + percent) * F.col("common") >= percent * F.col("total")).select("a", "b"), "links")


def rooted(parents: DataFrame) -> DataFrame:
    """(id, p) with every p a root: pointers are followed by doubling, so a chain of n takes log2(n) steps."""
    while True:
        inner = parents.where(F.col("p") != F.col("id")).select(F.col("id").alias("p"), F.col("p").alias("pp"))
        moved = parents.join(inner, "p", "left").select("id", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved"))
        moved = materialise(moved, "parents")
        if moved.where("moved").isEmpty():
            return parents
        parents = moved.select("id", "p")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for each id in ``links``.

    Each round hooks every node to its least neighbour, follows the pointers to their roots and contracts the edges; what lies within
    one component is gone, so a round's rows are a fraction of the one before, and no node ever meets all its neighbours at once."""
    edges = links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges, labels = materialise(edges.distinct(), "edges"), None
    while labels is None or not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        parents = rooted(materialise(least.withColumnRenamed("a", "id"), "parents"))
        if labels is None:
            labels = parents.select("id", F.col("p").alias("component"))
        else:
            labels = materialise(relabelled(labels, parents), "labels")
        for end in ("a", "b"):
            edges = edges.join(parents.select(F.col("id").alias(end), F.col("p").alias(f"{end}_root")), end)
        edges = edges.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
        edges = materialise(edges.where(F.col("a") != F.col("b")).distinct(), "edges")
    return labels


def relabelled(labels: DataFrame, parents: DataFrame) -> DataFrame:
    """``labels`` with the components that have a parent replaced by it."""
    up = parents.select(F.col("id").alias("component"), F.col("p").alias("up"))
    return labels.join(up, "component", "left").select("id", F.coalesce("up", "component").alias("component"))


def more_components(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """:func:`components` of the links behind ``labels`` and of ``links``: only the components that the new links join are worked on."""
    if labels is None:
        return components(links)
    ends = links
    for end in ("a", "b"):
        ends = ends.join(labels.select(F.col("id").alias(end), F.col("component").alias(f"{end}_of")), end, "left")
        ends = ends.withColumn(f"{end}_of", F.coalesce(f"{end}_of", end))
    new = components(ends.select(F.col("a_of").alias("a"), F.col("b_of").alias("b")))
    known = labels.select(F.col("id").alias("old"))
    fresh = new.join(known, F.col("id") == F.col("old"), "left_anti")
    moved = relabelled(labels, new.withColumnRenamed("component", "p"))
    return materialise(moved.union(fresh.select("id", "component")), "labels")


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` with the component of their id (the id itself where it has no link so far)."""
    if labels is None:
        return rows.withColumn("component", F.col("id"))
    return rows.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


def is_full(key: str = "key"):
    return F.col(key).bitwiseAND(F.lit(FULL)) != 0


def is_frequent(key: str = "key"):
    return (F.col("members") > FREQUENT) | ~is_full(key)


def star_pairs(shared: DataFrame, scores: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """(a, b): each id and the pivot that it meets in most keys of a home, if that is in another component and the two may agree in more
    words of that home than its slack (words met, and empty parts).

    A key whose members are in one component has no part in it; the pivot of a later round comes from the members outside the
    first's component."""
    rows = labelled(shared.where(is_full()).join(scores, "id"), labels)
    rank = F.struct("score", (-F.col("id")).alias("low"), F.col("component").alias("of"))
    if labels is not None:  # of members with links and without, prefer those without: the others had their pivot
        rank = F.struct((F.col("component") == F.col("id")).cast("int").alias("alone"), "score", (-F.col("id")).alias("low"), F.col("component").alias("of"))
    tops = rows.groupBy("key").agg(F.max(rank).alias("top"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    tops = tops.where(F.col("c0") != F.col("c1")).select("key", (-F.col("top.low")).alias("pivot"), F.col("top.of").alias("of"))
    met = rows.join(tops, "key").where(F.col("component") != F.col("of"))
    counts = met.groupBy("id", "pivot", home_of().alias("home")).agg(F.count(F.lit(1)).alias("keys"), F.max("empty").alias("empty"))
    counts = counts.where(F.col("keys") + F.col("empty") > slack_of(F.col("home"), percent))
    best = counts.groupBy("id").agg(F.max(F.struct("keys", (-F.col("pivot")).alias("low"))).alias("top"))
    return best.select(F.col("id").alias("x"), (-F.col("top.low")).alias("y")).select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
    ).distinct()


def frequent_rows(shared: DataFrame, percent: int) -> DataFrame:
    """(key, id) of frequent keys (many members, or an empty part) of those sets that have more of them in the home than
    its slack. Any other set agrees with each of its partners in a word that is neither empty nor frequent."""
    return shared.where(is_frequent() & (F.col("common") > slack_of(home_of(), percent))).select("key", "id")


def rest_pairs(shared: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """(a, b) of different components that may agree in more words of a home than its slack.

    Keys that are neither frequent nor of an empty part are counted while pairing; of the others the two agree in no more than the
    one with fewer has."""
    rows = labelled(shared.where(~is_frequent()).select("key", "id", "common"), labels)
    mixed = rows.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
    rows = materialise(rows.join(mixed.where(F.col("c0") != F.col("c1")).select("key"), "key", "left_semi"), "rest")
    left, right = (
        rows.select("key", F.col("id").alias(end), F.col("component").alias(f"c{end}"), F.col("common").alias(f"common_{end}")) for end in "ab"
    )
    met = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")))
    may = F.max(F.least("common_a", "common_b")).alias("may")
    agreed = met.groupBy("a", "b", home_of().alias("home")).agg(F.count(F.lit(1)).alias("n"), may)
    return agreed.where(F.col("n") + F.col("may") > slack_of(F.col("home"), percent)).select("a", "b").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over the elements that several sets hold."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    if not sets:
        return out
    elements, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    place = np.cumsum(counts > 1) - 1
    keep = counts[column] > 1
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [first, first + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[lo:hi], column[lo:hi] - first] = 1
        out += part @ part.T
    return out


def family_links(docs: DataFrame, rows: DataFrame, labels: DataFrame | None, width: int, percent: int) -> DataFrame:
    """Links between components among the sets of :func:`frequent_rows`.

    Sets connected by frequent keys are a family. A family is dealt into blocks (at most about BLOCK_SETS sets and
    BLOCK_SHINGLES shingles each), and each two blocks meet in a task of their own that counts all intersections as a matrix
    product and returns a spanning forest of the links between different components: no row for a pair, no task for a whole
    family.
    """
    lead = rows.groupBy("key").agg(F.min("id").alias("lead"))
    edges = rows.join(lead, "key").where(F.col("id") != F.col("lead")).select(F.col("id").alias("a"), F.col("lead").alias("b"))
    families = components(materialise(edges.distinct(), "family-edges")).withColumnRenamed("component", "family")
    known = materialise(labelled(families, labels), "families")
    mixed = known.groupBy("family").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
    known = known.join(mixed.where(F.col("c0") != F.col("c1")).select("family"), "family", "left_semi")
    known = materialise(known, "families")
    sets = shingle_arrays(by_ids(docs, known.select("id"), "left_semi"), width)
    sets = materialise(sets.join(known, "id"), "family-sets")
    size = sets.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("set").cast("bigint")).alias("s"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    dealt = sets.join(size.select("family", blocks.alias("blocks")), "family")
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")})

    def meet(pdf):
        pdf = pdf.drop_duplicates("id").sort_values("id")
        ids, group = pdf["id"].to_numpy(), np.unique(pdf["component"].to_numpy(), return_inverse=True)[1]
        found = []
        if len(ids) > 1 and group.max() > 0:
            sizes = np.array([len(x) for x in pdf["set"]])
            common = overlaps([np.asarray(x) for x in pdf["set"]])
            near = (100 + percent) * common >= percent * (sizes[:, None] + sizes[None, :])
            for i, j in np.argwhere(np.triu(near & (group[:, None] != group[None, :]))):
                if group[i] != group[j]:  # still: earlier links may have joined them
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    group[group == group[j]] = group[i]
        return pd.DataFrame(found, columns=["a", "b"])

    kind = docs.schema["id"].dataType.simpleString()
    work = dealt.select("family", "lo", "hi", "id", "component", "set").groupBy("family", "lo", "hi")
    return materialise(work.applyInPandas(meet, f"a {kind}, b {kind}"), "links")


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``."""
    docs = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    known = materialise(with_sets(docs, width), "fingerprints")
    named = known.where(F.col("id").isNotNull() & (F.col("n") > 0))
    repeated = not named.groupBy("id").count().where("count > 1").isEmpty()
    if repeated:  # an id can have several classes: the nodes are the classes, one text each
        classes = class_texts(docs, width)
        docs = single = classes.select(F.col("node").alias("id"), "text")
        classes = classes.drop("text")
    else:  # an id has one class, whose node is its smallest id
        classes = named.groupBy("p1", "p2", "n").agg(F.min("id").alias("first_id")).withColumn("node", F.col("first_id"))
    member = materialise(named.join(classes, ["p1", "p2", "n"]).select("id", "node", "first_id").distinct(), "classes")
    if not repeated:
        firsts = member.where(F.col("id") != F.col("first_id")).select("id")
        docs = docs.where(F.col("id").isNotNull())
        single = by_ids(docs, materialise(firsts, "copies"), "left_anti")
    shared = materialise(shared_keys(key_rows(single, width, percent), percent), "shared-keys")
    scores = materialise(shared.where(is_full()).groupBy("id").agg(F.sum("members").alias("score")), "scores")
    labels, tested = None, None

    def add(new: DataFrame) -> None:
        """Take in stored links, if there are any."""
        nonlocal labels
        if not new.isEmpty():
            labels = more_components(labels, new)

    for step in range(STAR_ROUNDS + 1):
        pairs = star_pairs(shared, scores, labels, percent) if step < STAR_ROUNDS else rest_pairs(shared, labels, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        if not pairs.isEmpty():
            add(verified(pairs, docs, width, percent))
    frequent = materialise(frequent_rows(shared, percent), "frequent")
    if not frequent.isEmpty():
        add(family_links(docs, frequent, labels, width, percent))
    if repeated:  # all classes of an id belong together
        leads = member.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("top")).where(F.col("a") != F.col("top"))
        own = member.join(leads.select("id", "a"), "id").where(F.col("node") != F.col("a"))
        add(materialise(own.select("a", F.col("node").alias("b")).distinct(), "links"))
    one = member.select("id", F.col("node"), "first_id")
    if labels is None:
        one = one.withColumn("component", F.col("node"))
    else:
        one = one.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    if repeated:  # from the number of a node to the smallest id
        least = one.groupBy("component").agg(F.min("first_id").alias("least"))
        one = one.join(least, "component").groupBy("id").agg(F.min("least").alias("component"))
    return known.join(one.select("id", "component"), "id", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def drop_similar(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component (its smallest id; one row where ids repeat); columns unchanged.

    Rows without id stay."""
    found = materialise(similar_components(docs, width=width, percent=percent), "components")
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    gone = materialise(gone, "gone")
    small = gone.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    named = kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return named.unionByName(kept.where(F.col("doc_id").isNull()))
