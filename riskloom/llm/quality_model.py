"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are computed in numpy on the raw bytes of whole texts. Training takes a bounded sample of labelled rows
(``TRAIN_ROWS``, chosen by a hash of the id): only their statistics reach the driver. Trees are complete binary trees in
flat arrays, so that scoring walks all rows of a slice down one level at a time with numpy.

Defined cases: null and empty texts have the statistics of an empty text and are scored; without labels every score is
0.5; with labels of one class only, the score is that class's smoothed share; ties of a split go to the lower feature
and bin, so training is deterministic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import labelled_sample, map_text, word_bounds, word_hashes
from riskloom.llm.langid import held_out

TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAF_WEIGHT = 40, 4, 64, 0.25, 2.0
THRESHOLD = 0.7
STATS = (
    "log_bytes", "log_words", "mean_word", "max_word", "upper_share", "digit_share", "symbol_share", "exclaim_share",
    "stop_share", "comma_share", "wide_share", "blank_share", "line_share", "distinct_share", "same_as_previous",
    "top_word_share", "repeated_lines", "byte_entropy", "short_words", "pipe_share",
)
_CLASS = {name: np.zeros(256, bool) for name in ("upper", "digit", "symbol", "space")}
_CLASS["upper"][65:91] = True
_CLASS["digit"][48:58] = True
_CLASS["symbol"][list(b"#*$%&<>@^~=+_{}[]\\")] = True
_CLASS["space"][list(b" \t\n\r\x0b\x0c")] = True


def statistics(text: bytes) -> list[float]:
    """The values of STATS for one text."""
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    counts = np.bincount(data, minlength=256)
    starts, ends = word_bounds(data)
    words = len(starts)
    if not words:
        return [float(np.log1p(n)), *[0.0] * (len(STATS) - 1)]
    sizes = ends - starts
    hashes = word_hashes(data, starts, ends)
    repeats = np.unique(hashes, return_counts=True)[1]
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = counts[counts > 0] / n
    letters = counts[65:91].sum() + counts[97:123].sum()
    return [
        float(x)
        for x in (
            np.log1p(n), np.log1p(words), sizes.mean(), sizes.max(), counts[_CLASS["upper"]].sum() / max(1, letters),
            counts[_CLASS["digit"]].sum() / n, counts[_CLASS["symbol"]].sum() / n, counts[33] / words,
            counts[46] / words, counts[44] / words, counts[128:].sum() / n, counts[_CLASS["space"]].sum() / n,
            counts[10] / words, len(repeats) / words, (hashes[1:] == hashes[:-1]).mean() if words > 1 else 0,
            repeats.max() / words, 1 - len(set(lines)) / len(lines), -(share * np.log2(share)).sum(),
            (sizes <= 2).mean(), counts[124] / words,
        )
    ]


@dataclass
class Trees:
    """Complete binary trees of one depth: node k has the children 2k+1 and 2k+2; leaves have values only."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    bound: np.ndarray  # rows with a value above it go right
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > bound[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def train(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the log loss; every level is one histogram over (node, feature, bin)."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    empty = Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(y):
        return empty
    p = (y.sum() + 1) / (len(y) + 2)
    empty.base = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        return empty
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1)
    slot = binned + np.arange(m) * BINS
    total = np.full(n, empty.base)
    features, bounds, values = [], [], []
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-total))
        grad, hess = q - y, np.maximum(q * (1 - q), 1e-6)
        node = np.zeros(n, np.int64)
        feature, bound = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (m * BINS) + slot).ravel()
            g, h = (
                np.bincount(cell, np.repeat(v, m), minlength=width * m * BINS).reshape(width, m, BINS)
                for v in (grad, hess)
            )
            gl, hl = g.cumsum(2), h.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            part = lambda a, b: a**2 / (b + LEAF_WEIGHT)
            gain = part(gl, hl) + part(gt - gl, ht - hl) - part(gt, ht)
            gain[(hl < 0.5) | (ht - hl < 0.5)] = 0
            for j in range(m):
                gain[:, j, len(edges[j]) :] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-9:
                    feature[first + k], bound[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > bound[node])
        place = node - inner
        leaf = -RATE * np.bincount(place, grad, minlength=leaves) / (np.bincount(place, hess, minlength=leaves) + LEAF_WEIGHT)
        total += leaf[place]
        features.append(feature), bounds.append(bound), values.append(leaf)
    return Trees(empty.base, np.array(features), np.array(bounds), np.array(values))


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` with an array column (in a struct; its name is returned too) of the values of STATS."""

    def make():
        return lambda texts: {"stats": [statistics(t) for t in texts]}

    return map_text(docs, make, "stats array<double>", text=text, keep=keep, out="statistics")


def learn_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Trees trained on at most about ``rows`` labelled documents; only their statistics come to the driver."""
    found, f = with_statistics(labelled_sample(docs, labels, label, rows), keep=["doc_id", "label"])
    got = sorted((r.doc_id, r.label, r.stats) for r in found.select("doc_id", "label", f"{f}.stats").collect())
    x = np.array([s for _, _, s in got], float).reshape(len(got), len(STATS))
    return train(x, np.array([float(y) for _, y, _ in got]))


def score_quality(docs: DataFrame, trees: Trees, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a struct column (its name is returned too) holding the score of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def make():
        def apply(texts: list[bytes]) -> dict[str, list]:
            return {"score": sent.value.score(np.array([statistics(t) for t in texts])).tolist()}

        return apply

    return map_text(docs, make, "score double", text=text, keep=keep, out="quality")


def quality_report(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted; labels are learned only from rows outside the fold."""
    trees = learn_quality(docs, labels.where(~held_out("doc_id", folds, fold)))
    found, f = score_quality(docs, trees, keep=["doc_id"])
    return found.select(
        "doc_id", held_out("doc_id", folds, fold).alias("held_out"), F.col(f"{f}.score").alias("score"),
        (F.col(f"{f}.score") >= THRESHOLD).cast("int").alias("predicted"),
    )
