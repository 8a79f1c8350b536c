"""Toxicity by weak supervision: voters -> generative label model -> linear classifier on posterior labels.

1. Voters. Lexicon voters fire on a word or word beginning: a fixed list of insults, and terms mined from a bounded
   sample of labelled rows (``TRAIN_ROWS``). Pattern voters fire on shouting, exclamation marks and the like.
2. Votes of every document are a bit mask. Spark counts the masks (pre-aggregated, so repeated texts cost nothing).
3. Label model: a two-class generative model over all documents' masks, fitted by expectation maximisation that starts
   from, and keeps counting, the labelled rows. It estimates the correlations of voters within the toxic class, joins
   correlated voters into groups so that their evidence counts once, and estimates how often each group fires in either
   class (its accuracy). Each step is a Spark job over the mask counts that returns a fixed number of moments.
4. Classifier: logistic regression on hashed words and word beginnings, trained on the sample's posterior labels; every
   whole text is scored in numpy.

Defined cases: null and empty texts have no features and get the score of the intercept; without positive or negative
labels there is nothing to mine, the fixed lexicon votes alone and the prior stays at its start; ties in mining go to the
smaller hash; repeated rows are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import RangeHash, labelled_sample, map_text, mix64, word_bounds
from riskloom.llm.langid import held_out
from riskloom.session import materialise

#: Bound of the sample of labelled rows that mining and training use.
TRAIN_ROWS = 6_000
THRESHOLD = 0.7
MINED, FEATURES, PRIOR = 38, 2_000, 0.05
#: The label model is fitted in EM_STEPS steps for each grouping of the voters; voters correlated over LINKED are grouped.
EM_STEPS, REGROUPINGS, LINKED = 3, 2, 0.25
#: A mined term is at least LIFT times as frequent in toxic rows as in others, and in SUPPORT toxic rows (and 0.5 % of them).
LIFT, SUPPORT = 40, 4
#: General English insults that vote from the start.
INSULTS = (
    "idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb",
    "imbecile", "bastard", "filth", "vermin", "jerk", "freak", "coward", "liar", "pig",
)
PATTERNS = ("shouting", "exclaiming", "questioning", "starred")
PREFIXES = (4, 5, 6)
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(97, 123), *range(128, 256)]] = False


def features(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's words (3 bytes and more) and of their beginnings of PREFIXES bytes."""
    data = np.frombuffer(text.lower(), np.uint8)
    starts, ends = word_bounds(data, _SEPARATOR)
    if not len(starts):
        return np.zeros(0, np.uint64)
    hashed, sizes = RangeHash(data), ends - starts
    found = [hashed(starts[sizes >= 3], ends[sizes >= 3])]
    for k in PREFIXES:
        longer = starts[sizes > k]
        found.append(mix64(hashed(longer, longer + k)))
    return np.unique(np.concatenate(found))


def word_feature(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(RangeHash(data)(np.array([0]), np.array([len(data)]))[0])


def patterns(text: bytes) -> list[bool]:
    """Votes of PATTERNS."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    words = max(1, counts[32] + counts[10])
    return [upper > lower, counts[33] > words * 0.2, counts[63] > words * 0.2, counts[42] > words * 0.2]


def vote_mask(found: np.ndarray, text_votes: list[bool], voters: np.ndarray) -> int:
    """Bits of the lexicon voters (hashes, any order) that a text's features hold, then of the patterns."""
    bits = 0
    for k in np.flatnonzero(np.isin(voters, found)):
        bits |= 1 << int(k)
    for k, on in enumerate(text_votes):
        bits |= int(on) << (len(voters) + k)
    return bits


def mine_voters(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Feature hashes that vote: the fixed insults, then terms far more frequent in toxic rows (chi-squared order);
    a term that occurs in nearly the same toxic rows as a chosen one is skipped."""
    chosen = [word_feature(w) for w in INSULTS]
    support = max(SUPPORT, -(-int(y.sum()) // 200))
    toxic = [r for r, label in zip(rows, y, strict=True) if label]
    clean = [r for r, label in zip(rows, y, strict=True) if not label]
    if not toxic or not clean:
        return np.array(chosen, np.uint64)
    terms, n1 = np.unique(np.concatenate(toxic), return_counts=True)
    terms, n1 = terms[n1 >= support], n1[n1 >= support]
    everything, counts = np.unique(np.concatenate(clean), return_counts=True)
    n0 = np.zeros(len(terms), np.int64)
    at = np.minimum(np.searchsorted(everything, terms), max(0, len(everything) - 1))
    if len(everything):
        n0 = np.where(everything[at] == terms, counts[at], 0)
    p1, p0 = n1 / len(toxic), n0 / len(clean)
    p = (n1 + n0) / (len(toxic) + len(clean))
    chi = np.where(p1 > LIFT * p0, (p1 - p0) ** 2 / np.maximum(p * (1 - p), 1e-9), 0)
    holds = lambda h: frozenset(i for i, r in enumerate(toxic) if (j := np.searchsorted(r, h)) < len(r) and r[j] == h)
    taken = [x for h in np.array(chosen, np.uint64) if (x := holds(h))]
    for k in np.lexsort((terms, -chi))[: 16 * MINED]:
        if chi[k] <= 0 or len(chosen) >= MINED + len(INSULTS):
            break
        mine = holds(terms[k])
        if all(len(mine & o) < 0.9 * len(mine | o) for o in taken):
            taken.append(mine)
            chosen.append(int(terms[k]))
    return np.array(chosen, np.uint64)


@dataclass
class LabelModel:
    """Two classes; voters that are correlated within the toxic class form one group, which votes if any of it does."""

    prior: float
    group: np.ndarray  # of each voter
    fire: np.ndarray  # 2 x groups: how often a group votes in a clean and in a toxic text

    def grouped(self, votes: np.ndarray) -> np.ndarray:
        """0/1 votes of the groups, from rows of 0/1 votes of the voters."""
        member = np.zeros((len(self.group), self.fire.shape[1]))
        member[np.arange(len(self.group)), self.group] = 1
        return (votes @ member > 0).astype(float)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of the toxic class for rows of 0/1 votes of the voters."""
        on, off = np.log(self.fire[1] / self.fire[0]), np.log((1 - self.fire[1]) / (1 - self.fire[0]))
        odds = np.log(self.prior / (1 - self.prior)) + self.grouped(votes) @ (on - off) + off.sum()
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def moments(self, votes: np.ndarray, weight: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """Weights, votes of groups and pairs of voters in the toxic class, weights and votes of groups in all; flat."""
        r, g = weight * toxic, self.grouped(votes)
        pairs = (votes * r[:, None]).T @ votes
        return np.concatenate([[r.sum(), weight.sum()], pairs.ravel(), r @ g, weight @ g])

    def refit(self, total: np.ndarray) -> LabelModel:
        """The model with prior and firing rates estimated anew from summed moments."""
        toxic, both, n = total[0], total[1], len(self.group)
        on1, on = np.split(total[2 + n * n :], 2)
        fire = np.stack([(on - on1 + 0.05) / (both - toxic + 2), (on1 + 0.5) / (toxic + 2)])
        return LabelModel(float(np.clip((toxic + 1) / (both + 2), 1e-4, 0.5)), self.group, np.clip(fire, 1e-5, 1 - 1e-5))


def bits_of(masks: np.ndarray, n: int) -> np.ndarray:
    return ((masks[:, None] >> np.arange(n)) & 1).astype(float)


def correlated_groups(toxic: float, pairs: np.ndarray) -> np.ndarray:
    """Group number of each voter: voters linked by a correlation over LINKED within the toxic class."""
    n = len(pairs)
    rate = np.clip(pairs.diagonal() / max(toxic, 1), 1e-9, 1 - 1e-9)
    spread = np.sqrt(rate * (1 - rate))
    linked = (pairs / max(toxic, 1) - np.outer(rate, rate)) / np.outer(spread, spread) > LINKED
    group = np.arange(n)
    for _ in range(n):
        least = np.where(linked | np.eye(n, dtype=bool), group[None, :], n).min(1)
        if (least == group).all():
            break
        group = least
    return np.unique(group, return_inverse=True)[1]


def fit_label_model(masks: DataFrame, known_votes: np.ndarray, y: np.ndarray, n: int) -> LabelModel:
    """``masks``: (mask, count) of all documents. The labelled rows give the start and go on counting."""
    ones, toxic = np.ones(len(y)), y.astype(float)
    pairs, share = np.zeros((n, n)), 0.0
    if len(y):
        pairs, share = (known_votes * toxic[:, None]).T @ known_votes, toxic.sum()
    for _ in range(REGROUPINGS):
        group = correlated_groups(share, pairs) if share else np.arange(n)
        start = np.tile(np.array([[0.002], [0.1]]), (1, int(group.max()) + 1))  # rates to begin with where nothing is known
        model = LabelModel(PRIOR, group, start)
        known = model.moments(known_votes, ones, toxic)
        if len(y) and 0 < toxic.sum() < len(y):
            model = model.refit(known)
        for _ in range(EM_STEPS):
            total = summed_moments(masks, model, n, len(known)) + known
            model = model.refit(total)
        share, pairs = total[0], total[2 : 2 + n * n].reshape(n, n)
    return model


def summed_moments(masks: DataFrame, model: LabelModel, n: int, size: int) -> np.ndarray:
    """Moments of all masks under the model's posterior: a Spark job that returns ``size`` numbers."""

    def run(batches):
        total = None
        for b in batches:
            votes = bits_of(np.asarray(b.column(0)), n)
            part = model.moments(votes, np.asarray(b.column(1)).astype(float), model.posterior(votes))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["place", "value"])

    parts = masks.mapInArrow(run, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value"))
    got = dict(parts.collect())
    return np.array([got.get(k, 0.0) for k in range(size)])


@dataclass
class Linear:
    terms: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float

    def score(self, found: np.ndarray) -> float:
        on = np.searchsorted(self.terms, found)
        on = np.minimum(on, max(0, len(self.terms) - 1))
        hit = self.terms[on] == found if len(self.terms) else np.zeros(len(found), bool)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[on[hit]].sum(), -40, 40))))


def train_linear(rows: list[np.ndarray], target: np.ndarray) -> Linear:
    """Logistic regression on the presence of the FEATURES terms that vary most with the soft target."""
    mean = float(np.clip(target.mean(), 1e-3, 1 - 1e-3)) if len(target) else PRIOR
    bias = float(np.log(mean / (1 - mean)))
    if not len(rows) or not sum(map(len, rows)):
        return Linear(np.zeros(0, np.uint64), np.zeros(0), bias)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    terms, column, counts = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    lift = np.abs(np.bincount(column, (target - mean)[owner])) / np.sqrt(counts + 5)
    lift[counts < 3] = 0
    top = np.sort(np.lexsort((terms, -lift))[:FEATURES])
    place = np.full(len(terms), -1)
    place[top] = np.arange(len(top))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    w, b, vw, vb = np.zeros(len(top)), bias, np.zeros(len(top)), 0.0
    balance = np.where(target > 0.5, 0.5 / max(mean, 0.02), 0.5 / (1 - mean))
    step = 4.0 / len(rows)
    for _ in range(400):
        margin = b + np.bincount(owner, w[column], minlength=len(rows))
        g = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - target) * balance
        vw = 0.9 * vw - step * (np.bincount(column, g[owner], minlength=len(top)) + 0.3 * w)
        vb = 0.9 * vb - step * 0.1 * g.sum()
        w, b = w + vw, b + vb
    return Linear(terms[top], w, float(b))


def learn_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> Linear:
    """The classifier; ``labels`` must hold only rows that may be learned from."""

    def make():
        def apply(texts):
            return {"features": [features(t).tobytes() for t in texts], "patterns": [patterns(t) for t in texts]}

        return apply

    sample = labelled_sample(docs, labels, label, rows)
    found, f = map_text(sample, make, "features binary, patterns array<boolean>", keep=["doc_id", "label"], out="seen")
    got = found.select("doc_id", "label", f"{f}.*").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    known = [np.frombuffer(x.as_buffer(), np.uint64) for x in got.column("features")]
    y = np.array(got.column("label").to_pylist(), int)
    voters = mine_voters(known, y)
    n = len(voters) + len(PATTERNS)
    known_masks = np.array([vote_mask(x, p, voters) for x, p in zip(known, got.column("patterns").to_pylist(), strict=True)], np.int64)
    masks = count_masks(docs, voters)
    model = fit_label_model(masks, bits_of(known_masks, n), y, n)
    return train_linear(known, model.posterior(bits_of(known_masks, n)))


def count_masks(docs: DataFrame, voters: np.ndarray) -> DataFrame:
    """(mask, count) over all documents, stored because each step of the label model reads it."""
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    def make():
        return lambda texts: {"mask": [vote_mask(features(t), patterns(t), sent.value) for t in texts]}

    votes, v = map_text(docs, make, "mask bigint", keep=[], out="votes")
    return materialise(votes.groupBy(F.col(f"{v}.mask").alias("mask")).count(), "vote-masks")


def score_toxicity(docs: DataFrame, model: Linear, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a struct column (its name is returned too) holding the score of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: {"score": [sent.value.score(features(t)) for t in texts]}

    return map_text(docs, make, "score double", text=text, keep=keep, out="toxicity")


def toxicity_report(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted; labels are learned only from rows outside the fold."""
    model = learn_toxicity(docs, labels.where(~held_out("doc_id", folds, fold)))
    found, f = score_toxicity(docs, model, keep=["doc_id"])
    return found.select(
        "doc_id", held_out("doc_id", folds, fold).alias("held_out"), F.col(f"{f}.score").alias("score"),
        (F.col(f"{f}.score") >= THRESHOLD).cast("int").alias("predicted"),
    )
