"""Ordinal quality classifier: cumulative-link regression on graded ratings of hashed texts.

A label gives a grade: 0 toxic, 1 not toxic but of low quality, 2 good. One weight vector is shared by all
grades, P(grade <= j) = sigmoid(threshold_j - score), with ordered thresholds, so that a document has a score, an
expected grade and the probability of each tail. A text's features are its hashed words, the hashed beginnings of its
words (4 and 6 bytes, for languages that inflect or compound) and marks of form (how many words, and the share of words in
capitals, with symbols, long, or repeated).

A word counts in two ways: a weight below 0 is a fault and counts whole, however long the text; a weight above 0 is praise
and counts by the word's share of the text (with ``PRIOR`` neutral words added, so that a few words prove little). So a
long text neither buries a fault nor gathers praise by its length, and the marks of length even out what a short one lacks. Words whose share among the texts of some grade is not clearly another one than among all texts
get no weight, so that long texts do not gather noise.

The model is fitted on at most ``max_rows`` labelled documents (the first by a hash of doc_id), whose hashed features
come to the driver; scoring runs over all documents in Arrow batches with the weights broadcast, whose size is
fixed by ``buckets``.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import text_bytes, text_slices, words_of

GRADES = 3
#: What praise that every word gives is multiplied by, and words of no praise that are added to each text.
PRAISE = 10.0
PRIOR = 100
_STEMS = (4, 6)
_FORMS = 128  # the first buckets are for marks of form
_LENGTHS = 64  # and the second half of them for lengths


def _form_tables() -> tuple[np.ndarray, np.ndarray]:
    symbol, upper = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
    symbol[[ord(c) for c in "#*$%&|<>!{}=\\@_^~"]] = True
    upper[65:91] = True
    return symbol, upper


_SYMBOL, _UPPER = _form_tables()


def features(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, owner, bucket): words of each text, and all features of all texts by text number.

    A word's features come once for each time it is there; marks of form come once a text.
    """
    data, offsets = text_bytes(column)
    hashes, owner, starts, ends = words_of(data, offsets, _STEMS)
    n = np.bincount(owner, minlength=len(column))
    marked = lambda at: np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=len(starts))
    marks = (
        marked(np.flatnonzero(_SYMBOL[data])) > 0,
        marked(np.flatnonzero(_UPPER[data])) > 1,
        np.concatenate(([False], (hashes[0][1:] == hashes[0][:-1]) & (owner[1:] == owner[:-1])))[: len(owner)],
        ends - starts > 24,
    )
    texts, forms = [], []
    shares = [np.bincount(owner[m], minlength=len(column)) * 8 // np.maximum(n, 1) for m in marks]
    for i, level in enumerate([*shares, np.ceil(np.log2(n + 1)).astype(np.int64)]):
        t = np.repeat(np.arange(len(column)), level)
        step = np.arange(len(t)) - np.repeat(np.cumsum(level) - level, level)
        texts.append(t)
        forms.append((16 * i if i < len(marks) else _LENGTHS) + 1 + step)
    place = lambda h: ((h >> np.uint64(24)) % np.uint64(buckets - _FORMS)).astype(np.int64) + _FORMS
    return n, np.concatenate([*texts, *[owner] * len(hashes)]), np.concatenate([*forms, *map(place, hashes)])


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by bucket, ascending thresholds between the grades, and the P(good) from which a text is kept."""

    weights: np.ndarray
    thresholds: np.ndarray
    bar: float = 0.5

    def scores(self, n: np.ndarray, owner: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Score of each text from what ``features`` gives: marks and faults once, praise by its share."""
        weight = self.weights[bucket].astype(np.float64)
        praise = (weight > 0) & (bucket >= _FORMS)
        out = np.bincount(owner[praise], weight[praise], minlength=len(n)) * PRAISE / ((n + PRIOR) * (1 + len(_STEMS)))
        once = np.flatnonzero((weight != 0) & ~praise)
        pairs = np.unique(owner[once] * len(self.weights) + bucket[once])
        return out + np.bincount(pairs // len(self.weights), self.weights[pairs % len(self.weights)], minlength=len(n))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) for each score (row) and threshold (column)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


@dataclass(frozen=True)
class Ratings:
    """Rated texts: their features (row, column), each feature's share where it is praise, and the grades."""

    rows: np.ndarray
    columns: np.ndarray
    shares: np.ndarray
    grades: np.ndarray

    def scores(self, weights: np.ndarray) -> np.ndarray:
        own = weights[self.columns]
        return np.bincount(self.rows, np.where(own > 0, own * self.shares, own), minlength=len(self.grades))

    def loss(self, weights: np.ndarray, gap: np.ndarray) -> float:
        """Mean negative log likelihood, grades weighted to count alike."""
        p, share = self._likelihood(self.scores(weights), gap)[0], self._importance()
        return float(-(share * np.log(p)).sum() / len(p))

    def slopes(self, weights: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Derivatives of the loss by each weight, were it a fault and were it praise, and by ``gap``."""
        n, g = len(self.grades), self.grades
        p, slope = self._likelihood(self.scores(weights), gap)
        share, at = self._importance(), np.arange(n)
        hi, lo = slope[at, g + 1] / p * share, slope[at, g] / p * share
        by_score = (hi - lo) / n
        fault = np.bincount(self.columns, by_score[self.rows], minlength=len(weights))
        praise = np.bincount(self.columns, by_score[self.rows] * self.shares, minlength=len(weights))
        by_cut = np.array([-np.sum(np.where(g == j, hi, 0) - np.where(g == j + 1, lo, 0)) for j in range(GRADES - 1)]) / n
        return fault, praise, np.array([by_cut.sum(), by_cut[1] * np.exp(gap[1])])

    def _importance(self) -> np.ndarray:
        count = np.bincount(self.grades, minlength=GRADES)
        return (len(self.grades) / (np.maximum(count, 1) * np.count_nonzero(count)))[self.grades]

    def _likelihood(self, scores: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        below = 1 / (1 + np.exp(np.clip(scores[:, None] - thresholds(gap)[None, :], -60, 60)))
        no, at = np.zeros((len(scores), 1)), np.arange(len(scores))
        edges = np.concatenate((no, below, no + 1), axis=1)
        slope = np.concatenate((no, below * (1 - below), no), axis=1)
        return np.maximum(edges[at, self.grades + 1] - edges[at, self.grades], 1e-9), slope


def thresholds(gap: np.ndarray) -> np.ndarray:
    """The first threshold, and the second by the logarithm of its distance: they stay in order."""
    return np.array([gap[0], gap[0] + np.exp(gap[1])])


def telling(ratings: Ratings, buckets: int, least: int = 5, clear: float = 5.0) -> np.ndarray:
    """Buckets that get a weight.

    Of words, those that ``least`` texts or more have and for which, in some grade, the number of texts with it
    is ``clear`` standard deviations or more from what chance gives; of forms, all that are there.
    """
    have = np.bincount(ratings.columns, minlength=buckets).astype(np.float64)
    out = np.zeros(buckets, dtype=bool)
    for g in range(GRADES):
        q = np.count_nonzero(ratings.grades == g) / max(len(ratings.grades), 1)
        got = np.bincount(ratings.columns[ratings.grades[ratings.rows] == g], minlength=buckets)
        out |= np.abs(got - have * q) > clear * np.sqrt(np.maximum(have * q * (1 - q), 1e-9))
    out &= have >= least
    out[:_FORMS] = have[:_FORMS] > 0
    return out


def fit(ratings: Ratings, buckets: int, l2: float = 1e-4, rate: float = 0.5, flat: float = 0.003, most_steps: int = 3000) -> OrdinalModel:
    """Full-batch AdaGrad on the cumulative-link likelihood, until the slope's length is ``flat`` of what it was at the start.

    A weight that would change its sign stops at 0 for a step. Marks of form take larger steps than the many words that come with them, and so most of the credit.
    A fit that is not flat after ``most_steps`` is used as it is, with a warning.
    """
    weights, gap = np.zeros(buckets), np.array([-2.0, np.log(2.0)])
    if not len(ratings.grades):
        return OrdinalModel(weights.astype(np.float32), thresholds(gap))
    use = telling(ratings, buckets)[ratings.columns]
    own = Ratings(ratings.rows[use], ratings.columns[use], ratings.shares[use], ratings.grades)
    scale = np.where(np.arange(buckets) < _LENGTHS, 3.0, 1.0)
    seen_w, seen_c, first = np.full(buckets, 1e-8), np.full(GRADES - 1, 1e-8), None
    for _ in range(most_steps):
        fault, praise, by_cut = own.slopes(weights * scale, gap)
        fault, praise = fault * scale, praise * scale
        at_zero = np.where(praise < 0, praise, np.maximum(fault, 0))
        by_weight = np.where(weights < 0, fault, np.where(weights > 0, praise, at_zero)) + l2 * weights
        slope = float(np.sqrt((by_weight**2).sum() + (by_cut**2).sum()))
        first = slope if first is None else first
        if slope <= flat * first:
            break
        seen_w += by_weight**2
        seen_c += by_cut**2
        moved = weights - rate * by_weight / np.sqrt(seen_w)
        weights = np.where(weights * moved < 0, 0.0, moved)
        gap = gap - rate * by_cut / np.sqrt(seen_c)
    else:
        warnings.warn(f"the fit is not flat after {most_steps} steps: {slope / first:.4f} of the first slope", stacklevel=2)
    return OrdinalModel((weights * scale).astype(np.float32), thresholds(gap))


def split(ratings: Ratings, every: int = 5) -> tuple[Ratings, Ratings]:
    """Ratings without every ``every``-th text, and those texts."""
    held = np.arange(len(ratings.grades)) % every == every - 1

    def part(texts: np.ndarray) -> Ratings:
        own = texts[ratings.rows]
        return Ratings((np.cumsum(texts) - 1)[ratings.rows[own]], ratings.columns[own], ratings.shares[own], ratings.grades[texts])

    return part(~held), part(held)


def best_bar(model: OrdinalModel, held: Ratings) -> float:
    """The lowest P(good), in steps of 0.05, that keeps most of the good texts above what it keeps of either lower grade; 0.5 if a grade is missing."""
    count = np.bincount(held.grades, minlength=GRADES)
    if not count.all():
        return 0.5
    good = model.tails(held.scores(model.weights.astype(np.float64)))[:, 1]
    bars = np.arange(1, 20) / 20
    kept = np.array([np.bincount(held.grades[good >= bar], minlength=GRADES) / count for bar in bars])
    return float(bars[np.argmax(np.round(kept[:, 2] - kept[:, :2].max(axis=1), 9))])


def _feature_batches(buckets: int):
    def run(batches):
        for batch in batches:
            for start, part in text_slices(batch.column("text")):
                n, owner, bucket = features(part, buckets)
                pairs, times = np.unique(owner * buckets + bucket, return_counts=True)
                ends = np.searchsorted(pairs // buckets, np.arange(len(part) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, x) for x in ((pairs % buckets).astype(np.int32), times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column("grade").slice(start, len(part)), pa.array(n, pa.int64()), *lists], names=["grade", "n", "buckets", "times"])

    return run


def rated_texts(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(grade, text) of at most ``max_rows`` labelled documents. Null ratings and labels without a text are left out.

    Of rows that repeat a doc_id the first by text is taken, and of several labels the lowest grade.
    """
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1).cast("long")
    rated = labels.where("doc_id is not null and toxic is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))
    chosen = rated.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(chosen, "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("grade", "text")


def ratings_of(rated: DataFrame, buckets: int) -> Ratings:
    """The features of rated texts, on the driver."""
    sample = rated.mapInArrow(_feature_batches(buckets), "grade long, n long, buckets array<int>, times array<int>").toArrow()
    rows = sorted(zip(*(sample.column(c) for c in ("buckets", "times", "n", "grade")), strict=True), key=lambda r: (r[0].values.to_numpy().tobytes(), r[3].as_py()))
    none = np.empty(0, dtype=np.int64)  # the order of arrival must not matter
    sizes = [len(r[0].values) for r in rows]
    columns = np.concatenate([none, *(r[0].values.to_numpy() for r in rows)])
    times = np.concatenate([none, *(r[1].values.to_numpy() for r in rows)])
    words = np.repeat(np.array([r[2].as_py() + PRIOR for r in rows], dtype=np.int64), sizes)
    shares = np.where(columns < _FORMS, 1.0, times * PRAISE / (words * (1 + len(_STEMS))))
    return Ratings(np.repeat(np.arange(len(rows)), sizes), columns, shares, np.array([r[3].as_py() for r in rows], dtype=np.int64))


def train(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 18, max_rows: int = 8000) -> OrdinalModel:
    """Fit on four fifths of at most ``max_rows`` labelled documents; the rest choose the bar."""
    own, held = split(ratings_of(rated_texts(docs, labels, max_rows), buckets))
    model = fit(own, buckets)
    return replace(model, bar=best_bar(model, held))


def score(docs: DataFrame, model: OrdinalModel, least_good: float | None = None) -> DataFrame:
    """(doc_id, score, expected_grade, p_above_toxic, p_good, kept): a row for each row of ``docs``.

    ``kept`` if P(good) is at least ``least_good``, or the model's bar. A null, empty or wordless text can't be judged: its score is
    null, its grade and probabilities are 0 and it is not kept. Repeated rows are scored alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bar = model.bar if least_good is None else least_good
    names = ["doc_id", "score", "expected_grade", "p_above_toxic", "p_good", "kept"]

    def run(batches):
        own = shared.value
        for batch in batches:
            for start, part in text_slices(batch.column("text")):
                n, owner, bucket = features(part, len(own.weights))
                scores = own.scores(n, owner, bucket)
                tails = own.tails(scores) * (n > 0)[:, None]
                columns = [pa.array(scores, mask=n == 0), *map(pa.array, (tails.sum(axis=1), tails[:, 0], tails[:, 1], (tails[:, 1] >= bar) & (n > 0)))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(part)), *columns], names=names)

    schema = "doc_id long, score double, expected_grade double, p_above_toxic double, p_good double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def quality_classifier(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, least_good: float | None = None) -> DataFrame:
    """Train on the labels and score every document; ``least_good`` instead of the bar that the labels choose, if given."""
    return score(docs, train(docs, labels, max_rows=max_rows), least_good)
