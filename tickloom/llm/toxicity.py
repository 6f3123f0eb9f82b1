"""Toxicity: bags of subword embeddings, averaged over short windows, into a linear softmax.

A window's vector is the mean of its words' vectors, a word's the mean of its character n-grams' embeddings, so a
misspelling shares most of its word's vectors. A text is as toxic as its worst window: every window of the whole
text counts, and one insult in a long text isn't averaged away.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import _slices
from .common import labelled_sample, small_batches
from .words import WordTable, characters, ngram_hashes

_SHORTEST, _LONGEST = 3, 5
#: Texts whose words must have an n-gram for it to be trained; rarer ones stay zero, so that no text is learned by heart.
_FEWEST = 4
#: Characters around a word that aren't part of it.
_AROUND = "\"'`.,;:!?()[]{}<>|*#%&$~-_+=/\\^"


@dataclass
class ToxicityModel:
    """``scores``: each bucket's embedding times the difference of the softmax's two rows; see :func:`train`."""

    scores: np.ndarray
    bias: float
    window: int
    slope: float = 1.0
    shift: float = 0.0

    def words(self, words: list[str]) -> np.ndarray:
        buckets, starts = _buckets(words, len(self.scores))
        counts = np.diff(np.append(starts, len(buckets)))
        return (np.add.reduceat(self.scores[buckets], starts) / counts)[:, None] if len(words) else np.zeros((0, 1))

    def worst(self, word_scores: np.ndarray) -> float:
        """The highest mean score of a window; that of no words is the bias alone."""
        return self.bias + (_windows(word_scores, self.window).max() if len(word_scores) else 0.0)


def _buckets(words: list[str], size: int, step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all n-grams of all words, and where each word's begin. Every word has one at least."""
    parts, starts, done = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    for a in range(0, len(words), step):
        values, first = _some_buckets(words[a : a + step], size)
        parts.append(values.astype(np.int32))
        starts.append(first + done)
        done += len(values)
    return np.concatenate(parts), np.concatenate(starts)


def _some_buckets(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    points, place = characters([w.strip(_AROUND) or w for w in words], "\x02", "\x03")
    first = np.flatnonzero(place == 0)
    owner = np.cumsum(place == 0) - 1
    hashes = ngram_hashes(points, place, _LONGEST)[_SHORTEST - 1 :]
    found = [np.flatnonzero(place >= n) for n in range(_SHORTEST - 1, _LONGEST)]
    short = np.diff(np.append(first, len(points))) < _SHORTEST
    values = [h[f] for h, f in zip(hashes, found, strict=True)] + [points[first[short]]]
    owners = [owner[f] for f in found] + [np.flatnonzero(short)]
    values, owners = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (values[order] % np.uint64(size)).astype(np.int64), np.searchsorted(owners[order], np.arange(len(words)))


def _windows(values: np.ndarray, width: int) -> np.ndarray:
    """Means of all runs of ``width`` values; of all values where there are fewer."""
    width = min(width, len(values))
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (sums[width:] - sums[:-width]) / width


def _fit(texts: list[str], y: np.ndarray, size: int, dim: int, window: int, epochs: int) -> tuple[np.ndarray, float]:
    """Embeddings and softmax together, by Adagrad over all texts.

    One embedding axis starts at the n-grams' log odds. In each epoch a text's worst window under the present model
    takes the gradient.
    """
    rng = np.random.default_rng(7)
    row: dict[str, int] = {}
    docs = [np.array([row.setdefault(w, len(row)) for w in t.lower().split()], np.int32) for t in texts]
    vocabulary = list(row)
    del row
    buckets, starts = _buckets(vocabulary, size)
    counts = np.diff(np.append(starts, len(buckets)))
    per_word = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=len(vocabulary))
    common = np.bincount(buckets, np.repeat(per_word, counts), size) >= _FEWEST
    per_class = [np.bincount(np.concatenate([np.unique(d) for d, k in zip(docs, y, strict=True) if k == c]), minlength=len(vocabulary)) for c in (0, 1)]
    seen_in = [np.bincount(buckets, np.repeat(np.minimum(n, m), counts), size) for n, m in zip(per_class, ((y == 0).sum(), (y == 1).sum()), strict=True)]
    odds = np.log((seen_in[1] + 0.5) / (y.sum() + 1.0)) - np.log((seen_in[0] + 0.5) / ((1 - y).sum() + 1.0))
    embedding = np.zeros((size, dim), np.float32)
    embedding[:, 0] = np.clip(odds, -2, 2) * common  # a start; all of it is trained on
    softmax = rng.normal(0, 0.3, (dim, 2)).astype(np.float32)
    softmax[0] = (-0.5, 0.5)
    bias = np.zeros(2, np.float32)
    seen = [np.full_like(x, 1e-8) for x in (embedding, softmax, bias)]
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for _ in range(epochs):
        direction = softmax[:, 1] - softmax[:, 0]
        value = np.add.reduceat((embedding @ direction)[buckets], starts) / counts
        parts = []
        for d in docs:
            at = int(_windows(value[d], window).argmax())
            parts.append(d[at : at + window])
        chosen, who = np.concatenate(parts), np.repeat(np.arange(len(docs)), [len(p) for p in parts])
        size_of = np.bincount(who, minlength=len(docs))
        words, inverse = np.unique(chosen, return_inverse=True)
        lengths = counts[words]
        inner = np.repeat(starts[words] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        used = buckets[inner]
        vectors = np.add.reduceat(embedding[used], np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]
        pooled = np.stack([np.bincount(who, vectors[inverse, k], len(docs)) for k in range(dim)], 1) / size_of[:, None]
        logits = pooled @ softmax + bias
        p = 1.0 / (1.0 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -30, 30)))
        error = (weight * (p - y))[:, None] * np.array([[-1.0, 1.0]])
        to_pooled = error @ softmax.T / size_of[:, None]
        to_words = np.stack([np.bincount(inverse, to_pooled[who, k], len(words)) for k in range(dim)], 1) / lengths[:, None]
        per_gram = np.repeat(to_words, lengths, axis=0)
        gradient = np.stack([np.bincount(used, per_gram[:, k], size) for k in range(dim)], 1) * common[:, None]
        for x, g, s, rate in ((embedding, gradient, seen[0], 0.1), (softmax, pooled.T @ error, seen[1], 0.05), (bias, error.sum(0), seen[2], 0.05)):
            s += g**2
            x -= (rate * g / np.sqrt(s)).astype(np.float32)
    return embedding @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, max_chars: int = 30_000_000, buckets: int = 1 << 17, dim: int = 8, window: int = 4, epochs: int = 60) -> ToxicityModel:
    """A model from a bounded sample: ``per_class`` labelled texts a class, of ``max_chars`` characters in all.

    Each fifth text calibrates the score (logistic regression on the worst window's logit, class weights undone so
    that the score is a probability at the sample's balance). Where a class is missing, every score is 0.5.
    """
    sample = labelled_sample(docs, labels, "toxic", per_class, max_chars)
    sample = [(t, y) for t, y in sample if t.strip()]
    fit, check = [s for i, s in enumerate(sample) if i % 5], sample[::5]
    if len({y for _, y in fit}) < 2:
        return ToxicityModel(np.zeros(buckets, np.float32), 0.0, window, 0.0, 0.0)
    scores, bias = _fit([t for t, _ in fit], np.array([y for _, y in fit]), buckets, dim, window, epochs)
    model = ToxicityModel(scores, bias, window)
    table = WordTable(model.words)
    x = np.array([model.worst(table.rows[at][:, 0]) for at in table.indices([t.lower().split() for t, _ in check])])
    slope, shift = logistic(x, np.array([y for _, y in check]))
    if slope > 0:  # else the check is too small to tell
        model.slope, model.shift = slope, shift
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of p = 1 / (1 + exp(-(slope * x + shift))), by damped Newton steps with a weak prior."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    scale = x.std() or 1.0
    a, w = np.column_stack([(x - x.mean()) / scale, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 0.01 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.eye(2) * 0.01
        step = np.linalg.solve(h, g)
        w -= step / max(1.0, np.abs(step).max())
    return float(w[0] / scale), float(w[1] - w[0] * x.mean() / scale)


def predict(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 where score >= threshold) of every row of ``docs``.

    Null, empty and blank texts get the score of no words. Repeated rows give repeated rows, an empty table none;
    other columns are left out. Texts are scored whole, where they are read; the model (0.5 MB) is broadcast.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        table = WordTable(m.words, 400_000)
        for batch, texts in _slices(batches, "text"):
            split = [t.lower().split() if t else [] for t in texts.to_pylist()]
            x = np.array([m.worst(table.rows[at, 0]) for at in table.indices(split)])
            score = 1.0 / (1.0 + np.exp(-np.clip(m.slope * x + m.shift, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
