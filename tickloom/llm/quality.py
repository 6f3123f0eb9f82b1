"""Quality: random-indexing word vectors pooled per text, then a two-layer network with calibrated probabilities."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import _slices
from .common import labelled_sample, small_batches
from .words import WordTable, characters, mix64, ngram_hashes

_LOWER, _UPPER, _DIGIT = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")


def _shape(word: str) -> str:
    """Letters and digits by kind, runs as one, other characters as they are."""
    return "\x00" + _DIGIT.sub("0", _UPPER.sub("A", _LOWER.sub("a", word)))


def _hash(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word, from its characters and their places."""
    if not words:
        return np.zeros(0, np.uint64)
    points, place = characters(words, "\x02", "\x03")
    with np.errstate(over="ignore"):
        each = mix64(ngram_hashes(points, place, 2)[1] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + points)
        return mix64(np.add.reduceat(each, np.flatnonzero(place == 0)))


def index_vectors(words: list[str], dim: int, nonzero: int = 6) -> np.ndarray:
    """The words' fixed sparse random vectors: ``nonzero`` places with +1 or -1, drawn from the word's hash."""
    h, out = _hash(words), np.zeros((len(words), dim), np.float32)
    for k in range(nonzero):
        with np.errstate(over="ignore"):
            r = mix64(h + np.uint64(k + 1) * np.uint64(0xD1B54A32D192ED03))
        np.add.at(out, (np.arange(len(h)), (r % np.uint64(dim)).astype(np.int64)), np.where(r >> np.uint64(63), 1.0, -1.0))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1.0)


@dataclass
class QualityModel:
    dim: int
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # hashes of words and shapes, sorted
    context: np.ndarray | None = None  # their context vectors, then one of zeros
    layers: list[np.ndarray] | None = None
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    temperature: float = 1.0

    def words(self, words: list[str]) -> np.ndarray:
        """Context vector and index vector of each word. An unknown word has its shape's context."""
        at = self.places(words)
        new = np.flatnonzero(at == len(self.known))
        at[new] = self.places([_shape(words[i]) for i in new])
        return np.hstack([self.context[at], index_vectors(words, self.dim // 2)]).astype(np.float32)

    def places(self, keys: list[str]) -> np.ndarray:
        """The keys' rows of ``context``; of unknown ones the last, which is zero."""
        h = _hash(keys)
        at = np.searchsorted(self.known, h)
        if len(self.known):
            at[self.known[np.minimum(at, len(self.known) - 1)] != h] = len(self.known)
        return at

    def pooled(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A text's features: the mean context vector, how concentrated its index vectors are, and how alike
        neighbours are."""
        if not len(at):
            return np.zeros(self.dim + 3)
        total = np.zeros(rows.shape[1])
        for a in range(0, len(at), 50_000):
            total += rows[at[a : a + 50_000]].sum(0, dtype=np.float64)
        mean = total / len(at)
        alike = float((at[1:] == at[:-1]).mean()) if len(at) > 1 else 0.0
        return np.concatenate([mean[: self.dim], [float(mean[self.dim :] @ mean[self.dim :]), alike, np.log(len(at))]])

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((features - self.centre) / self.spread @ w1 + b1) @ w2 + b2

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(features), 0.5)
        z = self.logits(features) / self.temperature
        return 1.0 / (1.0 + np.exp(np.clip(z[:, 0] - z[:, 1], -30, 30)))


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    rows /= np.where(norm > 0, norm, rows.dtype.type(1))  # in place
    return rows


def _contexts(model: QualityModel, split: list[list[str]], backoff: float, reach: int = 2) -> None:
    """Each word's context vector: the index vectors of the words around it (their own and their shapes'), summed, plus
    ``backoff`` times its shape's direction, which is the sum over all words of that shape; then of length 1. So a rare
    word is near its shape and a common one near its own contexts."""
    words = sorted(set().union(*split))
    shaped = [_shape(w) for w in words]
    shapes = sorted(set(shaped))
    number = {w: i for i, w in enumerate(words)}
    at = {s: i for i, s in enumerate(shapes)}
    shape_of = np.array([at[s] for s in shaped] + [len(shapes)])
    empty = len(words)
    ids = np.concatenate([np.array([number[w] for w in s] + [empty] * reach) for s in split])
    vectors = np.zeros((empty + 1, model.dim), np.float32)
    for a in range(0, empty, 20_000):
        b = min(empty, a + 20_000)
        vectors[a:b] = index_vectors(words[a:b], model.dim) / np.float32(2**0.5)
    vectors[:-1] += (index_vectors(shapes, model.dim) / np.float32(2**0.5))[shape_of[:-1]]
    sums = np.zeros((empty, model.dim), np.float32)
    for step in range(1, reach + 1):
        for to, of in ((ids[:-step], ids[step:]), (ids[step:], ids[:-step])):
            for k in range(model.dim):
                sums[:, k] += np.bincount(to, vectors[of, k], empty + 1)[:-1]
    del vectors
    whole = _unit(np.column_stack([np.bincount(shape_of[:-1], sums[:, k], len(shapes)) for k in range(model.dim)]).astype(np.float32))
    for a in range(0, empty, 20_000):
        sums[a : a + 20_000] += np.float32(backoff) * whole[shape_of[:-1][a : a + 20_000]]
    keys = [*words, *shapes]
    hashes = np.concatenate([_hash(keys[a : a + 20_000]) for a in range(0, len(keys), 20_000)])
    model.known, first = np.unique(hashes, return_index=True)
    model.context = np.zeros((len(first) + 1, model.dim), np.float32)
    of_word = first < empty
    model.context[:-1][of_word] = _unit(sums)[first[of_word]]
    model.context[:-1][~of_word] = whole[first[~of_word] - empty]


def _network(x: np.ndarray, y: np.ndarray, hidden: int, epochs: int) -> list[np.ndarray]:
    """Two layers by Adam on the class-weighted cross-entropy."""
    rng = np.random.default_rng(11)
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    weight, step = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 128):
            b = order[a : a + 128]
            w1, b1, w2, b2 = layers
            h = np.tanh(x[b] @ w1 + b1)
            z = h @ w2 + b2
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(b)), y[b]] -= 1
            dz = p * weight[b, None] / len(b)
            dh = dz @ w2.T * (1 - h**2)
            step += 1
            for i, g in enumerate((x[b].T @ dh + 1e-4 * w1, dh.sum(0), h.T @ dz + 1e-4 * w2, dz.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] = layers[i] - 0.003 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return layers


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, max_chars: int = 30_000_000, dim: int = 48, backoff: float = 8.0, hidden: int = 32, epochs: int = 60) -> QualityModel:
    """A model from a bounded sample: ``per_class`` labelled texts a class, of ``max_chars`` characters in all.

    Every word of the sample has a context vector, in whole, and so has every shape; both are held by 64-bit hashes. Each fifth text sets the temperature, the one of a grid with the least log loss. Where a class is missing every
    score is 0.5.
    """
    sample = labelled_sample(docs, labels, "quality", per_class, max_chars)
    sample = [(t.split(), y) for t, y in sample if t.strip()]
    model = QualityModel(dim)
    if len({y for i, (_, y) in enumerate(sample) if i % 5}) < 2:
        model.context = np.zeros((1, dim), np.float32)
        return model
    _contexts(model, [s for s, _ in sample], backoff)
    table = WordTable(model.words)
    at = table.indices([s for s, _ in sample])
    x = np.array([model.pooled(table.rows, a) for a in at])
    y = np.array([y for _, y in sample])
    fit = np.arange(len(y)) % 5 != 0
    model.centre, model.spread = x[fit].mean(0), x[fit].std(0) + 1e-6
    model.layers = _network((x[fit] - model.centre) / model.spread, y[fit], hidden, epochs)
    z, target = model.logits(x[~fit]), y[~fit]
    gap = (z[:, 1] - z[:, 0]) * np.where(target == 1, 1, -1)
    if len(gap):
        model.temperature = float(min(np.geomspace(0.5, 10, 40), key=lambda t: np.mean(np.logaddexp(0, -gap / t))))
    return model


def predict(docs: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 where score >= threshold) of every row of ``docs``.

    Null, empty and blank texts get the score of no words. Repeated rows give repeated rows, an empty table none;
    other columns are left out. Texts are scored whole, where they are read; the model, which the sample's
    ``max_chars`` bounds, is broadcast.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        table = WordTable(m.words, 150_000)
        for batch, texts in _slices(batches, "text"):
            split = [t.split() if t else [] for t in texts.to_pylist()]
            at = table.indices(split)
            score = m.score(np.array([m.pooled(table.rows, a) for a in at]).reshape(len(at), -1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
