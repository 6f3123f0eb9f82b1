"""A small quantum-channel model of symbol sequences: one matrix a symbol, probabilities by repeated application.

The model's parameters are tiny and live on the driver; sequences are scored, and gradients summed, where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def polar(v: np.ndarray) -> np.ndarray:
    """The nearest matrix with orthonormal columns: v (v* v)^(-1/2)."""
    values, vectors = np.linalg.eigh(v.conj().T @ v)
    return v @ (vectors / np.sqrt(np.maximum(values, 1e-12))) @ vectors.conj().T


@dataclass
class KrausModel:
    """``k``: (symbols, d, d) with sum of k* k = 1; ``rho``: the state before a sequence, of trace 1."""

    k: np.ndarray
    rho: np.ndarray

    @classmethod
    def random(cls, symbols: int, d: int, seed: int = 0) -> KrausModel:
        rng = np.random.default_rng(seed)
        v = polar(rng.normal(size=(symbols * d, d)) + 1j * rng.normal(size=(symbols * d, d)))
        rho = np.zeros((d, d), complex)
        rho[0, 0] = 1
        return cls(v.reshape(symbols, d, d), rho)

    def residual(self) -> float:
        """How far the matrices are from preserving trace."""
        return float(np.abs(np.einsum("sij,sik->jk", self.k.conj(), self.k) - np.eye(self.k.shape[1])).max())

    def path(self, seq: list[int]) -> tuple[np.ndarray, float]:
        """The product of a sequence's matrices, last leftmost, and the sequence's probability."""
        op = np.eye(self.k.shape[1], dtype=complex)
        for s in seq:
            if s >= 0:
                op = self.k[s] @ op
        return op, max(float(np.trace(op @ self.rho @ op.conj().T).real), 0.0)

    def probabilities(self, seqs: list) -> np.ndarray:
        """Probabilities of sequences together, step by step; symbols below 0 are padding."""
        longest = max(map(len, seqs), default=0)
        state = np.repeat(self.rho[None], len(seqs), 0)
        padded = np.full((len(seqs), longest), -1)
        for i, s in enumerate(seqs):
            padded[i, : len(s)] = s
        for t in range(longest):
            on = padded[:, t] >= 0
            k = self.k[padded[on, t]]
            state[on] = k @ state[on] @ k.conj().transpose(0, 2, 1)
        return np.maximum(np.trace(state, axis1=1, axis2=2).real, 0.0)

    def gradient(self, seqs: list, weights: np.ndarray) -> tuple[np.ndarray, float]:
        """Of -sum of weight * log p by the conjugate matrices, and that sum."""
        out, loss = np.zeros_like(self.k), 0.0
        for seq, w in zip(seqs, weights, strict=True):
            seq = [s for s in seq if s >= 0]
            states = [self.rho]
            for s in seq:
                states.append(self.k[s] @ states[-1] @ self.k[s].conj().T)
            p = max(float(np.trace(states[-1]).real), 1e-12)
            loss -= w * np.log(p)
            later = np.eye(len(self.rho), dtype=complex)
            for s, before in zip(reversed(seq), reversed(states[:-1]), strict=True):
                out[s] -= w / p * (later @ self.k[s] @ before)
                later = self.k[s].conj().T @ later @ self.k[s]
        return out, loss


def score(df: DataFrame, model: KrausModel, out: str = "prob") -> DataFrame:
    """Every row of ``df`` (with ``seq``) and its sequence's probability; a null sequence counts as empty."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            p[out] = shared.value.probabilities([[] if s is None else list(s) for s in p.seq])
            yield p

    return df.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` double"]))


def fit(df: DataFrame, model: KrausModel, steps: int = 50, rate: float = 0.1) -> tuple[KrausModel, list[float]]:
    """Lowers the weighted negative log likelihood of ``df`` (seq, emp_prob) and gives each step's loss.

    A step is one pass: tasks sum gradients, the driver gets symbols * d * d sums, moves along the gradient (its norm
    clipped at 1) and restores orthonormal columns.
    """
    spark, (m, d, _) = df.sparkSession, model.k.shape
    df = df.select("seq", F.greatest(F.col("emp_prob"), F.lit(0.0)).alias("w"))
    total, losses = df.agg(F.sum("w")).first()[0] or 1.0, []
    for _ in range(steps):
        shared = spark.sparkContext.broadcast(model)

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for p in frames:
                g, loss = shared.value.gradient(p.seq.tolist(), p.w.to_numpy())
                flat = np.append(g.ravel(), loss)
                yield pd.DataFrame({"at": np.arange(len(flat)), "re": flat.real, "im": flat.imag})

        flat = np.zeros(m * d * d + 1, complex)
        for r in df.mapInPandas(run, "at long, re double, im double").groupBy("at").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).collect():
            flat[r["at"]] = (r.re + 1j * r.im) / total
        losses.append(float(flat[-1].real))
        g = flat[:-1].reshape(m * d, d)
        v = model.k.reshape(m * d, d)
        g = g - v @ (v.conj().T @ g + g.conj().T @ v) / 2  # along the manifold of orthonormal columns
        model = KrausModel(polar(v - rate * g / max(1.0, float(np.linalg.norm(g)))).reshape(m, d, d), model.rho)
    return model, losses


def save(model: KrausModel, spark: SparkSession, path: str) -> None:
    rows = [("k", s, i, j, float(z.real), float(z.imag)) for (s, i, j), z in np.ndenumerate(model.k)]
    rows += [("rho", 0, i, j, float(z.real), float(z.imag)) for (i, j), z in np.ndenumerate(model.rho)]
    spark.createDataFrame(rows, "part string, s int, i int, j int, re double, im double").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> KrausModel:
    rows = spark.read.parquet(path).collect()
    m, d = max(r.s for r in rows) + 1, max(r.i for r in rows) + 1
    out = KrausModel(np.zeros((m, d, d), complex), np.zeros((d, d), complex))
    for r in rows:
        if r.part == "k":
            out.k[r.s, r.i, r.j] = r.re + 1j * r.im
        else:
            out.rho[r.i, r.j] = r.re + 1j * r.im
    return out


def likelihood_loss(p: Column, emp: Column, eps: float = 1e-12) -> Column:
    """Aggregate: weighted mean of -log p."""
    w = F.greatest(emp, F.lit(0.0))
    return F.sum(-w * F.log(F.greatest(p, F.lit(eps)))) / F.sum(w)


def square_loss(p: Column, emp: Column) -> Column:
    """Aggregate: mean of emp * (emp - p) squared."""
    return F.avg(emp * (emp - p) * (emp - p))


def total_square_loss(p: Column, emp: Column) -> Column:
    return F.sum(emp * (emp - p) * (emp - p))


def length_weighted(p: Column, length: Column, longest: int, kind: str = "uniform", alpha: float = 0.5) -> Column:
    """p times the length's share: alike for all, geometric in alpha, or none."""
    if kind == "none":
        return p
    if kind == "uniform":
        return p / longest
    if kind != "geometric":
        raise ValueError("kind must be 'uniform', 'geometric' or 'none'")
    return p * F.pow(F.lit(alpha), length) / sum(alpha**n for n in range(1, longest + 1))
