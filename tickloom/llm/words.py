"""Whole texts as sums over words, with each distinct word worked out once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class WordTable:
    """Rows of numbers by word, worked out for all new words of a slice at once by ``compute(list of words)``.

    Holds at most ``cap`` words plus those of one slice; then it starts anew, so memory is bounded whatever the
    vocabulary.
    """

    def __init__(self, compute: Callable[[list[str]], np.ndarray], cap: int = 200_000):
        self.compute, self.cap = compute, cap
        self.row: dict[str, int] = {}
        self.rows: np.ndarray | None = None

    def indices(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each list of words their row numbers in ``rows``."""
        new = set().union(*texts).difference(self.row)
        if len(self.row) + len(new) > self.cap:
            self.row, self.rows = {}, None
            new = set().union(*texts)
        if new or self.rows is None:
            words = sorted(new)
            values = self.compute(words)
            start = 0 if self.rows is None else len(self.rows)
            self.rows = values if self.rows is None else np.concatenate([self.rows, values])
            self.row.update(zip(words, range(start, start + len(words)), strict=True))
        at = self.row.__getitem__
        return [np.fromiter(map(at, w), np.int64, len(w)) for w in texts]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser for unsigned arrays."""
    with np.errstate(over="ignore"):
        z = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def characters(words: list[str], first: str, last: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between two marks, and the place within its own word of each of them."""
    lengths = np.array([len(w) + len(first) + len(last) for w in words], np.int64)
    points = np.frombuffer("".join(first + w + last for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return points.astype(np.uint64), place


def ngram_hashes(points: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the hash of the n characters that end at each place; 0 where the word has fewer."""
    with np.errstate(over="ignore"):
        out = [mix64(points + np.uint64(0x9E3779B97F4A7C15))]
        for n in range(2, order + 1):
            back = np.zeros_like(points)
            back[n - 1 :] = points[: len(points) - n + 1]
            h = mix64(out[-1] * np.uint64(0x9E3779B97F4A7C15) + back + np.uint64(n << 32))
            out.append(np.where(place >= n - 1, h, np.uint64(0)))
    return out
