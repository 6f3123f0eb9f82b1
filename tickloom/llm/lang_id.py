"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import _slices
from .common import held_out, small_batches
from .words import WordTable, characters, ngram_hashes

#: Marks before and after a word.
_START, _END = "\x02", "\x03"
#: Lengths of 1, 2, 4, ... 512 characters have limits of their own. Longer texts have the last: a sample has too few of them to show how far
#: whole documents lie apart.
_LENGTHS = 10
#: Runs and characters that are scored at once.
_RUNS, _CHARACTERS = 20_000, 200_000


@dataclass
class LanguageModels:
    """One sorted array of n-gram hashes for each order, with a column for each language.

    ``prob[n]`` has log p(last character | those before), fully interpolated, or NaN where the language never had
    the n-gram; ``back[n]`` the log weight with which a language leaves the n-gram, as a history, for the next
    shorter one (0 where it never had it).
    """

    langs: list[str]
    order: int
    keys: list[np.ndarray]
    prob: list[np.ndarray]
    back: list[np.ndarray]
    floor: np.ndarray
    temperature: float = 0.05
    #: of each language, by the binary logarithm of the number of characters: the cross-entropy above which a text is rejected
    limits: np.ndarray | None = None

    def limit(self, lang: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The limits of texts of ``chars`` characters in languages number ``lang``, between two lengths in proportion."""
        at = np.clip(np.log2(np.maximum(chars, 1.0)), 0, _LENGTHS - 1)
        low = np.minimum(at.astype(np.int64), _LENGTHS - 2)
        own, part = self.limits[lang], at - low
        each = np.arange(len(lang))
        return own[each, low] * (1 - part) + own[each, low + 1] * part

    def characters(self, points: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log p of each character but the start marks, by language; 0 at the start marks."""
        logp = np.tile(self.floor, (len(points), 1))
        previous = None
        for n, h in enumerate(ngram_hashes(points, place, self.order)):
            keys = self.keys[n]
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            known = (keys[at] == h) & (h != 0) if len(keys) else np.zeros(len(h), bool)
            if n and previous is not None:
                before, had = previous
                weight = np.where(np.roll(had, 1)[:, None], self.back[n - 1][np.roll(before, 1)], 0.0)
                weight[place < n] = 0.0
                logp += weight
            if len(keys):
                own = np.where(known[:, None], self.prob[n][at], np.nan)
                logp = np.where(np.isnan(own), logp, own)
                previous = (at, known)
            else:
                previous = None
        logp[place == 0] = 0.0
        return logp

    def words(self, words: list[str]) -> np.ndarray:
        """Sum of log p for each language and the number of characters scored, a row for each word.

        A word's letters are scored run by run, each between its own marks.
        """
        import regex

        letters = regex.compile(r"\p{L}+")
        out = np.zeros((len(words), len(self.langs) + 1))
        runs, owner, size = [], [], 0
        for i, w in enumerate(words):
            for r in letters.findall(w):
                runs.append(r)
                owner.append(i)
                size += len(r)
                if len(runs) >= _RUNS or size >= _CHARACTERS:
                    self._add(out, runs, owner)
                    runs, owner, size = [], [], 0
        self._add(out, runs, owner)
        return out

    def _add(self, out: np.ndarray, runs: list[str], owner: list[int]) -> None:
        if len(runs) == 1 and len(runs[0]) > _CHARACTERS:  # a long run in stretches, each with the characters before it
            run, own = _START + runs[0] + _END, owner[0]
            for a in range(1, len(run), _CHARACTERS):
                before = min(a, self.order)
                points = np.frombuffer(run[a - before : a + _CHARACTERS].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                place = np.arange(len(points)) + (0 if before == a else self.order)
                out[own, :-1] += self.characters(points, place)[before:].sum(0)
            out[own, -1] += len(run) - 1
        elif runs:
            points, place = characters(runs, _START, _END)
            lengths = np.array([len(r) + 2 for r in runs])
            logp = np.add.reduceat(self.characters(points, place), np.cumsum(lengths) - lengths, axis=0)
            np.add.at(out, np.array(owner), np.column_stack([logp, lengths - 1.0]))


def _fit(texts: dict[str, list[str]], order: int) -> LanguageModels:
    """Interpolated Kneser-Ney: raw counts at the highest order, continuation counts below it."""
    import regex

    letters = regex.compile(r"\p{L}+")
    langs, tables, alphabet = sorted(texts), [], set()
    for lang in langs:
        runs = [r for t in texts[lang] for r in letters.findall(t.lower())]
        points, place = characters(runs, _START, _END)
        alphabet.update(np.unique(points).tolist())
        hashes = ngram_hashes(points, place, order)
        grams = []  # of each order: hash, history's hash, suffix's hash, count
        for n, h in enumerate(hashes):
            use = place >= max(n, 1)
            g, first, c = np.unique(h[use], return_index=True, return_counts=True)
            at = np.flatnonzero(use)[first]
            history = hashes[n - 1][at - 1] if n else np.zeros(len(g), np.uint64)
            suffix = hashes[n - 1][at] if n else np.zeros(len(g), np.uint64)
            grams.append((g, history, suffix, c))
        counts = [None] * order
        counts[-1] = grams[-1][3].astype(float)
        for n in range(order - 1):  # distinct characters before the n-gram, and once the word's start itself
            g, c = grams[n][0], np.zeros(len(grams[n][0]))
            np.add.at(c, np.searchsorted(g, grams[n + 1][2]), 1.0)
            at_start = np.unique(hashes[n][place == n]) if n else np.zeros(0, np.uint64)
            found = np.searchsorted(g, at_start)
            np.add.at(c, found[(found < len(g)) & (g[np.minimum(found, len(g) - 1)] == at_start)], 1.0)
            counts[n] = np.maximum(c, 1.0)
        tables.append((grams, counts))
    floor = -np.log(len(alphabet) + 1.0) * np.ones(len(langs))
    keys = [np.unique(np.concatenate([t[0][n][0] for t in tables] + [t[0][n + 1][1] for t in tables if n + 1 < order])) for n in range(order)]
    prob = [np.full((len(k), len(langs)), np.nan) for k in keys]
    back = [np.zeros((len(k), len(langs))) for k in keys]
    for j, (grams, counts) in enumerate(tables):
        lower = None
        for n in range(order):
            (g, history, suffix, _), c = grams[n], counts[n]
            ones, twos = (c == 1).sum(), (c == 2).sum()
            d = min(max(ones / max(ones + 2.0 * twos, 1.0), 0.1), 0.9)
            h, inverse = np.unique(history, return_inverse=True)
            total = np.bincount(inverse, c, len(h))
            gamma = d * np.bincount(inverse, minlength=len(h)) / total
            below = np.exp(floor[j]) if n == 0 else lower[np.searchsorted(grams[n - 1][0], suffix)]
            p = (c - d) / total[inverse] + gamma[inverse] * below
            prob[n][np.searchsorted(keys[n], g), j] = np.log(p)
            if n:
                back[n - 1][np.searchsorted(keys[n - 1], h), j] = np.log(gamma)
            else:
                floor[j] += np.log(gamma[0])
            lower = p
    return LanguageModels(langs, order, keys, [p.astype(np.float32) for p in prob], [b.astype(np.float32) for b in back], floor)


def _limits(models: LanguageModels, table: WordTable, texts: list[np.ndarray], y: np.ndarray, rate: float) -> np.ndarray:
    """Limits of all languages by length, from runs of 1, 2, 4, ... words of calibration texts of each language.

    At each length a limit lies half again as far above the median as the cross-entropy that a share ``rate`` of the runs
    exceeds, no lower than half more than the median, which leaves room for texts that mix known languages, and no lower than at the
    next greater length. Lengths without runs take the next known one; languages without
    calibration texts what all others have together.
    """
    found: list[list[list[np.ndarray]]] = [[[] for _ in range(_LENGTHS)] for _ in range(len(models.langs) + 1)]
    for at, lang in zip(texts, y, strict=True):
        own = table.rows[at][:, [lang, -1]]
        own = own[own[:, 1] > 0]
        step = 1
        while step <= max(len(own), 1):
            sums = np.add.reduceat(own, np.arange(0, len(own) - step + 1, step), axis=0) if len(own) >= step else own[:0]
            h, length = -sums[:, 0] / sums[:, 1], np.clip(np.round(np.log2(sums[:, 1])), 0, _LENGTHS - 1)
            for n in np.unique(length).astype(int):
                for k in (lang, -1):
                    found[k][n].append(h[length == n])
            step *= 2
    out = np.full((len(models.langs) + 1, _LENGTHS), np.nan)
    for k, by_length in enumerate(found):
        for n, parts in enumerate(by_length):
            if parts:
                h = np.concatenate(parts)
                middle = np.median(h)
                out[k, n] = max(middle + 1.5 * (np.quantile(h, 1 - rate) - middle), 1.5 * middle)
    for n in range(_LENGTHS - 2, -1, -1):
        out[:, n] = np.fmax(out[:, n], out[:, n + 1])
    for n in range(1, _LENGTHS):
        out[:, n] = np.where(np.isnan(out[:, n]), out[:, n - 1], out[:, n])
    out = np.where(np.isnan(out), out[-1], out)
    return np.where(np.isnan(out), np.inf, out)[:-1]


def train(docs: DataFrame, per_language: int = 400, max_chars: int = 8_000_000, order: int = 5, rate: float = 0.001, max_languages: int = 1_000) -> LanguageModels:
    """Models from a bounded sample: at most ``per_language`` training texts a language, of ``max_chars`` characters a language.

    Training texts are those with a non-null language that aren't held out; each is taken whole. Which of them are taken depends
    on a hash of doc_id alone; where they have more characters the longest are left out, but for a language's shortest, so no
    language is lost. A fifth of them calibrates: the temperature of the score by likelihood, and by :func:`_limits` the
    cross-entropies above which texts are rejected, so that of the stretches of texts of a known language, short ones too, at most about
    a share ``rate`` goes. More than ``max_languages`` languages are an error, since the models have a column for each.
    """
    rows = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id"), 4)).select("doc_id", "lang", "text")
    share = rows.groupBy("lang").agg((3.0 * per_language / F.count("*")).alias("share")).limit(max_languages + 1).collect()
    if len(share) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    share = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in share], "lang string, share double"))
    uniform = F.shiftrightunsigned(F.xxhash64("doc_id", F.length("text")), 11) / float(2**53)
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    shortest = Window.partitionBy("lang").orderBy(F.length("text"), "nth").rowsBetween(Window.unboundedPreceding, 0)
    sample = (
        rows.join(share, "lang")
        .where(uniform < F.col("share"))
        .withColumn("nth", F.row_number().over(first))
        .where(F.col("nth") <= per_language)
        .withColumns({"chars": F.sum(F.length("text")).over(shortest), "rank": F.row_number().over(shortest)})
        .where((F.col("chars") <= max_chars) | (F.col("rank") == 1))
        .select("lang", "text", "nth")
        .collect()
    )
    fit: dict[str, list[str]] = {}
    check: list[tuple[str, str]] = []
    for r in sorted(sample, key=lambda r: (r.lang, r.nth)):
        if r.nth % 5 == 0:
            check.append((r.lang, r.text))
        else:
            fit.setdefault(r.lang, []).append(r.text)
    fit = {k: v for k, v in fit.items() if any(c.isalpha() for t in v for c in t)}
    if not fit:
        return LanguageModels([], order, [np.zeros(0, np.uint64)] * order, [], [], np.zeros(0))
    models = _fit(fit, order)
    check = [c for c in check if c[0] in fit and any(x.isalpha() for x in c[1])]
    table = WordTable(models.words, 10_000_000)
    y = np.array([models.langs.index(lang) for lang, _ in check], np.int64)
    texts = table.indices([t.lower().split() for _, t in check])
    models.limits = _limits(models, table, texts, y, rate)
    if check:
        total = np.array([table.rows[at].sum(0) for at in texts])
        h = -total[:, :-1] / np.maximum(total[:, -1:], 1.0)
        gap = h - h.min(1, keepdims=True)
        loss = lambda t: np.mean(gap[np.arange(len(y)), y] / t + np.log(np.exp(-gap / t).sum(1)))
        models.temperature = float(min(np.geomspace(0.01, 2.0, 40), key=loss))
    return models


class _Scorer:
    """Language, score, cross-entropy and rejection of whole texts, by slices."""

    def __init__(self, models: LanguageModels):
        self.models, self.table = models, WordTable(models.words)

    def __call__(self, texts: list[str | None]) -> pd.DataFrame:
        m = self.models
        split = [t.lower().split() if t and m.langs else [] for t in texts]
        n = len(split)
        total = np.zeros((n, len(m.langs) + 1))
        for i, at in enumerate(self.table.indices(split)):
            if len(at):
                total[i] = self.table.rows[at].sum(0)
        known = total[:, -1] > 0
        lang, score, best = np.full(n, "und", object), np.zeros(n), np.full(n, np.nan)
        rejected = np.ones(n, bool)
        if known.any():
            h = -total[known, :-1] / total[known, -1:]
            j = h.argmin(1)
            best[known] = h.min(1)
            lang[known] = np.array(m.langs, object)[j]
            score[known] = 1.0 / np.exp(-(h - h.min(1, keepdims=True)) / m.temperature).sum(1)
            rejected[known] = best[known] > (m.limit(j, total[known, -1]) if m.limits is not None else np.inf)
        return pd.DataFrame({"lang_pred": lang, "score": score, "cross_entropy": best, "rejected": rejected})


def accepted(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`predict` doesn't reject."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        score = _Scorer(shared.value)
        for batch, texts in _slices(batches, "text"):
            yield batch.filter(pa.array(~score(texts.to_pylist()).rejected.to_numpy(bool)))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """Every row of ``docs``: doc_id, lang_pred, score, cross_entropy, rejected.

    The language with the lowest cross-entropy per character wins (the first by name among equals); ``score`` is its
    calibrated probability. Null texts and texts without letters get ``und`` and score 0, as do all texts where no
    language was learned. ``rejected`` is true for ``und`` and where the cross-entropy is above the language's limit at the text's length.
    Repeated rows give repeated rows, an empty table none, and other columns are left out. Texts are scored whole,
    where they are read; the models (bounded by the sample) are broadcast.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        score = _Scorer(shared.value)
        for batch, texts in _slices(batches, "text"):
            frame = score(texts.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(frame.lang_pred, pa.string()), pa.array(frame.score), pa.array(frame.cross_entropy, from_pandas=True), pa.array(frame.rejected)],
                names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")
