"""Language-model scoring: smoothed n-grams as a weighted backoff automaton.

The model keeps every n-gram of all training texts, so no task and not the driver can hold it. Texts are grouped
into chunks of a few MB, each a file in the shared folder. Order by order a chunk asks, shard by shard of the hashed n-grams, for the
corpus counts of the n-grams it has itself, giving its own training counts with the question; a shard adds up what all
chunks gave and answers each, and says whether another chunk has the n-gram. One whose beginning or end no other chunk has
is in no other chunk either, so its count is known without asking. From the answers a chunk builds its part of the automaton
and runs its texts through it.

Smoothing: p(w | h) = (c(hw) + k p(w | h')) / (c(h) + k) with h' one word shorter (a Dirichlet prior), down to
p(w) = (c(w) - d) / N for training words and d V / N for the one unknown word, d from the counts of counts.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import _slices
from .common import held_out, shared_dir, small_batches, written
from .token_output import _publish, _store
from .words import mix64

#: Bytes of a hashed n-gram within its shard: 64 bits for words, whose counts are reported, 48 for longer ones.
_WORD, _GRAM = 8, 6
#: Stretches of a chunk's tokens that go through the automaton side by side.
_LANES = 2_048
_ASKED = "shard int, chunk string, keys binary, counts binary"
_ANSWERED = "chunk string, shard int, level int, totals binary, n long, v long, n1 long, n2 long"


def _planes(values: np.ndarray, width: int) -> bytes:
    """Little-endian integers byte by byte, all first bytes before all second ones: small numbers compress well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8")[:, 0]


def _chunks(batches: Iterator[pa.RecordBatch], out_dir: str, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Writes each slice of texts as a chunk and gives its file's name and number of tokens."""
    import xxhash
    import zstandard

    class Numbers(dict):
        def __missing__(self, word):
            n = self[word] = len(self)
            return n

    context, nth = TaskContext.get(), 0
    fs, root = _store(out_dir)
    for batch, texts in _slices(batches, "text", chunk_bytes):
        number = Numbers()
        end = number[b""]  # no word is empty
        parts = []
        for t in texts.to_pylist():
            words = t.encode().lower().split() if t else []
            parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            parts.append(np.array([end]))
        tokens = np.concatenate(parts)
        packed = zstandard.ZstdCompressor(level=1).compress(_planes(tokens, 4))
        ids, buffer = batch.column(0), io.BytesIO()
        np.savez(
            buffer,
            doc_id=ids.fill_null(0).to_numpy(zero_copy_only=False),
            null=ids.is_null().to_numpy(zero_copy_only=False),
            held=batch.column(2).to_numpy(zero_copy_only=False).astype(bool),
            lengths=np.array([len(p) + 1 for p in parts[::2]], np.int64),
            hashes=np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number)),
            tokens=np.frombuffer(packed, np.uint8),
        )
        name = f"{context.partitionId()}-{context.taskAttemptId()}-{nth}"
        with fs.open_output_stream(f"{root}/{name}.part") as f:
            f.write(buffer.getvalue())
        _publish(fs, f"{root}/{name}", "part")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(tokens)], pa.int64())], names=["chunk", "tokens"])
        nth += 1


class _Chunk:
    """A chunk's tokens and the n-grams in them up to ``order``, in a fixed order; the same each time it is read."""

    def __init__(self, data: dict[str, np.ndarray], order: int):
        import zstandard

        self.doc_id, self.null, self.held, self.lengths, self.hashes = (data[k] for k in ("doc_id", "null", "held", "lengths", "hashes"))
        self.tokens = _from_planes(zstandard.ZstdDecompressor().decompress(data["tokens"].tobytes()), 4).astype(np.int64)
        train = np.repeat(~self.held, self.lengths)
        self.begins = np.cumsum(self.lengths) - self.lengths
        place = self.place = np.arange(len(self.tokens)) - np.repeat(self.begins, self.lengths)
        #: of each order: each position's n-gram number (-1: too near the text's start), the n-grams' first positions, own training
        #: counts, hashes, and the numbers of their beginnings and ends, one word shorter
        first = np.zeros(len(self.hashes), np.int64)
        first[self.tokens[::-1]] = np.arange(len(self.tokens))[::-1]
        self.gram, self.first, self.count, self.keys, self.before, self.after = [self.tokens], [first], [], [self.hashes], [None], [None]
        self.count.append(np.bincount(self.tokens[train], minlength=len(self.hashes)))
        for n in range(2, order + 1):
            # the history of a text's first word is the end of text (number 0)
            before = np.where(place > 0, np.roll(self.gram[-1], 1), 0 if n == 2 else -1)
            valid = before >= 0
            _, at, inverse = np.unique(before[valid] * len(self.hashes) + self.tokens[valid], return_index=True, return_inverse=True)
            gram = np.full(len(self.tokens), -1)
            gram[valid] = inverse
            where = np.flatnonzero(valid)[at]
            with np.errstate(over="ignore"):
                self.keys.append(mix64(self.keys[-1][before[where]] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[self.tokens[where]] + np.uint64(n)))
            self.before.append(before[where])
            self.after.append(self.gram[-1][where])
            self.gram.append(gram)
            self.first.append(where)
            self.count.append(np.bincount(gram[valid & train], minlength=len(where)))

    @classmethod
    def read(cls, out_dir: str, name: str, order: int) -> _Chunk:
        fs, root = _store(out_dir)
        with fs.open_input_file(f"{root}/{name}") as f, np.load(io.BytesIO(f.read())) as z:
            return cls({k: z[k] for k in z.files}, order)

    def asked(self, n: int, shared: list[np.ndarray], shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams of order ``n`` that other chunks may have, in the order in which they are asked for, their hashes, and where each shard's begin."""
        which = np.arange(len(self.keys[n - 1]))
        if n > 1:
            which = which[shared[n - 2][self.before[n - 1]] & shared[n - 2][self.after[n - 1]]]
        hashed = self.keys[n - 1][which]
        shard = (hashed % np.uint64(shards)).astype(np.int64)
        value = hashed if n == 1 else hashed >> np.uint64(16)
        order = np.lexsort((value, shard))
        return which[order], value[order], np.searchsorted(shard[order], np.arange(shards + 1))

    def answered(self, answers: pd.DataFrame, order: int, shards: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of each order the corpus counts, and whether another chunk has the n-gram."""
        totals, shared = [], []
        for n in range(1, order + 1):
            which, _, _ = self.asked(n, shared, shards)
            got = answers[answers.level == n].sort_values("shard")
            found = np.concatenate([_from_planes(x, 8) for x in got.totals]).astype(np.int64) if len(got) else np.zeros(0, np.int64)
            total, other = self.count[n - 1].astype(np.int64), np.zeros(len(self.keys[n - 1]), bool)
            total[which], other[which] = found >> 1, (found & 1).astype(bool)
            totals.append(total)
            shared.append(other)
        return totals, shared


def _ask(name: str, c: _Chunk, n: int, shared: list[np.ndarray], shards: int) -> pd.DataFrame:
    which, value, cut = c.asked(n, shared, shards)
    keys, counts = [], []
    for s in range(shards):
        part = slice(cut[s], cut[s + 1])
        keys.append(_planes(np.diff(value[part], prepend=np.uint64(0)), _WORD if n == 1 else _GRAM))
        counts.append(_planes(c.count[n - 1][which[part]], 4))
    out = pd.DataFrame({"shard": np.arange(shards, dtype=np.int32), "chunk": name, "keys": keys, "counts": counts})
    return out[[len(k) > 0 for k in keys]]


def _answer(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """For each chunk's questions to one shard twice the corpus count, plus one where another chunk asks too. The first row also has
    the shard's statistics."""
    with np.errstate(over="ignore"):
        asked = [np.cumsum(_from_planes(x, _WORD if n == 1 else _GRAM), dtype=np.uint64) for x in rows["keys"]]
    given = np.concatenate([_from_planes(x, 4) for x in rows["counts"]])
    _, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(inverse, given).astype(np.int64)
    answers = (2 * total + (np.bincount(inverse) > 1))[inverse]
    ends = np.cumsum([len(a) for a in asked])
    out = {"chunk": rows["chunk"], "shard": rows["shard"], "level": n}
    out["totals"] = [_planes(answers[e - len(a) : e], 8) for a, e in zip(asked, ends, strict=True)]
    stats = (total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()) if n == 1 else (0, 0, 0, 0)
    for name, value in zip(("n", "v", "n1", "n2"), stats, strict=True):
        out[name] = [int(value)] + [0] * (len(rows) - 1)
    return pd.DataFrame(out)


class Automaton:
    """A chunk's part of the model. States are histories, state 0 the empty one. Each n-gram of the training texts is an arc from
    its history; where a state lacks an arc, its failure arc leads, at its weight, to the state one word shorter. State 0 has an
    arc for every word. Weights are log10 probabilities.

    ``arcs[m]`` has for each position the arc for its word from a history of the m words before it, -1 where there is none.
    """

    def __init__(self, c: _Chunk, totals: list[np.ndarray], stats: tuple[int, int, int, int], k: tuple[float, ...]):
        n, v, n1, n2 = stats
        d = min(max(n1 / max(n1 + 2.0 * n2, 1.0), 0.1), 0.9)
        count, orders = totals[0], len(c.gram)
        prob = np.where(count > 0, count - d, d * max(v, 1)) / n if n else np.ones(len(count))
        state, level, fail_weight, fail_state, made = [], [np.zeros(1, np.int64)], [np.zeros(1)], [np.zeros(1, np.int64)], 1
        for m in range(1, orders):  # a history of m words is a state if the training texts have it
            known = totals[m - 1] > 0
            shorter = np.zeros(len(known), np.int64) if m == 1 else state[-1][c.after[m - 1]]
            state.append(np.where(known, made + np.cumsum(known) - 1, shorter))
            fail_weight.append(np.log10(k[m - 1] / (totals[m - 1][known] + k[m - 1])))
            fail_state.append(shorter[known])
            level.append(np.full(int(known.sum()), m))
            made += int(known.sum())
        self.level, self.fail_weight, self.fail_state = np.concatenate(level), np.concatenate(fail_weight), np.concatenate(fail_state)
        self.start = int(state[0][0]) if state else 0
        weights, targets, self.arcs = [np.log10(prob)], [state[0] if state else np.zeros(len(prob), np.int64)], [c.tokens]
        for m in range(2, orders + 1):
            seen, of = totals[m - 1] > 0, totals[m - 2][c.before[m - 1]]
            prob = (totals[m - 1] + k[m - 2] * prob[c.after[m - 1]]) / (of + k[m - 2])
            number = np.append(np.where(seen, sum(map(len, weights)) + np.cumsum(seen) - 1, -1), -1)
            self.arcs.append(number[c.gram[m - 1]])
            weights.append(np.log10(prob[seen]))
            targets.append((state[m - 1] if m < orders else state[m - 2][c.after[m - 1]])[seen])
        self.weight, self.target = np.concatenate(weights), np.concatenate(targets)

    def traverse(self, place: np.ndarray) -> np.ndarray:
        """One left-to-right pass: the log10 probability of the word at each position after those before it in its text.

        Stretches of the positions go side by side. A state has at most order - 1 words, so one that begins within a text
        reads so many words before its own to come into the state that the words before it would have left.
        """
        size, reach = len(place), len(self.arcs) - 1
        lane = max(1, -(-size // _LANES))
        begin, out, arcs = np.arange(0, size, lane), np.zeros(size), np.stack(self.arcs)
        state = np.zeros(len(begin), np.int64)
        for step in range(-reach, lane):
            at = begin + step
            use = (at >= 0) & (at < size)
            p = at[use]
            s = np.where(place[p] == 0, self.start, state[use])
            total, arc = np.zeros(len(p)), arcs[self.level[s], p]
            missing = np.flatnonzero(arc < 0)
            while len(missing):
                failed = s[missing]
                total[missing] += self.fail_weight[failed]
                s[missing] = self.fail_state[failed]
                arc[missing] = arcs[self.level[s[missing]], p[missing]]
                missing = missing[arc[missing] < 0]
            state[use] = self.target[arc]
            if step >= 0:
                out[p] = total + self.weight[arc]
        return out


def _score(out_dir: str, answers: pd.DataFrame, order: int, shards: int, stats: tuple[int, int, int, int], k: tuple[float, ...]) -> pd.DataFrame:
    c = _Chunk.read(out_dir, answers["chunk"].iloc[0], order)
    totals, _ = c.answered(answers, order, shards)
    score = Automaton(c, totals, stats, k).traverse(c.place)
    base = np.log10((totals[0] + 1.0) / (stats[0] + stats[1] + 1.0))[c.tokens]
    return pd.DataFrame(
        {
            "doc_id": pd.array(np.where(c.null, None, c.doc_id.astype(object)), "Int64"),
            "held_out": c.held,
            "n_tokens": c.lengths,
            "n_known": np.add.reduceat((totals[0] > 0)[c.tokens].astype(np.int64), c.begins),
            "train_tokens": stats[0],
            "base_score": np.add.reduceat(base, c.begins),
            "score": np.add.reduceat(score, c.begins),
        }
    )


def score(
    docs: DataFrame, order: int = 3, k: tuple[float, ...] = (1000.0, 100.0), modulus: int = 7, chunk_bytes: int = 4_000_000, shard_tokens: int = 2_500_000
) -> DataFrame:
    """Every row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from all texts that aren't held out (remainder 2 of crc32 of the id by ``modulus``). Its counts
    are exact but for hash collisions: words have 64 bits, longer n-grams 48 within their shard, and shards grow in
    number with the corpus. ``k`` has a prior weight for each order from 2. Null and empty texts are the end token alone; a null id
    trains. Repeated rows count and are scored each; an empty table gives no rows; other columns are ignored. Without training texts
    the one unknown word has probability 1.

    ``chunk_bytes`` bounds a task's part of the model, ``shard_tokens`` (corpus tokens for each shard) the counts in
    one task. Chunks (files that tasks write and read, so they aren't shuffled) and answers are in the shared folder, so a lost
    executor costs its tasks alone.
    """
    if len(k) < order - 1:
        raise ValueError(f"order {order} needs {order - 1} values of k")
    small_batches(docs.sparkSession)
    out_dir = shared_dir(docs.sparkSession, "lm-texts")
    fs, root = _store(out_dir)
    fs.create_dir(root)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id"), modulus).alias("held")
    )
    chunks = written(rows.mapInArrow(lambda b: _chunks(b, out_dir, chunk_bytes), "chunk string, tokens long"), "lm-chunks")
    count, tokens = chunks.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    shards = max(1, -(-tokens // shard_tokens))

    def words(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pandas(_ask(name, _Chunk.read(out_dir, name, 1), 1, [], shards), preserve_index=False)

    def grams(n):
        def ask(answers):
            name = answers["chunk"].iloc[0]
            c = _Chunk.read(out_dir, name, n)
            return _ask(name, c, n, c.answered(answers, n - 1, shards)[1], shards)

        return ask

    def replies(n):
        return lambda rows: _answer(rows, n)

    answers = None
    for n in range(1, order + 1):
        if n == 1:
            asked = chunks.select("chunk").repartition(max(1, count)).mapInArrow(words, _ASKED)
        else:
            asked = answers.groupBy("chunk").applyInPandas(grams(n), _ASKED)
        found = asked.groupBy("shard").applyInPandas(replies(n), _ANSWERED)
        found = written(found, "lm-answers")
        answers = found if answers is None else answers.unionByName(found)
    stats = tuple(x or 0 for x in answers.agg(*(F.sum(c) for c in ("n", "v", "n1", "n2"))).first())
    return answers.groupBy("chunk").applyInPandas(
        lambda rows: _score(out_dir, rows, order, shards, stats, k),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
