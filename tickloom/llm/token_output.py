"""Token-id shards: raw id payloads with a minimal perfect hash index, written and read by Spark tasks.

A shard ``shard-000007`` is three files:

* ``.bin`` the ids of its documents one after another, little-endian unsigned 16-bit (32-bit for vocabularies above
  65,536 ids), in ascending doc_id order;
* ``.idx`` the payload's type and the index: for a document's key the hash gives a slot, the slot a fingerprint, the first id's place in the
  payload and the number of ids;
* ``.key`` the documents' ids in order.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import _slices
from .common import held, small_batches

_U64 = np.uint64


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64) after adding a seed."""
    with np.errstate(over="ignore"):
        z = x.astype(_U64) + _U64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        z = (z ^ (z >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U64(27))) * _U64(0x94D049BB133111EB)
        return z ^ (z >> _U64(31))


class MinimalPerfectHash:
    """n distinct 64-bit keys to 0..n-1, about 3 bits a key.

    Each level is a bit array; keys that meet no other key in it take their bit, the rest go to the next level. A
    key's value is the number of set bits before its own.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = [np.asarray(x, np.uint8) for x in levels]
        self.bits = [np.unpackbits(x).astype(bool) for x in self.levels]
        self.rank, base = [], 0
        for b in self.bits:
            self.rank.append(base + np.concatenate([[0], np.cumsum(b)]))
            base = int(self.rank[-1][-1])

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> MinimalPerfectHash:
        levels: list[np.ndarray] = []
        rest = keys.astype(_U64)
        while len(rest):
            if len(levels) >= 64:
                raise ValueError("keys are not distinct")
            size = -(-max(64, int(gamma * len(rest))) // 8) * 8
            at = (_mix(rest, len(levels)) % _U64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone))
            rest = rest[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that no level knows."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.bits, self.rank, strict=True)):
            if not len(todo):
                break
            at = (_mix(keys[todo], level) % _U64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = rank[at[hit]]
            todo = todo[~hit]
        return out


def document_keys(ids: np.ndarray, null: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit keys of (doc_id, number of earlier rows with that id); ``ids`` is sorted, null ids come first."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    starts = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0)) if len(ids) else np.zeros(0, np.int64)
    nth = np.arange(len(ids)) - starts
    return _key(ids, null, nth, seed)


def _key(ids, null, nth, seed):
    base = _mix(ids.astype(np.int64).view(_U64), seed)
    base = np.where(null, _mix(base, 77), base)
    return np.where(nth > 0, _mix(base ^ _mix(nth.astype(_U64), 991)), base)


class WordEncoder:
    """Whole texts to ids with a tokenizers-library file that lower-cases and drops white space between words.

    What the library gives for a text is what it gives for its words, one after another, so the ids of words (runs without
    Unicode white space, A-Z lower-cased) are remembered, within about ``budget`` bytes, and only new words go to the library.
    Texts that needn't fall apart so go to it whole: those with one of the four separators on which Python's and Unicode's notions
    of white space differ, and those with the string of a special token. Such a string becomes the special token's id, as in a
    plain call of the library, or with ``special`` false is text like any other.
    """

    def __init__(self, json: str, special: bool = True, budget: int = 260_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_str(json), Tokenizer.from_str(json)
        letters = "abcdefghijklmnopqrstuvwxyz"
        same = self.plain.normalizer is None or self.plain.normalizer.normalize_str(letters) == letters
        if same and self.plain.pre_tokenizer is not None and [p for p, _ in self.plain.pre_tokenizer.pre_tokenize_str(letters)] == [letters]:
            # neither step changes or cuts a word of these letters, so such words can do without
            self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.Sequence([])
        self.tokenizer.encode_special_tokens = self.plain.encode_special_tokens = not special
        self.whole = tuple({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()} | set(_SEPARATORS))
        self.dtype = id_type(self.tokenizer.get_vocab_size())
        self.budget, self.used = budget, 0
        self.ids: dict[str, bytes] = {}

    def _packed(self, texts: list[str], tokenizer, step: int = 20_000) -> list[bytes]:
        out, code = [], {"<u2": "H", "<u4": "I"}[self.dtype]
        for a in range(0, len(texts), step):
            for e in tokenizer.encode_batch_fast(texts[a : a + step], add_special_tokens=False):
                ids = e.ids
                out.append(struct.pack(f"<{len(ids)}{code}", *ids))
        return out

    def _words(self, text: str | None) -> list[str] | None:
        if not text:
            return []
        # marks compose with the letter before them, differently with a capital one, and before lower-casing
        lower = text if _MARKS.search(text) else text.encode().lower().decode()
        return None if any(map(lower.lower().__contains__, self.whole)) else lower.split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self._words(t) for t in texts]
        words = list(set().union(*(w for w in split if w)))
        here = dict(zip(words, map(self.ids.get, words), strict=True))
        plain = [w for w, i in here.items() if i is None and _LETTERS.fullmatch(w)]
        other = [w for w, i in here.items() if i is None and not _LETTERS.fullmatch(w)]
        new = dict(zip(plain + other, self._packed(plain, self.plain) + self._packed(other, self.tokenizer), strict=True))
        here |= new
        self.used += _size(new)
        if self.used > self.budget:  # only the words of these texts stay
            self.ids, self.used = dict(here), _size(here)
        else:
            self.ids |= new
        word = here.__getitem__
        return [self._packed([t], self.tokenizer)[0] if ws is None else b"".join(map(word, ws)) for t, ws in zip(texts, split, strict=True)]


def _size(ids: dict[str, bytes]) -> int:
    """About the bytes that these take."""
    return 200 * len(ids) + sum(4 * len(w) + len(i) for w, i in ids.items())


_LETTERS = re.compile("[a-z]+")
#: Separators that are white space to Python but not to the library.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Marks that the library's normaliser may compose with a letter before them.
_MARKS = re.compile("[\u0300-\u036f]")


def id_type(size: int) -> str:
    """The payload's type for ids below ``size``."""
    return "<u2" if size <= 1 << 16 else "<u4"


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _publish(fs: pafs.FileSystem, path: str, attempt: int) -> None:
    """A finished file takes its final name; a repeated or speculative task writes the same bytes again."""
    fs.move(f"{path}.{attempt}", path)


def write_shards(docs: DataFrame, tokenizer_json: str, out_dir: str, end_id: int, shard_bytes: int = 24 << 20, special: bool = True) -> list[int]:
    """Writes all documents as shards below ``out_dir`` (a folder all executors share); gives each shard's id count.

    Documents are dealt to shards by ranges of doc_id (ties by a hash of the text), sorted within a shard, encoded
    and written; only text, doc_id and the shard totals move. Null texts count as empty and have the end id alone;
    null ids come first; repeated ids are kept, each under its own key; other columns are ignored. An empty table
    gives no shards. A shard's payload is written as it is encoded, so a task holds one slice of texts and the
    index of its own shard. ``special``: see :class:`WordEncoder`. Texts move and not their ids, since dealing by ranges reads its
    input twice and encoding costs more than reading.
    """
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    if not total:
        return []
    n = int(-(-total // shard_bytes))
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    with open(tokenizer_json, encoding="utf-8") as f:
        json = f.read()
    vocabulary = sc.broadcast(json)  # a fixed file of a few MB
    key = ("words", hashlib.sha256(json.encode()).hexdigest(), special)
    fs, root = _store(out_dir)
    fs.create_dir(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        fs, root = _store(out_dir)
        path = f"{root}/shard-{shard:06d}"
        encoder = held(key, lambda: WordEncoder(vocabulary.value, special))
        dtype = "<u4" if end_id >= 1 << 16 else encoder.dtype
        end, ids, null, lengths = np.array([end_id], dtype).tobytes(), [], [], []
        with fs.open_output_stream(f"{path}.bin.{attempt}") as payload:
            for batch, texts in _slices(batches, "text"):
                for packed in encoder.encode(texts.to_pylist()):
                    if dtype != encoder.dtype:
                        packed = np.frombuffer(packed, encoder.dtype).astype(dtype).tobytes()
                    payload.write(packed + end)
                    lengths.append(len(packed) // len(end) + 1)
                keys = batch.column(0)
                null.append(np.asarray(keys.is_null().to_numpy(zero_copy_only=False)))
                ids.append(keys.fill_null(0).to_numpy(zero_copy_only=False))
        lengths = np.array(lengths, np.int64)
        ids = np.concatenate([*ids, np.zeros(0, np.int64)])
        null = np.concatenate([*null, np.zeros(0, bool)]).astype(bool)
        seed = 0
        while len(np.unique(keys := document_keys(ids, null, seed))) < len(ids):
            seed += 1
        index = MinimalPerfectHash.build(keys)
        slots = index.slots(keys)
        by_slot = np.argsort(slots)
        starts = np.cumsum(lengths) - lengths
        parts = {f"level{i:02d}": x for i, x in enumerate(index.levels)}
        for name, arrays in (
            ("idx", parts | {"width": np.array([len(end)]), "seed": np.array([seed]), "fingerprint": (_mix(keys, 5151)[by_slot] & _U64(0xFFFFFFFF)).astype(np.uint32), "offset": starts[by_slot], "length": lengths[by_slot]}),
            ("key", {"doc_id": ids, "null": null}),
        ):
            buffer = io.BytesIO()
            np.savez(buffer, **arrays)
            with fs.open_output_stream(f"{path}.{name}.{attempt}") as f:
                f.write(buffer.getvalue())
            _publish(fs, f"{path}.{name}", attempt)
        _publish(fs, f"{path}.bin", attempt)
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([int(lengths.sum())])], names=["shard", "n_ids"])

    done = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(run, "shard long, n_ids long")
    totals = {r.shard: r.n_ids for r in done.collect()}  # one row per shard
    return [totals.get(i, 0) for i in range(max(totals, default=-1) + 1)]


class Shard:
    """One shard opened for keyed reads."""

    def __init__(self, out_dir: str, shard: int):
        self.fs, root = _store(out_dir)
        self.path = f"{root}/shard-{shard:06d}"
        idx = self._npz("idx")
        self.index = MinimalPerfectHash([idx[k] for k in sorted(idx) if k.startswith("level")])
        self.width = int(idx["width"][0])
        self.dtype = f"<u{self.width}"
        self.seed, self.fingerprint, self.offset, self.length = int(idx["seed"][0]), idx["fingerprint"], idx["offset"], idx["length"]

    def _npz(self, name: str) -> dict[str, np.ndarray]:
        with self.fs.open_input_file(f"{self.path}.{name}") as f, np.load(io.BytesIO(f.read())) as z:
            return {k: z[k] for k in z.files}

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        key = self._npz("key")
        return key["doc_id"], key["null"]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Found, first place in the payload and number of ids of each key, by one hash and one fingerprint."""
        slots = self.index.slots(keys)
        found = slots >= 0
        found[found] = self.fingerprint[slots[found]] == (_mix(keys[found], 5151) & _U64(0xFFFFFFFF)).astype(np.uint32)
        at = np.where(found, slots, 0)
        if not len(self.offset):
            return found, at, at
        return found, self.offset[at], self.length[at]

    def get(self, doc_id: int, nth: int = 0) -> np.ndarray | None:
        """The ids of one document, or None where the shard lacks it."""
        key = _key(np.array([doc_id]), np.array([False]), np.array([nth]), self.seed)
        found, start, length = self.find(key)
        if not found[0]:
            return None
        with self.fs.open_input_file(f"{self.path}.bin") as f:
            return np.frombuffer(f.read_at(int(length[0]) * self.width, int(start[0]) * self.width), self.dtype)


def read_shards(spark: SparkSession, out_dir: str, totals: list[int]) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) of every document, from the files.

    Each document is looked up by its key. ``totals`` are the shards' id counts (8 bytes a shard); a task reads one
    shard and gives its rows in slices.
    """
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not totals:
        return spark.createDataFrame([], schema)
    base = np.concatenate([[0], np.cumsum(totals)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                s = Shard(out_dir, shard)
                ids, null = s.documents()
                found, start, length = s.find(document_keys(ids, null, s.seed))
                if not found.all():
                    raise ValueError(f"shard {shard}: its index lacks some of its documents")
                with s.fs.open_input_file(f"{s.path}.bin") as f:
                    row = 0
                    while row < len(ids):
                        # whole documents of about 4 MB together; offsets ascend with the document order
                        stop = max(row + 1, int(np.searchsorted(start, start[row] + 2_000_000)))
                        first = int(start[row])
                        count = int(start[stop - 1] + length[stop - 1]) - first
                        data = np.frombuffer(f.read_at(count * s.width, first * s.width), s.dtype).astype("<u4").tobytes()
                        cuts = (start[row:stop] - first) * 4
                        packed = [data[a : a + n] for a, n in zip(cuts.tolist(), (length[row:stop] * 4).tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(ids[row:stop], pa.int64(), mask=null[row:stop]),
                                pa.array(start[row:stop] + base[shard]),
                                pa.array(length[row:stop]),
                                pa.array(packed, pa.binary()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )
                        row = stop

    n = len(totals)
    return spark.range(0, n, 1, n).mapInArrow(run, schema)


