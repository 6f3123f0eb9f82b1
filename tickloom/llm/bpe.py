"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

The merges are compiled into a transducer over bytes: its nondeterministic states are (last finished token, place
in the trie of tokens), and a token may follow another exactly if merging the two tokens' bytes gives the two back.
Every prefix of a piece has one such tokenisation, so subset construction with pending output yields a deterministic
machine which emits a token as soon as all live readings agree on it, that is after at most the longest token's
bytes. States and arcs are made when first met and kept, packed, within a bound.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held, small_batches

#: Texts are worked through in stretches of about so many characters, or pieces, so that their words needn't all be in memory at once.
_STRETCH, _STEP = 1_000_000, 200_000
#: A rank above all others.
_NEVER = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain byte-pair merging, lowest rank first and leftmost among equals; the definition for short inputs."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
        if best == _NEVER:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _pack(ids: tuple[int, ...]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Transducer:
    """Encodes one piece in a single left-to-right pass over its bytes.

    A state is kept as its readings (last token + 1, trie node, number of pending tokens, these tokens), packed into
    bytes. Arcs are keyed by 512 * state + byte; an arc's value is 512 * target, plus 256 where the arc emits tokens.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = 300_000):
        self.ranks, self.max_states = ranks, max_states
        self.token = {i: t for t, i in ranks.items()}
        self.packed = {i: _pack((i,)) for i in self.token}
        self.trie: dict[int, int] = {}  # node << 8 | byte to node
        self.ends: list[int] = [-1]
        for t, i in ranks.items():
            node = 0
            for b in t:
                nxt = self.trie.get(node << 8 | b)
                if nxt is None:
                    nxt = self.trie[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = i
        self.inner = bytearray(len(self.ends))
        for key in self.trie:
            self.inner[key >> 8] = 1
        self._spines: dict[int, tuple] = {}
        self._pairs: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[bytes, int] = {}
        self.items: list[bytes] = []
        self.arcs: dict[int, int] = {}
        self.emits: dict[int, bytes] = {}
        self.final: dict[int, bytes] = {}  # of 512 * state: what an end of the piece emits
        self._state([(-1, 0, ())])

    def _state(self, readings: list[tuple[int, int, tuple[int, ...]]]) -> int:
        flat: list[int] = []
        for last, node, pending in readings:
            flat += (last + 1, node, len(pending), *pending)
        key = struct.pack(f"<{len(flat)}I", *flat)
        s = self.states.get(key)
        if s is None:
            s = self.states[key] = len(self.items)
            self.items.append(key)
        return s

    def _readings(self, state: int) -> list[tuple[int, int, tuple[int, ...]]]:
        packed = self.items[state]
        flat = struct.unpack(f"<{len(packed) >> 2}I", packed)
        at, readings = 0, []
        while at < len(flat):
            stop = at + 3 + flat[at + 2]
            readings.append((flat[at] - 1, flat[at + 1], flat[at + 3 : stop]))
            at = stop
        return readings

    def _spine(self, token: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]:
        """The parts that hold the token's first byte, and those that hold its last, in the order merging makes them.

        Each comes with the rank of the merge that ends it. Both are empty for a token that merging its own bytes does not give. Merges happen in rising rank, so a part
        exists from its own rank until the next one's.
        """
        known = self._spines.get(token)
        if known is None:
            ranks, piece = self.ranks, self.token[token]
            parts = [piece[i : i + 1] for i in range(len(piece))]
            first, last = [parts[0]], [parts[-1]]
            while len(parts) > 1:
                best, at = min((ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
                if best == _NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if at == 0:
                    first.append(parts[0])
                if at == len(parts) - 1:
                    last.append(parts[-1])
            if parts != [piece]:
                first = last = []
            known = self._spines[token] = tuple(
                [(part, ranks[after] if after else _NEVER) for part, after in zip(side, [*side[1:], None], strict=False)] for side in (first, last)
            )
        return known

    def follows(self, left: int, right: int) -> bool:
        """May ``right`` come directly after ``left`` in an encoding? -1 stands for the start of a piece.

        It may unless some part at the end of ``left`` and some part at the start of ``right`` that exist at the
        same time merge before either is merged within its own token (on equal rank the leftmost merge wins).
        """
        key = (left + 1) << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= self.max_states:
                self._pairs.clear()
            known = self._pairs[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        first = self._spine(right)[0]
        if left < 0 or not first:
            return bool(first)
        rank, last = self.ranks.get, self._spine(left)[1]
        i = j = 0
        while True:
            part, ends_left = last[i]
            other, ends_right = first[j]
            across = rank(part + other)
            if across is not None and across < ends_left and across <= ends_right:
                return False
            if ends_left == ends_right == _NEVER:
                return True
            if ends_left <= ends_right:
                i += 1
            else:
                j += 1

    def _arc(self, key: int) -> int:
        """Makes the arc for 512 * state + byte."""
        byte, readings, ended = key & 255, [], None
        for last, node, pending in self._readings(key >> 9):
            node = self.trie.get(node << 8 | byte)
            if node is None:
                continue
            if self.inner[node]:
                readings.append((last, node, pending))
            end = self.ends[node]
            if end >= 0 and ended is None and self.follows(last, end):
                ended = (end, 0, (*pending, end))  # the one tokenisation of all bytes so far
        if ended is not None:
            readings.append(ended)
        readings.sort()
        agreed = readings[0][2]  # tokens on which all live readings agree
        for _, _, pending in readings[1:]:
            while pending[: len(agreed)] != agreed:
                agreed = agreed[:-1]
        n = len(agreed)
        if n:
            readings = [(last, node, pending[n:]) for last, node, pending in readings]
            self.emits[key] = self.packed[agreed[0]] if n == 1 else _pack(agreed)
        arc = self.arcs[key] = self._state(readings) << 9 | (256 if n else 0)
        return arc

    def encode(self, piece: bytes) -> bytes:
        """The piece's ids as little-endian unsigned 32-bit integers."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return self.packed[whole]
        if len(self.items) > self.max_states:
            self._reset()
        arc, emits, at, out = self.arcs.get, self.emits, 0, []
        for byte in piece:
            key = at | byte
            at = arc(key)
            if at is None:
                if len(self.items) > 2 * self.max_states:  # within a very long piece: only the present state stays
                    readings = list(self._readings(key >> 9))
                    self._reset()
                    arc, emits = self.arcs.get, self.emits
                    key = self._state(readings) << 9 | byte
                at = self._arc(key)
            if at & 256:
                out.append(emits[key])
                at ^= 256
        end = self.final.get(at)
        if end is None:
            end = self.final[at] = next((_pack(pending) for _, node, pending in self._readings(at >> 9) if node == 0), b"")
        out.append(end)
        return b"".join(out)


class _Memo(dict):
    """Key to ``make(key)``; the younger half of the entries, at about ``budget`` bytes, stays when it is full."""

    def __init__(self, make, budget: int):
        self.make, self.budget, self.used, self.older = make, budget // 2, 0, {}

    def __missing__(self, key: str) -> bytes:
        packed = self.older.get(key)
        if packed is None:
            packed = self.make(key)
        self.used += 200 + 4 * len(key) + len(packed or b"")
        if self.used > self.budget:
            self.older, self.used = dict(self), 0
            self.clear()
        self[key] = packed
        return packed


class Encoder:
    """Whole texts to ids. ``pattern`` splits a text; each match is encoded separately.

    Where every white space stands alone between two other characters, a text falls apart at its spaces and line
    ends without changing any match, so ids are remembered by word; other texts are remembered by match.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, budget: int = 200_000_000):
        import regex

        # Python's \s has four separators more than Unicode's white space.
        space = r"\p{White_Space}"
        pattern = pattern.replace(r"[^\s", rf"[^{space}").replace(r"\s", space).replace(r"\S", r"\P{White_Space}")
        self.pattern = regex.compile(pattern)
        self.runs = re.compile(r"\A\s|\s\s|\s\Z|\A\Z")
        self.machine = Transducer(ranks)
        self.pieces = _Memo(lambda piece: self.machine.encode(piece.encode()), budget // 4)
        self.words = _Memo(self._word, budget)

    def _cut(self, text: str) -> bytes:
        return b"".join([self.machine.encode(piece.encode()) for piece in self.pattern.findall(text)])

    def _word(self, word: str) -> bytes | None:
        """A word after one space, or a word that begins with its line end; None where other white space is at its ends or in a run."""
        line = word[:1] == "\n"
        if self.runs.search(word[line:]) is not None:
            return None
        return self._cut(word if line else " " + word)

    def _by_word(self, text: str) -> bytes | None:
        """The text's ids, or None unless every white space in it stands alone."""
        ends = [i for i in (text.find(" "), text.find("\n"), len(text)) if i >= 0]
        at = min(ends)
        if self.runs.search(text[:at]) is not None:
            return None
        parts = [self._cut(text[:at])]
        while at < len(text):
            stop = text.find(" ", at + _STRETCH)
            stop = stop if stop >= 0 else len(text)
            found = list(map(self.words.__getitem__, text[at:stop].replace("\n", " \n").split(" ")[1:]))
            if None in found:
                return None
            parts += found
            at = stop
        return b"".join(parts)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null is the empty text."""
        if not text:
            return b""
        ids = self._by_word(text)
        if ids is None:
            found, parts = self.pattern.finditer(text), []
            while step := [m[0] for m in itertools.islice(found, _STEP)]:
                parts.append(b"".join(map(self.pieces.__getitem__, step)))
            ids = b"".join(parts)
        return ids


#: Bytes that follow a lead byte, by the lead's top bits; a continuation byte leads nothing.
def _follow(lead: int) -> int:
    return 0 if lead < 0xC2 else 1 if lead < 0xE0 else 2 if lead < 0xF0 else 3 if lead < 0xF5 else 0


class StreamDecoder:
    """Ids to text, piece by piece: holds back an unfinished UTF-8 character until its last byte comes.

    The state is the unfinished character's bytes (three at most). ``feed`` returns the text that is complete so
    far; ``close`` the replacement of what never was completed. Malformed bytes become U+FFFD.
    """

    def __init__(self, table: list[bytes]):
        self.table, self.held = table, b""

    def raw(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def feed(self, ids: Iterable[int]) -> str:
        data = self.held + self.raw(ids)
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:  # the last lead byte
                keep = back if _follow(byte) >= back else 0
                break
        done, self.held = (data[:-keep], data[-keep:]) if keep else (data, b"")
        return done.decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def _slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Runs of rows with about ``limit`` bytes of ``column`` each, so that outputs stay small."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        row = 0
        while row < batch.num_rows:
            end, size = row, 0
            while end < batch.num_rows and (end == row or size < limit):
                v = values[end]
                size += len(v.as_buffer()) if v.is_valid else 0
                end += 1
            yield batch.slice(row, end - row), values.slice(row, end - row)
            row = end


def _text_of(packed: pa.Scalar, table: list[bytes], step: int) -> str:
    import numpy as np

    ids = np.frombuffer(packed.as_buffer(), "<u4") if packed.is_valid else np.zeros(0, "<u4")
    stream = StreamDecoder(table)
    parts = [stream.feed(ids[a : a + step].tolist()) for a in range(0, len(ids), step)]
    return "".join([*parts, stream.close()])


def _table(ranks: dict[bytes, int]) -> list[bytes]:
    """Token bytes by id; no bytes for ids that aren't used."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table


def _run(docs: DataFrame, ranks_path: str, pattern: str, with_text: bool, step: int) -> DataFrame:
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    loaded = load_ranks(ranks_path)
    ranks = sc.broadcast(loaded)
    key = ("bpe", hashlib.sha256(repr((sorted(loaded.items()), pattern)).encode()).hexdigest())
    names = ["doc_id", "n_tokens", "ids"] + ["text"] * with_text

    def run(batches):
        encoder, table = held(key, lambda: (Encoder(ranks.value, pattern), _table(ranks.value)))
        for batch, texts in _slices(batches, "text"):
            ids = pa.array([encoder.encode(t) for t in texts.to_pylist()], pa.binary())
            columns = [batch.column(0), pa.array([len(i.as_buffer()) // 4 for i in ids], pa.int64()), ids]
            if with_text:
                columns.append(pa.array([_text_of(i, table, step) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", text string" * with_text)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit) for every row of ``docs``.

    Null and empty texts have no ids. Repeated rows give repeated rows, an empty table none; columns other than
    doc_id and text are left out, so their names cannot clash. Rows are encoded where they are read: no shuffle.
    The vocabulary (under 1 MB) goes to the executors once; a Python worker keeps its transducer between tasks, within
    the bounds of :class:`Transducer` and :class:`Encoder` (about 300 MB).
    """
    return _run(docs, ranks_path, pattern, False, 65_536)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, step: int = 65_536) -> DataFrame:
    """What :func:`encode` gives, and the text that :func:`decode` makes of it, in one pass over the rows."""
    return _run(docs, ranks_path, pattern, True, step)


def decode(encoded: DataFrame, ranks_path: str, step: int = 65_536) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with the decoded text, fed to a streaming decoder in steps.

    Null ids decode to the empty text; bytes that are no UTF-8 become U+FFFD, which never happens for ids of a text.
    """
    small_batches(encoded.sparkSession)
    sc = encoded.sparkSession.sparkContext
    ranks = sc.broadcast(load_ranks(ranks_path))

    def run(batches):
        table = _table(ranks.value)
        for batch, packed in _slices(batches, "ids"):
            texts = pa.array([_text_of(p, table, step) for p in packed], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")
