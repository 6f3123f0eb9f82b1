"""Encoding and decoding with a merge-type (BPE) sentencepiece model: a score-ordered agenda of adjacent symbol pairs.

A text is its characters as symbols. The agenda holds every adjacent pair whose join is a piece; the pair of the highest
score, the leftmost of equals, is joined first and brings in its new neighbours. Characters that are no piece become
byte pieces. Where no piece has two characters side by side, no join ever crosses them, so a text falls apart there
without changing a result: it is cut into words before runs of spaces, words into parts at such places, and words and parts
are remembered within a budget.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .bpe import _slices
from .common import held, small_batches

#: sentencepiece writes a space as this character.
SPACE = "▁"
#: Fixed values of the model file's format (protocol buffer field numbers and enumerations).
_PIECE, _TRAINER, _NORMALIZER = 1, 2, 3
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_BPE = 2

#: Words and parts up to this many characters are remembered.
_SHORT = 64


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        field, kind = divmod(number(), 8)
        if kind == 0:
            yield field, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield field, data[at : at + size]
            at += size


class Model:
    """Pieces, scores and kinds of a model file's bytes.

    Raises ValueError for a model that this encoder doesn't follow: one that isn't BPE with byte fallback, that rewrites
    texts or drops spaces, adds no space in front, or has unused or user-defined pieces.
    """

    def __init__(self, data: bytes):
        trainer: dict = {}
        normal: dict = {}
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        for field, value in _fields(data):
            if field == _PIECE:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(piece.get(3, _NORMAL))
            elif field == _TRAINER:
                trainer = dict(_fields(value))
            elif field == _NORMALIZER:
                normal = dict(_fields(value))
        sound = trainer.get(3) == _BPE and trainer.get(35) == 1 and not normal.get(2) and normal.get(3, 1) == 1 and normal.get(4, 1) == 0 and normal.get(5, 1) == 1
        if not sound or not set(self.kinds) <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("the model must be BPE with byte fallback, a space in front, texts as they are, and no unused or user-defined pieces")
        normal_ids = [i for i, k in enumerate(self.kinds) if k == _NORMAL]
        self.id = {self.pieces[i]: i for i in normal_ids}
        #: A piece's place among the distinct scores, the highest first: pieces of equal score share it.
        place = {s: n for n, s in enumerate(sorted({scores[i] for i in normal_ids}, reverse=True))}
        self.rank = {self.pieces[i]: place[scores[i]] for i in normal_ids if len(self.pieces[i]) > 1}
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self._index()
        self.joints = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        self.byte = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == _BYTE}
        if len(self.byte) != 256:
            raise ValueError("the model must have 256 byte pieces")
        self.words_apart = all(SPACE not in p.lstrip(SPACE) for p in self.rank) and not any("\n" in j for j in self.joints)

    def _index(self) -> None:
        """Sorted arrays: characters that are pieces, and pairs of pieces whose join is a piece."""
        single = sorted((ord(p), i) for p, i in self.id.items() if len(p) == 1)
        self._points, self._single = (np.array(x, np.int64) for x in zip(*single, strict=True))
        pairs = sorted(
            (self.id[p[:k]] << 32 | self.id[p[k:]], r, self.id[p]) for p, r in self.rank.items() for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id
        )
        self._pair, self._pair_rank, self._pair_id = (np.array(x, np.int64) for x in zip(*pairs, strict=True))

    def of_character(self, points: np.ndarray) -> np.ndarray:
        """The piece of each character; -1 for those that are none."""
        at = np.minimum(np.searchsorted(self._points, points), len(self._points) - 1)
        return np.where(self._points[at] == points, self._single[at], -1)

    def joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair's join; rank -1 where it is no piece."""
        pair = np.where((left >= 0) & (right >= 0), left << np.int64(32) | right, -1)
        at = np.minimum(np.searchsorted(self._pair, pair), len(self._pair) - 1)
        return np.where(self._pair[at] == pair, self._pair_rank[at], -1), self._pair_id[at]

    def table(self) -> dict[str, bytes]:
        """The bytes that each id, written in decimal, stands for: none for control pieces, U+2047 between spaces for the unknown."""
        out = {}
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            text = bytes([int(p[3:5], 16)]) if k == _BYTE else b"" if k == _CONTROL else " ⁇ ".encode() if k == _UNKNOWN else p.replace(SPACE, " ").encode()
            out[str(i)] = text
        return out


def _pairs(text: str, rank: dict[str, int]) -> Iterator[int]:
    """rank << 32 | place of all adjacent pairs that can be joined, in rising order; eight bytes each for long texts."""
    found = ((r << 32) | i for i in range(len(text) - 1) if (r := rank.get(text[i : i + 2])) is not None)
    if len(text) <= 1_000:
        yield from sorted(found)
        return
    packed = np.fromiter(found, np.int64)
    packed.sort()
    for a in range(0, len(packed), 65_536):
        yield from packed[a : a + 65_536].tolist()


def merge(text: str, rank: dict[str, int]) -> list[str]:
    """The symbols that ``text``'s characters are joined to.

    The agenda is the sorted run of the first pairs and a heap of those that joins bring in. A pair is out of date when
    either symbol has changed, which its length shows.
    """
    n = len(text)
    kind = list if n <= 1_000 else (lambda x: array("i", x))
    size, after, before = kind([1]) * n, kind(range(1, n + 1)), kind(range(-1, n - 1))
    run, heap = _pairs(text, rank), []
    head = next(run, None)
    while head is not None or heap:
        if heap and (head is None or heap[0][0] <= head):
            at, length = heapq.heappop(heap)
        else:
            at, length = head, 2
            head = next(run, None)
        left = at & 0xFFFFFFFF
        right = after[left]
        if right >= n or not size[left] or size[left] + size[right] != length:
            continue
        size[left], size[right] = length, 0
        after[left] = end = after[right]
        if end < n:
            before[end] = left
            total = length + size[end]
            if (r := rank.get(text[left : left + total])) is not None:
                heapq.heappush(heap, (r << 32 | left, total))
        if (start := before[left]) >= 0:
            total = length + size[start]
            if (r := rank.get(text[start : start + total])) is not None:
                heapq.heappush(heap, (r << 32 | start, total))
    out, at = [], 0
    while at < n:
        out.append(text[at : at + size[at]])
        at = after[at]
    return out


def _agendas(words: list[str], model: Model) -> list[str]:
    """Ids in decimal of many short words at once: each word has its own agenda, and all words take their best pair together.

    A pair's key is its rank and then its place, so the smallest key of a word is the top of its agenda; a join makes new
    keys for two neighbours. Words whose agenda is empty are done and drop out.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    n, start = len(points), np.cumsum(lengths) - lengths
    symbol = model.of_character(points)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[start + lengths - 1] = -1
    before[start] = -1
    live = np.ones(n, bool)
    never = np.int64(1) << 62

    def keys(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key and joined symbol of the pairs that begin at ``left``."""
        right = after[left]
        rank, joined = model.joined(symbol[left], np.where(right >= 0, symbol[np.maximum(right, 0)], -1))
        return np.where(rank >= 0, (rank << np.int64(32)) | left, never), joined

    key, joined = keys(np.arange(n))
    at, spans = start, lengths
    index = np.arange(n)
    while len(at):
        top = np.minimum.reduceat(key[index], np.cumsum(spans) - spans)
        more = top < never
        if not more.all():
            index = index[np.repeat(more, spans)]
            top, at, spans = top[more], at[more], spans[more]
            if not len(at):
                break
        left = top & np.int64(0xFFFFFFFF)
        right = after[left]
        symbol[left] = joined[left]
        live[right], key[right] = False, never
        end = after[right]
        after[left] = end
        inner = end >= 0
        before[end[inner]] = left[inner]
        key[left], joined[left] = keys(left)
        back = before[left]
        back = back[back >= 0]
        key[back], joined[back] = keys(back)
    ids, owner = symbol[live], np.repeat(np.arange(len(words)), lengths)[live]
    bounds = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
    text = list(map(model.decimal.__getitem__, ids.tolist()))
    unknown = np.flatnonzero(ids < 0)
    spelled = {c: " ".join(str(model.byte[b]) for b in chr(c).encode()) for c in np.unique(points[live][unknown]).tolist()}
    for k, c in zip(unknown.tolist(), points[live][unknown].tolist(), strict=True):
        text[k] = spelled[c]
    return [" ".join(text[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


class PieceEncoder:
    """Texts to ids, written in decimal and joined by one space; up to twice ``most`` words of 64 characters at most are remembered.

    ``check``: a function that gives the library's ids of a list of texts; every word that is new is held against it, and a
    difference raises RuntimeError.
    """

    def __init__(self, model: Model, most: int = 300_000, check=None):
        self.model, self.most, self.check = model, most, check
        self.words: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.word = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")

    def _split(self, text: str) -> list[str]:
        """The words of a text, without the one space that stands before each; before those that begin with a line's end stands none."""
        if not self.model.words_apart:
            return [text.replace(" ", SPACE)]
        plain = "  " not in text and " \n" not in text and SPACE not in text and text[-1] != " " and text[0] not in " \n"
        if plain:
            return text.replace("\n", " \n").split(" ")
        return [w[1:] if w[0] == SPACE else w for w in self.word.findall(SPACE + text.replace(" ", SPACE))]

    def _whole(self, word: str) -> str:
        return word if word[:1] == "\n" and self.model.words_apart else SPACE + word

    def _long(self, word: str) -> str:
        """The ids of a long word: its parts, cut where no piece can reach across, each by an agenda of its own."""
        joints, known, out, a = self.model.joints, self.model.id, [], 0
        word = self._whole(word)
        for b in range(1, len(word) + 1):
            if b == len(word) or word[b - 1 : b + 1] not in joints:
                for symbol in merge(word[a:b], self.model.rank) if b - a > 1 else [word[a]]:
                    i = known.get(symbol)
                    out += [self.model.decimal[i]] if i is not None else [str(self.model.byte[x]) for x in symbol.encode()]
                a = b
        return " ".join(out)

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text; an empty text has none."""
        if len(self.words) > self.most:
            self.words, self.older = {}, self.words
        split = [self._split(t) if t else [] for t in texts]
        new = set().union(*split).difference(self.words)
        if self.older:
            again = new.intersection(self.older)
            self.words.update((w, self.older[w]) for w in again)
            new -= again
        short, long = [w for w in new if len(w) < _SHORT], [w for w in new if len(w) >= _SHORT]
        found = dict(zip(short, _agendas(list(map(self._whole, short)), self.model), strict=True)) if short else {}
        found |= {w: self._long(w) for w in long}
        if self.check is not None:
            words, front = [w for w in new if w], f"{self.model.id[SPACE]} "
            for w, ids in zip(words, self.check(words), strict=True):
                if (found[w] if self._whole(w) is not w else front + found[w]) != " ".join(map(str, ids)):
                    raise RuntimeError(f"ids of a word of {len(w)} characters differ from the library's")
        self.words.update(found)
        out = [" ".join(map(self.words.__getitem__, s)) for s in split]
        for w in long:
            del self.words[w]
        return out


def _one_byte(e: UnicodeError):
    return "�", e.start + 1


codecs.register_error("tickloom-one-byte", _one_byte)


def decode_ids(ids: Iterable[str], table: dict[str, bytes]) -> str:
    """The text of ids written in decimal: spaces back, the one in front dropped, each byte that is no UTF-8 as U+FFFD."""
    raw = b"".join(map(table.__getitem__, ids))
    return raw.removeprefix(b" ").decode("utf-8", "tickloom-one-byte")


def _library(data: bytes):
    """The library's ids of a list of texts."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=data)
    return lambda texts: processor.encode(texts, num_threads=1) if texts else []


def round_trip(docs: DataFrame, model_path: str, end: bool = True, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by one space) and text (what the ids decode to) of every row of ``docs``.

    ``end`` appends the model's end id; ``check`` holds each Arrow batch's new words against the sentencepiece library.
    Null and empty texts have the end id alone and decode to the empty text. Repeated rows give repeated rows, an empty
    table none; columns other than doc_id and text are left out, so their names can't clash. Rows are encoded where they
    are read: no shuffle. The model's bytes (under 1 MB) go to the executors; a worker keeps its words between
    tasks within a budget. A text without a space is one word, whatever its length: it takes about 60 bytes a character.
    """
    small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        data = f.read()
    model = Model(data)
    if end and "</s>" not in model.pieces:
        raise ValueError("the model has no end piece")
    last = str(model.pieces.index("</s>")) if end else ""
    key = ("piece", hashlib.sha256(data).hexdigest(), check)
    sent = docs.sparkSession.sparkContext.broadcast(data)

    def make():
        own = Model(sent.value)
        return PieceEncoder(own, check=_library(sent.value) if check else None), own.table()

    def run(batches):
        encoder, table = held(key, make)
        for batch, texts in _slices(batches, "text", 2_000_000):
            ids = encoder.encode([t or "" for t in texts.to_pylist()])
            ids = [f"{i} {last}" if i and last else i or last for i in ids]
            counts = pa.array([i.count(" ") + 1 if i else 0 for i in ids], pa.int64())
            decoded = pa.array([decode_ids(i.split(" "), table) if i else "" for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(ids, pa.string()), decoded], names=["doc_id", "n_tokens", "ids", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids string, text string")


def as_array(ids: Column | str) -> Column:
    """Ids in decimal as an array of ints; none for the empty string."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.when(c == "", F.array().cast("array<int>")).otherwise(F.split(c, " ").cast("array<int>"))
