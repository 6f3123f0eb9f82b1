"""Conversations made well formed by the cheapest edits: a shortest path whose scalar weights decide ties as well.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``. Four states follow what has been kept so
far: nothing, the system turn, a user turn, an assistant turn. Each row may be kept, given another role or deleted, and a turn
with an empty text may be inserted before it or at the end. An edit's weight is one integer: its cost in the high digits
and its letter in the top one of fixed-width low digits; taking an edit before others moves theirs one digit down, where
zeros stand for the end. So the smaller integer is the lower cost and, of equals, the audit that is least in ASCII.

Long conversations are worked out in blocks of rows: a block gives the least weight from each state to each other, and the
blocks' weights are put together in order. Of two ways through a block with the same cost and ends neither's letters are
the beginning of the other's (only inserts, which cost, could follow), so what is least in a block is least in the whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import hot_joined, small_batches, written

#: Rows of a conversation that are worked out together, a power of two.
BLOCK = 512
START, SYSTEM, USER, ASSISTANT = range(4)
#: Letters by their order in ASCII; 0 is the end.
_LETTERS = "\0DIKR"
_BITS = 3
_DIGIT = {c: i for i, c in enumerate(_LETTERS)}
_WORDS = {USER: "user", ASSISTANT: "assistant"}
#: The states after which a user or an assistant turn may come.
_BEFORE = {USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
_STATE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (how often): ``rows`` with the faults that crc32(``conv_id:turn``) modulo 20 says.

    0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes its role ``user``. Null roles and texts,
    and nulls in ``conv_id:turn``, are one space; conv_id and turn themselves stay null.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.where(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _faults(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, n, initial, blank, repeated, cut; equal rows of a turn are one row with their number.

    ``repeated``: an earlier turn has the same role and text. The earliest turn of each role and text comes from a
    pre-aggregated join, hot ones apart, and no window, so no task gathers a conversation.
    """
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("-")).alias("conv")
    rows = rows.select(conv, F.col("turn").cast("long").alias("turn"), "role", "text", "n")
    rows = rows.withColumn("what", F.unhex(F.sha2(F.concat_ws("\0", "conv", F.length("role").cast("string"), "role", "text"), 256)))
    rows = written(rows.groupBy("conv", "turn", "role", "text", "what").agg(F.sum("n").alias("n")), "conversation-rows")
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = rows.groupBy("what").agg(F.min(place).alias("first"), F.count("*").alias("turns"))
    joined = hot_joined(rows, first.where("turns > 1"), "what", "turns", "left")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return joined.select(
        "conv", "turn", "role", "text", "n",
        F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        F.coalesce(F.col("first") < place, F.lit(False)).alias("repeated"),
        (~last.isin(".", "!", "?")).alias("cut"),
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rid``, rising along each conversation, and ``block``: a range sort numbers rows, so long conversations span tasks."""
    by = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role")]
    spread = rows.repartitionByRange(*by, F.substring("text", 1, 32))  # the sample of keys, which the driver sees, stays small
    rows = spread.sortWithinPartitions(*by, "text").withColumn("rid", F.monotonically_increasing_id())
    return written(rows.withColumn("block", F.shiftright("rid", BLOCK.bit_length() - 1)), "conversation-order")


# --- the shortest path ----------------------------------------------------------------------------------------------

class Path:
    """Least weights over one run of rows, worked out from its end.

    ``rows``: (initial, must go, truncated, number of equal rows). All weights have the same ``width`` of letters: every row's
    own and an insert before each and at the end.
    """

    def __init__(self, rows: list[tuple[str, bool, bool, int]], costs: Costs, last: bool):
        self.rows, self.costs, self.last = rows, costs, last
        self.width = sum(r[3] for r in rows) + len(rows) + 1
        self.shift = _BITS * self.width

    def edit(self, cost: int, letter: str, rest: int, times: int = 1) -> int:
        """The weight of an edit, taken ``times`` over, and then ``rest``."""
        high, low = rest >> self.shift, rest & ((1 << self.shift) - 1)
        run = int(oct(_DIGIT[letter])[2:] * times, 8) << (self.shift - _BITS * times)
        return ((high + cost * times) << self.shift) | run | (low >> (_BITS * times))

    def _inserted(self, value: list[int | None]) -> list[int | None]:
        """The least weight at each state when one turn may be inserted first."""
        out = list(value)
        for to, froms in _BEFORE.items():
            if value[to] is not None:
                w = self.edit(self.costs.insert, "I", value[to])
                for s in froms:
                    if out[s] is None or w < out[s]:
                        out[s] = w
        return out

    def weights(self, end: int) -> list[int | None]:
        """The least weight from each state at the beginning to ``end``; None where there is no way."""
        value: list[int | None] = [None] * 4
        value[end] = 0
        if self.last:
            value = self._inserted(value)
        c = self.costs
        for initial, gone, cut, n in reversed(self.rows):
            if n > 1:  # of equal rows those after the first repeat it
                value = [v if v is None else self.edit(c.delete, "D", v, n if gone else n - 1) for v in value]
                if gone:
                    value = self._inserted(value)
                    continue
            new: list[int | None] = [None if v is None else self.edit(c.delete, "D", v) for v in value]

            def offer(s, to, cost, letter, new=new, value=value):
                if value[to] is not None:
                    w = self.edit(cost, letter, value[to])
                    if new[s] is None or w < new[s]:
                        new[s] = w

            if not gone:
                extra = c.truncated * cut
                for to, froms in _BEFORE.items():
                    for s in froms:
                        offer(s, to, c.rerole + extra, "R")
                        if _STATE_OF.get(initial) == to:
                            offer(s, to, extra, "K")
                if initial == "s":
                    offer(START, SYSTEM, extra, "K")
            value = self._inserted(new)
        return value

    def told(self, w: int) -> tuple[int, str]:
        """Cost and letters of a weight."""
        digits = f"{w & ((1 << self.shift) - 1):0{self.width}o}".rstrip("0")
        return w >> self.shift, digits.translate({ord(str(i)): c for i, c in enumerate(_LETTERS) if i})


def block_ways(rows: list[tuple[str, bool, bool, int]], costs: Costs, last: bool) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, letters) of the cheapest way between any two states; ``last``: turns may be inserted at the end too."""
    path, out = Path(rows, costs, last), []
    for to in range(4):
        out += [(s, to, *path.told(w)) for s, w in enumerate(path.weights(to)) if w is not None]
    return out


def joined_ways(blocks: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[tuple[int, str]]]:
    """The least cost of a well-formed whole, and each block's state at its beginning and letters."""
    width = max((sum(max(len(w[3]) for w in b) for b in blocks), 1))
    shift = _BITS * width
    mask, number = (1 << shift) - 1, str.maketrans({c: str(i) for i, c in enumerate(_LETTERS)})
    value: list[int | None] = [0, None, None, 0]  # well formed at the end: nothing, or after an assistant turn
    chosen = []
    for ways in reversed(blocks):
        new: list[int | None] = [None] * 4
        via: list = [None] * 4
        for s, to, cost, letters in ways:
            if value[to] is None:
                continue
            own = int(letters.translate(number) or "0", 8) << (shift - _BITS * len(letters))
            w = ((value[to] >> shift) + cost) << shift | own | (value[to] & mask) >> (_BITS * len(letters))
            if new[s] is None or w < new[s]:
                new[s], via[s] = w, (to, letters)
        value = new
        chosen.append(via)
    state, out = START, []
    for via in reversed(chosen):
        to, letters = via[state]
        out.append((state, letters))
        state = to
    return value[START] >> shift, out


def outcomes(rows: list[tuple[str, bool, bool, int]], letters: str, state: int) -> tuple[list[tuple[str | None, str]], str]:
    """For each row its role's change (None: gone, "": as it was, else the new role) and the roles inserted before it, one letter
    each; and the roles inserted at the end. The letters and the state before them say it all."""
    at, out = 0, []

    def inserts() -> str:
        nonlocal at, state
        got = ""
        while at < len(letters) and letters[at] == "I":
            state = ASSISTANT if state == USER else USER
            got, at = got + "ua"[state == ASSISTANT], at + 1
        return got

    for initial, _, _, n in rows:
        before, letter = inserts(), letters[at]
        at += n
        if letter == "D":
            out.append((None, before))
            continue
        state = SYSTEM if state == START and letter == "K" and initial == "s" else ASSISTANT if state == USER else USER
        out.append(("" if letter == "K" else _WORDS[state], before))
    return out, inserts()


# --- the tables -----------------------------------------------------------------------------------------------------

_ROWS = "array<struct<rid:bigint,initial:string,gone:boolean,cut:boolean,n:bigint>>"


def _plain(values: list[dict]) -> list[tuple[str, bool, bool, int]]:
    return [(v["initial"], v["gone"], v["cut"], v["n"]) for v in values]


def _plan(rows: DataFrame, costs: Costs) -> tuple[DataFrame, DataFrame]:
    """(conv, cost, audit, illegal), and for each row (rid, role, before, after): its role's change and what is inserted around it."""
    gone = (F.col("blank") | F.col("repeated")).alias("gone")
    light = rows.select("conv", "block", F.struct("rid", "initial", gone, "cut", "n").alias("row"))
    blocks = light.groupBy("conv", "block").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    size = rows.groupBy("conv").agg(F.max("block").alias("last"))
    blocks = blocks.join(size.hint("merge"), "conv")

    def ways(batches):
        for b in batches:
            out = []
            for values, block, last in zip(b.column("rows").to_pylist(), b.column("block").to_pylist(), b.column("last").to_pylist(), strict=True):
                plain, illegal, before = _plain(values), 0, None
                for initial, _, _, n in plain:
                    illegal += (n - 1) + (before is not None and before + initial not in ("su", "ua", "au"))
                    before = initial
                found = [{"s": s, "e": e, "cost": c, "letters": w} for s, e, c, w in block_ways(plain, costs, block == last)]
                out.append({"ways": found, "illegal": illegal, "head": plain[0][0], "tail": plain[-1][0]})
            yield pa.RecordBatch.from_arrays(
                [b.column("conv"), b.column("block"), b.column("rows"), pa.array(out, _WAYS)], names=["conv", "block", "rows", "found"]
            )

    shape = f"conv string, block long, rows {_ROWS}, found struct<ways:array<struct<s:int,e:int,cost:bigint,letters:string>>,illegal:bigint,head:string,tail:string>"
    found = written(blocks.select("conv", "block", "rows", "last").mapInArrow(ways, shape), "conversation-blocks")

    whole = found.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "found"))).alias("blocks"))

    def choose(batches):
        for b in batches:
            out = []
            for blocks in b.column("blocks").to_pylist():
                found = [x["found"] for x in blocks]
                cost, chosen = joined_ways([[(w["s"], w["e"], w["cost"], w["letters"]) for w in f["ways"]] for f in found])
                illegal = sum(f["illegal"] for f in found)
                illegal += sum(f["tail"] + g["head"] not in ("su", "ua", "au") for f, g in zip(found, found[1:], strict=False))
                parts = [{"block": x["block"], "state": s, "letters": w} for x, (s, w) in zip(blocks, chosen, strict=True)]
                out.append({"cost": cost, "audit": "".join(w for _, w in chosen), "illegal": illegal, "parts": parts})
            yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(out, _CHOSEN)], names=["conv", "chosen"])

    shape = "conv string, chosen struct<cost:bigint,audit:string,illegal:bigint,parts:array<struct<block:bigint,state:int,letters:string>>>"
    chosen = written(whole.mapInArrow(choose, shape), "conversation-audits")

    parts = chosen.select("conv", F.explode("chosen.parts").alias("p")).select("conv", "p.block", "p.state", "p.letters")
    told = found.select("conv", "block", "rows").join(parts.hint("merge"), ["conv", "block"])

    def edit(batches):
        for b in batches:
            out = []
            for values, state, letters in zip(b.column("rows").to_pylist(), b.column("state").to_pylist(), b.column("letters").to_pylist(), strict=True):
                each, end = outcomes(_plain(values), letters, state)
                out.append([{"rid": v["rid"], "role": r, "before": x, "after": ""} for v, (r, x) in zip(values, each, strict=True)])
                out[-1][-1]["after"] = end
            yield pa.RecordBatch.from_arrays([pa.array(out, _EDITS)], names=["edits"])

    shape = "edits array<struct<rid:bigint,role:string,before:string,after:string>>"
    edits = told.select("rows", "state", "letters").mapInArrow(edit, shape).select(F.explode("edits").alias("e")).select("e.*")
    return chosen.select("conv", "chosen.cost", "chosen.audit", "chosen.illegal"), edits


_WAYS = pa.struct(
    [
        ("ways", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())]))),
        ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string()),
    ]
)
_CHOSEN = pa.struct(
    [
        ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()),
        ("parts", pa.list_(pa.struct([("block", pa.int64()), ("state", pa.int32()), ("letters", pa.string())]))),
    ]
)
_EDITS = pa.list_(pa.struct([("rid", pa.int64()), ("role", pa.string()), ("before", pa.string()), ("after", pa.string())]))


def _lines(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv, rid, lines: what each row leaves in the repaired conversation, inserted turns included; rows that leave nothing go."""
    named = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.when(x == "u", F.lit("user:")).otherwise(F.lit("assistant:")))
    own = F.when(F.col("edit.role").isNotNull(), F.array(F.concat(F.when(F.col("edit.role") == "", F.col("role")).otherwise(F.col("edit.role")), F.lit(":"), "text"))).otherwise(F.array())
    joined = rows.select("conv", "rid", "role", "text").join(edits.select("rid", F.struct("role", "before", "after").alias("edit")).hint("merge"), "rid")
    lines = joined.select("conv", "rid", F.concat(named(F.col("edit.before")), own, named(F.col("edit.after"))).alias("lines"))
    return lines.where(F.size("lines") > 0)


def _digests(lines: DataFrame) -> DataFrame:
    """conv, repaired_sha256: lines stream through one running digest for each conversation, never gathered."""
    lines = lines.select("conv", "rid", F.array_join("lines", "\n").alias("line")).repartition("conv").sortWithinPartitions("conv", "rid")

    def run(batches):
        now, digest = None, None
        for b in batches:
            done: list[tuple[str, str]] = []
            for conv, line in zip(b.column("conv").to_pylist(), b.column("line").to_pylist(), strict=True):
                if conv != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = conv, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names=["conv", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["conv", "repaired_sha256"])

    return lines.mapInArrow(run, "conv string, repaired_sha256 string")


def repaired(rows: DataFrame, costs: Costs = Costs()) -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation and its cheapest repair; and the repaired turns.

    ``rows``: conv_id, turn, role, text and ``n``, how often the row stands there (1 if there is no such column). A conversation's
    rows are taken by turn (nulls first), role and text. Gives (conv, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256) and (conv, rid, lines); ``conv`` is conv_id as text, "-" for null. A row's first fault counts. An empty role
    has no initial, so it can't be kept as it is. Equal rows travel as one with their number, conversations in blocks of
    512 rows; only a conversation's audit, one cell of the result, is put together in one task.
    """
    small_batches(rows.sparkSession)
    if "n" not in rows.columns:
        rows = rows.withColumn("n", F.lit(1).cast("long"))
    rows = _ordered(_faults(rows))
    plan, edits = _plan(rows, costs)
    sound = ~F.col("blank") & ~F.col("repeated")
    more = F.when(F.col("blank"), 0).otherwise(F.when(F.col("repeated"), F.col("n")).otherwise(F.col("n") - 1))
    span = F.max("turn").cast("decimal(20,0)") - F.min("turn") + 1 - F.count_distinct("turn")
    facts = rows.groupBy("conv").agg(
        F.coalesce(span.try_cast("bigint"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(more).cast("long").alias("duplicate"),
        F.count_if(sound & F.col("cut")).alias("truncated"),
    )
    lines = _lines(rows, edits)
    out = facts.join(plan.hint("merge"), "conv").join(_digests(lines).hint("merge"), "conv", "left")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))), lines


def repair(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): :func:`damaged` and then :func:`repaired`.

    A conversation without rows after damage has zeros, an empty audit and the digest of an empty string. Null conv_ids are
    one conversation. Other columns are left out; an empty table gives none.
    """
    out, _ = repaired(damaged(rows), costs)
    every = rows.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")).alias("conv")).distinct()
    out = every.join(out.hint("merge"), "conv", "left").drop("conv")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
