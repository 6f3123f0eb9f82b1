"""Counts of symbol sequences, their classes, and folds over days.

A distribution has rows (keys, length, seq, cnt, total, prob); a class distribution (keys, length, seq, class_counts,
class_probs, total) with classes in the order 0, +1, -1. Only sequences that occur are ever counted; zero rows are added
on request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.series import Order
from .bars import BARS

CLASSES = (0, 1, -1)


def _grams(df: DataFrame, symbol: str, longest: int, order: Order, extra: dict[str, Column] | None = None) -> DataFrame:
    """keys, length, seq and place of each sequence's last row."""
    if longest < 1:
        raise ValueError("the longest length must be 1 or more")
    back = [F.lag(symbol, k).over(order.rows()) for k in range(longest)]
    place = F.row_number().over(order.rows())
    df = df.select(*order.keys, place.alias("place"), *(b.cast("int").alias(f"_b{k}") for k, b in enumerate(back)), *(c.alias(n) for n, c in (extra or {}).items()))
    grams = F.array(
        *(
            F.when(F.col("place") >= n, F.struct(F.lit(n).alias("length"), F.array(*(F.col(f"_b{k}") for k in reversed(range(n)))).alias("seq")))
            for n in range(1, longest + 1)
        )
    )
    df = df.withColumn("_g", F.explode(grams)).where("_g is not null")
    return df.select(*order.keys, "place", F.col("_g.length").alias("length"), F.col("_g.seq").alias("seq"), *(extra or {}))


def counts(df: DataFrame, symbol: str, longest: int = 6, order: Order = BARS) -> DataFrame:
    """How often each sequence of up to ``longest`` symbols occurs in each series, with its share of its length's.

    ``first`` is where it first ends, for first-seen order.
    """
    keys = list(order.keys)
    out = _grams(df, symbol, longest, order).groupBy(*keys, "length", "seq").agg(F.count("*").alias("cnt"), F.min("place").alias("first"))
    return with_shares(out, keys)


def with_shares(df: DataFrame, keys: list[str]) -> DataFrame:
    total = F.sum("cnt").over(Window.partitionBy(*keys, "length"))
    return df.withColumn("total", total).withColumn("prob", F.coalesce(F.try_divide(F.col("cnt"), F.col("total")), F.lit(0.0)))


def ordered(df: DataFrame, how: str = "lexicographic") -> DataFrame:
    by = {"lexicographic": ["seq"], "count": [F.col("cnt").desc(), "seq"], "first_seen": ["first"]}
    if how not in by:
        raise ValueError(f"order must be one of {sorted(by)}")
    return df.orderBy("length", *by[how])


def sampled(df: DataFrame, share: float, keys: list[str], after_length: int = 2, seed: int = 0) -> DataFrame:
    """Of sequences longer than ``after_length`` a uniform sample without replacement, one at least of each length."""
    if not 0 < share <= 1:
        raise ValueError("the share must be above 0 and at most 1")
    w = Window.partitionBy(*keys, "length")
    df = df.withColumn("_nth", F.row_number().over(w.orderBy(F.xxhash64("seq", F.lit(seed)), "seq"))).withColumn("_m", F.count("*").over(w))
    kept = (F.col("length") <= after_length) | (F.col("_nth") <= F.greatest(F.lit(1.0), F.rint(F.col("_m") * share)))
    return df.where(kept).drop("_nth", "_m")


def _all_sequences(symbols: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """All sequences over each series' own symbols: |alphabet| ** length rows, so for small alphabets."""
    alphabet = symbols.groupBy(*keys).agg(F.sort_array(F.collect_set("_s")).alias("_a"))
    level = alphabet.select(*keys, "_a", F.array().cast("array<int>").alias("seq"))
    out = None
    for n in range(1, longest + 1):
        level = level.select(*keys, "_a", F.explode(F.transform("_a", lambda s: F.concat("seq", F.array(s)))).alias("seq"))
        rows = level.select(*keys, F.lit(n).alias("length"), "seq")
        out = rows if out is None else out.unionByName(rows)
    return out


def zero_filled(df: DataFrame, symbol: str, longest: int, order: Order = BARS) -> DataFrame:
    """:func:`counts` with a row of 0 for every sequence of a series' symbols that never occurs."""
    keys = list(order.keys)
    found = _grams(df, symbol, longest, order).groupBy(*keys, "length", "seq").agg(F.count("*").alias("cnt"))
    every = _all_sequences(df.select(*keys, F.col(symbol).cast("int").alias("_s")).distinct(), keys, longest)
    return with_shares(every.join(found, [*keys, "length", "seq"], "left").fillna(0, subset=["cnt"]), keys)


def class_counts(df: DataFrame, symbol: str, label: str, longest: int = 6, order: Order = BARS, non_zero_only: bool = True) -> DataFrame:
    """For each sequence how often its last row has each class, and these shares."""
    keys = list(order.keys)
    out = _grams(df, symbol, longest, order, {"_class": F.col(label)}).groupBy(*keys, "length", "seq").agg(
        *(F.count_if(F.col("_class") == c).alias(f"_n{i}") for i, c in enumerate(CLASSES))
    )
    if not non_zero_only:
        every = _all_sequences(df.select(*keys, F.col(symbol).cast("int").alias("_s")).distinct(), keys, longest)
        out = every.join(out, [*keys, "length", "seq"], "left").fillna(0)
    return _class_rows(out, [*keys, "length", "seq"])


def _class_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    n = [F.col(f"_n{i}") for i in range(len(CLASSES))]
    total = sum(n[1:], n[0])
    probs = F.array(*(F.coalesce(F.try_divide(x, total), F.lit(0.0)) for x in n))
    return df.select(*keys, F.array(*n).alias("class_counts"), probs.alias("class_probs"), total.alias("total"))


def fold(df: DataFrame, keys: list[str] | tuple[str, ...] = (), longest: int | None = None) -> DataFrame:
    """Distributions of several days summed; associative, so folded parts can be folded again."""
    df = df.where(F.col("length") <= longest) if longest else df
    return with_shares(df.groupBy(*keys, "length", "seq").agg(F.sum("cnt").alias("cnt")), list(keys))


def fold_classes(df: DataFrame, keys: list[str] | tuple[str, ...] = (), longest: int | None = None) -> DataFrame:
    """Class distributions of several days summed. A vector of another length raises an error."""
    df = df.where(F.col("length") <= longest) if longest else df
    n = len(CLASSES)
    vector = F.when(F.size("class_counts") == n, F.col("class_counts")).otherwise(F.raise_error(F.lit(f"class counts must have {n} entries")).cast("array<bigint>"))
    sums = [F.sum(F.get(vector, F.lit(i))).alias(f"_n{i}") for i in range(n)]
    return _class_rows(df.groupBy(*keys, "length", "seq").agg(*sums), [*keys, "length", "seq"])


def filtered(df: DataFrame, lengths: list[int], least: float) -> DataFrame:
    """Rows of these lengths with a share above ``least``."""
    return df.where(F.col("length").isin(*lengths) & (F.col("prob") > least))


def training_rows(df: DataFrame, longest: int, least: float) -> DataFrame:
    return df.where((F.col("length") <= longest) & (F.col("prob") > least)).select("seq", F.col("prob").alias("emp_prob"))


def aligned(reference: DataFrame, others: dict[str, DataFrame], top: int | None = None) -> DataFrame:
    """The reference's sequences (length, seq, prob, pos) with each other's share, 0 where it lacks one, and a label."""
    out = reference.where(F.col("pos") < top) if top is not None else reference
    for name, df in others.items():
        out = out.join(df.select("length", "seq", F.col("prob").alias(name)), ["length", "seq"], "left").fillna(0.0, subset=[name])
    return out.withColumn("label", F.concat(F.lit("("), F.array_join(F.col("seq").cast("array<string>"), ","), F.lit(")")))


def value_shares(df: DataFrame, c: str, keys: list[str]) -> DataFrame:
    out = df.groupBy(*keys, F.col(c).alias("value")).agg(F.count("*").alias("cnt"))
    return out.withColumn("prob", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(*keys)))
