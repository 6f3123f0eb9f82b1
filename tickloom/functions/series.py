"""Ordered-series building blocks: everything here is a column or window expression.

A series lives in a partition (``Order.keys``) and is ordered by ``Order.by``. All windows of one :class:`Order` share
one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal, localcontext

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


@dataclass(frozen=True)
class Order:
    """Which rows form a series, and in which order."""

    keys: tuple[str, ...] = ("instrument_id", "trade_date")
    by: tuple[str, ...] = ("ts_event", "sequence")

    def rows(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.by)

    def past(self) -> WindowSpec:
        """The present row and all before it."""
        return self.rows().rowsBetween(Window.unboundedPreceding, 0)

    def future(self) -> WindowSpec:
        """The present row and all after it, from the series' end on: a frame that grows as rows pass, so its cost is that of one more
        sort and not of a frame anew for each row."""
        back = Window.partitionBy(*self.keys).orderBy(*(F.col(c).desc() for c in self.by))
        return back.rowsBetween(Window.unboundedPreceding, 0)


#: The order of one day's events of one instrument.
DAY = Order()


def dealt(df: DataFrame, keys: Iterable[str] = DAY.keys) -> DataFrame:
    """Rows dealt by ``keys`` to `spark.sql.shuffle.partitions` tasks. Windows of these keys need no other exchange; theirs would put
    partitions that are small as bytes together, so that a task's memory grew with the table and not with a series."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and infinite values as null."""
    x = col(c).cast("double")
    return F.when(F.abs(x) < float("inf"), x)  # NaN is above infinity


def _two_parts(x: Decimal) -> tuple[float, float]:
    high = float(x)
    return high, float(x - Decimal(high))


def _log_table() -> tuple[list[tuple[float, float]], float, float]:
    """Logarithms of 128/128 .. 256/128 in two parts, and that of 2, whose first part ends in zeros."""
    with localcontext(prec=60):
        two = Decimal(2).ln()
        high = float(int(two * 2**40)) / 2**40
        return [_two_parts((Decimal(i) / 128).ln()) for i in range(128, 257)], high, float(two - Decimal(high))


_LOGS, _LN2, _LN2_REST = _log_table()


def ln(c: Column | str) -> Column:
    """The natural logarithm rounded from some 60 bits, as C libraries give it; Spark's own is now and then the double beside it, so that
    of two equal logarithms one may be less. Null at 0 and below.

    x is 2^e m, m near a whole 128th, whose logarithm is known in two parts; the rest is a log1p near 0.
    """
    x = col(c).cast("double")
    e = F.floor(F.log2(x)).cast("double")
    m = x / F.pow(F.lit(2.0), e)
    i = F.floor(m * 128 + 0.5)
    known = lambda part: F.get(F.array(*(F.lit(v[part]) for v in _LOGS)), (i - 128).cast("int"))
    a, b = e * _LN2, known(0)
    s = a + b
    lost = (a - (s - (s - a))) + (b - (s - a))
    return F.coalesce(s + (F.log1p(F.try_divide(m * 128 - i, i.cast("double"))) + (lost + (e * _LN2_REST + known(1)))), F.log(x))


def diff(c: Column | str, order: Order = DAY, n: int = 1) -> Column:
    return col(c) - F.lag(c, n).over(order.rows())


def forward_fill(c: Column | str, order: Order = DAY) -> Column:
    return F.last(c, ignorenulls=True).over(order.past())


def backward_fill(c: Column | str, order: Order = DAY) -> Column:
    return F.last(c, ignorenulls=True).over(order.future())


def position(order: Order = DAY) -> Column:
    """0-based place in the series."""
    return F.row_number().over(order.rows()) - 1


#: Trailing sums over more rows than this are put together from sums within blocks.
FRAME = 64


def rolling(df: DataFrame, sums: dict[str, tuple[str, int, int]], order: Order = DAY) -> DataFrame:
    """Adds trailing sums ``name: (column, rows, fewest non-null values)``; NaN and infinite values count as null.

    A sum has nothing but its own rows in it, so a huge value is forgotten once it has left the window. Short windows are
    frames. A long one of n rows is cut by blocks of n rows: what its last rows have in their block so far, and what its first
    rows have from their place to their block's end; both run on, so the cost doesn't depend on n.
    """
    short = {k: v for k, v in sums.items() if v[1] <= FRAME}
    out = {}
    for name, (c, n, least) in short.items():
        x, frame = finite(c), order.rows().rowsBetween(-(n - 1), 0)
        out[name] = F.when(F.count(x).over(frame) >= least, F.coalesce(F.sum(x).over(frame), F.lit(0.0)))
    df = df.withColumns(out) if out else df
    for n in dict.fromkeys(v[1] for k, v in sums.items() if k not in short):
        mine = {k: (c, least) for k, (c, m, least) in sums.items() if m == n}
        df = df.withColumn("_place", position(order))
        df = df.withColumn("_block", F.floor(F.col("_place") / n))
        within = Order((*order.keys, "_block"), order.by)
        parts = {}
        for k, (c, _) in mine.items():
            x = finite(c)
            for e, w in (("head", within.past()), ("tail", within.future())):
                parts[f"_{k}_{e}"] = F.struct(F.coalesce(F.sum(x).over(w), F.lit(0.0)).alias("s"), F.count(x).over(w).alias("c"))
        df = df.withColumns(parts)
        df = df.withColumns({f"_{k}_tail": F.lag(f"_{k}_tail", n - 1).over(order.rows()) for k in mine})
        whole = F.col("_place") % n == n - 1  # then the block's sum so far is all
        tail = lambda k, f: F.when(whole, 0).otherwise(F.coalesce(F.col(f"_{k}_tail.{f}"), F.lit(0)))
        df = df.withColumns({k: F.when(F.col(f"_{k}_head.c") + tail(k, "c") >= least, F.col(f"_{k}_head.s") + tail(k, "s")) for k, (_, least) in mine.items()})
        df = df.drop("_place", "_block", *(f"_{k}_{e}" for k in mine for e in ("head", "tail")))
    return df


def utc_micros(df: DataFrame, c: str) -> Column:
    """Microseconds since 1970 in UTC, whatever the session's time zone; a timestamp without a zone is read as UTC."""
    if dict(df.dtypes)[c] != "timestamp_ntz":
        return F.unix_micros(F.col(c).cast("timestamp"))
    since = F.col(c) - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    part = lambda unit: F.extract(F.lit(unit), since)
    seconds = (part("DAY").cast("long") * 24 + part("HOUR")) * 3600 + part("MINUTE") * 60
    return seconds * 1_000_000 + (part("SECOND") * 1_000_000).cast("long")
