"""Class labels of bars from what follows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.series import Order, backward_fill, forward_fill
from .bars import BARS

#: Thresholds of forward returns by k, that of forward sums, and its multiples by k.
RETURN_THRESHOLDS = {1: 4.15e-5, 2: 4.15e-5, 4: 7.5e-5}
SUM_THRESHOLD = 7e-6
SUM_MULTIPLES = {1: 1.0, 2: 1.5, 4: 2.0}


def class_label(df: DataFrame, kind: str, fill_missing: bool = False, order: Order = BARS, out: str = "class") -> DataFrame:
    """+1 up, -1 down, 0 flat. ``c<k>``: by the forward return over k bars; ``ca<k>``: forward against backward sum.

    A missing value gives 0, so the last k bars are flat. ``fill_missing`` first fills returns and forward sums forwards
    and backward sums backwards. Unknown kinds raise KeyError, missing columns ValueError.
    """
    k = int(kind.lstrip("ca"))
    sums = kind.startswith("ca")
    theta = SUM_THRESHOLD * SUM_MULTIPLES[k] if sums else RETURN_THRESHOLDS[k]
    needed = [f"log_mid_sum_fwd_{k}", f"log_mid_sum_bwd_{k}"] if sums else [f"log_mid_return_fwd_{k}"]
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"columns {missing} are missing")
    a = forward_fill(needed[0], order) if fill_missing else F.col(needed[0])
    if sums:
        b = backward_fill(needed[1], order) if fill_missing else F.col(needed[1])
        return df.withColumn(out, F.when(a > b * (1 + theta), 1).when(a < b * (1 - theta), -1).otherwise(0))
    return df.withColumn(out, F.when(a > theta, 1).when(a < -theta, -1).otherwise(0))


def suffix_mean(c: str, n: int, order: Order = BARS) -> Column:
    """Mean of the next n values."""
    return F.avg(c).over(order.rows().rowsBetween(1, n))


def next_sign(c: str, order: Order = BARS) -> Column:
    """0 where the next value is 0 or less, else 1."""
    return F.when(F.lead(c).over(order.rows()) <= 0, 0).otherwise(1)


def rises(c: str, n: int, order: Order = BARS) -> Column:
    """1 where the next n values' mean is above the present value."""
    return F.when(suffix_mean(c, n, order) > F.col(c), 1).otherwise(0)


def falls_on_average(c: str, before: int, after: int, order: Order = BARS) -> Column:
    """1 where the mean of the last ``before`` values is above that of the next ``after``."""
    return F.when(F.avg(c).over(order.rows().rowsBetween(-(before - 1), 0)) > suffix_mean(c, after, order), 1).otherwise(0)


def windows(df: DataFrame, c: str, before: int, after: int, order: Order = BARS) -> DataFrame:
    """Rows with a full ``prefix`` (last ``before`` values) and ``suffix`` (next ``after``) as arrays."""
    df = df.withColumns(
        {
            "prefix": F.collect_list(c).over(order.rows().rowsBetween(-(before - 1), 0)),
            "suffix": F.collect_list(c).over(order.rows().rowsBetween(1, after)),
        }
    )
    return df.where((F.size("prefix") == before) & (F.size("suffix") == after))
