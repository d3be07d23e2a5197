"""Column helpers that encode the NULL / NaN / ANSI rules the operators need.

* NaN counts as missing: every fitted statistic and every fitted transform
  turns it into NULL (`nan_to_null`), because Spark orders NaN above every
  number and treats NaN = NaN as true.
* Division never raises under ANSI mode: `safe_div` yields NULL for x/0.
* `clip` keeps NULL (and NaN) as NULL; greatest/least would replace it.
* `bucket_right_closed` is pd.cut-style (lo, hi]; a value outside every edge
  pair is NULL.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def is_missing(c: Column | str) -> Column:
    c = col(c)
    return c.isNull() | F.isnan(c)


def is_infinite(c: Column | str) -> Column:
    c = col(c)
    return F.abs(c) == F.lit(float("inf"))


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL when b is 0 or either side is NULL/NaN/inf-producing."""
    r = F.try_divide(col(a).cast("double"), col(b).cast("double"))
    return F.when(~F.isnan(r) & ~is_infinite(r), r)


def clip(c: Column | str, lo: Column | float | None, hi: Column | float | None) -> Column:
    c = nan_to_null(c)
    out = c
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(lo))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(hi))
    return F.when(c.isNotNull(), out)


def euclidean_norm(a: Column | str, b: Column | str) -> Column:
    return F.hypot(col(a), col(b))


def bucket_right_closed(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    if len(edges) != len(labels) + 1:
        raise ValueError("need len(edges) == len(labels) + 1")
    c = col(c)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (c > F.lit(lo)) & (c <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def zero_spread_to_one(scale: Column | str) -> Column:
    s = col(scale)
    return F.when(s.isNull() | (s == 0), F.lit(1.0)).otherwise(s)


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded double for stable result comparison."""
    return F.round(col(c).cast("double"), digits)
