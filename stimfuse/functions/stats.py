"""Column expressions for correlation, ranks and the t distribution. All are built-in aggregates or windows, so partial aggregation applies."""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def missing(x: Column) -> Column:
    """NaN as NULL, which averages skip."""
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson's r of a group; NULL where a variance is 0 (corr() itself fails there)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson_eps(x: Column, y: Column, eps: float = 1e-8) -> Column:
    """r with eps added to each standard deviation: 0 where a variance is 0, slightly shrunk elsewhere."""
    return F.covar_pop(x, y) / ((F.stddev_pop(x) + eps) * (F.stddev_pop(y) + eps))


def average_rank(by: WindowSpec, ties: WindowSpec) -> Column:
    """Ranks with ties averaged; `by` orders the group by value, `ties` partitions it by group and value."""
    return F.rank().over(by) + (F.count(F.lit(1)).over(ties) - 1) / 2


def fisher_z(r: Column, bound: float = 0.9999) -> Column:
    return F.atanh(F.greatest(F.least(r, F.lit(bound)), F.lit(-bound)))


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) for a whole number of degrees of freedom, by the finite trigonometric series."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    cos, sin = F.cos(theta), F.sin(theta)
    start = F.when(df % 2 == 1, F.lit(1)).otherwise(F.lit(0))
    first = F.when(df % 2 == 1, cos).otherwise(F.lit(1.0))
    steps = F.sequence(start + 2, F.greatest(df - 2, start), F.lit(2))
    steps = F.when(df - 2 >= start + 2, steps).otherwise(F.array().cast("array<int>"))
    added = F.aggregate(
        steps,
        F.struct(first.alias("term"), first.alias("sum")),
        lambda s, k: F.struct((s["term"] * cos * cos * (k - 1) / k).alias("term"), (s["sum"] + s["term"] * cos * cos * (k - 1) / k).alias("sum")),
    )["sum"]
    odd = F.when(df == 1, 2 * theta / math.pi).otherwise(2 / math.pi * (theta + sin * added))
    return 1 - F.when(df % 2 == 1, odd).otherwise(sin * added)


def t_quantile(p: float, df: int) -> float:
    """The t with P(T <= t) = p, by bisection on the same series; for a number of subjects, on the driver."""

    def below(t: float) -> float:
        theta = math.atan(t / math.sqrt(df))
        cos, sin = math.cos(theta), math.sin(theta)
        term = total = cos if df % 2 else 1.0
        k = 3 if df % 2 else 2
        while k <= df - 2:
            term *= cos * cos * (k - 1) / k
            total += term
            k += 2
        if df % 2:
            inside = 2 / math.pi * (theta + (sin * total if df > 1 else 0))
        else:
            inside = sin * total
        return 0.5 + inside / 2

    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return (lo + hi) / 2
