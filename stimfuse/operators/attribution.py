"""Shared and unique parts of explained variance, as expressions over pairwise correlations. Only the correlations need a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stimfuse.functions.stats import safe_corr


def partial_r(r_ya: Column, r_yb: Column, r_ab: Column) -> Column:
    """r of y and a with b regressed out of both; NULL where nothing is left of one of them."""
    return F.try_divide(r_ya - r_yb * r_ab, F.sqrt(F.greatest(1 - r_yb * r_yb, F.lit(0.0))) * F.sqrt(F.greatest(1 - r_ab * r_ab, F.lit(0.0))))


def two_predictor_r2(r1: Column, r2: Column, r12: Column) -> Column:
    return F.try_divide(r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12, 1 - r12 * r12)


def three_predictor_r2(r1: Column, r2: Column, r3: Column, r12: Column, r13: Column, r23: Column) -> Column:
    """1 - det of all four over det of the predictors, written out."""
    det = 1 + 2 * r12 * r13 * r23 - r12 * r12 - r13 * r13 - r23 * r23
    a = r1 * r1 * (1 - r23 * r23) + r2 * r2 * (1 - r13 * r13) + r3 * r3 * (1 - r12 * r12)
    b = 2 * (r1 * r2 * (r13 * r23 - r12) + r1 * r3 * (r12 * r23 - r13) + r2 * r3 * (r12 * r13 - r23))
    return F.try_divide(a + b, det)


def pairwise(rows: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """One column per named pair: its r within keys, all in one aggregation."""
    return rows.groupBy(*keys).agg(*[safe_corr(F.col(a), F.col(b)).alias(name) for name, (a, b) in pairs.items()])


def partial_correlation(rows: DataFrame, keys: list[str], y: str, a: str, b: str) -> DataFrame:
    """r of y and a without b (ra), and of y and b without a (rb)."""
    r = pairwise(rows, keys, {"ya": (y, a), "yb": (y, b), "ab": (a, b)})
    c = F.col
    return r.select(*keys, partial_r(c("ya"), c("yb"), c("ab")).alias("ra"), partial_r(c("yb"), c("ya"), c("ab")).alias("rb"))


def commonality(rows: DataFrame, keys: list[str], y: str, a: str, b: str) -> DataFrame:
    """What a and b explain of y together: r_a^2 + r_b^2 - R^2."""
    return common_part(pairwise(rows, keys, {"ya": (y, a), "yb": (y, b), "ab": (a, b)}), keys)


def common_part(r: DataFrame, keys: list[str]) -> DataFrame:
    """commonality() of correlations (keys, ya, yb, ab)."""
    c = F.col
    return r.select(*keys, (c("ya") * c("ya") + c("yb") * c("yb") - two_predictor_r2(c("ya"), c("yb"), c("ab"))).alias("common"))


def variance_partition(rows: DataFrame, keys: list[str], f: str, v: str, l: str, e: str) -> DataFrame:
    """unique_v, unique_l (commonality of each model with e, the other regressed out) and shared (both models with e)."""
    return variance_parts(pairwise(rows, keys, {"fv": (f, v), "fl": (f, l), "fe": (f, e), "vl": (v, l), "ve": (v, e), "le": (l, e)}), keys)


def variance_parts(r: DataFrame, keys: list[str]) -> DataFrame:
    """variance_partition() of correlations (keys, fv, fl, fe, vl, ve, le)."""
    c = F.col

    def unique(fx: str, fo: str, xo: str, xe: str, oe: str) -> Column:
        f_x, f_e, x_e = partial_r(c(fx), c(fo), c(xo)), partial_r(c("fe"), c(fo), c(oe)), partial_r(c(xe), c(xo), c(oe))
        return f_x * f_x + f_e * f_e - two_predictor_r2(f_x, f_e, x_e)

    shared = two_predictor_r2(c("fv"), c("fl"), c("vl")) + c("fe") * c("fe") - three_predictor_r2(c("fv"), c("fl"), c("fe"), c("vl"), c("ve"), c("le"))
    return r.select(*keys, unique("fv", "fl", "vl", "ve", "le").alias("unique_v"), unique("fl", "fv", "vl", "le", "ve").alias("unique_l"), shared.alias("shared"))


def ols(rows: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """Slope and intercept of y on x within keys; a constant x gives slope 0."""
    slope = F.coalesce(F.try_divide(F.covar_pop(y, x), F.var_pop(x)), F.lit(0.0))
    return rows.groupBy(*keys).agg(slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"))


def ols_fit_predict(rows: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """The rows with predicted and residual."""
    fit = ols(rows, keys, y, x)
    return rows.join(fit, keys).withColumn("predicted", F.col("intercept") + F.col("slope") * F.col(x)).withColumn("residual", F.col(y) - F.col("predicted"))
