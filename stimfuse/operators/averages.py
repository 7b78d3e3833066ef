"""Averages over repeats, vertices and subjects, and their summaries. All are one partial and one final aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stimfuse.functions.stats import missing, t_quantile
from stimfuse.operators.windows import beside, quantiles
from stimfuse.session import checkpointed


def repeat_mean(trials: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Plain mean over repeats: a NaN repeat makes the mean NaN."""
    return trials.groupBy(*keys).agg(F.avg(value).alias(value))


def repeat_nanmean(trials: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean over repeats that are not NaN; 0 if all are."""
    return trials.groupBy(*keys).agg(F.coalesce(F.avg(missing(F.col(value))), F.lit(0.0)).alias(value))


def condition_average(data: DataFrame, wanted: DataFrame, keys: list[str], condition: str = "condition", value: str = "value") -> DataFrame:
    """Mean per wanted condition; a condition without data gets a row with NULL."""
    means = data.join(wanted.select(condition).distinct(), condition, "left_semi").groupBy(condition, *keys).agg(F.avg(value).alias(value))
    return wanted.select(condition).distinct().join(means, condition, "left")


def repeat_number(trials: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Order of a repeat inside its condition, from 1."""
    return trials.withColumn("repeat", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def half_repeat_mean(trials: DataFrame, keys: list[str], order: list, value: str = "value") -> DataFrame:
    """Mean of repeats 1, 3, 5, ... (half 0) and of 2, 4, 6, ... (half 1)."""
    return repeat_number(trials, keys, order).groupBy(*keys, ((F.col("repeat") - 1) % 2).alias("half")).agg(F.avg(value).alias(value))


def pseudo_trials(trials: DataFrame, keys: list[str], order: list, groups: int, value: str = "value") -> DataFrame:
    """`groups` means of consecutive repeats; only conditions whose number of repeats divides evenly."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    numbered = repeat_number(trials, keys, order).withColumn("n", n).filter(F.col("n") % groups == 0)
    pseudo = F.floor((F.col("repeat") - 1) / (F.col("n") / groups)).cast("int")
    return numbered.groupBy(*keys, pseudo.alias("pseudo")).agg(F.avg(value).alias(value))


def mean_vector(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Element-wise mean of vectors, packed again in order."""
    long = rows.select(*keys, F.posexplode(vector).alias("pos", "x"))
    means = long.groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(vector))


def keyed_bundle(rows: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """One map from name to value per keys, such as the arrays of a model by layer; a name that comes twice is an error of Spark's."""
    return rows.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("bundle"))


def roi_timecourse(scores: DataFrame, members: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """Mean over the vertices of a region; a NaN vertex makes the mean NaN."""
    return scores.join(members, "vertex").groupBy("roi", *keys).agg(F.avg(value).alias(value))


def roi_nanmean(scores: DataFrame, members: DataFrame, regions: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """Mean over the vertices that are not NaN, NaN where a region has none."""
    means = scores.join(members, "vertex").groupBy("roi", *keys).agg(F.avg(missing(F.col(value))).alias(value))
    return regions.join(means, ["roi", *keys], "left").withColumn(value, F.coalesce(value, F.lit(float("nan"))))


def group_mean_map(scores: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    return scores.groupBy(*keys).agg(F.avg(value).alias(value))


def mean_ci95(values: DataFrame, keys: list[str], n: int, value: str = "value") -> DataFrame:
    """Mean and mean -/+ t(0.975, n - 1) times the standard error; n: number of subjects."""
    t = t_quantile(0.975, n - 1)
    half = t * F.stddev_samp(value) / F.sqrt(F.count(value))
    return values.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))


def two_level_summary(values: DataFrame, unit: list[str], keys: list[str], value: str = "value") -> DataFrame:
    """Mean per unit, then mean and sample standard deviation over units; NaN is skipped."""
    per = values.groupBy(*keys, *unit).agg(F.avg(missing(F.col(value))).alias("m"))
    return per.groupBy(*keys).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.count("m").alias("n"))


def roi_noise_ceiling(members: DataFrame, quality: DataFrame, region: str = "macro", formula: str = "sqrt") -> DataFrame:
    """Mean over a region's vertices of sqrt(max(ncsnr, 0)), or of sqrt(s / (s + 1)) with formula snr_ratio; 0 for a region without any."""
    x = F.greatest(F.col("ncsnr"), F.lit(0.0))
    y: Column = F.sqrt(x) if formula == "sqrt" else F.sqrt(x / (x + 1))
    return members.join(quality, "vertex", "left").groupBy(region).agg(F.coalesce(F.avg(y), F.lit(0.0)).alias("ceiling"))


def box_summary(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Quartiles, and whiskers at the last values within 1.5 interquartile ranges of them; a group may hold a large part of the table."""
    q = checkpointed(quantiles(values, keys, value, [0.25, 0.5, 0.75]).select(*keys, *[F.col("q")[k].alias(n) for k, n in enumerate(("q1", "median", "q3"))]))
    wide = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - wide) & (F.col(value) <= F.col("q3") + wide)
    ends = beside(values, q, keys).filter(inside).groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return beside(q, ends, keys)
