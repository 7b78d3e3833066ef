"""Time axis, masks, checks and value changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def time_axis(spark: SparkSession, points: int = 615, first: float = -200, last: float = 1000, shift: int = -50, low: int = -100, high: int = 600) -> DataFrame:
    """t_idx, t_ms of evenly spaced points, rounded half to even, shifted and cropped."""
    ms = F.bround(F.lit(float(first)) + F.col("id") * F.lit((last - first) / (points - 1)), 0).cast("int") + shift
    kept = spark.range(points).select("id", ms.alias("t_ms")).filter(F.col("t_ms").between(low, high))
    return kept.select((F.row_number().over(Window.orderBy("id")) - 1).alias("t_idx"), "t_ms")


def roi_quality_mask(rows: DataFrame, members: DataFrame, quality: DataFrame, least: float = 0.2) -> DataFrame:
    """Rows of vertices that are in the region and good enough; each row once."""
    good = quality.filter(F.col("ncsnr") >= least).select("vertex")
    return rows.join(members.select("vertex").distinct(), "vertex", "left_semi").join(good, "vertex", "left_semi")


def quality_nan_mask(rows: DataFrame, quality: DataFrame, value: str = "score", least: float = 0.2) -> DataFrame:
    """Rows stay; values of vertices under the limit become NaN."""
    return rows.join(quality, "vertex", "left").withColumn(value, F.when(F.col("ncsnr") >= least, F.col(value)).otherwise(F.lit(float("nan")))).drop("ncsnr")


def zero_fill_unselected(rows: DataFrame, grid: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """Every row of the grid, 0 where rows has none."""
    return grid.join(rows, keys, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def vertex_block(vertex: Column, size: int) -> Column:
    return (F.floor(vertex / size) + 1).cast("int")


#: The ranges that entries of a dissimilarity matrix are cut to, by metric.
METRIC_RANGE = {"correlation": (0.0, 2.0), "cosine": (0.0, 1.0), "euclidean": (0.0, float("inf"))}


def clip_rdm_values(d: Column, metric: str) -> Column:
    if metric not in METRIC_RANGE:
        raise ValueError(f"metric {metric} is not known")
    low, high = METRIC_RANGE[metric]
    return F.least(F.greatest(d, F.lit(low)), F.lit(high))


def gamma_encode(values: Column) -> Column:
    """Each of an array's samples as the whole part of sqrt(x / 255) * 255."""
    return F.transform(values, lambda x: (F.sqrt(x / 255.0) * 255).cast("int"))


def keep_n_repeats(rows: DataFrame, n: int, condition: str = "condition") -> DataFrame:
    """Rows of conditions that occur exactly n times."""
    return rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(condition))).filter(F.col("__n") == n).drop("__n")


def subsample_conditions(conditions: DataFrame, n: int, seed: int, condition: str = "condition") -> DataFrame:
    """n conditions in the order of a hash of seed and id; the same n on every run."""
    return conditions.select(condition).distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(condition).cast("string")).cast("binary")), condition).limit(n)


def expect_pairs(rdm: DataFrame, keys: list[str]) -> DataFrame:
    """Per matrix: number of pairs, the number of stimuli that it implies, and whether it is a full upper triangle."""
    n = F.round((1 + F.sqrt(1 + 8 * F.col("pairs"))) / 2).cast("bigint")
    return rdm.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs")).withColumn("stimuli", n).withColumn("complete", F.col("stimuli") * (F.col("stimuli") - 1) / 2 == F.col("pairs"))


def infer_axis_roles(rows: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Which key column has which role, by its number of values; a role that no column or several columns fit gets NULL."""
    counts = rows.agg(*[F.count_distinct(c).alias(c) for c in rows.columns])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in rows.columns])).alias("x")).select("x.*")
    roles = F.explode(F.array(*[F.struct(F.lit(k).alias("role"), F.lit(n).cast("bigint").alias("n")) for k, n in sizes.items()]))
    wanted = rows.sparkSession.range(1).select(roles.alias("r")).select("r.*")
    found = wanted.join(long, "n", "left").groupBy("role").agg(F.when(F.count("column") == 1, F.max("column")).alias("column"))
    return found
