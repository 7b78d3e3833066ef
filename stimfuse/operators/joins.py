"""Joins that align stimuli, regions, halves and analyses. Identity is carried by keys, never by position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stimfuse.operators.windows import numbered


def align_modalities(signals: DataFrame, responses: DataFrame, condition: str = "condition") -> DataFrame:
    """Rows of both measurements of the same stimulus."""
    return signals.join(responses, condition)


def union_roi_masks(rows: DataFrame, members: DataFrame, regions: list[str], region: str = "roi") -> DataFrame:
    """Rows of vertices in any of the regions; each row once."""
    return rows.join(members.filter(F.col(region).isin(regions)).select("vertex").distinct(), "vertex", "left_semi")


def concat_roi_pools(rows: DataFrame, members: DataFrame, regions: list[str], region: str = "roi") -> DataFrame:
    """Rows of vertices in the regions; once for every region that holds the vertex."""
    return rows.join(members.filter(F.col(region).isin(regions)), "vertex")


def opposite_half_join(weights: DataFrame, data: DataFrame, keys: list[str], half: str = "half") -> DataFrame:
    """Weights of one half with data of the other."""
    flipped = weights.withColumn(half, F.when(F.col(half) == "even", "odd").otherwise("even"))
    return flipped.join(data, [*keys, half])


def predicted(x: Column, coef: Column, intercept: Column) -> Column:
    """Packed features times packed coefficients, plus the intercept."""
    return F.aggregate(F.zip_with(x, coef, lambda a, b: a.cast("double") * b.cast("double")), intercept.cast("double"), lambda s, v: s + v)


def shared_across(rows: DataFrame, units: str, condition: str, times: int) -> DataFrame:
    """Conditions that every unit has at least `times` times."""
    n = rows.agg(F.count_distinct(units).alias("n"))
    per = rows.groupBy(condition, units).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= times)
    return per.groupBy(condition).agg(F.count(F.lit(1)).alias("have")).join(F.broadcast(n), F.col("have") == F.col("n")).select(condition)


def intersect_units(rows: DataFrame, units: str, condition: str, values: list) -> DataFrame:
    """Conditions that all of the given units have: one scan, each condition's units counted once."""
    mine = rows.filter(F.col(units).isin(values)).select(condition, units).distinct()
    return mine.groupBy(condition).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == len(set(values))).select(condition)


def positional_pick(ids: DataFrame, positions: list[int], order: str) -> DataFrame:
    """Rows at the given 1-based places of the order."""
    return numbered(ids, [F.col(order).asc()]).drop("__part").filter(F.col("place").isin(positions)).withColumn("place", F.col("place").cast("int"))


def both_halves_average(rows: DataFrame, keys: list[str], value: str, half: str = "half") -> DataFrame:
    """Mean of the two directions, only where both exist."""
    return rows.groupBy(*keys).agg(F.avg(value).alias(value), F.count_distinct(half).alias("n")).filter("n = 2").drop("n")


def tolerant_union(parts: DataFrame, expected: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The parts that are expected, and a report of the expected keys that no part has."""
    return expected.join(parts, keys), expected.join(parts.select(*keys).distinct(), keys, "left_anti")


def paired_join(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """x and y of two analyses; pairs with a NaN are dropped."""
    both = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys)
    return both.filter(~F.isnan("x") & ~F.isnan("y"))


def union_parts(parts: list[DataFrame]) -> DataFrame:
    """Blocks, hemispheres or sessions as one table, matched by column name."""
    return reduce(lambda p, q: p.unionByName(q), parts)


def except_cross_pairs(pairs: DataFrame, halves: DataFrame) -> DataFrame:
    """Pairs (i, j) without those whose conditions lie in different halves."""
    a, b = halves.select(F.col("condition").alias("i"), F.col("half").alias("hi")), halves.select(F.col("condition").alias("j"), F.col("half").alias("hj"))
    cross = pairs.join(a, "i").join(b, "j").filter("hi <> hj").select("i", "j")
    return pairs.join(cross, ["i", "j"], "left_anti")
