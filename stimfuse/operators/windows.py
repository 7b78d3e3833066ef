"""Window operators: z-scores, ranks, runs and adjusted p-values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stimfuse.functions.stats import average_rank
from stimfuse.session import checkpointed


#: Bytes of a table with a row per key up to which it is broadcast; copies of it among which rows are salted beyond that.
BROADCAST, SALTS = 16 << 20, 32


def beside(rows: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of per_key, one row per keys (null is a key as well), without gathering the rows of a key in one task.

    per_key is broadcast if its counted bytes are few; else rows are salted over SALTS copies of it."""
    sizes = [F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(1)) if f.dataType.typeName() == "string" else F.lit(8) for f in per_key.schema.fields]
    size = per_key.agg(F.sum(sum(sizes, F.lit(32)))).first()[0] or 0
    right = per_key.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in per_key.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    if size <= BROADCAST:
        return rows.join(F.broadcast(right), same).drop(*[f"__{k}" for k in keys])
    salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    met = rows.withColumn("__own", spread).join(salted, [*same, F.col("__own") == F.col("__salt")])
    return met.drop("__own", "__salt", *[f"__{k}" for k in keys])


def zscore(rows: DataFrame, keys: list[str], value: str = "value", eps: float = 0.0) -> DataFrame:
    """(x - mean) / (population standard deviation + eps) within keys; NULL where the divisor is 0. The moments are partial aggregations."""
    moments = checkpointed(rows.groupBy(*keys).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__sd")))
    return beside(rows, moments, keys).withColumn("z", F.try_divide(F.col(value) - F.col("__mean"), F.col("__sd") + eps)).drop("__mean", "__sd")


def ranked(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Average ranks within keys, by a window: for many keys with few rows each."""
    return rows.withColumn("rank", average_rank(Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys, value)))


def placed(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values of each keys, which may hold a large part of the table: (keys, value, __n, __upto), how many rows have the value and how
    many of the keys have it or a smaller one. Values are sorted in ranges, and running counts, less what stands before the keys, are kept.
    NULL comes first, as in a window."""
    distinct = numbered(rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n")), [*[F.col(k).asc() for k in keys], F.col(value).asc()], "__place")
    upto = F.sum("__n").over(Window.partitionBy("__part").orderBy("__place"))
    parts = distinct.groupBy("__part").agg(F.sum("__n").alias("__in"))  # one row per range
    before = parts.select("__part", F.coalesce(F.sum("__in").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    running = distinct.join(F.broadcast(before), "__part").withColumn("__upto", F.col("__before") + upto)
    first = running.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(F.col("__upto") - F.col("__n")).alias("__first"))
    met = running.join(first, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]) if keys else running.crossJoin(F.broadcast(first))
    return met.select(*keys, value, "__n", (F.col("__upto") - F.col("__first")).alias("__upto"))


def ranked_at_scale(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Average ranks within keys that may hold a large part of the table. NULL ranks first, as in a window."""
    ranks = placed(rows, keys, value).select(*[F.col(c).alias(f"__{c}") for c in (*keys, value)], (F.col("__upto") - (F.col("__n") - 1) / 2).alias("rank"))
    return rows.join(ranks, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*keys, value)]).drop(*[f"__{c}" for c in (*keys, value)])


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, q array): exact quantiles within keys that may hold a large part of the table, between the two nearest values in proportion.
    NULL counts for nothing; keys without a value have no row."""
    run = checkpointed(placed(rows.filter(F.col(value).isNotNull()), keys, value))
    n = run.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    met = beside(run, n, keys) if keys else run.crossJoin(F.broadcast(n))
    out = []
    for k, p in enumerate(shares):
        # places count from 0: the value there is the least with more rows up to it
        at = (F.col("__all") - 1) * F.lit(float(p))
        for name, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            out.append(F.min(F.when(F.col("__upto") > place, F.col(value))).alias(f"__{name}{k}"))
        out.append(F.first(at - F.floor(at)).alias(f"__share{k}"))
    found = met.groupBy(*keys).agg(*out)
    q = [(1 - F.col(f"__share{k}")) * F.col(f"__low{k}") + F.col(f"__share{k}") * F.col(f"__high{k}") for k in range(len(shares))]
    return found.select(*keys, F.array(*q).alias("q"))


def cluster_label(rows: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """Number (from 1) of the run of consecutive true flags that a row is in; NULL where the flag is false."""
    w = Window.partitionBy(*keys).orderBy(order)
    opens = F.when(F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False)), 1).otherwise(0)
    started = rows.withColumn("__opens", opens)
    number = F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    return started.withColumn("cluster", F.when(F.col(flag), number)).drop("__opens")


def merge_adjacent_windows(bins: DataFrame, keys: list[str], start: str, stop: str, winner: str) -> DataFrame:
    """Touching bins with the same winner become one."""
    w = Window.partitionBy(*keys).orderBy(start)
    opens = (F.lag(winner).over(w) == F.col(winner)) & (F.lag(stop).over(w) == F.col(start))
    numbered = bins.withColumn("__new", F.when(F.coalesce(opens, F.lit(False)), 0).otherwise(1))
    run = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return numbered.withColumn("__run", run).groupBy(*keys, winner, "__run").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("__run")


def numbered(rows: DataFrame, order: list, name: str = "place") -> DataFrame:
    """Rows numbered from 1 in an order over all of them, and __part, which rises with the number: ranges of the order are sorted
    apart, and their sizes, one row each, tell where each starts."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    parts = checkpointed(parts)
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))  # the number of a row in its partition
    return parts.join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part").withColumn(name, F.col("__before") + at + 1).drop("__at", "__before")


def positions(rows: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """Rows numbered from 1 within keys that may hold a large part of the table: their numbers in the order of all rows, less what stands
    before the first of their keys."""
    every = numbered(rows, [F.col(c).asc() for c in (*keys, *order)], "__place").drop("__part")
    first = checkpointed(every.groupBy(*keys).agg(F.min("__place").alias("__first")))
    return beside(every, first, keys).withColumn(name, F.col("__place") - F.col("__first") + 1).drop("__place", "__first")


def has_p(p: str):
    return F.col(p).isNotNull() & ~F.isnan(p)


def bh_adjust(rows: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Benjamini-Hochberg adjusted p within keys, or over all rows without keys. Tests without a p (NULL or NaN) count for nothing and get NULL."""
    real, rest = rows.filter(has_p(p)), rows.filter(~has_p(p)).withColumn("p_adjusted", F.lit(None).cast("double"))
    if keys:
        w = Window.partitionBy(*keys)
        scaled = real.withColumn("__r", F.row_number().over(w.orderBy(p))).withColumn("__s", F.col(p) * F.count(F.lit(1)).over(w) / F.col("__r"))
        least = F.min("__s").over(w.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return scaled.withColumn("p_adjusted", F.least(least, F.lit(1.0))).drop("__r", "__s").unionByName(rest)
    # one family of all tests: ranges of p apart, and the least of all later ranges beside each
    placed = numbered(real, [F.col(p).asc()], "__r")
    n = placed.agg(F.count(F.lit(1)).alias("__n"))
    scaled = placed.crossJoin(F.broadcast(n)).withColumn("__s", F.col(p) * F.col("__n") / F.col("__r"))
    later = scaled.groupBy("__part").agg(F.min("__s").alias("__s")).select("__part", F.min("__s").over(Window.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)).alias("__later"))
    least = F.min("__s").over(Window.partitionBy("__part").orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = scaled.withColumn("__least", least).join(F.broadcast(later), "__part")
    return out.withColumn("p_adjusted", F.least("__least", "__later", F.lit(1.0))).select(*rows.columns, "p_adjusted").unionByName(rest)


def bonferroni(rows: DataFrame, keys: list[str], p: str = "p", alpha: float = 0.05) -> DataFrame:
    """p times the number of tests that have a p, at most 1, and the verdict; NULL for tests without a p."""
    n = rows.filter(has_p(p)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    met = rows.join(n, keys, "left") if keys else rows.crossJoin(F.broadcast(n))
    adjusted = F.when(has_p(p), F.least(F.col(p) * F.col("__n"), F.lit(1.0)))
    return met.withColumn("p_adjusted", adjusted).withColumn("significant", F.col("p_adjusted") < alpha).select(*rows.columns, "p_adjusted", "significant")
