"""The given tables seen as stimuli, signals, responses, regions and features; each view exists for Spark and as a DuckDB CTE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stimfuse.session import table


def curve(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select((F.col("user_id") % 6).cast("int").alias("subject"), F.hour("ts").alias("t_idx"), (20 * F.hour("ts") - 100).alias("t_ms"), "value")


def subject_curve(spark: SparkSession, d: str) -> DataFrame:
    """Mean curve per subject, centred on the grand mean so that its sign varies."""
    c = curve(spark, d)
    grand = c.agg(F.avg("value").alias("grand"))
    return c.groupBy("subject", "t_idx", "t_ms").agg(F.avg("value").alias("mean")).crossJoin(F.broadcast(grand)).select("subject", "t_idx", "t_ms", F.round(F.col("mean") - F.col("grand"), 9).alias("value"))


def signal_trials(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.dayofmonth("ts").alias("session"), F.col("user_id").alias("condition"), F.col("event_type").alias("channel"), "ts", F.col("event_id").alias("trial"), "value")


def response_trials(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    return x.select((F.col("l_orderkey") % 6).cast("int").alias("subject"), F.col("l_linestatus").alias("hemi"), F.col("l_suppkey").alias("vertex"), F.col("l_partkey").alias("condition"), F.col("l_orderkey").alias("trial"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), F.col("l_tax").alias("c"))


def vertex_quality(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("vertex"), (F.col("s_acctbal") / 10000).alias("ncsnr"))


def roi_membership(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("vertex"), F.trim("n_name").alias("roi"), F.trim("r_name").alias("macro"))


def score_map(spark: SparkSession, d: str) -> DataFrame:
    """One value per (subject, hemi, t, vertex): mean response by order-key class."""
    x = response_trials(spark, d)
    return x.groupBy("subject", "hemi", (F.col("trial") % 4).cast("int").alias("t_idx"), "vertex").agg((F.avg("value") / 100000).alias("score"))


def features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("condition"), "embedding", "label")


VIEWS = """with
curve as (select (user_id % 6)::int as subject, hour(ts)::int as t_idx, (20 * hour(ts) - 100)::int as t_ms, value from events),
subject_curve as (select subject, t_idx, t_ms, round(avg(value) - (select avg(value) from curve), 9) as value from curve group by all),
signal_trials as (select day(ts)::int as session, user_id as condition, event_type as channel, ts, event_id as trial, value from events),
response_trials as (select (l_orderkey % 6)::int as subject, l_linestatus as hemi, l_suppkey as vertex, l_partkey as condition, l_orderkey as trial, l_linenumber as line, l_extendedprice as value, l_quantity as a, l_discount as b, l_tax as c from lineitem),
vertex_quality as (select s_suppkey as vertex, s_acctbal / 10000 as ncsnr from supplier),
roi_membership as (select s_suppkey as vertex, trim(n_name) as roi, trim(r_name) as macro from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
score_map as (select subject, hemi, (trial % 4)::int as t_idx, vertex, avg(value) / 100000 as score from response_trials group by all),
features as (select vec_id as condition, embedding, label from embeddings)
"""
