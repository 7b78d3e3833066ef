"""Connected components of a link table, as DataFrame rounds that survive lost executors.

Each round replaces the links of every node by links to the smallest node it knows, first towards larger neighbours and then
among smaller ones, until nothing changes; each round is a reliable checkpoint. The minimum of a node is a partial
aggregation, so a node with very many links costs no more than its rows. Links are few beside the rows they come from: each step
is run by as many tasks as their counted number needs, so that exchanges don't leave files of every task for a handful of rows, and
where one task is enough a round is one job without exchanges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stimfuse.session import checkpointed


#: Links that a task takes.
TASK = 250_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as so many rows need."""
    return df.coalesce(max(1, -(-rows // TASK)))


def _both_ways(pairs: DataFrame, one: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """Two links (u, v) of each row, in the row's own partition, so that pairs are made once."""
    ends = [F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in (one, other)]
    return pairs.select(F.explode(F.array(*ends)).alias("link")).select("link.u", "link.v")


def _to_smallest(links: DataFrame, one: bool) -> DataFrame:
    """links (u, v): every v of u, and u itself, gets a link to the least of them. one: a task holds all links, so none have to meet."""
    if one:
        return links.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
    least = links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return links.join(least, "u")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (u, v), of any orderable type: one row (node, component) per node that has a link; component is the least node that it reaches."""
    now = checkpointed(links.select("u", "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        n = now.count()
        now, one = few(now, n), n <= TASK
        large = _to_smallest(_both_ways(now, ("u", "v"), ("v", "u")), one).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = few(few(large.filter("u <> v"), n).distinct(), n)
        # among smaller neighbours: each, and the node itself, to the least
        next_links = _both_ways(_to_smallest(down, one), ("v", "m"), ("u", "m")).filter("u <> v")
        later = few(checkpointed(few(few(next_links, n).distinct(), n)), n)
        # stars: every node has one link, and no target has a link of its own
        ends = F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("own")), F.struct(F.col("v").alias("x"), F.lit(0).alias("own"))))
        own = later.select(ends.alias("end")).groupBy("end.x").agg(F.sum("end.own").alias("own"), F.min("end.own").alias("least"))
        open_ends = own.filter("own > 1 or own > least").limit(1).count()
        now = later
        if not open_ends:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
