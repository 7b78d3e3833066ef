"""Mixing sources to target weights with hash-threshold histograms.

Sizes are summed by source and bucket of a hash of the id. Along the buckets of a source the running sum shows which bucket
holds the budget's threshold; only the rows of that bucket are summed again, by a finer part of the hash, and so on until
single hashes are left. A row is taken whole by comparing its hash with its source's threshold: no rows are sorted. Sources
whose target is above their size are taken whole first, and the threshold is found for what remains.

The hash is the first 60 bits of MD5 of the id's text, so reruns and other engines agree. Rows of one id share a decision.
The threshold is put on the side of the boundary row that comes nearer to the target.

Rows meet the numbers of their source without a shuffle by source, so a source that holds most rows is no hot key: the table of
sources, one row each, is broadcast if its counted bytes are at most BROADCAST, else the rows are salted over SALTS copies of it.

Edge cases: a null text has size 0; a text of any length is counted whole; a null source is a source of its own, last in order;
a null id hashes as the empty text; a source without words has target 0; an empty table gives no rows; columns beyond id, text
and source are not read by mix() and kept by mixed(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stimfuse.llm.common import WORD, free_name
from stimfuse.session import checkpointed

#: The hash has BITS bits; each histogram resolves STEP of them for the boundary bucket, before single hashes are compared.
BITS, STEP, LEVELS = 60, 10, 3
#: Bytes of source names, plus 64 for each source, up to which the table of sources is broadcast; copies of it beyond that.
BROADCAST, SALTS = 16 << 20, 64


def id_hash(col: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, key, size, h. The key orders sources by code point with null last."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col))).alias("key"),
        word_count(F.col(text_col)).alias("size"),
        id_hash(F.col(id_col)).alias("h"),
    )


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Per source: key, source_size, target. Sources in order of key weigh `weights`, repeating, and share `share` times all sizes;
    no target is above `most` times its source's size, and what is cut off is shared again by weight. Sorting the sources by
    the level at which they are full gives the level of the others in one pass. There is one row per source here, not per document."""
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    s = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("place", F.row_number().over(Window.orderBy("key")) - 1).withColumn("weight", w.cast("double")).withColumn("full", F.col("source_size") * most)
    order = Window.orderBy(F.col("full") / F.col("weight"), "key")
    s = s.withColumn("nth", F.row_number().over(order))
    before = F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * share
    s = s.withColumn("level", (total - before) / rest)
    held = F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct("nth", "level"))
    s = s.withColumn("level", F.min(held).over(Window.partitionBy())["level"])
    return s.select("key", "source_size", F.least(F.col("full"), F.col("level") * F.col("weight")).alias("target"))


def beside(rows: DataFrame, sources: DataFrame, key: str, spread: Column, small: bool) -> DataFrame:
    """rows joined to sources by `key` without gathering a source's rows in one task; spread: any well spread number of a row."""
    if small:
        return rows.join(F.broadcast(sources), key)
    salt = free_name("__salt", [*rows.columns, *sources.columns])
    salted = sources.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [key, salt]).drop(salt)


def fits(sources: DataFrame) -> bool:
    """Whether the table of sources may be broadcast, by its counted bytes."""
    return (sources.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0) <= BROADCAST


def thresholds(sizes: DataFrame, goals: DataFrame, small: bool) -> DataFrame:
    """Per source: key, source_size, target, whole (times that all rows are taken) and cut (rows with h <= cut are taken once more)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = goals.withColumn("whole", whole.cast("bigint")).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    state = state.withColumn("prefix", F.lit(0).cast("bigint")).withColumn("below", F.lit(0).cast("bigint"))
    for level in range(1, LEVELS + 2):
        shift = BITS - STEP * level if level <= LEVELS else 0
        up = BITS - STEP * (level - 1)
        inside = beside(sizes, state.select("key", "prefix", "below", "left"), "key", F.col("h"), small).filter(F.shiftright("h", up) == F.col("prefix"))
        hist = inside.groupBy("key", "below", "left", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("in_bucket"))
        along = Window.partitionBy("key").orderBy("bucket")
        hist = hist.withColumn("upto", F.col("below") + F.sum("in_bucket").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        if level <= LEVELS:
            found = hist.groupBy("key").agg(
                F.coalesce(F.min(F.when(F.col("upto") >= F.col("left"), F.struct("bucket", (F.col("upto") - F.col("in_bucket")).alias("low")))), F.max(F.struct("bucket", (F.col("upto") - F.col("in_bucket")).alias("low")))).alias("at")
            )
            state = state.drop("prefix", "below").join(found.select("key", F.col("at.bucket").alias("prefix"), F.col("at.low").alias("below")), "key")
            state = checkpointed(state)
        else:
            taken = F.when(2 * F.col("upto") - F.col("in_bucket") <= 2 * F.col("left"), F.col("bucket"))
            found = hist.groupBy("key").agg(F.max(taken).alias("cut"))
            none = F.col("prefix") * F.lit(1 << up) - 1
            state = state.join(found, "key").withColumn("cut", F.coalesce("cut", none))
    return state.select("key", "source_size", "target", "whole", "cut")


def _cuts(docs: DataFrame, weights: list[float], share: float, most: float, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, bool]:
    """(sizes, thresholds per source, whether these may be broadcast)."""
    sizes = checkpointed(sized(docs, id_col, text_col, source_col))
    goals = checkpointed(targets(sizes, weights, share, most))
    small = fits(goals)
    return sizes, checkpointed(thresholds(sizes, goals, small)), small


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, source key, size, source_size, target, copies (times the mix takes it), taken (copies * size)."""
    sizes, cuts, small = _cuts(docs, weights, share, most, id_col, text_col, source_col)
    copies = F.col("whole") + F.when(F.col("h") <= F.col("cut"), 1).otherwise(0)
    return beside(sizes, cuts, "key", F.col("h"), small).select(F.col("id").alias(id_col), "key", "h", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of docs, all columns, each as many times as the mix takes it, where they stand: texts aren't shuffled.
    A row without words has nothing to take and stays once."""
    _, cuts, small = _cuts(docs, weights, share, most, id_col, text_col, source_col)
    source, whole, cut, times = (free_name(n, docs.columns) for n in ("__source", "__whole", "__cut", "__copies"))
    cuts = cuts.select(F.col("key").alias(source), F.col("whole").alias(whole), F.col("cut").alias(cut))
    key = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))
    h = id_hash(F.col(id_col))
    copies = F.col(whole) + F.when(h <= F.col(cut), 1).otherwise(0)
    copies = F.when(word_count(F.col(text_col)) == 0, 1).otherwise(copies).cast("int")
    found = beside(docs.withColumn(source, key), cuts, source, F.struct(h, F.col(text_col)), small).withColumn(times, copies)
    return found.withColumn(times, F.explode(F.array_repeat(F.lit(0), F.col(times)))).select(docs.columns)


#: DuckDB form of op3: the same hash as hex text, running sums instead of histograms.
SQL = r"""
with d as (select doc_id, case when source is null then '1' else '0' || source end as key,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                  substr(md5(coalesce(doc_id::varchar, '')), 1, 15) as h from documents),
s0 as (select key, sum(size)::bigint as source_size from d group by key),
s1 as (select *, [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by key) - 1) % 3 + 1)::int] as weight, source_size * 2.0::double as full_at from s0),
s2 as (select *, row_number() over (order by full_at / weight, key) as nth from s1),
s3 as (select *, (sum(source_size) over () * 1.5::double - coalesce(sum(full_at) over (order by nth rows between unbounded preceding and 1 preceding), 0))
                 / sum(weight) over (order by nth rows between current row and unbounded following) as level from s2),
lv as (select arg_min(level, nth) as level from s3 where level * weight <= full_at),
s as (select key, source_size, least(full_at, lv.level * weight)::double as target,
             case when source_size > 0 then floor(least(full_at, lv.level * weight) / source_size)::bigint else 0 end as whole from s3, lv),
g as (select key, h, sum(size)::bigint as hs from d group by key, h),
c as (select g.key, g.h, 2 * sum(hs) over (partition by g.key order by g.h rows unbounded preceding) - hs <= 2 * (target - whole * source_size) as more
      from g join s using (key))
select d.doc_id, d.size, s.source_size, s.target, ((s.whole + case when c.more then 1 else 0 end) * d.size)::bigint as taken
from d join s on d.key = s.key join c on c.key = d.key and c.h = d.h
"""
