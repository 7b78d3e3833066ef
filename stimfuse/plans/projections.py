"""Queries on projections, masks, windows and sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stimfuse.operators import projections as op
from stimfuse.operators import windows as win
from stimfuse.plans import views as v
from stimfuse.plans.averages import R
from stimfuse.plans.views import VIEWS
from stimfuse.session import table


def _masked(s, d):
    return op.roi_quality_mask(v.score_map(s, d), v.roi_membership(s, d).filter("macro = 'ASIA'"), v.vertex_quality(s, d))


def _flags(s, d):
    return v.subject_curve(s, d).withColumn("flag", F.col("value") > 0)


def _bins(s, d):
    b = v.subject_curve(s, d).groupBy((F.col("t_idx") * 20).alias("start")).agg(F.max_by("subject", F.struct("value", -F.col("subject"))).alias("winner"))
    return b.filter("start % 100 <> 60").withColumn("winner", F.col("winner") % 2).withColumn("stop", F.col("start") + 20)


def _pvalues(s, d):
    """Tests in five families; one test in eleven has no p."""
    p = F.when(F.col("p_partkey") % 11 != 0, (F.col("p_partkey") * 7919) % 1000 / 1000.0)
    return table(s, d, "part").select((F.col("p_size") % 5).alias("family"), F.col("p_partkey").alias("test"), p.alias("p"))


def _labelled(s, d):
    """The curve's points by the time axis of the measurement."""
    axis = op.time_axis(s).select(F.col("t_idx").cast("int"), F.col("t_ms").alias("axis_ms"))
    return v.curve(s, d).join(F.broadcast(axis), "t_idx").groupBy("t_idx", "axis_ms").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("value"))


QUERIES = {
    "time_axis": _labelled,
    "crop_window": lambda s, d: v.curve(s, d).filter(F.col("t_ms").between(-60, 200)).groupBy("t_ms").agg(F.count("*").alias("n")),
    "post_stimulus_filter": lambda s, d: v.curve(s, d).filter("t_ms >= 0").groupBy("subject").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("value")),
    "snapshot_times": lambda s, d: v.score_map(s, d).filter(F.col("t_idx").isin(0, 2)).select("subject", "hemi", "t_idx", "vertex", R("score")),
    "drop_channels": lambda s, d: _first_channels(v.signal_trials(s, d), 3).groupBy("channel").agg(F.count("*").alias("n")),
    "rebase_ids": lambda s, d: v.response_trials(s, d).select((F.col("condition") + 1).alias("condition")).distinct(),
    "roi_quality_mask": lambda s, d: _masked(s, d).select("subject", "hemi", "t_idx", "vertex", R("score")),
    "quality_filter": lambda s, d: v.score_map(s, d).join(v.vertex_quality(s, d).filter("ncsnr >= 0.2"), "vertex").groupBy("vertex").agg(F.round(F.avg("score"), 6).alias("score"), F.round(F.max("ncsnr"), 6).alias("ncsnr")),
    "quality_nan_mask": lambda s, d: op.quality_nan_mask(v.score_map(s, d), v.vertex_quality(s, d)).select("subject", "hemi", "t_idx", "vertex", R("score")),
    "zero_fill_unselected": lambda s, d: op.zero_fill_unselected(_masked(s, d), v.score_map(s, d).select("subject", "hemi", "t_idx", "vertex"), ["subject", "hemi", "t_idx", "vertex"]).select("subject", "hemi", "t_idx", "vertex", R("score")),
    "vertex_block": lambda s, d: v.score_map(s, d).groupBy(op.vertex_block(F.col("vertex"), 8).alias("block")).agg(F.count("*").alias("n"), F.min("vertex").alias("first"), F.max("vertex").alias("last")),
    "nan_to_zero": lambda s, d: v.score_map(s, d).withColumn("score", F.when(F.col("vertex") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("score"))).select("subject", "hemi", "t_idx", "vertex", F.round(F.coalesce(F.nanvl("score", F.lit(None)), F.lit(0.0)), 6).alias("score")),
    "scale_units": lambda s, d: v.response_trials(s, d).select("trial", "line", F.round(F.col("value") / 300, 6).alias("volume"), F.round(F.col("value") * 1000, 3).alias("variance")),
    "clip_values": lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(op.clip_rdm_values(F.col("l_tax") * 40 - 1, "cosine"), 6).alias("cosine"), F.round(op.clip_rdm_values(F.col("l_tax") * 40 - 1, "correlation"), 6).alias("correlation")),
    "gamma_encode": lambda s, d: table(s, d, "part").select("p_partkey", op.gamma_encode(F.array(F.col("p_size"), F.col("p_size") * 5, F.lit(255))).alias("px")),
    "concat_features": lambda s, d: v.features(s, d).select("condition", F.concat(F.slice("embedding", 1, 4), F.slice("embedding", 33, 4)).alias("x")).select("condition", F.transform("x", lambda x: F.round(x.cast("double"), 6)).alias("x")),
    "drop_degenerate": lambda s, d: v.roi_membership(s, d).join(v.vertex_quality(s, d).filter("ncsnr >= 0.5"), "vertex", "left").groupBy("roi").agg(F.count("ncsnr").alias("n")).filter("n > 0"),
    "subsample_conditions": lambda s, d: op.subsample_conditions(v.response_trials(s, d), 100, 8),
    "keep_n_repeats": lambda s, d: op.keep_n_repeats(v.response_trials(s, d), 30).select("condition").distinct(),
    "param_grid": lambda s, d: v.response_trials(s, d).select("subject").distinct().crossJoin(F.broadcast(v.response_trials(s, d).select("hemi").distinct())).crossJoin(F.broadcast(s.range(1, 4).select(F.col("id").alias("split")))),
    "expect_shape": lambda s, d: op.expect_pairs(_pairs(s, d), ["label"]),
    "infer_axis_roles": lambda s, d: op.infer_axis_roles(v.score_map(s, d).select("subject", "hemi", "t_idx"), {"subjects": 6, "halves": 2, "times": 4, "shuffles": 99}),
    "session_zscore": lambda s, d: win.zscore(v.signal_trials(s, d), ["session", "channel"]).select("trial", R("z")),
    "session_zscore_responses": lambda s, d: win.zscore(v.response_trials(s, d), ["subject", "hemi", "vertex"]).select("trial", "line", R("z")),
    "zscore_eps": lambda s, d: win.zscore(v.response_trials(s, d), ["vertex"], "value", 1e-8).select("trial", "line", R("z")),
    "average_rank": lambda s, d: win.ranked_at_scale(v.response_trials(s, d), ["subject"], "a").select("trial", "line", F.col("rank").cast("double").alias("rank")),
    "cluster_label": lambda s, d: win.cluster_label(_flags(s, d), ["subject"], "t_idx", "flag").select("subject", "t_idx", "cluster"),
    "merge_adjacent_windows": lambda s, d: win.merge_adjacent_windows(_bins(s, d), [], "start", "stop", "winner").select("winner", "start", "stop"),
    "bh_adjust": lambda s, d: win.bh_adjust(_pvalues(s, d), ["family"]).select("family", "test", R("p_adjusted")),
    "bonferroni": lambda s, d: win.bonferroni(_pvalues(s, d), ["family"]).select("family", "test", R("p_adjusted"), "significant"),
    "session_position": lambda s, d: win.positions(v.signal_trials(s, d), ["session"], ["ts", "trial"]).select("session", "trial", F.col("place").cast("int").alias("position")),
    "sort_ids": lambda s, d: v.response_trials(s, d).select("condition").distinct().orderBy("condition"),
    "arg_max": lambda s, d: v.subject_curve(s, d).groupBy("subject").agg(F.max_by("t_idx", F.struct("value", -F.col("t_idx"))).alias("t_idx")),
}


def _first_channels(rows, n):
    """Rows of the first n channels of each session: channels are put in order, not trials."""
    place = F.dense_rank().over(Window.partitionBy("session").orderBy("channel"))
    wanted = rows.select("session", "channel").distinct().withColumn("place", place).filter(F.col("place") <= n)
    return win.beside(rows, wanted, ["session", "channel"])


def _pairs(s, d):
    f = v.features(s, d).select("condition", "label")
    return f.alias("a").join(f.alias("b"), F.expr("a.label = b.label and a.condition < b.condition")).select("a.label", F.col("a.condition").alias("i"), F.col("b.condition").alias("j"))


MASKED = "masked as (select * from score_map where vertex in (select vertex from roi_membership where macro = 'ASIA') and vertex in (select vertex from vertex_quality where ncsnr >= 0.2))"
P = "pv as (select (p_size % 5)::int as family, p_partkey as test, case when p_partkey % 11 <> 0 then (p_partkey * 7919) % 1000 / 1000.0::double end as p from part)"
SQL = {
    "time_axis": VIEWS + ", ax as (select (row_number() over (order by i) - 1)::int as t_idx, t_ms as axis_ms from (select range as i, round_even(-200 + range * 1200 / 614.0::double, 0)::int - 50 as t_ms from range(615)) where t_ms between -100 and 600) select t_idx, axis_ms, count(*) as n, round(avg(value), 6) as value from curve join ax using (t_idx) group by all",
    "crop_window": VIEWS + "select t_ms, count(*) as n from curve where t_ms between -60 and 200 group by all",
    "post_stimulus_filter": VIEWS + "select subject, count(*) as n, round(avg(value), 6) as value from curve where t_ms >= 0 group by all",
    "snapshot_times": VIEWS + "select subject, hemi, t_idx, vertex, round(score, 6) as score from score_map where t_idx in (0, 2)",
    "drop_channels": VIEWS + "select channel, count(*) as n from (select *, dense_rank() over (partition by session order by channel) as place from signal_trials) where place <= 3 group by all",
    "rebase_ids": VIEWS + "select distinct condition + 1 as condition from response_trials",
    "roi_quality_mask": VIEWS + f", {MASKED} select subject, hemi, t_idx, vertex, round(score, 6) as score from masked",
    "quality_filter": VIEWS + "select vertex, round(avg(score), 6) as score, round(max(ncsnr), 6) as ncsnr from score_map join vertex_quality using (vertex) where ncsnr >= 0.2 group by all",
    "quality_nan_mask": VIEWS + "select subject, hemi, t_idx, vertex, round(case when ncsnr >= 0.2 then score else 'nan'::double end, 6) as score from score_map left join vertex_quality using (vertex)",
    "zero_fill_unselected": VIEWS + f", {MASKED} select subject, hemi, t_idx, vertex, round(coalesce(m.score, 0), 6) as score from score_map g left join masked m using (subject, hemi, t_idx, vertex)",
    "vertex_block": VIEWS + "select (floor(vertex / 8.0) + 1)::int as block, count(*) as n, min(vertex) as first, max(vertex) as last from score_map group by all",
    "nan_to_zero": VIEWS + "select subject, hemi, t_idx, vertex, round(case when vertex % 3 = 0 then 0 else score end, 6) as score from score_map",
    "scale_units": VIEWS + "select trial, line, round(value / 300, 6) as volume, round(value * 1000, 3) as variance from response_trials",
    "clip_values": "select l_orderkey, l_linenumber, round(least(greatest(l_tax * 40 - 1, 0), 1), 6) as cosine, round(least(greatest(l_tax * 40 - 1, 0), 2), 6) as correlation from lineitem",
    "gamma_encode": "select p_partkey, [trunc(sqrt(p_size / 255.0::double) * 255)::int, trunc(sqrt(p_size * 5 / 255.0::double) * 255)::int, 255] as px from part",
    "concat_features": VIEWS + "select condition, list_transform(list_concat(embedding[1:4], embedding[33:36]), lambda x: round(x::double, 6) + 0.0::double) as x from features",
    "drop_degenerate": VIEWS + "select roi, count(*) as n from roi_membership join vertex_quality using (vertex) where ncsnr >= 0.5 group by all",
    "subsample_conditions": VIEWS + "select condition from (select distinct condition from response_trials) order by md5('8:' || condition::varchar), condition limit 100",
    "keep_n_repeats": VIEWS + "select condition from response_trials group by condition having count(*) = 30",
    "param_grid": VIEWS + "select * from (select distinct subject from response_trials), (select distinct hemi from response_trials), (select range as split from range(1, 4))",
    "expect_shape": VIEWS + "select a.label, count(*) as pairs, round((1 + sqrt(1 + 8 * count(*))) / 2)::bigint as stimuli, true as complete from features a join features b on a.label = b.label and a.condition < b.condition group by all",
    "infer_axis_roles": "select * from (values ('subjects', 'subject'), ('halves', 'hemi'), ('times', 't_idx'), ('shuffles', null)) t(role, \"column\")",
    "session_zscore": VIEWS + "select trial, round((value - avg(value) over w) / stddev_pop(value) over w, 6) as z from signal_trials window w as (partition by session, channel)",
    "session_zscore_responses": VIEWS + "select trial, line, round((value - avg(value) over w) / stddev_pop(value) over w, 6) as z from response_trials window w as (partition by subject, hemi, vertex)",
    "zscore_eps": VIEWS + "select trial, line, round((value - avg(value) over w) / (stddev_pop(value) over w + 1e-8), 6) as z from response_trials window w as (partition by vertex)",
    "average_rank": VIEWS + "select trial, line, (rank() over (partition by subject order by a) + (count(*) over (partition by subject, a) - 1) / 2)::double as rank from response_trials",
    "cluster_label": VIEWS + "select subject, t_idx, case when flag then (sum(opens) over (partition by subject order by t_idx rows unbounded preceding))::int end as cluster from (select *, case when flag and not coalesce(lag(flag) over (partition by subject order by t_idx), false) then 1 else 0 end as opens from (select *, value > 0 as flag from subject_curve))",
    "merge_adjacent_windows": VIEWS + """, b as (select start, winner % 2 as winner, start + 20 as stop from (select t_idx * 20 as start, arg_max(subject, value * 1000 - subject / 1e9) as winner from subject_curve group by all) where start % 100 <> 60),
        r as (select *, sum(n) over (order by start rows unbounded preceding) as run from (select *, case when lag(winner) over (order by start) = winner and lag(stop) over (order by start) = start then 0 else 1 end as n from b))
        select winner, min(start) as start, max(stop) as stop from r group by winner, run""",
    "bh_adjust": f"with {P}, r as (select *, row_number() over (partition by family order by p nulls last) as r, count(p) over (partition by family) as n from pv) select family, test, case when p is not null then round(least(min(p * n / r) over (partition by family order by r desc rows unbounded preceding), 1), 6) end as p_adjusted from r",
    "bonferroni": f"with {P} select family, test, case when p is not null then round(least(p * count(p) over (partition by family), 1), 6) end as p_adjusted, case when p is not null then least(p * count(p) over (partition by family), 1) < 0.05 end as significant from pv",
    "session_position": VIEWS + "select session, trial, row_number() over (partition by session order by ts, trial)::int as position from signal_trials",
    "sort_ids": VIEWS + "select distinct condition from response_trials",
    "arg_max": VIEWS + "select subject, t_idx from (select *, row_number() over (partition by subject order by value desc, t_idx) as r from subject_curve) where r = 1",
}
