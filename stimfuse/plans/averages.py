"""Queries on averages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stimfuse.operators import averages as op
from stimfuse.plans import views as v
from stimfuse.plans.views import VIEWS
from stimfuse.session import table

R = lambda c, n=6: F.round(c, n).alias(c)
ORDER = ["ts", "trial"]


def _nan_trials(s, d):
    return v.response_trials(s, d).withColumn("value", F.when(F.col("line") == 1, F.lit(float("nan"))).otherwise(F.col("value")))


#: First elements of the layers' vectors.
LAYERS = {"early": 9, "middle": 17, "deep": 25}


def _layer_bundle(s, d):
    """Mean vectors of three layers per class, in a map by layer; read again by key."""
    layers = F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), F.slice("embedding", first, 8).alias("x")) for n, first in LAYERS.items()])).alias("at")
    rows = v.features(s, d).select("label", layers).select("label", "at.layer", "at.x")
    made = op.keyed_bundle(op.mean_vector(rows, ["label", "layer"], "x"), ["label"], "layer", "x")
    rounded = lambda c: F.transform(c, lambda e: F.round(e, 6))
    return made.select("label", F.map_keys("bundle").alias("layers"), rounded(F.col("bundle")["deep"]).alias("deep"), rounded(F.col("bundle")["early"]).alias("early"), F.col("bundle")["none"].isNull().alias("no_other"))


QUERIES = {
    "layer_bundle": _layer_bundle,
    "repeat_mean": lambda s, d: op.repeat_mean(v.signal_trials(s, d), ["condition", "channel"]).select("condition", "channel", R("value")),
    "repeat_nanmean": lambda s, d: op.repeat_nanmean(_nan_trials(s, d), ["condition", "vertex"]).select("condition", "vertex", R("value")),
    "condition_average": lambda s, d: op.condition_average(v.signal_trials(s, d), v.response_trials(s, d).select("condition").distinct(), ["channel"]).select("condition", "channel", R("value")),
    "half_repeat_mean": lambda s, d: op.half_repeat_mean(v.signal_trials(s, d), ["condition", "channel"], ORDER).select("condition", "channel", "half", R("value")),
    "pseudo_trials": lambda s, d: op.pseudo_trials(v.signal_trials(s, d), ["condition", "channel"], ORDER, 3).select("condition", "channel", "pseudo", R("value")),
    "repeat_number": lambda s, d: op.repeat_number(v.signal_trials(s, d), ["condition", "channel"], ORDER).select("condition", "channel", "trial", "repeat"),
    "caption_mean_embedding": lambda s, d: op.mean_vector(_captions(s, d), ["image"], "embedding").select("image", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding")),
    "roi_timecourse": lambda s, d: op.roi_timecourse(v.score_map(s, d), v.roi_membership(s, d).select("vertex", "roi"), ["subject", "t_idx"]).select("roi", "subject", "t_idx", R("score")),
    "roi_nanmean": lambda s, d: op.roi_nanmean(_nan_map(s, d), v.roi_membership(s, d).select("vertex", "roi"), _grid(s, d), ["subject"]).select("roi", "subject", R("score")),
    "group_mean_map": lambda s, d: op.group_mean_map(v.score_map(s, d), ["hemi", "t_idx", "vertex"]).select("hemi", "t_idx", "vertex", R("score")),
    "global_max": lambda s, d: op.group_mean_map(v.score_map(s, d), ["hemi", "t_idx", "vertex"]).groupBy("t_idx").agg(F.round(F.max("score"), 6).alias("top")),
    "mean_ci95": lambda s, d: op.mean_ci95(v.subject_curve(s, d), ["t_idx"], 6).select("t_idx", R("mean"), R("low"), R("high")),
    "post_stimulus_summary": lambda s, d: op.two_level_summary(v.curve(s, d).filter("t_ms >= 0"), ["subject"], []).select(R("mean"), R("sd"), "n"),
    "overall_reliability_summary": lambda s, d: op.two_level_summary(_nan_map(s, d), ["subject"], ["hemi"], "score").select("hemi", R("mean"), R("sd"), "n"),
    "roi_noise_ceiling": lambda s, d: op.roi_noise_ceiling(v.roi_membership(s, d), v.vertex_quality(s, d)).select("macro", R("ceiling")),
    "valid_vertex_count": lambda s, d: v.vertex_quality(s, d).agg(F.count_if(F.col("ncsnr") >= 0.2).alias("kept"), F.count("*").alias("total")),
    "box_summary": lambda s, d: op.box_summary(v.response_trials(s, d), ["subject", "hemi"]).select("subject", "hemi", *map(R, ("q1", "median", "q3", "low", "high"))),
    "distinct_conditions": lambda s, d: v.response_trials(s, d).select("condition").distinct().orderBy("condition"),
}


def _captions(s, d):
    """Captions of an image: turns of a conversation, each with a vector of `embeddings`, over all of these."""
    n = table(s, d, "embeddings").agg(F.count("*").alias("n"))
    c = table(s, d, "conversations").crossJoin(F.broadcast(n)).select(F.col("conv_id").alias("image"), ((7 * F.col("conv_id") + F.col("turn")) % F.col("n")).alias("vec_id"))
    return c.join(table(s, d, "embeddings").select("vec_id", "embedding"), "vec_id")


def _nan_map(s, d):
    return v.score_map(s, d).withColumn("score", F.when(F.col("vertex") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("score")))


def _grid(s, d):
    return v.roi_membership(s, d).select("roi").distinct().crossJoin(F.broadcast(s.range(6).select(F.col("id").cast("int").alias("subject"))))


NAN = "nan_map as (select * replace (case when vertex % 3 = 0 then 'nan'::double else score end as score) from score_map)"
SQL = {
    "layer_bundle": VIEWS + """, x as (select label, range as pos, avg(embedding[25 + range]::double) as deep, avg(embedding[9 + range]::double) as early from features, range(8) group by all)
        select label, ['deep', 'early', 'middle'] as layers, list(round(deep, 6) order by pos) as deep, list(round(early, 6) order by pos) as early, true as no_other from x group by label""",
    "repeat_mean": VIEWS + "select condition, channel, round(avg(value), 6) as value from signal_trials group by all",
    "repeat_nanmean": VIEWS + "select condition, vertex, round(coalesce(avg(case when line <> 1 then value end), 0), 6) as value from response_trials group by all",
    "condition_average": VIEWS + "select w.condition, channel, round(avg(value), 6) as value from (select distinct condition from response_trials) w left join signal_trials using (condition) group by all",
    "half_repeat_mean": VIEWS + "select condition, channel, ((r - 1) % 2)::int as half, round(avg(value), 6) as value from (select *, row_number() over (partition by condition, channel order by ts, trial) as r from signal_trials) group by all",
    "pseudo_trials": VIEWS + "select condition, channel, floor((r - 1) / (n / 3))::int as pseudo, round(avg(value), 6) as value from (select *, row_number() over (partition by condition, channel order by ts, trial) as r, count(*) over (partition by condition, channel) as n from signal_trials) where n % 3 = 0 group by all",
    "repeat_number": VIEWS + "select condition, channel, trial, row_number() over (partition by condition, channel order by ts, trial)::int as repeat from signal_trials",
    "caption_mean_embedding": """with c as (select conv_id as image, (7 * conv_id + turn) % (select count(*) from embeddings) as vec_id from conversations),
        x as (select image, unnest(range(1, 65)) as pos, embedding from c join embeddings using (vec_id)),
        m as (select image, pos, round(avg(embedding[pos]::double), 6) + 0.0::double as x from x group by all)
        select image, list(x order by pos) as embedding from m group by image""",
    "roi_timecourse": VIEWS + "select roi, subject, t_idx, round(avg(score), 6) as score from score_map join roi_membership using (vertex) group by all",
    "roi_nanmean": VIEWS + f", {NAN} select g.roi, g.subject, round(coalesce(x.score, 'nan'::double), 6) as score from (select distinct roi, range::int as subject from roi_membership, range(6)) g left join (select roi, subject, avg(score) as score from nan_map join roi_membership using (vertex) where not isnan(score) group by all) x using (roi, subject)",
    "group_mean_map": VIEWS + "select hemi, t_idx, vertex, round(avg(score), 6) as score from score_map group by all",
    "global_max": VIEWS + "select t_idx, round(max(score), 6) as top from (select hemi, t_idx, vertex, avg(score) as score from score_map group by all) group by all",
    "mean_ci95": VIEWS + "select t_idx, round(avg(value), 6) as mean, round(avg(value) - 2.5705818356363 * stddev_samp(value) / sqrt(count(*)), 6) as low, round(avg(value) + 2.5705818356363 * stddev_samp(value) / sqrt(count(*)), 6) as high from subject_curve group by all",
    "post_stimulus_summary": VIEWS + "select round(avg(m), 6) as mean, round(stddev_samp(m), 6) as sd, count(*) as n from (select subject, avg(value) as m from curve where t_ms >= 0 group by all)",
    "overall_reliability_summary": VIEWS + f", {NAN} select hemi, round(avg(m), 6) as mean, round(stddev_samp(m), 6) as sd, count(m) as n from (select hemi, subject, avg(score) as m from nan_map where not isnan(score) group by all) group by all",
    "roi_noise_ceiling": VIEWS + "select macro, round(avg(sqrt(greatest(ncsnr, 0))), 6) as ceiling from roi_membership join vertex_quality using (vertex) group by all",
    "valid_vertex_count": VIEWS + "select count(*) filter (where ncsnr >= 0.2) as kept, count(*) as total from vertex_quality",
    "box_summary": VIEWS + """, q as (select subject, hemi, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from response_trials group by all)
        select subject, hemi, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, round(min(value) filter (where value >= q1 - 1.5 * (q3 - q1) and value <= q3 + 1.5 * (q3 - q1)), 6) as low,
        round(max(value) filter (where value >= q1 - 1.5 * (q3 - q1) and value <= q3 + 1.5 * (q3 - q1)), 6) as high from response_trials join q using (subject, hemi) group by all""",
    "distinct_conditions": VIEWS + "select distinct condition from response_trials",
}
