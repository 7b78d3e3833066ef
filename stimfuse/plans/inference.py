"""Queries on inference, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stimfuse.operators import inference as op
from stimfuse.operators.windows import merge_adjacent_windows
from stimfuse.plans import views as v
from stimfuse.plans.averages import R
from stimfuse.plans.views import VIEWS
from stimfuse.session import table

BOOT = 200


def _axis(s, d):
    return v.curve(s, d).select("t_idx", "t_ms").distinct()


def _r_values(s, d):
    """Values in (-1, 1) per (t_idx, subject), of changing sign."""
    return v.subject_curve(s, d).withColumn("value", F.col("value") / 60)


def _models(s, d):
    """Curves of three models: events of three types."""
    e = v.signal_trials(s, d).filter("channel in ('click', 'view', 'purchase', 'search', 'login', 'logout')")
    return e.select(F.col("channel").alias("model"), (F.col("condition") % 6).cast("int").alias("subject"), F.hour("ts").alias("t_idx"), (20 * F.hour("ts") - 100).alias("t_ms"), "value")


def _model_stats(s, d):
    m = _models(s, d).groupBy("model", "t_ms").agg(F.avg("value").alias("mean"))
    return m.withColumn("significant", F.col("mean") > 47)


def _pair(s, d):
    c = v.curve(s, d)
    even = c.filter("t_idx % 2 = 0").groupBy("subject", (F.col("t_idx") % 4).alias("g")).agg(F.avg("value").alias("value"))
    odd = c.filter("t_idx % 2 = 1").groupBy("subject", ((F.col("t_idx") - 1) % 4).alias("g")).agg(F.avg("value").alias("value"))
    return even, odd


def _two_analyses(s, d):
    """Curves of the second and of the first half of the day, per subject."""
    a = v.curve(s, d).withColumn("half", F.col("t_idx") >= 12).groupBy("subject", (F.col("t_idx") % 12).alias("t_idx"), "half").agg(F.avg("value").alias("value"))
    return a.filter("half").drop("half"), a.filter("not half").drop("half")


def _part_curves(s, d):
    """Curves of the models in three parts of the day's hours, less the mean of all, one value per subject and time."""
    m = _models(s, d)
    grand = m.agg(F.avg("value").alias("grand"))
    c = m.groupBy((F.col("t_idx") % 3).alias("part"), "model", "subject", "t_idx", "t_ms").agg(F.avg("value").alias("value"))
    return c.crossJoin(F.broadcast(grand)).withColumn("value", F.round(F.col("value") - F.col("grand"), 9)).drop("grand").withColumn("t_idx", F.floor(F.col("t_idx") / 3).cast("int"))


def _report(s, d):
    found = op.best_model_report(_part_curves(s, d), ["part"], op.sign_draws(s, 6), op.bootstrap_draws(s, BOOT, 6), "model", 0, 0.2, 0.5)
    return found.select("part", "model", R("m"), "peak_ms", R("low"), R("high"), "significant_at")


QUERIES = {
    "fisher_z": lambda s, d: _r_values(s, d).select("subject", "t_idx", F.round(op.fisher_z(F.col("value")), 6).alias("z")),
    "ttest_1samp": lambda s, d: op.ttest_1samp(v.subject_curve(s, d), ["t_idx"]).select("t_idx", R("t"), R("p")),
    "significance_mask": lambda s, d: op.significance_mask(_r_values(s, d), ["t_idx"], 0.2).select("t_idx", R("p_adjusted"), "significant"),
    "significance_mask_raw": lambda s, d: op.significance_mask(_r_values(s, d), ["t_idx"], 0.2, "bonferroni", raw=True).select("t_idx", R("p_adjusted"), "significant"),
    "ttest_paired": lambda s, d: op.ttest_paired(*_pair(s, d), ["subject"], ["g"]).select("g", "n", R("t"), R("p")),
    "generate_sign_draws": lambda s, d: op.sign_draws(s, v.curve(s, d)),
    "generate_bootstrap_draws": lambda s, d: op.bootstrap_draws(s, BOOT, v.curve(s, d)),
    "generate_split_labels": lambda s, d: op.split_labels(v.features(s, d).select("condition"), 4, 8),
    "generate_train_halves": lambda s, d: op.split_labels(v.response_trials(s, d).select("condition").distinct(), 2, 9).groupBy("shuffle", "half").agg(F.count("*").alias("n"), F.sum("condition").alias("ids")),
    "sign_flip_null": lambda s, d: op.sign_flip_null(v.subject_curve(s, d), op.sign_draws(s, 6)).select("draw", "t_idx", R("m")),
    "pooled_thresholds": lambda s, d: op.pooled_thresholds(op.sign_flip_null(v.subject_curve(s, d), op.sign_draws(s, 6)), 0.2).select(R("low"), R("high")),
    "cluster_permutation_test": lambda s, d: op.cluster_permutation_test(v.subject_curve(s, d), op.sign_draws(s, 6), 0.2, 0.2).select("cluster", "first", "last", R("sum"), R("p"), "significant"),
    "cluster_difference_test": lambda s, d: op.cluster_difference_test(*_two_analyses(s, d), op.sign_draws(s, 6), 0.2, 0.2).select("cluster", "first", "last", R("sum"), R("p"), "significant"),
    "significance_windows": lambda s, d: op.significance_windows(op.cluster_permutation_test(v.subject_curve(s, d), op.sign_draws(s, 6), 0.2, 0.9), _axis(s, d)),
    "mean_onset": lambda s, d: op.cluster_permutation_test(v.subject_curve(s, d), op.sign_draws(s, 6), 0.2, 0.9).filter("significant").agg(F.avg("first").cast("int").alias("onset")),
    "subject_onsets": lambda s, d: op.subject_onsets(v.subject_curve(s, d), 2.0),
    "peak_latency": lambda s, d: op.peak_latency(v.subject_curve(s, d).groupBy("t_ms").agg(F.avg("value").alias("m")), []),
    "bootstrap_peak_ci": lambda s, d: op.percentile_ci(op.peak_latency(op.bootstrap_curves(v.subject_curve(s, d), op.bootstrap_draws(s, BOOT, 6)), ["draw"]), [], "peak_ms").select(R("low"), R("high")),
    "bootstrap_curve_ci": lambda s, d: op.percentile_ci(op.bootstrap_curves(v.subject_curve(s, d), op.bootstrap_draws(s, BOOT, 6)), ["t_ms"], "m").select("t_ms", R("low"), R("high")),
    "resample_cross_join": lambda s, d: v.subject_curve(s, d).join(F.broadcast(op.bootstrap_draws(s, 50, 6)), "subject").groupBy("draw").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")),
    "best_model": lambda s, d: op.best_model(_models(s, d).filter("t_ms >= 0").withColumn("part", F.col("t_idx") % 3), ["part"], "model").select("part", "model", R("m")),
    "best_model_report": _report,
    "best_model_per_bin": lambda s, d: op.best_model_per_bin(_model_stats(s, d), 40),
    "bin_range_join": lambda s, d: _bins(s, d).select("t_ms", "start"),
    "model_windows": lambda s, d: merge_adjacent_windows(op.best_model_per_bin(_model_stats(s, d), 40), [], "start", "stop", "winner"),
}


def _bins(s, d):
    t0 = v.curve(s, d).filter("value > 99").agg(F.min("t_ms").alias("t0"))
    return _axis(s, d).crossJoin(F.broadcast(t0)).filter("t_ms >= t0").withColumn("start", (F.col("t0") + F.floor((F.col("t_ms") - F.col("t0")) / 60) * 60).cast("int"))


T5 = "1 - 2 / pi() * (atan(abs(t) / sqrt(5)) + sin(atan(abs(t) / sqrt(5))) * (cos(atan(abs(t) / sqrt(5))) + 2.0 / 3 * cos(atan(abs(t) / sqrt(5))) ** 3))"
TT = "tt as (select t_idx, avg(value) * sqrt(count(*)) / stddev_samp(value) as t from {0} group by all), pp as (select t_idx, t, " + T5 + " as p from tt)"
RV = "rv as (select subject, t_idx, value / 60 as value from subject_curve), zv as (select subject, t_idx, atanh(greatest(least(value, 0.9999), -0.9999)) as value from rv)"
DR = "draws as (select d.range as draw, s.range::int as subject, (1 - 2 * ((d.range >> s.range::int) & 1))::int as sign from range(64) d, range(6) s)"
BD = "boot as (select d.range as draw, s.range::int as slot, ((d.range * 7919 + s.range * 104729 + d.range * s.range * 31) % 1000003 % 6)::int as subject from range({0}) d, range(6) s)"
NULL = DR + ", nul as (select draw, t_idx, avg(value * sign) as m from {0} join draws using (subject) group by all), lim as (select quantile_cont(m, 0.1) as low, quantile_cont(m, 0.9) as high from nul)"
CL = NULL + """, mm as (select -1 as draw, t_idx, avg(value) as m from {0} group by all union all select draw, t_idx, m from nul),
fl as (select draw, t_idx, m, m > high or m < low as flag from mm, lim),
op as (select *, case when flag and not coalesce(lag(flag) over (partition by draw order by t_idx), false) then 1 else 0 end as o from fl),
cl as (select *, sum(o) over (partition by draw order by t_idx rows unbounded preceding)::int as cluster from op),
cs as (select draw, cluster, min(t_idx) as first, max(t_idx) as last, sum(m) as s from cl where flag group by all),
tops as (select d.range as draw, coalesce((select max(s) from cs where cs.draw = d.range), 0) as top from range(64) d),
res as (select cluster, first, last, s as sum, ((select count(*) from tops where top >= abs(s)) + 1) / 65.0::double as p from cs where draw = -1)"""
DIFF = "df as (select subject, (t_idx % 12)::int as t_idx, avg(value) filter (where t_idx >= 12) - avg(value) filter (where t_idx < 12) as value from curve group by subject, t_idx % 12)"
MS = "md as (select channel as model, (condition % 6)::int as subject, hour(ts)::int as t_idx, (20 * hour(ts) - 100)::int as t_ms, value from signal_trials where channel in ('click', 'view', 'purchase', 'search', 'login', 'logout')), ms as (select model, t_ms, avg(value) as mean, avg(value) > 47 as significant from md group by all)"
BM = MS + """, ed as (select min(t_ms) filter (where significant) as t0, max(t_ms) as tl from ms),
bn as (select (t0 + floor((t_ms - t0) / 40.0) * 40)::int as start, model, bool_and(significant) as whole, avg(mean) as m from ms, ed where t_ms >= t0 and (t0 + floor((t_ms - t0) / 40.0) * 40) < tl group by all),
bb as (select start, start + 40 as stop, model as winner from (select *, row_number() over (partition by start order by m desc, model) as r from bn where whole) where r = 1)"""
SPL = "(select *, row_number() over (partition by shuffle order by md5('{1}:' || shuffle || ':' || condition), condition) as r, count(*) over (partition by shuffle) as n from (select condition, range::int as shuffle from {0}, range({2})))"
SQL = {
    "fisher_z": VIEWS + f", {RV} select subject, t_idx, round(value, 6) as z from zv",
    "ttest_1samp": VIEWS + ", " + TT.format("subject_curve") + " select t_idx, round(t, 6) as t, round(p, 6) as p from pp",
    "significance_mask": VIEWS + f", {RV}, {TT.format('zv')}, r as (select *, row_number() over (order by p) as r, count(*) over () as n from pp), a as (select t_idx, least(min(p * n / r) over (order by r desc rows unbounded preceding), 1) as q from r) select t_idx, round(q, 6) as p_adjusted, q < 0.2 as significant from a",
    "significance_mask_raw": VIEWS + f", {RV}, {TT.format('rv')} select t_idx, round(least(p * count(*) over (), 1), 6) as p_adjusted, least(p * count(*) over (), 1) < 0.2 as significant from pp",
    "ttest_paired": VIEWS + f", a as (select subject, (t_idx % 4)::int as g, avg(value) as x from curve where t_idx % 2 = 0 group by all), b as (select subject, ((t_idx - 1) % 4)::int as g, avg(value) as y from curve where t_idx % 2 = 1 group by all), tt as (select g, count(*) as n, avg(x - y) * sqrt(count(*)) / stddev_samp(x - y) as t from a join b using (subject, g) group by all) select g, n, round(t, 6) as t, round({T5}, 6) as p from tt",
    "generate_sign_draws": f"with {DR} select draw, subject, sign from draws",
    "generate_bootstrap_draws": f"with {BD.format(BOOT)} select draw, slot, subject from boot",
    "generate_split_labels": VIEWS + f"select shuffle, condition, case when r <= floor(n / 2) then 0 else 1 end as half from {SPL.format('features', 8, 4)}",
    "generate_train_halves": VIEWS + f"select shuffle, case when r <= floor(n / 2) then 0 else 1 end as half, count(*) as n, sum(condition)::bigint as ids from {SPL.format('(select distinct condition from response_trials)', 9, 2)} group by all",
    "sign_flip_null": VIEWS + f", {NULL.format('subject_curve')} select draw, t_idx, round(m, 6) as m from nul",
    "pooled_thresholds": VIEWS + f", {NULL.format('subject_curve')} select round(low, 6) as low, round(high, 6) as high from lim",
    "cluster_permutation_test": VIEWS + f", {CL.format('subject_curve')} select cluster, first, last, round(sum, 6) as sum, round(p, 6) as p, p < 0.2 as significant from res",
    "cluster_difference_test": VIEWS + f", {DIFF}, {CL.format('df')} select cluster, first, last, round(sum, 6) as sum, round(p, 6) as p, p < 0.2 as significant from res",
    "significance_windows": VIEWS + f", {CL.format('subject_curve')}, w as (select cluster, 20 * first - 100 as start_ms, 20 * last - 100 as stop_ms from res where p < 0.9) select * from w union all select 0, min(start_ms), max(stop_ms) from w",
    "mean_onset": VIEWS + f", {CL.format('subject_curve')} select trunc(avg(first))::int as onset from res where p < 0.9",
    "subject_onsets": VIEWS + "select subject, min(t_idx) filter (where value > 2.0) as onset from subject_curve group by all",
    "peak_latency": VIEWS + "select t_ms as peak_ms from (select t_ms, avg(value) as m from subject_curve group by all) order by m desc, t_ms limit 1",
    "bootstrap_peak_ci": VIEWS + f", {BD.format(BOOT)}, m as (select draw, t_ms, avg(value) as m from boot join subject_curve using (subject) group by all), p as (select draw, t_ms from (select *, row_number() over (partition by draw order by m desc, t_ms) as r from m) where r = 1) select round(quantile_cont(t_ms, 0.025), 6) as low, round(quantile_cont(t_ms, 0.975), 6) as high from p",
    "bootstrap_curve_ci": VIEWS + f", {BD.format(BOOT)}, m as (select draw, t_ms, avg(value) as m from boot join subject_curve using (subject) group by all) select t_ms, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from m group by all",
    "resample_cross_join": VIEWS + f", {BD.format(50)} select draw, count(*) as n, round(sum(value), 4) as total from boot join subject_curve using (subject) group by all",
    "best_model": VIEWS + f", {MS}, a as (select (t_idx % 3)::int as part, model, subject, avg(value) as m from md where t_ms >= 0 group by all), b as (select part, model, avg(m) as m from a group by all) select part, model, round(m, 6) as m from (select *, row_number() over (partition by part order by m desc, model) as r from b) where r = 1",
    "best_model_report": VIEWS + f", {MS}, {DR}, {BD.format(BOOT)}" + """, gr as (select avg(value) as g from md),
        pc as (select (t_idx % 3)::int as part, model, subject, floor(t_idx / 3.0)::int as t_idx, t_ms, round(avg(value) - (select g from gr), 9) as value from md group by all),
        bm as (select part, model, m from (select *, row_number() over (partition by part order by m desc, model) as r from (select part, model, avg(m) as m from (select part, model, subject, avg(value) as m from pc where t_ms >= 0 group by all) group by all)) where r = 1),
        me as (select pc.* from pc join bm using (part, model)),
        pk as (select part, t_ms as peak_ms from (select *, row_number() over (partition by part order by m desc, t_ms) as r from (select part, t_ms, avg(value) as m from me group by all)) where r = 1),
        bp as (select part, draw, t_ms from (select *, row_number() over (partition by part, draw order by m desc, t_ms) as r from (select part, draw, t_ms, avg(value) as m from boot join me using (subject) group by all)) where r = 1),
        ci as (select part, quantile_cont(t_ms, 0.025) as low, quantile_cont(t_ms, 0.975) as high from bp group by all),
        nul as (select part, draw, t_idx, avg(value * sign) as m from me join draws using (subject) group by all), lim as (select part, quantile_cont(m, 0.1) as low, quantile_cont(m, 0.9) as high from nul group by all),
        mm as (select part, -1 as draw, t_idx, avg(value) as m from me group by all union all select part, draw, t_idx, m from nul),
        fl as (select part, draw, t_idx, m, m > high or m < low as flag from mm join lim using (part)),
        op as (select *, case when flag and not coalesce(lag(flag) over (partition by part, draw order by t_idx), false) then 1 else 0 end as o from fl),
        cl as (select *, sum(o) over (partition by part, draw order by t_idx rows unbounded preceding)::int as cluster from op),
        cs as (select part, draw, cluster, min(t_idx) as first, max(t_idx) as last, sum(m) as s from cl where flag group by all),
        tops as (select b.part, d.range as draw, coalesce((select max(s) from cs where cs.draw = d.range and cs.part = b.part), 0) as top from bm b, range(64) d),
        res as (select part, first, last, ((select count(*) from tops where top >= abs(s) and tops.part = cs.part) + 1) / 65.0::double as p from cs where draw = -1),
        mk as (select part, list_sort(list(t_idx)) as significant_at from (select part, unnest(range(first, last + 1))::int as t_idx from res where p < 0.5) group by all)
        select part, model, round(m, 6) as m, peak_ms, round(low, 6) as low, round(high, 6) as high, coalesce(significant_at, []) as significant_at from bm join pk using (part) join ci using (part) left join mk using (part)""",
    "best_model_per_bin": VIEWS + f", {BM} select start, stop, winner from bb",
    "bin_range_join": VIEWS + ", o as (select min(t_ms) as t0 from curve where value > 99) select distinct t_ms, (t0 + floor((t_ms - t0) / 60.0) * 60)::int as start from curve, o where t_ms >= t0",
    "model_windows": VIEWS + f", {BM}, r as (select *, sum(n) over (order by start rows unbounded preceding) as run from (select *, case when lag(winner) over (order by start) = winner and lag(stop) over (order by start) = start then 0 else 1 end as n from bb)) select winner, min(start) as start, max(stop) as stop from r group by winner, run",
}
