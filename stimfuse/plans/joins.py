"""Queries on joins, set operations and scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stimfuse.operators import joins as op
from stimfuse.operators import rdm
from stimfuse.plans import views as v
from stimfuse.plans.averages import R, _captions
from stimfuse.plans.views import VIEWS
from stimfuse.session import shared_dir, table

MACRO = ["ASIA", "EUROPE"]


def _train(s, d):
    return v.features(s, d).filter("label < 6").select("condition")


def _halves(s, d):
    """Mean response per (vertex, half) of a line's parity."""
    half = F.when(F.col("line") % 2 == 0, "even").otherwise("odd")
    return v.response_trials(s, d).groupBy("vertex", half.alias("half")).agg(F.avg("value").alias("value"), F.avg("a").alias("a"))


def _weights(s, d):
    return v.features(s, d).select(F.col("condition").alias("vertex"), F.slice("embedding", 1, 8).alias("coef"), F.col("label").alias("intercept"))


def _nan_side(s, d):
    m = v.score_map(s, d).groupBy("subject", "vertex").agg(F.avg("score").alias("value"))
    return m.withColumn("value", F.when(F.col("vertex") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value")))


def _files(s, d, rows, key):
    """Each key's rows as files of their own, without the key, as separate runs leave them, read again and named by their folder."""
    at = shared_dir(s, f"parts-{key}")
    rows.write.partitionBy(key).parquet(at)
    kind = rows.schema[key].dataType
    values = [r[0] for r in s.read.parquet(at).select(key).distinct().collect()]
    parts = [s.read.parquet(f"{at}/{key}={x}").withColumn(key, F.lit(x).cast(kind)) for x in values]
    # columns come in another order from every other run: they are matched by name
    return op.union_parts([p.select(*(reversed(p.columns) if k % 2 else p.columns)) for k, p in enumerate(parts)])


def _gaps(s, d):
    expected = s.range(30).select(F.col("id").cast("int").alias("t_idx"))
    return op.tolerant_union(v.curve(s, d).groupBy("t_idx").agg(F.count("*").alias("n")), expected, ["t_idx"])


QUERIES = {
    "join_trials_to_stimuli": lambda s, d: v.signal_trials(s, d).join(_train(s, d), "condition").groupBy("condition").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("value")),
    "split_semi_join": lambda s, d: v.response_trials(s, d).join(_train(s, d), "condition", "left_semi").groupBy("subject").agg(F.count("*").alias("n")),
    "align_modalities": lambda s, d: op.align_modalities(v.signal_trials(s, d).groupBy("condition").agg(F.avg("value").alias("signal")), v.response_trials(s, d).groupBy("condition", "hemi").agg(F.avg("value").alias("response"))).select("condition", "hemi", R("signal"), R("response")),
    "union_roi_masks": lambda s, d: op.union_roi_masks(v.score_map(s, d), v.roi_membership(s, d), MACRO, "macro").groupBy("subject").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score")),
    "concat_roi_pools": lambda s, d: op.concat_roi_pools(v.score_map(s, d), v.roi_membership(s, d).unionByName(v.roi_membership(s, d).filter("macro = 'ASIA' and vertex % 2 = 0")), MACRO, "macro").groupBy("subject").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score")),
    "opposite_half_join": lambda s, d: op.opposite_half_join(_halves(s, d).select("vertex", "half", F.col("value").alias("w")), _halves(s, d), ["vertex"]).select("vertex", "half", F.round("w", 6).alias("w"), R("value")),
    "apply_weights": lambda s, d: v.features(s, d).select("condition", F.slice("embedding", 9, 8).alias("x"), F.col("condition").alias("vertex")).join(_weights(s, d), "vertex").select("condition", F.round(op.predicted(F.col("x"), F.col("coef"), F.col("intercept")), 6).alias("predicted")),
    "caption_join": lambda s, d: _captions(s, d).groupBy("image").agg(F.count("*").alias("captions"), F.min("vec_id").alias("first")),
    "shared_across_subjects": lambda s, d: op.shared_across(v.response_trials(s, d), "subject", "condition", 3),
    "intersect_subjects": lambda s, d: op.intersect_units(v.response_trials(s, d), "subject", "condition", list(range(6))),
    "positional_pick": lambda s, d: op.positional_pick(v.response_trials(s, d).select("condition").distinct(), [1, 5, 17, 100, 150], "condition"),
    "even_odd_average": lambda s, d: op.both_halves_average(_halves(s, d), ["vertex"], "value").select("vertex", R("value")),
    "tolerant_union": lambda s, d: _gaps(s, d)[0],
    "gap_report": lambda s, d: _gaps(s, d)[1],
    "paired_join": lambda s, d: op.paired_join(_nan_side(s, d), v.score_map(s, d).filter("hemi = 'F'").groupBy("subject", "vertex").agg(F.avg("score").alias("value")), ["subject", "vertex"]).select("subject", "vertex", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")),
    "load_hemi": lambda s, d: v.response_trials(s, d).filter("hemi = 'F' and subject = 1").groupBy("condition", "vertex").agg(F.round(F.avg("value"), 6).alias("value")),
    "load_roi": lambda s, d: v.response_trials(s, d).join(v.roi_membership(s, d).filter("roi = 'CHINA' or macro = 'AFRICA'").select("vertex"), "vertex", "left_semi").join(v.vertex_quality(s, d).filter("ncsnr >= 0.2"), "vertex", "left_semi").groupBy("condition", "vertex").agg(F.round(F.avg("value"), 6).alias("value")),
    "load_macro_roi": lambda s, d: op.union_parts([v.response_trials(s, d).filter(F.col("hemi") == h) for h in ("F", "O")]).join(v.roi_membership(s, d), "vertex").join(v.vertex_quality(s, d).filter("ncsnr >= 0.2"), "vertex").groupBy("macro", "hemi").agg(F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("value")),
    "union_splits": lambda s, d: _files(s, d, v.score_map(s, d).withColumn("split", (F.col("vertex") % 3).cast("int")), "split").groupBy("hemi").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total")),
    "union_time_files": lambda s, d: _files(s, d, v.score_map(s, d), "t_idx").groupBy("vertex").agg(F.count("*").alias("n"), F.round(F.sum("score"), 5).alias("total")),
    "union_sessions": lambda s, d: _files(s, d, v.signal_trials(s, d).select("session", "trial", "value"), "session").groupBy("session").agg(F.count("*").alias("n")),
    "union_hemispheres": lambda s, d: _files(s, d, v.score_map(s, d), "hemi").select("subject", "hemi", "t_idx", "vertex", R("score")),
    "union_test_val": lambda s, d: _train(s, d).union(v.features(s, d).filter("label > 4").select("condition")).distinct(),
    "except_cross_pairs": lambda s, d: rdm.condition_pairs(v.features(s, d), ["label"], halves=v.features(s, d).select("condition", (F.col("condition") % 3 % 2).alias("half"))).select("i", "j"),
    "string_ids": lambda s, d: table(s, d, "part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 5, "0").alias("padded"), F.format_string("sub-%02d", (F.col("p_partkey") % 20).cast("int")).alias("subject"), F.regexp_extract("p_brand", r"(\d+)", 1).alias("digits"), F.element_at(F.split("p_name", " "), 1).alias("head")),
    "log_spaced_alphas": lambda s, d: table(s, d, "nation").select("n_nationkey", F.round(F.log10(F.pow(F.lit(10.0), F.lit(-6.0) + F.col("n_nationkey") * F.lit(16.0) / 24)), 6).alias("exponent")),
    "math_functions": lambda s, d: table(s, d, "supplier").select("s_suppkey", F.round(F.sqrt(F.abs("s_acctbal")), 6).alias("root"), F.round(F.atanh(F.least(F.greatest(F.col("s_acctbal") / 10000, F.lit(-0.999)), F.lit(0.999))), 6).alias("z"), F.bround(F.col("s_suppkey") / 2, 0).alias("half_even")),
}

SQL = {
    "join_trials_to_stimuli": VIEWS + "select condition, count(*) as n, round(avg(value), 6) as value from signal_trials join (select condition from features where label < 6) using (condition) group by all",
    "split_semi_join": VIEWS + "select subject, count(*) as n from response_trials where condition in (select condition from features where label < 6) group by all",
    "align_modalities": VIEWS + "select condition, hemi, round(signal, 6) as signal, round(response, 6) as response from (select condition, avg(value) as signal from signal_trials group by all) join (select condition, hemi, avg(value) as response from response_trials group by all) using (condition)",
    "union_roi_masks": VIEWS + "select subject, count(*) as n, round(avg(score), 6) as score from score_map where vertex in (select vertex from roi_membership where macro in ('ASIA', 'EUROPE')) group by all",
    "concat_roi_pools": VIEWS + "select subject, count(*) as n, round(avg(score), 6) as score from score_map join (select vertex from roi_membership where macro in ('ASIA', 'EUROPE') union all select vertex from roi_membership where macro = 'ASIA' and vertex % 2 = 0) using (vertex) group by all",
    "opposite_half_join": VIEWS + ", h as (select vertex, case when line % 2 = 0 then 'even' else 'odd' end as half, avg(value) as value from response_trials group by all) select b.vertex, b.half, round(a.value, 6) as w, round(b.value, 6) as value from h a join h b on a.vertex = b.vertex and a.half <> b.half",
    "apply_weights": VIEWS + "select condition, round(list_inner_product(embedding[9:16]::double[], embedding[1:8]::double[]) + label, 6) as predicted from features",
    "caption_join": "select conv_id as image, count(*) as captions, min((7 * conv_id + turn) % (select count(*) from embeddings)) as first from conversations group by all",
    "shared_across_subjects": VIEWS + "select condition from (select condition, subject, count(*) as k from response_trials group by all) where k >= 3 group by condition having count(*) = (select count(distinct subject) from response_trials)",
    "intersect_subjects": VIEWS + "select condition from response_trials group by condition having count(distinct subject) = 6",
    "positional_pick": VIEWS + "select condition, place from (select condition, row_number() over (order by condition)::int as place from (select distinct condition from response_trials)) where place in (1, 5, 17, 100, 150)",
    "even_odd_average": VIEWS + ", h as (select vertex, line % 2 as half, avg(value) as value from response_trials group by all) select vertex, round(avg(value), 6) as value from h group by vertex having count(*) = 2",
    "tolerant_union": VIEWS + "select t_idx, count(*) as n from curve group by all",
    "gap_report": VIEWS + "select range::int as t_idx from range(30) where range not in (select t_idx from curve)",
    "paired_join": VIEWS + "select subject, vertex, round(x, 6) as x, round(y, 6) as y from (select subject, vertex, avg(score) as x from score_map where vertex % 4 <> 0 group by all) join (select subject, vertex, avg(score) as y from score_map where hemi = 'F' group by all) using (subject, vertex)",
    "load_hemi": VIEWS + "select condition, vertex, round(avg(value), 6) as value from response_trials where hemi = 'F' and subject = 1 group by all",
    "load_roi": VIEWS + "select condition, vertex, round(avg(value), 6) as value from response_trials where vertex in (select vertex from roi_membership where roi = 'CHINA' or macro = 'AFRICA') and vertex in (select vertex from vertex_quality where ncsnr >= 0.2) group by all",
    "load_macro_roi": VIEWS + "select macro, hemi, count(*) as n, round(avg(value), 5) as value from response_trials join roi_membership using (vertex) join vertex_quality using (vertex) where ncsnr >= 0.2 group by all",
    "union_splits": VIEWS + "select hemi, count(*) as n, round(sum(score), 4) as total from score_map group by all",
    "union_time_files": VIEWS + "select vertex, count(*) as n, round(sum(score), 5) as total from score_map group by all",
    "union_sessions": VIEWS + "select session, count(*) as n from signal_trials group by all",
    "union_hemispheres": VIEWS + "select subject, hemi, t_idx, vertex, round(score, 6) as score from score_map",
    "union_test_val": VIEWS + "select distinct condition from features where label < 6 or label > 4",
    "except_cross_pairs": VIEWS + "select a.condition as i, b.condition as j from features a join features b on a.label = b.label and a.condition < b.condition where a.condition % 3 % 2 = b.condition % 3 % 2",
    "string_ids": r"select p_partkey, case when len(p_partkey::varchar) > 5 then left(p_partkey::varchar, 5) else lpad(p_partkey::varchar, 5, '0') end as padded, printf('sub-%02d', (p_partkey % 20)::int) as subject, regexp_extract(p_brand, '(\d+)', 1) as digits, split_part(p_name, ' ', 1) as head from part",
    "log_spaced_alphas": "select n_nationkey, round(-6.0 + n_nationkey * 16.0 / 24, 6) as exponent from nation",
    "math_functions": "select s_suppkey, round(sqrt(abs(s_acctbal)), 6) as root, round(atanh(least(greatest(s_acctbal / 10000, -0.999), 0.999)), 6) as z, round_even(s_suppkey / 2, 0)::double as half_even from supplier",
}
