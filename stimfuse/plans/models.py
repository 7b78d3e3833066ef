"""Queries on regression models, with SQL for ridge: the inverse of each penalised Gram matrix by elimination, and leave-one-out
errors from it; for decoding, Newton steps by elimination; for principal components, seven sweeps of Jacobi rotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stimfuse.operators import blocks, joins, tiles
from stimfuse.operators import regression as op
from stimfuse.plans import views as v
from stimfuse.plans.averages import R
from stimfuse.plans.views import VIEWS
from stimfuse.session import checkpointed

ALPHAS = [10.0 ** (-6 + 16 * k / 19) for k in range(20)]


def _signals(s, d):
    """(half, condition, x): elements 1 to 8 of a condition's vector are its signal."""
    return v.features(s, d).select(F.when(F.col("condition") % 2 == 0, "even").otherwise("odd").alias("half"), "condition", F.slice("embedding", 1, 8).alias("x"))


def _responses(s, d):
    """(half, condition, y): elements 33 to 48 are responses of 16 vertices, the targets 0 to 15."""
    return v.features(s, d).select(F.when(F.col("condition") % 2 == 0, "even").otherwise("odd").alias("half"), "condition", F.slice("embedding", 33, 16).alias("y"))


def _models(s, d):
    """(half, condition, x): elements 17 to 26 are model features."""
    return v.features(s, d).select(F.when(F.col("condition") % 2 == 0, "even").otherwise("odd").alias("half"), "condition", F.slice("embedding", 17, 10).alias("x"))


def _crossed(models):
    """Models of one half for the conditions of the other."""
    return models.withColumn("half", F.when(F.col("half") == "even", "odd").otherwise("even"))


class _Halves:
    """Signals and responses of both halves in blocks, and models that learn responses from signals (stage 1)."""

    def __init__(self, s, d, alphas=ALPHAS):
        signals, responses = _signals(s, d), _responses(s, d)
        self.shape = blocks.Shape(blocks.most_conditions(signals, ["half"]), op.target_count(responses))
        self.x, self.y = blocks.pack_predictors(signals, ["half"], self.shape), blocks.pack_responses(responses, ["half"], self.shape)
        self.models = self.learned(self.x, self.y, alphas)

    def learned(self, x, y, alphas=ALPHAS):
        return blocks.fit(x, y, ["half"], alphas, self.shape)

    def scored(self, x, models):
        """r of what models predict for the other half with its responses."""
        return blocks.score(x, _crossed(models), self.y, ["half"], self.shape).select("half", "target", F.round("r", 6).alias("r"))

    def transferred(self, features, made):
        """Stage 2 learns features against what stage 1 predicts for a half, and is scored on the true responses of the other."""
        x = blocks.pack_predictors(features, ["half"], self.shape)
        return self.scored(x, self.learned(x, made))

    def made(self):
        """What stage 1 predicts for the other half's signals."""
        return checkpointed(blocks.predict(self.x, _crossed(self.models), ["half"], self.shape))


def _encoding(s, d):
    h = _Halves(s, d)
    return h.scored(h.x, h.models)


def _transfer(s, d):
    h = _Halves(s, d)
    return h.transferred(_models(s, d), h.made())


def _layerwise(s, d):
    h, parts = _Halves(s, d), []
    made = h.made()
    for layer, first in enumerate((9, 17, 25)):
        f = v.features(s, d).select(F.when(F.col("condition") % 2 == 0, "even").otherwise("odd").alias("half"), "condition", F.slice("embedding", first, 8).alias("x"))
        parts.append(h.transferred(f, made).withColumn("layer", F.lit(layer)))
    return joins.union_parts(parts)


def _reweight(s, d):
    """One shared penalty: squared differences of four features against a correlation distance, within classes."""
    x = v.features(s, d).select("condition", "label", F.slice("embedding", 1, 4).alias("x"), F.slice("embedding", 33, 16).alias("y"))
    return tiles.ridge_over_pairs(x, ["label"], "x", ("correlation", "y"), [10.0 ** (-6 + 11 * k / 29) for k in range(30)])


def _split_half(s, d):
    """Three shuffles of the conditions: models of one half are scored on the other."""
    half = ((F.col("condition") * 7 + F.col("shuffle") * 13) % 11 % 2).cast("string")
    shuffles, keys = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("shuffle"), ["shuffle", "half"]
    sig = _signals(s, d).select("condition", "x", shuffles).withColumn("half", half)
    res = _responses(s, d).select("condition", "y", shuffles).withColumn("half", half)
    shape = blocks.Shape(blocks.most_conditions(sig, keys), op.target_count(res))
    x, y = blocks.pack_predictors(sig, keys, shape), blocks.pack_responses(res, keys, shape)
    models = blocks.fit(x, y, keys, ALPHAS, shape)
    flipped = models.withColumn("half", F.when(F.col("half") == "0", "1").otherwise("0"))
    return blocks.score(x, flipped, y, keys, shape).select(*keys, "target", F.round("r", 6).alias("r"))


def _pseudo(s, d):
    """Six pseudo-trials of each class: means of vectors by number."""
    x = v.features(s, d).select(F.col("label").alias("condition"), (F.col("condition") % 6).alias("fold"), F.posexplode(F.slice("embedding", 1, 12)).alias("pos", "v"))
    m = x.groupBy("condition", "fold", "pos").agg(F.avg("v").alias("v"))
    return m.groupBy(F.lit(0).alias("t_idx"), "condition", "fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"]).alias("x"))


def _standard(s, d):
    x = v.features(s, d).select("condition", F.slice("embedding", 1, 6).alias("x"))
    return op.standardize_apply(x, op.standardize_fit(x.filter("condition % 2 = 0")))


def _pca(s, d):
    x = v.features(s, d).select("condition", F.col("embedding").alias("x"))
    return op.pca_apply(x, op.pca_fit(x.filter("condition % 2 = 0"), 5)).select("condition", F.transform("x", lambda e: F.round(e, 5)).alias("x"))


QUERIES = {
    "ridge_cv": lambda s, d: op.ridge_cv(_signals(s, d), _responses(s, d), ["half"], ALPHAS).select("half", "target", R("alpha"), R("intercept"), F.transform("coef", lambda c: F.round(c, 6)).alias("coef")),
    "ridge_cv_single": lambda s, d: _reweight(s, d).select("label", R("alpha"), R("intercept"), F.transform("coef", lambda c: F.round(c, 6)).alias("coef")),
    "encoding_fusion": _encoding,
    "encoding_split_half": _split_half,
    "two_stage_fit": lambda s, d: op.ridge_cv(_signals(s, d), _responses(s, d), ["half"], [10.0 ** (-6 + 9 * k / 19) for k in range(20)]).select("half", "target", R("alpha"), R("intercept")),
    "two_stage_transfer": _transfer,
    "two_stage_layerwise": _layerwise,
    "standardize_fit_apply": lambda s, d: _standard(s, d).select("condition", F.transform("x", lambda e: F.round(e, 6)).alias("x")),
    "pca_fit_apply": _pca,
    "decoding_rdm": lambda s, d: op.decoding_rdm(_pseudo(s, d), None, ["t_idx"], 6),
}


def _ridge_sql(name: str, x: str, y: str, keys: str, alphas: str, p: int) -> str:
    """CTEs that end in {name}_w (keys, target, alpha, coef, intercept); x (keys, condition, x list), y (keys, condition, target, value)."""
    n, r = name, f"range(1, {p + 1})"
    return f"""{n}_x as (select {keys}, condition, x from {x} where ({keys}, condition) in (select ({keys}, condition) from {y})),
{n}_mx as (select {keys}, n, list(m order by pos) as mx from (select {keys}, pos.range as pos, avg(x[pos.range]) as m, count(*) as n from {n}_x, {r} pos group by all) group by {keys}, n),
{n}_z as (select {keys}, condition, n, list_transform({r}, lambda a: x[a] - mx[a]) as z from {n}_x join {n}_mx using ({keys})),
{n}_g as (select {keys}, a, list(s order by b) as g from (select {keys}, a.range as a, b.range as b, sum(z[a.range] * z[b.range]) as s from {n}_z, {r} a, {r} b group by all) group by {keys}, a),
{n}_m as (select {keys}, k, alpha, list(list_concat(list_transform(g, lambda v, j: v + case when j = a then alpha else 0 end), list_transform({r}, lambda j: case when j = a then 1.0::double else 0.0::double end)) order by a) as m from {n}_g, ({alphas}) group by all),
{n}_r as (select {keys}, k, alpha, 1 as step, m from {n}_m union all
  select {keys}, k, alpha, step + 1, list_transform(m, lambda q, i: case when i = step then pr else list_transform(q, lambda v, j: v - q[step] * pr[j]) end)
  from (select *, list_transform(m[step], lambda v: v / m[step][step]) as pr from {n}_r where step <= {p})),
{n}_inv as (select {keys}, k, alpha, list_transform(m, lambda q: q[{p + 1}:{2 * p}]) as inv from {n}_r where step = {p + 1}),
{n}_y as (select {keys}, target, condition, value, avg(value) over (partition by {keys}, target) as my from {y} where ({keys}, condition) in (select ({keys}, condition) from {x})),
{n}_c as (select {keys}, target, my, list(s order by a) as c from (select {keys}, target, my, a.range as a, sum(z[a.range] * (value - my)) as s from {n}_y join {n}_z using ({keys}, condition), {r} a group by all) group by all),
{n}_k as (select {keys}, target, k, alpha, my, list_transform(inv, lambda q: list_dot_product(q, c)) as w from {n}_inv join {n}_c using ({keys})),
{n}_h as (select {keys}, condition, k, z, 1 - 1.0::double / n - list_dot_product(z, list_transform(inv, lambda q: list_dot_product(q, z))) as rest from {n}_z join {n}_inv using ({keys})),
{n}_e as (select {keys}, target, k, avg(((value - y.my - list_dot_product(z, w)) / rest) ** 2) as error from {n}_y y join {n}_h using ({keys}, condition) join {n}_k using ({keys}, target, k) group by all),
{n}_b as (select {keys}, target, k from (select *, row_number() over (partition by {keys}, target order by error, k) as r from {n}_e) where r = 1),
{n}_w as (select {keys}, target, alpha, w as coef, my - list_dot_product(mx, w) as intercept from {n}_k join {n}_b using ({keys}, target, k) join {n}_mx using ({keys}))"""


def _alphas_sql(top: int, n: int) -> str:
    return f"select range as k, pow(10.0::double, -6 + {top} * range / {n - 1}.0::double) as alpha from range({n})"


def _made_sql(name: str, weights: str, x: str) -> str:
    """Predictions of one half's weights on the other half's features."""
    return f"{name} as (select x.half, x.condition, w.target, list_dot_product(x.x, w.coef) + w.intercept as value from {weights} w join {x} x on x.half <> w.half)"


def _r_sql(made: str, truth: str, keys: str) -> str:
    return f"select {keys}, target, round(covar_pop(m.value, t.value) / ((stddev_pop(m.value) + 1e-8) * (stddev_pop(t.value) + 1e-8)), 6) + 0.0 as r from {made} m join {truth} t using ({keys}, condition, target) group by {keys}, target"


HALVED = VIEWS.replace("with", "with recursive", 1) + """, hv as (select case when condition % 2 = 0 then 'even' else 'odd' end as half, condition, label, embedding::double[] as e from features),
sig as (select half, condition, e[1:8] as x from hv), resp as (select half, condition, range::int as target, e[33 + range] as value from hv, range(16))"""
STAGE1 = _ridge_sql("s1", "sig", "resp", "half", _alphas_sql(16, 20), 8) + ", " + _made_sql("m1", "s1_w", "sig")
LAYERS = ", ".join(f"f{k} as (select half, condition, e[{first}:{first + 7}] as x from hv), " + _ridge_sql(f"l{k}", f"f{k}", "m1", "half", _alphas_sql(16, 20), 8) + ", " + _made_sql(f"n{k}", f"l{k}_w", f"f{k}") for k, first in enumerate((9, 17, 25)))
COEF = "list_transform(coef, lambda c: round(c, 6) + 0.0) as coef"
#: One Newton step of a linear machine over signed rows r with weights w: normal equations of the rows inside the margin, by elimination.
STEP = """list_transform(list_reduce(list_prepend(
      list_transform(range(1, 14), lambda a: list_concat(list_transform(range(1, 14), lambda b: coalesce(list_sum(list_transform(list_filter(r, lambda x: list_dot_product(x, w) < 1), lambda x: x[a] * x[b])), 0) + case when a = b then 0.5 else 0 end), [coalesce(list_sum(list_transform(list_filter(r, lambda x: list_dot_product(x, w) < 1), lambda x: x[a])), 0)])),
      list_transform(range(1, 14), lambda s: [[s::double]])),
    lambda m, s: list_transform(m, lambda row, i: case when i = s[1][1] then list_transform(row, lambda v: v / row[s[1][1]::int]) else list_transform(row, lambda v, k: v - row[s[1][1]::int] * m[s[1][1]::int][k] / m[s[1][1]::int][s[1][1]::int]) end)), lambda row: row[14])"""
DECODING = VIEWS + f""", px as (select label, condition % 6 as fold, range as pos, avg(embedding[range + 1]::double) as v from features, range(12) group by all),
pt as (select label, fold, list_append(list(v order by pos), 1.0::double) as x from px group by all),
pc as (select label, list(x order by fold) as xs from pt group by label having count(*) = 6),
pf as (select a.label as i, b.label as j, f.range as f, a.xs as p, b.xs as q,
  list_concat(list_transform(list_filter(range(1, 7), lambda k: k <> f.range), lambda k: a.xs[k]), list_transform(list_filter(range(1, 7), lambda k: k <> f.range), lambda k: list_transform(b.xs[k], lambda e: -e))) as r
  from pc a join pc b on a.label < b.label, range(1, 7) f),
pw as (select i, j, f, p, q, list_reduce(list_transform(range(31), lambda k: list_transform(range(13), lambda e: 0.0::double)), lambda w, z: {STEP}) as w from pf)
select 0 as t_idx, i, j, avg((case when list_dot_product(p[f], w) > 0 then 0.5 else 0 end) + (case when list_dot_product(q[f], w) <= 0 then 0.5 else 0 end)) as d from pw group by i, j"""
#: One Jacobi rotation z of m, a covariance matrix above the vectors turned so far: cosine and sine, then both columns and both rows.
ANGLE = """list_transform([case when m[z[1][1]::int][z[1][2]::int] = 0 then 0.0::double else (m[z[1][2]::int][z[1][2]::int] - m[z[1][1]::int][z[1][1]::int]) / (2 * m[z[1][1]::int][z[1][2]::int]) end], lambda tau: list_transform([case when m[z[1][1]::int][z[1][2]::int] = 0 then 0.0::double else case when tau < 0 then -1 else 1 end / (abs(tau) + sqrt(1 + tau * tau)) end], lambda t: [1 / sqrt(1 + t * t), t / sqrt(1 + t * t), z[1][1], z[1][2]])[1])[1]"""
TURN = f"""list_transform([{ANGLE}], lambda w: list_transform([list_transform(m, lambda r: list_transform(r, lambda v, k: case when k = w[3] then w[1] * r[w[3]::int] - w[2] * r[w[4]::int] when k = w[4] then w[2] * r[w[3]::int] + w[1] * r[w[4]::int] else v end))], lambda n:
   list_transform(n, lambda r, i: case when i = w[3] then list_transform(n[w[3]::int], lambda v, k: w[1] * v - w[2] * n[w[4]::int][k]) when i = w[4] then list_transform(n[w[3]::int], lambda v, k: w[2] * v + w[1] * n[w[4]::int][k]) else r end))[1])[1]"""
PCA = VIEWS + f""", x as (select condition, embedding::double[] as x from features),
mean as (select list(m order by pos) as mu from (select pos.range as pos, avg(x[pos.range]) as m from x, range(1, 65) pos where condition % 2 = 0 group by 1)),
cov as (select list(row order by a) as c from (select a, list(s order by b) as row from (select a.range as a, b.range as b, avg((x[a.range] - mu[a.range]) * (x[b.range] - mu[b.range])) as s from x, mean, range(1, 65) a, range(1, 65) b where condition % 2 = 0 group by 1, 2) group by a)),
eig as (select list_reduce(list_concat([list_concat(c, list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: case when i = j then 1.0::double else 0.0::double end)))],
   (select list([[p.range::double, q.range::double]] order by s.range, p.range, q.range) from range(7) s, range(1, 65) p, range(1, 65) q where p.range < q.range)), lambda m, z: {TURN}) as m from cov),
val as (select k.range as k, m[k.range][k.range] as value, list_transform(range(65, 129), lambda i: m[i][k.range]) as vec from eig, range(1, 65) k),
top as (select row_number() over (order by value desc) as nth, case when vec[list_position(list_transform(vec, lambda e: abs(e)), list_max(list_transform(vec, lambda e: abs(e))))] < 0 then list_transform(vec, lambda e: -e) else vec end as vec from val),
five as (select list(vec order by nth) as w from top where nth <= 5)
select condition, list_transform(w, lambda u: round(list_dot_product(list_transform(x, lambda e, k: e - mu[k]), u), 5)) as x from x, mean, five"""
SQL = {
    "decoding_rdm": DECODING,
    "pca_fit_apply": PCA,
    "ridge_cv": f"{HALVED}, {_ridge_sql('s1', 'sig', 'resp', 'half', _alphas_sql(16, 20), 8)} select half, target, round(alpha, 6) as alpha, round(intercept, 6) + 0.0 as intercept, {COEF} from s1_w",
    "ridge_cv_single": HALVED + """, pr as (select a.label, a.condition * 1000000 + b.condition as condition, list_transform(range(1, 5), lambda k: (a.e[k] - b.e[k]) ** 2) as x,
        list_transform(a.e[33:48], lambda v: v - list_avg(a.e[33:48])) as p, list_transform(b.e[33:48], lambda v: v - list_avg(b.e[33:48])) as q from hv a join hv b on a.label = b.label and a.condition < b.condition),
        py as (select label, condition, 0 as target, 1 - list_dot_product(p, q) / sqrt(list_dot_product(p, p) * list_dot_product(q, q)) as value from pr), """ + _ridge_sql("s", "pr", "py", "label", _alphas_sql(11, 30), 4) + f" select label, round(alpha, 6) as alpha, round(intercept, 6) + 0.0 as intercept, {COEF} from s_w",
    "encoding_fusion": f"{HALVED}, {STAGE1} {_r_sql('m1', 'resp', 'half')}",
    "encoding_split_half": HALVED + """, hs as (select condition, s.range as shuffle, ((condition * 7 + s.range * 13) % 11 % 2)::varchar as side, e from hv, range(1, 4) s), sx as (select shuffle, side, condition, e[1:8] as x from hs),
        sy as (select shuffle, side, condition, range::int as target, e[33 + range] as value from hs, range(16)), """ + _ridge_sql("s", "sx", "sy", "shuffle, side", _alphas_sql(16, 20), 8) + """,
        ms as (select x.shuffle, x.side, x.condition, w.target, list_dot_product(x.x, w.coef) + w.intercept as value from s_w w join sx x on x.shuffle = w.shuffle and x.side <> w.side),
        rs as (""" + _r_sql("ms", "sy", "shuffle, side") + ") select shuffle::int as shuffle, side as half, target, r from rs",
    "two_stage_fit": f"{HALVED}, {_ridge_sql('s1', 'sig', 'resp', 'half', _alphas_sql(9, 20), 8)} select half, target, round(alpha, 6) as alpha, round(intercept, 6) + 0.0 as intercept from s1_w",
    "two_stage_transfer": f"{HALVED}, {STAGE1}, f as (select half, condition, e[17:26] as x from hv), {_ridge_sql('s2', 'f', 'm1', 'half', _alphas_sql(16, 20), 10)}, {_made_sql('m2', 's2_w', 'f')} {_r_sql('m2', 'resp', 'half')}",
    "two_stage_layerwise": f"{HALVED}, {STAGE1}, {LAYERS} " + " union all ".join(f"select *, {k} as layer from ({_r_sql(f'n{k}', 'resp', 'half')})" for k in range(3)),
    "standardize_fit_apply": VIEWS + """, l as (select condition, range::int as pos, embedding[range + 1]::double as x from features, range(6)),
        m as (select pos, avg(x) as mean, stddev_pop(x) as sd from l where condition % 2 = 0 group by all)
        select condition, list(round((x - mean) / case when sd = 0 then 1 else sd end, 6) order by pos) as x from l join m using (pos) group by condition""",
}
