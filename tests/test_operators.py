"""Small fixtures: models against brute force, missing values, degenerate groups, sources and sinks."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stimfuse.functions import stats
from stimfuse.operators import attribution, averages, inference, projections, rdm, regression, windows
from stimfuse.plans import joins as joins_plan
from stimfuse.sources import readers, sinks


def test_leave_one_out_ridge_equals_brute_force():
    r = np.random.default_rng(1)
    x, y = r.normal(size=(30, 4)), r.normal(size=(30, 3))
    y[:, 0] += x @ [1, 2, 0, 0]
    alphas = np.array([0.01, 2.5, 400.0])
    coef, intercept, chosen = regression.loo_ridge(x, y, alphas)

    def solve(x, y, a):
        mx, my = x.mean(0), y.mean(0)
        w = np.linalg.solve((x - mx).T @ (x - mx) + a * np.eye(x.shape[1]), (x - mx).T @ (y - my))
        return w, my - mx @ w

    for t in range(3):
        errors = []
        for a in alphas:
            e = 0
            for k in range(30):
                keep = np.arange(30) != k
                w, b = solve(x[keep], y[keep, t], a)
                e += (y[k, t] - x[k] @ w - b) ** 2
            errors.append(e)
        assert chosen[t] == alphas[int(np.argmin(errors))]
        w, b = solve(x, y[:, t], chosen[t])
        assert np.allclose(w, coef[t]) and np.isclose(b, intercept[t])
    assert len(set(regression.loo_ridge(x, y, alphas, per_target=False)[2])) == 1


def test_decoding_separable_and_identical(spark):
    rows = [(0, c, f, [float(c == 1) * 5 + 0.1 * f, 1.0]) for c in (1, 2) for f in range(6)] + [(0, 3, f, [0.1 * f, 1.0]) for f in range(6)]
    p = spark.createDataFrame(rows, "t_idx int, condition int, fold int, x array<double>")
    pairs = rdm.condition_pairs(p.select("condition").distinct(), [])
    got = {(r.i, r.j): r.d for r in regression.decoding_rdm(p, pairs, ["t_idx"], 6).collect()}
    assert got[1, 2] == 1.0 and got[1, 3] == 1.0 and got[2, 3] <= 0.6


def test_pca_against_numpy(spark):
    r = np.random.default_rng(2)
    m = r.normal(size=(50, 5)) @ r.normal(size=(5, 5))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(m)], "condition int, x array<double>")
    mean, w = regression.pca_fit(df, 3)
    _, _, vt = np.linalg.svd(m - m.mean(0), full_matrices=False)
    assert np.allclose(mean, m.mean(0)) and np.allclose(np.abs(w), np.abs(vt[:3]), atol=1e-6)


def test_zero_variance_and_nan(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 2.0), (2, 2.0, 4.0)], "k int, x double, y double")
    r = {x.k: (x.a, x.b) for x in df.groupBy("k").agg(stats.safe_corr(F.col("x"), F.col("y")).alias("a"), stats.pearson_eps(F.col("x"), F.col("y")).alias("b")).collect()}
    assert r[1] == (None, 0.0) and math.isclose(r[2][0], 1.0)
    nan = float("nan")
    t = spark.createDataFrame([(1, nan), (1, nan), (2, nan), (2, 4.0)], "condition int, value double")
    assert {x.condition: x.value for x in averages.repeat_nanmean(t, ["condition"]).collect()} == {1: 0.0, 2: 4.0}
    assert math.isnan(averages.repeat_mean(t, ["condition"]).filter("condition = 2").first().value)


def test_t_distribution(spark):
    df = spark.createDataFrame([(n, float(t)) for n in range(1, 12) for t in (0.0, 0.5, 2.0, 7.0)], "df int, t double").withColumn("p", stats.t_two_sided(F.col("t"), F.col("df")))
    for r in df.collect():
        u = np.linspace(0, r.t, 20001)
        c = math.gamma((r.df + 1) / 2) / (math.sqrt(r.df * math.pi) * math.gamma(r.df / 2))
        assert math.isclose(r.p, 1 - 2 * np.trapezoid(c * (1 + u * u / r.df) ** (-(r.df + 1) / 2), u), abs_tol=1e-6)
    assert math.isclose(stats.t_quantile(0.975, 5), 2.570581835636, abs_tol=1e-9)


def test_clusters_with_adjacent_signs(spark):
    m = [0, 3, 4, 0, -5, 6, 0, 0, 1]
    df = spark.createDataFrame([(t, float(v)) for t, v in enumerate(m)], "t_idx int, m double")
    limits = spark.createDataFrame([(-1.0, 1.0)], "low double, high double")
    got = sorted((r["first"], r["last"], r["sum"]) for r in inference.clusters(df, limits, []).collect())
    assert got == [(1, 2, 7.0), (4, 5, 1.0)]


def test_adjusted_p_with_ties(spark):
    p = [0.01, 0.02, 0.02, 0.5, 1.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    bh = {r.i: r.p_adjusted for r in windows.bh_adjust(df, []).collect()}
    assert np.allclose([bh[i] for i in range(5)], [1 / 30, 1 / 30, 1 / 30, 0.625, 1.0])
    assert [r.p_adjusted for r in windows.bonferroni(df, []).orderBy("i").collect()] == [0.05, 0.1, 0.1, 1.0, 1.0]


def test_time_axis(spark):
    rows = projections.time_axis(spark).orderBy("t_idx").collect()
    assert len(rows) == 359 and rows[51].t_ms == 0 and sum(r.t_ms >= 0 for r in rows) == 308 and rows[0].t_ms >= -100 and rows[-1].t_ms <= 600


def test_unknown_metric_and_method(spark):
    with pytest.raises(ValueError):
        projections.clip_rdm_values(F.lit(1.0), "other")
    with pytest.raises(ValueError):
        inference.significance_mask(spark.createDataFrame([(1, 0.5)], "t_idx int, value double"), ["t_idx"], method="none")


def test_odd_split_gives_the_rest_to_half_one(spark):
    c = spark.range(5).select(F.col("id").alias("condition"))
    n = {(r.shuffle, r.half): r["count"] for r in inference.split_labels(c, 3, 1).groupBy("shuffle", "half").count().collect()}
    assert n == {(s, h): 2 + h for s in range(3) for h in (0, 1)}


def test_variance_partition_equals_residuals(spark):
    r = np.random.default_rng(4)
    m = r.normal(size=(80, 4)) @ r.normal(size=(4, 4))
    df = spark.createDataFrame([(0, *map(float, row)) for row in m], "k int, f double, v double, l double, e double")
    got = attribution.variance_partition(df, ["k"], "f", "v", "l", "e").first()

    def resid(y, x):
        x = np.column_stack([np.ones(len(y)), x])
        return y - x @ np.linalg.lstsq(x, y, rcond=None)[0]

    def r2(y, x):
        return 1 - resid(y, x).var() / y.var()

    f, v, l, e = m.T
    fl, vl, el = resid(f, l), resid(v, l), resid(e, l)
    assert math.isclose(got.unique_v, r2(fl, vl) + r2(fl, el) - r2(fl, np.column_stack([vl, el])), abs_tol=1e-9)
    assert math.isclose(got.shared, r2(f, np.column_stack([v, l])) + r2(f, e) - r2(f, np.column_stack([v, l, e])), abs_tol=1e-9)


def test_sources(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("SESSION\tTRIAL\t73KID\n1\t2\t20\n1\t1\t10\n3\t1\t30\n")
    assert [tuple(r) for r in readers.scan_conditions(spark, str(tmp_path / "b.tsv"), 2).orderBy("position").collect()] == [(1, 0, 10), (1, 1, 20)]
    assert readers.scan_behavior(spark, str(tmp_path / "b.tsv"), 1, [1]).first()["73KID"] == "20"
    (tmp_path / "info.csv").write_text("n,coco,split,x\n0,391895,val2017,1\n")
    assert tuple(readers.scan_stimulus_info(spark, str(tmp_path / "info.csv")).first()) == (0, 391895, "val2017")
    (tmp_path / "c.json").write_text('{"annotations": [{"id": 1, "image_id": 5, "caption": "a"},\n {"id": 2, "image_id": 5, "caption": "b"}]}')
    assert readers.scan_captions(spark, str(tmp_path / "c.json")).count() == 2
    (tmp_path / "labels.txt").write_text("0 Unknown\n12 V1 dorsal \n\nnone\n")
    assert [tuple(r) for r in readers.scan_label_table(spark, str(tmp_path / "labels.txt")).collect()] == [(0, "Unknown"), (12, "V1 dorsal")]
    (tmp_path / "arrays").mkdir()
    for s in (1, 2):
        np.save(tmp_path / "arrays" / f"sub-{s:02d}_scores.npy", np.arange(6, dtype=np.float32).reshape(2, 3) + s)
    got = readers.scan_array_files(spark, str(tmp_path / "arrays"), {"subject": r"sub-(\d+)"}).orderBy("subject", "position").collect()
    assert [r.value for r in got] == [1, 2, 3, 4, 5, 6, 2, 3, 4, 5, 6, 7] and got[0].subject == "01"
    assert [r.model for r in readers.scan_model_files(spark, str(tmp_path / "arrays"), r"sub-(\d+)_").collect()] == ["01", "02"]
    assert [r.condition for r in readers.scan_shared_ids(spark, str(tmp_path / "arrays")).collect()] == [1, 2]


def test_sinks(spark, tmp_path):
    scores = spark.createDataFrame([(1, "F", t, v, float(t * v)) for t in range(3) for v in range(300)], "subject int, hemi string, t_idx int, vertex int, score double")
    sinks.write_score_map(scores, f"{tmp_path}/map", 100)
    assert readers.scan_partitioned(spark, f"{tmp_path}/map", v_block=2).agg(F.min("vertex"), F.max("vertex")).first() == (100, 199)
    sinks.write_checkpointed(scores.filter("t_idx < 2"), f"{tmp_path}/times", "t_idx")
    left = sinks.unfinished(spark, spark.range(3).select(F.col("id").cast("int").alias("t_idx")), f"{tmp_path}/times", "t_idx")
    assert [r.t_idx for r in left.collect()] == [2]
    sinks.write_checkpointed(scores.join(left, "t_idx"), f"{tmp_path}/times", "t_idx")
    assert spark.read.parquet(f"{tmp_path}/times").count() == 900
    calls = []
    for _ in range(2):
        assert sinks.compute_or_load(spark, f"{tmp_path}/avg", lambda: calls.append(1) or scores.groupBy("vertex").agg(F.avg("score"))).count() == 300
    assert len(calls) == 1
    pairs = rdm.condition_pairs(spark.range(4).select(F.col("id").alias("condition")), []).withColumn("vertex", F.lit(7)).withColumn("d", F.lit(0.5))
    sinks.write_rdm_store(pairs, f"{tmp_path}/rdm")
    assert readers.scan_rdm_block(spark, f"{tmp_path}/rdm", 0, 8).count() == 6
    labels = inference.split_labels(spark.range(5).select(F.col("id").alias("condition")), 3, 1)
    labels.write.parquet(f"{tmp_path}/labels")
    assert readers.scan_split_labels(spark, f"{tmp_path}/labels", 3, 5).count() == 15
    with pytest.raises(ValueError):
        readers.scan_split_labels(spark, f"{tmp_path}/labels", 4, 5)


def test_score_map_of_small_blocks_is_few_files(spark, tmp_path):
    """Many small blocks don't make a file each; a block lies in one file, and a read of some blocks is told to Parquet. Blocks of the usual
    size, negative vertices and none keep their rows."""
    ids = [*range(-20, 400), *range(8000, 8200), 20000, None]
    scores = spark.createDataFrame([(s, h, t, v, 0.5 * t) for s in (1, 2) for h in "FV" for t in range(2) for v in ids], "subject int, hemi string, t_idx int, vertex int, score double")
    for block in (8, 7802):
        at = f"{tmp_path}/map-{block}"
        sinks.write_score_map(scores, at, block)
        files = list(Path(at).rglob("*.parquet"))
        assert len(files) <= 4 * 5
        got = spark.read.parquet(at)
        assert sorted(map(repr, got.select("subject", "hemi", "t_idx", "vertex", "score").collect())) == sorted(map(repr, scores.withColumn("score", F.col("score").cast("float")).collect()))
        assert got.filter(f"v_block is not null and v_block <> floor(vertex / {block}) + 1").count() == got.filter("v_block is null and vertex is not null").count() == 0
        of = got.withColumn("file", F.input_file_name())
        assert of.groupBy("subject", "hemi", "v_block").agg(F.count_distinct("file").alias("n")).agg(F.max("n")).first()[0] == 1
        some = readers.scan_partitioned(spark, at, hemi="F", v_block=[1, 2])
        assert sorted({r.vertex for r in some.collect()}) == [v for v in ids if v is not None and 0 <= v < 2 * block]
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "v_block" in plan.split("PushedFilters")[1].split("]")[0]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the given tables are not here")
def test_apply_weights_predicts_every_condition(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    want = {r.vec_id: float(np.dot(r.embedding[8:16], r.embedding[:8])) + r.label for r in rows}
    got = {r.condition: r.predicted for r in joins_plan.QUERIES["apply_weights"](spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


@pytest.mark.parametrize("block", [64, 2])
@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_rdm_comparison_equals_brute_force(spark, monkeypatch, block, method):
    """Blocks of matrices, ties, constant matrices, matrices that lack pairs or share none, nulls."""
    monkeypatch.setattr(rdm, "MATRICES", block)
    r = np.random.default_rng(1)
    pairs = [(i, j) for i in range(6) for j in range(i + 1, 6)]

    def side(n):
        out = {}
        for m in range(n):
            kept = pairs if m % 3 else [p for p in pairs if r.random() < 0.7]
            out[m] = {p: float(r.integers(0, 6)) if m != 1 else 2.0 for p in kept}
        out[n] = {(90 + n, 99): 1.0}
        return out

    a, b = {g: side(4) for g in "xy"}, {g: side(5) for g in "xy"}
    frame = lambda s, key: spark.createDataFrame([(g, m, i, j, d) for g, ms in s.items() for m, v in ms.items() for (i, j), d in v.items()] + [("x", 2, 70, 71, None)], f"g string, {key} int, i int, j int, d double")
    got = {(x.g, x.s, x.t): x.r for x in rdm.correlate_rdms(frame(a, "s"), frame(b, "t"), ["s"], ["t"], ["g", "i", "j"], method).collect()}
    want = {}
    for g in "xy":
        for s, p in a[g].items():
            for t, q in b[g].items():
                both = sorted(p.keys() & q.keys())
                if both:
                    m = np.array([[v[k] for k in both] for v in (p, q)])
                    if method == "spearman":
                        m = np.array([[(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v] for v in m])
                    want[g, s, t] = None if (m.max(1) == m.min(1)).any() else np.corrcoef(m)[0, 1]
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_adjusted_p_skips_missing_tests(spark, keys):
    r = np.random.default_rng(3)
    p = np.round(r.random(300), 2)
    rows = [("a", k, float(x)) for k, x in enumerate(p)] + [("a", 1000, None), ("a", 1001, float("nan")), ("a", 1002, None)]
    df = spark.createDataFrame(rows, "g string, i int, p double").repartition(3)
    order = np.argsort(-p, kind="stable")
    want = np.empty(300)
    want[order] = np.minimum(np.minimum.accumulate(p[order] * 300 / np.arange(300, 0, -1)), 1)
    got = {x.i: x.p_adjusted for x in windows.bh_adjust(df, keys).collect()}
    assert len(got) == 303 and got[1000] is got[1001] is got[1002] is None
    assert np.allclose([got[k] for k in range(300)], want)
    b = {x.i: x.p_adjusted for x in windows.bonferroni(df, keys).collect()}
    assert b[1000] is b[1001] is None and np.allclose([b[k] for k in range(300)], np.minimum(p * 300, 1))


def test_difference_test_needs_the_same_subjects(spark):
    a = spark.createDataFrame([(s, t, float(s + t)) for s in range(3) for t in range(4)], "subject int, t_idx int, value double")
    with pytest.raises(ValueError, match="2"):
        inference.cluster_difference_test(a, a.filter("subject < 2"), inference.sign_draws(spark, 3))


def test_numbered_rows(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as x").repartition(7)
    assert all(r.place == r.x + 1 for r in windows.numbered(df, [F.col("x").asc()]).collect())
    assert windows.numbered(df.limit(0), [F.col("x").asc()]).count() == 0


@pytest.mark.parametrize("keys", [[], ["g"], ["g", "h"]])
def test_ranks_at_scale_equal_windows(spark, keys):
    r = np.random.default_rng(7)
    rows = [(None if x % 9 == 0 else int(x % 3), "ab"[x % 2], None if x % 50 == 0 else float(r.integers(0, 20)), x) for x in range(500)]
    df = spark.createDataFrame(rows, "g int, h string, value double, i int").repartition(5)
    a = {x.i: x.rank for x in windows.ranked(df, keys).collect()}
    assert {x.i: x.rank for x in windows.ranked_at_scale(df, keys).collect()} == a
