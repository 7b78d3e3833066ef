"""Ridge models in blocks, and the encoding and two-stage queries, against NumPy on whole tables."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stimfuse.operators import regression
from stimfuse.plans import models

DATA = Path("/root/testdata/sf0.001")
given = pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")


def brute_ridge(x, y, alphas):
    """Alpha, intercept and coefficients of one target, each leave-one-out model refitted."""
    best = None
    for a in alphas:
        error = 0.0
        for k in range(len(x)):
            keep = np.arange(len(x)) != k
            mx, my = x[keep].mean(0), y[keep].mean()
            z = x[keep] - mx
            w = np.linalg.solve(z.T @ z + a * np.eye(x.shape[1]), z.T @ (y[keep] - my))
            error += (y[k] - my - (x[k] - mx) @ w) ** 2
        if best is None or error < best[0] * (1 - 1e-12):
            best = error, a
    z = x - x.mean(0)
    w = np.linalg.solve(z.T @ z + best[1] * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return best[1], y.mean() - x.mean(0) @ w, w


@pytest.mark.parametrize("targets,conditions", [(256, 8192), (3, 11)])
def test_ridge_in_blocks_equals_brute_force(spark, monkeypatch, targets, conditions):
    monkeypatch.setattr(regression, "TARGETS", targets)
    monkeypatch.setattr(regression, "CONDITIONS", conditions)
    r = np.random.default_rng(2)
    alphas = [0.01, 1.0, 10.0, 100.0]
    x, y, want = [], [], {}
    for t in (0, 1):
        m = r.normal(size=(40, 4))
        v = m @ r.normal(size=(4, 7)) + r.normal(size=(40, 7)) * np.array([0.1, 0.5, 1, 3, 9, 1, 1])
        v[r.random((40, 7)) < np.array([0, 0, 0, 0.1, 0.2, 0, 0.3])] = np.nan
        x += [(t, k, m[k].tolist()) for k in range(40)] + [(t, 900 + t, [9.0] * 4)]  # a condition that the other side lacks
        y += [(t, k, j, float(v[k, j])) for k in range(40) for j in range(7) if (k + j) % 9 or j < 5] + [(t, 1000, 0, 5.0), (t, 3, 99, None)]
        for j in range(7):
            rows = [k for k in range(40) if np.isfinite(v[k, j]) and ((k + j) % 9 or j < 5)]
            want[t, j] = brute_ridge(m[rows], v[rows, j], alphas)
    got = regression.ridge_cv(spark.createDataFrame(x, "t int, condition int, x array<double>"), spark.createDataFrame(y, "t int, condition int, target int, value double"), ["t"], alphas).collect()
    assert {(g.t, g.target) for g in got} == set(want)
    for g in got:
        a, b, w = want[g.t, g.target]
        assert g.alpha == a and np.isclose(g.intercept, b) and np.allclose(g.coef, w)


def test_shared_penalty_and_no_rows(spark):
    r = np.random.default_rng(5)
    m = r.normal(size=(30, 3))
    v = m @ r.normal(size=(3, 4)) + r.normal(size=(30, 4)) * [0.1, 1, 3, 9]
    x = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(m)], "condition int, x array<double>").withColumn("g", F.lit("a"))
    y = spark.createDataFrame([(k, j, float(v[k, j])) for k in range(30) for j in range(4)], "condition int, target int, value double").withColumn("g", F.lit("a"))
    alphas = np.array([0.1, 1.0, 10.0])
    got = regression.ridge_cv(x, y, ["g"], alphas.tolist(), per_target=False).orderBy("target").collect()
    coef, intercept, alpha = regression.loo_ridge(m, v, alphas, per_target=False)
    assert [g.alpha for g in got] == alpha.tolist() and np.allclose([g.coef for g in got], coef) and np.allclose([g.intercept for g in got], intercept)
    assert regression.ridge_cv(x.limit(0), y, ["g"], [1.0]).count() == 0 == regression.ridge_cv(x, y.limit(0), ["g"], [1.0]).count()


def table():
    import pyarrow.parquet as pq

    t = pq.read_table(DATA / "embeddings.parquet").to_pydict()
    return np.array(t["vec_id"]), np.array(t["embedding"], float)


def fit(x, y, alphas=models.ALPHAS):
    coef, intercept, _ = regression.loo_ridge(x, y, np.array(alphas))
    return lambda z: z @ coef.T + intercept


def scores(predicted, y):
    p, q = predicted - predicted.mean(0), y - y.mean(0)
    return (p * q).mean(0) / ((p.std(0) + 1e-8) * (q.std(0) + 1e-8))


def halves(ids):
    return {"even": ids % 2 == 0, "odd": ids % 2 == 1}


def same(got, want, keys):
    assert {tuple(g[k] for k in keys) for g in got} == set(want)
    assert all(abs(g.r - want[tuple(g[k] for k in keys)]) < 5e-6 for g in got)


@given
def test_encoding_fusion_equals_numpy(spark):
    ids, e = table()
    x, y, h = e[:, :8], e[:, 32:48], halves(ids)
    want = {(b, j): r for a, b in (("even", "odd"), ("odd", "even")) for j, r in enumerate(scores(fit(x[h[a]], y[h[a]])(x[h[b]]), y[h[b]]))}
    same(models.QUERIES["encoding_fusion"](spark, str(DATA)).collect(), want, ["half", "target"])


@given
def test_encoding_split_half_equals_numpy(spark):
    ids, e = table()
    x, y, want = e[:, :8], e[:, 32:48], {}
    for s in (1, 2, 3):
        half = (ids * 7 + s * 13) % 11 % 2
        for b in (0, 1):
            r = scores(fit(x[half != b], y[half != b])(x[half == b]), y[half == b])
            want |= {(s, str(b), j): v for j, v in enumerate(r)}
    same(models.QUERIES["encoding_split_half"](spark, str(DATA)).collect(), want, ["shuffle", "half", "target"])


@given
def test_two_stages_equal_numpy(spark):
    ids, e = table()
    x, y, h = e[:, :8], e[:, 32:48], halves(ids)

    def transfer(f):
        out = {}
        for a, b in (("even", "odd"), ("odd", "even")):  # stage 1 learns on a and predicts b; stage 2 learns on b and is scored on a
            made = fit(x[h[a]], y[h[a]])(x[h[b]])
            out |= {(a, j): r for j, r in enumerate(scores(fit(f[h[b]], made)(f[h[a]]), y[h[a]]))}
        return out

    same(models.QUERIES["two_stage_transfer"](spark, str(DATA)).collect(), transfer(e[:, 16:26]), ["half", "target"])
    want = {(layer, *k): r for layer, first in enumerate((8, 16, 24)) for k, r in transfer(e[:, first : first + 8]).items()}
    same(models.QUERIES["two_stage_layerwise"](spark, str(DATA)).collect(), want, ["layer", "half", "target"])
    alphas = [10.0 ** (-6 + 9 * k / 19) for k in range(20)]
    want = {}
    for a in h:
        _, intercept, alpha = regression.loo_ridge(x[h[a]], y[h[a]], np.array(alphas))
        want |= {(a, j): (round(float(alpha[j]), 6), float(intercept[j])) for j in range(16)}
    for g in models.QUERIES["two_stage_fit"](spark, str(DATA)).collect():
        assert g.alpha == want[g.half, g.target][0] and abs(g.intercept - want[g.half, g.target][1]) < 2e-6


@given
def test_reweighting_equals_numpy(spark):
    ids, e = table()
    import pyarrow.parquet as pq

    labels = np.array(pq.read_table(DATA / "embeddings.parquet").column("label"))
    alphas = np.array([10.0 ** (-6 + 11 * k / 29) for k in range(30)])
    for g in models.QUERIES["ridge_cv_single"](spark, str(DATA)).collect():
        mine = e[labels == g.label]
        i, j = np.triu_indices(len(mine), 1)
        x = (mine[i, :4] - mine[j, :4]) ** 2
        y = 1 - np.corrcoef(mine[:, 32:48])[i, j]
        coef, intercept, alpha = regression.loo_ridge(x, y[:, None], alphas, per_target=False)
        assert abs(g.alpha - alpha[0]) < 1e-6 * max(1, alpha[0]) and abs(g.intercept - intercept[0]) < 2e-6 and np.allclose(g.coef, coef[0], atol=2e-6)
