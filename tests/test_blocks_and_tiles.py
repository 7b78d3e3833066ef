"""Packed blocks, tiles, quantiles and labels at scale, against NumPy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stimfuse.operators import averages, blocks, inference, rdm, regression, tiles, windows
from stimfuse.sources import readers, sinks


def frame(spark, ids, **vectors):
    names = list(vectors)
    rows = [(k, i, *[None if v is None else [float(x) for x in v] for v in (vectors[n][r] for n in names)]) for r, (k, i) in enumerate(ids)]
    return spark.createDataFrame(rows, "g string, condition bigint, " + ", ".join(f"{n} array<double>" for n in names))


@pytest.fixture(scope="module")
def classes(spark):
    """Two classes, one of which is large; ties, a vector without spread."""
    r = np.random.default_rng(4)
    ids = [("a", 7 * k % 101) for k in range(37)] + [("b", k) for k in range(5)] + [("c", 3)]
    x, y = r.normal(size=(len(ids), 6)).round(1), r.normal(size=(len(ids), 6)).round(1)
    x[3] = 2.0
    return ids, x, y, frame(spark, ids, x=x, y=y)


def pairs_of(ids, g):
    mine = sorted((i, k) for k, (c, i) in enumerate(ids) if c == g)
    return [(i, j, p, q) for n, (i, p) in enumerate(mine) for j, q in mine[n + 1 :]]


def distance(u, v, metric):
    if metric == "gram":
        return u @ v
    if metric == "correlation":
        u, v = u - u.mean(), v - v.mean()
    size = np.sqrt((u @ u) * (v @ v))
    return 1 - (u @ v) / size if size > 0 else None


@pytest.mark.parametrize("block", [1024, 8, 3])
def test_tiles_have_every_pair_once(spark, classes, block):
    ids, x, y, df = classes
    parts = {"p": ("correlation", "x"), "q": ("cosine", "y"), "s": ("gram", "y")}
    tiled = tiles.tiles(df, ["g"], parts, block=block)
    got = {(r.g, r.i, r.j): (r.p, r.q, r.s) for r in tiles.pair_rows(tiled, ["g"], list(parts)).collect()}
    want = {(g, i, j): (distance(x[p], x[q], "correlation"), distance(y[p], y[q], "cosine"), distance(y[p], y[q], "gram")) for g in "abc" for i, j, p, q in pairs_of(ids, g)}
    assert got.keys() == want.keys() and len(got) == 37 * 18 + 10
    for k, v in want.items():
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(got[k], v, strict=True))
    if block < 37:
        assert tiled.filter("g = 'a'").count() > 1


@pytest.mark.parametrize("block", [1024, 8])
def test_correlations_of_distances_as_a_map(spark, classes, block):
    ids, x, y, df = classes
    got = {r.g: r.r for r in tiles.correlations(df, ["g"], {"p": ("correlation", "x"), "q": ("cosine", "y"), "s": ("gram", "y")}, block=block).collect()}
    for g in "ab":
        rows = [(distance(x[p], x[q], "correlation"), distance(y[p], y[q], "cosine"), distance(y[p], y[q], "gram")) for *_, p, q in pairs_of(ids, g)]
        for name, a, b in (("p,q", 0, 1), ("p,s", 0, 2), ("q,s", 1, 2)):
            both = np.array([(r[a], r[b]) for r in rows if r[a] is not None and r[b] is not None])
            assert abs(got[g][name] - np.corrcoef(both.T)[0, 1]) < 1e-9
        assert got[g]["p,p"] == got[g]["s,s"] == pytest.approx(1)
    assert set(got["c"]) == {"p,p", "p,q", "p,s", "q,q", "q,s", "s,s"} and set(got["c"].values()) == {None}  # no pair


def test_ranks_average_ties():
    v = np.array([3.0, 1.0, 3.0, 2.0, 3.0, 1.0])
    assert tiles.average_ranks(v).tolist() == [5.0, 1.5, 5.0, 3.0, 5.0, 1.5]
    assert tiles.rank_correlation(v, np.full(6, 2.0)) is None and tiles.rank_correlation(v, np.array([np.nan] * 5 + [1.0])) is None
    assert tiles.rank_correlation(v, np.array([1, 0, np.nan, 0.5, 1, 0])) == pytest.approx(1.0)


def rho(a, b):
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    m = np.array([rank(np.array(a)), rank(np.array(b))])
    return None if (m.max(1) == m.min(1)).any() else np.corrcoef(m)[0, 1]


@pytest.mark.parametrize("block,chunk", [(1024, 16), (5, 2)])
def test_split_halves_by_masks(spark, classes, block, chunk):
    ids, shuffles, r = classes[0], 5, np.random.default_rng(5)
    x, y = r.normal(size=(len(ids), 6)), r.normal(size=(len(ids), 6))
    df = frame(spark, ids, x=x, y=y)
    half = lambda i, s: (i * 7 + s * 13) % 11 % 2
    labels = spark.createDataFrame([(g, s, i, half(i, s)) for g, i in ids for s in range(1, shuffles + 1)], "g string, shuffle int, condition bigint, half int")
    packed = tiles.matrices(tiles.tiles(df, ["g"], {"p": ("cosine", "y"), "q": ("gram", "y"), "r": ("cosine", "x")}, block=block), ["g"], ["p", "q", "r"])
    masks = tiles.half_masks(labels, ["g"], chunk)
    assert masks.filter("g = 'a'").count() == len({s // chunk for s in range(1, shuffles + 1)})  # copies of a matrix
    got = {(r.g, r.name, r.shuffle, r.half): r.r for r in tiles.split_half_correlations(packed, masks, ["g"], ["p", "q"], "r").collect()}
    want = {}
    for g in "abc":
        for s in range(1, shuffles + 1):
            for h in (0, 1):
                some = [(p, q) for i, j, p, q in pairs_of(ids, g) if half(i, s) == half(j, s) == h]
                for name, metric in (("p", "cosine"), ("q", "gram")):
                    if some:
                        want[g, name, s, h] = rho([distance(y[p], y[q], metric) for p, q in some], [distance(x[p], x[q], "cosine") for p, q in some]) if len(some) > 1 else None
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-9) for k, v in want.items())
    counts = {(r.g, r.shuffle, r.half): r.pairs for r in rdm.within_half_counts(labels, ["g"]).collect()}
    assert counts == {(g, s, h): n for g in "abc" for s in range(1, shuffles + 1) for h in (0, 1) if (n := sum(half(i, s) == half(j, s) == h for i, j, *_ in pairs_of(ids, g)))}


@pytest.mark.parametrize("block", [1024, 6])
def test_feature_rows_and_weights_over_pairs(spark, classes, monkeypatch, block):
    ids, x, y, df = classes
    monkeypatch.setattr(tiles, "FEATURE_BLOCK", block)
    got = {(r.g, r.i, r.j, r.feature): r.d for r in rdm.single_feature_rdm(df, ["g"], 4).collect()}
    assert got == {(g, i, j, f): pytest.approx((x[p, f] - x[q, f]) ** 2) for g in "abc" for i, j, p, q in pairs_of(ids, g) for f in range(4)}
    alphas = [0.01, 1.0, 100.0]
    # ids beyond a million must not meet each other's pairs
    wide = df.withColumn("condition", F.col("condition") * 1_000_003)
    fitted = {r.g: r for r in tiles.ridge_over_pairs(wide, ["g"], "x", ("correlation", "y"), alphas, block=block).collect()}
    for g in "ab":
        pairs = pairs_of(ids, g)
        m = np.array([(x[p] - x[q]) ** 2 for *_, p, q in pairs])
        d = np.array([distance(y[p], y[q], "correlation") for *_, p, q in pairs])
        coef, intercept, alpha = regression.loo_ridge(m, d[:, None], np.array(alphas), per_target=False)
        assert fitted[g].alpha == alpha[0] and np.allclose(fitted[g].coef, coef[0]) and np.isclose(fitted[g].intercept, intercept[0])
    assert "c" not in fitted


@pytest.mark.parametrize("block,strips", [((256, 8192), 16), ((3, 11), 2), ((4, 7), 1)])
def test_models_predictions_and_scores_in_blocks(spark, block, strips):
    r = np.random.default_rng(9)
    alphas, n, p, t = [0.1, 3.0, 50.0], 40, 4, 10
    m = {g: r.normal(size=(n, p)) for g in "xy"}
    v = {g: m[g] @ r.normal(size=(p, t)) + r.normal(size=(n, t)) * np.arange(1, t + 1) for g in "xy"}
    v["y"][5, 3] = np.nan
    predictors = spark.createDataFrame([(g, k, m[g][k].tolist()) for g in "xy" for k in range(n)], "g string, condition int, x array<double>")
    responses = spark.createDataFrame([(g, k, [None if np.isnan(a) else float(a) for a in v[g][k]]) for g in "xy" for k in range(n)], "g string, condition int, y array<double>")
    shape = blocks.Shape(n, t, block, strips)
    xs, ys = blocks.pack_predictors(predictors, ["g"], shape), blocks.pack_responses(responses, ["g"], shape)
    models = blocks.fit(xs, ys, ["g"], alphas, shape)
    fitted = {(w.g, w.target): w for w in blocks.weights(models, ["g"]).collect()}
    long = responses.select("g", "condition", F.posexplode("y").alias("target", "value"))
    again = {(w.g, w.target): w for w in regression.ridge_cv(predictors, long, ["g"], alphas).collect()}
    want, predicted = {}, {}
    for g in "xy":
        for j in range(t):
            rows = np.isfinite(v[g][:, j])
            coef, intercept, alpha = regression.loo_ridge(m[g][rows], v[g][rows, j : j + 1], np.array(alphas))
            for found in (fitted, again):
                w = found[g, j]
                assert w.alpha == alpha[0] and np.allclose(w.coef, coef[0]) and np.isclose(w.intercept, intercept[0])
            other = "y" if g == "x" else "x"
            z = m[other] @ coef[0] + intercept[0]
            predicted[other, j] = z
            seen = np.isfinite(v[other][:, j])
            a, b = z[seen] - z[seen].mean(), v[other][seen, j] - v[other][seen, j].mean()
            want[other, j] = (a * b).mean() / ((a.std() + 1e-8) * (b.std() + 1e-8))
    crossed = models.withColumn("g", F.when(F.col("g") == "x", "y").otherwise("x"))
    got = {(s.g, s.target): s.r for s in blocks.score(xs, crossed, ys, ["g"], shape).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for row in blocks.predict(xs, crossed, ["g"], shape).collect():
        table = np.frombuffer(row.ys).reshape(len(row.ids), -1)
        for k, j in enumerate(row.targets):
            assert np.allclose(table[:, k], predicted[row.g, j][row.ids])


def test_predictors_are_shuffled_a_bounded_number_of_times():
    assert blocks.Shape(9000, 163842).strips == 16 and blocks.Shape(9000, 163842).t_blocks == 641 and blocks.Shape(10, 3).strips == 1


def test_batched_machines_equal_single_ones(spark, monkeypatch):
    r = np.random.default_rng(3)
    x, y = r.normal(size=(50, 10, 3)), np.repeat([1.0, -1.0], 5)
    one = np.array([regression.linear_svm(m, y) for m in x])
    assert np.allclose(regression.linear_svms(x, y), one)
    monkeypatch.setattr(regression, "DECODED", 3)
    monkeypatch.setattr(regression, "TOGETHER", 4)
    points = r.normal(size=(9, 4, 2)) + np.arange(9)[:, None, None] / 3
    rows = [(0, c, f, points[c, f].tolist()) for c in range(9) for f in range(4)] + [(0, 50, 0, [1.0, 2.0])]
    got = {(d.i, d.j): d.d for d in regression.decoding_rdm(spark.createDataFrame(rows, "t int, condition int, fold int, x array<double>"), None, ["t"], 4).collect()}
    want = {}
    for i in range(9):
        for j in range(i + 1, 9):
            hits = 0
            for k in range(4):
                rest = [f for f in range(4) if f != k]
                w = regression.linear_svm(np.vstack([points[i, rest], points[j, rest]]), np.repeat([1.0, -1.0], 3))
                hits += int(np.append(points[i, k], 1) @ w > 0) + int(np.append(points[j, k], 1) @ w <= 0)
            want[i, j] = hits / 8
    assert got == want


@pytest.mark.parametrize("salted", [False, True])
def test_quantiles_and_moments_of_large_groups(spark, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(windows, "BROADCAST", -1)
    r = np.random.default_rng(8)
    values = {"a": r.integers(0, 20, 501) / 4, "b": r.normal(size=400), None: np.array([2.0, 7.0]), "one": np.array([3.0])}
    rows = [(g, float(v), k) for g, vs in values.items() for k, v in enumerate(vs)] + [("a", None, 900), ("none", None, 901)]
    df = spark.createDataFrame(rows, "g string, value double, k int")
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {x.g: x.q for x in windows.quantiles(df, ["g"], "value", shares).collect()}
    assert got.keys() == values.keys()
    assert all(np.allclose(got[g], np.quantile(v, shares)) for g, v in values.items())
    every = np.concatenate(list(values.values()))
    assert np.allclose(windows.quantiles(df, [], "value", shares).first().q, np.quantile(every, shares))
    z = {(x.g, x.k): x.z for x in windows.zscore(df, ["g"]).collect()}
    assert len(z) == len(rows)
    for g, v in values.items():
        for k, x in enumerate(v):
            assert z[g, k] is None if v.std() == 0 else abs(z[g, k] - (x - v.mean()) / v.std()) < 1e-9
    box = {x.g: x for x in averages.box_summary(df, ["g"]).collect()}
    for g, v in values.items():
        q1, _, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert np.isclose(box[g].q1, q1) and box[g].low == inside.min() and box[g].high == inside.max()
    placed = {(x.g, x.k): x.place for x in windows.positions(df.filter("value is not null"), ["g"], ["k"]).collect()}
    assert all(placed[g, k] == k + 1 for g, v in values.items() for k in range(len(v)))


@pytest.mark.parametrize("bits", [15, 2])
def test_halves_by_threshold_equal_the_order(spark, monkeypatch, bits):
    monkeypatch.setattr(inference, "LABEL_BITS", bits)
    ids = [3 * k for k in range(61)]
    got = {(x.shuffle, x.condition): x.half for x in inference.split_labels(spark.createDataFrame([(k,) for k in ids], "condition bigint"), 4, 5).collect()}
    for s in range(4):
        order = sorted(ids, key=lambda c: (hashlib.md5(f"5:{s}:{c}".encode()).hexdigest(), c))
        assert {c: got[s, c] for c in ids} == {c: int(k >= 30) for k, c in enumerate(order)}


def test_stored_matrices_are_pruned(spark, classes, tmp_path):
    ids, x, _, df = classes
    at = str(tmp_path / "store")
    number = df.withColumn("vertex", F.ascii("g") - F.ascii(F.lit("a")))
    packed = tiles.matrices(tiles.tiles(number, ["vertex"], {"d": ("correlation", "x")}, block=8), ["vertex"], ["d"])
    sinks.write_rdm_store(tiles.stored_rows(packed, "vertex", "d"), at, 1)
    found = readers.scan_rdm_block(spark, at, 1, 2, 1)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "v_block" in plan.split("PartitionFilters")[-1].split("]")[0]
    got = {(r.i, r.j): r.d for r in tiles.unpacked_rows(found, "vertex").collect()}
    want = {(i, j): distance(x[p], x[q], "correlation") for i, j, p, q in pairs_of(ids, "b")}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-6 for k, v in want.items())
    every = tiles.unpacked_rows(spark.read.parquet(at), "vertex")
    assert every.count() == 37 * 18 + 10


def test_cluster_test_of_many_curves_against_rows(spark):
    """The packed test against means of each draw as rows, with a subject that lacks a time and one without signs."""
    r = np.random.default_rng(6)
    curves = [(k, s, t, float(r.normal() + (1.2 if 3 <= t <= 5 else 0))) for k in range(3) for s in range(6) for t in range(9) if (s, t) != (2, 4)]
    df = spark.createDataFrame(curves, "k int, subject int, t_idx int, value double")
    draws = inference.sign_draws(spark, 6)
    got = inference.cluster_permutation_test(df, draws, 0.2, 0.1, ["k"]).collect()
    null = inference.sign_flip_null(df, draws, ["k"]).cache()
    limits = {x.k: (x.low, x.high) for x in inference.pooled_thresholds(null, 0.2, ["k"]).collect()}
    want = {}
    for k in range(3):
        low, high = limits[k]
        rows = {}
        for x in null.filter(F.col("k") == k).collect():
            rows.setdefault(x.draw, {})[x.t_idx] = x.m

        def found(m):
            out, run = [], []
            for t in [*sorted(m), None]:
                if t is not None and (m[t] > high or m[t] < low):
                    run.append(t)
                elif run:
                    out.append((run[0], run[-1], sum(m[u] for u in run)))
                    run = []
            return out

        tops = [max((s for *_, s in found(m)), default=0.0) for m in rows.values()]
        for n, (a, b, s) in enumerate(found(rows[0])):
            want[k, n + 1] = (a, b, s, (sum(t >= abs(s) - 1e-12 for t in tops) + 1) / (len(tops) + 1))
    assert {(x.k, x.cluster) for x in got} == set(want) and want
    for x in got:
        a, b, s, p = want[x.k, x.cluster]
        assert (x.first, x.last) == (a, b) and abs(x.sum - s) < 1e-9 and abs(x.p - p) < 1e-12 and x.significant == (p < 0.1)
