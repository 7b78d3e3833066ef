"""Ridge regression with a penalty per target, standardisation, principal components and pairwise decoding.

Ridge models run on packed blocks (see blocks.py); ridge_cv() takes and returns plain rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stimfuse.operators import blocks, tiles

#: Targets and conditions of a block.
TARGETS, CONDITIONS = blocks.TARGETS, blocks.CONDITIONS


def loo_ridge(x: np.ndarray, y: np.ndarray, alphas: np.ndarray, per_target: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, intercepts, chosen alphas) of ridge regression with the least leave-one-out error; the first alpha on ties.

    The same as ridge_cv() for one complete block that fits in memory."""
    mx, my = x.mean(0), y.mean(0)
    u, s, vt = np.linalg.svd(x - mx, full_matrices=False)
    uy = u.T @ (y - my)
    errors = []
    for a in alphas:
        shrink = (s * s / (s * s + a))[:, None]
        h = 1 / len(x) + ((u * u) @ shrink)[:, 0]
        e = (y - my - u @ (shrink * uy)) / (1 - h)[:, None]
        errors.append((e * e).mean(0))
    errors = np.array(errors)
    best = errors.argmin(0) if per_target else np.full(y.shape[1], errors.mean(1).argmin())
    a = np.asarray(alphas)[best]
    coef = vt.T @ (s[:, None] / (s[:, None] ** 2 + a[None, :]) * uy)
    return coef.T, my - mx @ coef, a


def ridge_cv(x: DataFrame, y: DataFrame, keys: list[str], alphas: list[float], per_target: bool = True) -> DataFrame:
    """x: (keys, condition, x array), y: (keys, condition, target, value) or vectors (keys, condition, y array). One row per keys and
    target: alpha, intercept, coef.

    Conditions that one side lacks take no part; a target that misses conditions of its keys is fitted on those it has, and has no row if that is none. With a
    penalty that all targets of the keys share (per_target false), they are one block."""
    shape = blocks.Shape(blocks.most_conditions(x, keys), target_count(y) if per_target else 1, (TARGETS, CONDITIONS))
    xs, ys = blocks.pack_predictors(x, keys, shape), blocks.pack_responses(y, keys, shape)
    return blocks.weights(blocks.fit(xs, ys, keys, alphas, shape, per_target), keys)


def target_count(y: DataFrame) -> int:
    """Number of targets of responses as rows or as vectors."""
    if "y" in y.columns:
        return y.agg(F.max(F.size("y"))).first()[0] or 1
    return y.select("target").distinct().count()


def standardize_fit(vectors: DataFrame, vector: str = "x") -> DataFrame:
    """(pos, mean, scale) per feature: population standard deviation, 1 where it is 0."""
    long = vectors.select(F.posexplode(vector).alias("pos", "v"))
    sd = F.stddev_pop("v")
    return long.groupBy("pos").agg(F.avg("v").alias("mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("scale"))


def standardize_apply(vectors: DataFrame, model: DataFrame, vector: str = "x") -> DataFrame:
    """Vectors with the model's mean and scale applied. The model, one row per feature, becomes one packed row beside every vector."""
    packed = model.agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "scale"))).alias("__m"))
    z = F.zip_with(F.col(vector), F.col("__m"), lambda x, m: (x.cast("double") - m["mean"]) / m["scale"])
    return vectors.crossJoin(F.broadcast(packed)).withColumn(vector, z).drop("__m")


def gram(vectors: DataFrame, vector: str = "x") -> np.ndarray:
    """Mean and covariance sums of all vectors: one partial matrix per batch, added up by Spark; p x p numbers reach the driver."""

    def run(batches):
        for b in batches:
            m = np.asarray(b.column(0).flatten(), float).reshape(b.num_rows, -1)
            m = np.hstack([m, np.ones((len(m), 1))])
            g = m.T @ m
            i, j = np.indices(g.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(g.ravel())], names=["i", "j", "s"])

    cells = vectors.select(vector).mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    p = max(r.i for r in cells) + 1
    g = np.zeros((p, p))
    for r in cells:
        g[r.i, r.j] = r.s
    return g


def pca_fit(vectors: DataFrame, components: int, vector: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """(mean, components x p); the largest loading of each component is positive."""
    g = gram(vectors, vector)
    n, total = g[-1, -1], g[-1, :-1]
    mean = total / n
    _, basis = np.linalg.eigh(g[:-1, :-1] / n - np.outer(mean, mean))
    w = basis[:, ::-1][:, :components].T
    return mean, w * np.sign(w[np.arange(len(w)), np.abs(w).argmax(1)])[:, None]


def pca_apply(vectors: DataFrame, model: tuple[np.ndarray, np.ndarray], vector: str = "x") -> DataFrame:
    """Vectors in the coordinates of the components."""
    mean, w = model
    at = vectors.columns.index(vector)
    names, kept = vectors.columns, [f for f in vectors.schema.fields if f.name != vector]

    def run(batches):
        for b in batches:
            m = np.asarray(b.column(at).flatten(), float).reshape(b.num_rows, -1)
            z = (m - mean) @ w.T
            z = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32()), pa.array(z.ravel()))
            cols = [c for k, c in enumerate(b.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*cols, z], names=[*[n for n in names if n != vector], vector])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], f"`{vector}` array<double>"])
    return vectors.mapInArrow(run, schema)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a linear machine: squared hinge, L2, bias regularised as one more feature; y is -1 or 1."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, last = np.zeros(a.shape[1]), None
    for _ in range(rounds):
        inside = y * (a @ w) < 1
        if last is not None and (inside == last).all():
            break
        last = inside
        b = a[inside]
        w = np.linalg.solve(np.eye(a.shape[1]) / (2 * c) + b.T @ b, b.T @ y[inside])
    return w


def linear_svms(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 30) -> np.ndarray:
    """linear_svm() of many problems at once: x (problems, rows, features), y (rows). One batched solve per round for those not settled."""
    a = np.concatenate([x, np.ones((*x.shape[:2], 1))], axis=2)
    w, last = np.zeros((len(a), a.shape[2])), np.zeros(a.shape[:2], bool)
    open_ = np.arange(len(a))
    for turn in range(rounds):
        mine = a[open_]
        inside = y * np.einsum("pmi,pi->pm", mine, w[open_]) < 1
        if turn:
            moved = (inside != last[open_]).any(1)
            open_, mine, inside = open_[moved], mine[moved], inside[moved]
        if not len(open_):
            break
        last[open_] = inside
        held = mine * inside[:, :, None]
        w[open_] = np.linalg.solve(np.eye(a.shape[2]) / (2 * c) + held.transpose(0, 2, 1) @ mine, np.einsum("pmi,m->pi", held, y)[:, :, None])[:, :, 0]
    return w


#: Conditions of a block, and pairs that are fitted together.
DECODED, TOGETHER = 256, 1024


def decoding_rdm(pseudo: DataFrame, pairs: DataFrame | None, keys: list[str], folds: int) -> DataFrame:
    """pseudo: (keys, condition, fold, x array). Per keys and pair i < j (of `pairs`, or all): mean accuracy over folds, each of which leaves the
    two conditions' pseudo-trials of one number out. Folds are fixed by number, so the result can be repeated; conditions that lack a fold
    take no part. A task holds the pseudo-trials of two blocks of conditions once and fits all their pairs in batched solves."""
    packed = pseudo.groupBy(*keys, "condition").agg(F.transform(F.array_sort(F.collect_list(F.struct("fold", "x"))), lambda s: s["x"]).alias("x")).filter(F.size("x") == folds)
    flat = packed.withColumn("x", F.flatten("x"))
    kind = to_arrow_type(flat.schema["condition"].dataType)

    def fit(a: tiles.Side, b: tiles.Side) -> dict:
        at, other = tiles.pair_places(a.ids, b.ids, a is b)
        left, right = np.asarray(a.ids)[at], np.asarray(b.ids)[other]
        first, second = a.parts["x"].reshape(len(a.ids), folds, -1), b.parts["x"].reshape(len(b.ids), folds, -1)
        swapped = left > right
        d = np.zeros(len(at))
        for lo in range(0, len(at), TOGETHER):
            s = slice(lo, lo + TOGETHER)
            turn = swapped[s, None, None]
            p, q = first[at[s]], second[other[s]]
            p, q = np.where(turn, q, p), np.where(turn, p, q)
            for k in range(folds):
                rest = [f for f in range(folds) if f != k]
                w = linear_svms(np.concatenate([p[:, rest], q[:, rest]], axis=1), np.repeat([1.0, -1.0], folds - 1))
                hit = lambda v: np.einsum("pi,pi->p", v, w[:, :-1]) + w[:, -1] > 0  # noqa: E731, B023
                d[s] += hit(p[:, k]).astype(int) + ~hit(q[:, k])
        return {"i": pa.array(np.where(swapped, right, left), kind), "j": pa.array(np.where(swapped, left, right), kind), "d": pa.array(d / (2 * folds))}

    c = flat.schema["condition"].dataType.simpleString()
    found = tiles.meet(tiles.packed_blocks(flat, keys, {"x": ("raw", "x")}, block=DECODED), keys, ["x"], fit, f"i {c}, j {c}, d double").drop("low", "high")
    return found if pairs is None else found.join(pairs, ["i", "j"], "left_semi").select(*keys, "i", "j", "d")
