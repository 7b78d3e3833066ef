"""Ridge models, predictions and their scores on packed blocks, with no row per condition and target.

Predictors lie in blocks of CONDITIONS conditions, responses in blocks of CONDITIONS conditions and TARGETS targets, each packed once.
A predictor block and the response blocks of the same conditions meet in one stream: the predictors come first and stay, the
responses pass by. Targets are spread over STRIPS streams at most, so predictors are shuffled that often, however many targets there are.

Of the conditions that responses use, the Gram matrix and its eigenbasis are made once per keys (the factor table); all targets without
gaps share them, others get those of their own conditions. A first stream sums products of predictors and responses, which solve the
models; a second one sums the leave-one-out errors of every penalty. Predictions are blocks again, so that they can be responses of
another model; scores keep only sums per target.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stimfuse.session import checkpointed

#: Targets and conditions of a block; streams over which the targets of a predictor block are spread.
TARGETS, CONDITIONS, STRIPS = 256, 8192, 16


class Shape:
    """How many blocks conditions and targets are dealt into; what meets must have one shape."""

    def __init__(self, conditions: int, targets: int, block: tuple[int, int] = (TARGETS, CONDITIONS), strips: int = STRIPS):
        self.targets = block[0]
        self.t_blocks, self.c_blocks = max(1, -(-targets // block[0])), max(1, -(-conditions // block[1]))
        self.strips = min(strips, self.t_blocks)

    def c_block(self):
        return F.pmod(F.xxhash64("condition"), F.lit(self.c_blocks)).cast("int").alias("c_block")


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return "".join(f"`{k}` {types[k]}, " for k in keys)


def _keyed(names: list[str], key: tuple, n: int = 1) -> dict:
    return {k: pa.array([v.as_py()] * n, v.type) for k, v in zip(names, key, strict=False)}


def most_conditions(x: DataFrame, keys: list[str]) -> int:
    return x.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1


def pack_predictors(x: DataFrame, keys: list[str], shape: Shape) -> DataFrame:
    """x (keys, condition, x array): one row per (keys, c_block) with ids, in order, and xs, the packed vectors."""

    def pack(key, t):
        ids = np.asarray(t.column("condition")).astype(np.int64)
        order = np.argsort(ids, kind="stable")
        flat = np.asarray(t.column("x").combine_chunks().flatten(), float).reshape(len(ids), -1)[order]
        return pa.table({**_keyed(at, key), "ids": pa.array([ids[order].tolist()], pa.list_(pa.int64())), "xs": pa.array([flat.tobytes()], pa.binary())})

    at = [*keys, "c_block"]
    rows = x.select(*keys, F.col("condition").cast("bigint").alias("condition"), "x", shape.c_block())
    return rows.groupBy(*at).applyInArrow(pack, f"{_key_schema(x, keys)}c_block int, ids array<bigint>, xs binary")


RESPONSES = "c_block int, t_block int, ids array<bigint>, targets array<{0}>, ys binary, finite bigint"


def _response_row(ids: np.ndarray, names: list, target_type: pa.DataType, table: np.ndarray) -> dict:
    seen = np.isfinite(table).any(1) if table.shape[1] else np.zeros(len(ids), bool)
    full = int(bool(seen.any()))
    table = table[seen]
    return {
        "ids": pa.array([ids[seen].tolist()] * full, pa.list_(pa.int64())),
        "targets": pa.array([list(names)] * full, pa.list_(target_type)),
        "ys": pa.array([table.tobytes()] * full, pa.binary()),
        "finite": pa.array([int(np.isfinite(table).sum())] * full, pa.int64()),
    }


def pack_responses(y: DataFrame, keys: list[str], shape: Shape) -> DataFrame:
    """y as long rows (keys, condition, target, value), or with vectors (keys, condition, y array) whose places are the targets, from 0.
    One row per (keys, c_block, t_block): ids of conditions with a value, in order, targets, and ys, the packed table with NaN in gaps."""
    at = [*keys, "c_block", "t_block"]
    if "y" in y.columns:
        n = shape.targets
        parts = F.transform(F.sequence(F.lit(0), F.lit(shape.t_blocks - 1)), lambda b: F.slice("y", b * n + 1, n))
        rows = y.select(*keys, F.col("condition").cast("bigint").alias("condition"), shape.c_block(), F.posexplode(parts).alias("t_block", "part"))

        def pack_vectors(key, t):
            ids = np.asarray(t.column("condition")).astype(np.int64)
            order = np.argsort(ids, kind="stable")
            table = np.asarray(t.column("part").combine_chunks().flatten().cast(pa.float64()).fill_null(np.nan)).reshape(len(ids), -1)[order]
            table = np.where(np.isfinite(table), table, np.nan)
            row = _response_row(ids[order], (np.arange(table.shape[1]) + key[-1].as_py() * n).tolist(), pa.int32(), table)
            return pa.table({**{k: v[: len(row["ids"])] for k, v in _keyed(at, key).items()}, **row})

        return rows.groupBy(*at).applyInArrow(pack_vectors, _key_schema(y, keys) + RESPONSES.format("int"))
    target_type = y.schema["target"].dataType
    rows = y.select(*keys, F.col("condition").cast("bigint").alias("condition"), "target", F.col("value").cast("double").alias("value"), shape.c_block(), F.pmod(F.xxhash64("target"), F.lit(shape.t_blocks)).cast("int").alias("t_block"))
    arrow_type = to_arrow_type(target_type)

    def pack(key, t):
        value = np.asarray(t.column("value"), float)
        met = np.isfinite(value)
        ids, row = np.unique(np.asarray(t.column("condition")).astype(np.int64)[met], return_inverse=True)
        names, col = np.unique(np.asarray(t.column("target"))[met], return_inverse=True)
        table = np.full((len(ids), len(names)), np.nan)
        table[row, col] = value[met]
        made = _response_row(ids, names.tolist(), arrow_type, table)
        return pa.table({**{k: v[: len(made["ids"])] for k, v in _keyed(at, key).items()}, **made})

    return rows.groupBy(*at).applyInArrow(pack, _key_schema(y, keys) + RESPONSES.format(target_type.simpleString()))


def _streamed(first: DataFrame, then: DataFrame, at: list[str], strips: int, prepare: Callable, step: Callable, schema: str) -> DataFrame:
    """For each row of `then`, step(prepared, row): prepared is prepare(row) of the row of `first` with equal `at`. Rows of `then`
    (which have a t_block) are dealt over `strips` streams; a stream is sorted so that its row of `first` comes before them."""
    a_cols, b_cols = [c for c in first.columns if c not in at], [c for c in then.columns if c not in at]
    a = first.select(*at, F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("__strip"), F.lit(0).alias("__side"), F.struct(*a_cols).alias("__a"), F.lit(None).cast(then.select(F.struct(*b_cols).alias("b")).schema["b"].dataType).alias("__b"))
    b = then.select(*at, F.pmod("t_block", F.lit(strips)).cast("int").alias("__strip"), F.lit(1).alias("__side"), F.lit(None).cast(a.schema["__a"].dataType).alias("__a"), F.struct(*b_cols).alias("__b"))
    deal = [*at, "__strip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                key = tuple(row.column(c)[0].as_py() for c in deal)
                if row.column("__side")[0].as_py() == 0:
                    held, of = prepare(row.column("__a")[0].as_py()), key
                elif of == key:
                    found = step(held, row.column("__b")[0].as_py())
                    if found is not None:
                        keyed = [row.column(c) for c in at]
                        yield pa.RecordBatch.from_arrays([*keyed, *found.values()], names=[*at, *found])

    return a.unionByName(b).repartition(*deal).sortWithinPartitions(*deal, "__side").mapInArrow(run, schema)


def _matrix(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data).reshape(rows, -1) if rows else np.zeros((0, 0))


class Basis:
    """Number of conditions, means of the predictors, and eigenvalues and eigenvectors of their centred Gram matrix."""

    def __init__(self, gram: np.ndarray):
        self.n = gram[-1, -1]
        self.mean = gram[-1, :-1] / self.n
        values, basis = np.linalg.eigh(gram[:-1, :-1] - self.n * np.outer(self.mean, self.mean))
        kept = values > 1e-13 * max(values[-1], 1e-300)
        self.values, self.basis = values[kept], basis[:, kept]

    def turned(self, x: np.ndarray, alphas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Predictors in the basis, and what leaving a condition out leaves of its weight, for each penalty."""
        z = (x - self.mean) @ self.basis
        return z, 1 - 1 / self.n - (z * z) @ (1 / (self.values[:, None] + alphas[None, :]))


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(x, 1)'y."""
    return np.vstack([x.T @ y, y.sum(0)])


def _gram(x: np.ndarray) -> np.ndarray:
    one = np.hstack([x, np.ones((len(x), 1))])
    return one.T @ one


def _at(ids: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ids, and in other, of what both have; both are in order and without repeats."""
    _, p, q = np.intersect1d(ids, other, assume_unique=True, return_indices=True)
    return p, q


def fit(xs: DataFrame, ys: DataFrame, keys: list[str], alphas: list[float], shape: Shape, per_target: bool = True) -> DataFrame:
    """Models of packed responses: per (keys, t_block) the targets, their alpha, coef (packed, targets x predictors) and intercept.

    The penalty with the least leave-one-out error is chosen for each target (the first on ties), or for all targets of a block together.
    Conditions that one side lacks take no part; a target is fitted on the conditions that it has."""
    values = np.asarray(alphas, float)
    at, group = [*keys, "c_block"], [*keys, "t_block"]
    target_type = ys.schema["targets"].dataType.elementType
    arrow_type = to_arrow_type(target_type)
    ys = checkpointed(ys)
    # most blocks of targets have the same conditions: equal lists become one before they meet
    seen = ys.groupBy(*at, F.xxhash64("ids").alias("__h"), F.size("ids").alias("__n")).agg(F.first("ids").alias("ids"))

    def cut(key, a, b):
        if not a.num_rows or not b.num_rows:
            return pa.table({**{k: v[:0] for k, v in _keyed(at, key).items()}, "ids": pa.array([], pa.list_(pa.int64())), "xs": pa.array([], pa.binary()), "gram": pa.array([], pa.binary())})
        ids = np.asarray(a.column("ids").combine_chunks().flatten())
        used = np.isin(ids, np.asarray(b.column("ids").combine_chunks().flatten()))
        x = _matrix(a.column("xs")[0].as_py(), len(ids))[used]
        n = int(used.any())
        return pa.table({**{k: v[:n] for k, v in _keyed(at, key).items()}, "ids": pa.array([ids[used].tolist()][:n], pa.list_(pa.int64())), "xs": pa.array([x.tobytes()][:n], pa.binary()), "gram": pa.array([_gram(x).tobytes()][:n], pa.binary())})

    schema = _key_schema(xs, keys)
    xs = checkpointed(xs.groupBy(*at).cogroup(seen.groupBy(*at)).applyInArrow(cut, f"{schema}c_block int, ids array<bigint>, xs binary, gram binary"))

    def factor(key, t):
        grams = [np.frombuffer(g) for g in t.column("gram").to_pylist()]
        p = int(np.sqrt(len(grams[0])))
        return pa.table({**_keyed(keys, key), "factor": pa.array([pickle.dumps(Basis(sum(grams).reshape(p, p)))], pa.binary())})

    factors = checkpointed(xs.groupBy(*keys).applyInArrow(factor, f"{schema}factor binary"))
    # whether any target has gaps: then blocks send their Gram matrices along, else the factor table has all that is needed
    sizes = xs.select(*at, F.size("ids").alias("__rows"))
    each = ys.select(*at, "t_block", F.size("targets").alias("__t"), "finite").join(sizes, at)
    whole = each.groupBy(*group).agg(F.count("*").alias("__blocks"), F.min(F.col("finite") == F.col("__rows") * F.col("__t")).alias("__full"), F.min("__t").alias("__low"), F.max("__t").alias("__high"))
    gaps = whole.join(sizes.groupBy(*keys).agg(F.count("*").alias("__all")), keys).filter(~F.col("__full") | (F.col("__blocks") != F.col("__all")) | (F.col("__low") != F.col("__high")))
    ragged = gaps.limit(1).count() > 0

    def predictors(row):
        return np.asarray(row["ids"], np.int64), _matrix(row["xs"], len(row["ids"])), np.frombuffer(row["gram"])

    def parts_of(table: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, columns) of the parts of a block in which all targets have the same conditions."""
        finite = np.isfinite(table)
        kinds, which = np.unique(finite, axis=1, return_inverse=True)
        which = which.ravel()
        return [(np.flatnonzero(kinds[:, k]), np.flatnonzero(which == k)) for k in range(kinds.shape[1]) if kinds[:, k].any()]

    def aligned(ids, row):
        """The table of a response block on the rows of the predictor block."""
        table = np.full((len(ids), len(row["targets"])), np.nan)
        p, q = _at(ids, np.asarray(row["ids"], np.int64))
        table[p] = _matrix(row["ys"], len(row["ids"]))[q]
        return table

    def sums(held, row):
        ids, x, gram = held
        table, out = aligned(ids, row), []
        for rows, cols in parts_of(table, len(ids)):
            own = None
            if ragged:
                own = gram if len(rows) == len(ids) else _gram(x[rows]).ravel()
            out.append((cols, own, len(rows), _products(x[rows], table[np.ix_(rows, cols)])))
        return {"t_block": pa.array([row["t_block"]], pa.int32()), "targets": pa.array([row["targets"]], pa.list_(arrow_type)), "sums": pa.array([pickle.dumps(out)], pa.binary())} if out else None

    def solve(key, t):
        # a block of conditions may lack some of the targets: they are numbered anew
        base = pickle.loads(t.column("factor")[0].as_py())
        parts = [(own, pickle.loads(s)) for own, s in zip(t.column("targets").to_pylist(), t.column("sums").to_pylist(), strict=True)]
        names = sorted({c for own, _ in parts for c in own})
        number = {c: i for i, c in enumerate(names)}
        flat = [(np.array([number[own[c]] for c in cols]), g, n, w) for own, found in parts for cols, g, n, w in found]
        of: list[list[int]] = [[] for _ in names]
        for k, (cols, *_) in enumerate(flat):
            for c in cols:
                of[c].append(k)
        alike: dict[tuple, list[int]] = {}
        for c, ks in enumerate(of):
            if ks:
                alike.setdefault(tuple(ks), []).append(c)
        models = []
        for ks, cols in alike.items():
            place = {c: i for i, c in enumerate(cols)}
            with_y = np.zeros((flat[ks[0]][3].shape[0], len(cols)))
            for k in ks:
                mine = [i for i, c in enumerate(flat[k][0]) if c in place]
                with_y[:, [place[flat[k][0][i]] for i in mine]] += flat[k][3][:, mine]
            shared = sum(flat[k][2] for k in ks) == base.n
            p = with_y.shape[0]
            basis = base if shared else Basis(sum(flat[k][1] for k in ks).reshape(p, p))
            my = with_y[-1] / basis.n
            models.append((np.array(cols), None if shared else basis, my, basis.basis.T @ (with_y[:-1] - basis.n * np.outer(basis.mean, my))))
        return pa.table({**_keyed(group, key), "model": pa.array([pickle.dumps((names, models))], pa.binary())})

    products = _streamed(xs, ys, at, shape.strips, predictors, sums, f"{schema}c_block int, t_block int, targets array<{target_type.simpleString()}>, sums binary")
    models = checkpointed(products.join(factors, keys).groupBy(*group).applyInArrow(solve, f"{schema}t_block int, model binary"))

    def turned(row):
        ids, x, _ = predictors(row)
        basis = pickle.loads(row["factor"])
        return ids, x, basis, basis.turned(x, values)

    def errors(held, row):
        ids, x, base, ready = held
        names, models = pickle.loads(row["model"])
        table = np.full((len(ids), len(names)), np.nan)
        number = {c: i for i, c in enumerate(names)}
        known = [k for k, c in enumerate(row["targets"]) if c in number]
        table[:, [number[row["targets"][k]] for k in known]] = aligned(ids, row)[:, known]
        total = np.zeros((len(values), len(names)))
        for cols, own, my, turned_y in models:
            basis, (z, left) = (base, ready) if own is None else (own, own.turned(x, values))
            y = table[:, cols] - my
            has = np.isfinite(y)
            for k, a in enumerate(values):
                e = (y - z @ (turned_y / (basis.values + a)[:, None])) / left[:, k : k + 1]
                total[k, cols] += np.where(has, e * e, 0).sum(0)
        return {"t_block": pa.array([row["t_block"]], pa.int32()), "errors": pa.array([total.tobytes()], pa.binary())}

    errs = _streamed(xs.join(factors, keys), ys.join(models, group), at, shape.strips, turned, errors, f"{schema}c_block int, t_block int, errors binary")

    def choose(key, a, b):
        names, models = pickle.loads(a.column("model")[0].as_py())
        base = pickle.loads(a.column("factor")[0].as_py())
        total = sum(np.frombuffer(e).reshape(len(values), -1) for e in b.column("errors").to_pylist())
        picked, coef, intercept = np.zeros(len(names)), np.zeros((len(names), len(base.mean))), np.zeros(len(names))
        for cols, own, my, turned_y in models:
            basis = base if own is None else own
            mean = total[:, cols] / basis.n
            best = mean.argmin(0) if per_target else np.full(len(cols), mean.mean(1).argmin())
            picked[cols] = values[best]
            w = (basis.basis @ (turned_y / (basis.values[:, None] + values[best][None, :]))).T
            coef[cols], intercept[cols] = w, my - w @ basis.mean
        lists = lambda x: pa.array([x.tolist()], pa.list_(pa.float64()))
        return pa.table({**_keyed(group, key), "targets": pa.array([names], pa.list_(arrow_type)), "alpha": lists(picked), "intercept": lists(intercept), "coef": pa.array([coef.tobytes()], pa.binary())})

    done = models.join(factors, keys).groupBy(*group).cogroup(errs.groupBy(*group))
    return done.applyInArrow(choose, f"{schema}t_block int, targets array<{target_type.simpleString()}>, alpha array<double>, intercept array<double>, coef binary")


def weights(models: DataFrame, keys: list[str]) -> DataFrame:
    """Models as rows (keys, target, alpha, intercept, coef array)."""
    target_type = models.schema["targets"].dataType.elementType
    arrow_type = to_arrow_type(target_type)

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                names = b.column("targets")[k].as_py()
                coef = _matrix(b.column("coef")[k].as_py(), len(names))
                at = pa.array([k] * len(names), pa.int64())
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in keys], pa.array(names, arrow_type), b.column("alpha")[k].values, b.column("intercept")[k].values, pa.array(coef.tolist(), pa.list_(pa.float64()))], names=[*keys, "target", "alpha", "intercept", "coef"])

    return models.mapInArrow(run, f"{_key_schema(models, keys)}target {target_type.simpleString()}, alpha double, intercept double, coef array<double>")


def _predictors(row):
    return np.asarray(row["ids"], np.int64), _matrix(row["xs"], len(row["ids"]))


def _predicted(x: np.ndarray, row: dict, names: list) -> np.ndarray:
    return x @ _matrix(row["coef"], len(names)).T + np.asarray(row["intercept"])


def predict(xs: DataFrame, models: DataFrame, keys: list[str], shape: Shape) -> DataFrame:
    """Responses that models predict for packed predictors, packed as by pack_responses()."""
    at = [*keys, "c_block"]
    target_type = models.schema["targets"].dataType.elementType
    arrow_type = to_arrow_type(target_type)

    def step(held, row):
        ids, x = held
        names = row["targets"]
        made = _response_row(ids, names, arrow_type, _predicted(x, row, names))
        return {"t_block": pa.array([row["t_block"]], pa.int32()), **made} if len(made["ids"]) else None

    each = models.select(*keys, "t_block", "targets", "intercept", "coef").join(xs.select(*at), keys)
    return _streamed(xs, each, at, shape.strips, _predictors, step, _key_schema(xs, keys) + RESPONSES.format(target_type.simpleString()))


def score(xs: DataFrame, models: DataFrame, ys: DataFrame, keys: list[str], shape: Shape, eps: float = 1e-8) -> DataFrame:
    """Per keys and target, r of what models predict with the responses: cov / ((sd + eps) (sd + eps)). Blocks give counts, means and
    sums of squares about them, which are merged."""
    at, group = [*keys, "c_block"], [*keys, "t_block"]
    target_type = models.schema["targets"].dataType.elementType
    arrow_type = to_arrow_type(target_type)

    def step(held, row):
        ids, x = held
        names = row["names"]
        number = {c: i for i, c in enumerate(names)}
        both = [(k, number[c]) for k, c in enumerate(row["targets"]) if c in number]
        p, q = _at(ids, np.asarray(row["ids"], np.int64))
        if not both or not len(p):
            return None
        mine, own = map(list, zip(*both, strict=True))
        y = _matrix(row["ys"], len(row["ids"]))[q][:, mine]
        z = np.where(np.isfinite(y), _predicted(x[p], row, names)[:, own], np.nan)
        n = np.isfinite(y).sum(0)
        with np.errstate(invalid="ignore", divide="ignore"):
            my, mz = np.nansum(y, 0) / n, np.nansum(z, 0) / n
        y, z = np.where(np.isfinite(y), y - my, 0), np.where(np.isfinite(y), z - mz, 0)
        stats = np.stack([n, my, mz, (y * y).sum(0), (z * z).sum(0), (y * z).sum(0)])
        return {"t_block": pa.array([row["t_block"]], pa.int32()), "targets": pa.array([[row["targets"][k] for k in mine]], pa.list_(arrow_type)), "stats": pa.array([stats.tobytes()], pa.binary())}

    def merge(key, t):
        total: dict = {}
        for names, data in zip(t.column("targets").to_pylist(), t.column("stats").to_pylist(), strict=True):
            for c, (n, my, mz, yy, zz, yz) in zip(names, np.frombuffer(data).reshape(6, -1).T.tolist(), strict=True):
                if not n:
                    continue
                m, oy, oz, a, b, ab = total.get(c, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
                dy, dz, both = my - oy, mz - oz, m + n
                f = m * n / both
                total[c] = both, oy + dy * n / both, oz + dz * n / both, a + yy + dy * dy * f, b + zz + dz * dz * f, ab + yz + dy * dz * f
        r = [ab / m / ((np.sqrt(a / m) + eps) * (np.sqrt(b / m) + eps)) for m, _, _, a, b, ab in total.values()]
        return pa.table({**_keyed(keys, key, len(total)), "target": pa.array(list(total), arrow_type), "r": pa.array(r, pa.float64())})

    schema = _key_schema(xs, keys)
    each = ys.join(models.select(*group, F.col("targets").alias("names"), "intercept", "coef"), group).drop("finite")
    found = _streamed(xs, each, at, shape.strips, _predictors, step, f"{schema}c_block int, t_block int, targets array<{target_type.simpleString()}>, stats binary")
    return found.groupBy(*group).applyInArrow(merge, f"{schema}target {target_type.simpleString()}, r double")
