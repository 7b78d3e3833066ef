"""Inference across subjects: tests, corrections, cluster permutation, bootstrap, peaks and winners.

Random draws are rows of a draw table, joined to the subjects, so results can be repeated and written in SQL. The draw tables are
small (draws x subjects); what grows with the data is the curve table, which is aggregated before it meets them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stimfuse.functions.stats import fisher_z, t_two_sided
from stimfuse.operators.windows import beside, bh_adjust, bonferroni, cluster_label, quantiles
from stimfuse.session import checkpointed


def counted(spark: SparkSession, subjects: int | DataFrame) -> DataFrame:
    """One row (subjects): the number itself, or that of a table with the numbered subjects."""
    return spark.range(1).select(F.lit(subjects).alias("subjects")) if isinstance(subjects, int) else subjects.agg((F.max("subject") + 1).cast("int").alias("subjects"))


def sign_draws(spark: SparkSession, subjects: int | DataFrame, draws: int | None = None) -> DataFrame:
    """(draw, subject, sign): all sign patterns (bit k of the draw's number), or the first `draws` of a hash of (draw, subject)."""
    n = counted(spark, subjects)
    each = F.explode(F.sequence(F.lit(0), F.col("subjects") - 1)).alias("subject")
    if draws is None:
        grid = n.select("subjects", F.explode(F.sequence(F.lit(0).cast("bigint"), F.pow(F.lit(2), F.col("subjects")).cast("bigint") - 1)).alias("draw")).select("draw", each)
        bit = F.expr("(draw >> subject) & 1")
    else:
        grid = spark.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(n)).select("draw", each)
        bit = F.pmod(F.xxhash64("draw", "subject"), F.lit(2))
    return grid.select("draw", "subject", (1 - 2 * bit).cast("int").alias("sign"))


def bootstrap_draws(spark: SparkSession, draws: int, subjects: int | DataFrame) -> DataFrame:
    """(draw, slot, subject): each draw takes as many subjects as there are, with replacement, by integer arithmetic."""
    n = counted(spark, subjects)
    grid = spark.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(n)).select("draw", "subjects", F.explode(F.sequence(F.lit(0), F.col("subjects") - 1)).alias("slot"))
    mixed = (F.col("draw") * 7919 + F.col("slot") * 104729 + F.col("draw") * F.col("slot") * 31) % 1000003
    return grid.select("draw", "slot", (mixed % F.col("subjects")).cast("int").alias("subject"))


#: Bits of the hash that split_labels() counts.
LABEL_BITS = 15


def split_labels(conditions: DataFrame, shuffles: int, seed: int) -> DataFrame:
    """(shuffle, condition, half): the first n // 2 conditions in the order of a hash are half 0, the rest half 1.

    Conditions are counted by the hash's first LABEL_BITS bits. The bucket with the middle of a shuffle (one row per shuffle) tells the
    half of all others; only its own conditions, a share of 1 in 2**LABEL_BITS, are put in order."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("shuffle").cast("string"), F.col("condition").cast("string")).cast("binary"))
    bucket = F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), 32 - LABEL_BITS)
    all_ = conditions.select("condition", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))).alias("shuffle")).withColumn("__digest", digest).withColumn("__bucket", bucket)
    sizes = all_.groupBy("shuffle", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("shuffle").orderBy("__bucket")  # 2**LABEL_BITS rows at most
    upto, half = F.sum("n").over(along), F.floor(F.sum("n").over(Window.partitionBy("shuffle")) / 2)
    sizes = sizes.withColumn("__upto", upto).withColumn("__middle", half).filter(F.col("__upto") > F.col("__middle"))
    cut = sizes.groupBy("shuffle").agg(F.min(F.struct("__bucket", (F.col("__middle") - (F.col("__upto") - F.col("n"))).alias("__left"))).alias("__cut"))
    met = beside(all_, checkpointed(cut.select("shuffle", F.col("__cut.__bucket").alias("__at"), F.col("__cut.__left").alias("__left"))), ["shuffle"])
    sure = met.filter(F.col("__bucket") != F.col("__at")).withColumn("half", F.when(F.col("__bucket") < F.col("__at"), 0).otherwise(1))
    place = F.row_number().over(Window.partitionBy("shuffle").orderBy("__digest", "condition"))
    rest = met.filter(F.col("__bucket") == F.col("__at")).withColumn("half", F.when(place <= F.col("__left"), 0).otherwise(1))
    return sure.select("shuffle", "condition", "half").union(rest.select("shuffle", "condition", "half"))


def ttest_1samp(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """t and two-sided p of the mean against 0; NULL without spread or with under two values."""
    g = values.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"))
    t = F.try_divide(F.col("m") * F.sqrt(F.col("n")), F.col("sd"))
    return g.withColumn("t", F.when(F.col("n") > 1, t)).withColumn("p", F.when(F.col("t").isNotNull(), t_two_sided(F.col("t"), (F.col("n") - 1).cast("int")))).select(*keys, "n", "t", "p")


def significance_mask(values: DataFrame, keys: list[str], alpha: float = 0.05, method: str = "fdr_bh", raw: bool = False, value: str = "value") -> DataFrame:
    """Test of each key against 0 (on Fisher's z, or on the values themselves with raw), corrected over all keys."""
    x = values if raw else values.withColumn(value, fisher_z(F.col(value)))
    p = ttest_1samp(x, keys, value)
    if method not in ("fdr_bh", "bonferroni"):
        raise ValueError(f"method {method} is not known")
    out = bh_adjust(p, []) if method == "fdr_bh" else bonferroni(p, [])
    return out.select(*keys, "p_adjusted", (F.col("p_adjusted") < alpha).alias("significant"))


def ttest_paired(a: DataFrame, b: DataFrame, unit: list[str], keys: list[str], value: str = "value") -> DataFrame:
    """Paired test per keys; pairs with a NaN or a missing side are dropped, and two pairs are needed."""
    d = a.select(*unit, *keys, F.col(value).alias("x")).join(b.select(*unit, *keys, F.col(value).alias("y")), [*unit, *keys])
    return ttest_1samp(d.filter(~F.isnan("x") & ~F.isnan("y")).withColumn("d", F.col("x") - F.col("y")), keys, "d")


def sign_flip_null(curve: DataFrame, draws: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean curve of each draw of signs: (keys, draw, t_idx, m)."""
    return curve.join(F.broadcast(draws), "subject").groupBy(*keys or [], "draw", "t_idx").agg(F.avg(F.col("value") * F.col("sign")).alias("m"))


def pooled_thresholds(null: DataFrame, p: float, keys: list[str] | None = None) -> DataFrame:
    """Lower and upper limits of the null of each keys, pooled over draws and time."""
    return quantiles(null, keys or [], "m", [p / 2, 1 - p / 2]).select(*keys or [], F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def clusters(means: DataFrame, limits: DataFrame, keys: list[str], limit_keys: list[str] | None = None) -> DataFrame:
    """Runs of means beyond the limits (of limit_keys): keys, cluster, first, last, signed sum."""
    met = means.join(limits, limit_keys) if limit_keys else means.crossJoin(F.broadcast(limits))
    flagged = met.withColumn("flag", (F.col("m") > F.col("high")) | (F.col("m") < F.col("low")))
    runs = cluster_label(flagged, keys, "t_idx", "flag").filter("flag")
    return runs.groupBy(*keys, "cluster").agg(F.min("t_idx").alias("first"), F.max("t_idx").alias("last"), F.sum("m").alias("sum"))


def signed_sums(means: np.ndarray, low: float, high: float) -> list[tuple[np.ndarray, ...]]:
    """(row, first, last, sum) of the runs of columns beyond the limits, in order, for each row of means; sums run from left to right."""
    flag = np.pad((means > high) | (means < low), ((0, 0), (1, 1))).astype(np.int8)
    step = np.diff(flag, axis=1)
    row, first = np.nonzero(step == 1)
    last = np.nonzero(step == -1)[1] - 1
    total = np.zeros(len(row))
    for k in range(int((last - first).max(initial=-1)) + 1):
        inside = np.flatnonzero(first + k <= last)
        total[inside] += means[row[inside], first[inside] + k]
    return [row, first, last, total]


def cluster_permutation_test(curve: DataFrame, draws: DataFrame, p_thresh: float = 0.05, alpha: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """One row per observed cluster of each curve (one per keys): keys, cluster, first, last, sum, p, significant.

    p counts draws whose largest signed cluster sum (0 without a cluster) is at least the size of the observed sum. The limits are
    quantiles of the null, pooled over draws and time. A curve is packed as a table of subjects and times, which is multiplied with the
    signs of all draws (draws x subjects, a table of parameters) in the task that has it: only its clusters leave. Subjects without signs
    take no part; times with other numbers of subjects are means over those they have."""
    keys = keys or []
    signs = draws.toPandas().pivot(index="draw", columns="subject", values="sign")  # draws x subjects, both parameters
    names, signs = [s.item() if hasattr(s, "item") else s for s in signs.columns], signs.to_numpy(float)
    signs = np.where(np.isfinite(signs), signs, 0)
    cells = curve.filter(F.col("value").isNotNull()).groupBy(*keys, "subject", "t_idx").agg(F.sum(F.col("value").cast("double")).alias("v"), F.count(F.lit(1)).alias("n"))
    packed = cells.groupBy(*keys).agg(F.collect_list(F.struct("subject", "t_idx", "v", "n")).alias("cells"))  # subjects x times

    def test(cells: list[dict]) -> list[tuple]:
        place = {s: k for k, s in enumerate(names)}
        cells = [c for c in cells if c["subject"] in place]
        times = sorted({c["t_idx"] for c in cells})
        at = {t: k for k, t in enumerate(times)}
        v, n = np.zeros((len(names), len(times))), np.zeros(len(times))
        for c in cells:
            v[place[c["subject"]], at[c["t_idx"]]] = c["v"]
            n[at[c["t_idx"]]] += c["n"]
        if not times:
            return []
        # added subject by subject, so that a draw without flips equals what was observed to the last bit
        null, observed = np.zeros((len(signs), len(times))), np.zeros((1, len(times)))
        for k in range(len(names)):
            null += signs[:, k : k + 1] * v[k]
            observed += v[k]
        null, observed = null / n, observed / n
        low, high = np.quantile(null, [p_thresh / 2, 1 - p_thresh / 2])
        row, _, _, sums = signed_sums(null, low, high)
        top = np.full(len(signs), -np.inf)
        np.maximum.at(top, row, sums)
        top[np.isinf(top)] = 0.0
        _, first, last, sums = signed_sums(observed, low, high)
        p = [(int((top >= abs(s)).sum()) + 1) / (len(top) + 1) for s in sums]
        return [(k + 1, times[a], times[b], float(s), q, q < alpha) for k, (a, b, s, q) in enumerate(zip(first, last, sums, p, strict=True))]

    def run(batches):
        for b in batches:
            found = [(k, *x) for k, cells in enumerate(b.column("cells").to_pylist()) for x in test(cells)]
            at, *cols = zip(*found, strict=True) if found else ((),) * 7
            at = pa.array(at, pa.int64())
            types = (pa.int32(), t_type, t_type, pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in keys], *[pa.array(x, kind) for x, kind in zip(cols, types, strict=True)]], names=[*keys, "cluster", "first", "last", "sum", "p", "significant"])

    kinds = {f.name: f.dataType for f in curve.schema.fields}
    t_type, t = to_arrow_type(kinds["t_idx"]), kinds["t_idx"].simpleString()
    key_schema = "".join(f"`{k}` {kinds[k].simpleString()}, " for k in keys)
    return packed.mapInArrow(run, f"{key_schema}cluster int, first {t}, last {t}, sum double, p double, significant boolean")


def cluster_difference_test(a: DataFrame, b: DataFrame, draws: DataFrame, p_thresh: float = 0.05, alpha: float = 0.05, value: str = "value") -> DataFrame:
    """Cluster test of the differences of two analyses (subject, t_idx, value) of the same subjects; other subjects on one side are an error."""
    one, two = a.select("subject").distinct(), b.select("subject").distinct()
    alone = one.exceptAll(two).union(two.exceptAll(one)).limit(5).collect()
    if alone:
        raise ValueError(f"subjects of one side only: {sorted(r.subject for r in alone)}")
    x, y = a.select("subject", "t_idx", F.col(value).alias("x")), b.select("subject", "t_idx", F.col(value).alias("y"))
    return cluster_permutation_test(x.join(y, ["subject", "t_idx"]).select("subject", "t_idx", (F.col("x") - F.col("y")).alias("value")), draws, p_thresh, alpha)


def significance_windows(found: DataFrame, axis: DataFrame) -> DataFrame:
    """Milliseconds of each significant cluster, and of all of them, by the time axis (t_idx, t_ms)."""
    a, b = axis.select(F.col("t_idx").alias("first"), F.col("t_ms").alias("start_ms")), axis.select(F.col("t_idx").alias("last"), F.col("t_ms").alias("stop_ms"))
    each = found.filter("significant").join(a, "first").join(b, "last").select("cluster", "start_ms", "stop_ms")
    return each.unionByName(each.agg(F.lit(0).alias("cluster"), F.min("start_ms").alias("start_ms"), F.max("stop_ms").alias("stop_ms")))


def peak_latency(means: DataFrame, keys: list[str]) -> DataFrame:
    """Time of the largest mean; the first of equal ones."""
    return means.groupBy(*keys).agg(F.max_by("t_ms", F.struct("m", -F.col("t_ms"))).alias("peak_ms"))


def bootstrap_curves(curve: DataFrame, draws: DataFrame) -> DataFrame:
    """Mean curve of each draw of subjects: (draw, t_idx, t_ms, m)."""
    return curve.join(F.broadcast(draws), "subject").groupBy("draw", "t_idx", "t_ms").agg(F.avg("value").alias("m"))


def percentile_ci(values: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """Interval of the draws of each keys: a group holds one value per draw, a parameter."""
    q = F.percentile(value, F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return values.groupBy(*keys).agg(q.alias("q")).select(*keys, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def subject_onsets(curve: DataFrame, threshold: float) -> DataFrame:
    """First time above the threshold per subject; NULL if none."""
    return curve.groupBy("subject").agg(F.min(F.when(F.col("value") > threshold, F.col("t_idx"))).alias("onset"))


def best_model(scores: DataFrame, keys: list[str], order: str = "layer") -> DataFrame:
    """Model with the highest mean of subject means; the first in order on ties."""
    per = scores.groupBy(*keys, order, "subject").agg(F.avg("value").alias("m")).groupBy(*keys, order).agg(F.avg("m").alias("m"))
    w = Window.partitionBy(*keys).orderBy(F.desc("m"), order)
    return per.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def best_model_report(curves: DataFrame, keys: list[str], signs: DataFrame, resamples: DataFrame, order: str = "layer", since: float = 0, p_thresh: float = 0.05, alpha: float = 0.05) -> DataFrame:
    """The best model of each keys from time `since` on, with the peak of its mean curve, the interval of the peak over resampled
    subjects, and the times that lie in significant clusters (sorted, empty if none).

    curves: (keys, order, subject, t_idx, t_ms, value), one value per subject and time."""
    best = best_model(curves.filter(F.col("t_ms") >= since), keys, order)
    mine = checkpointed(curves.join(best.select(*keys, order), [*keys, order]))
    peak = peak_latency(mine.groupBy(*keys, "t_ms").agg(F.avg("value").alias("m")), keys)
    drawn = mine.join(F.broadcast(resamples), "subject").groupBy(*keys, "draw", "t_ms").agg(F.avg("value").alias("m"))
    ci = percentile_ci(peak_latency(drawn, [*keys, "draw"]), keys, "peak_ms")
    runs = cluster_permutation_test(mine, signs, p_thresh, alpha, keys).filter("significant").select(*keys, F.explode(F.sequence("first", "last")).alias("t_idx"))
    mask = runs.groupBy(*keys).agg(F.array_sort(F.collect_list("t_idx")).alias("significant_at"))
    out = best.join(peak, keys).join(ci, keys).join(mask, keys, "left")
    return out.withColumn("significant_at", F.coalesce("significant_at", F.array().cast("array<int>")))


def best_model_per_bin(stats: DataFrame, width: int) -> DataFrame:
    """stats (model, t_ms, mean, significant): per bin from the first significant time on, the model with the highest mean among
    those that are significant at every time in the bin. Bins are half-open, and those without such a model are left out."""
    edge = stats.agg(F.min(F.when(F.col("significant"), F.col("t_ms"))).alias("t0"), F.max("t_ms").alias("t_last"))
    start = F.col("t0") + F.floor((F.col("t_ms") - F.col("t0")) / width) * width
    inside = stats.crossJoin(F.broadcast(edge)).filter("t_ms >= t0").withColumn("start", start.cast("int")).filter("start < t_last")
    per = inside.groupBy("start", "model").agg(F.bool_and("significant").alias("whole"), F.avg("mean").alias("m")).filter("whole")
    w = Window.partitionBy("start").orderBy(F.desc("m"), "model")
    return per.withColumn("r", F.row_number().over(w)).filter("r = 1").select("start", (F.col("start") + width).cast("int").alias("stop"), F.col("model").alias("winner"))
