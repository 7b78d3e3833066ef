"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams (1 to 3 characters) of the lower-cased text, with every run of other than letters as one space. A
row's vector is log(1 + count) * idf, scaled to length 1. Document frequencies are counted over all learning rows. Weights are
learned with follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties, so most weights are zero) on a sample of
at most `per_label` distinct texts of each label; a last part of that sample, which the weights do not see, sets the temperature
that calibrates the probabilities. The sample is drawn among the digests of distinct texts, so copies of a text count once, their
texts are not gathered, and a label with any learning text keeps one.

Edge cases: a null text, or one without letters, gives `und` and score 0; with no learning rows everything is `und`; texts of any
length are read whole; labels that are null are not learned; repeated rows weigh in the document frequencies as often as they
occur; an empty table gives no rows; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stimfuse.llm.common import crc_mod, map_batches

#: Hashed features; distinct learning texts of a label at most; share of them that is kept for the temperature.
DIMENSIONS, PER_LABEL, HELD = 1 << 15, 1200, 0.2

_LETTER = None


def _letters() -> np.ndarray:
    """Whether each code point is a letter (Unicode category L)."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _LETTER


def grams(text: str | None) -> np.ndarray | None:
    """Hashed n-grams of a whole text, repeats included; None if it has no letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stands for it
    c = np.where(letter, c, np.uint32(32))[keep]
    c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]]).astype(np.uint32)
    one = (c * np.uint32(0x9E3779B1)) >> np.uint32(17)
    two = ((c[:-1] * np.uint32(0x85EBCA6B)) ^ (c[1:] * np.uint32(0xC2B2AE35))) * np.uint32(0x9E3779B1) >> np.uint32(17)
    three = ((c[:-2] * np.uint32(0x27D4EB2F)) ^ (c[1:-1] * np.uint32(0x85EBCA6B)) ^ (c[2:] * np.uint32(0x165667B1))) * np.uint32(0x9E3779B1) >> np.uint32(17)
    return np.concatenate([one, two, three])


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Feature numbers and their counts."""
    g = grams(text)
    if g is None:
        return None
    n = np.bincount(g, minlength=DIMENSIONS)
    at = np.flatnonzero(n)
    return at, n[at]


def vector(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = found
    x = np.log1p(n) * idf[at]
    return at, x / max(np.sqrt((x * x).sum()), 1e-12)


class Ftrl:
    """Multinomial logistic regression by follow-the-regularised-leader: only sums of gradients are kept, weights follow from them."""

    def __init__(self, classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.z, self.n = np.zeros((DIMENSIONS, classes)), np.zeros((DIMENSIONS, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = np.outer(x, p)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores with the least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0
    other = 1 / (len(y) + 2)  # as if one of two further rows were wrong: a sample without errors doesn't make errors impossible

    def loss(t: float) -> float:
        p = np.log(np.maximum(softmax(scores / np.exp(t)), 1e-300))
        return -((1 - other) * p[np.arange(len(y)), y] + other * p.mean(axis=1)).mean()

    lo, hi, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


class Model:
    def __init__(self, labels: list[str], idf: np.ndarray, weights: np.ndarray, t: float):
        self.labels, self.idf, self.weights, self.t = labels, idf, weights, t

    def predict(self, text: str | None) -> tuple[str, float]:
        found = counts(text)
        if found is None or not self.labels:
            return "und", 0.0
        at, x = vector(found, self.idf)
        p = softmax(x @ self.weights[at] / self.t)
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def fit(rows: DataFrame, text_col: str = "text", label_col: str = "lang", per_label: int = PER_LABEL, epochs: int = 3) -> Model:
    """rows: the learning rows. Frequencies come from all of them, weights from at most per_label distinct texts of each label."""
    rows = rows.filter(F.col(label_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(label_col).alias("label"))

    def frequencies(batches):
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for b in batches:
            for t in b.column(0):
                found = counts(t.as_py())
                n += 1
                if found is not None:
                    df[found[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, DIMENSIONS), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], names=["at", "n"])

    df = np.zeros(DIMENSIONS + 1)
    for r in rows.select("text").mapInArrow(frequencies, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():  # one row per feature
        df[r["at"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    # a digest per distinct text and label; only those under the label's share can be among the first per_label
    digests = rows.filter(F.col("text").rlike(r"\p{L}")).select("label", F.xxhash64("text").alias("digest")).distinct()
    digests = digests.withColumn("order", F.shiftrightunsigned(F.xxhash64("digest", "label"), 11) / float(1 << 53)).persist()
    labels = {r["label"]: r["count"] for r in digests.groupBy("label").count().collect()}  # one row per label
    names = sorted(labels)
    share = F.element_at(F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, (per_label + 8 * per_label**0.5) / labels[k]))]), F.col("label")) if names else F.lit(1.0)
    nth = F.row_number().over(Window.partitionBy("label").orderBy("order", "digest"))
    chosen = digests.filter(F.col("order") < share).withColumn("nth", nth).filter(F.col("nth") <= per_label)
    # per_label rows a label; of copies one stays before anything is shuffled
    drawn = rows.withColumn("digest", F.xxhash64("text")).join(F.broadcast(chosen), ["label", "digest"]).groupBy("label", "digest", "nth").agg(F.min("text").alias("text"))

    def features(b: pa.RecordBatch):
        out = [(label, nth, f) for t, label, nth in zip(*(c.to_pylist() for c in b.columns), strict=True) if (f := counts(t)) is not None]
        kinds = [pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        cols = [[x[0] for x in out], [x[1] for x in out], [x[2][0] for x in out], [x[2][1] for x in out]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["label", "nth", "at", "n"])

    # a sample of per_label texts a label, each with DIMENSIONS features at most
    got = map_batches(drawn.select("text", "label", "nth"), features, "label string, nth int, at array<int>, n array<int>").toArrow().sort_by([("nth", "ascending"), ("label", "ascending")])
    digests.unpersist()
    number = {k: i for i, k in enumerate(names)}
    flat_at, flat_n = got.column("at").combine_chunks(), got.column("n").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(np.asarray(flat_at.value_lengths()))]).astype(int) if len(got) else np.zeros(1, int)
    at, n = np.asarray(flat_at.flatten()), np.asarray(flat_n.flatten())
    y = np.array([number[k] for k in got.column("label").to_pylist()], int)
    x = [vector((at[a:b], n[a:b]), idf) for a, b in zip(ends, ends[1:], strict=False)]
    model = Ftrl(len(names))
    # in the order of the draw; one text in 1 / HELD of a label's sample is kept for the temperature, but never its only one
    every, place = round(1 / HELD), np.asarray(got.column("nth"), int)
    held = [k for k in range(len(y)) if place[k] % every == 0]
    for _ in range(epochs):
        for k in range(len(y)):
            if place[k] % every:
                model.learn(*x[k], y[k])
    w = model.weights()
    t = temperature(np.array([x[k][1] @ w[x[k][0]] for k in held]), y[held]) if held else 1.0
    return Model(names if len(y) else [], idf, w.astype(np.float32), t)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS weights a label

    def run(b: pa.RecordBatch):
        out = [shared.value.predict(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], names=[id_col, "lang_pred", "score"])

    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` bigint, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 3) == 1
