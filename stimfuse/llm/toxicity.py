"""Toxicity: a support vector machine on a gap-weighted subsequence string kernel, with Nyström landmarks.

A text is a bag of tokens and is as toxic as its most toxic token (multiple-instance learning: the label of a text says that at
least one token is a witness, not which). The kernel of two tokens compares their subsequences of 3 and 4 characters, marks of
both ends included; a subsequence that spans s characters weighs GAP ** s, up to 2 inserted characters. Tokens are lower-cased,
look-alike digits and signs become letters, signs between letters are dropped, and letters that stand alone in a row are joined,
so spelled-out and gapped insults come close to the plain ones.

Landmarks are a bounded set of tokens; the Nyström map K_mm^(-1/2) k_m(x) turns the kernel machine into a linear one. As the
kernel is a product of explicit subsequence vectors of length 1, the trained machine is one weight per (hashed) subsequence, which
is all that scoring needs.

Training sees a bounded sample; its bounds are the parameters below. At most `per_class` texts of each label are drawn by a hash
of their id, and Spark counts their tokens (those of TOKEN_CHARS characters at most; scoring judges tokens of any length). Of the
sample's tokens, at most TOKENS of a kind are learned: the first witnesses are tokens of toxic texts that no clean text has, in
order of how many different toxic texts hold them; TOKENS of clean texts by hash and FREQUENT by count. Later rounds take the
best-scoring token of each toxic text that scores above WEAK, and the HARD best-scoring ones of clean texts. Copies of the first
COPIED witnesses with a letter put in are learned as well. One text in HOLD of the sample is kept from the machine: a logistic fit
on the best scores of these texts gives probabilities. Forms and samples follow from the rows alone, so reruns agree.

Edge cases: null and empty texts, and those without letters, get the score of no evidence (near 0); texts of any length are read
whole; labels other than 0 and 1 and labelled rows without a document are not learned; without labels of both kinds every score
is 0; repeated rows are scored alike; an empty table gives no rows; columns other than id, text and label are not read.
"""

from __future__ import annotations

import re
import zlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stimfuse.llm.common import crc_mod, map_batches, slices

#: Texts of each label that are learned from at most; tokens of each kind; frequent and hard clean tokens; landmarks.
PER_CLASS, TOKENS, FREQUENT, HARD, LANDMARKS = 3000, 6000, 1500, 3000, 400
#: Characters of a token that is learned at most; witnesses that get copies with a letter put in; least score of a later witness.
TOKEN_CHARS, COPIED, WEAK = 64, 600, -0.5
#: One text in so many is kept for the logistic fit.
HOLD = 5
#: Weight of a spanned character; inserted characters at most; hashed subsequences.
GAP, INSERTED, SLOTS = 0.7, 2, 1 << 20
#: Entries of a worker's memo.
MEMO = 500_000

#: Signs that are read as letters.
LOOKS_LIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

_ALONE = re.compile(r"(?<!\w)\w(?:[^\w\n]\w){2,}(?!\w)")
_SIGNS = re.compile(r"[\W_]+")
_PAD = 4 + INSERTED


def tokens(text: str | None) -> set[str]:
    """Raw tokens of a whole text: what white space separates, and letters that stand alone in a row as one."""
    if not text:
        return set()
    text = text.lower()
    found = set(text.split())
    found.update(_SIGNS.sub("", m) for m in _ALONE.findall(text))
    return found


def forms(raw: str) -> list[str]:
    """The forms in which a raw token is judged: joined over its inner signs, and the parts between them."""
    bare = raw if raw.isalpha() else raw.strip(".,;:!?\"'()[]")
    if bare.isalpha():
        return [bare]
    parts = [p for p in _SIGNS.split(raw) if p]
    if not parts:
        return []
    joined = _SIGNS.sub("", bare.translate(LOOKS_LIKE))
    return list(dict.fromkeys([joined, *(p for p in parts if len(p) > 2 and not p.isdigit())]))


def _codes(forms_: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of all forms in one array, with end marks and padding; where each form starts."""
    pad = "\0" * _PAD
    c = np.frombuffer((f"\x01" + f"\x02{pad}\x01".join(forms_) + f"\x02{pad}").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter(map(len, forms_), np.int64, len(forms_)) + 2 + _PAD
    return c, np.cumsum(n) - n


def _weight(span: int) -> np.float32:
    return np.float32(GAP ** (span + 1))


def subsequences(c: np.ndarray):
    """(slot, weight) of the subsequences of 3 and 4 characters that start at each character, one pair of arrays per choice of
    distances; weight 0 where there is none. Longer ones go on from the hash of shorter ones."""
    n = len(c) - _PAD
    ahead = [c[k : k + n] for k in range(_PAD)]
    there = [(a > 0) for a in ahead]
    mul, end = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)

    def longer(h: np.ndarray, k: int) -> np.ndarray:
        return (h ^ h >> np.uint32(15)) * mul + ahead[k]

    def slot(h: np.ndarray) -> np.ndarray:
        return (h ^ h >> np.uint32(13)) * end >> np.uint32(12)

    one = ahead[0] * np.uint32(0x9E3779B1)
    for i in range(1, 2 + INSERTED):
        two = longer(one, i)
        for j in range(i + 1, 3 + INSERTED):
            three = longer(two, j)
            yield slot(three), (there[0] & there[j]) * _weight(j)
            for k in range(j + 1, 4 + INSERTED):
                yield slot(longer(three, k)), (there[0] & there[k]) * _weight(k)


def _starts(lengths: np.ndarray) -> np.ndarray:
    """Squared length of a form's vector by its number of characters, end marks included, if no subsequence occurs twice in it."""
    out = np.zeros(len(lengths))
    for i in range(1, 2 + INSERTED):
        for j in range(i + 1, 3 + INSERTED):
            out += np.maximum(lengths - j, 0) * float(_weight(j)) ** 2
            for k in range(j + 1, 4 + INSERTED):
                out += np.maximum(lengths - k, 0) * float(_weight(k)) ** 2
    return out


def _entries(forms_: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, slot, weight) of all subsequences of all forms; one that occurs at several places of a form is one entry with all their weight."""
    c, starts = _codes(forms_)
    n = len(c) - _PAD
    of = (np.searchsorted(starts, np.arange(n), side="right") - 1).astype(np.uint64) << np.uint64(20 + 5)
    keys = []
    for slots, weights in subsequences(c):
        span = np.uint64(round(float(np.log(weights.max(initial=1e-30)) / np.log(GAP)))) if weights.any() else np.uint64(0)
        live = weights > 0
        keys.append((of[live] | slots[live].astype(np.uint64) << np.uint64(5)) | span)
    key = np.sort(np.concatenate(keys))
    w = (GAP ** np.arange(32.0))[(key & np.uint64(31)).astype(np.int64)]
    key >>= np.uint64(5)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    w, key = np.add.reduceat(w, first) if len(key) else w, key[first]
    return (key >> np.uint64(20)).astype(np.int64), (key & np.uint64(SLOTS - 1)).astype(np.int64), w


def norms(forms_: list[str]) -> np.ndarray:
    """Length of each form's vector. Only a form with a repeated character can hold a subsequence twice; the others follow from their length."""
    square = _starts(np.fromiter(map(len, forms_), np.int64, len(forms_)) + 2)
    again = [k for k, f in enumerate(forms_) if len(set(f)) < len(f)]
    if again:
        owner, _, w = _entries([forms_[k] for k in again])
        square[again] = np.bincount(owner, w * w, len(again))
    return np.sqrt(np.maximum(square, 1e-9))


def vectors(forms_: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per form: slots and weights of its subsequences, scaled to length 1."""
    if not forms_:
        return []
    owner, slots, weights = _entries(forms_)
    cuts = np.searchsorted(owner, np.arange(len(forms_) + 1))
    weights = (weights / norms(forms_)[owner]).astype(np.float32)
    return [(slots[a:b], weights[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Machine:
    """Weights per slot, the bias, and the logistic curve over a text's best score."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias
        self.curve = (1.0, 0.0)

    def margins(self, forms_: list[str]) -> np.ndarray:
        out = []
        for k in range(0, len(forms_), 4096):
            part = forms_[k : k + 4096]
            c, starts = _codes(part)
            c = np.concatenate([c, np.zeros(_PAD, np.uint32)])
            total = np.zeros(len(c) - _PAD, np.float32)
            for slots, w in subsequences(c):
                total += self.weights[slots] * w
            out.append(np.add.reduceat(total, starts) / norms(part) + self.bias)
        return np.concatenate(out) if out else np.zeros(0)

    def best(self, texts: list[str | None], memo: dict[str, float]) -> list[tuple[float, str | None]]:
        """The best score of each text's tokens, and the witness where there may be one. Tokens that the memo lacks are judged together."""
        found = [tokens(t) for t in texts]
        new = list(set().union(*found).difference(memo))
        own = [forms(t) for t in new]
        m = self.margins([f for o in own for f in o])
        at = 0
        for t, o in zip(new, own, strict=True):
            memo[t] = float(m[at] if len(o) == 1 else m[at : at + len(o)].max()) if o else NOTHING
            at += len(o)
        out = []
        for f in found:
            top = max(map(memo.__getitem__, f), default=NOTHING)
            out.append((top, min(t for t in f if memo[t] == top) if top > WITNESS else None))
        return out

    def score(self, margin: float) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40))))


#: The score of a text that has no token to judge, and the least score of a token that is named.
NOTHING, WITNESS = -3.0, -0.75


def with_insertions(witnesses: list[str], most: int = COPIED) -> list[str]:
    """The witnesses, and copies of the first `most` plain ones with one letter put in, at a place and of a kind that their text decides."""
    out = list(witnesses)
    for w in [w for w in witnesses if w.isalpha() and 4 <= len(w) <= 24][:most]:
        for k in (1, 2):
            n = zlib.crc32(f"{k}{w}".encode())
            at = 1 + n % (len(w) - 1)
            out.append(w[:at] + chr(97 + n // 64 % 26) + w[at:])
    return list(dict.fromkeys(out))


def newton_svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    n, m = z.shape
    x = np.hstack([z, np.ones((n, 1))])
    ridge = np.eye(m + 1)
    ridge[m, m] = 1e-6
    w, last = np.zeros(m + 1), None
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        if last is not None and (inside == last).all():
            break
        last = inside
        a = x[inside] * cost[inside, None]
        w = np.linalg.solve(ridge + a.T @ x[inside], a.T @ y[inside])
    return w[:m], float(w[m])


def train_tokens(positive: list[str], negative: list[str], landmarks: int = LANDMARKS, c: float = 4.0) -> Machine:
    """The machine on single tokens."""
    pos, neg = [f for t in positive for f in forms(t)[:1]], [f for t in negative for f in forms(t)[:1]]
    marks = pos[: landmarks // 2] + neg[:: max(1, len(neg) // (landmarks // 2))][: landmarks // 2]
    v = vectors(marks)
    used = np.unique(np.concatenate([s for s, _ in v]))
    table = np.zeros((len(used), len(marks)), np.float32)
    for j, (s, w) in enumerate(v):
        np.add.at(table[:, j], np.searchsorted(used, s), w)

    def against(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(rows), len(marks)), np.float32)
        for i, (s, w) in enumerate(rows):
            at = np.minimum(np.searchsorted(used, s), len(used) - 1)
            hit = used[at] == s
            out[i] = w[hit] @ table[at[hit]]
        return out

    values, basis = np.linalg.eigh(against(v).astype(float))
    keep = values > 1e-6 * values.max()
    root = basis[:, keep] / np.sqrt(values[keep])
    y = np.array([1.0] * len(pos) + [-1.0] * len(neg))
    cost = np.where(y > 0, c * len(y) / (2 * max(len(pos), 1)), c * len(y) / (2 * max(len(neg), 1))) / 2
    z = np.vstack([against(vectors(part)) for k in range(0, len(y), 500) if (part := (pos + neg)[k : k + 500])]).astype(float) @ root
    w, bias = newton_svm(z, y, cost)
    weights = np.zeros(SLOTS)
    weights[used] = table @ (root @ w)
    return Machine(weights, bias)


def logistic(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with Platt's smoothed targets."""
    up, down = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x, w = np.stack([m, np.ones_like(m)], 1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (t - p)) - 1e-4 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def _best_of(rows: DataFrame, machine: Machine) -> DataFrame:
    """(toxic, margin, token) of rows (text, toxic)."""
    shared = rows.sparkSession.sparkContext.broadcast(machine)  # SLOTS weights

    def run(b: pa.RecordBatch):
        memo: dict[str, float] = {}
        found = shared.value.best(b.column(0).to_pylist(), memo)
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.string())], names=["toxic", "margin", "token"])

    return map_batches(rows.select("text", F.col("toxic").cast("int").alias("toxic")), run, "toxic int, margin double, token string")


def _first(rows: DataFrame, n: int, of: int, draw) -> DataFrame:
    """The n rows with the least `draw`, a hash of their key; of: the number of rows. Rows that can't be among them stay where they are."""
    share = min(1.0, (n + 8 * n**0.5) / max(of, 1))
    return rows.filter(F.shiftrightunsigned(draw, 24) < int(share * (1 << 40))).orderBy(F.shiftrightunsigned(draw, 24), *rows.columns).limit(n)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, rounds: int = 2) -> Machine | None:
    """docs (doc_id, text) and labels (doc_id, toxic): the learning rows. None if they lack toxic or clean texts.

    The sample is drawn from the labels, and its at most 2 * per_class ids are broadcast: texts are never shuffled for it."""
    marks = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    some = [_first(marks.filter(F.col("toxic") == k), per_class, n[k], F.xxhash64("doc_id")) for k in (0, 1)]
    some = some[0].union(some[1]).withColumn("held", F.pmod(F.crc32(F.concat(F.lit("held "), F.col("doc_id").cast("string")).cast("binary")), F.lit(HOLD)) == 0)
    drawn = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "toxic", "held")
    drawn = drawn.repartition(docs.sparkSession.sparkContext.defaultParallelism).persist()
    try:
        return _fit(drawn, n, per_class, rounds)
    finally:
        drawn.unpersist()


def _fit(drawn: DataFrame, n: dict[int, int], per_class: int, rounds: int) -> Machine | None:
    """drawn (text, toxic, held): the sample; n: labels of each kind."""

    def spread(b: pa.RecordBatch):
        # near copies of a text have the same least hash most of the time, and count as one
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = sorted(t for t in tokens(text) if len(t) <= TOKEN_CHARS)
            if found:
                sketch = min(hash(tuple(t.encode())) for t in found)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([toxic] * len(found), pa.int32()), pa.array([sketch] * len(found), pa.int64())], names=["token", "toxic", "sketch"])

    taught = drawn.filter("not held").select("text", "toxic")
    stats = map_batches(taught, spread, "token string, toxic int, sketch bigint").groupBy("token").agg(F.count_distinct(F.when(F.col("toxic") == 1, F.col("sketch"))).alias("up"), F.sum(1 - F.col("toxic")).alias("down"))
    stats = stats.coalesce(4).persist()  # tokens of the sample; each task sends at most TOKENS of a kind to the driver
    only = stats.filter("down = 0").orderBy(F.desc("up"), "token").limit(TOKENS).collect()
    clean = [r["token"] for r in stats.filter("down > 0").orderBy(F.xxhash64("token"), "token").limit(TOKENS).collect()]
    clean += [r["token"] for r in stats.filter("down > 0").orderBy(F.desc("down"), "token").limit(FREQUENT).collect()]
    # a first witness is toxic more often than chance makes any token: at its count, hardly any token is expected to miss all clean texts
    rank = {r["token"]: r["up"] for r in only}
    tox, all_ = min(n[1], per_class), min(n[0], per_class) + min(n[1], per_class)
    seen = {r["k"]: r["n"] for r in stats.groupBy((F.col("up") + F.col("down")).alias("k")).agg(F.count("*").alias("n")).collect()}
    stats.unpersist()
    by_chance = lambda k: sum(c * (tox / all_) ** j for j, c in seen.items() if j >= k)
    least = next(k for k in count(2) if by_chance(k) <= 0.2)
    top = max(rank.values(), default=0)
    first = [t for t, k in rank.items() if k >= max(least, 0.05 * top)] or [t for t, k in rank.items() if k == top]
    if not first or not clean:
        return None
    machine, hard = train_tokens(with_insertions(first), clean), []
    for _ in range(rounds):
        found = _best_of(taught, machine).filter("token is not null").groupBy("toxic", "token").agg(F.count("*").alias("n"), F.max("margin").alias("margin")).coalesce(4).persist()
        up = found.filter("toxic = 1").orderBy(F.desc("n"), "token").limit(TOKENS).collect()
        down = found.filter("toxic = 0").orderBy(F.desc("margin"), "token").limit(HARD).collect()
        found.unpersist()
        bad = {r["token"] for r in down}
        hard = list(dict.fromkeys(hard + [r["token"] for r in down]))
        witnesses = [r["token"] for r in up if r["token"] not in bad and r["margin"] > WEAK] or first
        witnesses = list(dict.fromkeys(witnesses + [t for t in first if t not in bad]))
        machine = train_tokens(with_insertions(witnesses), list(dict.fromkeys(hard + clean)))
    kept = drawn.filter("held")
    kinds = {r["toxic"] for r in kept.select("toxic").distinct().collect()}
    got = _best_of(kept if kinds == {0, 1} else drawn, machine).select("toxic", "margin").toPandas().sort_values(["toxic", "margin"])  # 2 * per_class rows
    y, m = got["toxic"].to_numpy(), got["margin"].to_numpy()
    seen = {k: max(int((y == k).sum()), 1) for k in (0, 1)}
    machine.curve = logistic(m, y, np.where(y == 1, n[1] / seen[1], n[0] / seen[0]) * len(y) / (n[0] + n[1]))
    return machine


def scores(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, score, token); token is the witness."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # SLOTS weights

    def run(batches):
        memo: dict[str, float] = {}
        for b in batches:
            texts, machine = b.column(1).to_pylist(), shared.value
            out: list = [(0.0, None)] * len(texts) if machine is None else []
            for lo, hi in [] if machine is None else slices(texts):
                if len(memo) > MEMO:
                    memo.clear()
                out += [(machine.score(m), t) for m, t in machine.best(texts[lo:hi], memo)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.string())], names=[id_col, "score", "token"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` bigint, score double, token string")


def learn(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """The machine of the contract: it learns only labels of documents that crc32 of the id does not hold out."""
    return fit(docs, labels.filter(crc_mod(F.col("doc_id"), 5) != 0))


def without_toxic(docs: DataFrame, machine: Machine | None, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is under the limit; rows stay in place, nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # SLOTS weights
    if machine is None:
        return docs

    def run(batches):
        memo: dict[str, float] = {}
        for b in batches:
            texts, keep = b.column(text_col).to_pylist(), []
            for lo, hi in slices(texts):
                if len(memo) > MEMO:
                    memo.clear()
                keep += [shared.value.score(m) < limit for m, _ in shared.value.best(texts[lo:hi], memo)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
