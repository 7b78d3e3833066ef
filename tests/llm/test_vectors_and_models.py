"""Top-k search against brute force; classifiers on held-out rows; the pipeline's stages against their own inputs."""

import base64
import hashlib
import math
import os
import random
import subprocess
import sys
import zlib
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from stimfuse.llm import exact_topk, language_id, mixing, simhash_dedup, toxicity


def brute_topk(vectors, queries, k, scale=256.0):
    ok = [(i, [int(np.floor(scale * np.float64(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for own, (i, q) in enumerate(ok):  # queries holds every row of its ids
        if any(i == x for x, _ in queries):
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for n, (j, v) in enumerate(ok) if n != own)[:k]  # noqa: B905
            out += [(i, n + 1, j, -p) for n, (p, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("kind,rounds", [("normal", 2), ("clustered", 2), ("large", 100), ("unit", 100)])
def test_topk_equals_brute_force(spark, kind, rounds, monkeypatch):
    monkeypatch.setattr(exact_topk, "HEAD", 16)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(exact_topk, "BLOCK", 16)
    monkeypatch.setattr(exact_topk, "CHUNK", 2)
    monkeypatch.setattr(exact_topk, "ROUND", rounds)
    r = np.random.default_rng(1)
    m = r.normal(size=(400, 12)) * r.lognormal(size=(400, 1))
    if kind == "clustered":
        m = np.round(m[r.integers(0, 9, 400)], 1)
    if kind == "large":
        m *= 1e6
    if kind == "unit":
        m /= np.linalg.norm(m, axis=1)[:, None]
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(m)]
    rows += [(50, rows[50][1]), (50, rows[50][1]), (100, rows[7][1]), (7, rows[8][1]), (1000, None), (1050, [None] * 12), (1100, [float("nan")] * 12), (1150, [float("inf")] * 12), (None, rows[1][1]), (1200, [1.0, 2.0]), (1250, [])]
    monkeypatch.setattr(exact_topk, "GROUP", 1 if rounds == 2 else 16)
    df = spark.createDataFrame(rows, "vec_id bigint, v array<float>")
    got = sorted(map(tuple, exact_topk.search(df, df.filter("vec_id % 50 = 0"), 5).collect()))
    assert got == brute_topk(rows, [x for x in rows if x[0] is not None and x[0] % 50 == 0], 5)


def test_topk_of_repeated_ids(spark):
    """The other row of a query's id is a candidate, and so is a second row with its vector; more columns and names don't matter."""
    rows = [(0, [1.0, 0.0], 1), (0, [0.5, 0.5], 2), (1, [0.2, 0.1], 3), (50, [0.1, 0.9], 4), (50, [0.1, 0.9], 5)]
    df = spark.createDataFrame(rows, "own bigint, score array<double>, rank int").select("own", "score")
    got = sorted(map(tuple, exact_topk.search(df, df.filter("own % 50 = 0"), 2).collect()))
    assert got == brute_topk([r[:2] for r in rows], [r[:2] for r in rows if r[0] % 50 == 0], 2)
    assert (0, 1, 0, 32768) in got


def test_topk_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id bigint, v array<float>")
    assert exact_topk.search(df, df).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id bigint, v array<float>")
    assert exact_topk.search(one, one).count() == 0


def words(r, syllables, n):
    return " ".join("".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(n))


def test_language_id_on_held_out_rows(spark, awkward, nothing):
    r = random.Random(1)
    kinds = {"aa": ["ka", "to", "ri", "mu"], "bb": ["sch", "ein", "ung", "keit"], "cc": ["tion", "ez", "ña", "llo"]}
    rows = [(i, words(r, kinds[k], 30), k) for i in range(240) for k in [r.choice(list(kinds))]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(docs.filter("doc_id % 2 = 0"))
    got = {x.doc_id: x for x in language_id.predict(docs, model).collect()}
    right = [got[i].lang_pred == k for i, _, k in rows if i % 2]
    assert np.mean(right) > 0.98 and all(0 <= x.score <= 1 for x in got.values())
    # copies are one learning text: a label whose rows are nearly all copies is learned, and a sample of 12 holds 12 a label
    copies = docs.union(spark.createDataFrame([(1000 + i, "uuh oooh uuh" if i else "ooouh uuuoh", "dd") for i in range(900)], docs.schema))
    few = language_id.fit(copies.filter("doc_id % 2 = 0"), per_label=12)
    assert few.labels == ["aa", "bb", "cc", "dd"] and few.predict("uuh oooh")[0] == "dd" and few.predict(rows[1][1])[0] == rows[1][2]
    again = language_id.fit(copies.filter("doc_id % 2 = 0").orderBy("text"), per_label=12)
    assert (few.weights == again.weights).all() and few.t == again.t
    odd = language_id.predict(awkward, model).collect()
    assert {x.lang_pred for x in odd if x.doc_id in (0, 1, 2)} == {"und"} and len(odd) == awkward.count()
    assert language_id.predict(nothing, model).count() == 0
    untaught = language_id.fit(nothing.select("text", "lang"))
    assert {x.lang_pred for x in language_id.predict(docs, untaught).collect()} == {"und"}


def test_temperature_spreads_wrong_confidence():
    s = np.array([[8.0, 0.0]] * 50)
    y = np.array([0] * 30 + [1] * 20)
    p = language_id.softmax(s / language_id.temperature(s, y))[0, 0]
    assert abs(p - 0.6) < 0.05


def toxic_rows(n=500):
    r = random.Random(2)
    clean, bad = ["tion", "er", "the", "an", "re", "ou", "in", "st"], ["snarfl", "dweebo", "grobnik", "plonkar"]
    rows = []
    for i in range(n):
        w = words(r, clean, 25).split()
        mark = int(i % 3 == 0)
        if mark:
            w.insert(r.randint(0, 24), r.choice(bad) + r.choice(["", "", "x", "."]))
        rows.append((i, " ".join(w), mark))
    return rows


def test_toxicity_on_held_out_rows(spark, awkward, nothing):
    rows = toxic_rows()
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, m) for i, _, m in rows] + [(None, 1), (10**6, 1), (3, None)], "doc_id bigint, toxic int")
    machine = toxicity.learn(docs, labels)
    got = {x.doc_id: x.score for x in toxicity.scores(docs, machine).collect()}
    held = [(got[i] >= 0.5) == bool(m) for i, _, m in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 60 and np.mean(held) > 0.95
    assert {x.doc_id: x.score for x in toxicity.scores(docs, toxicity.learn(docs.orderBy("text"), labels)).collect()} == got  # reruns agree
    spelled = spark.createDataFrame([(1, "you d w e e b o there"), (2, "you d.w.e.e.b.o there"), (3, "you grobbnik there"), (4, "the thing of an er"), (5, ""), (6, None), (7, "GROBNIK!!")], "doc_id bigint, text string")
    s = {x.doc_id: x.score for x in toxicity.scores(spelled, machine).collect()}
    assert min(s[1], s[2], s[3], s[7]) >= 0.5 and max(s[4], s[5], s[6]) < 0.5
    assert toxicity.scores(awkward, machine).count() == awkward.count() and toxicity.scores(nothing, machine).count() == 0
    assert toxicity.learn(docs, labels.filter("toxic = 0")) is None
    assert {x.score for x in toxicity.scores(docs, None).collect()} == {0.0}
    assert toxicity.without_toxic(docs, machine).count() == sum(v < 0.5 for v in got.values())


def test_collapsed_kernel_equals_landmark_kernel():
    forms = ["snarfl", "dweebo", "an", "tioner", "x", "grobnikplonkar"]
    v = toxicity.vectors(forms)
    dense = np.zeros((len(forms), toxicity.SLOTS))
    for i, (at, w) in enumerate(v):
        np.add.at(dense[i], at, w)
    m = toxicity.Machine(dense[0], 0.0)
    assert np.allclose(m.margins(forms), dense @ dense[0], atol=1e-4)


def test_kernel_equals_enumerated_subsequences():
    def brute(form):
        c, out = f"\1{form}\2", {}
        for n in (3, 4):
            for at in combinations(range(len(c)), n):
                if at[-1] - at[0] < 4 + toxicity.INSERTED and at[-1] - at[0] <= n - 1 + toxicity.INSERTED:
                    k = "".join(c[i] for i in at)
                    out[k] = out.get(k, 0) + toxicity.GAP ** (at[-1] - at[0] + 1)
        size = sum(v * v for v in out.values()) ** 0.5
        return {k: v / size for k, v in out.items()}

    r = random.Random(6)
    forms = ["banana", "abab", "aaaaaa", "x", "xyz", "dweebo", "dweeebo"] + ["".join(r.choices("abcde", k=r.randint(1, 12))) for _ in range(40)]
    own = toxicity.vectors(forms)
    dense = np.zeros((len(forms), toxicity.SLOTS))
    for i, (at, w) in enumerate(own):
        np.add.at(dense[i], at, w)
    sparse = [brute(f) for f in forms]
    want = np.array([[sum(v * b.get(k, 0) for k, v in a.items()) for b in sparse] for a in sparse])
    assert np.abs(dense @ dense.T - want).max() < 2e-3  # hashed slots may fall together
    assert np.allclose((dense**2).sum(1), 1, atol=1e-5)


def test_forms_do_not_follow_the_hash_seed():
    code = "from stimfuse.llm import toxicity as t; print([t.forms(x) for x in ('foo-barbaz', 'a.b.cde,fgh', 's!lly_thing')], t.train_tokens(['foo-barbaz', 'zzy'], ['plain', 'words', 'only']).margins(['foobarbaz', 'words']).tolist())"
    run = lambda seed: subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2], env=os.environ | {"PYTHONHASHSEED": seed}).stdout
    assert run("1") == run("2") == run("77")


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in toxic_rows(600)]
    clean = " ".join(t for _, t, m in toxic_rows(600) if not m).split()
    copy = " ".join(clean[:80])
    rows += [(1200 + i, copy, "en", "s1", len(copy)) for i in range(5)]
    passage = " ".join(clean[200:260])
    rows += [(1300 + i, f"{' '.join(clean[1000 + 50 * i :][:20])} {passage} {' '.join(clean[2000 + 50 * i :][:20])}", "en", "s2", 1) for i in range(4)]
    rows += [(1400, None, None, None, None), (1401, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, m) for i, _, m in toxic_rows(600)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], str(tmp_path)).persist())
    assert all(x.columns == docs.columns for x in seen[:-1])
    kept = {x.doc_id for x in seen[1].collect()}
    assert {i for i, _, m in toxic_rows(600) if m} & kept == set() and len(kept) >= 0.98 * (docs.count() - 200)
    # one of each group of fingerprints within 3 bits or five-word sets of similarity 0.8, by all pairs
    rows = sorted(((x.doc_id, x.text) for x in seen[1].collect()), key=lambda x: x[0])
    fp = [simhash_dedup.fingerprint(t) for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and ((fp[i] ^ fp[j]).bit_count() <= 3 or (both and both >= 0.8 * len(sets[i] | sets[j]))):
                root = [root[j] if x == root[i] else x for x in root]
    assert sorted(x.doc_id for x in seen[2].collect()) == sorted(min(rows[i][0] for i in range(len(rows)) if root[i] == c) for c in set(root))
    # every byte under a 50-byte string of a document with a smaller id goes
    texts = {x.doc_id: x.text for x in seen[2].collect()}
    first = {}
    for i, t in texts.items():
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], 1 << 62), i)
    want = {}
    for i, t in texts.items():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        want[i] = None if t is None else bytes(x for x, y in zip(b, gone, strict=True) if not y).decode("utf-8", "ignore")
    assert {x.doc_id: x.text for x in seen[3].collect()} == want
    assert any(want[i] != texts[i] for i in want)
    # as often as SQL says; texts without words once
    c = duckdb.connect()
    documents = seen[3].select("doc_id", "text", "source").toPandas()
    c.register("documents", documents)
    times = {int(r[0]): 1 if r[1] == 0 else int(r[4]) // int(r[1]) for r in c.sql(mixing.SQL).fetchall()}
    assert {x.doc_id: x["count"] for x in seen[4].groupBy("doc_id").count().collect()} == {i: n for i, n in times.items() if n}
    # and encoded as the library does
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted(map(tuple, seen[5].collect()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {i: np.array(library.encode_ordinary(t or ""), "<u4") for i, t in want.items()}
    assert got == sorted((i, len(ids[i]), sha(ids[i].tobytes()), sha((want[i] or "").encode())) for i, n in times.items() for _ in range(n))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == got


def test_language_model_equals_plain_python(spark):
    """The whole of fit() and predict() again, with dictionaries and loops: n-grams, document frequencies, leaders, temperature."""
    r = random.Random(4)
    kinds = {"aa": ["ka", "to", "É", "mu"], "bb": ["sch", "ein", "12", "keit"]}
    rows = [(i, words(r, kinds[k], r.randint(1, 6)), k) for i in range(40) for k in [r.choice(list(kinds))]] + [(90, None, "aa"), (91, "12 34", "bb"), (92, "einka", None)]
    rows += [(93, rows[0][1], rows[0][2])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(docs, epochs=2)
    bits = lambda x: x % 2**32

    def features(text):
        chars = [c if c.isalpha() else " " for c in (text or "").lower()]
        kept = [c for k, c in enumerate(chars) if c != " " or (k and chars[k - 1] != " ")]
        if not any(c != " " for c in chars):
            return None
        c, out = [32, *map(ord, kept), 32], {}
        grams = [bits(a * 0x9E3779B1) >> 17 for a in c]
        grams += [bits((bits(a * 0x85EBCA6B) ^ bits(b * 0xC2B2AE35)) * 0x9E3779B1) >> 17 for a, b in zip(c, c[1:], strict=False)]
        grams += [bits((bits(a * 0x27D4EB2F) ^ bits(b * 0x85EBCA6B) ^ bits(d * 0x165667B1)) * 0x9E3779B1) >> 17 for a, b, d in zip(c, c[1:], c[2:], strict=False)]
        for g in grams:
            out[g] = out.get(g, 0) + 1
        return out

    learning = [x for x in rows if x[2] is not None]
    df = {}
    for _, text, _ in learning:
        for g in features(text) or ():
            df[g] = df.get(g, 0) + 1
    idf = lambda g: math.log((1 + len(learning)) / (1 + df.get(g, 0))) + 1

    def vector(text):
        x = {g: math.log1p(n) * idf(g) for g, n in features(text).items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {g: v / size for g, v in x.items()}

    drawn = docs.filter("lang is not null and text rlike '\\\\p{L}'").selectExpr("lang", "text", "xxhash64(text) digest").distinct().selectExpr("*", "shiftrightunsigned(xxhash64(digest, lang), 11) o").collect()
    order = []
    for label in kinds:
        mine = sorted((x for x in drawn if x.lang == label), key=lambda x: (x.o, x.digest))
        order += [(k + 1, label, x.text) for k, x in enumerate(mine)]
    order.sort()
    labels = sorted(kinds)
    z, n = [{} for _ in labels], [{} for _ in labels]
    alpha, beta, l1, l2 = 1.0, 1.0, 0.02, 0.01

    def weight(c, g):
        v = z[c].get(g, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n[c].get(g, 0.0))) / alpha + l2)

    def scored(x):
        return [sum(v * weight(c, g) for g, v in x.items()) for c in range(len(labels))]

    def probabilities(s):
        e = [math.exp(v - max(s)) for v in s]
        return [v / sum(e) for v in e]

    every = round(1 / language_id.HELD)
    for _ in range(2):
        for place, label, text in order:
            if place % every == 0:
                continue
            x = vector(text)
            p = probabilities(scored(x))
            w = {(c, g): weight(c, g) for c in range(len(labels)) for g in x}
            for c, name in enumerate(labels):
                for g, v in x.items():
                    grad = (p[c] - (name == label)) * v
                    old = n[c].get(g, 0.0)
                    z[c][g] = z[c].get(g, 0.0) + grad - (math.sqrt(old + grad * grad) - math.sqrt(old)) / alpha * w[c, g]
                    n[c][g] = old + grad * grad
    assert model.labels == labels
    for c in range(len(labels)):
        seen = {g: weight(c, g) for g in z[c]}
        assert all(abs(model.weights[g, c] - v) < 1e-5 for g, v in seen.items())
        assert all(model.weights[g, c] == 0 for g in range(language_id.DIMENSIONS) if g not in seen)
    got = {x.doc_id: x for x in language_id.predict(docs, model).collect()}
    for i, text, _ in rows:
        if features(text) is None:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        p = probabilities([v / model.t for v in scored(vector(text))])
        assert got[i].lang_pred == labels[p.index(max(p))] and abs(got[i].score - max(p)) < 1e-4
