"""Spelling variants, substring dedup and collocations against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stimfuse.llm import collocations, fm_index, spelling_variants, substring_dedup, suffix_dedup
from stimfuse.llm.common import free_name


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_by_hand(rows, shortest=7, least=2, every=31, times=10):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if k >= least and len(w) >= shortest}
    form, count = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        count[w] = len(others)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return out


@pytest.fixture(scope="module")
def misspelled(spark):
    r = random.Random(2)
    letters = "abcdeé×ÿ"
    base = ["".join(r.choices(letters, k=r.randint(6, 10))) for _ in range(25)]
    words = []
    for w in base:
        words += [w] * r.choice([1, 3, 40, 500])
        for _ in range(r.randint(0, 6)):
            k, how = r.randrange(len(w)), r.randrange(3)
            v = w[:k] + ("" if how == 0 else r.choice(letters)) + w[k + (how < 2) :]
            words += [v.upper() if r.random() < 0.3 else v] * r.choice([1, 2, 4, 40])
    words += ["a" * 5000, "a" * 4999 + "b"] * 2 + ["anagram", "managra", "nagaram"] * 3
    r.shuffle(words)
    rows = [(k if k % 9 else None, " 1".join(words[k * 20 : k * 20 + 20])) for k in range(len(words) // 20 + 1)] + [(4, None), (5, ""), (6, "short 123")]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), rows


def test_variants_against_all_pairs(spark, misspelled, awkward, nothing):
    docs, rows = misspelled
    want = variants_by_hand(rows)
    assert {tuple(r) for r in spelling_variants.variants(docs).collect()} == want
    assert any(form and root != form for _, form, root, *_ in want) and any(n > 1 for *_, n, _ in want)
    got = {tuple(r) for r in spelling_variants.variants(awkward, shortest=4, times=2).collect()}
    assert got == variants_by_hand([(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()], shortest=4, times=2)
    assert spelling_variants.variants(nothing).count() == 0


def test_large_signatures_are_dealt_in_parts(spark, misspelled):
    words = spelling_variants.vocabulary(misspelled[0]).cache()
    whole = sorted(map(tuple, spelling_variants.near_pairs(words).collect()))
    assert sorted(map(tuple, spelling_variants.near_pairs(words, group=2).collect())) == whole
    assert sorted(map(tuple, spelling_variants.near_pairs(words, parts=4).collect())) == whole
    assert len(whole) == len(set(whole))


def test_near_words_share_a_signature():
    r = random.Random(7)
    for _ in range(300):
        w = "".join(r.choices("aabbcdeéz", k=r.randint(7, 14)))
        k, how = r.randrange(len(w)), r.randrange(3)
        v = w[:k] + ("" if how == 0 else r.choice("abxé")) + w[k + (how < 2) :]
        sigs, mask = spelling_variants.signatures([w, v])
        assert (sigs[0] == sigs[1]).any() and int(mask[0] ^ mask[1]).bit_count() <= 2


def test_runs_are_not_cut(monkeypatch):
    text = " ".join("x" * k for k in range(1, 60))
    whole = re.findall(r"x{7,}", text)
    monkeypatch.setattr(spelling_variants, "PIECE", 10)
    assert [w for part in spelling_variants.runs_of(text, 7) for w in part] == whole


@pytest.mark.parametrize("seed", range(6))
def test_intervals_against_counts(seed):
    r = random.Random(seed)
    for _ in range(60):
        n_words, length, count = r.choice([1, 2, 3, 8, 50]), r.choice([2, 3, 5, 8]), r.choice([2, 3])
        texts = [[r.randint(1, n_words) for _ in range(r.randint(1, 30))] for _ in range(r.randint(1, 8))]
        flat = np.array([x for t in texts for x in [*t, 0]])
        sizes = np.array([len(t) for t in texts])
        begins = np.cumsum(sizes + 1) - sizes - 1
        index = fm_index.FMIndex(flat, n_words + 1)
        order = fm_index.suffix_order(flat)
        ends = iter(range(len(flat)))
        told = [x if x else -1 - len(flat) + next(ends) for x in flat.tolist()]
        assert order.tolist() == sorted(range(len(flat)), key=lambda k: told[k:])
        for symbol in range(1, n_words + 1):
            at = np.arange(len(flat) + 1)
            assert index.bwt.rank(np.full(len(at), symbol), at).tolist() == np.concatenate([[0], np.cumsum(flat[order - 1] == symbol)]).tolist()
        seen = Counter(tuple(t[k : k + length]) for t in texts for k in range(len(t) - length + 1))
        got = Counter()
        for q, start, stop in zip(*index.intervals(flat, begins, begins + sizes, length, count), strict=True):
            got.update((int(q), k - int(begins[q])) for k in range(start, stop - length + 1))
        assert set(got) == {(q, k) for q, t in enumerate(texts) for k in range(len(t) - length + 1) if seen[tuple(t[k : k + length])] >= count}


def passages_by_hand(rows, length):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    seen = Counter(tuple(w[k : k + length]) for w in words for k in range(len(w) - length + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = {k + i for k in range(len(w) - length + 1) if seen[tuple(w[k : k + length])] > 1 for i in range(length)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def passages(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 4)))
    text = lambda n: [word() for _ in range(n)]
    common, other = text(60), text(38)
    texts = [text(r.randint(0, 120)) for _ in range(30)]
    texts += [text(20) + common[a : a + n] + text(20) for a, n in ((0, 60), (5, 40), (10, 34), (10, 35), (20, 40), (0, 36), (25, 35))]
    texts += [common, common, text(5) + other + text(3) + other, ["x", "y"] * 60, ["z"] * 36, ["z"] * 35, ["q"] * 35, common + other]
    joined = [r.choice([" ", "\n", " \t "]).join(t) for t in texts]
    rows = [(k if k % 7 else None, t) for k, t in enumerate(joined)] + [(500, None), (501, ""), (2, joined[40]), (3, joined[3]), (3, joined[3])]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), rows


@pytest.mark.parametrize("how", [{}, {"shard_bytes": 300}, {"shard_bytes": 300, "hot": 0}])
def test_passages_against_all_windows(spark, passages, how, monkeypatch):
    docs, rows = passages
    want = passages_by_hand(rows, 35)
    assert sum(n for _, _, n, _ in want) > 500
    got = sorted(map(tuple, substring_dedup.removal_digests(docs, 35, **how).collect()), key=str)
    assert got == want


def test_passages_in_small_slices(spark, passages, awkward, nothing, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE", 500)
    monkeypatch.setattr(substring_dedup, "PIECE", 16)
    monkeypatch.setattr(substring_dedup, "STREAM", 3)
    batch = passages[0].selectExpr("coalesce(doc_id, -1) doc", "hash(text) key", "coalesce(text, '') text").toArrow().combine_chunks().to_batches()[0]
    windows = Counter()
    for ids, _, before, s in substring_dedup._slices(batch, 35):
        for doc, at, k in zip(ids.tolist(), before.tolist(), range(len(s.h)), strict=True):
            assert len(s.context(k).split()) == s.hi[k] - s.lo[k]
            windows.update((doc, at + x) for x in range(s.lo[k], s.hi[k] - 34))
    want = Counter((-1 if doc is None else doc, k) for doc, t in passages[1] for k in range(len((t or "").split()) - 34))
    assert windows == want
    monkeypatch.undo()
    for length in (10, 35):
        got = sorted(map(tuple, substring_dedup.removal_digests(awkward, length).collect()), key=str)
        assert got == passages_by_hand([(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()], length)
    assert substring_dedup.removal_digests(nothing).count() == 0 and substring_dedup.remove(nothing).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.spans(nothing, 5)


def test_passages_removed_from_texts_with_any_columns(spark, passages):
    docs, rows = passages
    wide = docs.selectExpr("*", "1 as runs", "2 as row", "3 as `key`", "4 as doc")
    got = substring_dedup.remove(wide).collect()
    assert substring_dedup.remove(wide).schema == wide.schema and len(got) == len(rows)
    kept = sorted(((r.doc_id, hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")).encode()).hexdigest()) for r in got), key=str)
    assert kept == sorted(((doc, h) for doc, _, _, h in passages_by_hand(rows, 35)), key=str)
    assert free_name("runs", ["Runs", "runs_"]) == "runs__"


def phrases_by_hand(rows, longest=4, least=30, share=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), left, right))
        rows_.sort()
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(rows_[:top])]
    return sorted(out)


def test_collocations_against_counts(spark, awkward, nothing):
    r = random.Random(5)
    words = ["the", "The", "of", "é", "end x", "\x1c", "a-b", "_", "rare"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", " ", "\t", "  ", ". ", "\n", "!?"]) for _ in range(n))
    rows = [(["en", None, "und", "ß"][k % 4], text(r.randint(0, 80)) + r.choice(["one two three four ", "two three ", ""])) for k in range(120)] + [("en", None), (None, ""), ("xx", " \n.")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    for how in ({"least": 3}, {"least": 5, "top": 7}, {"least": 4, "share": 50, "longest": 3}):
        got = collocations.collocations(docs, **how)
        assert [t for _, t in got.dtypes] == ["string", "bigint", "string", "bigint", "bigint", "bigint", "bigint", "bigint"]
        assert sorted(map(tuple, got.collect())) == phrases_by_hand(rows, **how)
    got = sorted(map(tuple, collocations.collocations(awkward).collect()))
    assert got == phrases_by_hand([(x.lang, x.text) for x in awkward.select("lang", "text").collect()]) and got
    assert collocations.collocations(nothing).count() == 0


def test_rare_places_leave_the_relation(spark):
    docs = spark.createDataFrame([("en", "a b c x a b c"), ("en", "a b. c a b c y")], "lang string, text string")
    rel = collocations.relation(docs)
    first = collocations.counts(rel, 1).filter("f >= 3 and phrase <> ''")
    assert sorted(r.phrase for r in first.collect()) == ["a", "b", "c"]
    kept = collocations.frequent_places(rel, first, 1, 3, 20).collect()
    runs = sorted(x.strip() for row in kept if row.runs for x in bytes(row.runs).split(b"\xff") if x.strip())
    assert runs == [b"a b", b"a b c", b"a b c", b"c a b c"]
    heavy = collocations.heavy_buckets(spark.createDataFrame([r for r in kept if r.part is not None], collocations.STORED), 3, 20)
    assert np.unpackbits(heavy).sum() == 2  # a b, four times, and b c, three times; c a is rare


def test_buckets_of_many_rows_are_dealt_together(spark, monkeypatch):
    """Rows of buckets grow with their ranges, not with rows of the relation times ranges, and equal buckets of rows are summed."""
    monkeypatch.setattr(collocations, "ROW", 200)
    r = np.random.default_rng(4)
    docs = spark.createDataFrame([("en", " ".join(map(str, r.integers(0, 40, 60)))) for _ in range(80)], "lang string, text string").coalesce(1)
    rel = collocations.relation(docs)
    shift = collocations.BITS - 5
    first = collocations.counts(rel, 1).filter("phrase <> ''")
    kept = collocations.frequent_places(rel, first, 1, 30, shift).collect()
    assert sum(x.runs is not None for x in kept) >= 40 and sum(x.part is not None for x in kept) <= 32
    heavy = np.unpackbits(collocations.heavy_buckets(spark.createDataFrame([x for x in kept if x.part is not None], collocations.STORED), 30, shift), bitorder="little")
    two = collocations.counts(rel, 2).collect()
    total = {}
    for x in two:
        words = collocations.Occurrences.read(x.phrase.encode())
        at = int(words.buckets("en", 2, collocations.BITS)[3][0])
        total[at] = total.get(at, 0) + x.f
    assert len(two) > 1000 and set(np.flatnonzero(heavy).tolist()) == {k for k, n in total.items() if n >= 30}


def test_parts_of_buckets_are_summed_at_once(spark):
    """No job per part, which would sum them one after another."""
    rows = spark.createDataFrame([(p, (np.array([p << 20], "<u4")).tobytes(), np.array([5], "<u4").tobytes()) for p in range(64)], "part bigint, bucket binary, n binary").repartition(64, "part")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        spark.sparkContext.setJobGroup("parts", "parts of buckets")
        assert np.unpackbits(collocations.heavy_buckets(rows, 5, 20)).sum() == 64
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("parts")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.sparkContext._jsc.clearJobGroup()
    assert len(jobs) < 30


def test_passages_meet_their_runs_deflated(spark):
    """Texts that lose words are shuffled small: a text that says much the same takes a fraction of its bytes."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 3}x{k % 400}" for k in range(3000)) + " é") for i in range(12)], "doc_id bigint, text string")
    whole, others = suffix_dedup.with_runs(docs, 35, "doc_id", "text", substring_dedup.spans, packed=True)
    rows = others.collect()
    assert len(rows) + whole.count() == 12 and rows and all(len(r.text) < 0.3 * len(zlib.decompress(r.text)) for r in rows)
    assert {r.id: zlib.decompress(r.text).decode() for r in rows}.items() <= {r.doc_id: r.text for r in docs.collect()}.items()


@pytest.mark.parametrize("k", [1, 2, 3])
def test_hashes_of_places_are_those_of_phrases(k):
    """No phrase of a row is put together to ask for it: its words' hashes are mixed, as those of a frequent phrase are."""
    found = collocations.Occurrences.read("a b a b c \xff a b é c".encode().replace("\xff".encode(), collocations.END))
    assert found.words[5] == collocations.END and found.word.tolist() == [1, 2, 1, 2, 3, 0, 1, 2, 4, 3]
    _, _, first, h = found.hashed("xx", k)
    phrases = [found.phrase(p, k) for p in first.tolist()]
    assert h.view(np.int64).tolist() == collocations._hashes("xx", phrases, k).to_pylist() and len(set(h.tolist())) == len(phrases)
    assert not set(h.tolist()) & set(found.hashed("yy", k)[3].tolist())


@pytest.mark.parametrize("digests", [substring_dedup.removal_digests, suffix_dedup.removal_digests])
def test_texts_pass_one_python_worker_a_task(passages, digests):
    """A Python step that feeds another one without an exchange would keep two workers a task, each with its memory."""
    plan = digests(passages[0], 35)._jdf.queryExecution().sparkPlan().toString().splitlines()
    steps = [k for k, line in enumerate(plan) if "MapInArrow" in line]
    assert len(steps) == 3
    for a, b in zip(steps, steps[1:], strict=False):  # a step's own input stands below it
        assert any("Join" in line or "Scan" in line or "Union" in line for line in plan[a + 1 : b])
