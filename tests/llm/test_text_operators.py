"""BPE, token counts, TIFF, mixing, license scan, SimHash and suffix dedup against brute force and exact round trips."""

import base64
import hashlib
import random
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from tokenizers import Tokenizer

from stimfuse.llm import byte_bpe, common, components, license_scan, media_tiff, mixing, near_copies, simhash_dedup, suffix_dedup, token_counts
from stimfuse.session import shared_dir

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    own = byte_bpe.ByteBPE(RANKS, P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library_on_random_texts(bpe):
    own, library = bpe
    r = random.Random(1)
    alphabet = list("abcdeé ñ\n\r\t\x1c\x85\xa0　  's'll12٣!?.,中文字\U0001d4b3\U0001f600<|endoftext|>  ")
    for k in range(6000):
        x = "".join(r.choices(alphabet if k % 2 else "etaoinshr", k=r.randint(0, 40)))
        ids = own.encode(x)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(x), repr(x)
        assert own.decode(ids) == x.encode()


def test_bpe_rows(spark, awkward, nothing, bpe):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.encode_digests(awkward, RANKS, P.PATTERN).collect()}
    want = set()
    for r in awkward.select("doc_id", "text").collect():
        ids = bpe[1].encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == want
    assert byte_bpe.encode_digests(nothing, RANKS, P.PATTERN).count() == 0
    ids = byte_bpe.encode_texts(awkward.filter("doc_id = 12"), RANKS, P.PATTERN)
    back = byte_bpe.decode_ids(ids, RANKS, P.PATTERN).first()["bytes"]
    assert bytes(back).decode() == awkward.filter("doc_id = 12").first().text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_and_cache(spark, awkward, nothing, name):
    cache = shared_dir(spark, "cache")
    got = sorted(map(tuple, token_counts.with_token_counts(awkward, P.path(name), cache).collect()), key=str)
    if name.endswith(".json"):
        t = Tokenizer.from_file(P.path(name))
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        import sentencepiece

        t = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        count = lambda x: len(t.encode(x))
    want = [(r.doc_id, len((r.text or "").encode()), count(r.text or ""), count(r.text or "") > 1024) for r in awkward.select("doc_id", "text").collect()]
    assert got == sorted(want, key=str)
    stored = spark.read.parquet(cache).count()
    assert spark.read.parquet(cache).select("content_digest").distinct().count() == awkward.selectExpr("coalesce(text, '') t").distinct().count()
    token_counts.with_token_counts(awkward, P.path(name), cache).count()
    assert spark.read.parquet(cache).count() == stored  # a warm cache is not added to
    assert token_counts.with_token_counts(nothing, P.path(name), shared_dir(spark, "cache")).count() == 0


def test_token_counts_of_null_and_repeated_ids(spark):
    rows = [(None, f"text {i % 700} of many") for i in range(1000)] + [(5, f"other {i % 40}") for i in range(200)]
    cache = shared_dir(spark, "cache")
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = token_counts.with_token_counts(spark.createDataFrame(rows, "doc_id bigint, text string"), P.path("byte_bpe_50k.json"), cache)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == Counter((i, len(x), len(t.encode(x).ids)) for i, x in rows)
    assert spark.read.parquet(cache).select("content_digest").distinct().count() == 740


@pytest.mark.parametrize("compression", [media_tiff.NONE, media_tiff.LZW, media_tiff.DEFLATE, media_tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16, 48])
def test_tiff_round_trip(compression, predictor, tile):
    r = random.Random(3)
    pages = [bytes(r.choices(range(values), k=64 * rows)) for rows in (1, 7, 300) for values in (1, 2, 256)]
    media = media_tiff.write_tiff(pages, 64, compression, predictor, tile, 1000)
    assert [a.tobytes() for _, a in media_tiff.decoded(media)] == pages


def test_tiff_codecs_on_known_bytes():
    # fixed values: the examples of the TIFF 6.0 specification (LZW codes of 9 bits) and of the PackBits note
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert media_tiff.lzw_decode(packed, 99) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert media_tiff.packbits_decode(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 99) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    r = random.Random(1)
    for n in (0, 1, 5000, 70000):
        for values in (1, 3, 256):
            x = bytes(r.choices(range(values), k=n))
            assert media_tiff.lzw_decode(media_tiff.lzw_encode(x), n) == x == media_tiff.packbits_decode(media_tiff.packbits_encode(x), n)


def tiff(pages, order="<"):
    """A file of pages (tags {tag: (type, numbers or raw bytes)}, blocks): blocks stand in front, tags 273 or 324 get their offsets."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for tags, blocks in pages:
        offsets = []
        for x in blocks:
            offsets.append(len(out))
            out += x
        tags = {t: (4, offsets) if v is None else v for t, v in tags.items()}
        struct.pack_into(order + "I", out, link, len(out))
        at, tail = len(out) + 2 + 12 * len(tags) + 4, b""
        head = struct.pack(order + "H", len(tags))
        for t, (kind, values) in sorted(tags.items()):
            raw = values if isinstance(values, bytes) else struct.pack(f"{order}{len(values)}{ {1: 'B', 3: 'H', 4: 'I'}[kind]}", *values)
            head += struct.pack(order + "HHI", t, kind, len(values) if not isinstance(values, bytes) or kind == 2 else len(values) // 8)
            head += raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", at + len(tail))
            tail += raw if len(raw) > 4 else b""
        link = len(out) + len(head)
        out += head + bytes(4) + tail
    return bytes(out)


def test_tiff_planes_samples_and_damage():
    M = media_tiff
    r = np.random.default_rng(3)
    base = lambda w, h, n=1, bits=8: {256: (3, [w]), 257: (3, [h]), 258: (3, [bits] * n), 259: (3, [8]), 277: (3, [n])}
    for order in "<>":
        a = r.integers(0, 65536, (5, 7, 3)).astype(np.uint16)
        kind = np.dtype(f"{order}u2")
        plane = lambda x: [zlib.compress(x[y : y + 2].astype(kind).tobytes()) for y in (0, 2, 4)]
        planar = (base(7, 5, 3, 16) | {284: (3, [2]), 278: (3, [2]), 273: None, 279: (4, [len(x) for k in range(3) for x in plane(a[..., k])])}, [x for k in range(3) for x in plane(a[..., k])])
        chunky = (base(7, 5, 3, 16) | {278: (3, [2]), 273: None, 279: (4, [len(x) for x in plane(a)])}, plane(a))
        diff = np.diff(a, axis=1, prepend=np.zeros((5, 1, 3), np.uint16))
        differs = (chunky[0] | {317: (3, [2]), 279: (4, [len(x) for x in plane(diff)])}, plane(diff))
        assert all((x == a).all() for _, x in M.decoded(tiff([planar, chunky, differs], order)))
    one = zlib.compress(bytes(range(16)))
    good = (base(4, 4) | {278: (4, [4]), 273: None, 279: (4, [len(one)])}, [one])
    bad = [
        ({**good[0], 256: (2, b"four\0")}, [one]), ({**good[0], 256: (5, struct.pack("<II", 4, 1))}, [one]), ({**good[0], 257: (4, [8])}, [one]),
        ({**good[0], 278: (4, [2])}, [one]), ({**good[0], 278: (4, [0])}, [one]), ({**good[0], 259: (3, [7])}, [one]), ({**good[0], 317: (3, [3])}, [one]),
        ({**good[0], 284: (3, [3])}, [one]), ({**good[0], 256: (4, [4_000_000_000]), 257: (4, [4_000_000_000])}, [one]), ({**good[0], 279: (4, [3])}, [one]),
        ({t: v for t, v in good[0].items() if t != 273}, [one]), ({**good[0], 258: (3, [4])}, [one]), ({**good[0], 322: (3, [0]), 323: (3, [16]), 324: (4, [8]), 325: (4, [9])}, [one]),
    ]
    rows = list(M.read_pages(tiff([x for b in bad for x in (b, good)])))
    assert [x[0] for x in rows] == list(range(2 * len(bad)))
    assert all(x[-1] for x in rows[::2]) and all(x[-1] is None and x[1:5] == (4, 4, 1, 8) and x[-2] == hashlib.sha256(bytes(range(16))).hexdigest() for x in rows[1::2])
    bomb = zlib.compress(bytes(1 << 26))
    [(_, a)] = M.decoded(tiff([(base(4, 4) | {278: (4, [4]), 273: None, 279: (4, [len(bomb)])}, [bomb])]))
    assert a.shape == (4, 4, 1) and not a.any()
    whole = tiff([good, good])
    for cut in range(0, len(whole), 7):  # cut anywhere: rows, never an exception
        assert list(M.read_pages(whole[:cut]))
    for k in range(0, len(whole)):
        list(M.read_pages(whole[:k] + bytes([whole[k] ^ 0xFF]) + whole[k + 1 :]))


def test_tiff_pages_and_features(spark, awkward, nothing, monkeypatch):
    one = media_tiff.write_tiff([bytes(range(128)), bytes(64)], 64, media_tiff.NONE, 1)
    loop = bytearray(one)
    struct.pack_into("<I", loop, loop.rindex(struct.pack("<I", 0)), struct.unpack_from("<I", loop, 4)[0])
    media = spark.createDataFrame([(1, bytearray(one), 1), (2, None, 2), (3, bytearray(b""), 3), (4, bytearray(b"junk"), 4), (5, loop, 5), (None, bytearray(one), 6)], "doc_id bigint, media binary, page int")
    got = {}
    for r in media_tiff.pages(media, "doc_id", "media").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [(x.page, x.width, x.height, x.error) for x in got[1]] == [(0, 64, 2, None), (1, 64, 1, None)] and len(got[None]) == 2
    assert 2 not in got and got[3][0].error and got[4][0].error
    texts = {r.doc_id: r.text for r in awkward.filter("doc_id > 3").collect()}
    layouts = set()
    for r in media_tiff.text_features(awkward.filter("doc_id > 3"), 64).collect():
        raw = media_tiff.padded(texts[r.doc_id].encode())
        layouts.add(zlib.crc32(raw) % 4)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        # the stored form, written again and read page by page
        media = media_tiff.stored(texts[r.doc_id])
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert b"".join(a.tobytes() for _, a in media_tiff.decoded(media)) == raw
        assert f" mean={sum(raw) / len(raw):.6f} min={min(raw)} max={max(raw)} " in r.feature
    assert layouts == {0, 1, 2, 3}
    monkeypatch.setattr(media_tiff, "PAGE_BYTES", 2048)
    for t in texts.values():
        assert b"".join(a.tobytes() for _, a in media_tiff.decoded(media_tiff.stored(t))) == media_tiff.padded(t.encode())
    assert {r.payload_bytes for r in media_tiff.text_features(awkward.filter("text is null")).collect()} == {64}
    assert media_tiff.text_features(nothing).count() == 0
    assert {p.error for p in media_tiff.pages(media_tiff.store_texts(awkward), "doc_id", "media").collect()} == {None}


def test_mixing_equals_sql(spark, awkward, nothing):
    c = duckdb.connect()
    documents = awkward.select("doc_id", "text", "source").toPandas()
    c.register("documents", documents)
    want = Counter((None if r[0] is None or r[0] != r[0] else int(r[0]), int(r[1]), int(r[2]), round(r[3], 6), int(r[4])) for r in c.sql(mixing.SQL.replace("doc_id::varchar", "doc_id::bigint::varchar")).fetchall())
    got = Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(awkward, [3.0, 1.0, 2.0]).collect())
    assert got == want
    for r in mixing.mix(awkward, [3.0, 1.0, 2.0]).groupBy("key").agg({"taken": "sum", "target": "max", "size": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= r["max(size)"]
    rows = mixing.mixed(awkward, [3.0, 1.0, 2.0])
    assert rows.columns == awkward.columns
    assert mixing.mix(nothing, [3.0, 1.0, 2.0]).count() == 0 and mixing.mixed(nothing, [3.0]).count() == 0


def test_license_scan_finds_templates_and_spans(spark, nothing):
    text = "é intro\n Permission is granted, free of charge, to any person obtaining one copy of this software and the associated documentation files. end. Released under  the MIT-License."
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "MIT"), (5, "x " * 50000 + "Licensed under CC BY-NC 4.0. " + "y " * 1000), (1, text)], "doc_id bigint, text string")
    got = license_scan.scan(docs).collect()
    found = Counter((r.doc_id, r.license) for r in got)
    assert found == {(1, "mit-grant"): 2, (1, "mit-notice"): 2, (5, "cc-by-nc-4.0-notice"): 1}
    for r in got:
        raw = (text if r.doc_id == 1 else docs.filter("doc_id = 5").first().text).encode()
        assert raw[r.start_byte : r.end_byte].decode() == r.matched and 0.8 <= r.coverage <= 1
    assert license_scan.scan(nothing.select("doc_id", "text")).count() == 0
    assert license_scan.scan(docs, {}).count() == 0


def test_license_scan_aligns_every_diagonal():
    index = license_scan.Index(license_scan.TEMPLATES)
    found = lambda text: [(m[0], text[m[2] : m[3]]) for m in license_scan.scan_text(text.encode(), index)]
    apache, mit = "licensed under the apache license version 2 0", "Released under the MIT License"
    assert found(f"it is licensed under the gnu gpl {apache}") == [("apache-2.0-notice", apache)]
    assert found(f"{mit}. {mit}.") == [("mit-notice", mit)] * 2
    assert found(f"Released under the MIT. {mit}.") == [("mit-notice", "Released under the MIT"), ("mit-notice", mit)]
    assert found(". ".join([mit] * 20)) == [("mit-notice", mit)] * 20


def test_license_scan_tells_licenses_apart(spark, awkward):
    index = license_scan.Index(license_scan.TEMPLATES)
    found = lambda text: [m[0] for m in license_scan.scan_text(text.encode(), index)]
    assert found("Released under the BSD License.") == ["bsd-notice"]
    assert found("Released under the Foo License.") == []
    assert found("Licensed under CC BY 4.0.") == ["cc-by-4.0-short-notice"]
    assert found("Licensed under CC BY-NC-SA 4.0.") == ["cc-by-nc-sa-4.0-notice"]
    assert found("Licensed under CC BY-NC-XY 4.0.") == []
    assert found("Licensed under the MIT License, Version 2.0.") == ["mit-notice"]
    assert found("licensed under the GNU Lesser General Public License, version 3") == ["lgpl-3.0-notice"]
    assert found("Licensed under CC BY-NC 4.0. " * 6) == ["cc-by-nc-4.0-notice"] * 6
    for name, text in license_scan.TEMPLATES.items():
        plain = text.replace("{", "").replace("}", "")
        assert [(m[0], m[1]) for m in license_scan.scan_text(f"before it {plain} and after".encode(), index) if m[0] == name] == [(name, 1.0)]
        assert name in found(" ".join(w for k, w in enumerate(plain.split()) if k != len(plain.split()) // 5) if len(plain.split()) > 30 else plain)
    line = "Released under the MIT License."
    rows = [(None, line, "a", 1), (None, line, "b", 2), (7, line, None, 3), (7, line, None, 3), (8, None, "c", 4), (9, "x" * 100_000 + " " + line, "d", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, license string, coverage int")
    assert Counter((r.doc_id, r.license) for r in license_scan.scan(docs).collect()) == {(None, "mit-notice"): 2, (7, "mit-notice"): 2, (9, "mit-notice"): 1}
    assert license_scan.scan(awkward).count() == 0


def brute_license(template, groups, words, coverage=0.8):
    """Whether some window of words covers enough of the template, with the group (one at most) standing in it without gaps."""

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    for lo in range(len(words)):
        for hi in range(lo + 1, min(len(words), lo + 2 * len(template)) + 1):
            w = words[lo:hi]
            if groups:
                [(a, b)] = groups
                best = max((common(template[:a], w[:k]) + b - a + common(template[b:], w[k + b - a :]) for k in range(len(w)) if w[k : k + b - a] == template[a:b]), default=0)
            else:
                best = common(template, w)
            if best >= coverage * len(template) and best >= coverage * len(w):
                return True
    return False


def test_license_scan_equals_alignment_of_every_window():
    r = random.Random(8)
    templates = {"a": "released under the {permissive lion} license of records", "b": "every reader may copy change and share these pages without paying anybody", "c": "published under terms named {grant 77} by their writers"}
    index = license_scan.Index(templates)
    filler = "released reader under pages the of grant lion 77 copy and extra noise words permissive license".split()
    hits = 0
    for _ in range(1500):
        words = r.choices(filler, k=r.randint(0, 6))
        for _ in range(r.randint(1, 3)):
            w = templates[r.choice("abc")].replace("{", "").replace("}", "").split()
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [r.choice(filler)], [w[k], r.choice(filler)], [w[k]]])
            words += w + r.choices(filler, k=r.randint(0, 6))
        got = {m[0] for m in license_scan.scan_text(" ".join(words).encode(), index)}
        for k, name in enumerate(index.names):
            want = brute_license([x.decode() for x in index.words[k]], index.groups[k], words)
            hits += want
            assert (name in got) == want, (name, words)
    assert hits > 300


def brute_simhash(text, size=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = regex.findall(r"[^\x20\x09-\x0D]+", text)
    sh = [" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("chunk", [256, 4])
def test_near_copies_equal_brute_force(spark, monkeypatch, nothing, chunk):
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    r = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(25):
        base = r.choices(words, k=200)
        texts.append(base)
        texts += [[r.choice(words) if k in edits else w for k, w in enumerate(base)] for n in (1, 2, 3, 4, 5, 6, 9) for edits in [set(r.sample(range(200), n))]]
    chain = r.choices(words, k=300)  # each text is near the next one only
    texts += [chain[8 * k : 8 * k + 200] for k in range(12)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "two words"), (903, "Two  words"), (904, " ".join(texts[0]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    fp = [simhash_dedup.fingerprint(t) for _, t in rows]
    root, lost = list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            near, both = bin(fp[i] ^ fp[j]).count("1") <= 3, len(sets[i] & sets[j])
            alike = both > 0 and both >= 0.8 * len(sets[i] | sets[j])
            lost += alike and not near
            if (near or alike) and root[i] != root[j]:
                root = [root[j] if x == root[i] else x for x in root]
    want = {min(rows[i][0] for i in range(len(rows)) if root[i] == c) for c in set(root)}
    assert lost > 25
    assert {x.doc_id for x in simhash_dedup.keep_one(docs, similar=0.8).collect()} == want
    assert {x.doc_id for x in simhash_dedup.keep_one(docs).collect()} > want
    assert simhash_dedup.keep_one(nothing, similar=0.8).count() == 0


def test_simhash_equals_brute_force(spark, awkward, nothing):
    rows = awkward.select("doc_id", "text").collect()
    fp = [brute_simhash(r.text) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 3:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    name = {g: min((r.doc_id for r, x in zip(rows, group, strict=True) if x == g and r.doc_id is not None), default=None) for g in set(group)}
    want = Counter((r.doc_id, f if f < 2**63 else f - 2**64, name[g]) for r, f, g in zip(rows, fp, group, strict=True))
    assert Counter(map(tuple, simhash_dedup.near_duplicates(awkward).collect())) == want
    kept = simhash_dedup.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(set(group))
    assert simhash_dedup.near_duplicates(nothing).count() == 0 and simhash_dedup.keep_one(nothing).count() == 0


@pytest.mark.parametrize("sample", [1 << 16, 64])
def test_vantage_point_links_lose_nothing(spark, monkeypatch, sample):
    """With a small sample the first tree leaves large shards, which get trees of their own."""
    monkeypatch.setattr(simhash_dedup, "SAMPLE", sample)
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 300, dtype=np.int64).view(np.uint64)
    copies = [b ^ np.uint64(sum(1 << int(x) for x in r.choice(64, r.integers(1, 4), replace=False))) for b in base for _ in range(6)]
    fp = np.unique(np.concatenate([base, np.array(copies, np.uint64)]))
    monkeypatch.setattr(simhash_dedup, "SHARD", 40)
    monkeypatch.setattr(simhash_dedup, "BLOCK", 32)
    nodes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp bigint")
    got = {(r.node, r.component) for r in components.components(simhash_dedup.links(nodes)).collect()}
    root = {int(x): int(x) for x in fp.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp[:i]) <= 3):
            a, b = find(int(fp[i].view(np.int64))), find(int(fp[j].view(np.int64)))
            root[max(a, b)] = min(a, b)
    linked = {x for i in range(len(fp)) if (np.bitwise_count(fp[i] ^ fp) <= 3).sum() > 1 for x in [int(fp[i].view(np.int64))]}
    assert got == {(x, find(x)) for x in linked}


def brute_removed(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(first.get(b[k : k + length], 2**63), i)
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[(i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("how", [{}, {"shard_bytes": 2000, "hot": 2}, {"shard_bytes": 1000}])
def test_suffix_dedup_equals_brute_force(spark, awkward, nothing, how):
    rows = [(2**63 - 1 if r.doc_id is None else r.doc_id, r.text) for r in awkward.collect()]
    got = Counter((2**63 - 1 if r.doc_id is None else r.doc_id, *list(r)[1:]) for r in suffix_dedup.removal_digests(awkward, 50, **how).collect())
    assert got == brute_removed(rows, 50)
    assert suffix_dedup.removal_digests(nothing, 50, **how).count() == 0
    cut = suffix_dedup.remove(awkward, 50, **how)
    assert cut.columns == awkward.columns and cut.count() == awkward.count()


def test_suffix_dedup_deals_slices_together(spark, monkeypatch):
    """Rows that are sent grow with the shards, not with slices times shards; no context is lost and equal ones become one."""
    monkeypatch.setattr(suffix_dedup, "SLICE", 500)
    r = random.Random(8)
    texts = ["".join(r.choices("abc ", k=300)) for _ in range(60)]
    texts[40:50] = texts[:10]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([0] * 60), pa.array(texts)], names=["doc", "key", "text"])
    held = [suffix_dedup.Contexts(i, k, o, j, a, np.arange(len(i))) for i, k, o, j, a in suffix_dedup._slices(batch, 50)]
    assert len(held) >= 30
    rows = [r for b in suffix_dedup._rows(suffix_dedup.Gathered(held).dealt(16, np.zeros(0, np.uint64), 50)) for r in b.to_pylist()]
    assert len(rows) <= 17 and [r["done"] for r in rows].count(True) == 1
    sent, settled = Counter(), set()
    for row in rows:
        (doc, _, start, stop), joined = suffix_dedup._unpacked(row["n"], row["data"])
        if row["done"]:
            settled |= set(doc.tolist())
            continue
        ends = np.cumsum(stop - start)
        for d, p, q, e in zip(doc.tolist(), start.tolist(), stop.tolist(), ends.tolist(), strict=True):
            assert joined[e - (q - p) : e].decode() == texts[d][p:q]
            sent[d] += 1
    assert settled == set(range(40, 50)) and set(sent) == set(range(60)) - settled
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert Counter(map(tuple, suffix_dedup.removal_digests(docs, 50, shard_bytes=1000).collect())) == brute_removed(list(enumerate(texts)), 50)


def test_suffix_dedup_cuts_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    r = random.Random(9)
    base = "".join(r.choices("abcdefgh é", k=2500))
    texts = [(1, base), (2, "zz" + base[300:1900] + "yy"), (3, "".join(r.choices("ab", k=900))), (4, base[100:160]), (5, "\0" * 200), (6, "\0" * 80 + "q")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert Counter(map(tuple, suffix_dedup.removal_digests(docs, 50).collect())) == brute_removed(texts, 50)


def test_longest_previous_factor():
    r = random.Random(4)
    for _ in range(60):
        t = "".join(r.choices("ab", k=r.randint(0, 40))).encode()
        want = [max((k for j in range(i) for k in range(len(t) - i + 1) if t[j : j + k] == t[i : i + k]), default=0) for i in range(len(t))]
        assert suffix_dedup.longest_previous_factor(t).tolist() == want
    assert suffix_dedup.longest_previous_factor(b"a" * 5000).tolist() == [0, *range(4999, 0, -1)]


@pytest.mark.parametrize("cut", [50, 17, 8])
def test_cut_suffix_order_and_previous_factors(cut):
    r = random.Random(cut)
    for _ in range(30):
        pool = b"".join(r.choice([b"ab", b"b", bytes(r.choices(range(256), k=9)), b"a" * r.randint(1, 40)]) for _ in range(60)) + bytes(cut)
        first = np.array(sorted(r.sample(range(len(pool) - cut + 1), min(90, len(pool) - cut + 1))), np.int32)
        values = np.array([r.randint(0, 12) for _ in first])
        strings = [pool[k : k + cut] for k in first]
        order, common = suffix_dedup.suffix_order(np.frombuffer(pool, np.uint8), first, cut)
        shared = lambda a, b: next((k for k in range(cut) if a[k] != b[k]), cut)
        assert [strings[k] for k in order] == sorted(strings)
        assert common.tolist() == [0, *(shared(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False))]
        want = [max((shared(s, t) for t, w in zip(strings, values, strict=True) if w < v), default=0) for s, v in zip(strings, values, strict=True)]
        assert suffix_dedup.previous_factors(order, common, values).tolist() == want
        assert suffix_dedup.previous_factors(order, common, values, cut).tolist() == [w if w >= cut else 0 for w in want]


def test_license_lists_cost_little_and_names_are_told():
    import time

    index = license_scan.Index(license_scan.TEMPLATES)
    mit = (license_scan.TEMPLATES["mit-text"] + "\n\n") * 40
    began = time.process_time()
    found = license_scan.scan_text(mit.encode(), index)
    assert time.process_time() - began < 3  # 41 KB; about 0.3 s here
    assert [x[0] for x in found if x[0] == "mit-text"] == ["mit-text"] * 40 and {x[1] for x in found if x[0] == "mit-text"} == {1.0}
    names = lambda text: {x[0] for x in license_scan.scan_text(text.encode(), index)}
    assert names("Licensed under GPLv3.") == {"gplv3-short-notice"}
    assert names("It is licensed under Apache License 2.0, see there.") == {"apache-license-2.0-short-notice"}
    assert names("released under the terms of the MIT license") == {"mit-terms-notice"}
    assert names("# SPDX-License-Identifier: GPL-2.0-or-later\nimport os") == {"spdx-gpl-2.0-or-later"}
    assert names("// SPDX-License-Identifier: Apache-2.0") == {"spdx-apache-2.0"}
    assert names("the license of the software is under the terms of nobody") == set()


def test_stages_keep_columns_of_any_name(spark):
    """Columns with the names that the stages use themselves, beside repeated and null ids; and the same columns in an empty table."""
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, text, "a"), (1, text + " more", "b"), (None, text, None), (None, "other words here", "a"), (2, "", "a"), (3, None, "b"), (4, "alone", "a")]
    own = ["__fp", "__kept", "__kept_fp", "__runs", "runs", "row", "__source", "__whole", "__cut", "__copies", "__salt"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", *[f"'{k}' as `{c}`" for k, c in enumerate(own)])
    for stage in (lambda d: simhash_dedup.keep_one(d, similar=0.8), simhash_dedup.keep_one, suffix_dedup.remove, lambda d: mixing.mixed(d, [3.0, 1.0, 2.0])):
        got = stage(docs)
        assert got.columns == docs.columns and got.count() > 0
        assert all(r[c] == str(k) for r in got.collect() for k, c in enumerate(own))
        assert stage(docs.limit(0)).count() == 0
    assert simhash_dedup.keep_one(docs, similar=0.8).filter("doc_id = 4").count() == 1


@pytest.fixture
def many_partitions(spark):
    """As where a cluster holds many shuffle partitions: they aren't merged."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def jobs_of(spark, name, step):
    """What step() returns, and the stages of each job that it starts."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = step()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    return out, [len(tracker.getJobInfo(k).stageIds) for k in tracker.getJobIdsForGroup(name)]


def test_bitmaps_come_in_few_jobs(spark, many_partitions):
    ids = spark.range(3000).selectExpr("id * 7 as id")
    (bitmap, bits), jobs = jobs_of(spark, "bitmap of ids", lambda: common.id_bitmap(ids, 3000))
    assert common.in_bitmap(pa.array(range(0, 21000, 7)), bitmap, bits).all() and bitmap.any()
    assert 0 < len(jobs) <= common.BITMAP_PARTS + 2
    texts = spark.createDataFrame([(k, 0, random.Random(k % 40).randbytes(300).hex()) for k in range(400)], "doc bigint, key bigint, text string")
    (found, _), jobs = jobs_of(spark, "bitmap of hashes", lambda: suffix_dedup.repeated_hashes(texts, lambda b: suffix_dedup._anchors(b, 50), 500, 16, 1 << 16))
    assert any(found) and 0 < len(jobs) <= common.BITMAP_PARTS + 4


@pytest.mark.parametrize("task", [components.TASK, 100])
def test_rounds_of_few_links_need_no_exchanges(spark, many_partitions, monkeypatch, task):
    monkeypatch.setattr(components, "TASK", task)
    r = random.Random(4)
    pairs = [(k, k + 1) for k in range(60)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)] + [(200, k) for k in range(201, 400)]
    got, jobs = jobs_of(spark, "components", lambda: components.components(spark.createDataFrame(pairs, "u bigint, v bigint")))
    assert task == 100 or sum(jobs) <= 60
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for u, v in pairs:
            root[u] = root[v] = min(root[u], root[v])
    assert {(x.node, x.component) for x in got.collect()} == {(k, v) for k, v in root.items() if any(k in p and p[0] != p[1] for p in pairs)}
