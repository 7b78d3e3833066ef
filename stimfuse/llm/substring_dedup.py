"""Removal of passages that stand anywhere else, by FM-indexes of shards.

A window is `length` consecutive words of one document. Each word that a window covers whose words also stand anywhere else, in the
same document too, is removed: all copies go. Windows are judged on the input.

No task can index a corpus, so windows are dealt into shards in which equal ones meet. The anchor of a window is the gram of GRAM
words in it with the least hash; equal windows have equal anchors at equal offsets. Pass 1 sends the hashes of anchors, once per slice,
and finds those that occur more than once, as a bitmap of bounded size that may let others pass, never hold one back. Pass 2 sends the
contexts of the anchors that it lets pass: the words of all neighbouring windows that have the anchor, so that each window is in one
context. Contexts with equal words are settled: all their windows are repeated, and only one of them goes on, from a slice as in a
shard. A shard indexes its distinct contexts, streams those that stand once through the index, and reports the intervals in which the
matching statistics reach `length` with a second occurrence.

Contexts of anchors that very many slices hold first meet in salted groups, each of which sends on one context of equals, so a
passage that is everywhere doesn't gather in one shard.

Edge cases: a null text has no words; texts with fewer words than a window lose nothing; long texts are cut into pieces of words that
overlap by length - 1; a null id counts as larger than all others; rows that repeat, or share an id, are documents of their own and
remove each other's words; an empty table gives no rows; other columns are kept by remove(), whatever their names, and not read elsewhere.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stimfuse.llm import suffix_dedup
from stimfuse.llm.common import free_name, map_batches
from stimfuse.llm.fm_index import FMIndex
from stimfuse.session import checkpointed

#: Words of an anchor gram; bytes of text per shard; bits of the bitmap at most (as a power of two); slices from which an anchor is salted, and salts.
GRAM, SHARD_BYTES, BITMAP, HOT, SALTS = 10, 4 << 20, 27, 1 << 16, 256
#: Bytes of texts in a slice; words of a piece of a longer text; contexts that are streamed through an index together.
SLICE, PIECE, STREAM = 1 << 20, 1 << 17, 1 << 14

_BYTE, _WORD = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base % 2**64, np.uint64)]))


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers modulo 2**64, of a table that slices of about this size share."""
    return _powers(base, -(-n // (1 << 18)) << 18)[:n]


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(32)


def _strings(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[starts:ends], as differences of running sums."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values.astype(np.uint64) * _power(base, len(values)))])
    return _spread((sums[ends] - sums[starts]) * _power(pow(base, -1, 2**64), len(values) + 1)[starts])


class Slice:
    """Words of some documents: their bytes, joined by spaces, where each word begins and ends, and the anchors of all windows.

    Of each anchor: hash h, owner (index of the document), and lo and hi, the words of its context."""

    def __init__(self, texts: list[bytes], counts: np.ndarray, length: int):
        self.pool = b" ".join(texts)
        data = np.frombuffer(self.pool, np.uint8)
        spaces = np.flatnonzero(data == 32)
        self.begins, self.ends = np.concatenate([[0], spaces + 1]), np.append(spaces, len(data))
        self.h = self.lo = self.hi = self.owner = np.zeros(0, np.int64)
        last_word = np.cumsum(counts)
        n = len(self.begins) - length + 1
        if n <= 0:
            return
        words = _strings(data + np.uint64(1), _BYTE, self.begins, self.ends)
        h = _strings(words, _WORD, np.arange(len(words) - GRAM + 1), np.arange(GRAM, len(words) + 1))
        low, w, span = np.uint64((1 << 24) - 1), length - GRAM + 1, 1  # a slice has fewer than 2**24 words
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        while 2 * span <= w:
            m = np.minimum(m[: len(m) - span], m[span:])
            span *= 2
        m = np.minimum(m[:n], m[w - span : w - span + n])
        at = (m & low).astype(np.int64)
        owner = np.searchsorted(last_word, np.arange(n), side="right")
        inside = np.arange(n) + length <= last_word[owner]
        cut = np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | ~inside[:-1], [True]])
        starts = np.flatnonzero(inside & cut[:-1])
        lasts = np.flatnonzero(inside & (cut[1:] | ~np.append(inside[1:], False)))
        self.lo, self.hi, self.owner = starts, lasts + length, owner[starts]
        self.h = _spread(h[at[starts]])  # least hashes are small numbers: spread them again

    def context(self, k: int) -> bytes:
        return self.pool[self.begins[self.lo[k]] : self.ends[self.hi[k] - 1]]


def _slices(b: pa.RecordBatch, length: int):
    """Per anchor its id, its key, and what makes a word's place in the slice one in the document; and the Slice. Batches are (doc, key, text)."""

    def made(ids, keys, offsets, texts, counts):
        s = Slice(texts, np.array(counts), length)
        if len(s.h):
            before = np.array(offsets) - np.cumsum([0, *counts[:-1]])
            yield np.array(ids)[s.owner], np.array(keys)[s.owner], before[s.owner], s

    held, size = ([], [], [], [], []), 0
    for doc, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
        words = text.as_buffer().to_pybytes().split()  # bytes are split at the contract's white space
        if len(words) < length:
            continue
        for at in range(0, len(words) - length + 1, PIECE):
            part = words[at : at + PIECE + length - 1]
            joined = b" ".join(part)
            for x, v in zip(held, (doc, key, at, joined, len(part)), strict=True):
                x.append(v)
            size += len(joined)
            if size >= SLICE:
                yield from made(*held)
                held, size = ([], [], [], [], []), 0
    if size:
        yield from made(*held)


def _anchors(b: pa.RecordBatch, length: int):
    """Distinct hashes of the anchors of each slice; the lowest bit says whether the slice has several."""
    for _, _, _, s in _slices(b, length):
        h, n = np.unique(s.h & ~np.uint64(1), return_counts=True)
        yield h | (n > 1).astype(np.uint64)


PACK = "shard bigint, salt int, done boolean, data binary"


def _packed(shard: int, salt: int, done: bool, numbers: np.ndarray, texts: list[bytes]) -> tuple:
    """numbers: (columns, contexts). They are laid out byte by byte, so that their many zero bytes stand together."""
    head = np.array(numbers.shape[1], "<i8").tobytes()
    return shard, salt, done, zlib.compress(head + np.ascontiguousarray(numbers, "<i8").view(np.uint8).reshape(len(numbers), -1, 8).transpose(0, 2, 1).tobytes() + b"\n".join(texts), 6)


def _unpacked(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zlib.decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    numbers = np.frombuffer(raw, np.uint8, 48 * n, 8).reshape(6, 8, n).transpose(0, 2, 1).copy().view("<i8")[..., 0]
    rest = raw[8 + 48 * n :]
    return numbers, rest.split(b"\n") if rest else []


def _collapsed(texts: list[bytes], several: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each one's text, index of the first of equals, whether a text stands several times)."""
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(x, len(number)) for x in texts], np.int64)
    first = np.full(len(number), len(texts))
    np.minimum.at(first, which, np.arange(len(texts)))
    times = np.bincount(which, weights=1 + several, minlength=len(number))
    return which, first, times > 1


def _judge(texts: list[bytes], anchors: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, stop) of the intervals of distinct contexts in which every window stands in two of them."""
    number: dict[bytes, int] = {}
    words = [x.split(b" ") for x in texts]
    sizes = np.array([len(x) for x in words])
    flat = np.array([number.setdefault(w, len(number) + 1) for x in words for w in x], np.int64)
    text = np.zeros(len(flat) + len(texts), np.int64)
    place = np.repeat(np.arange(len(texts)), sizes)
    text[np.arange(len(flat)) + place] = flat
    begins = np.cumsum(sizes + 1) - sizes - 1
    index = FMIndex(text, len(number) + 1)
    out = []
    for k in range(0, len(texts), STREAM):
        q, start, stop = index.intervals(text, begins[k : k + STREAM], (begins + sizes)[k : k + STREAM], length)
        out.append((q + k, start - begins[q + k], stop - begins[q + k]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def spans(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, hot: int = HOT, repeated: bool | None = None) -> DataFrame:
    """Removed runs of words, which may touch and overlap: (doc, key, start, stop); doc is the id (null: the largest long), key tells rows of one id apart."""
    if length < GRAM:
        raise ValueError(f"a window needs {GRAM} words at least")
    spark = docs.sparkSession
    repeated = suffix_dedup.ids_repeat(docs, id_col) if repeated is None else repeated
    texts = suffix_dedup.keyed(docs, id_col, text_col, repeated).filter(F.octet_length("text") >= 2 * length - 1).select("doc", "key", "text")
    total = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    bits = int(min(BITMAP, max(16, np.ceil(np.log2(max(total, 2))))))
    bitmap, hots = suffix_dedup.repeated_hashes(texts, lambda b: _anchors(b, length), shards, bits, hot)
    shared = spark.sparkContext.broadcast((bitmap, sorted(hots)))  # 2**BITMAP bits at most, and a hash per `hot` slices
    names = ["shard", "salt", "done", "data"]

    def rows(found: list[tuple]) -> pa.Table:
        return pa.table([pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else [()] * 4, (pa.int64(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=names)

    def settle(numbers: np.ndarray, texts: list[bytes]):
        """Runs that equal contexts settle, and (numbers, texts) of one of each: numbers are id, key, start, stop, anchor, several."""
        which, first, several = _collapsed(texts, numbers[5])
        done = numbers[:, several[which]]
        kept = numbers[:, first].copy()
        kept[5] = several
        return done, kept, [texts[k] for k in first.tolist()]

    def send(b: pa.RecordBatch):
        maps, hot_list = shared.value
        seen, hot_hashes = np.frombuffer(maps, np.uint8), np.array(hot_list, np.int64).view(np.uint64)
        for ids, keys, offset, s in _slices(b, length):
            h = s.h & ~np.uint64(1)
            index = (h >> np.uint64(64 - bits)).astype(np.int64)
            live = np.flatnonzero(seen[index >> 3] >> (index & 7).astype(np.uint8) & 1)
            if not len(live):
                continue
            numbers = np.stack([ids[live], keys[live], (offset + s.lo)[live], (offset + s.hi)[live], (h[live] & np.uint64(0xFFFFFFFE)).astype(np.int64), np.zeros(len(live), np.int64)])
            texts = [s.context(k) for k in live.tolist()]
            first = _collapsed(texts, numbers[5])[1]
            done, kept, texts = settle(numbers, texts)
            found, h = [], h[live][first]
            if done.shape[1]:
                found.append(_packed(int(done[0, 0]) % shards, -1, True, done, []))
            salt = np.where(np.isin(h, hot_hashes), int(ids[0]) * 31 % SALTS, -1)
            shard = suffix_dedup.shard_of(h, shards)
            for at, part in suffix_dedup.groups(shard * 2 + (salt >= 0)):
                found.append(_packed(at >> 1, int(salt[part[0]]), False, kept[:, part], [texts[k] for k in part.tolist()]))
            yield from rows(found).to_batches()

    def gathered(t: pa.Table):
        done, numbers, texts = [], [], []
        for is_done, data in zip(t.column("done").to_pylist(), t.column("data").to_pylist(), strict=True):
            n, x = _unpacked(data)
            (done if is_done else numbers).append(n)
            texts += x
        none = np.zeros((6, 0), np.int64)
        return np.concatenate([none, *done], axis=1), np.concatenate([none, *numbers], axis=1), texts

    def merge(key, t):
        """Contexts of hot anchors in a salted group: what equals settle, and one of each."""
        done, numbers, texts = gathered(t)
        shard, found = key[0].as_py(), []
        if texts:
            more, kept, texts = settle(numbers, texts)
            done = np.concatenate([done, more], axis=1)
            found.append(_packed(shard, -1, False, kept, texts))
        if done.shape[1]:
            found.append(_packed(shard, -1, True, done, []))
        return rows(found)

    def judge(key, t):
        done, numbers, texts = gathered(t)
        out = [done[:4]]
        if texts:
            done, kept, texts = settle(numbers, texts)
            out.append(done[:4])
            # an anchor with one context has no other window to meet
            _, anchor, n = np.unique(kept[4], return_inverse=True, return_counts=True)
            some = np.flatnonzero(n[anchor] > 1)
            if len(some):
                q, start, stop = _judge([texts[k] for k in some.tolist()], kept[4][some], length)
                once = kept[5][some[q]] == 0
                own = kept[:4, some[q[once]]]
                out.append(np.stack([own[0], own[1], own[2] + start[once], own[2] + stop[once]]))
        out = np.concatenate(out, axis=1)
        return pa.table(dict(zip(("doc", "key", "start", "stop"), out, strict=True)))

    sent = map_batches(texts, send, PACK)
    if hots:
        sent = checkpointed(sent)
        salted = sent.filter("salt >= 0").groupBy("shard", "salt").applyInArrow(merge, PACK)
        sent = sent.filter("salt < 0").unionByName(salted)
    return sent.groupBy("shard").applyInArrow(judge, suffix_dedup.SPANS)


def _kept(text: bytes, runs: list | None) -> tuple[list[bytes], int, list[tuple[int, int]]]:
    """Kept words, number of all words, removed runs."""
    words = text.split()
    cuts = suffix_dedup.merged([r["start"] for r in runs], [r["stop"] for r in runs]) if runs else []
    bounds = [0, *[x for c in cuts for x in c], len(words)]
    return [w for k in range(0, len(bounds), 2) for w in words[bounds[k] : bounds[k + 1]]], len(words), cuts


def removal_digests(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)."""

    def rows(ids: list, texts: list[bytes], every: list):
        out = []
        for key, text, runs in zip(ids, texts, every, strict=True):
            kept, n, _ = _kept(text, runs)
            out.append((key, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[id_col, "n_words", "n_removed", "kept_sha256"])

    def untouched(b: pa.RecordBatch):
        yield rows(b.column(0).to_pylist(), [x.as_buffer().to_pybytes() for x in b.column(1).fill_null("")], [None] * b.num_rows)

    def cut(b: pa.RecordBatch):
        yield rows(b.column(0).to_pylist(), [zlib.decompress(x.as_buffer()) for x in b.column(1)], b.column(2).to_pylist())

    schema = f"`{id_col}` bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    whole, others = suffix_dedup.with_runs(docs.select(id_col, text_col), length, id_col, text_col, spans, packed=True, whole=(untouched, schema), **how)
    return whole.unionByName(map_batches(others, cut, schema))


def remove(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The input with repeated passages cut out of text_col: a text that loses words becomes what is left of them, joined by one space.
    All other texts, columns and rows stay."""
    place, names = docs.columns.index(text_col), docs.columns

    def cut(b: pa.RecordBatch):
        texts, runs = b.column(place).to_pylist(), b.column(b.num_columns - 1).to_pylist()
        out = [t if not r else b" ".join(_kept(t.encode("utf-8", "surrogatepass"), r)[0]).decode("utf-8", "surrogatepass") for t, r in zip(texts, runs, strict=True)]
        columns = list(b.columns[:-1])
        columns[place] = pa.array(out, b.schema.field(place).type)
        yield pa.RecordBatch.from_arrays(columns, names=names)

    whole, others = suffix_dedup.with_runs(docs, length, id_col, text_col, spans, **how)
    others = others.select(*[F.col(f"row.`{c}`") for c in docs.columns], F.col("runs").alias(free_name("runs", docs.columns)))
    return whole.unionByName(map_batches(others, cut, docs.schema))


SQL = r"""with words as (select doc_id, unnest(w) as w, generate_subscripts(w, 1) as i from (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from documents)),
windows as (select doc_id, unnest(h) as h, generate_subscripts(h, 1) as i from (select doc_id, list_transform(range(1, greatest(len(w) - 33, 1)), lambda i: sha256(array_to_string(w[i : i + 34], ' '))) as h from (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from documents))),
counted as (select doc_id, i, case when count(*) over (partition by h) > 1 then 1 else 0 end as again from windows),
judged as (select words.doc_id, words.i, w, coalesce(max(again) over (partition by words.doc_id order by words.i rows between 34 preceding and current row), 0) = 1 as gone from words left join counted using (doc_id, i))
select doc_id, count(i) as n_words, count(*) filter (where gone) as n_removed, sha256(coalesce(string_agg(w, ' ' order by i) filter (where not gone), '')) as kept_sha256 from documents left join judged using (doc_id) group by doc_id"""
