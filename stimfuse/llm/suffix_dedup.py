"""Removal of repeated byte strings by longest-previous-factor arrays, in shards.

A byte is removed if a string of `length` bytes that covers it also starts in a document with a smaller id. Strings are judged
on the input, matches never cross documents, and the first copy stays.

A suffix array of a whole corpus doesn't fit a task, so suffixes are dealt into shards in which all equal strings meet. Every
string of `length` bytes has an anchor, the 16-byte gram in it with the least hash; equal strings have equal anchors at equal
offsets. Pass 1 sends the hashes of anchors, once per slice of text, and finds those that several slices or documents hold;
they come back as a bitmap of bounded size (it may let others pass, never hold one back). Pass 2 sends the anchors that the
bitmap lets pass, with the bytes of the strings that they anchor. A shard puts its suffixes, cut at `length`, in order, takes the
common prefixes of neighbours, and finds for each the previous and the next one of a smaller document in that order: the longer of
the two common prefixes is its longest previous factor, and a factor of `length` is an earlier match. Before the shuffle equal
contexts of a slice become one, and the strings of anchors that very many slices hold are dealt by their content, so a passage
that is everywhere doesn't gather in one shard.

Edge cases: null texts are empty; texts shorter than `length` lose nothing; texts of any length are cut into slices that overlap by
length - 1 bytes, so no string is missed; a null id counts as larger than all others; rows with the same id never remove each
other's bytes and are told apart by a hash of their text; an empty table gives no rows; other columns of the input are kept by
remove() and not read by spans().
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stimfuse.llm.common import BITMAP_PARTS, NULL_ID, free_name, id_bitmap, in_bitmap, map_batches
from stimfuse.session import checkpointed, shared_dir

#: Bytes of an anchor gram; bytes of text per shard; bits of the bitmap at most (as a power of two); slices from which an anchor is dealt by content.
GRAM, SHARD_BYTES, BITMAP, HOT = 16, 2 << 20, 27, 1 << 16
#: Bytes of a slice that is hashed at once; longer texts are cut with an overlap.
SLICE = 1 << 20
#: Hashes, and contexts, that a task deals to shards together.
HASHES, CONTEXTS = 1 << 19, 1 << 18

def suffix_array(text: bytes) -> np.ndarray:
    """Suffix array of one text by prefix doubling."""
    rank = np.frombuffer(text, np.uint8).astype(np.int64) + 1
    n, k = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while k < n:
        second = np.concatenate([rank[k:], np.zeros(min(k, n), np.int64)])[:n]
        order = np.lexsort((second, rank))
        step = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[1], 1 + np.cumsum(step)]) if n else []
        rank, k = new, 2 * k
        if rank.max() == n:
            break
    return order


def common_prefixes(text: bytes, order: np.ndarray) -> np.ndarray:
    """The common prefix of each suffix with the one before it in order, in linear time: moving on by one byte loses one at most."""
    n, held = len(text), 0
    out, at = np.zeros(n, np.int64), np.empty(n, np.int64)
    at[order] = np.arange(n)
    for i, k in enumerate(at.tolist()):
        if k == 0:
            held = 0
            continue
        j = int(order[k - 1])
        while max(i, j) + held < n and text[i + held] == text[j + held]:
            held += 1
        out[k] = held
        held = max(held - 1, 0)
    return out


def suffix_order(pool: np.ndarray, first: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that start at `first` in pool and are cut at `cut` bytes (which the pool has): their order, and the common prefix
    of each with the one before it in order. Ties are ordered again by the bytes that follow, as long as there are any."""
    n = len(first)
    order, common = np.zeros(n, np.int64), np.full(n, cut, np.int32)
    if not n:
        return order, common
    padded = np.concatenate([pool, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(pool) + 1,), dtype="<u8", buffer=padded, strides=(1,))

    def equal_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a ^ b).byteswap().view(np.uint8).reshape(-1, 8) != 0).argmax(1).astype(np.int32)

    key = eight[first].byteswap()
    order = np.argsort(key)
    key = key[order]
    common[0], depth = 0, 8
    tied = key[1:] == key[:-1]
    apart = np.flatnonzero(~tied)
    common[apart + 1] = equal_bytes(key[apart + 1], key[apart])
    while depth < cut and tied.any():
        after = np.concatenate([[False], tied])
        member = np.flatnonzero(after | np.append(tied, False))
        opens = ~after[member]
        group = np.cumsum(opens) - 1
        n_bytes = min((64 - max(int(group[-1]).bit_length(), 1)) // 8, cut - depth)
        up = np.uint64(64 - 8 * n_bytes)
        key = group.astype(np.uint64) << np.uint64(8 * n_bytes) | eight[first[order[member]] + depth].byteswap() >> up
        again = np.argsort(key)
        order[member], key = order[member][again], key[again]
        new = np.flatnonzero((key[1:] != key[:-1]) & ~opens[1:])
        at = member[new + 1]
        common[at] = depth + equal_bytes(key[new + 1] << up, key[new] << up)
        tied[at - 1] = False
        depth += n_bytes
    return order, common


def _previous_smaller(values: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """For each place the least of the common prefixes down to the previous smaller value, 0 if there is none (or if it is below
    least, which spares the search beyond). Whoever has not found a smaller value goes on from where the one it looks at has got to."""
    n = len(values)
    at, low = np.arange(n) - 1, common.copy()
    open_ = np.flatnonzero((at >= 0) & (low >= least))
    at[low < least] = -1
    while len(open_):
        open_ = open_[values[at[open_]] >= values[open_]]
        j = at[open_]
        low[open_], at[open_] = np.minimum(low[open_], low[j]), at[j]
        shut = (at[open_] < 0) | (low[open_] < least)
        at[open_[shut]], low[open_[shut]] = -1, 0
        open_ = open_[~shut]
    low[at < 0] = 0
    return low


def previous_factors(order: np.ndarray, common: np.ndarray, values: np.ndarray, least: int = 0) -> np.ndarray:
    """For each suffix, the longest prefix that one of a smaller value has as well, from the previous and the next smaller value in
    suffix order; factors below least are 0."""
    v = values[order]
    before = _previous_smaller(v, common, least)
    after = _previous_smaller(v[::-1], np.concatenate([np.zeros(min(len(v), 1), common.dtype), common[:0:-1]]), least)[::-1]
    out = np.empty(len(order), common.dtype)
    out[order] = np.maximum(before, after)
    return out


def longest_previous_factor(text: bytes) -> np.ndarray:
    """For each position of one text, the length of the longest string there that also starts earlier."""
    order = suffix_array(text)
    return previous_factors(order, common_prefixes(text, order), np.arange(len(text)))


class Anchors:
    """Anchors of the strings of one slice: hash, owner (index of the document), lo (first string start) and hi (end of the last string), in the slice."""

    def __init__(self, buf: np.ndarray, ends: np.ndarray, length: int):
        """buf: concatenated pieces; ends: their ends. No string crosses the end of a piece."""
        w = length - GRAM + 1
        n = len(buf) - length + 1
        self.h = self.lo = self.hi = self.at = self.owner = np.zeros(0, np.int64)
        if n <= 0:
            return
        u = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
        h = u[: len(buf) - 15] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h += u[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        low = np.uint64((1 << 24) - 1)  # a slice is shorter than 2**24
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= w:
            m = np.minimum(m[: len(m) - span], m[span:])
            span *= 2
        m = np.minimum(m[:n], m[w - span : w - span + n])
        pos = (m & low).astype(np.int64)
        owner = np.searchsorted(ends, np.arange(n), side="right")
        inside = np.arange(n) + length <= ends[owner]
        starts = np.flatnonzero(inside & np.concatenate([[True], (pos[1:] != pos[:-1]) | (owner[1:] != owner[:-1]) | ~inside[:-1]]))
        if not len(starts):
            return
        lasts = np.flatnonzero(inside & np.concatenate([(pos[1:] != pos[:-1]) | (owner[1:] != owner[:-1]) | ~inside[1:], [True]]))
        self.at, self.lo, self.hi, self.owner = pos[starts], starts, lasts + length, owner[starts]
        least = h[self.at]  # least hashes are small numbers: spread them again
        least = (least ^ least >> np.uint64(30)) * np.uint64(0x94D049BB133111EB)
        self.h = least ^ least >> np.uint64(31)


def _slices(b: pa.RecordBatch, length: int):
    """(ids, keys, offsets, bytes, anchors) of the slices of a batch (doc, key, text); one entry of ids, keys and offsets per anchor.

    A slice is a view of the batch's own bytes, of whole texts; a text above SLICE is cut with length - 1 bytes of overlap."""
    ids, keys = np.asarray(b.column(0)).astype(np.int64), np.asarray(b.column(1)).astype(np.int64)
    text = b.column(2)
    offset_type = np.int64 if pa.types.is_large_string(text.type) else np.int32
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, offset_type)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    pool = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(ids):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE, side="right")) - 1)
        begin, end = int(off[lo]), int(off[hi])
        for at in range(begin, max(end - length + 1, begin + 1), SLICE) if hi == lo + 1 else [begin]:
            piece = pool[at : min(end, at + SLICE + length - 1)] if hi == lo + 1 else pool[begin:end]
            ends = np.array([len(piece)]) if hi == lo + 1 else off[lo + 1 : hi + 1] - begin
            a = Anchors(piece, ends, length)
            if len(a.h):
                row = lo + a.owner
                yield ids[row], keys[row], at - off[row], memoryview(piece), a
        lo = hi


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def groups(shard: np.ndarray):
    """(shard, positions) in order of shard."""
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(shard[part[0]]), part


def gathered(found, limit: int):
    """Lists of what comes, each with about `limit` entries in all: what is dealt to shards together is a row per shard, and rows of
    single slices would grow with slices times shards, so with the square of the texts."""
    held, n = [], 0
    for x in found:
        held.append(x)
        n += len(x)
        if n >= limit:
            yield held
            held, n = [], 0
    if held:
        yield held


def _unique(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Distinct hashes of a slice; the lowest bit says whether several ids hold it."""
    order = np.lexsort((ids, h))
    h, ids = h[order], ids[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    ends = np.append(starts[1:], len(h)) - 1
    return (h[starts] & ~np.uint64(1)) | (ids[starts] != ids[ends]).astype(np.uint64)


def _anchors(b: pa.RecordBatch, length: int):
    """Distinct hashes of the anchors of each slice."""
    for ids, _, _, _, a in _slices(b, length):
        yield _unique(a.h, ids)


def repeated_hashes(texts: DataFrame, hashes, shards: int, bits: int, hot: int) -> tuple[bytes, list[int]]:
    """The bitmap of hashes that occur in several slices, or are marked in one, by their first `bits` bits, and the hashes that very many
    slices hold. hashes: from a batch of texts to the distinct hashes of each slice, marked in the lowest bit."""

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        u = np.concatenate(held)
        parts = [(s, u[part].astype("<u8").tobytes()) for s, part in groups(shard_of(u, shards))]
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int64()), pa.array([x for _, x in parts], pa.binary())], names=["shard", "hashes"])

    def send(batches):
        for held in gathered((u for b in batches if b.num_rows for u in hashes(b)), HASHES):
            yield dealt(held)

    def find(key, t):
        u = np.sort(np.concatenate([np.frombuffer(x, "<u8") for x in t.column("hashes").to_pylist()]))
        h = u & ~np.uint64(1)
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        counts = np.diff(np.append(starts, len(h)))
        many = (counts > 1) | (np.maximum.reduceat(u, starts) & np.uint64(1)).astype(bool)
        kept = h[starts][many]
        index = (kept >> np.uint64(64 - bits)).astype(np.int64)
        first = int(index[0] >> 3) if len(index) else 0
        piece = np.zeros(int(index[-1] >> 3) - first + 1 if len(index) else 0, np.uint8)
        np.bitwise_or.at(piece, (index >> 3) - first, (1 << (index & 7)).astype(np.uint8))
        return pa.table({"first": pa.array([first], pa.int64()), "piece": pa.array([piece.tobytes()], pa.binary()), "hot": pa.array([h[starts][counts > hot].view(np.int64).tolist()], pa.list_(pa.int64()))})

    sent = texts.mapInArrow(send, "shard bigint, hashes binary")
    bitmap, hots = np.zeros(1 << max(bits - 3, 0), np.uint8), []
    # shards are sorted by all tasks at once; only then their pieces come, a few parts after one another
    found = checkpointed(sent.groupBy("shard").applyInArrow(find, "first bigint, piece binary, hot array<bigint>"))
    for r in found.coalesce(BITMAP_PARTS).toLocalIterator():  # pieces of one bitmap, and a hash per `hot` slices
        piece = np.frombuffer(r.piece, np.uint8)
        bitmap[r.first : r.first + len(piece)] |= piece
        hots += r.hot
    return bitmap.tobytes(), hots


SPANS = "doc bigint, key bigint, start bigint, stop bigint"


def spans(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, hot: int = HOT, repeated: bool | None = None) -> DataFrame:
    """Removed runs, which may touch and overlap: (doc, key, start, stop); doc is the id (null: the largest long), key tells rows of one id apart."""
    spark = docs.sparkSession
    repeated = ids_repeat(docs, id_col) if repeated is None else repeated
    texts = keyed(docs, id_col, text_col, repeated).filter(F.octet_length("text") >= length).select("doc", "key", "text")
    total = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    bits = int(min(BITMAP, max(16, np.ceil(np.log2(max(total, 2))))))
    bitmap, hots = repeated_hashes(texts, lambda b: _anchors(b, length), shards, bits, hot)
    shared = spark.sparkContext.broadcast((bitmap, sorted(hots)))  # 2**BITMAP bits at most, and a hash per `hot` slices

    def live(batches):
        """The contexts of each slice whose anchors the bitmap lets pass."""
        seen = np.frombuffer(shared.value[0], np.uint8)
        for b in batches:
            for ids, keys, offset, joined, a in _slices(b, length) if b.num_rows else ():
                index = ((a.h & ~np.uint64(1)) >> np.uint64(64 - bits)).astype(np.int64)
                some = np.flatnonzero(seen[index >> 3] >> (index & 7).astype(np.uint8) & 1)
                if len(some):
                    yield Contexts(ids[some], keys[some], offset[some], joined, a, some)

    def send(batches):
        hot_hashes = np.array(shared.value[1], np.int64).view(np.uint64)
        for held in gathered(live(batches), CONTEXTS):
            yield from _rows(Gathered(held).dealt(shards, hot_hashes, length))

    def judge(key, t):
        doc, row, start, stop, texts = [], [], [], [], []
        out = [[], [], [], []]
        for n, done, data in zip(*(t.column(c).to_pylist() for c in ("n", "done", "data")), strict=True):
            cols, joined = _unpacked(n, data)
            if done:
                for o, c in zip(out, cols, strict=True):
                    o.append(c)
                continue
            for held, c in zip((doc, row, start, stop), cols, strict=True):
                held.append(c)
            ends = np.cumsum(cols[3] - cols[2])
            texts += [joined[e - k : e] for e, k in zip(ends.tolist(), (cols[3] - cols[2]).tolist(), strict=True)]
        if texts:
            doc, row, start, stop = map(np.concatenate, (doc, row, start, stop))
            for o, c in zip(out, _judge(doc, row, start, stop, texts, length), strict=True):
                o.append(c)
        out = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]
        return pa.table(dict(zip(("doc", "key", "start", "stop"), out, strict=True)))

    sent = texts.mapInArrow(send, PACK)
    return sent.groupBy("shard").applyInArrow(judge, SPANS)


class Contexts:
    """Contexts of a slice: (ids, keys, starts) of each, its hash h, and lo and hi, where it lies in the bytes of the slice."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, offset: np.ndarray, joined: memoryview, a: Anchors, some: np.ndarray):
        self.lo, self.hi, self.h, self.joined = a.lo[some], a.hi[some], a.h[some] & ~np.uint64(1), joined
        self.numbers = np.stack([ids, keys, offset + self.lo])
        eight = np.ndarray(shape=(len(joined) - 7,), dtype="<u8", buffer=joined, strides=(1,))
        # equal contexts have equal signs; what has an equal sign is compared
        self.sign = (self.h + (a.at[some] - self.lo).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + (self.hi - self.lo).astype(np.uint64)
        for x in (eight[self.lo], eight[self.hi - 8]):
            self.sign = (self.sign ^ x) * np.uint64(0xBF58476D1CE4E5B9)
            self.sign ^= self.sign >> np.uint64(32)

    def __len__(self) -> int:
        return len(self.lo)


class Gathered:
    """Contexts of several slices, which are dealt to shards together."""

    def __init__(self, held: list[Contexts]):
        self.joined = [x.joined for x in held]
        self.of = np.repeat(np.arange(len(held)), [len(x) for x in held])
        self.lo, self.hi, self.h, sign = (np.concatenate([getattr(x, n) for x in held]) for n in ("lo", "hi", "h", "sign"))
        self.sizes = self.hi - self.lo
        self.numbers = np.concatenate([x.numbers for x in held], axis=1)
        order = np.argsort(sign)
        same = sign[order][1:] == sign[order][:-1]
        self.alike = order[np.append(same, False) | np.concatenate([[False], same])[: len(order)]]

    def texts(self, which: np.ndarray) -> list[memoryview]:
        return [self.joined[k][p:q] for k, p, q in zip(self.of[which].tolist(), self.lo[which].tolist(), self.hi[which].tolist(), strict=True)]

    def dealt(self, shards: int, hot: np.ndarray, length: int):
        """Rows of PACK. Equal contexts become one, which goes to its shard, and those of larger ids are settled."""
        done, ids = np.zeros(len(self.h), bool), self.numbers[0]
        first: dict[bytes, int] = {}
        text = list(map(bytes, self.texts(self.alike)))
        mine = ids[self.alike].tolist()
        for c, d in zip(text, mine, strict=True):
            if d < first.get(c, d + 1):
                first[c] = d
        done[self.alike] = [first[c] < d for c, d in zip(text, mine, strict=True)]
        some = np.flatnonzero(done)
        if len(some):
            yield _packed(-1, self.numbers[:, some], self.sizes[some], [], shards)
        is_hot = np.isin(self.h, hot)
        kept = np.flatnonzero(~done & ~is_hot)
        for s, part in groups(shard_of(self.h[kept], shards)):
            i = kept[part]
            yield _packed(s, self.numbers[:, i], self.sizes[i], self.texts(i), shards)
        kept = np.flatnonzero(~done & is_hot)
        if len(kept):  # one string each, dealt by content
            n = self.sizes[kept] - length + 1
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i = np.repeat(kept, n)
            strings = [bytes(self.joined[k][p : p + length]) for k, p in zip(self.of[i].tolist(), (self.lo[i] + step).tolist(), strict=True)]
            by = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=4).digest(), "big") % shards for x in strings])
            for s, part in groups(by):
                numbers = self.numbers[:, i[part]]
                numbers[2] += step[part]
                yield _packed(s, numbers, np.full(len(part), length), [strings[x] for x in part.tolist()], shards)


PACK = "shard bigint, done boolean, n int, data binary"
#: Bytes of rows that leave a task together.
ROWS = 1 << 22


def _rows(packs):
    """Packs as batches of some rows each."""
    kinds = (("shard", pa.int64()), ("done", pa.bool_()), ("n", pa.int32()), ("data", pa.binary()))
    made = lambda held: pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*held, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])
    held, size = [], 0
    for x in packs:
        held.append(x)
        size += len(x[3])
        if size >= ROWS:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def _packed(shard: int, numbers: np.ndarray, sizes: np.ndarray, texts: list, shards: int) -> tuple:
    """One row of packed and compressed contexts, numbers being their ids, keys and starts; shard -1: runs that are settled, which only
    pass through a shard.

    Numbers are laid out byte by byte, so that their many zero bytes stand together."""
    done = shard < 0
    where = int(numbers[0, 0]) % shards if done else shard
    numbers = np.ascontiguousarray(np.concatenate([numbers, numbers[2:] + sizes]), "<i8")
    raw = numbers.view(np.uint8).reshape(4, -1, 8).transpose(0, 2, 1).tobytes() + b"".join(texts)
    return where, done, numbers.shape[1], len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpacked(n: int, data: bytes) -> tuple[np.ndarray, bytes]:
    """(ids, keys, starts, stops) and the texts of the contexts, joined."""
    raw = pa.Codec("zstd").decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    numbers = np.frombuffer(raw, np.uint8, 32 * n).reshape(4, 8, n).transpose(0, 2, 1).copy().view("<i8")[..., 0]
    return numbers, raw[32 * n :]


def _judge(doc, row, start, stop, texts: list[bytes], length: int):
    """Removed runs of the contexts of one shard: (doc, key, start, stop)."""
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(c, len(number)) for c in texts])
    contexts = list(number)
    least = np.full(len(contexts), NULL_ID)
    np.minimum.at(least, which, doc)
    whole = doc > least[which]
    # strings of the distinct contexts, which belong to the least document that has the context
    sizes = np.array([len(c) for c in contexts])
    begins = np.cumsum(sizes) - sizes
    pool = np.frombuffer(b"".join(contexts), np.uint8)
    n = sizes - length + 1
    of = np.repeat(np.arange(len(contexts), dtype=np.int32), n)
    at = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    first = (begins[of] + at).astype(np.int32)
    hit = previous_factors(*suffix_order(pool, first, length), least[of], length) >= length
    # runs of hit strings in a context
    opens = hit & np.concatenate([[True], (of[1:] != of[:-1]) | ~hit[:-1]]) if len(hit) else hit
    closes = hit & np.concatenate([(of[1:] != of[:-1]) | ~hit[1:], [True]]) if len(hit) else hit
    o, c = np.flatnonzero(opens), np.flatnonzero(closes)
    run_of, run_lo, run_hi = of[o], at[o], at[c] + length
    per = np.bincount(run_of, minlength=len(contexts))
    base = np.cumsum(per) - per
    rest = np.flatnonzero(~whole & (per[which] > 0))
    times = per[which[rest]]
    again = np.repeat(rest, times)
    r = np.repeat(base[which[rest]], times) + np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
    return (np.concatenate([doc[whole], doc[again]]), np.concatenate([row[whole], row[again]]), np.concatenate([start[whole], start[again] + run_lo[r].astype(np.int64)]), np.concatenate([stop[whole], start[again] + run_hi[r]]))


def keyed(docs: DataFrame, id_col: str, text_col: str, repeated: bool) -> DataFrame:
    """The input with doc (its id, null as the largest long), text (null as empty) and key, a hash of the text where ids repeat, else 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(text) if repeated else F.lit(0).cast("bigint")
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("doc"), key.alias("key"), text.alias("text"), F.struct("*").alias("row"))


def ids_repeat(docs: DataFrame, id_col: str) -> bool:
    return bool(docs.groupBy(F.col(id_col)).count().filter("count > 1").limit(1).count())


def merged(starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of a union of runs."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, stops, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def with_runs(docs: DataFrame, length: int, id_col: str, text_col: str, finder, packed: bool = False, whole: tuple | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """(rows of docs that surely lose nothing, the other rows as struct `row`, `text` and merged `runs`, null where nothing is removed).

    With packed, the others are id, text as deflated UTF-8 (as their texts are shuffled), and runs. whole: a function of batches of the
    first rows, and its schema. Rows are told apart where they are worked on: a Python step behind another one would keep two workers a task.
    finder: spans() or another function of its kind. Only the other rows are shuffled to meet their runs. Which rows those are is told by a bitmap of ids of bounded size."""
    spark = docs.sparkSession
    repeated = ids_repeat(docs, id_col)
    found = finder(docs, length, id_col, text_col, repeated=repeated, **how).groupBy("doc", "key").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))

    def merge(b: pa.RecordBatch):
        runs = [[{"start": x, "stop": y} for x, y in merged(p, q)] for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(runs, kind)], names=["doc", "key", "runs"])

    at = shared_dir(spark, "suffix-runs")
    map_batches(found, merge, "doc bigint, key bigint, runs array<struct<start: bigint, stop: bigint>>").write.parquet(at)
    runs = spark.read.parquet(at)
    shared = spark.sparkContext.broadcast(id_bitmap(runs.select("doc"), runs.count()))  # 2**ID_BITS bits at most
    place = docs.columns.index(id_col)
    same = lambda b: [b]

    def rows(df: DataFrame, place: int, hit: bool, then, schema) -> DataFrame:
        def run(b: pa.RecordBatch):
            b = b.filter(pa.array(in_bitmap(b.column(place), *shared.value) == hit))
            if b.num_rows:
                yield from then(b)

        return map_batches(df, run, schema)

    sure = rows(docs, place, False, *(whole or (same, docs.schema)))
    if packed:

        def deflate(b: pa.RecordBatch):
            small = [zlib.compress(x.as_buffer(), 6) for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(small, pa.binary())], names=["doc", "key", "id", "text"])

        held = keyed(docs, id_col, text_col, repeated).select("doc", "key", F.col(f"row.`{id_col}`").alias("id"), "text")
        kind = held.schema["id"].dataType.simpleString()
        others = rows(held, 0, True, deflate, f"doc bigint, key bigint, id {kind}, text binary")
        return sure, others.join(runs, ["doc", "key"], "left").select("id", "text", "runs")
    # a text is in its row alone, so that it is shuffled once
    others = keyed(rows(docs, place, True, same, docs.schema), id_col, text_col, repeated).select("doc", "key", "row").join(runs, ["doc", "key"], "left")
    return sure, others.withColumn("text", F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")))


def _kept(raw: bytes, runs: list | None) -> tuple[bytes, int, int]:
    """Remaining bytes, bytes removed, runs removed."""
    if not runs:
        return raw, 0, 0
    cuts = merged([r["start"] for r in runs], [r["stop"] for r in runs])
    bounds = [0, *[x for c in cuts for x in c], len(raw)]
    return b"".join(raw[bounds[k] : bounds[k + 1]] for k in range(0, len(bounds), 2)), sum(b - a for a, b in cuts), len(cuts)


def removal_digests(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(b: pa.RecordBatch):
        rows = []
        for key, text, runs in zip(*(c.to_pylist() for c in b.columns), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            kept, n, k = _kept(raw, runs)
            rows.append((key, len(raw), n, k, hashlib.sha256(kept).hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    def untouched(b: pa.RecordBatch):
        yield from run(pa.RecordBatch.from_arrays([b.column(0), b.column(1).fill_null(""), pa.nulls(b.num_rows)], names=["id", "text", "runs"]))

    schema = f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    whole, others = with_runs(docs.select(id_col, text_col), length, id_col, text_col, spans, whole=(untouched, schema), **how)
    others = others.select(F.col(f"row.`{id_col}`").alias(id_col), "text", "runs")
    return whole.unionByName(map_batches(others, run, schema))


def remove(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The input with repeated strings cut out of text_col; all other columns and all rows stay. What is left of a
    character that is cut through goes as well. A null text stays null."""

    place = docs.columns.index(text_col)

    def cut(b: pa.RecordBatch):
        texts, runs = b.column(place).to_pylist(), b.column(b.num_columns - 1).to_pylist()
        out = [t if not r else _kept(t.encode("utf-8", "surrogatepass"), r)[0].decode("utf-8", "ignore") for t, r in zip(texts, runs, strict=True)]
        columns = list(b.columns[:-1])
        columns[place] = pa.array(out, b.schema.field(place).type)
        yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    whole, others = with_runs(docs, length, id_col, text_col, spans, **how)
    others = others.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("runs").alias(free_name("runs", docs.columns)))
    return whole.unionByName(map_batches(others, cut, docs.schema))
