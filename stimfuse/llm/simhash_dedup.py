"""SimHash near-duplicates, with links found in vantage-point trees.

Fingerprints have 64 bits; a bit is 1 if it is set in over half of the hashes (XXH64 of the UTF-8 bytes) of a text's word
shingles. Two fingerprints link at `radius` or fewer differing bits. Equal fingerprints are one node. Links between different
ones are searched on the two 32-bit halves: a pair within r bits has a half within r // 2 bits. For each half a vantage-point
tree is fitted on a bounded sample of fingerprints: a node holds a vantage point and the median Hamming distance to it. Every
fingerprint goes down to the shard on its side, and also to the outer side if it lies within r // 2 of the border (by the
triangle bound, no pair that is split there can be missed). Shards that are still too large get a tree of their own, fitted on a
bounded sample of theirs, and so on while that parts them, so the number of shards grows with the table. Shards are compared in
blocks of bounded size, all distances of two blocks at once, and each pair of blocks gives a spanning forest of its links, never
all pairs. Components of the forests are components of the links.

Edge cases: a null text, or one without words, has fingerprint 0 and links like any other; a text with fewer words than a shingle
is one shingle; texts of any length are read whole; ties and repeated rows share a node; a null id is a member but never names a
component unless it is alone; an empty table gives no rows; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stimfuse.llm import near_copies
from stimfuse.llm.common import map_batches, free_name
from stimfuse.llm.components import components
from stimfuse.session import checkpointed

#: Fingerprints that a tree is fitted on at most, those a leaf of the sample keeps at least, and rows of a block of a shard.
SAMPLE, LEAF, BLOCK = 1 << 16, 16, 2048
#: Fingerprints that a shard should hold at most where its points allow it; fingerprints that the tree of a large shard is fitted on; rounds of that.
SHARD, SHARD_SAMPLE, RESPLITS = 1024, 1024, 12

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a whole text."""
    words = words_of(text)
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        h = [digest(b" ".join(words), seed)]
    elif size == 3:
        h = [digest(b"%b %b %b" % w, seed) for w in zip(words, words[1:], words[2:])]
    else:
        h = [digest(b" ".join(words[k : k + size]), seed) for k in range(len(words) - size + 1)]
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = np.array(h[k : k + (1 << 16)], ">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(h)).tobytes(), "big")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """One row per input row: (id, fp), fp as a signed long."""

    def run(b: pa.RecordBatch):
        fp = np.array([fingerprint(t.as_py(), size, seed) for t in b.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_signed(fp))], names=["id", "fp"])

    return map_batches(docs.select(F.col(id_col).cast("bigint"), text_col), run, "id bigint, fp bigint")


def fit_tree(points: np.ndarray, depth: int, rng: np.random.Generator):
    """A vantage-point tree over 32-bit halves: (vantage point, radius, inner, outer), or None for a leaf."""
    if depth == 0 or len(points) < 2 * LEAF:
        return None
    best = None
    for v in rng.choice(points, 4):
        d = np.bitwise_count(points ^ v)
        mu = int(np.median(d))
        inner = int((d <= mu).sum())
        if 0 < inner < len(points):
            cost = inner**2 + (len(points) - inner + int((d == mu).sum())) ** 2
            if best is None or cost < best[0]:
                best = cost, v, mu, d <= mu
    if best is None:
        return None
    _, v, mu, inside = best
    return v, mu, fit_tree(points[inside], depth - 1, rng), fit_tree(points[~inside], depth - 1, rng)


def route(tree, half: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, leaf) of every point, and of its copies beyond borders that lie within reach."""
    at, leaves = [], []

    def down(node, rows: np.ndarray, name: int) -> None:
        if not len(rows):
            return
        if node is None:
            at.append(rows)
            leaves.append(np.full(len(rows), name, np.int64))
            return
        v, mu, inner, outer = node
        d = np.bitwise_count(half[rows] ^ v).astype(np.int64)
        down(inner, rows[d <= mu], 2 * name)
        down(outer, rows[d > mu - reach], 2 * name + 1)

    down(tree, np.arange(len(half)), 1)
    return (np.concatenate(at), np.concatenate(leaves)) if at else (np.zeros(0, int), np.zeros(0, np.int64))


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the fingerprints a and b (within a if b is None), as pairs of fingerprints."""
    points = a if b is None else np.concatenate([a, b])
    root = np.arange(len(points))
    out_u, out_v = [], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    other = a if b is None else b
    shift = 0 if b is None else len(a)
    for k in range(0, len(a), 256):
        near = np.bitwise_count(a[k : k + 256, None] ^ other[None, :]) <= radius
        x, y = np.nonzero(near)
        x = x + k
        keep = x < y if b is None else np.ones(len(x), bool)
        x, y = x[keep], y[keep] + shift
        while len(x):  # one link between two trees joins them; links inside a tree fall away together
            tree = np.array([find(i) for i in range(len(points))]) if len(x) > len(points) else None
            if tree is not None:
                apart = tree[x] != tree[y]
                x, y = x[apart], y[apart]
                if not len(x):
                    break
            step = min(len(x), len(points))
            for i, j in zip(x[:step].tolist(), y[:step].tolist(), strict=True):
                p, q = find(i), find(j)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out_u.append(i)
                    out_v.append(j)
            x, y = x[step:], y[step:]
    return points[np.array(out_u, int)], points[np.array(out_v, int)]


def _resplit(dealt: DataFrame, halves: list, reach: int, block: int, shard: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """dealt (side, shard, fp) with shards above 2 * block parted by trees of their own, and the sizes of all shards.

    A shard's tree comes before its rows in the order of a partition, so that a task holds one tree and streams the rows."""
    schema, before = "side int, shard bigint, fp bigint", None
    for turn in range(RESPLITS + 1):
        sizes = checkpointed(dealt.groupBy("side", "shard").count())
        large = sizes.filter(F.col("count") > 2 * block)
        n = large.agg(F.sum("count")).first()[0] or 0
        if not n or turn == RESPLITS or (before is not None and n > 0.9 * before):  # nothing left to part, or what is left can't be parted
            return dealt, sizes
        before = n

        def fit(key, t):
            points = halves[key[0].as_py()](np.sort(np.asarray(t.column("fp")).astype(np.int64)).view(np.uint64))
            depth = max(1, int(np.ceil(np.log2(t.column("count")[0].as_py() / shard) / 0.8)))
            tree = pickle.dumps(fit_tree(points, depth, np.random.default_rng(13)))
            return pa.table({"side": [key[0].as_py()], "shard": [key[1].as_py()], "tree": [tree]}, pa.schema([("side", pa.int32()), ("shard", pa.int64()), ("tree", pa.binary())]))

        rows = dealt.join(large, ["side", "shard"])
        drawn = rows.filter(F.shiftrightunsigned(F.xxhash64("fp", F.lit(turn)), 24) < F.lit(float(1 << 40)) * sample / F.col("count"))
        trees = drawn.groupBy("side", "shard").applyInArrow(fit, "side int, shard bigint, tree binary")
        both = rows.select("side", "shard", "fp", F.lit(None).cast("binary").alias("tree")).unionByName(trees.withColumn("fp", F.lit(0).cast("bigint")))

        def down(batches):
            tree, of = None, None
            for b in batches:
                side, name, fp = (np.asarray(b.column(c)).astype(np.int64) for c in ("side", "shard", "fp"))
                is_tree = np.asarray(b.column("tree").is_valid())
                cuts = np.flatnonzero(np.concatenate([[True], (side[1:] != side[:-1]) | (name[1:] != name[:-1]) | is_tree[:-1], [True]])) if len(fp) else []
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if is_tree[lo]:
                        tree, of = pickle.loads(b.column("tree")[int(lo)].as_py()), (side[lo], name[lo])
                        continue
                    at, leaf = route(tree if of == (side[lo], name[lo]) else None, halves[int(side[lo])](fp[lo:hi].view(np.uint64)), reach)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), side[lo]), pa.int32()), pa.array(np.full(len(at), name[lo])), pa.array(leaf), pa.array(fp[lo:hi][at])], names=["side", "shard", "leaf", "fp"])

        parted = both.repartition("side", "shard").sortWithinPartitions("side", "shard", F.col("tree").isNull()).mapInArrow(down, "side int, shard bigint, leaf bigint, fp bigint")
        parted = parted.select("side", F.xxhash64("shard", "leaf").alias("shard"), "fp")
        dealt = checkpointed(parted.unionByName(dealt.join(large, ["side", "shard"], "left_anti").select(*[x.split(" ")[0] for x in schema.split(", ")])))
    raise AssertionError("not reached")


def links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """nodes (fp): distinct fingerprints. Returns (u, v), links whose components are those of all links within radius."""
    n = nodes.count()
    sample = nodes.sample(fraction=min(1.0, 1.05 * SAMPLE / max(n, 1)), seed=7).limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / SHARD) / 0.8))) if n > SHARD else 0
    reach, rng = radius // 2, np.random.default_rng(11)
    halves = [lambda x: (x >> np.uint64(32)).astype(np.uint32), lambda x: (x & np.uint64(0xFFFFFFFF)).astype(np.uint32)]
    trees = [fit_tree(half(sample), depth, rng) for half in halves]

    def deal(b: pa.RecordBatch):
        fp = np.asarray(b.column(0)).astype(np.int64)
        for k, (half, tree) in enumerate(zip(halves, trees, strict=True)):
            at, leaf = route(tree, half(fp.view(np.uint64)), reach)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(leaf), pa.array(fp[at])], names=["side", "shard", "fp"])

    dealt = checkpointed(map_batches(nodes.select("fp"), deal, "side int, shard bigint, fp bigint"))
    dealt, sizes = _resplit(dealt, halves, reach, BLOCK, SHARD, SHARD_SAMPLE)
    # what can't be parted further is cut by a hash, and every pair of its parts meets in a task of its own
    parts = sizes.select("side", "shard", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    cut = dealt.join(parts, ["side", "shard"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    met = cut.select("side", "shard", "fp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    met = met.select("side", "shard", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "part", "fp")

    def compare(key, t):
        fp, part = np.asarray(t.column("fp")).astype(np.int64).view(np.uint64), np.asarray(t.column("part"))
        low, high = key[2].as_py(), key[3].as_py()
        u, v = forest(fp, None, radius) if low == high else forest(fp[part == low], fp[part == high], radius)
        return pa.table({"u": _signed(u), "v": _signed(v)})

    return met.groupBy("side", "shard", "low", "high").applyInArrow(compare, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """One row per input row: (id, fp, component_id), component_id being the smallest id that links reach."""
    marked = checkpointed(fingerprints(docs, id_col, text_col, size, seed))
    return _grouped(marked, radius).select(F.col("id").alias(id_col), "fp", "component_id")


def _grouped(marked: DataFrame, radius: int, widen=None) -> DataFrame:
    """marked (id, fp): one row each with component_id and component, the least fingerprint of the component."""
    nodes = marked.groupBy("fp").agg(F.min("id").alias("least"))
    nodes = checkpointed(nodes)
    groups = components(links(nodes.select("fp"), radius))
    named = nodes.join(groups, nodes.fp == groups.node, "left").select(nodes.fp, "least", F.coalesce("component", nodes.fp).alias("component"))
    named = widen(named) if widen else named
    # only fingerprints with links share a component: copies of one text are one node by now
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(names, "component").select("fp", "component", "component_id")
    return marked.join(of, "fp").select("id", "fp", "component_id", "component")


def _with_near_copies(named: DataFrame, docs: DataFrame, marked: DataFrame, mark, similar: float, seed: int) -> DataFrame:
    """named (fp, least, component), with components joined that hold texts of at least this similarity of five-word shingles."""
    named = checkpointed(named)
    wider = components(near_copies.links(docs, marked, named, mark, 5, similar, seed))
    return named.join(wider.withColumnRenamed("component", "wider"), named.component == wider.node, "left").select("fp", "least", F.coalesce("wider", "component").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3, seed: int = 42, similar: float | None = None) -> DataFrame:
    """The rows of docs, all columns, that stay: of each component the one with the smallest id (of equal ids, the smallest
    fingerprint; a null id comes last). Repeated rows count as one document. With `similar`, texts whose sets of five-word
    shingles have at least that Jaccard similarity are linked as well."""

    def both(text: str | None):
        return int(np.uint64(fingerprint(text, size, seed)).view(np.int64)), words_of(text)

    texts = docs.select(F.col(id_col).cast("bigint"), text_col)
    # one pass over the texts serves both kinds of links
    marked = checkpointed(fingerprints(docs, id_col, text_col, size, seed) if similar is None else near_copies.marked(texts, both, 5, seed))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "fp")
    widen = None if similar is None else lambda named: _with_near_copies(named, texts, marked, both, similar, seed)
    kept = checkpointed(_grouped(marked.select("id", "fp"), radius, widen).groupBy("component").agg(F.min(order).alias("k")).select("k.id", "k.fp"))
    # ids that are null or come with several rows don't say which row is meant: those rows are matched by fingerprint as well
    unclear = checkpointed(marked.groupBy("id").count().filter("id is null or count > 1").select("id"))
    if not unclear.limit(1).count():
        return docs.join(kept.select(F.col("id").alias(id_col)), id_col, "left_semi")
    unclear_ids = unclear.filter("id is not null").select(F.col("id").alias(id_col))
    plain = docs.join(kept.select(F.col("id").alias(id_col)), id_col, "left_semi").join(unclear_ids, id_col, "left_anti")
    rest = docs.join(unclear_ids, id_col, "left_semi").unionByName(docs.filter(F.col(id_col).isNull()))
    own, kept_id, kept_fp = (free_name(n, docs.columns) for n in ("__fp", "__kept", "__kept_fp"))
    fields = docs.schema.names

    def mark(b: pa.RecordBatch):
        fp = np.array([fingerprint(t.as_py(), size, seed) for t in b.column(text_col)], np.uint64)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_signed(fp))], names=[*fields, own])

    marked_rest = map_batches(rest, mark, T.StructType([*docs.schema.fields, T.StructField(own, T.LongType())]))
    k = kept.select(F.col("id").alias(kept_id), F.col("fp").alias(kept_fp))
    held = marked_rest.join(k, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_fp)), "left_semi")
    return plain.unionByName(held.dropDuplicates([id_col, own]).drop(own))


def digits(fp) -> object:
    """A fingerprint column as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
