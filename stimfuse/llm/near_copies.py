"""Near copies by the Jaccard similarity of word shingles: MinHash bands propose, exact similarities decide.

A text is the set of the hashes of its shingles of `size` words. BANDS keys of ROWS least hashes each bring texts together: two
texts of similarity s share a key with probability 1 - (1 - s ** ROWS) ** BANDS, which is 0.99997 at 0.8 and more above. Texts with
equal keys are compared by their exact similarity unless links have joined them already. Texts of equal sets and fingerprints are
one member, and keys with the same members are one group. A group above CHUNK members is first compared in chunks that all hold its
least member; where that leaves several components, the members outside the largest meet all members, so that no pair is left out.

Edge cases: a null text, or one without words, has no shingles and no links; a text with fewer words than a shingle is one shingle;
repeated rows are one member; an empty table gives no links; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stimfuse.llm.common import NULL_ID, id_bitmap, in_bitmap, map_batches
from stimfuse.llm.components import components
from stimfuse.session import checkpointed

#: Keys of a text, least hashes in a key, members that are compared in one task.
BANDS, ROWS, CHUNK = 20, 4, 256

_RNG = np.random.default_rng(23)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(words: list[bytes], size: int, seed: int) -> np.ndarray:
    """The distinct hashes of the shingles, in order."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[k : k + size]), seed) for k in range(max(1, len(words) - size + 1))] if words else [], np.uint64))


def band_keys(found: np.ndarray) -> list[int]:
    """One key per band of a text that has shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 4096):
        np.minimum(least, (found[None, k : k + 4096] * _TIMES[:, None] + _PLUS[:, None]).min(1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def member_of(text: str | None, mark, size: int, seed: int) -> tuple[int, int, np.ndarray]:
    """(fingerprint, member, shingles) of a text; the member is a signed number that texts of equal fingerprint and shingles share."""
    fp, words = mark(text)
    found = shingles(words, size, seed)
    member = xxhash.xxh64_intdigest(found.tobytes(), fp & 0xFFFFFFFF) ^ (fp & 0xFFFFFFFFFFFFFFFF)
    return fp, member - (1 << 64) if member >> 63 else member, found


def similar_links(members: dict[str, list], similar: float) -> list[tuple[int, int]]:
    """Links (component, component) that join all components with a pair of members of at least this similarity."""
    sets = [np.frombuffer(x, np.uint64) for x in members["found"]]
    names = sorted(set(members["component"]))
    at = {c: k for k, c in enumerate(names)}
    root, of, out = list(range(len(names))), [at[c] for c in members["component"]], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (x, side) in enumerate(zip(sets, members["side"], strict=True)):
        for j in range(i):
            p, q = find(of[i]), find(of[j])
            y = sets[j]
            if p == q or side == members["side"][j] >= 0 or min(len(x), len(y)) < similar * max(len(x), len(y)):
                continue
            both = len(x) + len(y) - len(np.union1d(x, y))
            if both >= similar * (len(x) + len(y) - both):
                root[max(p, q)] = min(p, q)
                out.append((names[of[i]], names[of[j]]))
    return out


MARKED = "id bigint, fp bigint, member bigint, keys array<bigint>"


def marked(docs: DataFrame, mark, size: int = 5, seed: int = 42) -> DataFrame:
    """docs (id, text); mark: text to (fingerprint as a signed number, words). One row per input row, MARKED: the fingerprint, the member
    (texts of equal fingerprint and shingles) and its keys, null where there are no words."""

    def run(b: pa.RecordBatch):
        fps, members, keys = [], [], []
        for t in b.column(1):
            fp, member, found = member_of(t.as_py(), mark, size, seed)
            fps.append(fp)
            members.append(member)
            keys.append(np.array(band_keys(found), np.uint64).view(np.int64) if len(found) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), pa.array(members, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "fp", "member", "keys"])

    return map_batches(docs, run, MARKED)


def links(docs: DataFrame, rows: DataFrame, named: DataFrame, mark, size: int = 5, similar: float = 0.8, seed: int = 42) -> DataFrame:
    """docs (id, text); rows: MARKED of them; named (fp, component), for every fingerprint.

    Returns (u, v), links between components that hold near copies of each other. Shingles are made again for one row of each member
    that has to be compared, which a bitmap of ids tells."""
    texts = rows.filter("keys is not null")

    def sets(b: pa.RecordBatch):
        some = b.column(1).filter(pa.array(in_bitmap(b.column(0), *shared.value)))
        out = [member_of(t.as_py(), mark, size, seed)[1:] for t in some]
        yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in out], pa.int64()), pa.array([x.tobytes() for _, x in out], pa.binary())], names=["member", "found"])

    def compare(t: pa.Table) -> pa.Table:
        out = similar_links(t.select(["component", "side", "found"]).to_pydict(), similar)
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    # a row per member, not per text and key, meets its component and is stored
    members = texts.groupBy("member").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min(F.coalesce("id", F.lit(NULL_ID))).alias("id"))
    members = checkpointed(members.join(named.select("fp", "component"), "fp").select("member", "component", "keys", "id"))
    rows = members.select(F.explode("keys").alias("key"), "member", "component")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("member")).alias("who"), F.min("member").alias("lead"), F.min("component").alias("low"), F.max("component").alias("high"))
    one = groups.filter("low < high").groupBy("n", "who", "lead").agg(F.min("key").alias("key"))
    open_ = checkpointed(rows.join(one.select("key", "n", "lead"), "key").withColumn("parts", F.ceil(F.col("n") / CHUNK).cast("int")))
    one_of = checkpointed(members.join(open_.select("member").distinct(), "member", "left_semi").select("id"))
    shared = docs.sparkSession.sparkContext.broadcast(id_bitmap(one_of, one_of.count()))  # 2**ID_BITS bits at most
    held = map_batches(docs, sets, "member bigint, found binary").dropDuplicates(["member"])
    part = F.pmod(F.xxhash64("member"), F.col("parts")).cast("int")
    # the least member stands in every chunk, but meets its shingles once
    parts = F.when(F.col("member") == F.col("lead"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))
    first = open_.join(held, "member").withColumn("part", F.explode(parts)).withColumn("side", F.lit(-1)).select("key", "part", "component", "side", "found")
    found = checkpointed(first.groupBy("key", "part").applyInArrow(compare, "u bigint, v bigint").distinct())
    # what chunks of large groups leave apart
    large = open_.filter("parts > 1")
    if not large.limit(1).count():
        return found
    joined = components(found)
    large = large.join(joined, large.component == joined.node, "left").select("key", "member", "parts", F.coalesce(joined.component, large.component).alias("component"))
    # of the components of such a group the largest has no pairs left inside; all others, the rest, meet every member, in blocks
    sizes = large.groupBy("key", "component").agg(F.count("*").alias("n"))
    state = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"))
    state = state.select("key", F.col("top.component").alias("base"), F.ceil((F.col("all") - F.col("top.n")) / CHUNK).cast("int").alias("blocks")).filter("blocks > 0")
    cut = checkpointed(large.join(state, "key"))
    met = cut.join(held, "member")
    every = met.withColumn("low", part).withColumn("high", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(0))
    rest = met.filter("component <> base").withColumn("high", F.pmod(F.xxhash64("member", F.lit(1)), F.col("blocks")).cast("int")).withColumn("low", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("side", F.lit(1))
    columns = ["key", "low", "high", "component", "side", "found"]
    met = every.select(columns).unionByName(rest.select(columns))
    return found.union(met.groupBy("key", "low", "high").applyInArrow(compare, "u bigint, v bigint").distinct())
