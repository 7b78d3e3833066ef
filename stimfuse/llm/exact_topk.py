"""Exact top-k inner products with norm order, SVD rotation and Cauchy-Schwarz bounds.

Vectors are packed into blocks by descending length of their integer components, and neighbouring blocks are chunks. All of them
are rotated by the right singular vectors of the table (from its Gram matrix, summed over every row), so that the first coordinates
carry most of an inner product. A query block first meets a bounded head, the first blocks: the k-th best score there is a lower
bound for each of its queries. It then meets the chunks in rounds, by descending length. A chunk is not sent to a query block at all
if its longest vector times the query's length can reach no bound; inside a block the sum over the first coordinates, plus the
product of the residual lengths (Cauchy-Schwarz), bounds every score, and only pairs whose bound reaches the query's are scored
exactly, in integers. Of a block each query keeps its best, and each round's least of the kept scores are the bounds of the next.

Ids may repeat, so a query's own row is told by its id and its integer vector. It is a candidate like all others until the end: one more
than k is kept for each query, and then one such row is left out.

Components are floor(scale * x) with x as double. Bounds are computed in floating point and widened by a relative slack.

Edge cases: vectors that are null, hold a null or hold a component that isn't finite take no part, neither do rows with a null
id; shorter vectors count as padded with zeros, vectors of any length are taken whole; a zero or empty vector scores 0; rows that
repeat an id, or an id and a vector, are rows of their own: each query row is answered, by all rows but itself; ties go to
the smaller id; scores beyond a long are cut to its limits; an empty table gives no rows; columns go by position and two are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stimfuse.llm.common import map_batches
from stimfuse.session import checkpointed

#: Vectors of the bounded head, of a block of queries and of a block of candidates.
HEAD, QUERY_BLOCK, BLOCK = 4096, 1024, 2048
#: Blocks of candidates that share one copy of each query block; chunks of the first round (each later round has so many times more than all before).
CHUNK, ROUND = 8, 8
#: Blocks of queries in a group; a copy of a chunk is sent to each group.
GROUP = 16
#: Integers up to here are exact in a double.
EXACT = float(2**53)
LONG = 2**63 - 1

PACKED = "block bigint, n int, longest double, ids binary, rows binary"


def _matrix(col: pa.Array, ids: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer components (as doubles, which hold them exactly) of the valid rows of one batch."""
    keep, rows, width = [], [], 0
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64)
    n = np.asarray(col.value_lengths().fill_null(0))
    ends = np.cumsum(n)
    valid = np.asarray(col.is_valid()) & np.asarray(ids.is_valid())
    if len(n) and valid.all() and (n == n[0]).all() and np.isfinite(flat).all():
        return np.asarray(ids), np.floor(scale * flat.reshape(len(n), int(n[0])))
    for i, ok in enumerate(valid):
        v = flat[ends[i] - n[i] : ends[i]]
        if ok and np.isfinite(v).all():
            keep.append(i)
            rows.append(np.floor(scale * v))
            width = max(width, len(v))
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return np.array([ids[i].as_py() for i in keep], np.int64), out


def _wide(a: np.ndarray, d: int) -> np.ndarray:
    return a if a.shape[1] == d else np.pad(a, ((0, 0), (0, d - a.shape[1])))


def _gram(vectors: DataFrame, scale: float) -> np.ndarray:
    """Sum of v v' over all rows: tasks give one matrix each, Spark adds them up, and d x d numbers reach the driver."""

    def run(batches):
        g = np.zeros((0, 0))
        for b in batches:
            _, m = _matrix(b.column(1), b.column(0), scale)
            d = max(len(g), m.shape[1])
            g = np.pad(g, (0, d - len(g)))
            g[: m.shape[1], : m.shape[1]] += m.T @ m
        i, j = np.indices(g.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(g.ravel(), pa.float64())], names=["i", "j", "s"])

    cells = vectors.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    d = max((r.i for r in cells), default=-1) + 1
    g = np.zeros((d, d))
    for r in cells:
        g[r.i, r.j] = r.s
    return g


def _pack(vectors: DataFrame, d: int, size: int, scale: float) -> DataFrame:
    """Blocks of at most `size` rows, in the order in which they come: PACKED."""

    def run(batches):
        held_ids, held, seq, part = [], [], 0, TaskContext.get().partitionId() << 32

        def block(ids: np.ndarray, m: np.ndarray, seq: int) -> pa.RecordBatch:
            longest = float(np.sqrt((m * m).sum(1)).max())
            return pa.RecordBatch.from_arrays([pa.array([part + seq], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([longest]), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([m.astype("<f8").tobytes()], pa.binary())], names=["block", "n", "longest", "ids", "rows"])

        for b in batches:
            ids, m = _matrix(b.column(1), b.column(0), scale)
            if len(ids):
                held_ids.append(ids)
                held.append(_wide(m, d))
            while sum(map(len, held)) >= size:
                ids, m = np.concatenate(held_ids), np.concatenate(held)
                yield block(ids[:size], m[:size], seq)
                held_ids, held, seq = [ids[size:]], [m[size:]], seq + 1
        if sum(map(len, held)):
            yield block(np.concatenate(held_ids), np.concatenate(held), seq)

    return vectors.mapInArrow(run, PACKED)


def _exact(q: np.ndarray, c: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Integer products of paired rows as int64; scores: the same in floating point."""
    bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1]
    if bound < EXACT:
        return scores.astype(np.int64)
    return np.array([max(-LONG - 1, min(LONG, sum(int(x) * int(y) for x, y in zip(a, b, strict=True)))) for a, b in zip(q, c, strict=True)], np.int64)


class Space:
    """The rotation and the number of leading coordinates that are summed first."""

    def __init__(self, gram: np.ndarray):
        self.d = len(gram)
        values, vectors = np.linalg.eigh(gram) if self.d else (np.zeros(0), np.zeros((0, 0)))
        self.basis = vectors[:, ::-1]
        share = np.cumsum(values[::-1]) / max(values.sum(), 1e-300)
        self.lead = int(min(self.d, max(self.d // 4, np.searchsorted(share, 0.8) + 1)))

    def parts(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leading coordinates, residual lengths, lengths."""
        lead = m @ self.basis[:, : self.lead]
        square = (m * m).sum(1)
        return lead, np.sqrt(np.maximum(square - (lead * lead).sum(1), 0) + 1e-9 * square), np.sqrt(square)

    def survivors(self, qi, q, ci, c, bound: np.ndarray, k: int):
        """(query position, id, exact score, whether it may be the query's own row) of pairs that reach the bounds and are among the k best of this block."""
        ql, qr, qn = self.parts(q)
        cl, cr, cn = self.parts(c)
        slack = 1e-9 * np.outer(qn, [cn.max(initial=0)]) + 1e-6
        live = np.flatnonzero(qn * cn.max(initial=0) + slack[:, 0] >= bound)
        if not len(live):
            return np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        upper = ql[live] @ cl.T + np.outer(qr[live], cr) + slack[live]
        at = upper >= bound[live][:, None]
        if at.mean() > 0.05:
            full = q[live] @ c.T
            at &= full + slack[live] >= bound[live][:, None]
            if c.shape[0] > k and at.sum() > k * len(live):  # the k-th best of the block is a bound as well; ties stay
                masked = np.where(at, full, -np.inf)
                kth = np.partition(masked, -k, axis=1)[:, -k]
                at &= masked >= np.nan_to_num(kth - slack[live][:, 0], neginf=-np.inf)[:, None]
            a, b = np.nonzero(at)
            scores = full[a, b]
        else:
            a, b = np.nonzero(at)
            scores = np.einsum("ij,ij->i", q[live][a], c[b])
        exact = _exact(q[live][a], c[b], scores)
        order = np.lexsort((ci[b], -exact.astype(float), a)) if np.abs(exact).max(initial=0) < EXACT else np.array(sorted(range(len(a)), key=lambda x: (a[x], -int(exact[x]), ci[b[x]])), int)
        starts = np.flatnonzero(np.concatenate([[True], np.diff(a[order]) > 0])) if len(a) else np.zeros(0, int)
        best = order[np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a)))) < k]
        x, y = live[a[best]], b[best]
        return x, ci[y], exact[best], (qi[x] == ci[y]) & (q[x] == c[y]).all(1)


def lowered(scores: np.ndarray) -> np.ndarray:
    """Bounds from scores: a little less, for the rounding of floating point."""
    return np.where(np.isfinite(scores), scores - 1e-9 * np.abs(scores) - 1e-6, -np.inf)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0) -> DataFrame:
    """vectors, queries: (id bigint, v array<float or double>). Returns query_id, rank, vec_id, score."""
    spark, vectors, queries = vectors.sparkSession, vectors.toDF("id", "v"), queries.toDF("id", "v")
    space = Space(_gram(vectors, scale))
    d, more = space.d, k + 1  # the query's own row is one of those that are kept
    whole = lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    measured = vectors.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite).withColumn("square", F.aggregate("v", F.lit(0.0), lambda s, x: s + whole(x) * whole(x)))
    # equal lengths are parted by id, so that a table of unit vectors doesn't gather in one task
    by_length = measured.repartitionByRange(F.desc("square"), "id").sortWithinPartitions(F.desc("square"), "id")
    blocks = checkpointed(_pack(by_length.select("id", "v"), d, BLOCK, scale))
    chunk_of = [F.shiftright("block", 32).alias("part"), F.floor(F.col("block").bitwiseAND(F.lit((1 << 32) - 1)) / CHUNK).alias("nth")]
    # a number per CHUNK * BLOCK vectors: the chunks' longest vectors, in descending order
    lengths = blocks.groupBy(*chunk_of).agg(F.max("longest").alias("longest")).orderBy(F.desc("longest"), "part", "nth").collect()
    longest = np.array([r.longest for r in lengths])
    first = [r.block for r in blocks.select("block").orderBy("block").limit(-(-HEAD // BLOCK)).collect()]
    head = blocks.filter(F.col("block").isin(first)).select("rows").collect()  # HEAD rows
    head_m = np.concatenate([np.frombuffer(r.rows, "<f8").reshape(-1, d) for r in head] or [np.zeros((0, d))])

    def bounded(b: pa.RecordBatch):
        out = []
        for n, rows in zip(b.column("n").to_pylist(), b.column("rows").to_pylist(), strict=True):
            q = np.frombuffer(rows, "<f8").reshape(n, d)
            s = q @ head_m.T
            out.append(lowered(np.partition(s, -more, axis=1)[:, -more] if s.shape[1] >= more else np.full(n, -np.inf)).astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "bound"])

    asked = queries.filter("id is not null and v is not null")
    asked = map_batches(_pack(asked, d, QUERY_BLOCK, scale), bounded, PACKED + ", bound binary")
    asked = checkpointed(asked.select(F.col("block").alias("q_block"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), "bound"))
    number = spark.createDataFrame([(int(r.part), int(r.nth), k) for k, r in enumerate(lengths)], "part bigint, nth bigint, chunk int")
    dealt = blocks.select(*chunk_of, "n", "ids", "rows").join(number, ["part", "nth"]).select("chunk", "n", "ids", "rows")

    def needed(b: pa.RecordBatch):
        # chunks whose longest vector may reach the bound of some query
        out = []
        for n, rows, bound in zip(b.column("q_n").to_pylist(), b.column("q_rows").to_pylist(), b.column("bound").to_pylist(), strict=True):
            size = np.sqrt((np.frombuffer(rows, "<f8").reshape(n, d) ** 2).sum(1))
            bound = np.frombuffer(bound, "<f8")
            least = np.where(bound <= 0, -1.0, bound / np.maximum(size, 1e-300)).min(initial=np.inf)
            out.append(int((longest * (1 + 1e-9) >= least).sum()))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*b.schema.names, "upto"])

    def score(b: pa.RecordBatch):
        for r in b.to_pylist():
            qi, q = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["q_rows"], "<f8").reshape(r["q_n"], d)
            ci, c = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["rows"], "<f8").reshape(r["n"], d)
            at, ids, scores, own = space.survivors(qi, q, ci, c, np.frombuffer(r["bound"], "<f8"), more)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r["q_block"])), pa.array(at.astype(np.int32)), pa.array(qi[at]), pa.array(ids), pa.array(scores), pa.array(own)], names=["q_block", "place", "query_id", "vec_id", "score", "own"])

    def tightened(b: pa.RecordBatch):
        out = []
        for bound, seen in zip(b.column("bound").to_pylist(), b.column("seen").to_pylist(), strict=True):
            bound = np.frombuffer(bound, "<f8").copy()
            for x in seen or []:
                bound[x["place"]] = max(bound[x["place"]], lowered(np.float64(x["score"])))
            out.append(bound.tobytes())
        kept = [c for c in b.schema.names if c not in ("bound", "seen")]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(out, pa.binary())], names=[*kept, "bound"])

    best, low = None, 0
    # blocks of queries are dealt into groups, so that a chunk is as many tasks as it has groups
    groups = max(1, -(-asked.count() // GROUP))
    group_of = F.pmod(F.xxhash64("q_block"), F.lit(groups)).cast("int").alias("group")
    order = Window.partitionBy("q_block", "place").orderBy(F.desc("score"), "vec_id")
    while low < max(len(lengths), 1):
        high = min(len(lengths), low + ROUND * max(1, low))
        if best is not None:
            kth = best.filter(F.col("rank") == more).groupBy("q_block").agg(F.collect_list(F.struct("place", "score")).alias("seen"))  # a row per query of a block
            asked = map_batches(asked.join(kth, "q_block", "left"), tightened, "q_block bigint, q_n int, q_ids binary, q_rows binary, bound binary")
        pruned = map_batches(asked, needed, "q_block bigint, q_n int, q_ids binary, q_rows binary, bound binary, upto int").filter(F.col("upto") > low)
        sent = pruned.select("*", group_of, F.explode(F.sequence(F.lit(low), F.least(F.col("upto"), F.lit(high)) - 1)).alias("chunk"))
        met = dealt.filter((F.col("chunk") >= low) & (F.col("chunk") < high)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        found = map_batches(sent.join(met, ["chunk", "group"]).drop("chunk", "group"), score, "q_block bigint, place int, query_id bigint, vec_id bigint, score bigint, own boolean")
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= more)
        low = high if high else 1
        if low < len(lengths):
            best, asked = checkpointed(best), checkpointed(asked)
    own = F.row_number().over(Window.partitionBy("q_block", "place", "own").orderBy(F.desc("score"), "vec_id"))
    others = best.withColumn("nth", own).filter(~(F.col("own") & (F.col("nth") == 1))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return others.select("query_id", "rank", "vec_id", "score")


#: DuckDB form of op1.
SQL = """
with e as (select row_number() over () as place, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
           where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.place as q_place, q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.v, c.v)::bigint as score
      from e q join e c on c.place <> q.place where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by q_place order by score desc, vec_id)::int as rank from p)
select query_id, rank, vec_id, score from r where rank <= 5
"""
