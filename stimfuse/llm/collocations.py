"""Collocations by SETM: phrases grow by a word at a time, from occurrence relations that are stored and joined by place.

An occurrence relation has the places where frequent phrases of k words stand, in order of piece and position. It is stored packed: a
row holds many pieces of one language, as runs of neighbouring places; a run of m words is m - k + 1 occurrences at adjacent positions.
Each length takes two passes. The first joins every occurrence with the word at the adjacent position of its piece (both sides are in
order, so places merge), counts the longer phrases in its rows, and Spark sums the counts by phrase. The second is the semi-join: it
keeps the occurrences of phrases with at least `least` of them, and stores those that stand next to another.

The semi-join asks a bitmap of bounded size, which may let rare phrases pass, never hold a frequent one back; their counts, which are
always exact, drop them. Before phrases are counted, their hashes are: occurrences are summed by bucket, and only phrases of buckets that
hold `least` are counted by themselves, so that the many phrases that occur once or twice aren't shuffled. So nothing that grows with the
corpus is broadcast or collected, and no phrase is told by a hash alone.

Edge cases: a null text is empty, a null language is `und`; texts without words give nothing; long texts are taken whole; repeated rows
count again; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stimfuse.llm.common import BITMAP_PARTS, id_bitmap, in_bitmap, map_batches, slices
from stimfuse.session import checkpointed, shared_dir

#: Fixed value of the contract: these end a piece. A byte that no text has stands for them, as a word of its own.
ENDS, END = ".,;:!?\n\x0b\x0c\r", b"\xff"
_TABLE = bytes(255 if chr(b) in ENDS else b for b in range(256))
#: Characters of the texts in a row of a relation; one text is never split.
ROW = 600_000
#: Bits of a bucket's number; bytes of a relation whose buckets a task sums; buckets that a task deals to those tasks together.
BITS, PART, HELD = 27, 4 << 20, 1 << 20
#: Groups of a language in which its best phrases are found before they meet.
SALTS = 64

RELATION, COUNTS = "lang string, runs binary", "lang string, phrase string, f bigint"


def pieces(text: str) -> bytes:
    """Pieces of a text, A-Z lowered, as words and piece ends that spaces separate."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_TABLE).replace(END, b" \xff ")


class Occurrences:
    """Words of some pieces of one language, in order: `word` has their numbers, 0 for the end of a piece."""

    def __init__(self, words: list[bytes], word: np.ndarray):
        self.words, self.word = words, word

    @classmethod
    def read(cls, runs: bytes) -> Occurrences:
        words = runs.split()  # what the table leaves of white space is spaces and tabs
        number: dict[bytes, int] = defaultdict(count().__next__)
        number[END]  # is 0
        return cls(words, np.fromiter(map(number.__getitem__, words), np.int64, len(words)))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of all phrases of k words, the number of the phrase at each, a place of each phrase)."""
        place = np.flatnonzero(self.word)
        gram = self.word[place]
        one = np.full(int(gram.max(initial=0)) + 1, -1)
        one[gram] = place
        first = one[one >= 0]
        gram = (np.cumsum(one >= 0) - 1)[gram]
        for n in range(1, k):
            # places of n words meet the word that follows, unless their piece ends there
            inside = place + n < len(self.word)
            inside[inside] = self.word[place[inside] + n] > 0
            place, gram = place[inside], gram[inside]
            key = gram << 32 | self.word[place + n]
            order = np.argsort(key)
            key = key[order]
            opens = np.concatenate([key[:1] >= 0, key[1:] != key[:-1]])
            first, gram = order[opens], np.empty(len(key), np.int64)
            gram[order] = np.cumsum(opens) - 1
            first = place[first]
        return place, gram, first

    def phrase(self, at: int, k: int) -> bytes:
        return b" ".join(self.words[at : at + k])

    def runs(self, place: np.ndarray, k: int) -> Occurrences:
        """The relation of these places of phrases of k words, without those that have no neighbour."""
        cut = np.flatnonzero(np.diff(place) != 1) + 1
        begins = np.concatenate([place[:1], place[cut]])
        ends = np.concatenate([place[cut - 1], place[-1:]]) + k
        some = ends - begins > k
        begins, size = begins[some], (ends - begins)[some] + 1  # with the end of the piece
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begins, size)
        last = np.cumsum(size) - 1
        at[last] = 0
        word = self.word[at] if len(at) else at
        word[last] = 0
        words = list(map(self.words.__getitem__, at.tolist()))
        for x in last.tolist():
            words[x] = END
        return Occurrences(words, word)

    def hashed(self, lang: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """grams(), and the hash of each phrase, which follows from its language and words alone."""
        place, gram, first = self.grams(k)
        h_word = np.zeros(int(self.word.max(initial=0)) + 1, np.uint64)
        if len(first):
            one = self.grams(1)[2]
            h_word[self.word[one]] = [xxhash.xxh64_intdigest(self.words[p], 42) for p in one.tolist()]
        return place, gram, first, _mixed(lang, [h_word[self.word[first + n]] for n in range(k)])

    def buckets(self, lang: str, k: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """grams(), and the bucket of each phrase, which follows from its language and words alone."""
        place, gram, first, h = self.hashed(lang, k)
        return place, gram, first, (h >> np.uint64(64 - bits)).astype(np.int64)


def _mixed(lang: str, words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from those of their words: the first words' hashes, the second words', and so on."""
    h = np.full(len(words[0]), xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), len(words)), np.uint64)
    for w in words:
        h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _hashes(lang: str, phrases: list[bytes], k: int) -> pa.Array:
    """Occurrences.hashed() of phrases of k words."""
    words = np.array([xxhash.xxh64_intdigest(w, 42) for p in phrases for w in p.split(b" ")], np.uint64).reshape(-1, k)
    return pa.array(_mixed(lang, list(words.T)).view(np.int64))


def relation(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All words of all texts as RELATION."""

    def pack(b: pa.RecordBatch):
        by: dict[str, list[str]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text:
                by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for lo, hi in slices(texts, ROW):
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([b" \xff ".join(map(pieces, texts[lo:hi]))], pa.binary())], names=["lang", "runs"])

    return map_batches(docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")), pack, RELATION)


def _rows(b: pa.RecordBatch) -> Iterator[tuple[str, Occurrences]]:
    for lang, runs in zip(b.column(0).to_pylist(), b.column(1), strict=True):
        yield lang, Occurrences.read(runs.as_py())


def _buckets(found: Occurrences, lang: str, k: int, least: int) -> np.ndarray:
    """(bucket, occurrences in it, at most `least`) of the phrases of k words."""
    _, gram, first, bucket = found.buckets(lang, k, BITS)
    return _summed(bucket, np.bincount(gram, minlength=len(first)), least)


def _summed(bucket: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """Buckets in order and the sums of their n, at most `least`: only whether they reach it is asked."""
    order = np.argsort(bucket)
    bucket = bucket[order]
    opens = np.flatnonzero(np.diff(bucket, prepend=-1))
    return np.stack([bucket[opens], np.minimum(np.add.reduceat(n[order], opens), least) if len(opens) else opens])


def _bucket_rows(held: list[np.ndarray], least: int, shift: int) -> list[tuple]:
    """(part, buckets, occurrences in each) of many rows of a relation together, by ranges of 2**shift buckets: rows of each by themselves
    would grow with rows times ranges, so with the square of the texts."""
    bucket, n = _summed(*np.concatenate(held, axis=1), least)
    cuts = np.flatnonzero(np.diff(bucket >> shift, prepend=-1)).tolist()
    return [(int(bucket[p] >> shift), bucket[p:q].astype("<u4").tobytes(), n[p:q].astype("<u4").tobytes()) for p, q in zip(cuts, [*cuts[1:], len(bucket)], strict=True)]


def heavy_buckets(rows: DataFrame, least: int, shift: int) -> np.ndarray:
    """A bitmap of the buckets that hold at least `least` occurrences; rows (part, bucket, n) of _bucket_rows(), a part to a task."""

    def add(key, t):
        start = key[0].as_py() << shift
        total = np.zeros(1 << shift, np.int64)
        for bucket, n in zip(t.column("bucket"), t.column("n"), strict=True):
            np.add.at(total, np.frombuffer(bucket.as_buffer(), "<u4").astype(np.int64) - start, np.frombuffer(n.as_buffer(), "<u4"))
        heavy = np.flatnonzero(total >= least) + start
        first = int(heavy[0] >> 3) if len(heavy) else 0
        piece = np.zeros(int(heavy[-1] >> 3) - first + 1 if len(heavy) else 0, np.uint8)
        np.bitwise_or.at(piece, (heavy >> 3) - first, (1 << (heavy & 7)).astype(np.uint8))
        return pa.table({"first": pa.array([first], pa.int64()), "piece": pa.array([piece.tobytes()], pa.binary())})

    bitmap = np.zeros(1 << BITS - 3, np.uint8)
    # parts are summed by all tasks at once; only then their pieces come, a few tasks' after one another
    found = checkpointed(rows.select("part", "bucket", "n").groupBy("part").applyInArrow(add, "first bigint, piece binary"))
    for r in found.coalesce(BITMAP_PARTS).toLocalIterator():  # pieces of one bitmap
        piece = np.frombuffer(r.piece, np.uint8)
        bitmap[r.first : r.first + len(piece)] |= piece
    return bitmap


def counts(rel: DataFrame, k: int, heavy: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, f) of the phrases of k words in a relation, of heavy buckets alone if they are given; for k = 1 the empty phrase has
    the number of all words."""
    shared = rel.sparkSession.sparkContext.broadcast(heavy)  # 2**BITS bits at most

    def count(b: pa.RecordBatch):
        for lang, found in _rows(b):
            if shared.value is None:
                place, gram, first = found.grams(k)
                n = np.bincount(gram, minlength=len(first))
            else:
                place, gram, first, bucket = found.buckets(lang, k, BITS)
                some = np.flatnonzero(shared.value[bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1)
                n, first = np.bincount(gram, minlength=len(first))[some], first[some]
            phrases = [found.phrase(p, k) for p in first.tolist()]
            if k == 1:
                phrases, n = [*phrases, b""], np.append(n, len(place))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "f"])

    return map_batches(rel, count, COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


STORED = RELATION + ", part bigint, bucket binary, n binary"


def frequent_places(rel: DataFrame, frequent: DataFrame, k: int, least: int, shift: int) -> DataFrame:
    """STORED: the relation of the phrases of k words that are frequent (and of some others, which the bitmap lets pass), and beside it
    the buckets of the phrases of k + 1 words that it holds, in rows of their own."""

    def hashed(b: pa.RecordBatch):
        by: dict[str, list[bytes]] = {}
        for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            by.setdefault(lang, []).append(phrase)
        for lang, phrases in by.items():
            yield pa.RecordBatch.from_arrays([_hashes(lang, phrases, k)], names=["id"])

    spark = rel.sparkSession
    shared = spark.sparkContext.broadcast(id_bitmap(map_batches(frequent.select("lang", "phrase"), hashed, "id bigint"), frequent.count()))  # 2**ID_BITS bits at most

    def made(lang: str | None, runs: bytes | None, found: list[tuple]) -> pa.RecordBatch:
        out = [(lang, runs, None, None, None)] if runs is not None else [(None, None, *x) for x in found]
        kinds = (pa.string(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=["lang", "runs", "part", "bucket", "n"])

    def keep(batches):
        held, size = [], 0
        for lang, found in (x for b in batches if b.num_rows for x in _rows(b)):
            place, gram, _, h = found.hashed(lang, k)
            if not len(place):
                continue
            kept = in_bitmap(pa.array(h.view(np.int64)), *shared.value)
            found = found.runs(place[kept[gram]], k)
            if not found.words:
                continue
            yield made(lang, b" ".join(found.words), [])
            held.append(_buckets(found, lang, k + 1, least))
            size += held[-1].shape[1]
            if size >= HELD:
                yield made(None, None, _bucket_rows(held, least, shift))
                held, size = [], 0
        if size:
            yield made(None, None, _bucket_rows(held, least, shift))

    return rel.mapInArrow(keep, STORED)


def frequent_phrases(docs: DataFrame, longest: int = 4, least: int = 30, text_col: str = "text", lang_col: str = "lang") -> list[DataFrame]:
    """For each length k up to `longest`, (lang, phrase, f) of the phrases with at least `least` occurrences; the first also has the empty
    phrase of each language, with the number of its words."""
    spark, out, heavy = docs.sparkSession, [], None
    rel = relation(docs, text_col, lang_col)
    for k in range(1, longest + 1):
        at = shared_dir(spark, f"phrases-{k}")
        counts(rel, k, heavy).filter((F.col("f") >= least) | (F.col("phrase") == "")).write.parquet(at)
        out.append(spark.read.schema(COUNTS).parquet(at))
        if k < longest:
            at = shared_dir(spark, f"occurrences-{k}")
            size = rel.agg(F.sum(F.octet_length("runs"))).first()[0] or 0 if k > 1 else docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
            shift = BITS - int(np.ceil(np.log2(min(1 << BITS - 10, max(64, -(-size // PART))))))
            frequent_places(rel, out[-1].filter("phrase <> ''"), k, least, shift).write.parquet(at)
            stored = spark.read.schema(STORED).parquet(at)
            heavy = heavy_buckets(stored.filter("part is not null"), least, shift)
            rel = stored.filter("part is null").select("lang", "runs")
    return out


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, share: int = 80, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's `top` phrases: (lang, rank, phrase, a, l, r, n, score).

    A phrase of 2 to `longest` words with a >= `least` occurrences scores floor(2000000 a / (l + r)) at the cut where that is least (ties:
    after the fewest words), l and r being the occurrences of both parts. It is dropped if a longer such phrase that holds it occurs at
    least `share` percent as often. Products and sums are decimals of 38 digits."""
    levels = frequent_phrases(docs, longest, least, text_col, lang_col)
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)
    n = levels[0].filter("phrase = ''").select("lang", F.col("f").alias("n"))
    words = F.split("phrase", " ")
    found = every.withColumn("w", words).withColumn("k", F.size("w")).filter("k > 1").select("lang", "phrase", "w", "k", F.col("f").alias("a"))
    part = lambda first, size: F.array_join(F.slice("w", first, size), " ")
    cuts = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(every.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("cast(2000000 as decimal(10, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: F.array_join(F.slice("w", at, size), " "))))
    longer = found.filter("k > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    absorbed = F.expr(f"cast(100 as decimal(10, 0)) * cast(longer as decimal(19, 0)) >= cast({share} as decimal(10, 0)) * cast(a as decimal(19, 0))")
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | ~absorbed).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of a language are among the best of its groups
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return kept.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]', chr(10), 'g'), chr(10))) as p from documents),
words as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from pieces),
grams as (select lang, k.range as k, unnest(list_transform(range(1, greatest(len(w) - k.range + 2, 1)), lambda i: array_to_string(w[i : i + k.range - 1], ' '))) as phrase from words, range(1, 5) k),
f as (select lang, k, phrase, count(*) as f from grams group by all),
total as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
cand as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 30),
cuts as (select c.lang, c.k, c.phrase, c.a, w, j.range as j, array_to_string(w[1 : j.range], ' ') as first, array_to_string(w[j.range + 1 : c.k], ' ') as rest from cand c, range(1, 4) j where j.range < c.k),
scored as (select c.lang, c.phrase, c.a, l.f as l, r.f as r, ((2000000::hugeint * c.a) // (l.f + r.f))::bigint as score, row_number() over (partition by c.lang, c.phrase order by (2000000::hugeint * c.a) // (l.f + r.f), j) as nth
  from cuts c join f l on l.lang = c.lang and l.phrase = c.first and l.k = c.j join f r on r.lang = c.lang and r.phrase = c.rest and r.k = c.k - c.j),
subs as (select lang, array_to_string(w[i.range : i.range + s.range - 1], ' ') as phrase, max(a) as longer from cand, range(2, 4) s, range(1, 4) i where s.range < k and i.range + s.range - 1 <= k group by all),
kept as (select s.*, row_number() over (partition by s.lang order by score desc, a desc, s.phrase) as rank from scored s left join subs u on u.lang = s.lang and u.phrase = s.phrase where nth = 1 and (longer is null or 100::hugeint * longer < 80::hugeint * a))
select lang, rank, phrase, a, l, r, n, score from kept join total using (lang) where rank <= 2000"""
