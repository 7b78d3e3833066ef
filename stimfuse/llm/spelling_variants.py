"""Spelling variants of a corpus's words, found by PartEnum signatures of their letters.

A word is the multiset of its letters, taken as a binary vector with one dimension for each (letter, how manieth time). Two words
that differ by one inserted, deleted or replaced code point differ in at most two dimensions. The dimensions are parted into PARTS
partitions; of a pair at most two of these differ, so for some choice of two partitions all the others are equal. A signature is such a
choice with the hash of what the others hold: near words have an equal signature. Words meet in an equi-join on signatures, whose
condition verifies the pair (letters by a parity mask, then the edit distance itself), so no unverified pair is a row.

Signatures of more than GROUP words are dealt in parts: a word stands in one part on one side of the join, and in all on the other.

Edge cases: a null text has no words, a null id counts as the empty text, texts and runs of any length are taken whole, repeated rows
count again, an empty table gives no rows; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stimfuse.llm.common import map_batches, slices
from stimfuse.session import checkpointed

#: Partitions of the dimensions (each signature leaves two out), words of a signature that meet in one part, and bytes of the table of
#: larger signatures up to which it is broadcast.
PARTS, GROUP, BROADCAST = 6, 2048, 16 << 20
#: Characters of a text that are searched at once; the cut is moved on to the end of a run.
PIECE = 1 << 20

#: Fixed value of the contract: the letters of a run. Runs shorter than the least length can't become words.
LETTERS = r"A-Za-zÀ-ÿ"


def runs_of(text: str, shortest: int):
    """Lists of the maximal runs of at least `shortest` letters."""
    pattern, other, at = re.compile(f"[{LETTERS}]{{{shortest},}}"), re.compile(f"[^{LETTERS}]"), 0
    while at < len(text):
        cut = other.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield pattern.findall(text, at, end)
        at = end


def words_of(doc: str, text: str, shortest: int, every: int) -> Counter:
    """Words of one text, by number of occurrences: of runs whose checksum `every` divides, one code point is deleted."""
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # of bytes, this lowers A-Z alone
    begun, out = zlib.crc32(f"{doc}:".encode()), Counter()
    for found in runs_of(lowered, shortest):
        for run, n in Counter(found).items():
            h = zlib.crc32(run.encode(), begun)
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= shortest:
                out[run] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, every: int = 31) -> DataFrame:
    """(word, n) of all words of at least `shortest` code points and `least` occurrences."""

    def count(b: pa.RecordBatch):
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lo, hi in slices(texts):
            total: Counter = Counter()
            for doc, text in zip(ids[lo:hi], texts[lo:hi], strict=True):
                if text:
                    total.update(words_of("" if doc is None else doc, text, shortest, every))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    found = map_batches(docs.select(F.col(id_col).cast("string"), text_col), count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def signatures(words: list[str], parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """(words x choices of two partitions, parity mask per word): words at a Hamming distance of at most two share a signature, and
    their masks differ in at most two bits."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(words)), [len(w) for w in words])
    letters = np.sort(of << 21 | code)
    opens = np.concatenate([[True], letters[1:] != letters[:-1]])
    nth = np.arange(len(letters)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]
    letter = letters & ((1 << 21) - 1)
    h = _mixed((letter << 32 | nth).astype(np.uint64) + np.uint64(1))
    held = np.zeros((len(words), parts), np.uint64)
    # neighbours in the alphabet and repeats of a letter go to different partitions
    np.bitwise_xor.at(held, (letters >> 21, (letter + 2 * nth) % parts), h)
    mask = np.zeros(len(words), np.uint64)
    np.bitwise_xor.at(mask, letters >> 21, np.uint64(1) << (h >> np.uint64(58)))
    whole = np.bitwise_xor.reduce(held, axis=1)
    out = np.stack([_mixed(whole ^ held[:, p] ^ held[:, q] ^ np.uint64(k)) for k, (p, q) in enumerate(combinations(range(parts), 2))], axis=1)
    return out, mask


def near_pairs(words: DataFrame, parts: int = PARTS, group: int = GROUP) -> DataFrame:
    """words (word, n): (a, na, b, nb) with a < b for all pairs at an edit distance of one, each once."""

    def sign(b: pa.RecordBatch):
        sigs, mask = signatures(b.column(0).to_pylist(), parts)
        n = sigs.shape[1]
        again = pa.array(np.repeat(np.arange(len(sigs)), n))
        yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64).ravel()), b.column(0).take(again), b.column(1).take(again), pa.array(np.repeat(mask.view(np.int64), n))], names=["sig", "word", "n", "mask"])

    rows = map_batches(words.select("word", "n"), sign, "sig bigint, word string, n bigint, mask bigint")
    large = checkpointed(rows.groupBy("sig").agg(F.count("*").alias("size")).filter(F.col("size") > group).select("sig", F.ceil(F.col("size") / group).cast("int").alias("parts")))
    if large.count() * 16 <= BROADCAST:
        large = F.broadcast(large)
    dealt = rows.join(large, "sig", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    key = lambda p: F.xxhash64("sig", p)
    one = dealt.select(key(part).alias("key"), F.col("word").alias("a"), F.col("n").alias("na"), F.col("mask").alias("ma"))
    every = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    every = every.select(key(F.col("part")).alias("key"), F.col("word").alias("b"), F.col("n").alias("nb"), F.col("mask").alias("mb"))
    # in the parts of a large signature a pair meets twice, once from each side: the order of the words decides which counts
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("ma").bitwiseXOR(F.col("mb"))) <= 2) & (F.levenshtein("a", "b", 1) == 1)
    return one.hint("merge").join(every, (one.key == every.key) & near).select("a", "na", "b", "nb").distinct()


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, every: int = 31, times: int = 10) -> DataFrame:
    """One row per word: (word, form, root, n, n_near, form_n). A word's form is its most frequent near word (ties: the smallest) if that
    occurs at least `times` as often, else null; its root is the last form that forms lead to."""
    words = checkpointed(vocabulary(docs, id_col, text_col, shortest, least, every))
    pairs = checkpointed(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("own"), F.col("b").alias("other"), F.col("nb").alias("other_n")).union(pairs.select("b", "nb", "a", "na"))
    best = both.groupBy("word", "own").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    enough = -F.col("best.minus") >= times * F.col("own")
    near = checkpointed(best.select("word", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")))
    up = near.filter("form is not null").select("word", F.col("form").alias("root"))
    # a form occurs `times` as often as its word, so chains are short; each round doubles the steps that are taken
    most = words.agg(F.max("n")).first()[0] or 1
    for _ in range(int(np.ceil(np.log2(max(np.log(most) / np.log(times), 1)))) + 1):
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = checkpointed(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    found = words.join(near, "word", "left").join(up, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")


SQL = r"""with recursive crc as (select list_transform(range(256), lambda k: list_reduce(list_prepend(k::bigint, range(8)), lambda c, i: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
one as (select doc_id, run, count(*) as n from runs where length(run) >= 7 group by all),
sums as (select run, n, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::varchar, '') || ':' || run)), '..'), lambda b: ('0x' || b)::bigint) as bytes from one),
hashed as (select run, n, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as h from sums, crc),
cut as (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from cut where length(word) >= 7 group by word having sum(n) >= 2),
less as (select word, i.range as at, substr(word, 1, i.range - 1) || substr(word, i.range + 1) as rest from words, range(1, 10000) i where i.range <= length(word)),
pairs as (select x.word as a, y.word as b from less x join less y on x.at = y.at and x.rest = y.rest and x.word <> y.word
  union select x.word, w.word from less x join words w on x.rest = w.word union select w.word, x.word from less x join words w on x.rest = w.word),
best as (select a as word, count(*) as n_near, arg_min(b, (-n, b)) as near, max(n) as top from pairs join words on b = words.word group by a),
formed as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when top >= 10 * w.n then near end as form, case when top >= 10 * w.n then top end as form_n from words w left join best b on w.word = b.word),
up as (select word, word as root from formed where form is null union all select f.word, u.root from formed f join up u on f.form = u.word)
select word, form, root, n, n_near, form_n from formed join up using (word)"""
