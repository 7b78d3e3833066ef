"""Token counts through a digest cache.

A cache row is (content_digest, tokenizer_digest, n_tokens). The content digest is SHA-256 of the text's UTF-8 bytes, null as
the empty text; no other normalisation is made, since any would change counts. The tokenizer digest is SHA-256 of the
vocabulary file, so counts of another version are never read. Contents are joined to the cache, only distinct misses are
encoded, and their counts are appended as new files, so a job that is run again finds what an earlier one stored.

Encoding splits a text at white space, which the tokenizer's own pattern can't see across, and keeps the counts of chunks in
a bounded memo; the tokenizers library counts the chunks that the memo lacks. A text that holds an added token's string goes
to the library whole.

Edge cases: null and empty texts have 0 tokens; texts of any length are counted whole; repeated rows each get their count; rows
with a null id or an id that repeats are kept, and are told apart by the digests of their texts; an empty table gives no rows and
appends nothing; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stimfuse.llm.byte_bpe import CHUNK
from stimfuse.llm.common import map_batches

CACHE = T.StructType([T.StructField("content_digest", T.StringType()), T.StructField("tokenizer_digest", T.StringType()), T.StructField("n_tokens", T.LongType())])

#: Entries that the memo of a worker may hold before it is emptied, and the longest chunk that it keeps.
MEMO, MEMO_CHARS = 600_000, 64


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Counter:
    """Token counts of whole texts, as the library gives them without special tokens added."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.by_chunk = False
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.library = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path) as f:
                spec = json.load(f)
            cut = spec.get("pre_tokenizer") or {}
            # chunks may be counted apart only if nothing rewrites the text and the pattern is the byte-level one
            self.by_chunk = spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and spec.get("post_processor") is None
            self.added = re.compile("|".join(re.escape(x["content"]) for x in spec.get("added_tokens", [])) or r"(?!)")
        self.memo: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_chunk:
            return self.library(texts)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        out = []
        for text in texts:
            if self.added.search(text):
                out += self.library([text])
                continue
            keys = CHUNK.findall(text)
            try:
                out.append(sum([memo[k] for k in keys]))
                continue
            except KeyError:
                pass
            new = list({k for k in keys if k not in memo})
            found = dict(zip(new, self.library(new), strict=True))
            out.append(sum([found[k] if k in found else memo[k] for k in keys]))
            memo.update((k, v) for k, v in found.items() if len(k) <= MEMO_CHARS)
        return out


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def read_cache(spark: SparkSession, cache_dir: str) -> DataFrame:
    """The stored counts, one row per pair of digests; an absent folder is an empty cache."""
    try:
        found = spark.read.schema(CACHE).parquet(cache_dir)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)
    return found.groupBy("content_digest", "tokenizer_digest").agg(F.max("n_tokens").alias("n_tokens"))


def with_token_counts(docs: DataFrame, tokenizer_path: str, cache_dir: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per input row: (id, n_bytes, n_tokens, over_limit); the cache in cache_dir gets the counts it lacked.

    Texts are shuffled once, by id and digest, to meet the distinct misses; everything else is shuffled as digests. The id that
    stands for a content is its smallest, found by a partial aggregation, so copies of one text never meet in one task, and
    neither do the texts of one id, null or not.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(text.cast("binary"), 256)
    keyed = docs.select(F.col(id_col).alias("id"), digest.alias("content_digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    stored = read_cache(spark, cache_dir).filter(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")
    misses = keyed.groupBy("content_digest").agg(F.min("id").alias("id")).join(stored, "content_digest", "left_anti")
    # the least id is null only if all are; another value in its place keeps the join an equality
    wanted = misses.select(F.coalesce("id", F.lit(-(2**63))).alias("key"), "content_digest")
    source = docs.select(F.coalesce(F.col(id_col), F.lit(-(2**63))).alias("key"), digest.alias("content_digest"), text.alias("text"))

    def encode(b: pa.RecordBatch):
        # rows that repeat id and text are one miss
        distinct = dict(zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True))
        n = counter(tokenizer_path).counts(list(distinct.values()))
        yield pa.RecordBatch.from_arrays([pa.array(list(distinct), pa.string()), pa.array([version] * len(distinct), pa.string()), pa.array(n, pa.int64())], names=CACHE.names)

    new = map_batches(source.join(wanted, ["key", "content_digest"]).select("text", "content_digest"), encode, "content_digest string, tokenizer_digest string, n_tokens bigint")
    new.write.mode("append").parquet(cache_dir)
    counts = read_cache(spark, cache_dir).filter(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")
    return keyed.join(counts, "content_digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
