"""The corpus pipeline: five stages over documents, each of which works on all that the one before it kept.

1. Toxicity: documents whose whole text is judged toxic by a machine learned from `labels` go.
2. SimHash near-dedup: of each component one document stays, with the smallest doc_id; fingerprints within 3 bits are linked, and
   texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
3. Suffix-array dedup: byte strings of 50 that a document with a smaller doc_id holds are cut out; every document stays.
4. Mixing sources: documents are taken 0, 1 or 2 times, so that each source's words come near its target.
5. Byte-level BPE: each document is encoded and decoded; the rows carry the counts and digests of both.

Nulls, empty texts, ties, repeated rows and empty tables have the results that the operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stimfuse.llm import byte_bpe, mixing, simhash_dedup, suffix_dedup, toxicity
from stimfuse.session import ensure_shipped, shared_dir, small_batches, table


def _prepare(spark: SparkSession) -> None:
    ensure_shipped(spark)
    small_batches(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, machine)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return simhash_dedup.keep_one(docs, similar=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    found = suffix_dedup.remove(docs, 50)
    return found.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in found.columns else found


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return mixing.mixed(docs, [3.0, 1.0, 2.0], 1.5, 2.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return byte_bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("simhash_dedup", drop_near_copies), ("suffix_dedup", cut_repeats), ("mixing", mix_sources), ("byte_bpe", encode)]

#: SQL can't express the kernel machine, XXH64 or BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            at = shared_dir(spark, f"pipeline-{k}-{name}")
            docs.write.parquet(at)
            docs = spark.read.parquet(at)
    return docs
