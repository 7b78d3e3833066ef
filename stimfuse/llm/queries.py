"""The numbered queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stimfuse.llm import byte_bpe, collocations, exact_topk, language_id, license_scan, media_tiff, mixing, simhash_dedup, spelling_variants, substring_dedup, suffix_dedup, token_counts, toxicity
from stimfuse.llm.common import crc_mod
from stimfuse.session import ensure_shipped, shared_dir, small_batches, table


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_topk.search(vectors, vectors.filter("vec_id % 50 = 0"), k=5, scale=256.0)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=3, radius=3, seed=42)
    return found.select("doc_id", simhash_dedup.digits("fp").alias("fingerprint"), "component_id")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), [3.0, 1.0, 2.0], 1.5, 2.0).select("doc_id", "size", "source_size", "target", "taken")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    found = toxicity.scores(docs, machine)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(table(spark, sf_dir, "documents"), 50)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict(docs, model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_tiff.text_features(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each run starts with a cache of its own, so that every distinct text is encoded
    return token_counts.with_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), shared_dir(spark, "token-counts"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"), shortest=7, least=2, every=31, times=10)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(table(spark, sf_dir, "documents"), 35)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), longest=4, least=30, share=80, top=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}

    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_shipped(spark)
            small_batches(spark)
            return f(spark, sf_dir)

        return run

    return {k: shipped(f) for k, f in own.items()}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": exact_topk.SQL, "op3_source_mixing": mixing.SQL, "op11_spelling_variants": spelling_variants.SQL, "op12_substring_dedup": substring_dedup.SQL, "op13_collocations": collocations.SQL}
