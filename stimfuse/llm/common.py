"""What several operators share: batch mapping over texts, word patterns and text limits."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value of the contracts: a word is a run of bytes that are none of these.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts of a batch are worked on in slices of about this many characters, so that memory follows neither the batch nor the table.
SLICE_CHARS = 4_000_000


def slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts hold about `limit` characters; one text is never split."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t is not None else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow of a function that gets one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    return df.mapInArrow(run, schema)


def free_name(name: str, columns: list[str]) -> str:
    """The name, or one made from it, that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


#: Stands for a null id, and is larger than all others; bits of a bitmap of ids at most (as a power of two); parts in which a bitmap comes to the driver, each by a job.
NULL_ID, ID_BITS, BITMAP_PARTS = 2**63 - 1, 27, 16


def id_places(ids: np.ndarray, bits: int) -> np.ndarray:
    """The place of each id in a bitmap of 2**bits bits."""
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ h >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


def id_bitmap(ids: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bitmap of n ids (one column, no nulls), of at most 2**ID_BITS bits, and the number of bits as a power of two: it may hold more ids, never fewer."""
    bits = int(min(ID_BITS, max(16, np.ceil(np.log2(max(n, 1) * 64)))))

    def words(b: pa.RecordBatch):
        k = id_places(np.asarray(b.column(0)), bits)
        yield pa.RecordBatch.from_arrays([pa.array(k >> 5), pa.array(np.int64(1) << (k & 31))], names=["word", "bit"])

    table = np.zeros(1 << bits - 5, np.uint32)
    for r in map_batches(ids, words, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bit")).coalesce(BITMAP_PARTS).toLocalIterator():  # words of one bitmap
        table[r["word"]] = r["bit"]
    return table, bits


def in_bitmap(ids: pa.Array, table: np.ndarray, bits: int) -> np.ndarray:
    """Whether the bitmap may hold each id."""
    k = id_places(np.asarray(ids.cast(pa.int64()).fill_null(NULL_ID)), bits)
    return (table[k >> 5] >> (k & 31).astype(np.uint32) & 1).astype(bool)
