"""Helpers several operators share: reading tables, slices of bounded size inside tasks, words of bytes."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Text of at most so many bytes (or one row) is worked on at a time inside a Python task.
SLICE_BYTES = 4 << 20

LOWER_ASCII = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits of an id, which may be null or repeated, and its text; null and empty texts count as equal."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("bigint").cast("string"), F.lit("~")), F.lit("|"), F.coalesce(F.col(text).cast("string"), F.lit("")))))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again in batches whose text stays under `limit` bytes; a longer text comes alone."""
    for batch in batches:
        lengths = np.frombuffer(pc.binary_length(batch.column(column)).fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False), np.int64)
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [b"" if t is None else t for t in batch.column(column).cast(pa.binary()).to_pylist()]


def weight(words: Collection[str]) -> int:
    """Bytes that remembering the words takes, about: an entry each, and up to eight bytes a character."""
    return sum(map(len, words)) * 8 + 180 * len(words)


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each `width` neighbouring values, in order."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:count].copy()
    for k in range(1, width):
        total = mixed(total) + hashes[k : count + k]
    return mixed(total + np.uint64(width))
