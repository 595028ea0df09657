"""Benchmark decontamination as a prefix-filtered set join.

An item's window is 10 consecutive words (a shorter item is one window). A window is held as its set of 3-word shingles
in order. A document contains a window exactly when it contains all its shingles side by side, so with containment
1 the necessary prefix of a window is its rarest shingle:

1. shingles of the benchmark are counted over all documents (`counted`); windows with a shingle that never occurs go;
2. each window's shingles are ordered by rarity and the first one is its prefix;
3. documents report the places of prefix shingles with the words around (`placed`), joined to windows by shingle;
4. the place of the shingle inside the window fixes where the window would start; it must lie inside the document
   (positional and length bounds), and its words must equal the window's words (exact containment).

Tasks find benchmark shingles with a bitmap of fixed size (FILTER_BITS); a benchmark too large for it only lets more
rows through to the join, never fewer. Items and windows are joined by Spark, so neither side is held by a task.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has no window; a null item
id still makes its words hit but is not listed; repeated rows get equal results; empty tables give zeros or no rows. Only
ids and texts are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.base import hashes_of, row_key, runs, slices, texts_of
from aerolith.session import cut_lineage

WINDOW, SHINGLE = 10, 3
FILTER_BITS = 23
HITS = 20_000  # places of prefix shingles that leave a task at once

# Letters lower-cased, digits and all bytes beyond ASCII kept, everything else a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 18):
        out: list[tuple] = []
        for item, text in zip(batch.column("item_id").to_pylist(), texts_of(batch), strict=True):
            words = words_of(text)
            n = min(WINDOW, len(words))
            width = min(SHINGLE, n)
            marks = runs(hashes_of(words), width).view(np.int64) if n else []
            for at in range(len(words) - n + 1 if n else 0):
                out.append((item, b" ".join(words[at : at + n]).decode(), n, marks[at : at + n - width + 1].tolist()))
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item_id", "window", "n", "marks"])


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    rows = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_item_windows, "item_id string, window string, n int, marks array<bigint>")


def bitmap(marks: DataFrame) -> bytes:
    """Bits of the marks, 2 ^ FILTER_BITS of them whatever the number of marks; built by Spark, at most 1 MiB here."""
    at = F.col("mark").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    parts = marks.select(at.alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))
    whole = np.zeros((1 << FILTER_BITS) // 8 + 4096, np.uint8)
    for row in parts.collect():
        # buckets count from 1 and hold 2 ^ 15 bits each; bucket 0 holds no bit of ours but the first
        start = max(0, row.bucket - 1) * 4096
        whole[start : start + 4096] |= np.frombuffer(row.bits, np.uint8)
    return whole.tobytes()


class Filter:
    """Which of a document's shingles may belong to the benchmark."""

    def __init__(self, bits: bytes) -> None:
        self.bits = np.frombuffer(bits, np.uint8)

    def hits(self, marks: np.ndarray) -> np.ndarray:
        at = (marks & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
        slot = np.where(at > 0, at - 1, 0)  # bit position of x is (x - 1) mod 2 ^ 15 for x > 0
        return np.flatnonzero(self.bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)


def _marks(words: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of the runs of one, two and three words; the shorter ones serve items shorter than a shingle."""
    hashes = hashes_of(words)
    for width in range(1, SHINGLE + 1):
        yield width, runs(hashes, width)


def _counted(bits: bytes, widths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(bits)
        for batch in slices(batches, "text", 1 << 20):
            found = [np.empty(0, np.uint64)]
            for text in texts_of(batch):
                for width, marks in _marks(words_of(text)):
                    if width in widths:
                        found.append(marks[known.hits(marks)])
            marks, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(marks.view(np.int64)), pa.array(counts.astype(np.int64))], ["mark", "n"])

    return run


_PLACED = "doc_id bigint, key binary, n_words bigint, mark bigint, at int, lead int, around string"


def _placed(bits: bytes, widths: list[int]):
    """A row with the key and the size of each document, and a row for each of its prefix shingles (`mark` not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(bits)
        names = [c.split(" ")[0] for c in _PLACED.split(", ")]
        for batch in slices(batches, "text", 1 << 19):
            keys, words = batch.column("key").to_pylist(), [words_of(t) for t in texts_of(batch)]
            n, none = batch.num_rows, [pa.nulls(batch.num_rows, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([len(w) for w in words], pa.int64()), *none], names)
            for k in range(n):
                for width, marks in _marks(words[k]):
                    if width in widths:
                        found = known.hits(marks)
                        for cut in range(0, len(found), HITS):
                            at = found[cut : cut + HITS]
                            lead = np.minimum(at, WINDOW - 1)
                            around = [b" ".join(words[k][a - b : a + WINDOW]) for a, b in zip(at.tolist(), lead.tolist(), strict=True)]
                            columns = [pa.nulls(len(at), pa.int64()), pa.array([keys[k]] * len(at), pa.binary()), pa.array(np.full(len(at), len(words[k]))), pa.array(marks[at].view(np.int64))]
                            yield pa.RecordBatch.from_arrays([*columns, pa.array(at.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(around, pa.binary()).cast(pa.string())], names)

    return run


def contained_windows(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, key, n_words; occurrences: key, at, n, window) of item windows in whole documents."""
    plain = windows.select("window", "n", "marks").distinct()
    each = plain.select("window", "n", F.posexplode("marks").alias("off", "mark"))
    widths = [r.w for r in plain.select(F.least("n", F.lit(SHINGLE)).alias("w")).distinct().collect()]
    counts = docs.mapInArrow(_counted(bitmap(each), widths), "mark bigint, n bigint").groupBy("mark").agg(F.sum("n").alias("seen"))
    rated = each.join(counts, "mark", "left").groupBy("window", "n").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), F.col("mark"), F.col("off"))).alias("first")
    )
    prefixes = cut_lineage(rated.where("first.seen > 0").select("window", "n", "first.mark", "first.off"))
    placed = cut_lineage(docs.mapInArrow(_placed(bitmap(prefixes), widths), _PLACED))
    found, places = placed.where("mark is null").select("doc_id", "key", "n_words"), placed.where("mark is not null").drop("doc_id")
    joined = places.join(prefixes, "mark").withColumn("start", F.col("at") - F.col("off"))
    inside = joined.where((F.col("start") >= 0) & (F.col("off") <= F.col("lead")) & (F.col("start") + F.col("n") <= F.col("n_words")))
    words = F.slice(F.split("around", " "), F.col("lead") - F.col("off") + 1, F.col("n"))
    return found, inside.where(F.array_join(words, " ") == F.col("window")).select("key", F.col("start").alias("at"), "n", "window")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_hit (words inside an occurring window), item_ids (sorted as strings), contaminated, key
    (of id and text)."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), row_key(doc_id, text).alias("key"))
    windows = cut_lineage(item_windows(items, item_id, text))
    found, occurring = contained_windows(rows, windows)
    listed = occurring.select("key", "window").distinct().join(windows.select("window", "item_id").distinct(), "window")
    items_of = listed.groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    spans = occurring.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("stop")))).alias("spans"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    fold = lambda a, s: F.struct((a["n"] + F.greatest(s["stop"] - F.greatest(s["at"], a["reach"]), F.lit(0))).alias("n"), F.greatest(a["reach"], s["stop"]).alias("reach"))
    per = spans.select("key", F.aggregate("spans", start, fold, lambda a: a["n"]).cast("bigint").alias("n_hit"))
    out = found.join(per, "key", "left").join(items_of, "key", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "key"
    )
