"""Repeated passages by difference-cover anchors.

A window is `window` consecutive words. A word goes when a window that covers it also starts in a document with a smaller
id; windows are judged on the input.

1. `anchors`: a difference cover modulo a period holds, for every shift between two places, a pair of residues at that
   shift. So two equal windows share an anchor: a shorter run of words that starts at a cover position of both texts.
   Only cover positions are hashed (6 of 31 for windows of 50 words). Texts of equal words are one class, of which the
   smallest id takes part.
2. `shared_places`: anchors that occur in two classes, back at their places. Counted by minimum and maximum, on the map
   side first; their table is written, so that the join back is split where one anchor fills a third of all texts.
3. `extended`: around a shared anchor every window that holds it is hashed (128 bits), from the whole text. Equal windows
   meet by hash; each keeps its smallest document, again by a map-side minimum. No pair of occurrences is formed, so a
   passage in thousands of documents costs its rows, not their square.
4. `without_repeats`: each text drops the words of its windows that an earlier document holds. A text whose whole class
   has a smaller id and that has a window goes entirely.

Anchors are 64-bit hashes: two that collide only add windows to step 3. Windows and classes count as equal when 128 bits
are.

Defined results: a null, empty or blank text has no words; fewer words than a window are all kept; a null id neither
loses words nor takes any from others; rows of one id never take words from each other, each is judged by itself; a
window repeated inside one document stays; an empty table gives an empty result. Only id and text are read, so other
columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.base import hashes_of, mixed, slices, texts_of
from aerolith.session import cut_lineage

WINDOW = 50

# Perfect difference sets, by their period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}

EMPTY = hashlib.sha256(b"").hexdigest()


def period_of(window: int) -> int:
    """The longest period that leaves an anchor of three eighths of a window at least."""
    return max(p for p in COVERS if 8 * p <= 5 * window + 3)


def spans(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each `width` neighbouring values, put together from runs of doubling lengths."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total, level, size, done, left = np.full(count, width, np.uint64), hashes, 1, 0, width
    while True:
        if left & 1:
            total = mixed(total) + level[done : done + count]
            done += size
        left >>= 1
        if not left:
            return mixed(total)
        level = mixed(level[:-size]) + level[size:]
        size *= 2


def cover_places(count: int, period: int) -> np.ndarray:
    """The first `count` places that lie on the cover, ascending."""
    return np.flatnonzero(np.isin(np.arange(count) % period, COVERS[period]))


def _anchored(window: int):
    period = period_of(window)
    length = window - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = cover_places(1 << 12, period)
        for batch in slices(batches, "text", 1 << 20):
            rows = [(i, w) for i, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True) if len(w := t.split()) >= window]
            sizes = np.array([len(w) for _, w in rows], np.int64)
            if len(sizes) and sizes.max() > cover[-1]:
                cover = cover_places(int(sizes.max()) * 2, period)
            starts = np.cumsum(sizes) - sizes
            counts = np.searchsorted(cover, sizes - length, side="right")
            hashed = spans(hashes_of([x for _, w in rows for x in w]), length).view(np.int64)
            at = np.concatenate([np.empty(0, np.int64), *[cover[:c] + s for c, s in zip(counts.tolist(), starts.tolist(), strict=True)]])
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            wholes = [xxhash.xxh3_128_digest(b" ".join(w)) for _, w in rows]
            columns = [pa.array([i for i, _ in rows], pa.int64()), pa.array(wholes, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashed[at]))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "whole", "anchors"])

    return run


def _windowed(window: int):
    period = period_of(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            for doc, text, places in zip(batch.column("doc_id").to_pylist(), texts_of(batch), batch.column("places"), strict=True):
                words = text.split()
                count = len(words) - window + 1
                # another text that bears the same id may be shorter
                anchors = cover_places(len(words), period)
                known = places.values.to_numpy()
                anchors = anchors[np.sort(known[known < len(anchors)])]
                if doc is None or count <= 0 or not len(anchors):
                    continue
                edges = np.zeros(len(words) + 1, np.int32)  # windows that hold an anchor start at most period - 1 before it
                np.add.at(edges, np.maximum(anchors - period + 1, 0), 1)
                np.add.at(edges, anchors + 1, -1)
                at = np.flatnonzero(np.cumsum(edges)[:count] > 0)
                a, b = window_keys(words, window)
                for cut in range(0, len(at), 1 << 16):
                    some = at[cut : cut + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(a[some]), pa.array(b[some]), pa.array(np.full(len(some), doc)), pa.array(some.astype(np.int32))], ["a", "b", "doc_id", "at"])

    return run


def window_keys(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every window."""
    lanes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
    return spans(np.ascontiguousarray(lanes[:, 0]), window).view(np.int64), spans(np.ascontiguousarray(lanes[:, 1]), window).view(np.int64)


def _whole(window: int):
    """Hash of all words of each text that has a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            words = [t.split() for t in texts_of(batch)]
            wholes = [xxhash.xxh3_128_digest(b" ".join(w)) if len(w) >= window else None for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(wholes, pa.binary())], ["doc_id", "whole"])

    return run


_KEPT = "doc_id bigint, n_words bigint, n_removed bigint, kept string"


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            out: list[tuple] = []
            for doc, text, removed, copies in zip(batch.column("doc_id").to_pylist(), texts_of(batch), batch.column("removed"), batch.column("copies").to_pylist(), strict=True):
                words = text.split()
                joined, size, n = b" ".join(words), len(words), 0
                if doc is not None and copies and size >= window and xxhash.xxh3_128_digest(joined) in copies:
                    joined, n = b"", size
                elif doc is not None and removed.is_valid and len(removed) and size >= window:
                    gone = covered(words, removed.values, window)
                    n = int(gone.sum())
                    joined = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if n else joined
                out.append((doc, size, n, joined.decode()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def covered(words: list[bytes], removed: pa.StructArray, window: int) -> np.ndarray:
    """Which words lie in a removed window; a window of another text with the same id does not count."""
    at, key = removed.field("at").to_numpy(), removed.field("b").to_numpy()
    own = window_keys(words, window)[1]
    at = at[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] == key)]
    edges = np.zeros(len(words) + 1, np.int32)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return np.cumsum(edges)[:-1] > 0


def anchors(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per class of equal texts of at least a window: whole (hash of its words), rep (smallest id), anchors in order."""
    signed = df.where("doc_id is not null").select("doc_id", "text").mapInArrow(_anchored(window), "doc_id bigint, whole binary, anchors array<bigint>")
    return signed.groupBy("whole").agg(F.min("doc_id").alias("rep"), F.first("anchors").alias("anchors"))


def shared_places(classes: DataFrame) -> DataFrame:
    """Per document: the numbers of its anchors that another document has too."""
    each = classes.select("rep", F.posexplode("anchors").alias("k", "anchor"))
    shared = cut_lineage(each.groupBy("anchor").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("anchor"))
    return each.join(shared, "anchor").groupBy("rep").agg(F.collect_set("k").alias("places"))


def extended(docs: DataFrame, places: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, window: start and half of the hash) for each window that a document with a smaller id holds too."""
    rows = docs.join(places, F.col("key") == F.col("rep")).select("doc_id", "text", "places")
    windows = rows.mapInArrow(_windowed(window), "a bigint, b bigint, doc_id bigint, at int")
    first = cut_lineage(windows.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"))
    return windows.join(first, ["a", "b"]).where("first < doc_id").select("doc_id", F.struct("at", "b").alias("window"))


def copies(docs: DataFrame, classes: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, whole) of documents whose words are all those of one with a smaller id."""
    wholes = docs.select("doc_id", "text").mapInArrow(_whole(window), "doc_id bigint, whole binary")
    return wholes.join(classes.select("whole", "rep"), "whole").where("rep < doc_id").select("doc_id", "whole")


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
    # the key is never null, so that both joins with the texts read one shuffle of them
    docs = df.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-1)).alias("key"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    classes = cut_lineage(anchors(docs, window))
    windows = extended(docs, shared_places(classes), window)
    gone = windows.withColumn("whole", F.lit(None).cast("binary")).unionByName(copies(docs, classes, window), allowMissingColumns=True)
    later = gone.groupBy(F.col("doc_id").alias("later")).agg(F.collect_set("window").alias("removed"), F.collect_set("whole").alias("copies"))
    return docs.join(later, F.col("key") == F.col("later"), "left").select("doc_id", "text", "removed", "copies").mapInArrow(_kept(window), _KEPT)
