"""Byte-pair encoding and decoding with a pair occurrence index.

A task takes the distinct words it has not met yet, lays their symbols in one list, and indexes every adjacent pair that
has a rank by all its positions. Ranks in use are applied in ascending order: all positions of a
rank are merged left to right, and only the pairs beside a merged symbol enter or leave the index. Merging can only
make pairs of higher ranks, so each rank is visited once. The ids of a text are then gathered from its words.

A task remembers words worth at most REMEMBERED bytes; beyond that it starts anew, which costs time, never a result.
What it remembers goes with the task. A single unbroken word is merged whole, at some 150 bytes for each of its own.

Defined results: a null or blank text has no ids and decodes to an empty text; a null id stays null; every row is
encoded by itself, so repeated rows and ties get equal ids; an empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm import vocabulary
from aerolith.llm.base import slices, weight

REMEMBERED = 64 << 20
STEP = 50_000  # words at a time


def merge_all(words: list[list[int]], ranks: dict[int, int], made: list[int]) -> tuple[list[int], list[int]]:
    """Merge the symbols of all words at once by the pair occurrence index: (symbols left, number of them per word)."""
    symbols: list[int] = []
    for w in words:
        symbols += w
        symbols.append(-1)  # a border no pair crosses
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    index: dict[int, list[int]] = {}
    rank_of = ranks.get
    for at in range(n - 1):
        rank = rank_of(symbols[at] << 20 | symbols[at + 1])
        if rank is not None:
            if rank in index:
                index[rank].append(at)
            else:
                index[rank] = [at]
    active = list(index)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        places = index.pop(rank)
        if len(places) > 1:
            places.sort()
        new = made[rank]
        for at in places:
            nxt = after[at]
            # an earlier merge may have taken either symbol
            if nxt >= n or rank_of(symbols[at] << 20 | symbols[nxt]) != rank:
                continue
            symbols[at], symbols[nxt] = new, -2
            after[at] = beyond = after[nxt]
            if beyond < n:
                before[beyond] = at
                found = rank_of(new << 20 | symbols[beyond])
                if found is not None:
                    if found in index:
                        index[found].append(at)
                    else:
                        index[found] = [at]
                        heapq.heappush(active, found)
            prior = before[at]
            if prior >= 0:
                found = rank_of(symbols[prior] << 20 | new)
                if found is not None:
                    if found in index:
                        index[found].append(prior)
                    else:
                        index[found] = [prior]
                        heapq.heappush(active, found)
    left, sizes, size = [], [], 0
    for s in symbols:
        if s >= 0:
            left.append(s)
            size += 1
        elif s == -1:
            sizes.append(size)
            size = 0
    return left, sizes


class Encoder:
    """Ids of the words met so far, in one growing list."""

    def __init__(self, name: str) -> None:
        self.vocabulary = vocabulary.load(name)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.ends = np.zeros(1 << 16, np.int64)  # place k + 1 is where the ids of word k end
        self.used = self.weight = 0

    def learn(self, words: list[str]) -> None:
        left, sizes = merge_all([self.vocabulary.symbols(w) for w in words], self.vocabulary.ranks, self.vocabulary.made)
        k = len(self.known)
        while self.used + len(left) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while k + len(words) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.empty_like(self.ends)])
        self.ids[self.used : self.used + len(left)] = left
        self.ends[k + 1 : k + 1 + len(words)] = self.used + np.cumsum(sizes)
        self.used += len(left)
        self.known.update(zip(words, range(k, k + len(words)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of the texts)."""
        words, counts = [], [0]
        for text in texts:
            words += self.vocabulary.words(text)
            counts.append(len(words))
        parts = [self._part(words[k : k + STEP]) for k in range(0, len(words), STEP)]
        flat = np.concatenate([np.empty(0, np.int32), *[p for p, _ in parts]])
        ends = np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *[s for _, s in parts]]))]).astype(np.int64)
        return flat, ends[counts]

    def _part(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of them per word)."""
        known = self.known
        new = list(set(words).difference(known))
        if new:
            if self.weight + weight(new) > REMEMBERED:
                self.forget()
                known, new = self.known, list(set(words))
            self.weight += weight(new)
            self.learn(new)
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        begin = self.ends[at]
        size = self.ends[at + 1] - begin
        ends = np.cumsum(size)
        return self.ids[np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)], size


def decode_ids(ids: list[int], strings: dict[int, str]) -> str:
    """The strings of the ids joined by spaces: the file names no decoder. Special ids keep their strings."""
    return " ".join(map(strings.__getitem__, ids))


def _round_trip(name: str, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(name)
        for batch in slices(batches, "text", 1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            flat, offsets = enc.encode(texts)
            columns = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))]
            names = ["doc_id", "ids"]
            if decode:
                strings = enc.vocabulary.strings
                columns.append(pa.array([decode_ids(flat[a:b].tolist(), strings) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _decoded(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = vocabulary.load(name).strings
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode_ids(x or [], strings) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "decoded"])

    return run


def encode(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocab: str = vocabulary.DEFAULT) -> DataFrame:
    """Per row: doc_id, ids."""
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_round_trip(vocab, False), "doc_id bigint, ids array<int>")


def decode(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocab: str = vocabulary.DEFAULT) -> DataFrame:
    """Per row: doc_id, decoded."""
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decoded(vocab), "doc_id bigint, decoded string")


def round_trip(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocab: str = vocabulary.DEFAULT) -> DataFrame:
    """Per row: doc_id, ids, and the text decoded from these ids, in one pass over the texts."""
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_round_trip(vocab, True), "doc_id bigint, ids array<int>, decoded string")
