"""Token counts without tokens: symbols minus merges.

Each distinct word is a linked list of symbols and a heap of its adjacent pairs by (rank, position). The lowest pair is
popped, merged if it still stands, and its two neighbour pairs are pushed; every merge lowers the count by one. No id
leaves a task, only a number per text. A task remembers the counts of words worth at most REMEMBERED bytes.

Defined results: a null or blank text has 0 tokens and, if null, 0 bytes; a null id stays null; rows are counted one by
one, so repeated rows and ties are equal; an empty table gives an empty result. Other columns are not read.
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
STEP = 50_000  # words of a text at a time


def count_merged(symbols: list[int], ranks: dict[int, int], made: list[int]) -> int:
    """Number of symbols left when no adjacent pair has a rank."""
    n = len(symbols)
    if n < 2:
        return n
    symbols, rank_of = list(symbols), ranks.get
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(rank, at) for at in range(n - 1) if (rank := rank_of(symbols[at] << 20 | symbols[at + 1])) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        rank, at = heapq.heappop(heap)
        nxt = after[at]
        if nxt < 0 or symbols[at] < 0 or rank_of(symbols[at] << 20 | symbols[nxt]) != rank:
            continue  # one of the two has been merged meanwhile
        new = made[rank]
        symbols[at], symbols[nxt] = new, -1
        after[at] = beyond = after[nxt]
        left -= 1
        if beyond >= 0:
            before[beyond] = at
            if (found := rank_of(new << 20 | symbols[beyond])) is not None:
                heapq.heappush(heap, (found, at))
        prior = before[at]
        if prior >= 0 and (found := rank_of(symbols[prior] << 20 | new)) is not None:
            heapq.heappush(heap, (found, prior))
    return left


class Counter:
    def __init__(self, name: str) -> None:
        self.vocabulary = vocabulary.load(name)
        self.known: dict[str, int] = {}
        self.weight = 0

    def of(self, text: str) -> int:
        words, known = self.vocabulary.words(text), self.known
        total = 0
        for k in range(0, len(words), STEP):
            part = words[k : k + STEP]
            new = set(part).difference(known)
            if self.weight + weight(new) > REMEMBERED:
                known.clear()
                self.weight, new = 0, set(part)
            self.weight += weight(new)
            for w in new:
                known[w] = count_merged(self.vocabulary.symbols(w), self.vocabulary.ranks, self.vocabulary.made)
            total += sum(map(known.__getitem__, part))
        return total


def _counted(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(name)
        for batch in slices(batches, "text", 1 << 20):
            counts = np.fromiter((counter.of(t) if t else 0 for t in batch.column("text").to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 2048, vocab: str = vocabulary.DEFAULT) -> DataFrame:
    """Per row: doc_id, n_bytes of UTF-8, n_tokens, over_limit (n_tokens > limit)."""
    body = F.col(text).cast("string")
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.octet_length(body), F.lit(0)).cast("bigint").alias("n_bytes"), body.alias("text"))
    out = rows.mapInArrow(_counted(vocab), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
