"""Exact ranked search of all documents for many queries by sparse ball trees.

A document is a sparse vector: for each of its terms weight times saturated frequency, a whole number. A query is the
vector of its term counts, the score their inner product.

1. Queries are taken in blocks (`query_blocks`) of at most BLOCK_CELLS queries x terms; every block is set against all
   documents. `profiles` reads the whole texts once a block: length, and the frequencies of the block's terms. Spark sums
   documents, lengths and document frequencies over all of them.
2. A task puts its documents into trees of TREE_DOCS (`Tree`): a ball is halved between two far apart documents down to
   LEAF of them, and keeps its centre and its radii: the largest length of what a document has beyond the centre, over
   all terms and along each single term. Queries have no negative parts, so for any document of a ball
   score <= query x centre + length of the query x radius, and score <= query x (centre + radii along the terms); the
   smaller one holds, or that of the ball above. Distances are scaled per term by the root of the term's mean value
   (`scales`), which leaves all inner products as they are and shortens the radius where terms are common.
3. A query walks the balls of a tree best bound first and stops where no bound reaches its last listed score; the list
   goes on from tree to tree of a task. Leaves are scored in whole numbers. Bounds are rounded up by far more than sums
   of that length can lose (`SLACK`), so no document is lost to rounding; a bound equal to the last score is followed, as
   a smaller id wins there.
4. The lists of the tasks are merged in two rounds, the first of them over LANES parts of the ids.

Defined results: a null text and a text or query without terms have no score and are not listed; documents of one score
are ordered by id, those without an id last, repeated rows stand for themselves; a query is a row, so a repeated one is
answered twice; empty tables give no rows. Only ids and texts are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.base import slices, texts_of
from aerolith.session import cut_lineage

TOP = 20
BLOCK_CELLS = 1 << 22
TREE_DOCS, TREE_ENTRIES, LEAF = 2048, 1 << 20, 32
LANES = 64
SLACK = 1e-9
NO_ID = (1 << 63) - 1

# Letters lower-cased, digits and all bytes beyond ASCII kept, everything else a space.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


class Block(NamedTuple):
    """Some queries: their ids, the block's terms, and per query the places of its terms and their counts."""

    ids: list[str | None]
    terms: list[bytes]
    places: list[list[int]]
    counts: list[list[int]]


def query_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", cells: int = BLOCK_CELLS) -> Iterator[Block]:
    """The queries partition by partition, in blocks of bounded size."""

    def empty() -> tuple[Block, dict[bytes, int]]:
        return Block([], [], [], []), {}

    block, known = empty()
    for row in items.select(F.col(item_id).cast("string").alias("id"), F.col(text).cast("string").alias("text")).toLocalIterator():
        found = Counter(terms_of((row.text or "").encode()))
        if not found:
            continue
        if block.ids and (len(block.ids) + 1) * (len(known) + len(found.keys() - known.keys())) > cells:
            yield block
            block, known = empty()
        for t in found:
            if t not in known:
                known[t] = len(known)
                block.terms.append(t)
        block.ids.append(row.id)
        block.places.append([known[t] for t in found])
        block.counts.append(list(found.values()))
    if block.ids:
        yield block


def _profiled(terms: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: k for k, t in enumerate(terms)}.get
        for batch in slices(batches, "text", 1 << 20):
            sizes, ends, kinds, counts = [], [0], [], []
            for text in texts_of(batch):
                words = terms_of(text)
                found, n = np.unique(np.array([k for k in map(place, words) if k is not None], np.int32), return_counts=True)
                sizes.append(len(words))
                kinds.append(found)
                counts.append(n.astype(np.int64))
                ends.append(ends[-1] + len(found))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (kinds, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return run


def profiles(docs: DataFrame, terms: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n (terms with repeats), and which of `terms` it holds how often."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_profiled(terms), "doc_id bigint, n bigint, terms array<int>, counts array<bigint>")


class Corpus(NamedTuple):
    """Documents with a term, all their terms, and the weight of each term of a block."""

    documents: int
    length: int
    weights: np.ndarray


def corpus_of(rows: DataFrame, terms: int) -> Corpus:
    n, length = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(terms, np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():  # one row a term of the block
        frequency[r.term] = r.df
    return Corpus(n, length, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64))


class Rows(NamedTuple):
    """Sparse documents one after another: ids, start of each, terms and values."""

    ids: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def sums(self, factors: np.ndarray) -> np.ndarray:
        """Per document the sum of factor[term] x value, in the type of these."""
        return np.add.reduceat(self.values * factors[self.terms], self.starts)

    def picked(self, at: np.ndarray) -> Rows:
        sizes = np.diff(np.append(self.starts, len(self.terms)))[at]
        starts = np.cumsum(sizes) - sizes
        own = np.arange(sizes.sum()) + np.repeat(self.starts[at] - starts, sizes)
        return Rows(self.ids[at], starts, self.terms[own], self.values[own])


def rows_of(ids: np.ndarray, lengths: np.ndarray, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray, corpus: Corpus) -> Rows:
    m = 100 - 25 + (25 * lengths * corpus.documents) // corpus.length
    sizes = np.diff(ends)
    values = corpus.weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 12 * np.repeat(m, sizes)))
    return Rows(ids, ends[:-1].astype(np.int64), terms, values)


def scales(rows: Rows, terms: int) -> np.ndarray:
    """Per term the root of its mean value; one where it does not occur."""
    mean = np.bincount(rows.terms, rows.values.astype(float), terms) / len(rows.ids)
    return np.where(mean > 0, np.sqrt(np.maximum(mean, 1e-300)), 1.0)


class Tree:
    """Balls over the documents: centres, radii, the two halves of each, or the documents of a leaf."""

    def __init__(self, rows: Rows, terms: int) -> None:
        self.scale = scales(rows, terms)
        scaled = rows._replace(values=rows.values / self.scale[rows.terms])
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.along: list[np.ndarray] = []
        self.above: list[int] = []
        self.halves: list[list[int]] = []
        self.leaves: list[Rows | None] = []
        ahead = [(np.arange(len(rows.ids)), -1)]
        while ahead:
            at, above = ahead.pop()
            k, own = len(self.radii), scaled.picked(at)
            centre = np.bincount(own.terms, own.values, terms) / len(at)
            beyond, along = np.maximum(own.values - centre[own.terms], 0), np.zeros(terms)
            np.maximum.at(along, own.terms, beyond)
            self.centres.append(centre)
            self.radii.append(math.sqrt(float(np.add.reduceat(beyond**2, own.starts).max())))
            self.along.append(along)
            self.above.append(above)
            self.halves.append([])
            if above >= 0:
                self.halves[above].append(k)
            self.leaves.append(rows.picked(at) if len(at) <= LEAF else None)
            if len(at) > LEAF:
                order = np.argsort(self._pull(own, centre, terms), kind="stable")
                ahead += [(at[order[: len(at) // 2]], k), (at[order[len(at) // 2 :]], k)]

    @staticmethod
    def _pull(own: Rows, centre: np.ndarray, terms: int) -> np.ndarray:
        """Squared distance from a document far off the centre, less that from the one farthest from it."""
        squares = np.add.reduceat(own.values**2, own.starts)

        def distances(point: np.ndarray) -> np.ndarray:
            return squares - 2 * own.sums(point) + point @ point

        def place(k: int) -> np.ndarray:
            one = own.picked(np.array([k]))
            return np.bincount(one.terms, one.values, terms)

        near = distances(place(int(distances(centre).argmax())))
        return near - distances(place(int(near.argmax())))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Per query and ball a number that no score in the ball exceeds."""
        scaled = queries * self.scale
        at_centre = scaled @ np.array(self.centres).T
        out = at_centre + np.minimum(np.linalg.norm(scaled, axis=1)[:, None] * np.array(self.radii), scaled @ np.array(self.along).T)
        out = out * (1 + SLACK) + 1
        for k in range(1, len(self.above)):  # a ball comes after the one above it
            np.minimum(out[:, k], out[:, self.above[k]], out=out[:, k])
        return out


class Best:
    """The listed documents of one query, best first."""

    def __init__(self, top: int) -> None:
        self.top, self.scores, self.ids = top, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """Scores below this are never listed."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least
        if good.any():
            scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
            order = np.lexsort((ids, -scores))[: self.top]
            self.scores, self.ids = scores[order], ids[order]


def walk(tree: Tree, bounds: np.ndarray, query: np.ndarray, best: Best) -> int:
    """Balls best bound first until none reaches the list; the number of leaves scored."""
    ahead, scored = [(-float(bounds[0]), 0)], 0
    while ahead and -ahead[0][0] >= best.least:
        k = heapq.heappop(ahead)[1]
        leaf = tree.leaves[k]
        if leaf is not None:
            best.take(leaf.sums(query), leaf.ids)
            scored += 1
        else:
            for half in tree.halves[k]:
                heapq.heappush(ahead, (-float(bounds[half]), half))
    return scored


def _query_matrix(block: Block) -> np.ndarray:
    queries = np.zeros((len(block.ids), len(block.terms)), np.int64)
    for k, (places, counts) in enumerate(zip(block.places, block.counts, strict=True)):
        queries[k, places] = counts
    return queries


def _searched(block: Block, corpus: Corpus, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, lists = _query_matrix(block), [Best(top) for _ in block.ids]
        dense = queries.astype(float)
        for rows in _trees(batches, corpus):
            tree = Tree(rows, len(block.terms))
            bounds = tree.bounds(dense)
            for k, best in enumerate(lists):
                walk(tree, bounds[k], queries[k], best)
        found = [len(b.ids) for b in lists]
        columns = [np.repeat(np.arange(len(lists), dtype=np.int32), found), *(np.concatenate([np.empty(0, np.int64), *x]) for x in ([b.ids for b in lists], [b.scores for b in lists]))]
        names = pa.array(block.ids, pa.string()).take(pa.array(columns[0]))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0]), names, pa.array(columns[1]), pa.array(columns[2])], ["query", "item_id", "doc_id", "score"])

    return run


def _trees(batches: Iterator[pa.RecordBatch], corpus: Corpus) -> Iterator[Rows]:
    """Documents that hold a term of the block, as many at a time as a tree takes."""
    held: list[tuple] = []
    n = entries = 0

    def out() -> Rows:
        ids, lengths, sizes, terms, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        return rows_of(ids, lengths, np.concatenate([[0], np.cumsum(sizes)]), terms, counts, corpus)

    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            sizes = np.diff(part.column("terms").offsets.to_numpy())
            some = sizes > 0
            if not some.any():
                continue
            ids = part.column("doc_id").fill_null(NO_ID).to_numpy()[some]
            flat = [part.column(c).flatten().to_numpy() for c in ("terms", "counts")]
            held.append((ids, part.column("n").to_numpy()[some], sizes[some], *flat))
            n, entries = n + len(ids), entries + len(flat[0])
            if n >= TREE_DOCS or entries >= TREE_ENTRIES:
                yield out()
                held, n, entries = [], 0, 0
    if held:
        yield out()


def merged(lists: DataFrame, top: int = TOP) -> DataFrame:
    """The best `top` of each query with their rank, from lists of several tasks."""
    order = [F.col("score").desc(), F.col("doc_id")]
    lane = F.pmod(F.xxhash64("doc_id", "score"), F.lit(LANES))
    part = lists.withColumn("lane", lane).withColumn("rank", F.row_number().over(Window.partitionBy("query", "lane").orderBy(*order))).where(F.col("rank") <= top)
    return part.drop("lane").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", top: int = TOP, cells: int = BLOCK_CELLS) -> DataFrame:
    """Per query its `top` best documents: item_id, rank from 1, doc_id, score."""
    kind, out = items.schema[item_id].dataType, None
    for block in query_blocks(items, item_id, text, cells):
        rows = cut_lineage(profiles(docs, block.terms, doc_id, text))
        corpus = corpus_of(rows, len(block.terms))
        if not corpus.length:
            break
        lists = rows.where(F.size("terms") > 0).mapInArrow(_searched(block, corpus, top), "query int, item_id string, doc_id bigint, score bigint")
        best = merged(lists, top).select(F.col("item_id").cast(kind).alias("item_id"), "rank", F.nullif(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"), "score")
        out = best if out is None else out.unionByName(best)
    if out is None:
        return docs.sparkSession.createDataFrame([], "rank int, doc_id bigint, score bigint").select(F.lit(None).cast(kind).alias("item_id"), "rank", "doc_id", "score")
    return out
