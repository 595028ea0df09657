"""Near-duplicate classes by b-bit MinHash.

1. `signatures`: the distinct shingles of each whole text give bands x ROWS minima. The low B_BITS of the minima are
   packed into a signature of 64 bytes; each band of minima becomes one 64-bit key. Texts of equal shingle sets are one
   class from here on, so exact copies cost one row each.
2. `estimated_links`: classes meet in the buckets of equal band keys. Inside a bucket the similarity is estimated from
   the number of equal b-bit groups, corrected for chance agreement, and pairs whose estimate and sizes leave no room for a
   link go. A bucket hands on its connected parts (a star each), never its pairs.
3. `verified_links`: the parts form clusters; every link lies inside one. Members of a cluster meet again, block against
   block, with their whole texts, and every pair that passes the estimate and is not connected yet is decided on the
   full shingle sets. Again only stars leave a task.
4. `connected` turns stars into classes by alternating large and small stars.

Buckets and clusters larger than BLOCK rows are cut into blocks and dealt out as pairs of blocks, so that no task holds
a whole group and no pair inside it is left out. The number of bands and the margin of the estimate follow the threshold
(`bands_of`, `margin_of`). Chances to miss a link at the threshold itself: all bands, below 3e-7; the estimate (4.5
standard deviations), below 1e-5, and only where nothing else connects the two.

Defined results: a text without words (null, empty) has an empty set and is linked with nothing; a text of fewer words
than a shingle has one shingle, the whole sequence; a null id cannot be referred to, its row stays a class of its own
with a null component; repeated rows share their class and their id; an empty table gives an empty result. Only the id
and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.base import LOWER_ASCII, hashes_of, mixed, runs, slices, texts_of
from aerolith.session import cut_lineage

SHINGLE = 5
ROWS, B_BITS, KEPT = 5, 4, 128
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
PERCENT, MISSED, DEVIATIONS = 85, 3e-7, 4.5

SIGNATURE_SCHEMA = "doc_id bigint, n_shingles bigint, set_hash binary, bands array<bigint>, sig binary"


def shingle_set(words: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(runs(hashes_of(words), min(width, len(words))))


def bands_of(percent: int) -> int:
    """Bands that all miss a pair at the threshold with a chance below MISSED; at least enough minima for a signature."""
    return max(math.ceil(KEPT / ROWS), math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** ROWS))) if percent < 100 else 1)


def margin_of(percent: int) -> float:
    """How far below the threshold an estimate may lie: DEVIATIONS of a share of KEPT groups, corrected for chance."""
    share = percent / 100
    return DEVIATIONS * max(0.01, math.sqrt(share * (1 - share) / KEPT)) / (1 - 1 / (1 << B_BITS))


def _families(bands: int) -> tuple[np.ndarray, np.ndarray]:
    steps = mixed(np.arange(1, 2 * bands * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (steps[::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (steps[1::2] >> np.uint64(32)).astype(np.uint32)


def minima(sets: list[np.ndarray], bands: int) -> np.ndarray:
    """Minimum of each hash function over each (not empty) set: sets x functions."""
    factor, offset = _families(bands)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), bands * ROWS), np.uint32)
    work = np.empty_like(values)
    for k in range(bands * ROWS):
        np.multiply(values, factor[k], out=work)
        np.add(work, offset[k], out=work)
        out[:, k] = np.minimum.reduceat(work, starts)
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """Low bits of the kept minima, two groups of four bits a byte."""
    bits = (low[:, :KEPT] & np.uint32((1 << B_BITS) - 1)).astype(np.uint8)
    return bits[:, ::2] << 4 | bits[:, 1::2]


def band_keys(low: np.ndarray) -> np.ndarray:
    bands = low.shape[1] // ROWS
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(low), 1))
    rows = low.astype(np.uint64).reshape(len(low), bands, ROWS)
    for r in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return keys.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (64-bit words in the last axis), corrected for chance agreement."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    x &= np.uint64(0x1111111111111111)
    equal = KEPT - np.bitwise_count(x).sum(-1, dtype=np.int64)
    chance = 1 / (1 << B_BITS)
    return (equal / KEPT - chance) / (1 - chance)


def _signed(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sets = [shingle_set(t.translate(LOWER_ASCII).split()) for t in texts_of(batch)]
            some = [s for s in sets if len(s)]
            keys, sigs = None, None
            if some:
                low = minima(some, bands)
                keys, sigs = iter(band_keys(low)), iter(packed(low))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_hash", "bands", "sig"],
            )

    return run


def signatures(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: id, size and hash of its shingle set, band keys, packed signature."""
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_signed(bands_of(percent)), SIGNATURE_SCHEMA)


class Union:
    """Connected parts of a few items."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        self.up[self.top(a)] = self.top(b)

    def stars(self, ids: np.ndarray) -> tuple[list[int], list[int]]:
        """(smallest id of the part, other id) for each item that is not alone."""
        tops = np.array([self.top(x) for x in range(len(self.up))])
        least: dict[int, int] = {}
        for t, i in zip(tops.tolist(), ids.tolist(), strict=True):
            least[t] = min(i, least.get(t, i))
        pairs = {(least[t], i) for t, i in zip(tops.tolist(), ids.tolist(), strict=True) if least[t] != i}
        return [a for a, _ in pairs], [b for _, b in pairs]


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that come sorted by `keys`; each has two blocks of rows at most."""
    held: list[pa.RecordBatch] = []

    def cut(rows: pa.Table) -> np.ndarray:
        change = np.zeros(max(0, rows.num_rows - 1), bool)
        for k in keys:
            c = rows.column(k).to_numpy()
            change |= c[1:] != c[:-1]
        return np.flatnonzero(change) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch])
        ends = cut(rows)
        if len(ends):
            yield rows.slice(0, int(ends[-1])), ends[:-1]
            rows = rows.slice(int(ends[-1]))
        held = rows.to_batches()
    if held:
        yield pa.Table.from_batches(held), np.empty(0, np.int64)


def _passing(sig: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    close = estimate(sig[left], sig[right]) >= percent / 100 - margin_of(percent)
    a, b = sizes[left], sizes[right]
    return close & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))


def _pairs(own: np.ndarray, first: int, second: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of two blocks, or of all pairs inside one."""
    if first == second:
        return np.triu_indices(len(own), 1)
    a, b = np.flatnonzero(own == first), np.flatnonzero(own == second)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def _sig_words(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _estimated(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _grouped(batches, ["key", "bi", "bj"]):
            ids, sizes, own = (rows.column(c).to_numpy() for c in ("rep", "n_shingles", "block"))
            bi, bj, sig = rows.column("bi").to_numpy(), rows.column("bj").to_numpy(), _sig_words(rows.column("sig"))
            starts, ends = np.concatenate([[0], cuts]).astype(np.int64), np.concatenate([cuts, [rows.num_rows]]).astype(np.int64)
            out_a, out_b = [], []
            lengths = ends - starts
            for n in np.unique(lengths[(lengths > 1) & (lengths <= 8)]).tolist():  # small groups of one size together
                at = starts[(lengths == n) & (bi[starts] == bj[starts])]
                i, j = np.triu_indices(n, 1)
                left, right = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                ok = _passing(sig, sizes, left, right, percent)
                out_a += ids[left[ok]].tolist()
                out_b += ids[right[ok]].tolist()
            for s, e in zip(starts[lengths > 1].tolist(), ends[lengths > 1].tolist(), strict=True):
                if e - s <= 8 and bi[s] == bj[s]:
                    continue
                left, right = _pairs(own[s:e], bi[s], bj[s])
                ok = _passing(sig[s:e], sizes[s:e], left, right, percent)
                parts = Union(e - s)
                for a, b in zip(left[ok].tolist(), right[ok].tolist(), strict=True):
                    parts.join(a, b)
                a, b = parts.stars(ids[s:e])
                out_a += a
                out_b += b
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _grouped(batches, ["cluster", "bi", "bj"]):
            starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), rows.num_rows]
            for s, e in zip(starts, ends, strict=True):
                yield _decided(rows.slice(s, e - s), percent)

    return run


def _decided(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """Stars of the links between two blocks of a cluster, decided on whole shingle sets."""
    ids, sizes, own = (rows.column(c).to_numpy() for c in ("rep", "n_shingles", "block"))
    left, right = _pairs(own, rows.column("bi")[0].as_py(), rows.column("bj")[0].as_py())
    sig = _sig_words(rows.column("sig"))
    parts, sets = Union(len(ids)), {}
    texts, hashes = rows.column("text"), rows.column("set_hash")

    def of(x: int) -> np.ndarray:
        if x not in sets:
            found = shingle_set(texts[x].as_py().encode().translate(LOWER_ASCII).split())
            # another text that bears the same id is not this class
            sets[x] = found if xxhash.xxh3_128_digest(found) == hashes[x].as_py() else np.empty(0, np.uint64)
        return sets[x]

    for at in range(0, len(left), 1 << 18):
        a, b = left[at : at + (1 << 18)], right[at : at + (1 << 18)]
        ok = _passing(sig, sizes, a, b, percent)
        for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
            if parts.top(x) != parts.top(y):
                u, v = of(x), of(y)
                both = np.concatenate([u, v])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(u) + len(v) - common) > 0:
                    parts.join(x, y)
    a, b = parts.stars(ids)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _in_blocks(rows: DataFrame, keys: list[str], blocks: str) -> DataFrame:
    """Deal the rows of a group out to all pairs of its blocks; a group of one block stays one group."""
    out = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
    out = out.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("other", blocks)
    return out.repartition(*keys, "bi", "bj").sortWithinPartitions(*keys, "bi", "bj")


def estimated_links(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Stars (a, b) over the parts of each bucket that the estimate connects."""
    keys = classes.select("rep", F.explode("bands").alias("key"))
    shared = keys.withColumn("n", F.expr("count(1) over (partition by key)")).where("n > 1")
    rows = shared.join(classes.select("rep", "n_shingles", "sig"), "rep").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("bigint")).drop("n")
    return _in_blocks(rows, ["key"], "blocks").mapInArrow(_estimated(percent), "a bigint, b bigint").distinct()


def verified_links(df: DataFrame, classes: DataFrame, clusters: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Stars (a, b) over the links of each cluster, decided on the whole texts."""
    sizes = clusters.join(classes.select(F.col("rep").alias("node"), "n_shingles"), "node").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("bigint")
    members = clusters.join(sizes.select("cluster", blocks.alias("blocks")), "cluster").join(classes.select(F.col("rep").alias("node"), "set_hash", "n_shingles", "sig"), "node")
    rows = df.join(members.withColumnRenamed("node", "rep").hint("shuffle_hash"), F.col("doc_id") == F.col("rep")).drop("doc_id")
    return _in_blocks(rows, ["cluster"], "blocks").mapInArrow(_verified(percent), "a bigint, b bigint").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, smallest node of its component) for every node of the edges.

    Large stars hang the larger neighbours of a node on its smallest one, small stars hang the smaller ones on the
    smallest; both together settle in a logarithmic number of rounds. Each round is one written table.
    """
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("hi", "lo")), F.lit(0))).first())

    before = mark(now)
    while before[0]:
        both = now.select("hi", "lo").union(now.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*")
        now = cut_lineage(small.where("hi <> lo").distinct())
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("cluster")).union(now.select(F.col("lo"), F.col("lo")).distinct())


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over links), kept (the id is the component's).

    Two rows are linked when 100 x common shingles >= percent x all shingles of both.
    """
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = cut_lineage(signatures(rows, percent=percent))
    classes = cut_lineage(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_hash", "n_shingles", "bands", "sig").agg(F.min("doc_id").alias("rep"))
    )
    clusters = connected(estimated_links(classes, percent))
    parts = connected(verified_links(rows, classes, clusters, percent))
    named = classes.select("set_hash", "rep").join(parts, F.col("rep") == F.col("node"), "left").select("set_hash", F.coalesce("cluster", "rep").alias("found"))
    out = signed.select("doc_id", "n_shingles", "set_hash").join(named, "set_hash", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("found", "doc_id")).cast("bigint")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
