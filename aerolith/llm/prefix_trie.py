"""The trie of conversation prefixes by union-find over sorted neighbours.

1. `sequences`: a turn becomes the 128-bit digest of its role and text; a conversation is the row of its digests, the
   first ones taken from the conversation it branches from.
2. The sequences are sorted over all partitions (equal ones by id, so that a sequence with a third of all rows spreads).
   A task takes blocks of BLOCK neighbours, measures the common prefix of each two (`shared`), and joins them by
   union-find in descending depth (`joined`): two parts that meet at a depth where neither ends make a branching node;
   a part that ends there takes the other one in. Prefixes between two such nodes follow by running sums.
3. Only nodes above the first or the last sequence of a block can reach beyond it. All others are finished there. The
   rest of a block, contracted, is two paths with sums at each depth (members, smallest id, and what hangs off the path).
   These paths are sorted and joined by the same step again, until one block holds them all: each round leaves two
   paths of a block, so a few rounds do for any input.
4. The ids that end at an unfinished node leave a block as one piece of text; pieces are hashed in order as they stream
   by (`ends_of`). Finished nodes below an unfinished one learn its id by its digest.

A task holds one block of digests and sums, some 60 bytes a turn, never texts. Digests stand for turns and prefixes.

Defined results: turns are taken by turn (null first), equal turns by digest; a null role or text is empty; a row
without a conversation id belongs to none and is left out; repeated rows are turns like any other; the rest of a division
has the sign of the id; an empty table has no nodes. Only the four named columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.session import cut_lineage

BLOCK = 8192
GROUP, HEADS = 5, 9  # conversations of one branching group; a branch shares less than HEADS turns
DIGEST = 16

NOBODY = (1 << 63) - 1
EMPTY = hashlib.sha256(b"").hexdigest()
_PATH = ["n", "low", "children", "leaves", "saved"]
SCHEMA = (
    "kind int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, node binary, parent binary, "
    "key binary, sizes array<bigint>, " + ", ".join(f"{c} array<bigint>" for c in _PATH) + ", first bigint, piece string"
)
NODE, REST, PIECE = 0, 1, 2


def sequences(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per rebuilt conversation: conv_id, key (digests of its turns in a row), sizes (UTF-8 bytes of their texts).

    The first turns of a conversation come from the first one of its group: as many as its checksum says.
    """
    said, by = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said))
    turns = df.select(F.col(conv_id).cast("bigint").alias("conv_id"), F.struct(F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(said).cast("bigint").alias("size")).alias("t"))
    own = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    head_id = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("head_id"), F.slice("own", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    rows = own.withColumns({"head_id": head_id, "h": h}).join(heads, "head_id", "left")
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    rows = rows.select("conv_id", F.concat(F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), F.col("h")), rest).alias("turns"))
    return rows.select("conv_id", F.unhex(F.array_join(F.col("turns.digest"), "")).alias("key"), F.col("turns.size").alias("sizes"))


class Path(NamedTuple):
    """A sequence with, at each depth from 0 on, what its prefix has gathered: members, smallest id, finished children,
    and their leaves and savings. `conv_id` is that of a single conversation, whose members are itself."""

    key: bytes
    sizes: np.ndarray
    conv_id: int | None
    sums: list[np.ndarray] | None

    @property
    def depth(self) -> int:
        return len(self.key) // DIGEST


def shared(a: bytes, b: bytes) -> int:
    """Number of turns that two keys share at their beginning."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    if a[: high * DIGEST] == b[: high * DIGEST]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * DIGEST : mid * DIGEST] == b[low * DIGEST : mid * DIGEST]:
            low = mid
        else:
            high = mid - 1
    return low


class Tree(NamedTuple):
    """Branching nodes and ends of sequences: depth, children, first and last sequence below; the root is the last."""

    depth: list[int]
    below: list[list[int]]
    first: list[int]
    last: list[int]
    root: int


def joined(depths: list[int], common: list[int]) -> Tree:
    """Union-find over the edges between neighbours, the deepest first."""
    n = len(depths)
    tree = Tree(list(depths), [[] for _ in range(n)], list(range(n)), list(range(n)), 0)
    up, top = list(range(n)), list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def new(depth: int, below: list[int]) -> int:
        tree.depth.append(depth)
        tree.below.append(below)
        tree.first.append(tree.first[below[0]])
        tree.last.append(tree.last[below[-1]])
        return len(tree.depth) - 1

    for i in sorted(range(n - 1), key=lambda i: -common[i]):
        a, b, d = find(i), find(i + 1), common[i]
        x, y = top[a], top[b]
        if tree.depth[x] == d:
            if tree.depth[y] == d:
                tree.below[x].extend(tree.below[y])
            else:
                tree.below[x].append(y)
            tree.last[x] = tree.last[y]
        elif tree.depth[y] == d:
            tree.below[y].insert(0, x)
            tree.first[y], x = tree.first[x], y
        else:
            x = new(d, [x, y])
        up[b] = a
        top[a] = x
    root = top[find(0)]
    return tree._replace(root=root if tree.depth[root] == 0 else new(0, [root]))


def _digest(prefix: bytes) -> bytes:
    return hashlib.md5(prefix).digest()


class Rows:
    """Output rows, leaving as batches."""

    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
    kinds = [{"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}[c.strip().split(" ")[1]] for c in SCHEMA.split(",")]

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def add(self, **values: object) -> None:
        self.rows.append(values)

    def leave(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.rows and len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in self.rows], k) for n, k in zip(self.names, self.kinds, strict=True)], self.names)
            self.rows = []


def forest(paths: list[Path], whole: bool) -> Iterator[pa.RecordBatch]:
    """Finished nodes of neighbouring paths, and what is left of them: paths, and pieces of ids that end on them.

    `whole`: the paths are all there are, so every node is finished.
    """
    m, out = len(paths), Rows()
    tree = joined([p.depth for p in paths], [shared(a.key, b.key) for a, b in zip(paths, paths[1:], strict=False)])
    order = _below_first(tree)
    parent = {c: v for v in order for c in tree.below[v]}
    open_ = set() if whole else {v for v in order if tree.first[v] == 0 or tree.last[v] == m - 1}
    ends = {v: _ending(paths, tree, v) for v in order}
    sums: dict[int, list[np.ndarray]] = {}
    total: dict[int, tuple[int, int]] = {}  # leaves and savings of a finished node's uppermost prefix
    low: dict[int, int] = {}  # smallest id at the node itself
    for v in order:
        begin, end = (tree.depth[parent[v]] + 1 if v in parent else 0), tree.depth[v] + 1
        sums[v] = _summed(paths, tree, v, begin, end, ends[v], low)
        low[v] = int(sums[v][1][-1])
    for v in order:
        begin, end = (tree.depth[parent[v]] + 1 if v in parent else 0), tree.depth[v] + 1
        n, least, children, leaves, saved = sums[v]
        done = [c for c in tree.below[v] if c not in open_]
        children[-1] += len(done)
        leaves[-1] += sum(total[c][0] for c in done)
        saved[-1] += sum(total[c][1] for c in done)
        ids = [paths[i].conv_id for i in ends[v]]
        key = paths[tree.first[v]].key
        if v in open_:
            if ids and ids[0] is not None:
                out.add(kind=PIECE, node=_digest(key[: (end - 1) * DIGEST]), first=ids[0], piece=",".join(map(str, ids)))
            continue
        sizes = paths[tree.first[v]].sizes[begin - 1 : end - 1] if begin else np.zeros(1, np.int64)
        children[:-1] += 1
        leaves[-1] += children[-1] == 0
        leaves, saved = np.cumsum(leaves[::-1])[::-1], np.cumsum((saved + (n - 1) * sizes)[::-1])[::-1]
        total[v] = int(leaves[0]), int(saved[0])
        single = paths[tree.first[v]].sums is None
        for k, (c, u, a, b, s) in enumerate(zip(least.tolist(), n.tolist(), children.tolist(), leaves.tolist(), saved.tolist(), strict=True)):
            at = begin + k
            above = None if at == 0 else int(least[k - 1]) if k else low[parent[v]] if parent[v] not in open_ else None
            hidden = at > 0 and k == 0 and parent[v] in open_
            sha = (hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if ids and at == end - 1 else EMPTY) if single else None
            out.add(
                kind=NODE, conv_id=c, depth=at, parent_conv_id=above, n_convs=u, n_children=a, n_leaves=b, saved_tokens=s, ends=sha,
                node=None if single else _digest(key[: at * DIGEST]), parent=_digest(key[: (at - 1) * DIGEST]) if hidden else None,
            )
        yield from out.leave(20_000)
    for i in sorted({0, m - 1}) if open_ else []:
        gathered = [np.zeros(paths[i].depth + 1, np.int64) for _ in _PATH]
        gathered[1][:] = NOBODY
        for v in open_:
            if tree.first[v] <= i <= tree.last[v] and (i == 0 or tree.first[v] > 0):
                begin = tree.depth[parent[v]] + 1 if v in parent else 0
                for whole_path, part in zip(gathered, sums[v], strict=True):
                    whole_path[begin : begin + len(part)] = part
        if i == 0 or gathered[0].any() or gathered[2].any():
            out.add(kind=REST, key=paths[i].key, sizes=paths[i].sizes, **dict(zip(_PATH, gathered, strict=True)))
    yield from out.leave(1)


def _below_first(tree: Tree) -> list[int]:
    """Nodes of the tree, children before their parents."""
    found, ahead = [], [tree.root]
    while ahead:
        v = ahead.pop()
        found.append(v)
        ahead += tree.below[v]
    return found[::-1]


def _ending(paths: list[Path], tree: Tree, v: int) -> list[int]:
    """Single conversations that end at the node: they come first among those below it."""
    i = stop = tree.first[v]
    while stop <= tree.last[v] and paths[stop].depth == tree.depth[v] and paths[stop].sums is None:
        stop += 1
    return list(range(i, stop))


def _summed(paths: list[Path], tree: Tree, v: int, begin: int, end: int, ending: list[int], low: dict[int, int]) -> list[np.ndarray]:
    """Sums of the paths below a node for its prefixes of `begin` to `end` - 1 turns."""
    own = range(tree.first[v], tree.last[v] + 1)
    if paths[own[0]].sums is None:
        least = min([*(paths[i].conv_id for i in ending), *(low[c] for c in tree.below[v])])
        n = np.full(end - begin, len(own), np.int64)
        return [n, np.full_like(n, least), *(np.zeros_like(n) for _ in range(3))]
    parts = [[paths[i].sums[k][begin:end] for i in own] for k in range(len(_PATH))]
    return [reduce(np.minimum if k == 1 else np.add, p).copy() for k, p in enumerate(parts)]


def _blocks(size: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Path] = []
        for batch in batches:
            single = "conv_id" in batch.schema.names
            sums = None if single else [batch.column(c) for c in _PATH]
            for k in range(batch.num_rows):
                sizes = batch.column("sizes")[k].values.to_numpy(zero_copy_only=False)
                held.append(Path(batch.column("key")[k].as_py(), sizes, batch.column("conv_id")[k].as_py() if single else None, None if sums is None else [c[k].values.to_numpy(zero_copy_only=False) for c in sums]))
                if len(held) == size and not whole:
                    yield from forest(held, whole)
                    held = []
        if held:
            yield from forest(held, whole)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the pieces of each node, which come in order."""
    node, sha = None, hashlib.sha256()
    for batch in batches:
        done = []
        for key, piece in zip(batch.column("node").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if key == node:
                sha.update(b",")
            else:
                if node is not None:
                    done.append((node, sha.hexdigest()))
                node, sha = key, hashlib.sha256()
            sha.update(piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["node", "sha"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["node", "sha"])


def ends_of(pieces: DataFrame) -> DataFrame:
    """(node, sha) of the ids that end at each node, from their pieces in ascending order."""
    rows = pieces.select("node", "first", "piece").repartition("node").sortWithinPartitions("node", "first")
    return rows.select("node", "piece").mapInArrow(_hashed, "node binary, sha string")


def prefix_trie(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per distinct prefix of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (bytes saved below and at it by keeping each prefix once), ends_sha256."""
    if block < 8:
        raise ValueError("a block leaves two paths: it needs eight at least to shrink its input")
    rows = sequences(df, conv_id, turn, role, text).repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    rounds = [cut_lineage(rows.select("key", "sizes", "conv_id").mapInArrow(_blocks(block, False), SCHEMA))]
    while True:
        rest = rounds[-1].where(f"kind = {REST}").select("key", "sizes", *_PATH)
        n = rest.count()
        if n <= block:
            rounds.append(cut_lineage(rest.coalesce(1).sortWithinPartitions("key").mapInArrow(_blocks(block, True), SCHEMA)))
            break
        rounds.append(cut_lineage(rest.repartitionByRange(math.ceil(n / block), "key").sortWithinPartitions("key").mapInArrow(_blocks(block, False), SCHEMA)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    nodes = [r.where(f"kind = {NODE}") for r in rounds]
    late = reduce(DataFrame.union, nodes[1:])
    sha = ends_of(rounds[0].where(f"kind = {PIECE}"))
    late = cut_lineage(late.drop("ends").join(sha, "node", "left").select(*columns, F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"), "node", "parent"))
    early = nodes[0].select(*columns, F.col("ends").alias("ends_sha256"), "node", "parent")
    every, named = early.unionByName(late), late.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    hidden = every.where("parent is not null").join(named, "parent").withColumn("parent_conv_id", F.col("above"))
    return every.where("parent is null").select(*columns, "ends_sha256").unionByName(hidden.select(*columns, "ends_sha256"))
