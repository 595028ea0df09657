"""The trie of rebuilt conversations against a plain one."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.llm import prefix_trie as pt


def rebuilt(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            digest = hashlib.md5(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest()
            own.setdefault(c, []).append(((t is not None, t or 0, digest), (r or "", x or "")))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        head = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = tuple(own.get(head, [])[:h] + turns[h:])
    return out


def plainly(rows):
    members, exact = {}, {}
    for c, seq in rebuilt(rows).items():
        exact.setdefault(seq, []).append(c)
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    below, children = {p: [] for p in members}, dict.fromkeys(members, 0)
    for p in members:
        if p:
            children[p[:-1]] += 1
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    out = []
    for p, m in members.items():
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below[p] if q)
        ids = ",".join(map(str, sorted(exact.get(p, []))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], sum(children[q] == 0 for q in below[p]), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(map(repr, out))


def chats(seed):
    rng = random.Random(seed)
    rows = [(None, 0, "user", "lost"), (7000, None, "user", "é"), (7000, 0, None, None), (7000, 0, "user", "tie"), (7000, 0, "user", "tie"), (-3, 0, "user", "x"), (-3, 1, "user", "y")]
    for c in range(200):
        n = rng.choice([1, 1, 2, 3, 5, 9, 12])
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["a", "b", "éé"]) if rng.random() < 0.9 else "z" * rng.randrange(50)) for t in range(n)]
    rows += [(c, t, "user", f"same {t}") for c in range(3000, 3060) for t in range(11)]  # many equal ones
    rows += [(4000, t, "user", str(t % 7)) for t in range(300)] + [(4001, t, "user", str(t % 7)) for t in range(300)]  # long ones
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,seed", [(8192, 1), (20, 2)])
def test_trie(spark, block, seed):
    rows = chats(seed)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("key", F.lit(1)).repartition(4)
    got = pt.prefix_trie(df, block=block)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(repr(tuple(r)) for r in got.select(columns).collect()) == plainly(rows)


@pytest.mark.parametrize("block", [2, 3, 50])
def test_rounds_of_blocks(block):
    """The same on plain lists, cut into blocks of any size, round by round."""
    rows = chats(block)
    seqs = sorted((b"".join(hashlib.md5(repr(t).encode()).digest() for t in s), c, [len(t[1].encode()) for t in s]) for c, s in rebuilt(rows).items())
    paths, nodes = [pt.Path(k, np.array(z, np.int64), c, None) for k, c, z in seqs], 0
    for _ in range(50):
        whole, rest = len(paths) <= block, []
        for k in range(0, len(paths), block):
            for batch in pt.forest(paths[k : k + block], whole):
                for r in batch.to_pylist():
                    nodes += r["kind"] == pt.NODE
                    if r["kind"] == pt.REST:
                        rest.append(pt.Path(r["key"], np.array(r["sizes"], np.int64), None, [np.array(r[c], np.int64) for c in pt._PATH]))
        if whole:
            break
        if len(rest) >= len(paths):  # blocks of two keep both of their paths
            block *= 2
        paths = rest
    assert nodes == len(plainly(rows))


def test_empty(spark):
    assert pt.prefix_trie(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
