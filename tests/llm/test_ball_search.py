"""Ranked search against plain scoring of every pair."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.llm import ball_search as bs

LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plainly(docs, items, top=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    N, L = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            if b:
                m = 100 - 25 + (25 * b.total() * N) // L
                s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 12 * m)) for t in terms(text) if t in b)
                scores += [(-s, i is None, i)] if s > 0 else []
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(map(repr, out))


def corpus(seed):
    rng = random.Random(seed)
    words = [f"t{k}" for k in range(200)] + ["Été", "ß", "日本"]
    text = lambda n: rng.choice([" ", ", ", "_"]).join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=n))
    docs = [(None, "t1 t2 t3 " + text(5)), (1, None), (2, ""), (3, "... --"), (4, "T1 t1 t1"), (5, text(20_000))]
    docs += [(10 + k, text(rng.randrange(1, 60))) for k in range(600)]
    docs += [(2000 + k, docs[20][1]) for k in range(90)] + [docs[30], docs[30], (-7, docs[40][1])]  # ties
    items = [(k, text(rng.randrange(1, 30))) for k in range(25)] + [(90, None), (91, "!"), (92, "unknown"), (93, docs[20][1]), (93, docs[20][1]), (None, "t1 t5")]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("cells,seed", [(1 << 22, 1), (900, 2)])
def test_search(spark, cells, seed):
    docs, items = corpus(seed)
    left = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).withColumn("score", F.lit(1))
    got = bs.search(left, spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit(0)), cells=cells)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["item_id"] == "bigint"
    assert sorted(repr(tuple(r)) for r in got.collect()) == plainly(docs, items)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    terms_n, docs = 300, 3000
    kinds = rng.integers(0, 6, docs)  # six vocabularies that hardly meet
    lists = [np.unique(np.where(rng.random(20) < 0.95, k * 50 + rng.integers(0, 50, 20), rng.integers(0, terms_n, 20))) for k in kinds]
    sizes = np.array([len(x) for x in lists])
    rows = bs.Rows(np.arange(docs), np.cumsum(sizes) - sizes, np.concatenate(lists).astype(np.int32), rng.integers(1, 10**9, sizes.sum()))
    tree = bs.Tree(rows, terms_n)
    queries = np.zeros((40, terms_n), np.int64)
    for k in range(40):
        queries[k, lists[k][:12]] = 1 + k % 3
    bounds, leaves = tree.bounds(queries.astype(float)), sum(x is not None for x in tree.leaves)
    assert sum(len(x.ids) for x in tree.leaves if x is not None) == docs
    scored = 0
    for k in range(40):
        scores = rows.sums(queries[k])
        for ball, leaf in enumerate(tree.leaves):
            if leaf is not None:
                assert leaf.sums(queries[k]).max() <= bounds[k][ball] <= bounds[k][0]
        best = bs.Best(5)
        scored += bs.walk(tree, bounds[k], queries[k], best)
        assert best.scores.tolist() == sorted(scores.tolist(), reverse=True)[:5]
    assert scored < 0.5 * 40 * leaves


def test_empty(spark):
    none, some = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert bs.search(none, some).count() == 0
    assert bs.search(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), some.where("false")).count() == 0
    assert [tuple(r) for r in bs.search(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), some).collect()] == [(1, 1, 1, 287 * (10**9 // 2200))]
