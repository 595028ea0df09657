"""Repeated passages against windows compared one by one."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.llm import substring_dedup as sd


def plainly(rows, width):
    """(n_words, kept words) by the definition."""
    words = [(i, (t or "").split(" ") if t and t.strip() else []) for i, t in rows]
    words = [(i, [x for x in w if x]) for i, w in words]
    first = {}
    for i, w in words:
        for p in range(len(w) - width + 1):
            if i is not None:
                first[tuple(w[p : p + width])] = min(i, first.get(tuple(w[p : p + width]), i))
    out = []
    for i, w in words:
        gone = {q for p in range(len(w) - width + 1) if i is not None and first[tuple(w[p : p + width])] < i for q in range(p, p + width)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def corpus(width, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(40)}"
    passages = [[word() for _ in range(rng.randrange(max(1, width - 2), 3 * width))] for _ in range(6)]
    rows = [(None, " ".join(passages[0])), (40, None), (41, ""), (42, "  "), (43, "alone")]
    for i in range(80):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts += [word() for _ in range(rng.randrange(0, width))]
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            parts += rng.choice([p, p, p[cut:], p[:cut], p * 2])
        rows.append((100 + i, " ".join(parts)))
    rows += [(i + 500, t) for i, t in rows[6:12]] + [rows[8], (103, rows[20][1]), (104, " ".join(passages[1]) + " x"), (-1, " ".join(passages[2] + passages[3]))]
    rows += [(900, " ".join(word() for _ in range(30_000)) + " " + " ".join(passages[4])), (901, "x " * 3000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,seed", [(50, 1), (50, 2), (9, 3), (2, 4)])
def test_repeats(spark, width, seed):
    rows = corpus(width, seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).withColumn("rep", F.lit(1)).withColumn("key", F.lit("x"))
    got = [tuple(r) for r in sd.without_repeats(df, window=width).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plainly(rows, width)))


def test_covers():
    for period, cover in sd.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert sd.period_of(50) == 31
    places = sd.cover_places(1000, 31)
    for a in range(0, 62):
        for b in range(0, 62):  # any two windows share an aligned place
            assert np.intersect1d(places[(places >= a) & (places < a + 31)] - a, places[(places >= b) & (places < b + 31)] - b).size


def test_empty(spark):
    assert sd.without_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
