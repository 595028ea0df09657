"""The pipeline's stages against plain rules over the given documents."""

from __future__ import annotations

import re

import corpus_pipeline
from aerolith.llm import pii
from tests.llm.test_operators import components


def test_stages(spark, sf):
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in rows.select("doc_id", "text").collect()}
        rows = corpus_pipeline.cut_lineage(stage(spark, rows, sf))
        if name != "tokens":
            assert rows.columns == corpus_pipeline.COLUMNS
        kept.append({r.doc_id for r in rows.collect()})
        if name == "near_duplicates":
            ids = sorted(before)
            assert kept[-1] == {ids[t] for t in components([before[i] for i in ids], 80)[1]}
        if name == "personal_data":
            assert kept[-1] == set(before)
            assert not [r for r in rows.collect() if re.search(r"[a-z]@[a-z0-9-]+\.[a-z]", r.text)]
    assert kept[0] < set(documents) and kept[1] <= kept[0] and kept[2] <= kept[1] and kept[3] == kept[4] == kept[2]
    assert pii.KINDS[0] == "email"
