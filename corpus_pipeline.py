"""The corpus pipeline: quality rules, near duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. `run` writes every stage's rows as
Parquet to the shared folder and reads them back, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import bpe, decontamination, near_dups, pii, quality
from aerolith.llm.base import row_key, table
from aerolith.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PERCENT = 80  # similarity of near duplicates on shingles of five words


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the policy keeps."""
    return quality.apply_policy(quality.ledger(docs.select(*COLUMNS))).where("kept").select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key of id and text in 128 bits, never null: ids may be null or repeated with other texts."""
    return docs.select(*COLUMNS).withColumn("row_key", row_key())


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (0.8); a null id is a group of its own; of rows
    with one id and text, one.

    The classes need whole numbers, 64 bits of the key. Rows that share these but not the key are never compared: they
    stay.
    """
    rows = keyed(docs).withColumn("row_id", F.conv(F.substring(F.hex("row_key"), 1, 15), 16, 10).cast("bigint"))
    named = rows.where("doc_id is not null")
    ids = named.groupBy("row_id").agg(F.min("doc_id").alias("doc_id"), (F.min("row_key") != F.max("row_key")).alias("clash"))
    groups = near_dups.near_duplicates(named, doc_id="row_id", percent=PERCENT).select(F.col("doc_id").alias("row_id"), "component_id").distinct()
    members = cut_lineage(ids.join(groups, "row_id"))
    first = members.where("not clash").groupBy("component_id").agg(F.min(F.struct("doc_id", "row_id")).alias("first")).select("first.row_id")
    stay = first.union(members.where("clash").select("row_id"))
    kept = named.join(stay.hint("shuffle_hash"), "row_id", "left_semi").unionByName(rows.where("doc_id is null"))
    return kept.dropDuplicates(["row_key"]).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    hit = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("key").alias("row_key"))
    return keyed(docs).join(hit.hint("shuffle_hash"), "row_key", "left_anti").select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind; n_chars is that of the new text."""
    # repeated rows have equal spans
    spans = pii.personal_data(docs).where(F.size("spans") > 0).select(F.col("key").alias("row_key"), "spans").dropDuplicates(["row_key"])
    rows = keyed(docs).join(spans.hint("shuffle_hash"), "row_key", "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(pii.redacted(F.col("text"), F.col("spans")))
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, their number, and the digest of the text decoded from them."""
    rows = bpe.round_trip(docs)
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("tokens", tokens),
]

# Similarity classes and tokens are beyond SQL here; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        rows = cut_lineage(stage(spark, rows, sf_dir))
    return rows
