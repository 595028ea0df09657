"""Relation records of version 4.5 data sets: which feature a nested composite key means.

A reference names its target by the target's own key, nested inside the record: a runway direction holds the key of its
runway, which holds that of its aerodrome. A key is the set of its (path, value) pairs. References may leave parts out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 5  # keys nest four deep at most in the schema
_PAIRS = "array<string>"


def key_pairs(uid: Column, levels: int = LEVELS) -> Column:
    """Sorted path=value texts of a nested key given as JSON; record numbers (``mid``) and empty values do not count."""

    def pairs(text: Column, prefix: Column, left: int) -> Column:
        entries = F.map_entries(F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>")))

        def one(e: Column) -> Column:
            path = F.concat(prefix, e["key"])
            plain = F.array(F.concat(path, F.lit("="), e["value"]))
            leaf = F.when(F.coalesce(e["value"], F.lit("")) == "", F.array().cast(_PAIRS)).otherwise(plain)
            if left > 1:
                leaf = F.when(F.startswith(e["value"], F.lit("{")), pairs(e["value"], F.concat(path, F.lit(".")), left - 1)).otherwise(leaf)
            return F.when(e["key"].isin("mid", "_mid"), F.array().cast(_PAIRS)).otherwise(leaf)

        return F.flatten(F.transform(entries, one))

    return F.array_sort(F.coalesce(pairs(uid, F.lit(""), levels), F.array().cast(_PAIRS)))


def link_45(refs: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links: src_id, role, feature_id, match; problems: src_id, role, tag, uid, problem, n).

    ``features``: feature_id, tag, uid (JSON of the own key); ``refs``: src_id, role, tag, uid (JSON of the nested key). An
    equal key is an ``exact`` match; else the one feature that holds all pairs of the reference is a ``subset`` match.
    Several such features make the reference ``ambiguous``, none leaves it ``unresolved``, an empty key is ``empty``.

    Equal keys are looked up once. Of a partial key only its rarest pair is joined, and the features found by it are
    held against all pairs: a value that a third of all features share is never joined where the key has a rarer one.
    """
    own = features.select("feature_id", "tag", key_pairs(F.col("uid")).alias("pairs"))
    asked = refs.select("src_id", "role", "tag", "uid", key_pairs(F.col("uid")).alias("pairs"))
    keys = asked.where(F.size("pairs") > 0).select("tag", "pairs").distinct()
    exact = keys.join(own.groupBy("tag", "pairs").agg(F.min("feature_id").alias("feature_id"), F.count_distinct("feature_id").alias("n")), ["tag", "pairs"])
    rest = keys.join(exact.select("tag", "pairs"), ["tag", "pairs"], "left_anti")
    each = own.select("tag", "feature_id", "pairs", F.explode("pairs").alias("pair"))
    wanted = rest.select("tag", "pairs", F.explode("pairs").alias("pair"))
    seen = each.join(wanted.select("tag", "pair").distinct(), ["tag", "pair"], "left_semi").groupBy("tag", "pair").agg(F.count(F.lit(1)).alias("n"))
    rated = wanted.join(seen, ["tag", "pair"], "left").groupBy("tag", "pairs").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pair")).alias("rarest"))
    first = rated.where("rarest.n > 0").select("tag", F.col("pairs").alias("asked"), F.col("rarest.pair").alias("pair"))
    held = first.join(each, ["tag", "pair"]).where(F.size(F.array_except("asked", "pairs")) == 0)
    subset = held.groupBy("tag", F.col("asked").alias("pairs")).agg(F.min("feature_id").alias("feature_id"), F.count_distinct("feature_id").alias("n"))
    answers = exact.withColumn("match", F.lit("exact")).unionByName(subset.withColumn("match", F.lit("subset")))
    out = asked.join(answers, ["tag", "pairs"], "left")
    links = out.where("n = 1").select("src_id", "role", "feature_id", "match")
    problem = F.when(F.size("pairs") == 0, "empty").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return links, out.where("n is null or n > 1").select("src_id", "role", "tag", "uid", problem.alias("problem"), F.coalesce("n", F.lit(0)).alias("n"))


# Relation records of the schema: tag -> (path of the target's key, tag of the target, what the record is to it).
RELATIONS = {
    "Aha": (("AhaUid.AhpUid", "Ahp", "contact"),), "Ahu": (("AhuUid.AhpUid", "Ahp", "usage"),), "Abd": (("AbdUid.AseUid", "Ase", "border"),),
    "Sae": (("SaeUid.SerUid", "Ser", "service"), ("SaeUid.AseUid", "Ase", "client airspace")),
}


def relation_refs(records: DataFrame) -> DataFrame:
    """References of relation records: src_id, role, tag, uid. ``records``: record_id, tag, json (the whole record)."""
    found = []
    for tag, targets in RELATIONS.items():
        for path, target, role in targets:
            found.append(F.when(F.col("tag") == tag, F.struct(F.lit(role).alias("role"), F.lit(target).alias("tag"), F.get_json_object("json", f"$.{path}").alias("uid"))))
    return records.select(F.col("record_id").alias("src_id"), F.explode(F.array_compact(F.array(*found))).alias("r")).select("src_id", "r.*")


def attached(links: DataFrame, records: DataFrame) -> DataFrame:
    """Per feature and role the records that belong to it: feature_id, role, records (record_id, json in order)."""
    rows = links.join(records.select(F.col("record_id").alias("src_id"), "json"), "src_id")
    return rows.groupBy("feature_id", "role").agg(F.sort_array(F.collect_list(F.struct(F.col("src_id").alias("record_id"), "json"))).alias("records"))
