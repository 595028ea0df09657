"""Nested property trees as path / value rows, and what is derived from them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from ..functions.geo import col

# Keys that are not aeronautical data.
SKIPPED = {"_t", "_na", "timeSliceMetadata", "featureMetadata"}


def _scalar(v):
    """Text of a leaf, or None for a branch: references as arrow + id, measures as 'value unit', nil with its reason."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if not isinstance(v, (dict, list)):
        return str(v)
    if isinstance(v, dict):
        if "ref" in v:
            return "→" + str(v["ref"])
        if "nil" in v:
            return f"NIL({v['nil']})"
        if "v" in v:
            return str(v["v"]) + (f" {v['u']}" if v.get("u") else "")
    return None


def _leaves(tree: dict, prefix: str = "") -> dict[str, str]:
    out: dict[str, str] = {}
    for key, value in tree.items():
        if key in SKIPPED:
            continue
        path = f"{prefix}/{key}" if prefix else key
        if isinstance(value, list):
            items = []
            for x in value:
                text = _scalar(x)
                items.append({"": text} if text is not None else _leaves(x) if isinstance(x, dict) else {"": json.dumps(x)})
            # the order of repeated elements is not significant: they are numbered in the order of their content
            items.sort(key=lambda o: json.dumps(o, ensure_ascii=False, separators=(",", ":")))
            for i, item in enumerate(items, 1):
                for q, text in item.items():
                    out[f"{path}[{i}]/{q}" if q else f"{path}[{i}]"] = text
            continue
        text = _scalar(value)
        if text is not None:
            out[path] = text
        else:
            out.update(_leaves(value, path))
    return out


@F.pandas_udf(MapType(StringType(), StringType()))
def flat_map(tree: pd.Series) -> pd.Series:
    """MAP of path to value text of a JSON object text."""
    return tree.map(lambda t: _leaves(json.loads(t)) if t else {})


def flatten(df: DataFrame, tree: str, keep: list[str]) -> DataFrame:
    """One row per leaf: the kept columns, ``path`` and ``value``."""
    return df.select(*keep, F.explode(flat_map(col(tree))).alias("path", "value"))


def fingerprint(paths: Column) -> Column:
    """Order-independent hash of a MAP of path to value."""
    entries = F.array_sort(F.transform(F.map_entries(paths), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return F.md5(F.array_join(entries, "\n"))


def references(flat: DataFrame, value: str = "value", path: str = "path") -> DataFrame:
    """Rows of a flattened table that are references: ``prop`` (top level) and ``ref`` (normalised id)."""
    v = F.col(value)
    raw = F.regexp_replace(v, "^→", "")
    ref = F.regexp_replace(raw, r"^urn:uuid[.:]", "")
    return (
        flat.filter(v.startswith("→"))
        .withColumn("prop", F.regexp_extract(path, r"^([^/\[]+)", 1))
        .withColumn("ref", ref)
    )


def changed_paths(old: Column, new: Column) -> Column:
    """ARRAY<STRUCT<path, old, new>> of the paths whose text differs between two MAPs, ordered by path."""
    a = F.coalesce(old, F.create_map().cast("map<string,string>"))
    b = F.coalesce(new, F.create_map().cast("map<string,string>"))
    paths = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    differing = F.filter(paths, lambda p: ~F.try_element_at(a, p).eqNullSafe(F.try_element_at(b, p)))
    return F.transform(
        differing,
        lambda p: F.struct(p.alias("path"), F.try_element_at(a, p).alias("old"), F.try_element_at(b, p).alias("new")),
    )


def pretty_path(path) -> Column:
    """Readable change path: indexes as #n, camel case split, levels joined by a chevron."""
    p = F.regexp_replace(col(path), r"\[(\d+)\]", " #$1")
    p = F.regexp_replace(F.regexp_replace(p, r"(^|/)_", "$1"), r"([a-z])([A-Z])", "$1 $2")
    return F.regexp_replace(F.regexp_replace(p, "_", " "), "/", " › ")


def completeness(features: DataFrame, values: DataFrame, dim_property: DataFrame, keys: list[str]) -> DataFrame:
    """Per type and property of the dictionary: given, unknown (nil with a reason), not applicable, absent.

    ``features``: keys + feature_type; ``values``: keys + feature_type, prop, nil_reason, not_applicable;
    ``dim_property``: feature_type, prop. Each (feature, property) counts once, the strongest state wins.
    """
    counts = features.groupBy("feature_type").agg(F.count(F.lit(1)).alias("n_features"))
    rank = F.when(F.col("not_applicable"), 1).when(F.col("nil_reason").isNotNull(), 2).otherwise(3)
    per = (
        values.groupBy(*keys, "feature_type", "prop").agg(F.max(rank).alias("_s"))
        .groupBy("feature_type", "prop").agg(
            F.count_if(F.col("_s") == 3).alias("n_given"),
            F.count_if(F.col("_s") == 2).alias("n_unknown"),
            F.count_if(F.col("_s") == 1).alias("n_not_applicable"),
        )
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        dim_property.join(counts, "feature_type").join(per, ["feature_type", "prop"], "left")
        .select("feature_type", "prop", "n_features", zero("n_given"), zero("n_unknown"), zero("n_not_applicable"))
        .withColumn("n_absent", F.col("n_features") - F.col("n_given") - F.col("n_unknown") - F.col("n_not_applicable"))
        .withColumn("always_given", F.col("n_given") == F.col("n_features"))
        .withColumn("never_given", F.col("n_given") == 0)
    )
