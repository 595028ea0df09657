"""Two deliveries of the same data: matching, differences, cycle reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import cycle_id, cycle_start, publication_date
from ..functions.geo import col
from .flatten import changed_paths
from .ordered import OrderedScan

KEY_SHARE = 0.3


def identifier_match_share(a: DataFrame, b: DataFrame, key: str = "feature_id") -> DataFrame:
    """Share of the ids of ``a`` that ``b`` also has (one row); above 0.3 the deliveries are matched by id."""
    hit = a.select(key).join(b.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return hit.agg((F.count("_hit") / F.count(F.lit(1))).alias("share"))


def keyed_by(features: DataFrame, by_id: bool, natural_key: str = "natural_key", type_: str = "feature_type", id_: str = "feature_id",
             order: Sequence[str] = ("position",)) -> DataFrame:
    """Adds ``cmp_key``: type and id, or the natural key with repeats numbered ~2, ~3 in file order."""
    base = F.concat_ws("#", type_, id_) if by_id else F.col(natural_key)
    keyed = features.withColumn("_base", base)
    scan = OrderedScan(["_base"], [F.col(o) for o in order], F.floor(F.col(order[0]) / 100000))
    n = scan.row_number(keyed, "_nth")
    return n.withColumn("cmp_key", F.when(F.col("_nth") > 1, F.concat_ws("~", "_base", F.col("_nth").cast("string"))).otherwise(F.col("_base"))).drop("_base", "_nth")


def compare(a: DataFrame, b: DataFrame, keys: Sequence[str], props: str = "props", keep: Sequence[str] = ()) -> DataFrame:
    """Features of two deliveries matched by key: keys, kind (added, removed, modified, unchanged), fields.

    ``props`` is a MAP of path to value text on both sides; ``fields`` lists the changed paths with old and new value.
    """
    left = a.select(*keys, F.col(props).alias("_a"), *[F.col(k).alias(f"_a_{k}") for k in keep], F.lit(True).alias("_in_a"))
    right = b.select(*keys, F.col(props).alias("_b"), *[F.col(k).alias(f"_b_{k}") for k in keep], F.lit(True).alias("_in_b"))
    both = left.join(right, list(keys), "full_outer")
    fields = F.when(F.col("_in_a") & F.col("_in_b"), changed_paths(F.col("_a"), F.col("_b")))
    kind = (
        F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed")
        .when(F.size("fields") > 0, "modified").otherwise("unchanged")
    )
    kept = [F.coalesce(f"_b_{k}", f"_a_{k}").alias(k) for k in keep]
    return both.withColumn("fields", fields).select(*keys, kind.alias("kind"), "fields", *kept)


def compare_fields(result: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per changed path of the modified features: keys, path, old, new, change."""
    f = F.col("_f")
    change = F.when(f["old"].isNull(), "INSERT").when(f["new"].isNull(), "DELETE").otherwise("AMEND")
    return result.filter(F.col("kind") == "modified").select(*keys, F.explode("fields").alias("_f")).select(
        *keys, f["path"].alias("path"), f["old"].alias("old"), f["new"].alias("new"), change.alias("change")
    )


def compare_stats(result: DataFrame) -> DataFrame:
    return result.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def change_file(result: DataFrame, a: DataFrame, b: DataFrame, keys: Sequence[str], end_at) -> DataFrame:
    """Rows of a difference delivery: added and modified features as in the new data, removed ones with an end date."""
    fresh = result.filter(F.col("kind").isin("added", "modified")).select(*keys, "kind").join(b, list(keys))
    gone = result.filter(F.col("kind") == "removed").select(*keys, "kind").join(a, list(keys))
    end = F.lit(end_at).cast("timestamp")
    return fresh.withColumn("ends", F.lit(None).cast("timestamp")).unionByName(gone.withColumn("ends", end))


def crc_verify(items: DataFrame, delivered: DataFrame, keys: Sequence[str], crc: str = "crc") -> DataFrame:
    """Delivered check sums against current ones: keys and status same, changed, added or missing."""
    left = items.select(*keys, F.col(crc).alias("_now"), F.lit(True).alias("_cur"))
    right = delivered.select(*keys, F.col(crc).alias("_then"), F.lit(True).alias("_del"))
    status = (
        F.when(F.col("_del").isNull(), "added").when(F.col("_cur").isNull(), "missing")
        .when(F.upper("_now") == F.upper("_then"), "same").otherwise("changed")
    )
    return left.join(right, list(keys), "full_outer").select(*keys, status.alias("status"))


def side_by_side(left: DataFrame, right: DataFrame, keys: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """Rows of two table versions matched by key: keys, status (chg, add, del, same), changed column names."""
    a = left.select(*keys, F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cells]).alias("_l"))
    b = right.select(*keys, F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cells]).alias("_r"))
    both = a.join(b, list(keys), "full_outer")
    differs = [F.when(F.col("_l")[c] != F.col("_r")[c], F.lit(c)) for c in cells]
    changed = F.filter(F.array(*differs), lambda x: x.isNotNull())
    status = (
        F.when(F.col("_l").isNull(), "add").when(F.col("_r").isNull(), "del").when(F.size("_ch") > 0, "chg").otherwise("same")
    )
    return both.withColumn("_ch", changed).select(*keys, status.alias("status"), F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.array_join("_ch", ",")).alias("changed"))


# ---------------------------------------------------------------- cycles

def part_of(section) -> Column:
    s = col(section)
    return F.when(s.startswith("GEN"), "GEN").when(s.startswith("ENR"), "ENR").when(s.startswith("AD"), "AD").otherwise("Other")


def cycle_counts(changes: DataFrame, at: str = "from", section: str = "section", temporary: str = "temporary") -> DataFrame:
    """Changes per 28-day cycle, part and kind; cycles without changes in between are filled."""
    dated = changes.filter(F.col(at).isNotNull())
    p = part_of(section)
    counted = dated.groupBy(cycle_start(at).alias("start")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(p == part).alias(f"n_{part.lower()}") for part in ("GEN", "ENR", "AD", "Other")],
        F.count_if(F.col(temporary)).alias("n_temporary"), F.count_if(~F.col(temporary)).alias("n_permanent"),
    )
    bounds = counted.agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    calendar = bounds.filter("lo is not null").select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 28 DAYS"))).alias("start"))
    starts = calendar.unionByName(counted.select("start")).distinct()
    numbers = [c for c in counted.columns if c.startswith("n")]
    return starts.join(counted, "start", "left").select(
        cycle_id("start").alias("cycle"), F.col("start").cast("date").alias("start"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers]
    )


def section_counts(changes: DataFrame, section: str = "section", ad: str = "ad_id") -> DataFrame:
    """Changed features per section, per aerodrome and per group (first three letters) in one pass."""
    base = changes.select(F.col(section).alias("section"), F.col(ad).alias("ad"), F.substring(section, 1, 3).alias("grp"))
    out = base.groupingSets([["section"], ["ad"], ["grp"]], "section", "ad", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g")
    )
    kind = F.when(F.col("_g") == 3, "section").when(F.col("_g") == 5, "aerodrome").otherwise("group")
    return out.withColumn("level", kind).filter((F.col("level") != "aerodrome") | F.col("ad").isNotNull()).select(
        "level", F.coalesce(F.col("section"), F.col("ad").cast("string"), F.col("grp")).alias("name"), "n"
    )


def cycle_changes(changes: DataFrame, compared: DataFrame, start, next_start, keys: Sequence[str]) -> DataFrame:
    """What changes in one cycle: keys, added, n_fields, from_slices, from_compare.

    ``changes`` (in-file): keys, kind, from, n_fields, same; ``compared``: keys, kind, n_fields. Re-issues without a
    changed value are left out, and so are amended baselines the comparison shows unchanged.
    """
    window = (F.col("from") >= F.lit(start).cast("timestamp")) & (F.col("from") < F.lit(next_start).cast("timestamp"))
    in_file = (
        changes.filter(window & ~F.col("same")).groupBy(*keys).agg(
            F.sum("n_fields").alias("n_slice_fields"),
            F.bool_or(F.col("kind") == "New feature").alias("_new"),
            F.bool_and(F.col("kind") == "Amended (new baseline)").alias("_amended"),
            F.count(F.lit(1)).alias("n_slices"),
        )
    )
    cmp_ = compared.filter(F.col("kind").isin("added", "modified")).select(*keys, F.col("kind").alias("_k"), F.col("n_fields").alias("n_compare_fields"))
    both = in_file.join(cmp_, list(keys), "full_outer")
    keep = ~(F.coalesce("_amended", F.lit(False)) & F.col("_k").isNull())
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    added = (F.coalesce("_new", F.lit(False)) | (F.coalesce("_k", F.lit("")) == "added")).alias("added")
    return both.filter(keep).select(*keys, added, n("n_slices"), n("n_slice_fields"), n("n_compare_fields"))


def amendment_report(fields: DataFrame, whole: DataFrame, effective, section: str = "section") -> DataFrame:
    """Insert / amend / delete / new / withdrawn rows per section, with effective and publication date.

    ``fields``: section, change; ``whole``: section, kind (added, removed).
    """
    eff = F.lit(effective).cast("date")
    lines = fields.select(section, F.col("change").alias("action")).unionByName(
        whole.select(section, F.when(F.col("kind") == "added", "NEW").otherwise("WITHDRAWN").alias("action"))
    )
    actions = ["INSERT", "AMEND", "DELETE", "NEW", "WITHDRAWN"]
    return lines.groupBy(section).agg(*[F.count_if(F.col("action") == a).alias(f"n_{a.lower()}") for a in actions]).withColumns(
        {"effective": eff, "published": publication_date(eff)}
    )


def filter_changes(changes: DataFrame, kind: str | None = None, when: str | None = None, now=None, words: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Change list filtered by kind, by future or past start, and by words that must all occur."""
    out = changes
    if kind:
        out = out.filter(F.col("kind") == kind)
    if when:
        moment = F.lit(now).cast("timestamp")
        out = out.filter(F.col("from") > moment if when == "future" else F.col("from") <= moment)
    for w in words:
        out = out.filter(F.lower(text).contains(w.lower()))
    return out


def severity_rank(severity) -> Column:
    s = col(severity)
    return F.when(s == "error", 0).when(s == "warning", 1).when(s == "caution", 2).when(s == "info", 3).otherwise(4)


def worst_first(findings: DataFrame, amount: str = "n") -> DataFrame:
    """Errors first, then warnings and notes; the largest count or amount first inside each."""
    return findings.orderBy(severity_rank("severity"), F.col(amount).desc_nulls_last())


def issue_summary(issues: DataFrame, levels: Sequence[str] = ("severity", "rule")) -> DataFrame:
    """Counts by severity and rule with the sub-totals of each severity and the grand total."""
    return issues.rollup(*levels).agg(F.count(F.lit(1)).alias("n"))
