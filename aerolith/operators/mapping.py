"""Aerodrome mapping: spatial comparison, measured accuracy, taxi network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import NM_M, R_M, distance_m
from .ordered import OrderedScan, Running
from .spatial import near_path, within_distance

SAME_PLACE_M = 50.0
MOVED_M = 0.5


def compare_spatial(a: DataFrame, b: DataFrame, tolerance_m: float = MOVED_M) -> DataFrame:
    """Mapping features of two deliveries: key_a, key_b, status (same, moved, changed, moved+changed, added, removed), shift_m.

    Both: key, type, ad_id, label, lon, lat, attrs (MAP). The identifier counts first, then the label inside the same type
    and aerodrome, then the nearest place within 50 m. Where several could pair up, two features pair when each is the
    other's best; the reference order of a sequential match has no meaning in a distributed one.
    """
    cols = ["key", "type", "ad_id", "label", "lon", "lat", "attrs"]
    left, right = a.select(*[F.col(c).alias(f"a_{c}") for c in cols]), b.select(*[F.col(c).alias(f"b_{c}") for c in cols])
    by_id = left.join(right, (F.col("a_key") == F.col("b_key")) & (F.col("a_type") == F.col("b_type")))
    rest_a = left.join(by_id.select("a_key"), "a_key", "left_anti")
    rest_b = right.join(by_id.select("b_key"), "b_key", "left_anti")
    group = lambda s: [f"{s}_type", f"{s}_ad_id", f"{s}_label"]
    # one per label: the smallest key of each side stands for it
    la = rest_a.filter(F.coalesce("a_label", F.lit("")) != "").groupBy(*group("a")).agg(F.min("a_key").alias("a_key"))
    lb = rest_b.filter(F.coalesce("b_label", F.lit("")) != "").groupBy(*group("b")).agg(F.min("b_key").alias("b_key"))
    same_label = la.join(lb, (F.col("a_type") == F.col("b_type")) & F.col("a_ad_id").eqNullSafe(F.col("b_ad_id")) & (F.col("a_label") == F.col("b_label"))).select("a_key", "b_key")
    rest_a2, rest_b2 = rest_a.join(same_label, "a_key", "left_anti"), rest_b.join(same_label, "b_key", "left_anti")
    near = within_distance(
        rest_a2.select("a_key", "a_type", "a_ad_id", F.col("a_lon").alias("lon"), F.col("a_lat").alias("lat")), rest_b2.withColumnsRenamed({"b_lon": "site_lon", "b_lat": "site_lat"}),
        SAME_PLACE_M * 1.01 / NM_M, ["b_key", "b_type", "b_ad_id", "site_lon", "site_lat"], site_lon="site_lon", site_lat="site_lat",
    ).filter((F.col("a_type") == F.col("b_type")) & F.col("a_ad_id").eqNullSafe(F.col("b_ad_id")))
    near = near.withColumn("_d", distance_m("lon", "lat", "site_lon", "site_lat")).filter(F.col("_d") < SAME_PLACE_M)
    best_a = near.groupBy("a_key").agg(F.min(F.struct("_d", "b_key")).alias("_x")).select("a_key", F.col("_x.b_key").alias("b_key"))
    best_b = near.groupBy("b_key").agg(F.min(F.struct("_d", "a_key")).alias("_x")).select(F.col("_x.a_key").alias("a_key"), "b_key")
    mutual = best_a.join(best_b, ["a_key", "b_key"])
    pairs = by_id.select("a_key", "b_key").unionByName(same_label).unionByName(mutual)
    all_ = left.join(pairs, "a_key", "full_outer").join(right, "b_key", "full_outer")
    shift = F.when(F.col("a_key").isNotNull() & F.col("b_key").isNotNull(), distance_m("a_lon", "a_lat", "b_lon", "b_lat"))
    differs = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("a_attrs")))) != F.to_json(F.map_from_entries(F.array_sort(F.map_entries("b_attrs"))))
    moved = F.col("shift_m") > tolerance_m
    status = (
        F.when(F.col("a_key").isNull(), "added").when(F.col("b_key").isNull(), "removed").when(moved & differs, "moved+changed").when(moved, "moved").when(differs, "changed").otherwise("same")
    )
    return all_.withColumn("shift_m", shift).select(F.col("a_key").alias("key_a"), F.col("b_key").alias("key_b"), status.alias("status"), "shift_m")


def measure(vertices: DataFrame, reference: DataFrame, cut_m: float = 100.0) -> DataFrame:
    """Distance of each feature to the nearest reference line of its type within the cut: key, type, d (mean, null = missed), max, part.

    ``vertices``: key, type, vertex_no, lon, lat (points, or lines densified to 5 m); ``reference``: type, lon1, lat1,
    lon2, lat2. Features of a type the reference does not have are left out.
    """
    v = vertices.withColumn("_v", F.struct("key", "vertex_no"))
    ref = reference.withColumnRenamed("type", "ref_type")
    hits = near_path(v, ref, cut_m * 1.01 / NM_M, ["ref_type"]).filter(F.col("type") == F.col("ref_type"))
    d = hits.groupBy("_v").agg((F.min("distance_nm") / 60.0 * (R_M * 3.141592653589793 / 180.0)).alias("_d")).filter(F.col("_d") <= cut_m)
    known = v.join(reference.select("type").distinct(), "type", "left_semi")
    per = known.join(d, "_v", "left").groupBy("key", "type").agg(F.avg("_d").alias("d"), F.max("_d").alias("max"), (F.count("_d") / F.count(F.lit(1))).alias("part"))
    return per


def taxi_network(vertices: DataFrame, way: str = "way", seq: str = "seq", block: int = 1000) -> DataFrame:
    """Edges between the nodes of a line network: way, edge_no, from_node, to_node, length_m.

    ``vertices``: way, seq, node (an id shared by lines that meet), lon, lat, kind. A node is an end of a line or a
    vertex that several places of lines share.
    """
    shared = vertices.groupBy("node").agg(F.count(F.lit(1)).alias("_n"))
    ends = vertices.groupBy(way).agg(F.min(seq).alias("_first"), F.max(seq).alias("_last"))
    v = vertices.join(shared, "node").join(ends, way)
    v = v.withColumn("_is", ((F.col("_n") > 1) | (F.col(seq) == F.col("_first")) | (F.col(seq) == F.col("_last"))).cast("int"))
    scan = OrderedScan([way], [F.col(seq)], F.floor(F.col(seq) / block))
    s = scan.compute(v, running={"_before": Running("sum", F.col("_is"), inclusive=False)}, previous={"_lon": F.col("lon"), "_lat": F.col("lat")})
    s = s.filter(F.col("_lon").isNotNull())
    edges = s.groupBy(way, F.col("_before").alias("edge_no")).agg(F.sum(distance_m("_lon", "_lat", "lon", "lat")).alias("length_m"), F.max_by("node", seq).alias("to_node"))
    starts = OrderedScan([way], [F.col(seq)], F.floor(F.col(seq) / block)).running(v.filter("_is = 1"), edge_no=Running("count")).select(way, "edge_no", F.col("node").alias("from_node"))
    return edges.join(starts, [way, "edge_no"])


def related(points: DataFrame, aerodromes: DataFrame, owned: DataFrame, nm: float = 25.0) -> DataFrame:
    """Data around aerodromes: key, ad_id, tag; a feature an aerodrome owns keeps that tag, else it is near it.

    ``points``: key, lon, lat; ``aerodromes``: ad_id, lon, lat; ``owned``: key, ad_id.
    """
    once = lambda df, k: df.select(k, "lon", "lat").distinct().withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(k)))
    p, a = once(points, "key"), once(aerodromes, "ad_id").withColumnsRenamed({"lon": "_alon", "lat": "_alat"})
    own = owned.select("key", "ad_id").distinct()
    p = p.join(own.groupBy("key").agg(F.collect_set("ad_id").alias("_own")), "key", "left")

    def near(p: DataFrame, a: DataFrame) -> DataFrame:
        pairs = within_distance(p.drop("_n"), a.drop("_n"), nm, ["ad_id"], site_lon="_alon", site_lat="_alat")
        return pairs.filter(~F.coalesce(F.array_contains("_own", F.col("ad_id")), F.lit(False))).select("key", "ad_id")

    # a pair of one place each comes once and needs no grouping; only what has several places is made distinct
    plain = near(p.filter("_n = 1"), a.filter("_n = 1"))
    several = near(p.filter("_n > 1"), a).unionByName(near(p.filter("_n = 1"), a.filter("_n > 1"))).distinct()
    return own.withColumn("tag", F.lit("aerodrome data")).unionByName(plain.unionByName(several).withColumn("tag", F.lit("near")))


def derive_parents(elements: DataFrame, kind: str, code: str) -> DataFrame:
    """One row per aerodrome and code that mapping elements only name, with the largest width and length: ad_id, code, type, width_m, length_m, n.

    ``elements``: ad_id, the code column, width_m, length_m.
    """
    named = elements.filter(F.coalesce(F.col(code), F.lit("")) != "")
    return named.groupBy("ad_id", F.col(code).alias("code")).agg(
        F.max("width_m").alias("width_m"), F.max("length_m").alias("length_m"), F.count(F.lit(1)).alias("n")
    ).withColumn("type", F.lit(kind))


def pair_stands(areas: DataFrame, locations: DataFrame) -> DataFrame:
    """Stands given as an area and as a location are one stand, labelled at its location: ad_id, stand, area_id, location_id."""
    return areas.select("ad_id", "stand", "area_id").join(locations.select("ad_id", "stand", "location_id"), ["ad_id", "stand"], "full_outer")


def airspace_over(inside: DataFrame, served: DataFrame) -> DataFrame:
    """Airspace an aerodrome lies in or serves, once each: ad_id, airspace_id, served."""
    both = inside.select("ad_id", "airspace_id", F.lit(False).alias("served")).unionByName(served.select("ad_id", "airspace_id", F.lit(True).alias("served")))
    return both.groupBy("ad_id", "airspace_id").agg(F.bool_or("served").alias("served"))
