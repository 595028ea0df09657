"""Feature messages (XML) as slices and references.

The XML source splits the file by member elements and skips comments. Struct inference stays off the numbers: every leaf
is text, so designators keep their zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coords import coordinate_45
from ..operators.flatten import flat_map


def read_features_5(spark: SparkSession, path: str, dataset_id: str, row_tag: str = "hasMember") -> DataFrame:
    """Time slices of a version 5 message: dataset_id, feature_type, feature_id, gml_id, interp, seq, corr, validity, lifetime, props.

    ``props`` is the slice as JSON text, one element per property. Members that are not well-formed give an error row
    (feature_type '#error').
    """
    raw = (
        spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").option("inferSchema", "false").option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt").load(path).withColumn("_file", F.input_file_name())
    )
    kinds = [f.name for f in raw.schema.fields if f.dataType.typeName() == "struct"]
    if not kinds:
        raise ValueError(f"no members in {path}")

    def member(kind: str):
        has_id = "_id" in raw.schema[kind].dataType.fieldNames()
        gml = F.col(kind)["_id"] if has_id else F.lit(None)
        return F.when(F.col(kind).isNotNull(), F.struct(F.lit(kind).alias("feature_type"), gml.cast("string").alias("gml_id"), F.to_json(F.col(kind)).alias("json")))

    # one pass whatever the number of types: each member is the one filled column of its row
    members = [member(kind) for kind in kinds]
    if "_corrupt" in raw.columns:
        bad = F.struct(F.lit(ERROR).alias("feature_type"), F.lit(None).cast("string").alias("gml_id"), F.col("_corrupt").alias("json"))
        members.append(F.when(F.col("_corrupt").isNotNull(), bad))
    m = raw.select("_file", F.explode(F.array_compact(F.array(*members))).alias("_m")).select("_file", "_m.*")
    failed = F.col("feature_type") == ERROR
    j = lambda p, c="json": F.when(~failed, F.get_json_object(c, p))
    holder = j("$.timeSlice")
    many = F.when(holder.startswith("["), F.from_json(holder, "array<string>")).otherwise(F.array(holder))
    s = m.select("feature_type", "gml_id", "_file", "json", F.coalesce(j("$.identifier._VALUE"), j("$.identifier")).alias("feature_id"), F.posexplode(many).alias("slice_no", "_s"))
    body = F.coalesce(F.expr("get_json_object(_s, concat('$.', feature_type, 'TimeSlice'))"), F.col("_s"))
    s = s.withColumn("_b", F.when(failed, F.col("json")).otherwise(body))
    g = lambda p: j(p, "_b")
    ts = lambda *p: F.try_to_timestamp(F.coalesce(*[g(x) for x in p]))
    number = lambda p: F.when(~failed, F.coalesce(g(p).try_cast("int"), F.lit(0)))
    return s.select(
        F.lit(dataset_id).alias("dataset_id"), "feature_type", F.coalesce("feature_id", F.concat(F.lit("#"), "gml_id")).alias("feature_id"), "gml_id", F.col("_file").alias("file"),
        F.when(~failed, F.col("slice_no")).alias("slice_no"), g("$.interpretation").alias("interp"), number("$.sequenceNumber").alias("seq"), number("$.correctionNumber").alias("corr"),
        ts("$.validTime.TimePeriod.beginPosition", "$.validTime.TimeInstant.timePosition").alias("valid_begin"), ts("$.validTime.TimePeriod.endPosition").alias("valid_end"),
        ts("$.featureLifetime.TimePeriod.beginPosition").alias("life_begin"), ts("$.featureLifetime.TimePeriod.endPosition").alias("life_end"), F.col("_b").alias("props"),
    )


ERROR = "#error"
HOUSEKEEPING = ["interpretation", "sequenceNumber", "correctionNumber", "validTime", "featureLifetime", "_id"]


def slice_props(slices: DataFrame) -> DataFrame:
    """Adds ``prop_map``: MAP of top-level property to JSON text, without the housekeeping elements."""
    m = F.from_json("props", "map<string,string>")
    return slices.withColumn("prop_map", F.map_filter(m, lambda k, v: ~k.isin(HOUSEKEEPING) & v.isNotNull()))


def slice_refs(slices: DataFrame) -> DataFrame:
    """References of the slices: dataset_id, src_id, src_type, prop, ref (identifiers without their urn prefix)."""
    leaves = slices.select("dataset_id", F.col("feature_id").alias("src_id"), F.col("feature_type").alias("src_type"), F.explode(flat_map(F.col("props"))).alias("path", "value"))
    refs = leaves.filter(F.col("path").rlike(r"(^|/)_href$"))
    return refs.select("dataset_id", "src_id", "src_type", F.regexp_extract("path", r"^([^/\[]+)", 1).alias("prop"), F.regexp_replace("value", r"^urn:uuid[.:]", "").alias("ref")).distinct()


def gml_vertices(slices: DataFrame) -> DataFrame:
    """Vertices of the pos and posList texts of slices: keys, path, seq, lon, lat. EPSG:4326 gives latitude first, CRS84 longitude."""
    leaves = slices.select("dataset_id", "feature_id", "slice_no", flat_map(F.col("props")).alias("_m"))
    e = leaves.select("dataset_id", "feature_id", "slice_no", "_m", F.explode("_m").alias("path", "value")).filter(F.col("path").rlike(r"(^|/)(pos|posList)(\[\d+\])?(/_VALUE)?$"))
    srs_names = F.filter(F.map_keys("_m"), lambda k: k.endswith("_srsName"))
    lon_first = F.exists(srs_names, lambda k: F.try_element_at(F.col("_m"), k).rlike(r"(?i)CRS:?(84|83|27)(?!\d)"))
    nums = F.transform(F.split(F.trim("value"), r"[\s,]+"), lambda x: x.try_cast("double"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(nums) / 2).cast("int") - 1), lambda i: F.named_struct(F.lit("a"), F.get(nums, i * 2), F.lit("b"), F.get(nums, i * 2 + 1)))
    v = e.filter(F.size(nums) >= 2).select("dataset_id", "feature_id", "slice_no", "path", lon_first.alias("_lf"), F.posexplode(pairs).alias("seq", "_p"))
    return v.select("dataset_id", "feature_id", "slice_no", "path", "seq", F.when(F.col("_lf"), F.col("_p.a")).otherwise(F.col("_p.b")).alias("lon"), F.when(F.col("_lf"), F.col("_p.b")).otherwise(F.col("_p.a")).alias("lat"))


# A selection of version 4.5 record tags and the feature types they become.
TYPES_45 = {
    "Ahp": "AirportHeliport", "Rwy": "Runway", "Rdn": "RunwayDirection", "Twy": "Taxiway", "Apn": "Apron", "Ase": "Airspace", "Dpn": "DesignatedPoint", "Vor": "VOR", "Dme": "DME", "Ndb": "NDB",
    "Obs": "VerticalStructure", "Org": "OrganisationAuthority", "Uni": "Unit", "Ser": "Service", "Fqy": "RadioCommunicationChannel", "Rte": "Route", "Rsg": "RouteSegment",
}


def read_features_45(spark: SparkSession, path: str, dataset_id: str, tag: str) -> DataFrame:
    """Records of one tag of a version 4.5 message: dataset_id, feature_type, feature_id (composite uid), lon, lat, props."""
    raw = spark.read.format("xml").option("rowTag", tag).option("inferSchema", "false").load(path)
    j = F.to_json(F.struct(*raw.columns))
    uid = F.from_json(F.get_json_object(j, f"$.{tag}Uid"), "map<string,string>")
    parts = F.array_sort(F.transform(F.map_entries(F.map_filter(uid, lambda k, v: (k != "_mid") & v.isNotNull())), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    g = lambda n: F.coalesce(F.get_json_object(j, f"$.{n}"), F.get_json_object(j, f"$.{tag}Uid.{n}"))
    return raw.select(
        F.lit(dataset_id).alias("dataset_id"), F.lit(TYPES_45.get(tag, f"45:{tag}")).alias("feature_type"), F.concat_ws("|", F.lit(tag), F.array_join(parts, "|")).alias("feature_id"),
        coordinate_45(g("geoLong"), False).alias("lon"), coordinate_45(g("geoLat"), True).alias("lat"), j.alias("props"),
    )
