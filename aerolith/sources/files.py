"""Delivered files: catalogue, grouping into deliveries, check sums, GeoJSON and terrain grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import OrderedScan

HEAD_BYTES = 8192


def catalog_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, name, size, modified, family, version, from the head of its content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.decode(F.substring("content", 1, HEAD_BYTES), "UTF-8")
    f = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), head.alias("_h"))
    h = F.col("_h")
    family = (
        F.when(h.rlike("AIXM-(Snapshot|Update)"), "45").when(h.rlike(r"/amxm/|amxm:"), "amxm").when(h.rlike(r"aixm\.aero/schema/5"), "5").when(h.rlike(r"(?m)^[\w ]{0,10}[A-Z0-9]{2}-\d{6} |CURRENCY DATE\s*="), "dof")
        .when(h.rlike(r"(?i)^\s*ncols\s"), "terrain").when(h.rlike(r'"FeatureCollection"'), "geojson").when(h.rlike(r"NOTAM[NRC]\b|(?m)^!\w{3,4}\s+\d"), "notam").when(F.lower("name").rlike(r"\.(csv|tsv|txt)$"), "table")
    )
    version = F.regexp_extract(h, r"aixm\.aero/schema/(5(?:\.\d)+)", 1)
    effective = F.regexp_extract(h, r'effective="([^"]+)"', 1)
    return f.select("path", "name", "size", "modified", family.alias("family"), version.alias("version"), effective.alias("effective"))


VARIANTS = r"(?i)(baseline|snapshot|delta|update|diff(erence)?|full|part\d*|airport\w*|runway\w*|airspace\w*|navaid\w*|obstacle\w*|route\w*|procedure\w*|ad|enr|gen|\d{4}-?\d{2}-?\d{2}|v\d+)"


def group_deliveries(files: DataFrame, manifest: str = "manifest") -> DataFrame:
    """Files of one delivery: the same check-sum list, else the same name without type and variant words; baseline first.

    ``files``: path, name, manifest (null when none). Adds delivery and read_order.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("name", r"\.[^.]+$", ""), VARIANTS, ""), r"[\s_.-]+", " ")
    late = F.lower("name").rlike("delta|update|diff")
    keyed = files.withColumn("delivery", F.coalesce(manifest, F.trim(F.lower(bare)))).withColumn("_late", late.cast("int"))
    order = [F.col("_late"), F.col("name"), F.col("path")]
    segment = F.concat(F.col("_late").cast("string"), F.substring("name", 1, 8))
    return OrderedScan(["delivery"], order, segment).row_number(keyed, "read_order").drop("_late")


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files against a delivered list of SHA-256 sums: name, status ok, changed, missing or not listed.

    ``files``: name and content or sha256; ``manifest``: name, sha256.
    """
    digest = F.sha2("content", 256) if "content" in files.columns else F.col("sha256")
    have = files.select("name", digest.alias("_now"))
    want = manifest.select("name", F.lower("sha256").alias("_then"))
    status = F.when(F.col("_now").isNull(), "missing").when(F.col("_then").isNull(), "not listed").when(F.col("_now") == F.col("_then"), "ok").otherwise("changed")
    return have.join(want, "name", "full_outer").select("name", status.alias("status"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON collections: type (property, else file name), geometry kind, properties, coordinates as JSON text."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("f"))
    g = lambda p: F.get_json_object("f", p)
    name = F.regexp_extract("file", r"([^/]+)\.\w+$", 1)
    return raw.select(
        F.coalesce(g("$.properties.feattype"), g("$.properties.type"), g("$.properties.layer"), name).alias("type"), g("$.id").alias("feature_id"), g("$.geometry.type").alias("geometry"),
        F.from_json(g("$.properties"), "map<string,string>").alias("attrs"), g("$.geometry.coordinates").alias("coordinates"),
    )


def read_terrain_asc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cells and grid description of ESRI ASCII grids: (source, row, col, lon, lat, elev), (source, spacing_deg, lon0, lat0, n_rows, n_cols).

    Each file is one row of text; its lines are exploded to cells inside Spark. No-data posts are null.
    """
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("source"), F.col("value").alias("t"))
    h = lambda k: F.regexp_extract("t", rf"(?im)^\s*{k}\s+(\S+)", 1).try_cast("double")
    g = raw.select(
        "source", "t", h("ncols").cast("int").alias("n_cols"), h("nrows").cast("int").alias("n_rows"), h("cellsize").alias("spacing_deg"), h("nodata_value").alias("_nd"),
        F.coalesce(h("xllcenter"), h("xllcorner") + h("cellsize") / 2).alias("lon0"), F.coalesce(h("yllcenter"), h("yllcorner") + h("cellsize") / 2).alias("_south"),
    ).withColumn("lat0", F.col("_south") + (F.col("n_rows") - 1) * F.col("spacing_deg"))
    lines = F.filter(F.split("t", r"\r?\n"), lambda x: x.rlike(r"^\s*[-+\d.]"))
    rows = g.select("*", F.posexplode(lines).alias("row", "_l")).drop("t")
    cells = rows.select("*", F.posexplode(F.split(F.trim("_l"), r"\s+")).alias("col", "_v"))
    v = F.col("_v").try_cast("double")
    out = cells.select(
        "source", "row", "col", (F.col("lon0") + F.col("col") * F.col("spacing_deg")).alias("lon"), (F.col("lat0") - F.col("row") * F.col("spacing_deg")).alias("lat"),
        F.when(F.col("_nd").isNull() | (v != F.col("_nd")), v).alias("elev"),
    )
    return out, g.select("source", "spacing_deg", "lon0", "lat0", "n_rows", "n_cols")
