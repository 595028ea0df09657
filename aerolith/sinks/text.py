"""CSV guarded against formulas, JSON with lineage, GeoJSON, KML, WKT tables, terrain grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import col


def safe_cell(value) -> Column:
    """Text a spreadsheet would run as a formula gets a leading apostrophe; numbers stay."""
    v = col(value)
    risky = v.rlike(r"^[=+\-@\t\r]") & ~v.rlike(r"^[-+]?\d+([.,]\d+)?$")
    return F.when(risky, F.concat(F.lit("'"), v)).otherwise(v)


def guard(df: DataFrame) -> DataFrame:
    return df.select(*[safe_cell(f.name).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in df.schema.fields])


def write_csv_safe(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    guard(df).write.mode(mode).csv(path, header=True)


def lineage_json(df: DataFrame, columns: Sequence[str], source: Sequence[str]) -> Column:
    """Row as JSON in which every value carries its source (feature, file, line …)."""
    origin = F.struct(*source)
    return F.to_json(F.struct(*[F.struct(F.col(c).cast("string").alias("value"), origin.alias("source")).alias(c) for c in columns]))


def write_json_lineage(df: DataFrame, path: str, columns: Sequence[str], source: Sequence[str], mode: str = "errorifexists") -> None:
    df.select(lineage_json(df, columns, source).alias("value")).write.mode(mode).text(path)


def geojson_point(lon, lat, properties: Sequence[str]) -> Column:
    """One GeoJSON feature with a point and flattened scalar properties."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(col(lon), col(lat)).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def write_geojson(df: DataFrame, path: str, properties: Sequence[str], lon: str = "lon", lat: str = "lat", mode: str = "errorifexists") -> None:
    """Newline-delimited GeoJSON features."""
    df.select(geojson_point(lon, lat, properties).alias("value")).write.mode(mode).text(path)


def xml_text(value) -> Column:
    v = F.replace(col(value).cast("string"), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(v, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def kml_placemark(name, lon, lat, begin=None, end=None) -> Column:
    iso = lambda t: F.date_format(col(t), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    span = F.lit("")
    if begin is not None:
        opened = F.coalesce(F.concat(F.lit("<begin>"), iso(begin), F.lit("</begin>")), F.lit(""))
        closed = F.coalesce(F.concat(F.lit("<end>"), iso(end), F.lit("</end>")), F.lit("")) if end is not None else F.lit("")
        span = F.concat(F.lit("<TimeSpan>"), opened, closed, F.lit("</TimeSpan>"))
    return F.concat(F.lit("<Placemark><name>"), xml_text(name), F.lit("</name>"), span, F.lit("<Point><coordinates>"), col(lon).cast("string"), F.lit(","), col(lat).cast("string"), F.lit("</coordinates></Point></Placemark>"))


def wkt_table(attributes: DataFrame, names: Sequence[str], key: str = "feature_id") -> DataFrame:
    """Attribute rows (key, type, wkt, attr, value) as one row per feature with a column per attribute name."""
    return attributes.groupBy("type", key, "wkt").pivot("attr", list(names)).agg(F.first("value"))


def write_wkt_csv(attributes: DataFrame, path: str, names: Sequence[str], key: str = "feature_id", mode: str = "errorifexists") -> None:
    """One folder of CSV per feature type, with a WKT column and the union of the attribute columns."""
    guard(wkt_table(attributes, names, key)).write.mode(mode).partitionBy("type").csv(path, header=True)


def terrain_lines(cells: DataFrame, layout: str = "asc", nodata: str = "-9999") -> DataFrame:
    """Grid rows as text lines (asc: one line per row, ordered by row; xyz: one line per post): row, value."""
    if layout == "xyz":
        return cells.filter(F.col("elev").isNotNull()).select("row", F.concat_ws(" ", F.col("lon").cast("string"), F.col("lat").cast("string"), F.col("elev").cast("string")).alias("value"))
    v = F.coalesce(F.col("elev").cast("string"), F.lit(nodata))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", v.alias("v")))), lambda x: x["v"]), " ")
    return cells.groupBy("row").agg(line.alias("value")).orderBy("row")
