"""Route texts to points: a token grammar, places by name, airways by a search over their segments.

A text is split into tokens once; what a token means is a column, the level in force is the last one named before it, and
the airways asked for by all texts are searched together, one segment further each round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import positions_in_text
from ..functions.geo import FT_M
from ..session import cut_lineage

# Words of a route that name neither a place nor an airway.
CONNECTORS = ("DCT", "SID", "STAR", "IFR", "VFR")
# Metres a level group counts by its letter: flight level and altitude in hundreds of feet, metric ones in tens of metres.
LEVEL_METRES = {"F": 100 * FT_M, "A": 100 * FT_M, "S": 10.0, "M": 10.0}


def level_m(group: Column) -> Column:
    """Metres of a level group with or without a speed group before it (F350, N0450F350, S1130); null for other words."""
    speed = F.regexp_extract(group, r"^([KNM][0-9]{3,4})[AFMS][0-9]{3,4}$", 1)
    level = F.substring(group, F.length(speed) + 1, F.lit(6))
    value = F.when(level.rlike("^[AFMS][0-9]{3,4}$"), F.substring(level, 2, 4).cast("double"))
    by = F.lit(None).cast("double")
    for letter, metres in LEVEL_METRES.items():
        by = F.when(level.startswith(letter), F.lit(metres)).otherwise(by)
    return value * by


def tokens(routes: DataFrame, key: str = "route_id", text: str = "text") -> DataFrame:
    """key, pos, base (before a slash), level_m (of the group behind it), sets_m (the token is a level for what follows)."""
    words = F.filter(F.split(F.upper(F.coalesce(F.col(text), F.lit(""))), r"[\s,;]+"), lambda w: w != "")
    rows = routes.select(key, F.posexplode(words).alias("pos", "token"))
    base, tail = F.split_part("token", F.lit("/"), F.lit(1)), F.split_part("token", F.lit("/"), F.lit(2))
    alone = ~F.contains("token", F.lit("/"))
    return rows.select(key, "pos", "token", base.alias("base"), level_m(tail).alias("level_m"), F.when(alone, level_m(base)).alias("sets_m"))


def read_tokens(routes: DataFrame, places: DataFrame, key: str = "route_id", text: str = "text", default_m: str | None = None) -> DataFrame:
    """Tokens with their meaning: kind (skip, level, position, place, word), lon, lat and alt_m of points, from_name (the
    last point before) and next_base (the token after) for words.

    ``places``: name, rank (the lowest one wins where several bear a name), lon, lat. Texts are short: a window over one
    route's tokens holds one text.
    """
    t = tokens(routes, key, text)
    written = F.get(positions_in_text(F.col("base")), F.lit(0))
    known = places.groupBy("name").agg(F.min(F.struct("rank", "lon", "lat")).alias("p")).select(F.col("name").alias("base"), F.col("p.lon").alias("_lon"), F.col("p.lat").alias("_lat"))
    t = t.withColumn("_at", written).join(known, "base", "left")
    kind = (
        F.when(F.col("base").isin(*CONNECTORS), "skip").when(F.col("sets_m").isNotNull(), "level").when(F.col("_at").isNotNull(), "position").when(F.col("_lon").isNotNull(), "place").otherwise("word")
    )
    t = t.withColumns({"kind": kind, "lon": F.coalesce("_at.lon", "_lon"), "lat": F.coalesce("_at.lat", "_lat")})
    point = F.col("kind").isin("position", "place")
    order = Window.partitionBy(key).orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.when(F.col("kind") == "level", F.col("sets_m")), ignorenulls=True).over(before)
    if default_m:
        carried = F.coalesce(carried, F.col(default_m))
        t = t.join(routes.select(key, default_m), key)
    t = t.withColumns({
        "alt_m": F.coalesce(F.when(point, F.col("level_m")), carried), "next_base": F.lead("base").over(order),
        "from_name": F.last(F.when(point, F.col("base")), ignorenulls=True).over(before),
    })
    return t.select(key, "pos", "token", "base", "kind", *[F.when(point, F.col(c)).alias(c) for c in ("lon", "lat")], "alt_m", "from_name", "next_base")


def airway_paths(asked: DataFrame, segments: DataFrame) -> DataFrame:
    """For each (airway, from_name, to_name) that segments connect: path, the places in order from the first to the last.

    ``segments``: airway, no (their order), a, b; both directions are flown. Of the ways with the fewest segments the one
    that takes the earlier segments first. All searches go on together, a segment a round, until none is open; each
    round is a written table, and a search that has arrived leaves.
    """
    edges = cut_lineage(
        segments.select("airway", F.explode(F.array(F.struct("no", F.col("a").alias("u"), F.col("b").alias("v")), F.struct("no", F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("airway", "e.*").distinct()
    )
    wanted = cut_lineage(asked.select("airway", "from_name", "to_name").distinct())
    search = ["airway", "from_name"]
    start = wanted.select(*search).distinct().join(edges.select("airway", F.col("u").alias("from_name")).distinct(), search, "left_semi")
    seen = front = cut_lineage(start.withColumns({"at": F.col("from_name"), "steps": F.array().cast("array<bigint>"), "path": F.array("from_name")}))
    open_ = wanted
    found = open_.where("from_name = to_name").join(seen.select(*search, "path"), search)
    while True:
        arrived = open_.join(front.withColumnRenamed("at", "to_name"), [*search, "to_name"]).select(*open_.columns, "path")
        found = cut_lineage(arrived) if found is None else cut_lineage(found.unionByName(arrived).distinct())
        open_ = open_.join(found.select(*open_.columns), open_.columns, "left_anti")
        live = front.join(open_.select(*search).distinct(), search, "left_semi")
        ahead = live.join(edges, (live["airway"] == edges["airway"]) & (live["at"] == edges["u"])).select(live["airway"], "from_name", F.col("v").alias("at"), F.concat("steps", F.array(F.col("no").cast("bigint"))).alias("steps"), F.concat("path", F.array("v")).alias("path"))
        new = ahead.join(seen.select(*search, "at"), [*search, "at"], "left_anti").groupBy(*search, "at").agg(F.min(F.struct("steps", "path")).alias("p"))
        front = cut_lineage(new.select(*search, "at", "p.steps", "p.path"))
        if front.isEmpty():
            return found
        seen = cut_lineage(seen.select(*search, "at").unionByName(front.select(*search, "at")))


def expand_routes(routes: DataFrame, places: DataFrame, segments: DataFrame, key: str = "route_id", text: str = "text", default_m: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(points: key, pos, nth, name, lon, lat, alt_m, via; unknown: key, pos, token).

    ``segments``: airway, no, a, a_lon, a_lat, b, b_lon, b_lat. A word between two points that an airway of that name
    connects gives the places between them (``via``); any other word is unknown. The name of an airway is compared
    without blanks. Equal names of places are settled by rank.
    """
    read = cut_lineage(read_tokens(routes, places, key, text, default_m))
    own = read.where("kind in ('position', 'place')").select(key, "pos", F.lit(0).alias("nth"), F.col("base").alias("name"), "lon", "lat", "alt_m", F.lit(None).cast("string").alias("via"))
    named = segments.withColumn("airway", F.regexp_replace(F.upper("airway"), r"\s", ""))
    words = read.where("kind = 'word'")
    asked = words.where("from_name is not null and next_base is not null").select(F.col("base").alias("airway"), "from_name", F.col("next_base").alias("to_name"))
    paths = airway_paths(asked.join(named.select("airway").distinct(), "airway", "left_semi"), named.select("airway", "no", "a", "b"))
    via = words.join(paths.select(F.col("airway").alias("base"), "from_name", F.col("to_name").alias("next_base"), "path"), ["base", "from_name", "next_base"], "left")
    where = named.select("airway", "no", F.explode(F.array(*[F.struct(F.col(s).alias("name"), F.col(f"{s}_lon").alias("lon"), F.col(f"{s}_lat").alias("lat")) for s in ("a", "b")])).alias("p")).groupBy("airway", "p.name").agg(
        F.min(F.struct("no", "p.lon", "p.lat")).alias("p")
    ).select(F.col("airway").alias("via"), "name", "p.lon", "p.lat")
    between = via.where("path is not null").select(key, "pos", "alt_m", F.col("base").alias("via"), F.posexplode(F.slice("path", F.lit(2), F.greatest(F.size("path") - 2, F.lit(0)))).alias("nth", "name"))
    points = own.unionByName(between.join(where, ["via", "name"]).select(*own.columns))
    return points, via.where("path is null").select(key, "pos", "token")
