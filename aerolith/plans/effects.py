"""What events and NOTAMs change, and tables put together from assembled parts: approach profiles, airspace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import OrderedScan, Running
from ..operators.polygons import assemble_airspace, vertical_band
from ..operators.terrain import terrain_at

PROFILE_SEGMENT = 64


def along_profile(legs: DataFrame) -> DataFrame:
    """Approach profile: proc_id, seq, fix, to_threshold_nm, role, lower_ft, upper_ft.

    ``legs``: proc_id, seq (unique in its procedure, from 0), fix (at the end of the leg), role (IAF, IF, FAF, MAPT or
    null), length_nm, lower_ft, upper_ft. The distance is what is still to fly behind the fix; missing lengths count
    nothing. Roles that are not coded follow from the place: the fix before the FAF is the IF, the first one the IAF,
    the last one the MAPT.
    """
    marks = legs.groupBy("proc_id").agg(F.min(F.when(F.col("role") == "FAF", F.col("seq"))).alias("_faf"), F.min("seq").alias("_first"), F.max("seq").alias("_last"))
    rows = legs.join(marks, "proc_id")
    before = rows.filter(F.col("seq") < F.col("_faf")).groupBy("proc_id").agg(F.max("seq").alias("_if"))
    scan = OrderedScan(["proc_id"], [-F.col("seq")], -F.floor(F.col("seq") / PROFILE_SEGMENT))
    done = scan.running(rows.join(before, "proc_id", "left"), _behind=Running("sum", F.coalesce("length_nm", F.lit(0.0)), inclusive=False))
    place = F.when(F.col("seq") == F.col("_if"), "IF").when(F.col("seq") == F.col("_last"), "MAPT").when(F.col("seq") == F.col("_first"), "IAF")
    return done.select("proc_id", "seq", "fix", F.coalesce("_behind", F.lit(0.0)).alias("to_threshold_nm"), F.coalesce("role", place).alias("role"), "lower_ft", "upper_ft")


def airspace_table(airspaces: DataFrame, own_cells: DataFrame, components: DataFrame, volumes: DataFrame) -> DataFrame:
    """Airspace with its assembled shape and vertical band: the given columns, n_cells, lo_ft, up_ft.

    ``airspaces``: airspace_id and what else describes it (class, activation); the others as `assemble_airspace` and
    `vertical_band` take them. Airspace without a shape has n_cells 0, without limits null limits.
    """
    shape = assemble_airspace(own_cells, components).groupBy("airspace_id").agg(F.count(F.lit(1)).alias("_n"))
    out = airspaces.join(shape, "airspace_id", "left").join(vertical_band(volumes), "airspace_id", "left")
    return out.withColumn("n_cells", F.coalesce("_n", F.lit(0).cast("long"))).drop("_n")


def notam_effects(notam_obstacles: DataFrame, obstacles: DataFrame, cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Published obstacles and those of NOTAMs as one table for the assessments: obstacle_id, origin, lon, lat, elev_m, hgt_m, ground_m.

    A NOTAM obstacle (id, n, lon, lat, elev_m, hgt_m) without elevation stands on the terrain: ground and height; one
    without height rises from it. Off the terrain what is missing stays null.
    """
    new = notam_obstacles.withColumn("obstacle_id", F.concat_ws("#", "id", "n"))
    ground = terrain_at(new.filter("lon is not null and lat is not null").select("obstacle_id", "lon", "lat"), cells, grids, "obstacle_id")
    new = new.join(ground.select("obstacle_id", F.col("elev").alias("ground_m")), "obstacle_id", "left")
    new = new.select(
        "obstacle_id", F.lit("notam").alias("origin"), "lon", "lat", F.coalesce("elev_m", F.col("ground_m") + F.col("hgt_m")).alias("elev_m"),
        F.coalesce("hgt_m", F.when(F.col("elev_m").isNotNull() & F.col("ground_m").isNotNull(), F.greatest(F.lit(0.0), F.col("elev_m") - F.col("ground_m")))).alias("hgt_m"), "ground_m",
    )
    kept = obstacles.select(F.col("obstacle_id").cast("string"), F.lit("published").alias("origin"), "lon", "lat", "elev_m", "hgt_m", (F.col("elev_m") - F.col("hgt_m")).alias("ground_m"))
    return kept.unionByName(new)


def event_effects(events: DataFrame, temporary: DataFrame, base: DataFrame) -> DataFrame:
    """What each event changes: event_id, feature_id, n_changed, lines (one 'property: before → during' per property, in order).

    ``events``: event_id; ``temporary`` (property values of the temporary slices that name an event): event_id,
    feature_id, prop, value; ``base``: feature_id, prop, value of the state below. Values equal to the base are no
    change; a property the base does not give is 'not given'. Repeated values count once; of several the last in order.
    """
    during = temporary.join(events.select("event_id").distinct(), "event_id", "left_semi").groupBy("event_id", "feature_id", "prop").agg(F.max("value").alias("value"))
    now = base.groupBy("feature_id", "prop").agg(F.max("value").alias("_before"))
    changed = during.join(now, ["feature_id", "prop"], "left").filter(~F.col("value").eqNullSafe(F.col("_before")))
    line = F.concat(F.col("prop"), F.lit(": "), F.coalesce("_before", F.lit("not given")), F.lit(" → "), F.coalesce("value", F.lit("not given")))
    # the lines of one feature under one event: as many as a type has properties
    return changed.groupBy("event_id", "feature_id").agg(F.count(F.lit(1)).alias("n_changed"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
