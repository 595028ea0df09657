"""References between features: resolution, ownership, closure, chains.

``refs`` rows: dataset_id, src_id, prop, ref and ref_no (place of the reference in its feature);
``features`` rows: dataset_id, feature_id, feature_type, gml_id, gone.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import top_k_per_key

# Feature types by what they are to an aerodrome.
AERODROME = "AirportHeliport"
AERODROME_COMPONENTS = (
    "Runway RunwayDirection RunwayCentrelinePoint RunwayElement RunwayMarking RunwayProtectArea RunwayDirectionLightSystem "
    "RunwayProtectAreaLightSystem RunwayVisualRange RunwayVisualRangeEquipment RunwayBlastPad ArrestingGear "
    "ApproachLightingSystem VisualGlideSlopeIndicator Taxiway TaxiwayElement TaxiwayMarking TaxiwayLightSystem "
    "TaxiHoldingPosition TaxiHoldingPositionMarking TaxiHoldingPositionLightSystem Apron ApronElement ApronMarking "
    "ApronLightSystem AircraftStand StandMarking GuidanceLine GuidanceLineMarking GuidanceLineLightSystem TouchDownLiftOff "
    "TouchDownLiftOffMarking TouchDownLiftOffLightSystem TouchDownLiftOffSafeArea DeicingArea DeicingAreaMarking "
    "NonMovementArea WorkArea AirportHotSpot AirportProtectionAreaMarking AirportSign Road SeaplaneLandingArea "
    "SeaplaneRampSite FloatingDockSite PassengerLoadingBridge Gangway MarkingBuoy AirportClearanceService "
    "AirportSuppliesService AircraftGroundService PassengerService FireFightingService CheckpointINS CheckpointVOR "
    "AltimeterCheckpoint AltimeterSource Navaid ObstacleArea Unit AirTrafficControlService InformationService "
    "GroundTrafficControlService SearchRescueService Service StandardInstrumentDeparture StandardInstrumentArrival "
    "InstrumentApproachProcedure SafeAltitudeArea MinimumAltitudeArea TerminalArrivalArea SurveyControlPoint "
    "PilotControlledLighting WeatherSource DepartureLeg ArrivalLeg ArrivalFeederLeg InitialLeg IntermediateLeg FinalLeg "
    "MissedApproachLeg"
).split()
EQUIPMENT = "VOR DME NDB TACAN MarkerBeacon Localizer Glidepath Azimuth Elevation SDF DirectionFinder".split()
PROCEDURES = ["StandardInstrumentDeparture", "StandardInstrumentArrival", "InstrumentApproachProcedure"]
LEGS = "DepartureLeg ArrivalLeg ArrivalFeederLeg InitialLeg IntermediateLeg FinalLeg MissedApproachLeg".split()
SERVICES = (
    "AirTrafficControlService InformationService GroundTrafficControlService SearchRescueService AirportSuppliesService "
    "AircraftGroundService PassengerService FireFightingService AirportClearanceService AirTrafficManagementService "
    "AirTrafficFlowManagementService Service"
).split()
CHANNEL = "RadioCommunicationChannel"
PASS_DOWN = {
    "Navaid": "navaidEquipment", "ObstacleArea": "obstacle", "AirTrafficControlService": "radioCommunication",
    "InformationService": "radioCommunication", "GroundTrafficControlService": "radioCommunication",
    "AirportSuppliesService": "radioCommunication", "AircraftGroundService": "radioCommunication",
    "FireFightingService": "radioCommunication", "SearchRescueService": "radioCommunication",
    "StandardInstrumentDeparture": "flightTransition", "StandardInstrumentArrival": "flightTransition",
    "InstrumentApproachProcedure": "flightTransition",
}
NEAREST_OWNER_NM = 25.0


def resolve_refs(refs: DataFrame, features: DataFrame) -> DataFrame:
    """Adds ``target_id`` and ``target_type``: the feature a reference names by identifier, else by local id.

    Withdrawn targets and references of a feature to itself stay unresolved (null).
    """
    alive = features.filter(~F.coalesce(F.col("gone"), F.lit(False)))
    by_id = alive.select("dataset_id", F.col("feature_id").alias("ref"), F.col("feature_id").alias("_t1"), F.col("feature_type").alias("_y1"))
    by_gml = alive.filter(F.col("gml_id").isNotNull()).select(
        "dataset_id", F.col("gml_id").alias("_local"), F.col("feature_id").alias("_t2"), F.col("feature_type").alias("_y2")
    )
    out = (
        refs.join(by_id, ["dataset_id", "ref"], "left")
        .withColumn("_local", F.when(F.col("ref").cast("string").startswith("#"), F.expr("substring(cast(ref as string), 2)")))
        .join(by_gml, ["dataset_id", "_local"], "left")
        .withColumn("target_id", F.coalesce("_t1", "_t2"))
        .withColumn("target_type", F.coalesce("_y1", "_y2"))
    )
    own = F.col("target_id") == F.col("src_id")
    return out.withColumns({c: F.when(~own | own.isNull(), F.col(c)) for c in ("target_type", "target_id")}).drop("_t1", "_t2", "_y1", "_y2", "_local")


def reverse_refs(resolved: DataFrame, src_type: str | None = None, prop: str | None = None) -> DataFrame:
    """Who points at a feature: target_id, src_id, src_type, prop."""
    out = resolved.filter(F.col("target_id").isNotNull())
    if src_type:
        out = out.filter(F.col("src_type") == src_type)
    if prop:
        out = out.filter(F.col("prop") == prop)
    return out.select("dataset_id", "target_id", "src_id", "src_type", "prop")


def unresolved_refs(refs: DataFrame, features: DataFrame, examples: int = 5) -> DataFrame:
    """References to features the data does not hold, per (type, property), with a few examples.

    Targets inside vendor extensions are only a note. ``refs`` needs src_type besides its usual columns.
    """
    ids = features.select("dataset_id", F.col("feature_id").alias("ref"))
    local = features.filter(F.col("gml_id").isNotNull()).select("dataset_id", F.concat(F.lit("#"), F.col("gml_id")).alias("ref"))
    lost = refs.join(ids, ["dataset_id", "ref"], "left_anti").join(
        local.withColumn("ref", F.col("ref").cast(refs.schema["ref"].dataType)), ["dataset_id", "ref"], "left_anti"
    )
    counts = lost.groupBy("src_type", "prop").agg(F.count(F.lit(1)).alias("n"))
    few = top_k_per_key(lost.select("src_type", "prop", "src_id").distinct(), ["src_type", "prop"], [F.col("src_id")], examples)
    few = few.groupBy("src_type", "prop").agg(F.array_join(F.array_sort(F.collect_list("src_id")), ", ").alias("examples"))
    severity = F.when(F.col("prop") == "extension", "info").otherwise("warning")
    return counts.join(few, ["src_type", "prop"]).withColumn("severity", severity)


def peer_lookup(lost: DataFrame, peers: DataFrame, key: str = "ref") -> DataFrame:
    """Unresolved references found in other data sets: the first data set that has the feature.

    ``peers``: dataset_id, dataset_order, feature_id of the other data sets.
    """
    first = peers.groupBy(F.col("feature_id").alias(key)).agg(F.min_by("dataset_id", "dataset_order").alias("found_in"))
    return lost.join(first, key)


def cross_dataset_refs(lost: DataFrame, features: DataFrame, least: int = 3, share: float = 0.2) -> DataFrame:
    """Data sets that name features of another one.

    Of the unresolved ids of a data set at least ``least``, and the given share, are found in the other.
    """
    looked_up = lost.select("dataset_id", "ref").distinct()
    n = looked_up.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_ids"))
    hits = (
        looked_up.join(features.select(F.col("dataset_id").alias("other_id"), F.col("feature_id").alias("ref")).distinct(), "ref")
        .filter(F.col("other_id") != F.col("dataset_id"))
        .groupBy("dataset_id", "other_id").agg(F.count(F.lit(1)).alias("n_found"))
    )
    return hits.join(n, "dataset_id").filter((F.col("n_found") >= least) & (F.col("n_found") >= share * F.col("n_ids")))


def component_owners(direct: DataFrame, steps: DataFrame) -> DataFrame:
    """Owner of the features that reach an owned one over their references: feature_id, ad_id, at any depth.

    ``direct``: feature_id, ad_id; ``steps``: src_id, ref_no, target_id of features without a direct owner. The first
    reference of a feature that leads to an owner counts. A backward search by frontiers finds what leads to one; then
    each feature follows its one reference by doubling of pointers. Features whose first references run in a loop
    follow the shortest way out instead.
    """
    leads = cut_lineage(direct.select("feature_id", F.lit(0).alias("level")))
    frontier = leads
    for level in count(1):
        reached = steps.join(frontier.select(F.col("feature_id").alias("target_id")), "target_id", "left_semi").select(F.col("src_id").alias("feature_id")).distinct()
        frontier = cut_lineage(reached.join(leads, "feature_id", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        leads = leads.unionByName(frontier)
    place = F.struct("ref_no", "target_id")
    hops = cut_lineage(
        steps.join(leads.withColumnRenamed("feature_id", "target_id"), "target_id").groupBy(F.col("src_id").alias("feature_id"))
        .agg(F.min_by("target_id", place).alias("first"), F.min_by("target_id", F.struct("level", place)).alias("near"))
    )
    owners = direct.select(F.col("feature_id").alias("_ptr"), "ad_id")
    rounds = hops.count().bit_length() + 1

    def follow(way: str) -> DataFrame:
        now = cut_lineage(hops.select("feature_id", F.col(way).alias("_ptr")).join(owners, "_ptr", "left"))
        for _ in range(rounds):
            if now.filter(F.col("ad_id").isNull()).isEmpty():
                break
            ahead = now.select(F.col("feature_id").alias("_ptr"), F.col("_ptr").alias("_ptr2"), F.col("ad_id").alias("_ad2"))
            now = cut_lineage(
                now.join(ahead, "_ptr", "left").select("feature_id", F.coalesce("_ptr2", "_ptr").alias("_ptr"), F.coalesce("ad_id", "_ad2").alias("ad_id"))
            )
        return now.filter(F.col("ad_id").isNotNull()).select("feature_id", "ad_id")

    found = follow("first")
    looped = hops.join(found, "feature_id", "left_anti")
    return found if looped.isEmpty() else found.unionByName(follow("near").join(looped, "feature_id", "left_semi"))


def ownership(features: DataFrame, edges: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """Owning aerodrome of each feature: feature_id, ad_id, via.

    ``features``: feature_id, feature_type, subtype; ``edges`` (resolved references): src_id, src_type, prop, ref_no,
    target_id, target_type. The passes run in a fixed order and a feature keeps the first owner it gets; inside a pass
    the first reference of the feature that leads to an owner wins. ``positions`` (feature_id, lon, lat) serves the
    nearest-aerodrome rule of minimum sector altitudes and terminal holdings.
    """
    first = lambda c: F.min_by(c, F.struct("ref_no", "target_id"))
    direct = (
        edges.filter((F.col("target_type") == AERODROME) & (F.col("prop") != "specialDateAuthority"))
        .groupBy(F.col("src_id").alias("feature_id")).agg(first("target_id").alias("ad_id"))
    )
    chains = features.filter(
        F.col("feature_type").isin(*AERODROME_COMPONENTS, *EQUIPMENT, CHANNEL) | F.col("feature_type").startswith("45:")
    ).select("feature_id")
    steps = (
        edges.filter(F.col("target_type").isin(*[t for t in AERODROME_COMPONENTS if t != "Navaid"]))
        .join(chains.withColumnRenamed("feature_id", "src_id"), "src_id", "left_semi")
        .join(direct.select(F.col("feature_id").alias("src_id")), "src_id", "left_anti")
        .select("src_id", "ref_no", "target_id")
    )
    direct, steps = cut_lineage(direct), cut_lineage(steps)
    parts = component_owners(direct, steps).withColumn("via", F.lit("component"))
    pieces = [cut_lineage(direct.withColumn("via", F.lit("direct")).unionByName(parts))]

    def owned_now() -> DataFrame:
        out = pieces[0]
        for p in pieces[1:]:
            out = out.unionByName(p)
        return out

    def extend(found: DataFrame, via: str) -> None:
        fresh = found.join(owned_now().select("feature_id"), "feature_id", "left_anti").withColumn("via", F.lit(via))
        pieces.append(cut_lineage(fresh.select("feature_id", "ad_id", "via")))

    def of(key: str) -> DataFrame:
        return owned_now().select(F.col("feature_id").alias(key), "ad_id")

    rule = F.lit(False)
    for kind, prop in PASS_DOWN.items():
        rule = rule | ((F.col("src_type") == kind) & (F.col("prop") == prop))
    down = edges.filter(rule & (F.col("target_type") != AERODROME)).join(of("src_id"), "src_id")
    extend(down.groupBy(F.col("target_id").alias("feature_id")).agg(F.min_by("ad_id", F.struct("src_id", "ref_no")).alias("ad_id")), "passed down")
    providers = edges.filter(F.col("src_type").isin(*SERVICES) & (F.col("prop") == "serviceProvider")).join(of("target_id"), "target_id")
    extend(providers.groupBy(F.col("src_id").alias("feature_id")).agg(first("ad_id").alias("ad_id")), "provider")
    users = edges.filter(F.col("target_type") == CHANNEL).join(of("src_id"), "src_id")
    extend(users.groupBy(F.col("target_id").alias("feature_id")).agg(F.min_by("ad_id", "src_id").alias("ad_id")), "channel user")
    # procedure data: minimum sector altitudes, terminal arrival areas, terminal holdings
    areas = features.filter(F.col("feature_type").isin("SafeAltitudeArea", "TerminalArrivalArea"))
    holdings = features.filter((F.col("feature_type") == "HoldingPattern") & (F.col("subtype") == "TER"))
    both = areas.select("feature_id").unionByName(holdings.select("feature_id"))
    fixes = (
        edges.filter(F.col("src_type").isin(*LEGS) & F.col("prop").isin("startPoint", "endPoint")).join(of("src_id"), "src_id")
        .groupBy(F.col("target_id").alias("fix_id")).agg(F.min_by("ad_id", F.struct("src_id", "ref_no")).alias("ad_id"))
    )
    hold_points = edges.filter(F.col("prop") == "holdingPoint").join(
        holdings.select(F.col("feature_id").alias("src_id")), "src_id", "left_semi"
    )
    by_fix = hold_points.withColumnRenamed("target_id", "fix_id").join(fixes, "fix_id").groupBy(F.col("src_id").alias("feature_id")).agg(
        F.min_by("ad_id", "ref_no").alias("ad_id")
    )
    extend(by_fix, "fix of a leg")
    by_user = edges.join(both.withColumnRenamed("feature_id", "target_id"), "target_id", "left_semi").join(of("src_id"), "src_id")
    extend(by_user.groupBy(F.col("target_id").alias("feature_id")).agg(F.min_by("ad_id", "src_id").alias("ad_id")), "procedure")
    to_proc = edges.filter(F.col("target_type").isin(*PROCEDURES)).join(
        areas.select(F.col("feature_id").alias("src_id")), "src_id", "left_semi"
    ).join(of("target_id"), "target_id")
    extend(to_proc.groupBy(F.col("src_id").alias("feature_id")).agg(first("ad_id").alias("ad_id")), "procedure")
    if positions is not None:
        from .spatial import nearest

        centres = edges.filter(F.col("prop").startswith("centrePoint") | (F.col("prop") == "holdingPoint")).join(
            features.filter((F.col("feature_type") == "SafeAltitudeArea") | ((F.col("feature_type") == "HoldingPattern") & (F.col("subtype") == "TER")))
            .select(F.col("feature_id").alias("src_id")), "src_id", "left_semi"
        )
        points = centres.join(positions.withColumnRenamed("feature_id", "target_id"), "target_id").groupBy(
            F.col("src_id").alias("feature_id")
        ).agg(F.min_by(F.struct("lon", "lat"), "ref_no").alias("p")).select("feature_id", "p.lon", "p.lat")
        sites = features.filter(F.col("feature_type") == AERODROME).select(F.col("feature_id").alias("ad_id")).join(
            positions.withColumnRenamed("feature_id", "ad_id"), "ad_id"
        )
        near = nearest(points, sites, NEAREST_OWNER_NM, "feature_id", "ad_id").filter(F.col("distance_nm") < NEAREST_OWNER_NM)
        extend(near.select("feature_id", "ad_id"), "nearest")
    aerodromes = features.filter(F.col("feature_type") == AERODROME).select("feature_id")
    return owned_now().join(aerodromes, "feature_id", "left_anti")


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Seeds and everything they reference, with the referrer that brought it in: feature_id, referrer, depth.

    ``seeds``: feature_id; ``edges``: src_id, target_id. Each round writes its frontier, so a round is the most that is
    ever computed twice. It ends when a round reaches nothing new, however deep that is.
    """
    ftype = seeds.schema["feature_id"].dataType
    seen = cut_lineage(
        seeds.select("feature_id").distinct().withColumns({"referrer": F.lit(None).cast(ftype), "depth": F.lit(0)})
    )
    frontier = seen
    for depth in count(1):
        reached = (
            edges.join(frontier.select(F.col("feature_id").alias("src_id")), "src_id", "left_semi")
            .groupBy(F.col("target_id").alias("feature_id")).agg(F.min("src_id").alias("referrer"))
            .join(seen.select("feature_id"), "feature_id", "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier = cut_lineage(reached)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def missing_targets(members: DataFrame, refs: DataFrame, features: DataFrame) -> DataFrame:
    """References of a closure that name nothing in the data: ref and one referrer."""
    return (
        refs.join(members.select(F.col("feature_id").alias("src_id")), "src_id", "left_semi")
        .join(features.select(F.col("feature_id").alias("ref")), "ref", "left_anti")
        .groupBy("ref").agg(F.min("src_id").alias("referrer"))
    )


def chain_segments(segments: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str]) -> DataFrame:
    """Order segments head to tail: adds ``chain_no`` (from 0) and ``head`` (order value of the chain's first segment).

    A segment follows the one that ends where it starts; of several starting at one point only the first in ``order``
    continues a chain. List ranking by pointer doubling: the number of rounds grows with the logarithm of the longest
    chain, so one very long route costs rounds, not one task. Segments on a closed loop have no head; they keep
    chain_no null and their own order value.
    """
    place = F.struct(*order)
    starts = segments.groupBy(*keys, F.col(start).alias("_node")).agg(F.min(place).alias("_next"))
    ends = segments.select(*keys, F.col(end).alias("_node"), place.alias("_me"))
    # predecessor: of the segments ending at a point, the first one leads into the segment that starts there
    pred = ends.join(starts, [*keys, "_node"]).groupBy(*keys, "_next").agg(F.min("_me").alias("_ptr"))
    ranks = segments.select(*keys, place.alias("_me")).join(pred.withColumnRenamed("_next", "_me"), [*keys, "_me"], "left")
    ranks = cut_lineage(ranks.withColumn("_rank", F.when(F.col("_ptr").isNotNull(), 1).otherwise(0).cast("long")).withColumn("_head", F.coalesce("_ptr", "_me")))
    # a chain of n segments needs log2(n) rounds; what still points on after that lies on a loop
    for _ in range(segments.count().bit_length() + 1):
        if ranks.filter(F.col("_ptr").isNotNull()).isEmpty():
            break
        hop = ranks.select(*keys, F.col("_me").alias("_ptr"), F.col("_ptr").alias("_ptr2"), F.col("_rank").alias("_rank2"), F.col("_head").alias("_head2"))
        ranks = cut_lineage(
            ranks.join(hop, [*keys, "_ptr"], "left")
            .select(
                *keys, "_me", F.col("_ptr2").alias("_ptr"), (F.col("_rank") + F.coalesce("_rank2", F.lit(0))).alias("_rank"),
                F.coalesce("_head2", "_head").alias("_head"),
            )
        )
    done = ranks.select(
        *keys, *[F.col("_me")[o].alias(o) for o in order],
        F.when(F.col("_ptr").isNull(), F.col("_rank")).alias("chain_no"),
        F.when(F.col("_ptr").isNull(), F.col("_head")[order[0]]).otherwise(F.col("_me")[order[0]]).alias("head"),
    )
    return segments.join(done, [*keys, *order])


def harmonize_states(datasets: DataFrame) -> DataFrame:
    """A data set with a weak State guess takes the State of a strong one with the same location prefix.

    ``datasets``: dataset_id, dataset_order, prefix, state, strength (weak, code or strong).
    """
    # 'code': the State comes from location indicators; it leads other data sets but gives way to a strong one
    lead = datasets.filter(F.col("strength").isin("code", "strong") & F.col("prefix").isNotNull()).select(
        "prefix", F.col("state").alias("_state"), F.col("dataset_id").alias("_from"), F.col("dataset_order").alias("_order"),
        F.col("strength").alias("_strength"),
    )
    # of the leaders of one prefix, strength and State the first two decide: the second where the first is the data set itself
    group = ["prefix", "_strength", "_state"]
    lead = lead.groupBy(*group, "_from").agg(F.min("_order").alias("_order")).filter(F.col("_order").isNotNull())
    lead = top_k_per_key(lead, group, [F.col("_order"), F.col("_from")], 2, salts=4)
    cand = datasets.filter(F.col("strength") != "strong").join(lead, "prefix").filter(
        (F.col("_from") != F.col("dataset_id")) & (F.col("_state") != F.col("state"))
        & ((F.col("strength") == "weak") | (F.col("_strength") == "strong"))
    )
    best = cand.groupBy("dataset_id").agg(F.min_by(F.struct("_state", "_from"), "_order").alias("_b"))
    return (
        datasets.join(best, "dataset_id", "left")
        .withColumn("state_detected", F.col("state")).withColumn("state", F.coalesce("_b._state", "state"))
        .withColumn("state_from", F.col("_b._from")).drop("_b")
    )


def allocation(features: DataFrame, allowed: DataFrame) -> DataFrame:
    """Feature types that do not belong in the data set, with counts (``allowed``: feature_type)."""
    return features.groupBy("feature_type").agg(F.count(F.lit(1)).alias("n")).join(allowed, "feature_type", "left_anti")


def type_except(features: DataFrame, target_types: DataFrame) -> DataFrame:
    """Types of the data that the target version does not have."""
    return features.select("feature_type").distinct().exceptAll(target_types.select("feature_type").distinct())


def union_datasets(parts: Sequence[DataFrame]) -> DataFrame:
    """Several files or States as one table; columns only some parts have are null in the others."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def merge_states(parts: DataFrame, id_: str = "gml_id", part_no: str = "part_no", salts: int = 16) -> DataFrame:
    """Local ids that occur in several parts get the part number as suffix, except in the first part that has them."""
    first = parts.groupBy(id_).agg(F.min(part_no).alias("_first"))
    suffixed = F.when(F.col(part_no) > F.col("_first"), F.concat(F.col(id_), F.lit("_p"), F.col(part_no))).otherwise(F.col(id_))
    return parts.join(first, id_).withColumn("output_id", suffixed).drop("_first")


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keyed merge: a later row replaces and completes an earlier one; columns it leaves null keep their value."""
    both = existing.withColumn("_load", F.lit(0)).unionByName(new.withColumn("_load", F.lit(1)), allowMissingColumns=True)
    values = [c for c in both.columns if c not in (*keys, "_load")]
    return both.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_load"))).alias(c) for c in values])
