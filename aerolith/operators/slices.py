"""Time slices of features: ordering, deduplication, state at a moment, changes inside a delivery.

A slice row has the feature keys, an interpretation (BASELINE, SNAPSHOT, PERMDELTA, TEMPDELTA), sequence and correction
numbers, a validity and a lifetime, its position in the delivery and ``props``, a MAP of top-level property to value
text. Aggregates with map-side combine are used wherever the result allows, so a feature with very many slices does not
end up in one task; where order matters the ordered scan splits it by day.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import col
from ..session import cut_lineage
from .ordered import OrderedScan, Running

EPOCH = "1970-01-01 00:00:00"
LOAD_DAY_MIN = 30
LOAD_DAY_SHARE = 0.3


@dataclass(frozen=True)
class SliceColumns:
    keys: Sequence[str] = ("dataset_id", "feature_id")
    interp: str = "interp"
    seq: str = "seq"
    corr: str = "corr"
    begin: str = "valid_begin"
    end: str = "valid_end"
    life_begin: str = "life_begin"
    life_end: str = "life_end"
    position: Sequence[str] = ("file_no", "slice_no")
    props: str = "props"
    extra: Sequence[str] = field(default=())

    def begin_or_epoch(self) -> Column:
        return F.coalesce(F.col(self.begin), F.lit(EPOCH).cast("timestamp"))

    def order(self) -> list[Column]:
        """Validity begin, sequence, correction; the position in the delivery settles ties."""
        return [self.begin_or_epoch(), F.col(self.seq), F.col(self.corr), *[F.col(p) for p in self.position]]

    def order_key(self) -> Column:
        return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(self.order())])

    def position_key(self) -> Column:
        return F.struct(*[F.col(p) for p in self.position])

    def is_temp(self) -> Column:
        return F.coalesce(F.col(self.interp), F.lit("")) == "TEMPDELTA"

    def is_delta(self) -> Column:
        return F.coalesce(F.col(self.interp), F.lit("")) == "PERMDELTA"

    def day(self) -> Column:
        return F.date_trunc("day", self.begin_or_epoch())

    def scan(self) -> OrderedScan:
        return OrderedScan(self.keys, self.order(), self.day())


def order_slices(slices: DataFrame, c: SliceColumns = SliceColumns(), out: str = "slice_order") -> DataFrame:
    """Number the slices of each feature by (begin, sequence, correction)."""
    return c.scan().row_number(slices, out)


def dedupe_slices(slices: DataFrame, c: SliceColumns = SliceColumns()) -> DataFrame:
    """The same slice delivered twice is kept once; the first in delivery order wins."""
    key = [*c.keys, c.interp, c.seq, c.corr, c.begin, c.end]
    rest = [x for x in slices.columns if x not in key]
    first = slices.groupBy(*key).agg(F.min_by(F.struct(*rest), c.position_key()).alias("_r"))
    return first.select(*[x if x in key else F.col("_r")[x].alias(x) for x in slices.columns])


def _state_heads(slices: DataFrame, t: Column | None, c: SliceColumns) -> DataFrame:
    """One row per feature: the chosen slice, the last slice that replaces everything, and what to do otherwise."""
    facts = F.struct(
        c.order_key().alias("ord"), F.col(c.interp).alias("interp"), F.col(c.begin).alias("begin"),
        F.col(c.end).alias("end"), F.col(c.seq).alias("seq"), F.col(c.corr).alias("corr"),
        F.col(c.life_begin).alias("life_begin"), F.col(c.life_end).alias("life_end"),
    )
    perm = ~c.is_temp()
    begun = F.lit(True) if t is None else F.col(c.begin).isNull() | (F.col(c.begin) <= t)
    heads = slices.groupBy(*c.keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(perm).alias("_n_perm"),
        F.max(F.when(perm & begun, facts)).alias("_chosen"),
        F.max(F.when(perm & begun & ~c.is_delta(), c.order_key())).alias("_reset"),
        F.min(F.when(perm, facts)).alias("_first_perm"),
        F.min_by(facts, c.position_key()).alias("_first_any"),
    )
    single = (F.col("_n") == 1) & (F.col("_n_perm") == 1)
    return (
        heads.withColumn("_single", single)
        .withColumn("future", ~single & F.col("_chosen").isNull())
        .withColumn("_pick", F.coalesce(F.when(single, F.col("_first_perm")), F.col("_chosen"), F.col("_first_perm"), F.col("_first_any")))
    )


@dataclass(frozen=True)
class ResolvedState:
    state: DataFrame  # one row per feature: the chosen slice and its flags
    values: DataFrame  # one row per feature and top-level property: keys, prop, value

    def as_map(self, keys: Sequence[str]) -> DataFrame:
        """State rows with the properties gathered in one MAP (as many entries as a feature has properties)."""
        props = self.values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("prop", "value"))).alias("props"))
        return self.state.join(props, list(keys), "left")


def resolve_at(slices: DataFrame, t=None, c: SliceColumns = SliceColumns()) -> ResolvedState:
    """State of each feature at ``t`` (null: the latest).

    The last permanent slice begun at ``t`` counts; PERMDELTAs after the last full slice replace single top-level
    properties; TEMPDELTAs in force at ``t`` come on top, in delivery order. A feature with one permanent slice is
    returned as it is. A feature with nothing begun yet gets its first slice, flagged ``future``.
    """
    at = None if t is None else col(t).cast("timestamp") if not isinstance(t, str) else F.lit(t).cast("timestamp")
    heads = _state_heads(slices, at, c)
    ended = F.lit(False) if at is None else F.coalesce(~F.col("_single") & ~F.col("future") & (F.col("_pick.end") <= at), F.lit(False))
    marks = heads.select(*c.keys, "_single", "future", "_pick", "_reset")
    joined = slices.join(marks, list(c.keys))
    in_force = (
        F.lit(False)
        if at is None
        else c.is_temp() & ~F.col("_single") & ~F.col("future")
        & (F.col(c.begin).isNull() | (F.col(c.begin) <= at)) & (F.col(c.end).isNull() | (F.col(c.end) > at))
    )
    ord_ = c.order_key()
    picked = ord_ == F.col("_pick.ord")
    chain = ~c.is_temp() & (ord_ <= F.col("_pick.ord")) & (F.col("_reset").isNull() | (ord_ >= F.col("_reset")))
    used = F.when(F.col("_single") | F.col("future"), picked).otherwise(chain | in_force)
    rank = F.struct(
        in_force.cast("int").alias("r0"), F.when(~in_force, ord_).alias("r1"), c.position_key().alias("r2")
    )
    contributing = joined.filter(used).withColumn("_rank", rank).withColumn("_temp", in_force)
    values = (
        contributing.select(*c.keys, "_rank", F.explode(c.props).alias("prop", "value"))
        .groupBy(*c.keys, "prop").agg(F.max_by("value", "_rank").alias("value"))
    )
    temps = contributing.groupBy(*c.keys).agg(F.count_if("_temp").alias("n_temp"))
    state = (
        heads.withColumn("ended", ended)
        .select(
            *c.keys, F.col("_pick.interp").alias("interp"), F.col("_pick.seq").alias("seq"), F.col("_pick.corr").alias("corr"),
            F.col("_pick.begin").alias("valid_begin"), F.col("_pick.end").alias("valid_end"),
            F.col("_pick.life_begin").alias("life_begin"), F.col("_pick.life_end").alias("life_end"), "future", "ended",
        )
        .join(temps, list(c.keys), "left")
        .withColumn("n_temp", F.coalesce("n_temp", F.lit(0)).cast("long"))
    )
    return ResolvedState(state, values)


def withdrawn(slices: DataFrame, t=None, c: SliceColumns = SliceColumns()) -> DataFrame:
    """Keys and ``gone``: the lifetime ended, or the chosen slice ended and no permanent slice follows, by ``t``.

    With ``t`` null the moment is the latest begin of any permanent slice of the data.
    """
    given = None if t is None else F.lit(t).cast("timestamp") if isinstance(t, str) else col(t)
    heads = _state_heads(slices, given, c).select(*c.keys, "_pick")
    if given is None:
        latest = slices.filter(~c.is_temp()).agg(F.max(c.begin).alias("m"))
        moment = latest.scalar()
    else:
        moment = given
    later = slices.join(heads, list(c.keys)).groupBy(*c.keys).agg(
        F.max(
            F.when(~c.is_temp() & (c.order_key() != F.col("_pick.ord")) & (c.begin_or_epoch() <= moment), c.begin_or_epoch())
        ).alias("_later"),
        F.any_value("_pick").alias("_pick"),
    )
    ended = (F.col("_pick.end") <= moment) & ~F.coalesce(F.col("_later") >= F.col("_pick.end"), F.lit(False))
    gone = F.coalesce(F.col("_pick.life_end") <= moment, F.lit(False)) | F.coalesce(ended, F.lit(False))
    return later.select(*c.keys, gone.alias("gone"))


def load_days(slices: DataFrame, c: SliceColumns = SliceColumns(), dataset: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Days on which a large share of the single-slice features begins: an initial load, not amendments."""
    singles = (
        slices.groupBy(*c.keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.any_value(c.interp).alias("_i"), F.any_value(c.begin).alias("_b"))
        .filter((F.col("_n") == 1) & (F.col("_i") == "BASELINE") & F.col("_b").isNotNull())
    )
    by_day = singles.groupBy(*dataset, F.to_date("_b").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    totals = by_day.groupBy(*dataset).agg(F.sum("n").alias("singles"))
    joined = by_day.join(totals, list(dataset)) if dataset else by_day.withColumn("singles", F.lit(None))
    return joined.filter(F.col("n") > F.greatest(F.lit(float(LOAD_DAY_MIN)), F.col("singles") * LOAD_DAY_SHARE))


def _with_resets(slices: DataFrame, c: SliceColumns) -> DataFrame:
    """Permanent slices with ``nth`` (place), ``reset_no`` (full slices so far) and the numbers of the slice before.

    Several steps read it, so it is written once to the shared checkpoint folder.
    """
    perm = slices.filter(~c.is_temp())
    return cut_lineage(
        c.scan().compute(
            perm,
            running={"nth": Running("count"), "reset_no": Running("sum", F.when(c.is_delta(), 0).otherwise(1))},
            previous={"p_seq": F.col(c.seq), "p_corr": F.col(c.corr)},
        )
    )


def _field_changes(perm: DataFrame, c: SliceColumns) -> DataFrame:
    keys, pos = list(c.keys), list(c.position)
    full = ~c.is_delta()
    long = perm.select(
        *keys, *pos, *{x for x in (c.begin, c.seq, c.corr)}, "nth", "reset_no", full.alias("is_full"),
        F.explode(c.props).alias("prop", "value"),
    )
    both = OrderedScan([*keys, "prop"], c.order(), c.day()).compute(
        long,
        previous={"p_value": F.col("value"), "p_reset": F.col("reset_no")},
        following={"n_reset": F.col("reset_no"), "n_full": F.col("is_full")},
    )
    state_before = F.when(F.col("is_full"), F.col("reset_no") - 1).otherwise(F.col("reset_no"))
    old = F.when(F.col("p_reset") == state_before, F.col("p_value"))
    is_change = ~(F.col("is_full") & (F.col("nth") == 1)) & ~old.eqNullSafe(F.col("value"))
    stays = (F.col("n_reset") == F.col("reset_no")) | ((F.col("n_reset") == F.col("reset_no") + 1) & F.col("n_full"))
    # one pass: the change a row makes, and the removal the next full slice makes of it
    outcomes = F.array(
        F.struct(is_change.alias("hit"), old.alias("old"), F.col("value").alias("new"), F.lit(None).cast("long").alias("gone_at")),
        F.struct(
            (~F.coalesce(stays, F.lit(False))).alias("hit"), F.col("value").alias("old"), F.lit(None).cast("string").alias("new"),
            (F.col("reset_no") + 1).cast("long").alias("gone_at"),
        ),
    )
    rows = both.select(*keys, *pos, "prop", F.explode(outcomes).alias("o")).filter("o.hit").select(*keys, *pos, "prop", "o.*")
    resets = perm.filter(full).select(*keys, *[F.col(p).alias(f"_{p}") for p in pos], F.col("reset_no").cast("long").alias("gone_at"))
    placed = rows.join(resets, [*keys, "gone_at"], "left").filter(F.col("gone_at").isNull() | F.col(f"_{pos[0]}").isNotNull())
    return placed.select(
        *keys, *[F.when(F.col("gone_at").isNull(), F.col(p)).otherwise(F.col(f"_{p}")).alias(p) for p in pos], "prop", "old", "new"
    )


def permanent_field_changes(slices: DataFrame, c: SliceColumns = SliceColumns()) -> DataFrame:
    """Changed top-level properties of every permanent slice against the state just before it.

    A property lives until it is set again or until the next full slice leaves it out; comparing each value with its
    neighbour in (feature, property) order therefore gives every change without building the state of each slice.
    Columns: keys, position, prop, old, new. The first full slice of a feature is its start, not a change.
    """
    return _field_changes(_with_resets(slices, c), c)


def _temporary_fields(slices: DataFrame, perm: DataFrame, c: SliceColumns) -> DataFrame:
    """Properties of the TEMPDELTAs with the permanent value in force; ``no_base`` where nothing is."""
    keys, pos = list(c.keys), list(c.position)
    temp = slices.filter(c.is_temp())
    stamp = lambda df, kind: df.withColumn("_at", c.begin_or_epoch()).withColumn("_kind", F.lit(kind))
    cols = [*keys, *pos, "_at", "_kind", c.seq, c.corr]
    order = [F.col("_at"), F.col("_kind"), F.col(c.seq), F.col(c.corr), *[F.col(p) for p in pos]]
    segment = F.date_trunc("day", F.col("_at"))
    nothing = F.lit(None).cast("long")
    # the empty property stands for the slice itself: its running reset tells which full slice is in force
    whole = F.map_concat(F.col(c.props), F.create_map(F.lit(""), F.lit("")))
    timeline = stamp(perm, 0).select(*cols, F.col("reset_no").cast("long").alias("reset_no"), F.explode(whole).alias("prop", "value")).unionByName(
        stamp(temp, 1).select(*cols, nothing.alias("reset_no"), F.explode(whole).alias("prop", "value"))
    )
    merged = OrderedScan([*keys, "prop"], order, segment).compute(
        timeline, running={"_base": Running("last", F.when(F.col("_kind") == 0, F.struct("value", "reset_no")))}
    ).filter(F.col("_kind") == 1)
    in_force = merged.filter(F.col("prop") == "").select(*keys, *pos, F.col("_base.reset_no").alias("_reset"))
    return (
        merged.filter(F.col("prop") != "").join(in_force, [*keys, *pos])
        .withColumn("old", F.when(F.col("_base.reset_no") == F.col("_reset"), F.col("_base.value")))
        .select(*keys, *pos, "prop", "old", F.col("value").alias("new"), F.col("_reset").isNull().alias("no_base"))
    )


def base_for_temporary(slices: DataFrame, c: SliceColumns = SliceColumns(), others: DataFrame | None = None) -> DataFrame:
    """Properties of each TEMPDELTA with the value they replace.

    The base is the feature's own permanent state at the begin of the temporary slice, else the latest value of the
    same feature id in ``others`` (long rows: feature id, prop, value). Columns: keys, position, prop, old, new.
    """
    out = _temporary_fields(slices, _with_resets(slices, c), c)
    if others is not None:
        id_ = c.keys[-1]
        foreign = others.select(F.col(id_), "prop", F.col("value").alias("_other"))
        out = out.join(foreign, [id_, "prop"], "left").withColumn("old", F.coalesce("old", F.when(F.col("no_base"), F.col("_other"))))
    return out.select(*c.keys, *c.position, "prop", "old", "new")


def in_file_changes(slices: DataFrame, c: SliceColumns = SliceColumns(), dataset: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Everything a delivery says about change, one row per change event.

    Columns: keys, position, kind, from, to, n_fields, same (a full slice that repeats the state before it) and
    initial_load: a single full slice that begins on a day of an initial load, so is no amendment.
    """
    keys, pos = list(c.keys), list(c.position)
    perm = _with_resets(slices, c)
    fields = _field_changes(perm, c).groupBy(*keys, *pos).agg(F.count(F.lit(1)).alias("n_fields"))
    facts = slices.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(c.life_end).alias("_le"))
    last_order = perm.groupBy(*keys).agg(F.max("nth").alias("_last"))
    zero = F.coalesce(F.col("n_fields"), F.lit(0)).cast("long")
    no_ts, no = F.lit(None).cast("timestamp"), F.lit(0).cast("long")
    out_cols = lambda k, frm, to, n, same: [
        *keys, *pos, k.alias("kind"), frm.alias("from"), to.alias("to"), n.alias("n_fields"), same.alias("same"), F.lit(False).alias("initial_load"),
    ]
    # 1. permanent slices after the first
    kind = (
        F.when(c.is_delta(), "Permanent change (PERMDELTA)")
        .when((F.col("p_seq") == F.col(c.seq)) & (F.col(c.corr) > F.col("p_corr")), "Correction")
        .otherwise("Permanent change (new BASELINE)")
    )
    permanent = (
        perm.filter((F.col("nth") > 1) | c.is_delta()).join(fields, [*keys, *pos], "left")
        .select(*out_cols(kind, F.col(c.begin), F.col(c.end), zero, (F.col(c.interp) == "BASELINE") & (zero == 0)))
    )
    # 2. temporary slices
    temp_fields = _temporary_fields(slices, perm, c).filter(~F.col("old").eqNullSafe(F.col("new"))).groupBy(*keys, *pos).agg(
        F.count(F.lit(1)).alias("n_fields")
    )
    temporary = slices.filter(c.is_temp()).join(temp_fields, [*keys, *pos], "left").select(
        *out_cols(F.lit("Temporary change (TEMPDELTA)"), F.col(c.begin), F.col(c.end), zero, F.lit(False))
    )
    # 3. single full slices: new or amended features; those of an initial-load day carry the flag
    single = (
        slices.join(facts.filter(F.col("_n") == 1), keys, "left_semi")
        .filter((F.col(c.interp) == "BASELINE") & F.col(c.life_end).isNull() & F.col(c.begin).isNotNull())
        .withColumn("day", F.to_date(c.begin))
        .join(load_days(slices, c, dataset).select(*dataset, "day").distinct().withColumn("_load", F.lit(True)), [*dataset, "day"], "left")
    )
    new = F.when(F.coalesce(F.col(c.life_begin) == F.col(c.begin), F.lit(False)), "New feature").otherwise("Amended (new baseline)")
    singles = single.select(*out_cols(new, F.col(c.begin), no_ts, no, F.lit(False)), "_load")
    singles = singles.withColumn("initial_load", F.coalesce("_load", F.lit(False))).drop("_load")
    # 4. end of life on the last permanent slice
    dead = perm.join(last_order, keys).filter((F.col("nth") == F.col("_last")) & F.col(c.life_end).isNotNull()).select(
        *out_cols(F.lit("Feature withdrawn (end of life)"), F.col(c.life_end), no_ts, no, F.lit(False))
    )
    # 5. the last validity ended and nothing follows, where no end of life is given at all
    ended = (
        perm.filter(F.col(c.end).isNotNull())
        .groupBy(*keys).agg(F.max_by(F.struct(*pos, F.col(c.end).alias("_e")), F.struct(F.col(c.end), F.negative(F.col("nth")))).alias("_x"))
        .join(facts.filter(F.col("_le").isNull()), keys, "left_semi")
        .join(withdrawn(slices, None, c).filter("gone"), keys, "left_semi")
        .select(*keys, *[F.col("_x")[p].alias(p) for p in pos], F.lit("Feature withdrawn (validity ended)").alias("kind"),
                F.col("_x._e").alias("from"), no_ts.alias("to"), no.alias("n_fields"), F.lit(False).alias("same"), F.lit(False).alias("initial_load"))
    )
    return permanent.unionByName(temporary).unionByName(singles).unionByName(dead).unionByName(ended)


def baseline_overlaps(slices: DataFrame, c: SliceColumns = SliceColumns()) -> DataFrame:
    """Features whose BASELINEs repeat a (sequence, correction) or overlap in validity, with counts of both."""
    base = slices.filter(F.col(c.interp) == "BASELINE")
    repeated = (
        base.groupBy(*c.keys, c.seq, c.corr).agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*c.keys).agg(F.sum(F.col("_n") - 1).alias("n_repeated"))
    )
    forever = F.lit("9999-12-31 00:00:00").cast("timestamp")
    open_end = F.coalesce(F.col(c.end), forever)
    seen = c.scan().running(base, _max_end=Running("max", open_end, inclusive=False))
    overlaps = seen.groupBy(*c.keys).agg(F.count_if(c.begin_or_epoch() < F.col("_max_end")).alias("n_overlapping"))
    return repeated.join(overlaps, list(c.keys)).filter((F.col("n_repeated") > 0) | (F.col("n_overlapping") > 0))


def aerodrome_effective(slices: DataFrame, owner: DataFrame, c: SliceColumns = SliceColumns(), ad: str = "ad_id") -> DataFrame:
    """Latest slice begin over an aerodrome and the features it owns."""
    return slices.join(owner, list(c.keys)).groupBy(ad).agg(F.max(c.begin).alias("effective"))
