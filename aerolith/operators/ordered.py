"""Ordered (window) computations that stay balanced when one key holds a large share of the rows.

A plain window sends every row of a key to one task. Here rows are ordered inside (key, segment) groups, where a
segment is a coarse prefix of the ordering (an hour, a day, a hundred sequence numbers), and only one summary row per
(key, segment) travels to the key level. The segment must be monotone in the ordering: all rows of an earlier segment
come before all rows of a later one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Running:
    """A running aggregate: sum, count, max, min, last or first (ignoring nulls) of a column."""

    fn: str
    column: Column | None = None
    inclusive: bool = True  # with the current row; False: only rows before it


class OrderedScan:
    """Running values and neighbours of rows in key order.

    ``keys`` partition the rows, ``order`` (ascending) is total inside a key, ``segment`` is a monotone coarse prefix
    of it. One call of ``compute`` costs one shuffle of the rows and one small join, however many outputs it has.
    """

    def __init__(self, keys: Sequence[str], order: Sequence[Column], segment: Column):
        self.keys, self.order, self.segment = list(keys), list(order), segment

    def compute(
        self,
        df: DataFrame,
        running: dict[str, Running] | None = None,
        previous: dict[str, Column] | None = None,
        following: dict[str, Column] | None = None,
    ) -> DataFrame:
        """Adds running aggregates, values of the row before and values of the row after, by name."""
        running, previous, following = running or {}, previous or {}, following or {}
        df = df.withColumn("_segment", self.segment)
        inside = Window.partitionBy(*self.keys, "_segment").orderBy(*self.order)
        segments = Window.partitionBy(*self.keys).orderBy("_segment")
        earlier = segments.rowsBetween(Window.unboundedPreceding, -1)
        place = F.struct(*self.order)
        local: dict[str, Column] = {}
        summary: list[Column] = []
        carried: dict[str, Column] = {}
        merged: dict[str, Column] = {}
        for name, r in running.items():
            frame = inside.rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1)
            value = r.column if r.column is not None else F.lit(1)
            here, before = F.col(f"_l_{name}"), F.col(f"_c_{name}")
            if r.fn in ("sum", "count"):
                agg = F.sum if r.fn == "sum" else F.count
                local[name] = agg(value).over(frame)
                summary.append(agg(value).alias(f"_s_{name}"))
                carried[name] = F.sum(f"_s_{name}").over(earlier)
                total = F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
                merged[name] = F.when(here.isNotNull() | before.isNotNull(), total)
            elif r.fn in ("max", "min"):
                agg = F.max if r.fn == "max" else F.min
                local[name] = agg(value).over(frame)
                summary.append(agg(value).alias(f"_s_{name}"))
                carried[name] = agg(f"_s_{name}").over(earlier)
                merged[name] = (F.greatest if r.fn == "max" else F.least)(here, before)
            elif r.fn in ("last", "first"):
                pick, fn = (F.max_by, F.last) if r.fn == "last" else (F.min_by, F.first)
                local[name] = fn(value, ignorenulls=True).over(frame)
                summary.append(pick(value, F.when(value.isNotNull(), place)).alias(f"_s_{name}"))
                carried[name] = fn(f"_s_{name}", ignorenulls=True).over(earlier)
                merged[name] = F.coalesce(here, before) if r.fn == "last" else F.coalesce(before, here)
            else:
                raise ValueError(r.fn)
        if previous:
            row = F.struct(*[c.alias(n) for n, c in previous.items()])
            local["prev"] = F.lag(row).over(inside)
            summary.append(F.max_by(row, place).alias("_s_prev"))
            carried["prev"] = F.lag("_s_prev").over(segments)
            merged.update({n: F.coalesce(F.col("_l_prev"), F.col("_c_prev"))[n] for n in previous})
        if following:
            row = F.struct(*[c.alias(n) for n, c in following.items()])
            local["next"] = F.lead(row).over(inside)
            summary.append(F.min_by(row, place).alias("_s_next"))
            carried["next"] = F.lead("_s_next").over(segments)
            merged.update({n: F.coalesce(F.col("_l_next"), F.col("_c_next"))[n] for n in following})
        level = [*self.keys, "_segment"]
        carry = (
            df.groupBy(*level).agg(*summary)
            .select(*level, *[e.alias(f"_c_{n}") for n, e in carried.items()])
            .withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(level)})
        )
        rows = df.withColumns({f"_l_{n}": c for n, c in local.items()})
        on = None
        for i, k in enumerate(level):
            same = F.col(k).eqNullSafe(F.col(f"_k{i}"))
            on = same if on is None else on & same
        drop = [f"_k{i}" for i in range(len(level))] + [f"_l_{n}" for n in local] + [f"_c_{n}" for n in carried] + ["_segment"]
        return rows.join(carry, on, "left").withColumns(merged).drop(*drop)

    def running(self, df: DataFrame, **outputs: Running) -> DataFrame:
        return self.compute(df, running=outputs)

    def previous(self, df: DataFrame, **columns: Column) -> DataFrame:
        return self.compute(df, previous=columns)

    def row_number(self, df: DataFrame, name: str = "rn") -> DataFrame:
        return self.compute(df, running={name: Running("count")})


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salts: int = 32, spread: Column | None = None) -> DataFrame:
    """The first k rows of each key: k per (key, salt) first, then k of those, so no key sits in one task."""
    salt = F.pmod(F.xxhash64(*( [spread] if spread is not None else df.columns)), F.lit(salts))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= k)
        .withColumn("_rn", F.row_number().over(final)).filter(F.col("_rn") <= k)
        .drop("_salt", "_rn")
    )


def number_repeats(df: DataFrame, key: str, order: Sequence[str], out: str, segment: Column | None = None) -> DataFrame:
    """Repeated keys get ~2, ~3 … in the given order; single rows keep the key."""
    scan = OrderedScan([key], [F.col(c) for c in order], segment if segment is not None else F.lit(0))
    numbered = scan.row_number(df, "_nth")
    return numbered.withColumn(
        out, F.when(F.col("_nth") > 1, F.concat(F.col(key), F.lit("~"), F.col("_nth"))).otherwise(F.col(key))
    ).drop("_nth")
