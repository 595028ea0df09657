"""A step boundary for long column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later filters and expressions refer to instead of repeating their arithmetic.

    Catalyst moves filters below projections by copying the expressions into them; chains of trigonometry grow out of
    hand that way. One row exploded to one row keeps the values computed once, inside the same stage. The values are a
    projection of their own: where a stage is too long to be compiled as a whole, what stands inside the explode is
    walked as a tree for every row.
    """
    values = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    kept = [c for c in df.columns if c not in columns]
    # the outer kind, because for the other one Spark asks the size of the array, all its values again
    made = df.select(*kept, values.alias("_made")).select(*kept, F.explode_outer("_made").alias("_settled"))
    return made.select(*kept, *[F.col("_settled")[n].alias(n) for n in columns])
