"""Distributed ranks and prefix sums within groups, without a task that holds a whole group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task orders at a time, about.
ROWS_A_BUCKET = 20_000


def buckets_for(rows: int) -> int:
    return max(1, math.ceil(rows / ROWS_A_BUCKET))


def running_total(df: DataFrame, group: str, order: list[str], value: Column, buckets: int, out: str) -> DataFrame:
    """Add `out`: the sum of value over the rows of the same group that come before this one.

    order[0] must be a uniformly distributed 64-bit key: its range is cut into `buckets` slices, so that a group with
    a third of all rows is spread over that many tasks. Slices are summed first, their totals are accumulated within
    the group (at most `buckets` rows), and rows are ordered only within their slice. Groups may be null.
    """
    bucket, base, v = f"{out}_bucket", f"{out}_base", f"{out}_value"
    cut = F.least(F.floor((F.col(order[0]).cast("double") / F.lit(2.0**64) + 0.5) * buckets), F.lit(buckets - 1)).cast("int")
    df = df.withColumns({bucket: cut if buckets > 1 else F.lit(0), v: value.cast("long")})
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = df.groupBy(group, bucket).agg(F.sum(v).alias(base)).withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    bases = bases.select(F.col(group).alias(f"{out}_g"), F.col(bucket).alias(f"{out}_b"), base)
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(bases, df[group].eqNullSafe(bases[f"{out}_g"]) & (df[bucket] == bases[f"{out}_b"]), "left")
    return joined.withColumn(out, F.col(base) + F.coalesce(F.sum(v).over(within), F.lit(0))).drop(bucket, base, v, f"{out}_g", f"{out}_b")
