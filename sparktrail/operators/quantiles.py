"""Approximate quantiles from sketches: one a day and name, merged over any range of days, beside the exact ones.

A KLL sketch of parameter k keeps about 3 k values; its rank error is about 1.33 % for k = 200 and falls as 1 / k. Sketches of
few values are exact. Days are sketched once; a range reads a row per day and name, however many events there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import tool_results

K = 200


def daily_sketches(e: DataFrame, by: str = "tool_name", value: str = "duration_ms", k: int = K) -> DataFrame:
    """(dt, <by>, n, least, most, sketch) of tool results, each counted once; unknown names and values don't count."""
    rows = tool_results(e).filter(F.col(by).isNotNull() & F.col(value).isNotNull())
    v = F.col(value).cast("long")
    return rows.groupBy("dt", by).agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.kll_sketch_agg_bigint(v, k).alias("sketch"))


def over_days(daily: DataFrame, first: str, last: str, by: str = "tool_name", at: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(<by>, n, p50, p95, ...) over the days from first to last, from their sketches alone."""
    merged = daily.filter(F.col("dt").between(first, last)).groupBy(by).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return merged.select(by, "n", *(F.kll_sketch_get_quantile_bigint("sketch", F.lit(p)).alias(f"p{round(100 * p)}") for p in at))


def exact_over_days(e: DataFrame, first: str, last: str, by: str = "tool_name", value: str = "duration_ms", at: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """The same from the events: the value at rank ceil(p n), which is what sketches approximate.

    A result is counted on the day of the row that stands for it; so results are told apart within each day, as in sketches.
    """
    rows = tool_results(e.filter(F.col("dt").between(first, last))).filter(F.col(by).isNotNull() & F.col(value).isNotNull())
    return rows.groupBy(by).agg(F.count("*").alias("n"), *(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)").cast("long").alias(f"p{round(100 * p)}") for p in at))
