"""One row for each tool result and each priced request, whatever observed it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precedence(*sources: str) -> Column:
    """0 for the first source named, 1 for the next, and so on; unnamed ones last."""
    out = F.lit(len(sources))
    for k, s in reversed(list(enumerate(sources))):
        out = F.when(F.col("source") == s, k).otherwise(out)
    return out


def is_first_observation() -> Column:
    """Over all events: true for the row that stands for its tool result; null key rows stand for themselves.

    otel goes before hook before others, then the earliest.
    """
    is_result = F.col("event_type") == "tool.result"
    key = F.coalesce("correlation_key", F.concat(F.lit("\0"), "event_id"))
    order = Window.partitionBy("session_id", key, is_result).orderBy(precedence("otel", "hook"), "ts", "event_id")
    return is_result & (F.row_number().over(order) == 1)


def tool_results(e: DataFrame) -> DataFrame:
    key = F.coalesce("correlation_key", F.concat(F.lit("\0"), "event_id"))
    order = Window.partitionBy("session_id", key).orderBy(precedence("otel", "hook"), "ts", "event_id")
    return e.filter("event_type = 'tool.result'").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def without_result_copies(e: DataFrame) -> DataFrame:
    """All events, tool results once."""
    return e.filter("event_type <> 'tool.result'").unionByName(tool_results(e))


def preferred_usage(e: DataFrame) -> DataFrame:
    """API requests of each session's best source: otel, else log, else others. A null session is one group."""
    requests = e.filter("event_type = 'api.request'").withColumn("_p", precedence("otel", "log"))
    # a minimum adds up before the shuffle; sessions grow with the log, so they are merged and never sent whole by the driver
    best = requests.groupBy(F.col("session_id").alias("_s")).agg(F.min("_p").alias("_best"))
    return requests.join(best.hint("merge"), F.col("session_id").eqNullSafe(F.col("_s")) & (F.col("_p") == F.col("_best"))).drop("_p", "_best", "_s")


def latest_by_id(e: DataFrame) -> DataFrame:
    """One row per event_id, the latest; a missing id is an error."""
    checked = e.withColumn("event_id", F.when(F.col("event_id").isNull(), F.raise_error(F.lit("missing event id")).cast("string")).otherwise(F.col("event_id")))
    order = Window.partitionBy("event_id").orderBy(F.col("ts").desc_nulls_last())
    return checked.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
