"""One history on two devices: imported session files matched with what was observed live, before either is dropped.

The surest rules go first (`resolution.device_rules`), then the boundaries of sessions and turns that lie close in time. A
row that two rules or two rows claim is an error, not a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrail.session import stored

from .resolution import device_rules, link_devices, unmatched

BOUNDARY, TURN = "transcript boundary within a live session", "the only turn near in time"


def _of(source: str, *kinds: str) -> Column:
    return (F.col("agent") == "claude-code") & (F.col("source") == source) & F.col("event_type").isin(*kinds) & F.col("session_id").isNotNull()


def boundaries(current: DataFrame, previous: DataFrame) -> DataFrame:
    """A file's start and the session's first live start; a file's end and the last live end, if that covers the file's.

    Live sessions have a boundary for each time that they were resumed, a file has one at each end.
    """
    kinds = ("session.start", "session.end")
    key = ["session_id", "event_type"]
    live = previous.filter(_of("hook", *kinds)).groupBy(*key).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last"), F.max("ts").alias("last_ts"))
    both = current.filter(_of("log", *kinds)).join(live.hint("merge"), key)
    start = F.col("event_type") == "session.start"
    covered = both.filter(start | (F.col("last_ts") >= F.col("ts")))
    return covered.select(F.col("event_id").alias("left_id"), F.when(start, F.col("first")).otherwise(F.col("last")).alias("right_id"), F.lit(BOUNDARY).alias("rule"))


def near_turns(current: DataFrame, previous: DataFrame, within_ms: int = 100, allowed: bool = True) -> DataFrame:
    """A file's turn and the exported one within `within_ms` of it, where each has only the other; else an error.

    Pairs that are alone on both sides keep their order: were two of them crossed, the earlier turn would have both exported
    ones near it. Times meet in spans of that length and their neighbours, so a session's turns aren't all compared.
    Without `allowed`, any turns that are near are an error: times alone aren't trusted then.
    """
    span = F.floor(F.col("ts") / within_ms)
    left = current.filter(_of("log", "turn")).select("session_id", F.col("event_id").alias("left_id"), F.col("ts").alias("left_ts"), span.alias("span"))
    right = previous.filter(_of("otel", "turn")).select("session_id", F.col("event_id").alias("right_id"), F.col("ts").alias("right_ts"), F.explode(F.sequence(span - 1, span + 1)).alias("span"))
    pairs = left.join(right.hint("merge"), ["session_id", "span"]).filter(F.abs(F.col("left_ts") - F.col("right_ts")) <= within_ms)
    of = lambda c: F.count("*").over(Window.partitionBy(c))
    pairs = pairs.withColumn("alone", (of("left_id") == 1) & (of("right_id") == 1) & F.lit(allowed))
    wrong = F.raise_error(F.concat(F.lit("unresolved turn in session "), "session_id")).cast("string")
    return pairs.select(F.when(F.col("alone"), F.col("left_id")).otherwise(wrong).alias("left_id"), "right_id", F.lit(TURN).alias("rule"))


def reconcile(current: DataFrame, previous: DataFrame, match_prompt_times: bool = False) -> DataFrame:
    """(left_id, right_id, rule) of imported rows and what was observed before; a row in two pairs is an error.

    Both sides have the columns of the event schema. Each rule reads both, so they are stored first.
    """
    current, previous = stored(current), stored(previous)
    found = link_devices(current, previous, device_rules(current.columns))
    found = found.unionByName(stored(boundaries(unmatched(current, found, "left_id"), previous)))
    found = found.unionByName(near_turns(unmatched(current, found, "left_id"), previous, allowed=match_prompt_times))
    twice = lambda c: F.count("*").over(Window.partitionBy(c)) > 1
    wrong = F.raise_error(F.concat(F.lit("two proposed counterparts of "), "left_id", F.lit(" or "), "right_id")).cast("string")
    return found.withColumn("twice", twice("left_id") | twice("right_id")).withColumn("left_id", F.when(F.col("twice"), wrong).otherwise(F.col("left_id"))).drop("twice")
