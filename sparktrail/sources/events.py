"""Event tables: day-partitioned Parquet, ledgers of JSON payloads, spooled hook calls, landed log exports."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sparktrail.functions.columns import day_of
from sparktrail.schema import BODIES, COLUMNS, EVENT_SCHEMA, conform, empty_events


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Our own day-partitioned table; days are pruned by directory. An absent table is empty, not an error."""
    try:
        return conform(spark.read.schema(EVENT_SCHEMA).parquet(folder))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty_events(spark)
        raise


def read_foreign_events(spark: SparkSession, folder: str) -> DataFrame:
    """A file set of unknown origin under dt=*: the day within the files counts, whatever the directories say."""
    try:
        return conform(spark.read.schema(EVENT_SCHEMA).parquet(f"{folder.rstrip('/')}/dt=*/*.parquet"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty_events(spark)
        raise


def read_shared_events(spark: SparkSession, folder: str) -> DataFrame:
    """A file set that others write to: only files of plain names in directories that are days are read."""
    try:
        files = spark.read.schema(EVENT_SCHEMA).parquet(f"{folder.rstrip('/')}/dt=*/*.parquet")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty_events(spark)
        raise
    # the path is asked for in the scan, which leaves out whole files: no list of them comes to the driver
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    day = F.regexp_extract(path, _KEY.pattern, 1)
    return conform(files.filter((day != "") & F.try_to_date(day).isNotNull() & ~path.rlike(r"(^|/)\.\.(/|$)")))


_KEY = re.compile(r"(?:^|/)dt=(\d{4}-\d{2}-\d{2})/[A-Za-z0-9._-]+\.parquet$")


def valid_key(key: str) -> bool:
    """dt=<a day>/<a plain name>.parquet, and no path that climbs."""
    found = _KEY.search(key)
    if not found or ".." in key.split("/"):
        return False
    try:
        date.fromisoformat(found[1])
    except ValueError:
        return False
    return True


def from_ledger(ledger: DataFrame) -> DataFrame:
    """Typed events from rows (scope, event_id, payload as JSON); unknown fields are ignored."""
    return ledger.select("scope", F.from_json("payload", EVENT_SCHEMA).alias("e")).select("scope", "e.*")


def write_events(events: DataFrame, folder: str, mode: str = "append") -> None:
    events.write.mode(mode).partitionBy("dt").option("compression", "zstd").parquet(folder)


def masked(events: DataFrame) -> DataFrame:
    """Without bodies, and with repositories cleaned of user information: what may be shared."""
    from sparktrail.functions.scalars import repository

    return events.withColumns({c: F.lit(None).cast("string") for c in BODIES} | {"repo": repository(F.col("repo"))})


def missing_from(events: DataFrame, existing: DataFrame) -> DataFrame:
    """Events whose id isn't in the table yet, once each."""
    return events.dropDuplicates(["event_id"]).join(existing.select("event_id"), "event_id", "left_anti").select(*events.columns)


class Conflict(ValueError):
    """A replay that differs from what was recorded."""


def differing(new: dict, old: dict) -> list[str]:
    return [c for c in COLUMNS if new[c] != old[c]]


def checked_inserts(events: DataFrame, existing: DataFrame) -> DataFrame:
    """New events; an identical replay adds nothing, one that differs is an error that names the fields."""
    once = events.dropDuplicates(COLUMNS)
    twice = once.groupBy("event_id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise Conflict(f"event {twice[0]['event_id']} was sent with different contents")
    old = existing.select(F.col("event_id").alias("_id"), F.struct(*COLUMNS).alias("_old"))
    both = once.join(old, F.col("event_id") == F.col("_id"))
    fields = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_old.{c}")), F.lit(c)) for c in COLUMNS)))
    changed = both.select("event_id", fields.alias("fields")).filter(F.size("fields") > 0).limit(1).collect()
    if changed:
        raise Conflict(f"event {changed[0]['event_id']} differs in {', '.join(changed[0]['fields'])}")
    return missing_from(once, existing)


def rekeyed(events: DataFrame) -> DataFrame:
    """Log metadata of the second agent under ids of their content, once each: its ordinals can be absent or used twice."""
    from sparktrail.functions.scalars import content_id

    meant = (F.col("agent") == "codex") & (F.col("source") == "log") & F.col("event_type").isin("session.start", "turn", "api.request")
    record = F.struct(*(F.col(c) for c in sorted(COLUMNS) if c != "event_id"))
    new = F.when(meant, content_id(F.col("host_id"), F.col("source"), F.col("event_type"), record)).otherwise(F.col("event_id"))
    out = events.withColumn("event_id", new).dropDuplicates(COLUMNS)
    twice = out.groupBy("event_id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise Conflict(f"event {twice[0]['event_id']} would stand for different contents")
    return out


def next_cursor(page: DataFrame, cursor: int) -> int:
    """The cursor after a page was applied; an empty page leaves it."""
    return page.agg(F.coalesce(F.max("sequence"), F.lit(cursor)).alias("x")).first()["x"]


def apply_changes(ledger: DataFrame, tombstones: DataFrame, page: DataFrame, cursor: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A page of remote changes (scope, sequence, event_id, deleted, payload): the last one of an id counts, deletions stay.

    With a cursor, every sequence of the page must be given, used once and lie beyond it. Returns the new ledger and
    tombstones.
    """
    if cursor is not None:
        seen = page.agg(F.count("*").alias("n"), F.count_distinct("sequence").alias("distinct"), F.min("sequence").alias("low")).first()
        if seen["n"] != seen["distinct"] or (seen["n"] and seen["low"] <= cursor):
            raise Conflict(f"the page doesn't continue from {cursor}")
    last = page.groupBy("scope", "event_id").agg(F.max_by(F.struct("deleted", "payload"), "sequence").alias("x"), F.bool_or("deleted").alias("gone"))
    stones = tombstones.unionByName(last.filter("gone").select("scope", "event_id")).distinct()
    fresh = last.filter("not gone").select("scope", "event_id", F.col("x.payload").alias("payload"))
    kept = ledger.join(last.select("scope", "event_id"), ["scope", "event_id"], "left_anti").unionByName(fresh)
    return kept.join(stones, ["scope", "event_id"], "left_anti").select("scope", "event_id", "payload"), stones


def day_column(events: DataFrame) -> DataFrame:
    return events.withColumn("dt", day_of(F.col("ts")))


def read_export(spark: SparkSession, folder: str, start: str, end: str) -> DataFrame:
    """Events of the days from start to end."""
    return read_events(spark, folder).filter(F.col("dt").between(start, end))


def write_export(spark: SparkSession, folder: str, target: str, start: str, end: str) -> tuple[int, int]:
    """Write the events of the days from start to end to a new folder; its rows and columns."""
    if start > end:
        raise ValueError("the first day lies after the last")
    read_export(spark, folder, start, end).write.mode("error").partitionBy("dt").option("compression", "zstd").parquet(target)
    written = read_events(spark, target)  # counted from the footers of what was written
    return written.count(), len(written.columns)
