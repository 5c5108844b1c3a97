"""Ingestion by Structured Streaming: spooled hook calls, log exports and session files into the event table.

Sources are at-least-once; the writer is idempotent. Each micro-batch is checked against what the table has: replays add
nothing, contradictions fail the batch before it is acknowledged, and the checkpoint moves on only after the write.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparktrail.functions import normalize
from sparktrail.schema import required
from sparktrail.sources.events import checked_inserts, read_events, write_events
from sparktrail.sources.identity import IdIndex

Normaliser = Callable[[DataFrame], DataFrame]


def spool(spark: SparkSession, folder: str, files_at_once: int = 1000, archive: str | None = None) -> DataFrame:
    """(name, body) of each spooled file; files whose names start with a dot are still being written."""
    reader = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", "[!.]*.json")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("name"), F.col("value").alias("body"))


def session_files(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """(file, line_no, line) of closed session files; .zst files are decoded by Spark's codec."""
    reader = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", True)
    texts = reader.load(folder).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file"), F.split("value", "\n").alias("lines"))
    return texts.select("file", F.posexplode("lines").alias("line_no", "line")).filter("line <> ''")


def settled(files: DataFrame, now_ms: int, quiet_ms: int = 60_000, most_ms: int = 600_000) -> DataFrame:
    """Of (file, modified_ms, waiting_since_ms), those to be read now: untouched for a minute, or waited for ten.

    Session files are read after the exports that they complete, so a file that still grows waits, but not for ever.
    """
    return files.filter((now_ms - F.col("modified_ms") >= quiet_ms) | (now_ms - F.col("waiting_since_ms") >= most_ms))


def writer(events_folder: str, normalise: Normaliser, rejects_folder: str | None = None, ids_folder: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: normalise, check, append. Bodies that aren't JSON go to the rejects.

    A batch is compared with the days that it touches, and with the index of ids for all others. Events are written before
    their ids: a batch that failed in between comes again, finds its rows in its days, and adds their ids then. A table
    without an index gets one first.
    """
    ids_folder = ids_folder or f"{events_folder.rstrip('/')}_ids"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            if rejects_folder and "body" in batch.columns:
                bad = batch.filter(F.try_parse_json("body").isNull())
                if not bad.isEmpty():
                    bad.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(rejects_folder)
            events = required(normalise(batch)).persist()
            index = IdIndex(spark, ids_folder)
            if index.read() is None:
                index.rebuild(read_events(spark, events_folder))
            index.check(events, events_folder)
            days = [r["dt"] for r in events.select("dt").distinct().collect()]  # a batch's days are few; they prune the table
            known = read_events(spark, events_folder).filter(F.col("dt").isin(days))
            fresh = checked_inserts(events, known)
            if not fresh.isEmpty():
                write_events(fresh, events_folder)
            index.add(events)
            events.unpersist()
        finally:
            batch.unpersist()

    return write


def start(stream: DataFrame, events_folder: str, checkpoint: str, normalise: Normaliser, seconds: int = 30, once: bool = False, rejects_folder: str | None = None) -> StreamingQuery:
    out = stream.writeStream.foreachBatch(writer(events_folder, normalise, rejects_folder)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=f"{seconds} seconds")).start()


def hook_events(host: str, agent: str = "claude-code") -> Normaliser:
    return lambda raw: normalize.hooks(raw, host, agent)


def final_days(events: DataFrame, delay: str = "72 hours") -> DataFrame:
    """Per day, kind and session source: event counts that are emitted once, when the day ended that long ago."""
    timed = events.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", delay)
    return timed.groupBy(F.window("at", "1 day").alias("day"), "event_type", "source").agg(F.count("*").alias("events"), F.sum("input_tokens").alias("input_tokens"))


def deduplicated(events: DataFrame, horizon: str = "1 hour") -> DataFrame:
    """A prefilter for replays that come soon; the writer's check has no horizon."""
    return events.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", horizon).dropDuplicatesWithinWatermark(["event_id"]).drop("at")


_READ_ONLY = re.compile(r"^\s*(?:--[^\n]*\n\s*)*(select|with|values)\b", re.I)
#: Functions that call any method of the virtual machine.
_REACHING_OUT = re.compile(r"\b(?:reflect|try_reflect|java_method)\b", re.I)


def run_query(spark: SparkSession, text: str, **views: DataFrame) -> DataFrame:
    """One read-only statement of at most 65,536 bytes over the given views and nothing else.

    The text must also stand as a subquery, where the grammar has neither inserts nor commands, whatever they begin with.
    Every relation that the parser finds in it must be a view or a name that the query itself defines, so that neither files
    nor other tables are read; functions that reach out of SQL are refused, also where only their name is written.
    """
    if len(text.encode()) > 65_536 or not _READ_ONLY.match(text):
        raise ValueError("a single query is expected")
    if found := _REACHING_OUT.search(text):
        raise ValueError(f"{found[0]} isn't allowed")
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(f"SELECT * FROM (\n{text}\n)").toString()
    except ParseException as e:
        raise ValueError("a single query is expected") from e
    own = {name.strip().lower() for names in re.findall(r"\bCTE \[([^\]]*)\]", parsed) for name in names.split(",")}
    for name in re.findall(r"'UnresolvedRelation \[([^\n]*?)\], \[", parsed):
        if name.lower() not in own | {v.lower() for v in views}:
            raise ValueError(f"{name} isn't a view")
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)


def json_rows(query: DataFrame) -> DataFrame:
    """Each row of a query as one JSON object; nulls are kept."""
    return query.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in query.columns)), {"ignoreNullFields": "false"}).alias("row"))
