"""Identity over all days: an index of event ids, so that a replay is found on whatever day it was stored.

The index is a small Parquet table (event_id, dt, digest), in directories by a hash of the id. A batch reads the directories
of its own ids and not the events. Files are sorted by id and carry Bloom filters, which help look-ups of few ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sparktrail.schema import COLUMNS

from .events import Conflict, differing, read_events

SCHEMA = "event_id string, dt string, digest string, bucket int"


def digest() -> Column:
    """Of all columns of an event, nulls included."""
    return F.sha2(F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"}), 256)


class IdIndex:
    """The index at `folder`, dealt over `buckets` directories; one writer at a time. The number must stay as it was."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 256):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("event_id"), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame | None:
        """None where there is no index yet."""
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.folder)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def found(self, events: DataFrame) -> DataFrame:
        """(event_id, dt, digest) of the events that the index has, from the directories that they can be in."""
        have = self.read()
        ids = events.select("event_id").distinct().withColumn("bucket", self._bucket())
        if have is None:
            return self.spark.createDataFrame([], SCHEMA).drop("bucket")
        touched = [r["bucket"] for r in ids.select("bucket").distinct().collect()]  # at most as many as there are
        return have.filter(F.col("bucket").isin(touched)).join(ids, ["bucket", "event_id"]).select("event_id", "dt", "digest").distinct()

    def add(self, events: DataFrame) -> None:
        """Ids that aren't in the index, one file a directory."""
        known = self.found(events).select("event_id")
        new = events.dropDuplicates(["event_id"]).join(known, "event_id", "left_anti").select("event_id", "dt", digest().alias("digest"), self._bucket().alias("bucket"))
        self._write(new, self.folder, "append")

    def _write(self, rows: DataFrame, folder: str, mode: str) -> None:
        dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "event_id")
        dealt.write.mode(mode).partitionBy("bucket").option("compression", "zstd").option("parquet.bloom.filter.enabled#event_id", "true").parquet(folder)

    def rebuild(self, events: DataFrame) -> None:
        """From the events themselves: for a table that has none yet, or whose writer was lost with its checkpoint."""
        self._write(events.select("event_id", "dt", digest().alias("digest"), self._bucket().alias("bucket")).distinct(), self.folder, "overwrite")

    def compacted(self, folder: str) -> IdIndex:
        """The same index in another folder, with a file a directory."""
        if (have := self.read()) is not None:
            self._write(have.distinct(), folder, "overwrite")
        return IdIndex(self.spark, folder, self.buckets)

    def check(self, events: DataFrame, events_folder: str) -> None:
        """An event that is stored on another day is a contradiction: the error names the fields, read from that day alone."""
        old = self.found(events).select(F.col("event_id").alias("_id"), F.col("dt").alias("_dt"))
        moved = events.join(old, (F.col("event_id") == F.col("_id")) & (F.col("dt") != F.col("_dt"))).limit(1).drop("_id").collect()
        if moved:
            event = moved[0]
            stored = read_events(self.spark, events_folder).filter((F.col("dt") == event["_dt"]) & (F.col("event_id") == event["event_id"])).first()
            fields = ["ts", "dt"] if stored is None else differing(event.asDict(), stored.asDict())
            raise Conflict(f"event {event['event_id']} differs in {', '.join(fields)}")
