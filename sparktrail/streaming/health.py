"""Health of the collecting streams, from their own progress reports."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

BEATS = "collector string, ts long, rows long, error string"
#: A collector that was silent for longer isn't running.
SILENT_MS = 30_000


class Heartbeats(StreamingQueryListener):
    """Keeps the last report of each stream; register it with spark.streams.addListener."""

    def __init__(self):
        self.last: dict[str, tuple] = {}
        self.names: dict[str, str] = {}  # some events carry a stream's id only

    def _beat(self, name: str, rows: int | None = None, error: str | None = None) -> None:
        self.last[name] = (name, int(time.time() * 1000), rows, error)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.names[str(event.id)] = event.name or str(event.id)
        self._beat(self.names[str(event.id)])

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self._beat(event.progress.name or str(event.progress.id), event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._beat(self.names.get(str(event.id), str(event.id)))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._beat(self.names.get(str(event.id), str(event.id)), error=event.exception)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.last.values()), BEATS)


def collector_health(expected: DataFrame, beats: DataFrame, now_ms: int, silent_ms: int = SILENT_MS) -> DataFrame:
    """(collector, status, last_ts, issue) of each expected collector: never_seen, failed, silent or healthy, the worst first."""
    last = beats.groupBy("collector").agg(F.max_by(F.struct("ts", "error"), "ts").alias("b")).select("collector", "b.*")
    out = expected.select("collector").distinct().join(last, "collector", "left")
    status = F.when(F.col("ts").isNull(), "never_seen").when(F.col("error").isNotNull(), "failed").when(now_ms - F.col("ts") > silent_ms, "silent").otherwise("healthy")
    issue = F.when(status == "failed", F.col("error")).when(status == "silent", F.concat(F.lit("no report for "), F.floor((now_ms - F.col("ts")) / 1000).cast("string"), F.lit(" s")))
    rank = F.array_position(F.array(*map(F.lit, ("never_seen", "failed", "silent", "healthy"))), status)
    return out.select("collector", status.alias("status"), F.col("ts").alias("last_ts"), issue.alias("issue"), rank.alias("_r")).orderBy("_r", "collector").drop("_r")
