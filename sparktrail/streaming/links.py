"""Links in streams: a later contradiction takes back what an earlier link had moved."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrail.operators.resolution import FACTS, resolve_links
from sparktrail.sources.events import read_events

from .ingest import writer


def linker(events_folder: str, facts_folder: str, resolved_folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over events and facts (links, rejections, observed clients).

    Events and facts are recorded as they come, each with its own identity. Then the days that the batch can change are
    resolved anew, from their events and all facts, and replace what the resolved table had of them: the days of its
    events, and those of earlier events that one of its facts speaks of. Facts are few beside events. A batch that comes
    again gives the same days again.
    """
    record_events, record_facts = writer(events_folder, lambda x: x), writer(facts_folder, lambda x: x)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            facts = batch.filter(F.col("event_type").isin(*FACTS))
            events = batch.filter(~F.col("event_type").isin(*FACTS))
            record_facts(facts, batch_id)
            record_events(events, batch_id)
            stored = read_events(spark, events_folder)
            spoken = facts.select("host_id", F.when(F.col("event_type") == "message.usage.link", F.col("parent_session_id")).otherwise(F.col("session_id")).alias("session_id")).distinct()
            days = events.select("dt").union(stored.join(spoken, ["host_id", "session_id"], "left_semi").select("dt")).distinct()
            touched = [r["dt"] for r in days.collect()]  # days, of which there are few
            if touched:
                some = stored.filter(F.col("dt").isin(touched)).unionByName(read_events(spark, facts_folder))
                out = resolve_links(some).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
                out.partitionBy("dt").parquet(resolved_folder)
        finally:
            batch.unpersist()

    return write
