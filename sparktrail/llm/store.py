"""Materialising intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a temporary one in local mode only: elsewhere executors can't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sparktrail-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Drops a query's shuffle files when it has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, and a lost executor costs nothing.

    Once it is written, the shuffles that made it are of no use and go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "6").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, *columns: str) -> DataFrame:
    """(row, doc): docs, or these columns of it, as one struct each with a number, written once.

    Operators that read documents more than once tell rows with null or repeated ids apart by it. Spark numbers rows by
    split, and splits change with the settings and the executors at hand; a written number doesn't.
    """
    some = [F.col(f"`{c}`") for c in (columns or docs.columns)]
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*some).alias("doc")), "rows")
