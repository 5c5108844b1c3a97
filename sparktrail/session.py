"""Sessions with the settings that the engine relies on, and the package's code for workers that lack it."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a method beyond which the JVM only interprets it. Wide projections are split into smaller methods instead.
JIT_LIMIT = "8000"
PACKAGE = Path(__file__).resolve().parent
#: Rows that one task sorts at a time, about.
ROWS_A_TASK = 100_000
_shipped: set[str] = set()


def session(name: str = "sparktrail", **settings: str) -> SparkSession:
    """UTC, adaptive execution, generated methods of a size that the JVM still compiles; other settings as given."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.codegen.hugeMethodLimit", JIT_LIMIT)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the workers once per application, unless PYTHONPATH leads them to it."""
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if PACKAGE.parent in paths or app in _shipped:
        return
    with tempfile.TemporaryDirectory() as folder:
        staged = Path(folder) / "code"
        shutil.copytree(PACKAGE, staged / PACKAGE.name, ignore=shutil.ignore_patterns("__pycache__"))
        for extra in PACKAGE.parent.glob("corpus_pipeline.py"):
            shutil.copy(extra, staged)
        target = tempfile.mkdtemp(prefix="sparktrail-code-")
        archive = shutil.make_archive(f"{target}/sparktrail_code", "zip", staged)
    spark.sparkContext.addPyFile(archive)  # served by the driver to every executor
    _shipped.add(app)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's checkpoint folder, which all executors share (spark.checkpoint.dir).

    A cluster must have it; in local mode a temporary one stands in.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sparktrail-"))
    return f"{context.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df worked out once and read back from the session's checkpoint folder, which cuts its lineage."""
    path = shared_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(df: DataFrame) -> int:
    """How many tasks df's rows are dealt to, so that a task sorts about ROWS_A_TASK of them, whatever their number.

    Left to itself, adaptive execution joins partitions until there are as many as cores, or each has 64 MB compressed; rows
    that are sorted several times then take a share of the input's size in each task.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))
