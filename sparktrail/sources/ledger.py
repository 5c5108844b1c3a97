"""A ledger of records by scope that is read in snapshots: what a version holds never changes, and a page counts whole or not at all.

Changes are appended as Parquet folders. A version is one small file that names the folders and each scope's cursor; it
comes into being by a rename that fails where another writer was faster. A reader takes the latest version and reads its
folders, whatever is written meanwhile.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .events import Conflict

CHANGES = "scope string, event_id string, deleted boolean, payload string, version long, sequence long"


@dataclass(frozen=True)
class Version:
    number: int = 0
    folders: tuple[str, ...] = ()
    cursors: dict[str, int] = field(default_factory=dict)


class Ledger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs

    def _path(self, *names: str):
        return self._fs.Path("/".join((self.folder, *names)))

    def latest(self) -> Version:
        versions = self._path("versions")
        fs = versions.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(versions)] if fs.exists(versions) else []
        numbers = [int(n) for n in names if n.isdigit()]
        return self.version(max(numbers)) if numbers else Version()

    def version(self, number: int) -> Version:
        text = self.spark.read.text(self._path("versions", f"{number:012}").toString(), wholetext=True).first()[0]
        found = json.loads(text)
        return Version(number, tuple(found["folders"]), found["cursors"])

    def _commit(self, new: Version) -> None:
        conf = self.spark._jsc.hadoopConfiguration()
        draft, final = self._path("versions", f".{uuid.uuid4().hex}"), self._path("versions", f"{new.number:012}")
        out = draft.getFileSystem(conf).create(draft, False)
        out.write(bytearray(json.dumps({"folders": new.folders, "cursors": new.cursors}).encode()))
        out.close()
        context = self._fs.FileContext.getFileContext(draft.getFileSystem(conf).getUri(), conf)
        nothing = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(final), nothing)  # without leave to overwrite
        except Exception as e:
            draft.getFileSystem(conf).delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {new.number} was committed by another writer") from e
            raise

    def _write(self, rows: DataFrame, number: int) -> str:
        name = f"changes/{number:012}-{uuid.uuid4().hex}"
        rows.withColumn("version", F.lit(number).cast("long")).select(*(c.split()[0] for c in CHANGES.split(", "))).write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return name

    def changes(self, at: Version | None = None) -> DataFrame:
        """All changes of a version, the latest by default."""
        at = self.latest() if at is None else at
        if not at.folders:
            return self.spark.createDataFrame([], CHANGES)
        return self.spark.read.schema(CHANGES).parquet(*(f"{self.folder}/{f}" for f in at.folders))

    def rows(self, at: Version | None = None) -> DataFrame:
        """(scope, event_id, payload): the last payload of each id; what was ever deleted stays deleted."""
        last = F.max_by("payload", F.when(~F.col("deleted"), F.struct("version", "sequence")))
        return self.changes(at).groupBy("scope", "event_id").agg(last.alias("payload"), F.bool_or("deleted").alias("gone")).filter("not gone").drop("gone")

    def tombstones(self, at: Version | None = None) -> DataFrame:
        return self.changes(at).filter("deleted").select("scope", "event_id").distinct()

    def apply_page(self, scope: str, start: int, through: int, page: DataFrame) -> Version:
        """A page (sequence, event_id, deleted, payload) of a remote scope, and its cursor, as one new version.

        The page must go on from the scope's cursor `start`; its sequences are used once and lie after it and up to `through`.
        An empty page moves the cursor only. Of the changes of an id the last counts, and a deletion for ever.
        """
        old = self.latest()
        if not scope or scope == "local":
            raise ValueError("invalid remote scope")
        if old.cursors.get(scope, 0) != start or through < start:
            raise Conflict(f"stale cursor: {scope} is at {old.cursors.get(scope, 0)}, not at {start}")
        seen = page.agg(F.count("*").alias("n"), F.count_distinct("sequence").alias("distinct"), F.min("sequence").alias("low"), F.max("sequence").alias("high")).first()
        if seen["n"] != seen["distinct"] or (seen["n"] and not start < seen["low"] <= seen["high"] <= through):
            raise Conflict(f"unordered page after {start}")
        name = [self._write(page.withColumn("scope", F.lit(scope)), old.number + 1)] if seen["n"] else []
        new = Version(old.number + 1, (*old.folders, *name), old.cursors | {scope: through})
        self._commit(new)
        return new

    def record(self, rows: DataFrame) -> Version:
        """Local records (event_id, payload). Replays add nothing; one that differs from what is recorded is a conflict."""
        old = self.latest()
        once = rows.select("event_id", "payload").distinct()
        mine = self.rows(old).filter("scope = 'local'").select("event_id", F.col("payload").alias("_old"))
        both = once.groupBy("event_id").agg(F.count("*").alias("n"), F.first("payload").alias("payload")).join(mine, "event_id", "left")
        wrong = both.filter((F.col("n") > 1) | (F.col("payload") != F.col("_old"))).limit(1).collect()
        if wrong:
            raise Conflict(f"event {wrong[0]['event_id']} differs from what was recorded")
        fresh = both.filter("_old is null").select("event_id", "payload", F.lit("local").alias("scope"), F.lit(False).alias("deleted"), F.lit(0).cast("long").alias("sequence"))
        new = Version(old.number + 1, (*old.folders, self._write(fresh, old.number + 1)), old.cursors)
        self._commit(new)
        return new

    def import_history(self, rows: DataFrame, name: str) -> Version:
        """Records (event_id, payload) of an older store, once for each name: the mark and the records come in one version.

        Of several records of an id one counts, the smallest payload; ids that are recorded already stay as they are, as what
        was observed goes before what is imported. A record without an id is an error.
        """
        old, mark = self.latest(), f"imported {name}"
        if mark in old.cursors:
            return old
        if not rows.filter(F.coalesce(F.col("event_id"), F.lit("")) == "").isEmpty():
            raise Conflict("a record of the history has no id")
        known = self.rows(old).filter("scope = 'local'").select("event_id")
        once = rows.groupBy("event_id").agg(F.min("payload").alias("payload")).join(known, "event_id", "left_anti")
        fresh = once.select("event_id", "payload", F.lit("local").alias("scope"), F.lit(False).alias("deleted"), F.lit(0).cast("long").alias("sequence"))
        new = Version(old.number + 1, (*old.folders, self._write(fresh, old.number + 1)), old.cursors | {mark: 1})
        self._commit(new)
        return new

    def compact(self) -> Version:
        """A version with the same rows and tombstones in one folder. Older versions keep theirs until their owner deletes them."""
        old = self.latest()
        alive = self.rows(old).withColumn("deleted", F.lit(False))
        dead = self.tombstones(old).withColumns({"deleted": F.lit(True), "payload": F.lit(None).cast("string")})
        name = self._write(alive.unionByName(dead).withColumn("sequence", F.lit(0).cast("long")), old.number + 1)
        new = Version(old.number + 1, (name,), old.cursors)
        self._commit(new)
        return new
