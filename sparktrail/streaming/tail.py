"""Session files that are still being written: a stream of their complete lines, and normalisers with state per file."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparktrail.functions.carry import Carried

#: Bytes that are looked at together when line ends are counted, and that a batch of rows is made of.
CHUNK = 4 << 20
HEAD = 4096


@dataclass
class Span(InputPartition):
    """Bytes of a file that hold complete lines; the number of the first; whether the file is read anew, and is complete."""

    path: str
    name: str
    begin: int
    end: int
    line_no: int
    restart: bool
    closed: bool


class TailReader(DataSourceStreamReader):
    """Offsets: for each file the bytes and lines up to its last line end, a hash of its first line, and whether it is closed.

    They tell what to read without any memory of the process: a file that is shorter than it was, or begins otherwise, is
    read from its beginning. What was counted is kept only to save reading it again.
    """

    def __init__(self, options: dict):
        self.fs, self.root = pafs.FileSystem.from_uri(options["path"]) if "://" in options["path"] else (pafs.LocalFileSystem(), options["path"])
        self.suffix = options.get("suffix", ".jsonl")
        self.quiet_s = float(options["quietSeconds"]) if "quietseconds" in {k.lower() for k in options} else None
        self.counted: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = self.fs.get_file_info(pafs.FileSelector(self.root, recursive=True, allow_not_found=True))
        out = {}
        for info in found:
            if info.type == pafs.FileType.File and info.path.endswith(self.suffix) and not info.base_name.startswith("."):
                out[info.path] = self._complete(info)
        self.counted = out
        return out

    def _complete(self, info: pafs.FileInfo) -> list:
        with self.fs.open_input_file(info.path) as f:
            size = f.size()
            head = f.read(min(size, HEAD)).split(b"\n", 1)
            head = hashlib.md5(head[0]).hexdigest() if len(head) == 2 or size >= HEAD else ""  # noqa: S324
            begin, lines, *_ = known if (known := self.counted.get(info.path)) and known[2] == head and known[0] <= size else (0, 0)
            at, last = begin, begin
            f.seek(at)
            while chunk := f.read(min(CHUNK, size - at)):
                lines += chunk.count(b"\n")
                if (k := chunk.rfind(b"\n")) >= 0:
                    last = at + k + 1
                at += len(chunk)
        closed = self.quiet_s is not None and last == size and info.mtime_ns is not None and time.time() - info.mtime_ns / 1e9 >= self.quiet_s
        return [last, lines, head, closed]

    def partitions(self, start: dict, end: dict) -> list[Span]:
        out = []
        for path, (to, _, head, closed) in sorted(end.items()):
            begin, lines, old_head, was_closed = start.get(path) or (0, 0, None, False)
            restart = old_head != head or to < begin
            if restart:
                begin, lines, was_closed = 0, 0, False
            if to > begin or (closed and not was_closed and to):
                out.append(Span(path, path.removeprefix(self.root).lstrip("/"), begin, to, lines, restart, closed and not was_closed))
        return out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        p, line_no, restart = partition, partition.line_no, partition.restart

        def batch(texts: list[str | None]) -> pa.RecordBatch:
            nonlocal line_no, restart
            numbers = range(line_no, line_no + len(texts))
            columns = [pa.array([p.name] * len(texts)), pa.array(numbers, pa.int64()), pa.array(texts, pa.string()), pa.array([restart and k == 0 for k in range(len(texts))])]
            line_no, restart = line_no + len(texts), False
            return pa.RecordBatch.from_arrays(columns, ["file", "line_no", "line", "restart"])

        with self.fs.open_input_file(p.path) as f:
            f.seek(p.begin)
            at, rest = p.begin, b""
            while at < p.end and (chunk := f.read(min(CHUNK, p.end - at))):
                at += len(chunk)
                whole, newline, rest = (rest + chunk).rpartition(b"\n")
                if newline:
                    yield batch([x.decode(errors="replace") for x in whole.split(b"\n")])
        if p.closed:
            yield batch([None])


class Tail(DataSource):
    """`spark.readStream.format("tail")`: (file, line_no, line, restart) of the complete lines of the files below `path`.

    Options: path (a folder or URI of a file system that all executors see), suffix, quietSeconds. A line without an end waits
    for it. After `quietSeconds` without a change a file is given one row with a null line: it is complete, as far as known.
    `restart` marks the first row of a file that is read from its beginning.
    """

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, line_no long, line string, restart boolean"

    def streamReader(self, schema: T.StructType) -> TailReader:
        return TailReader(self.options)


def open_files(spark: SparkSession, folder: str, suffix: str = ".jsonl", quiet_seconds: float | None = None) -> DataFrame:
    spark.dataSource.register(Tail)
    reader = spark.readStream.format("tail").option("path", folder).option("suffix", suffix)
    return (reader if quiet_seconds is None else reader.option("quietSeconds", str(quiet_seconds))).load()


def _row(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(c, kind) for c, kind in kinds.items()])


class _Carrier(StatefulProcessor):
    """Per file: the latest and first facts, the keys that were seen, and the definitions that later lines refer to."""

    def __init__(self, spec: Carried):
        self.spec = spec
        self.texts = [*(f"last_{c}" for c in dict.fromkeys((*spec.last, *spec.previous))), *(f"first_{c}" for c in spec.first)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        text, number = T.StringType(), T.LongType()
        self.facts = handle.getValueState("facts", _row(**dict.fromkeys(self.texts, text), from_ts=number, to_ts=number, ended=T.BooleanType()))
        self.seen = handle.getMapState("seen", _row(key=text), _row(at=number))
        self.defined = handle.getMapState("defined", _row(id=text), _row(name=text, ts=number))

    def _definition(self, id_: str) -> dict | None:
        found = self.defined.getValue((id_,)) if self.defined.containsKey((id_,)) else None
        return found and {"name": found[0], "ts": found[1]}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        spec = self.spec
        x = pd.concat(list(rows)).sort_values("line_no", kind="stable")  # what was added to one file since the last batch
        if x["restart"].any():
            for state in (self.facts, self.seen, self.defined):
                state.clear()
        old = self.facts.get() if self.facts.exists() else None
        now = dict(zip(self.texts, old, strict=False)) if old is not None else dict.fromkeys(self.texts)
        from_ts, to_ts, ended = old[len(self.texts) :] if old is not None else (None, None, False)
        out = []
        for r in x.to_dict("records"):
            new = {}
            for c in spec.previous:
                new[f"previous_{c}"] = now[f"last_{c}"]
            ts = None if pd.isna(r["ts"]) else int(r["ts"])
            new["begins"] = ts is not None and from_ts is None
            if ts is not None:
                from_ts, to_ts = ts if from_ts is None else min(from_ts, ts), ts if to_ts is None else max(to_ts, ts)
            for c in dict.fromkeys((*spec.last, *spec.previous)):
                if isinstance(r[c], str):
                    now[f"last_{c}"] = r[c]
            for c in spec.first:
                if isinstance(r[c], str) and now[f"first_{c}"] is None:
                    now[f"first_{c}"] = r[c]
            new |= {f"last_{c}": now[f"last_{c}"] for c in spec.last} | {f"first_{c}": now[f"first_{c}"] for c in spec.first}
            if spec.fresh:
                new["fresh"] = isinstance(r[spec.fresh], str) and not self.seen.containsKey((r[spec.fresh],))
                if new["fresh"]:
                    self.seen.updateValue((r[spec.fresh],), (int(r["line_no"]),))
            if spec.named:
                given, asked = (r[c] if r[c] is not None else [] for c in spec.named)
                for d in given:
                    if d["id"] is not None and not self.defined.containsKey((d["id"],)):
                        self.defined.updateValue((d["id"],), (d["name"], None if pd.isna(d["ts"]) else int(d["ts"])))
                new["known"] = {i: d for i in asked if i is not None and (d := self._definition(i)) is not None}
            new["ended"] = r["line"] is None and not ended
            ended = ended or r["line"] is None
            out.append({"file": key[0], "line_no": r["line_no"], "line": r["line"], "from_ts": from_ts, "to_ts": to_ts, **new})
        self.facts.update((*(now[c] for c in self.texts), from_ts, to_ts, ended))
        frame = pd.DataFrame(out)
        for c in ("from_ts", "to_ts"):
            frame[c] = frame[c].astype("Int64")
        yield frame[self.columns(spec)]

    @staticmethod
    def columns(spec: Carried) -> list[str]:
        return [f.name for f in _carried_type(spec)]

    def close(self) -> None:
        pass


def _carried_type(spec: Carried) -> T.StructType:
    text, number, flag = T.StringType(), T.LongType(), T.BooleanType()
    carried = [*(f"last_{c}" for c in spec.last), *(f"previous_{c}" for c in spec.previous), *(f"first_{c}" for c in spec.first)]
    more = {"fresh": flag} if spec.fresh else {}
    if spec.named:
        more["known"] = T.MapType(text, _row(name=text, ts=number))
    return _row(file=text, line=text, **dict.fromkeys(carried, text), line_no=number, from_ts=number, to_ts=number, begins=flag, ended=flag, **more)


def by_state(lines: DataFrame, spec: Carried) -> DataFrame:
    """For streams of `open_files` with facts: file, line_no, line and the carried columns.

    State per file, in the state store of the checkpoint: a restarted query goes on where it was. Facts must be worked out
    again from the line afterwards. Needs the RocksDB state store, see `state_store`.
    """
    facts = list(dict.fromkeys((*spec.last, *spec.previous, *spec.first, *((spec.fresh,) if spec.fresh else ()), *(spec.named or ()))))
    rows = lines.select("file", "line_no", "line", "restart", "ts", *facts)
    return rows.groupBy("file").transformWithStateInPandas(_Carrier(spec), _carried_type(spec), "Append", "None")


def state_store(spark: SparkSession) -> None:
    """Use the state store that state with several variables needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def transcripts(lines: DataFrame, host: str) -> DataFrame:
    """Events of open session files of the first agent; the last ones of a file come when it is complete."""
    from sparktrail.functions import normalize

    return normalize.transcripts(lines, host, by_state)


def rollouts(lines: DataFrame, host: str) -> DataFrame:
    """Events of open session files of the second agent."""
    from sparktrail.functions import normalize

    return normalize.rollouts(lines, host, by_state)
