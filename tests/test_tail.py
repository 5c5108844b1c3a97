"""Open files: the tail source, and normalisers with state against those of whole files."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sparktrail.functions import normalize
from sparktrail.functions.carry import Carried, by_windows
from sparktrail.streaming import tail


@pytest.fixture(scope="module")
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    tail.state_store(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def stamp(k):
    return f"2024-01-02T00:{k // 60:02}:{k % 60:02}Z"


def transcript(agent=None):
    at = lambda k, **more: {"sessionId": "s", "version": "1", "timestamp": stamp(k), **({"agentId": agent} if agent else {}), **more}
    use = lambda i, t: {"id": f"m{i}", "model": "mo", "usage": {"input_tokens": i, "output_tokens": 6}, "content": [{"type": "tool_use", "id": t, "name": "Skill" if i % 2 else "mcp__gh__x", "input": {"skill": "draw"}}]}
    done = lambda *ids: {"content": [{"type": "tool_result", "tool_use_id": i, "is_error": i == "t2"} for i in ids]}
    return [
        {"type": "summary"}, at(1, type="user", uuid="u1", promptId="p1", message={"content": "x"}), at(2, type="assistant", requestId="r1", message=use(1, "t1")), at(3, type="assistant", requestId="r1", message=use(2, "t2")), "not json",
        at(4, type="x", attachment={"type": "skill_listing", "names": ["b", "a", "b"]}), at(5, type="user", uuid="u2", message=done("t1", "t2", "never")), at(6, type="user", uuid="u3", isMeta=True, message={"content": "x"}),
        at(7, type="assistant", message=use(3, "t1")), at(8, type="user", uuid="u4", isCompactSummary=True, message={"content": "x"}), at(9, type="user", uuid="u5", message={"content": [{"type": "text"}]}), at(10, type="assistant", requestId="r2", message=use(4, "t3")),
        at(12, type="user", uuid="u6", message=done("t3")), at(11, type="assistant", uuid="u7", isApiErrorMessage=True, message={"model": "mo"}), at(13, type="x", attachment={"type": "skill_listing", "addedNames": ["c"]}),
    ]


def rollout():
    at = lambda k, kind, payload: {"timestamp": stamp(k), "type": kind, "payload": payload}
    used = lambda n: {"type": "token_count", "info": {"total_token_usage": {"total": n}, "last_token_usage": {"input_tokens": n, "output_tokens": 1}}}
    context = lambda m, t: {"model": m, "effort": "high", "turn_id": t}
    return [
        at(0, "session_meta", {"id": "c", "cli_version": "1"}), at(1, "event_msg", {"type": "task_started"}), at(2, "turn_context", context("gpt", "t1")), at(3, "event_msg", used(10)), at(4, "event_msg", used(10)), "broken",
        at(5, "turn_context", context("gpt-2", "t2")), at(6, "event_msg", used(30)), at(7, "event_msg", {"type": "item_completed", "item": {"id": "k", "command": "ls", "exit_code": 1, "duration_ms": 8}}), at(8, "event_msg", used(30)),
        at(9, "event_msg", {"type": "item_completed", "item": {"server": "gh", "tool": "x"}}), {"type": "event_msg", "payload": used(99)},
    ]


def text(lines):
    return "".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines)


class Query:
    """A query from open files to a table that can be stopped and started again."""

    def __init__(self, spark, tmp_path, make, **options):
        self.spark, self.make, self.options = spark, make, options
        self.files, self.out, self.checkpoint = (str(tmp_path / x) for x in ("files", "out", "checkpoint"))
        os.makedirs(self.files, exist_ok=True)

    def start(self):
        stream = self.make(tail.open_files(self.spark, self.files, **self.options))
        append = lambda batch, _: batch.write.mode("append").parquet(self.out)
        self.query = stream.writeStream.foreachBatch(append).option("checkpointLocation", self.checkpoint).trigger(processingTime="0 seconds").start()

    def settle(self):
        self.query.processAllAvailable()

    def stop(self):
        self.settle()
        self.query.stop()

    def add(self, name, data, mode="ab"):
        with open(f"{self.files}/{name}", mode) as f:
            f.write(data if isinstance(data, bytes) else data.encode())

    def rows(self):
        return self.spark.read.parquet(self.out)


def test_only_complete_lines_and_a_new_beginning_after_truncation(spark, tmp_path):
    q = Query(spark, tmp_path, lambda x: x)
    got = lambda: sorted((r["file"], r["line_no"], r["line"], r["restart"]) for r in q.rows().collect())
    q.add("a.jsonl", "one\ntwo\nthr")
    q.add("ignored.txt", "x\n")
    q.add(".hidden.jsonl", "x\n")
    q.start()
    q.settle()
    assert got() == [("a.jsonl", 0, "one", True), ("a.jsonl", 1, "two", False)]
    q.add("a.jsonl", "ee\n\nfünf".encode()[:-1])  # within a character
    os.makedirs(f"{q.files}/deep/er")
    q.add("deep/er/b.jsonl", "b\n")
    q.settle()
    assert got()[2:] == [("a.jsonl", 2, "three", False), ("a.jsonl", 3, "", False), ("deep/er/b.jsonl", 0, "b", True)]
    q.stop()
    q.add("a.jsonl", "fünf".encode()[-1:] + b"\nsix\n")  # while nobody reads
    q.start()
    q.settle()
    assert [r[1:] for r in got() if r[1] >= 4] == [(4, "fünf", False), (5, "six", False)]
    q.add("a.jsonl", "one\nnew\n", "wb")  # shorter, same beginning
    q.settle()
    assert [r[1:] for r in got() if r[0] == "a.jsonl"].count((0, "one", True)) == 2 and ("a.jsonl", 1, "new", False) in got()
    q.stop()
    q.add("a.jsonl", "other\n" + "longer than before\n" * 5, "wb")  # longer, another beginning, while nobody reads
    q.start()
    q.stop()
    assert ("a.jsonl", 0, "other", True) in got() and sum(r[2] == "longer than before" for r in got()) == 5


def test_offsets_need_no_memory(tmp_path):
    """A reader that has counted nothing gives the same spans as one that followed the file."""
    path = tmp_path / "f.jsonl"
    old = tail.TailReader({"path": str(tmp_path)})
    offset, seen = old.initialOffset(), []
    rng = random.Random(1)
    for k in range(40):
        with open(path, "ab") as f:
            f.write(b"x" * rng.randrange(30) + (b"\n" if rng.random() < 0.7 else b""))
        end = json.loads(json.dumps(old.latestOffset()))
        fresh = tail.TailReader({"path": str(tmp_path)})
        assert json.loads(json.dumps(fresh.latestOffset())) == end
        for span in fresh.partitions(offset, end):
            seen += [x for b in fresh.read(span) for x in b.to_pylist()]
        assert not fresh.partitions(end, end)
        offset = end
    whole = path.read_bytes().decode().split("\n")[:-1]
    assert [(r["line_no"], r["line"]) for r in seen] == list(enumerate(whole))
    assert sum(r["restart"] for r in seen) <= 2  # a file whose first line wasn't complete has no beginning yet


def whole_files(spark, files):
    return spark.createDataFrame([(f, k, x if isinstance(x, str) else json.dumps(x)) for f, rows in files.items() for k, x in enumerate(rows)], "file string, line_no long, line string")


@pytest.mark.parametrize("kind", ["transcripts", "rollouts"])
def test_open_files_give_the_events_of_whole_ones(store, tmp_path, kind):
    spark = store
    files = {"a.jsonl": transcript(), "b.jsonl": transcript("ag1")[1:]} if kind == "transcripts" else {"a.jsonl": rollout(), "b.jsonl": rollout()[2:]}
    q = Query(spark, tmp_path, lambda x: getattr(tail, kind)(x, "h"), **({"quiet_seconds": 3.0} if kind == "transcripts" else {}))
    q.start()
    rng = random.Random(4)
    left = {f: text(x).encode() for f, x in files.items()}
    steps = 0
    while any(left.values()):
        for f, data in left.items():
            n = rng.randrange(150, 700)  # often within a line
            q.add(f, data[:n])
            left[f] = data[n:]
        q.settle()
        steps += 1
        if steps == 3:  # what was carried survives a restart
            q.stop()
            q.start()
    assert steps > 4
    want = getattr(normalize, kind)(whole_files(spark, files), "h")
    if kind == "transcripts":
        import time

        before = {r["event_type"] for r in q.rows().collect()}
        assert "session.start" in before
        time.sleep(4)
        q.settle()
    q.stop()
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, q.rows().collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    kinds = {r["event_type"] for r in want.collect()}
    assert kinds >= ({"session.start", "session.end", "subagent.stop", "turn", "tool.call", "tool.result", "api.request", "api.error", "compaction"} if kind == "transcripts" else {"session.start", "turn", "api.request", "tool.call", "tool.result"})


def test_a_file_begun_anew_loses_what_was_carried(store, tmp_path):
    q = Query(store, tmp_path, lambda x: tail.rollouts(x, "h"))
    q.add("a.jsonl", text(rollout()[:4]))
    q.start()
    q.settle()
    q.add("a.jsonl", text([rollout()[3]]), "wb")  # the same usage total, but of a file without session and model
    q.stop()
    got = [(r["event_type"], r["session_id"], r["model"], r["input_tokens"]) for r in q.rows().filter("event_type = 'api.request'").collect()]
    assert sorted(got, key=str) == [("api.request", "c", "gpt", 10), ("api.request", None, None, 10)]


def test_windows_carry_what_plain_python_does(spark):
    rng = random.Random(6)
    rows = []
    for f in "abc":
        for k in range(60):
            word = lambda: rng.choice([None, None, "x", "y", "z"])
            ids = [rng.choice("pqr") for _ in range(rng.randrange(3))]
            rows.append((f, k, rng.choice([None, k * 10, 5]), word(), word(), word(), [(i, f"{i}{k}", k) for i in ids], [rng.choice("pqrs") for _ in range(rng.randrange(3))]))
    df = spark.createDataFrame(rows, "file string, line_no long, ts long, u string, v string, key string, defs array<struct<id: string, name: string, ts: long>>, refs array<string>").repartition(5)
    spec = Carried(last=("u",), previous=("v",), first=("v",), fresh="key", named=("defs", "refs"))
    got = {(r["file"], r["line_no"]): r for r in by_windows(df, spec).collect()}
    assert len(got) == len(rows)
    for f in "abc":
        last = prev = first = start = stop = None
        seen, known = set(), {}
        for _, k, ts, u, v, key, defs, refs in (r for r in rows if r[0] == f):
            r = got[f, k]
            assert r["previous_v"] == prev
            last, prev, first = u or last, v or prev, first or v
            assert (r["last_u"], r["first_v"], r["fresh"]) == (last, first, key is not None and key not in seen)
            seen.add(key)
            for i, name, at in defs:
                known.setdefault(i, (name, at))
            assert {i: tuple(d) for i, d in (r["known"] or {}).items()} == {i: known[i] for i in refs if i in known}
            assert r["begins"] == (ts is not None and start is None) and r["ended"] == (k == 59)
            if ts is not None:
                start, stop = ts if start is None else min(start, ts), ts if stop is None else max(stop, ts)
            assert (r["from_ts"], r["to_ts"]) == (start, stop)
    assert by_windows(df.filter("false"), spec).count() == 0 and F.lit(1) is not None
