"""Normalisers, sources and sinks, resolution, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from sparktrail.functions import desktop, normalize, scalars
from sparktrail.operators import billing, folds, resolution
from sparktrail.schema import COLUMNS, EVENT_SCHEMA, conform, empty_events, required
from sparktrail.sources import events as tables
from sparktrail.streaming import health, ingest

SECRET = "must not be stored"


def one(spark, column, *values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(column(F.col("x"))).collect()]


def test_scalars(spark):
    names = ["mcp__github__search", "mcp__my_playwright__go", "Bash", "Skill", "WebFetch", "Edit", "mcp__x", None]
    assert one(spark, scalars.tool_kind, *names) == ["mcp", "browser", "bash", "skill", "browser", "builtin", "builtin", None]
    assert one(spark, lambda c: scalars.tool_kind(c, shells=True), "Shell", "exec", "mcp__a__b", "Skill") == ["bash", "bash", "mcp", "builtin"]
    assert one(spark, scalars.mcp_server, "mcp__a__b__c", "mcp__a") == ["a", None] and one(spark, scalars.mcp_tool, "mcp__a__b__c") == ["b__c"]
    assert one(spark, scalars.token_estimate, "abcd", "abcde", "日本", "", None) == [1, 2, 2, 0, None]
    raw = ["https://u:p@github.com/a/b.git?x=1#y", "git@github.com:a/b.git", "bob@host:a/b", "org/repo", "", "a\x01b", "ext::sh -c x", "ftp://h/x", "a@b"]
    assert one(spark, scalars.repository, *raw) == ["https://github.com/a/b.git", "git@github.com:a/b.git", "host:a/b", "org/repo", None, None, None, None, None]
    assert one(spark, lambda c: scalars.glob_matches(c, ["org/*", "x?"]), "org/a.b", "xy", "Org/a", "x", None) == [True, True, False, False, False]
    assert one(spark, scalars.skill_of_command, "cat /a/b/draw/SKILL.md", "ls") == ["draw", None]
    assert one(spark, lambda c: scalars.refined_clients(c, F.lit("z")), None, "codex_desktop,a", "a") == ["z", "a,z", "a"]
    assert one(spark, normalize.millis, "1700000000", "1700000000123", "2024-01-02T03:04:05.678+01:00", "x", None) == [1700000000000, 1700000000123, 1704161045678, None, None]


def hook(name, k=0, **more):
    return (f"{1000 + k}-u{k}.claude.json", json.dumps({"hook_event_name": name, "session_id": "s", "cwd": "/home/x", "prompt": SECRET, "tool_input": {"command": SECRET, "skill": "draw"}, "timestamp": "2024-01-02T00:00:00Z", **more}))


def spark_rows(spark, rows):
    return spark.createDataFrame(rows, "name string, body string")


def test_hooks(spark):
    raw = [
        hook("PreToolUse", tool_name="Bash", tool_use_id="t1", agent_id="", model="never"), hook("PostToolUse", 1, tool_name="mcp__gh__x", tool_use_id="t1", tool_response={"success": False, "error": "denied", "text": SECRET}, duration_ms=12),
        hook("PostToolUse", 2, tool_name="Skill", tool_response={}), hook("PermissionDenied", 3, tool_name="Edit", decision_source="user"), hook("SubagentStop", 4, agent_id="a1", usage={"input_tokens": 5, "output_tokens": 7}),
        hook("Notification", 5), ("x.json", "not json"), hook("SessionStart", 6, model="m"), hook("Stop", 7),
    ]
    out = normalize.hooks(spark_rows(spark, raw), "h")
    rows = {(r["event_type"], r["tool_name"]): r for r in out.collect()}
    assert len(rows) == 7 and out.dtypes == empty_events(spark).dtypes
    call, failed, skill = rows["tool.call", "Bash"], rows["tool.result", "mcp__gh__x"], rows["tool.result", "Skill"]
    assert (call["tool_kind"], call["correlation_key"], call["query_source"], call["model"], call["agent_id"]) == ("bash", "t1", "main", None, None)
    assert (failed["success"], failed["error_type"], failed["mcp_server"], failed["duration_ms"]) == (False, "denied", "gh", 12)
    assert skill["success"] is None and skill["skill_name"] == "draw" and skill["correlation_confidence"] == "none"
    assert rows["tool.denied", "Edit"]["decision_source"] == "user"
    stop = rows["subagent.stop", None]
    assert (stop["input_tokens"], stop["correlation_key"], stop["query_source"]) == (5, "a1", "subagent")
    assert call["dt"] == "2024-01-02" and call["event_id"] != failed["event_id"] and len(call["event_id"]) == 32
    assert SECRET not in str(out.collect())
    again = normalize.hooks(spark_rows(spark, raw), "h")
    assert not again.exceptAll(out).count()  # the same files give the same events
    assert normalize.hooks(spark_rows(spark, raw), "h", "codex").filter("tool_kind = 'skill'").count() == 0


def attribute(k, v):
    return {"key": k, "value": {"intValue": str(v)} if isinstance(v, int) else {"stringValue": v}}


def export(*records, **resource):
    logs = [{"timeUnixNano": str(t), "body": {"stringValue": SECRET if "event.name" in a else name}, "eventName": name, "attributes": [attribute(k, v) for k, v in a.items()]} for t, name, a in records]
    return json.dumps({"resourceLogs": [{"resource": {"attributes": [attribute(k, v) for k, v in resource.items()]}, "scopeLogs": [{"logRecords": logs}]}]})


def test_log_exports(spark):
    body = export(
        (1_704_153_600_000_000_000, "claude_code.api_request", {"session.id": "s", "model": "m", "input_tokens": 10, "output_tokens": "4", "cache_creation_tokens": 3, "cost_usd": "0.5", "query_source": "main"}),
        (1_704_153_601_000_000_000, "tool_result", {"session.id": "s", "tool_name": "Bash", "success": "true", "tool_use_id": "t", "duration_ms": 9}), (1, "unknown", {}), model="shared", **{"user.email": "a@b.c"},
    )
    rows = {r["event_type"]: r for r in normalize.otlp_logs(spark.createDataFrame([(body,), ("{}",), ("bad",)], "body string"), "h", 5).collect()}
    api = rows["api.request"]
    assert (api["model"], api["input_tokens"], api["output_tokens"], api["cache_write_tokens"], api["cost_usd"], api["user_id"], api["ts"]) == ("m", 10, 4, 3, 0.5, "a@b.c", 1_704_153_600_000)
    assert (rows["tool.result"]["success"], rows["tool.result"]["model"], rows["tool.result"]["tool_kind"]) == (True, "shared", "bash") and len(rows) == 2
    codex = lambda **n: (7, "x", {"event.name": "codex.sse_event", "event.kind": "response.completed", "conversation.id": "c", **n})
    got = normalize.codex_responses(spark.createDataFrame([(export(codex(input_token_count=2, output_token_count=0), codex(input_token_count=20, output_token_count=5, cached_token_count=8)),)], "body string"), "h", 9).collect()
    assert [(r["input_tokens"], r["output_tokens"], r["cache_read_tokens"], r["session_id"], r["provider"]) for r in got] == [(20, 5, 8, "c", "openai")]


def lines(spark, files):
    return spark.createDataFrame([(f, k, x if isinstance(x, str) else json.dumps(x)) for f, rows in files.items() for k, x in enumerate(rows)], "file string, line_no int, line string")


def test_transcripts(spark):
    at = lambda s: {"sessionId": "s", "timestamp": f"2024-01-02T00:00:{s:02}Z"}
    use = {"id": "m1", "model": "mo", "usage": {"input_tokens": 5, "output_tokens": 6}, "content": [{"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": SECRET}}]}
    main = [
        {"type": "user", "uuid": "u1", "message": {"content": SECRET}, **at(1)}, {"type": "assistant", "requestId": "r1", "message": use, **at(2)}, {"type": "assistant", "requestId": "r1", "message": use | {"content": []}, **at(3)},
        {"type": "user", "uuid": "u2", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": SECRET}]}, **at(5)}, {"type": "user", "uuid": "u3", "isCompactSummary": True, "message": {"content": SECRET}, **at(6)},
        {"type": "x", "attachment": {"type": "skill_listing", "names": ["b", "a"]}, **at(7)}, "garbage", {"type": "assistant", "uuid": "u4", "isApiErrorMessage": True, "message": {"model": "mo"}, **at(8)},
    ]
    out = normalize.transcripts(lines(spark, {"f": main, "g": [{"type": "user", "uuid": "v", "agentId": "a9", "message": {"content": "x"}, **at(1)}, {"type": "x", "agentId": "a9", **at(4)}]}), "h")
    rows = {}
    for r in out.collect():
        rows.setdefault((r["event_type"], r["agent_id"]), []).append(r)
    count = {k: len(v) for k, v in rows.items()}
    assert count == {("turn", None): 1, ("api.request", None): 1, ("tool.call", None): 1, ("tool.result", None): 1, ("compaction", None): 1, ("api.error", None): 1, ("session.start", None): 1, ("session.end", None): 1, ("turn", "a9"): 1, ("subagent.stop", "a9"): 1}
    done = rows["tool.result", None][0]
    assert (done["success"], done["duration_ms"], done["tool_name"], done["turn_id"]) == (True, 3000, "Bash", "u1")
    assert rows["session.end", None][0]["configured_skills"] == '["a","b"]' and rows["subagent.stop", "a9"][0]["duration_ms"] == 3000
    assert SECRET not in str(out.collect()) and out.select("event_id").distinct().count() == out.count()


def test_rollouts(spark):
    at = lambda s, kind, payload: {"timestamp": f"2024-01-02T00:00:{s:02}Z", "type": kind, "payload": payload}
    used = lambda n: {"type": "token_count", "info": {"total_token_usage": {"total": n}, "last_token_usage": {"input_tokens": n, "output_tokens": 1}}}
    rows = [at(0, "session_meta", {"id": "c", "cli_version": "1"}), at(1, "turn_context", {"model": "gpt", "effort": "high", "turn_id": "t"}), at(2, "event_msg", {"type": "task_started"}), at(3, "event_msg", used(10)), at(4, "event_msg", used(10)), at(5, "event_msg", used(30)), at(6, "event_msg", {"type": "item_completed", "item": {"id": "k", "command": SECRET, "exit_code": 1, "duration_ms": 8}})]
    out = normalize.rollouts(lines(spark, {"f": rows}), "h").collect()
    kinds = sorted(r["event_type"] for r in out)
    assert kinds == ["api.request", "api.request", "session.start", "tool.call", "tool.result", "turn"]
    result = next(r for r in out if r["event_type"] == "tool.result")
    assert (result["success"], result["duration_ms"], result["tool_kind"], result["model"], result["session_id"]) == (False, 8, "bash", "gpt", "c")
    assert SECRET not in str(out)


def test_reports(spark):
    good = {"session_id": "s", "response_id": "r", "model": "m", "timestamp_ms": 5, "input_tokens": 1, "output_tokens": 2, "cache_read_tokens": 0, "cache_write_tokens": 0}
    raw = spark.createDataFrame([(json.dumps(x),) for x in (good, good | {"input_tokens": -1}, good | {"response_id": "a b"}, good | {"pad": "x" * 5000})], "body string")
    assert normalize.plugin_responses(raw, "h").count() == 1
    limits = spark.createDataFrame([(json.dumps({"agent": "a", "account": "b", "observed_at": t, "windows": [{"name": "w", "used_percent": p}]}),) for t, p in ((1, 10), (3, 120), (2, 20))], "body string")
    latest = normalize.latest_limits(normalize.usage_limits(limits)).collect()
    assert [(r["observed_at"], r["windows"]) for r in latest] == [(3, [])]


def events(spark, *rows):
    base = {"ts": 1, "dt": "1970-01-01", "host_id": "h", "agent": "codex", "source": "log", "event_type": "turn", "session_id": "s"}
    return spark.createDataFrame([tuple((base | r).get(c) for c in COLUMNS) for r in rows], EVENT_SCHEMA)


def test_links(spark):
    link = {"event_type": "message.usage.link", "correlation_confidence": "content_match", "parent_session_id": "p", "correlation_key": "k", "session_id": "chat", "turn_id": "m"}
    request = {"event_id": "r", "event_type": "api.request", "client": "claude_desktop", "session_id": "p", "correlation_key": "k"}
    session = lambda *rows: {r["event_id"]: (r["session_id"], r["turn_id"]) for r in resolution.resolve_links(events(spark, *rows)).collect()}
    assert session(request, link) == {"r": ("chat", "m")}
    assert session(request, link, link) == {"r": ("chat", "m")}
    assert session(request, link, link | {"turn_id": "other"}) == {"r": ("p", None)}
    assert session(request, link, {"event_type": "message.usage.link.rejected", "session_id": "p", "correlation_key": "k"}) == {"r": ("p", None)}
    fact = {"event_type": "session.client", "correlation_confidence": "observed_originator", "client": "chatgpt_desktop_cowork"}
    out = resolution.resolve_links(events(spark, {"event_id": "a", "client": "codex_desktop"}, {"event_id": "b", "client": "x"}, fact)).collect()
    assert {r["event_id"]: r["client"] for r in out} == {"a": "chatgpt_desktop_cowork", "b": "x"}


def test_scopes_and_changes(spark):
    ledger = spark.createDataFrame([("local", "a", "1"), ("remote", "a", "2"), ("local", "b", "3"), ("remote", "c", "4"), ("local", "d", "5"), ("other", "e", "6")], "scope string, event_id string, payload string")
    stones = spark.createDataFrame([("remote", "d")], "scope string, event_id string")
    aliases = spark.createDataFrame([("remote", "b", "c")], "scope string, local_id string, remote_id string")
    got = {(r["event_id"], r["payload"]) for r in resolution.resolve_scopes(ledger, "remote", stones, aliases).collect()}
    assert got == {("a", "1"), ("c", "4")}
    page = spark.createDataFrame([("remote", 1, "c", False, "7"), ("remote", 2, "c", False, "8"), ("remote", 3, "a", True, None), ("remote", 4, "d", False, "9")], "scope string, sequence long, event_id string, deleted boolean, payload string")
    new, dead = tables.apply_changes(ledger, stones, page)
    assert {(r["scope"], r["event_id"], r["payload"]) for r in new.collect()} == {("local", "a", "1"), ("local", "b", "3"), ("remote", "c", "8"), ("local", "d", "5"), ("other", "e", "6")}
    assert {r["event_id"] for r in dead.collect()} == {"a", "d"}


def test_devices_and_fingerprints(spark):
    a = events(spark, {"event_id": "a1", "tool_name": "x"}, {"event_id": "a2", "tool_name": "x"}, {"event_id": "a3", "tool_name": None, "input_tokens": 7})
    b = events(spark, {"event_id": "b1", "tool_name": "x"}, {"event_id": "b2", "tool_name": "x"}, {"event_id": "b3", "tool_name": "y", "input_tokens": 7})
    rules = [("same", [F.col("tool_name"), F.col("ts")], False), ("usage", [F.col("input_tokens")], True)]
    assert {tuple(r) for r in resolution.link_devices(a, b, rules).collect()} == {("a1", "b1", "same"), ("a2", "b2", "same"), ("a3", "b3", "usage")}
    prints = resolution.fingerprints(spark.createDataFrame([("a\r\nb",), ("a\nb",), (None,)], "text string"), b"k").collect()
    assert prints[0][1] == prints[1][1] and len(prints[0][1]) == 64 and prints[2][1] is None
    r = spark.createDataFrame([("r1", "f", 0), ("r2", "g", 0), ("r3", "g", 1)], "response_id string, fingerprint string, ts long")
    m = spark.createDataFrame([("m1", "f", 120_000), ("m2", "g", 5), ("m3", "f", 999_999)], "message_id string, fingerprint string, ts long")
    assert {tuple(x) for x in resolution.match_fingerprints(r, m).collect()} == {("r1", "m1", "linked"), ("r2", "m2", "rejected"), ("r3", "m2", "rejected")}


def test_filters_and_marks(spark):
    e = events(spark, {"event_id": "1", "repo": "a"}, {"event_id": "2", "repo": ""}, {"event_id": "3", "host_id": "other"})
    ids = lambda **f: sorted(r[0] for r in e.filter(resolution.display_filter(**f)).select("event_id").collect())
    assert ids() == ["1", "2", "3"] and ids(device="this-mac", this_device="h") == ["1", "2"] and ids(repo="a") == ["1"] and ids(without_repo=True) == ["2", "3"]
    with pytest.raises(ValueError):
        resolution.display_filter(repo="a", without_repo=True)
    marks = spark.createDataFrame([], resolution.Marks.SCHEMA)
    marks = resolution.Marks.create(marks.select("pattern_id", "subject", "dt", "note", "host_id", "id"), "p", "s", "2024-01-02", "n", "h", "2024-01-03")
    assert resolution.Marks.listed(marks, "p", "s", resolution.display_filter(device="h")).count() == 1
    assert resolution.Marks.delete(marks, marks.first()["id"]).count() == 0
    with pytest.raises(ValueError):
        resolution.Marks.create(marks, "p", "s", "2024-01-04", "n", "h", "2024-01-03")


def test_tables(spark, tmp_path):
    folder = str(tmp_path / "events")
    assert tables.read_events(spark, folder).count() == 0 and tables.read_foreign_events(spark, folder).count() == 0
    e = events(spark, {"event_id": "1"}, {"event_id": "2", "dt": "1970-01-02"})
    tables.write_events(e, folder)
    assert sorted(r["event_id"] for r in tables.read_events(spark, folder).filter("dt = '1970-01-02'").collect()) == ["2"]
    assert tables.checked_inserts(e, tables.read_events(spark, folder)).count() == 0
    with pytest.raises(tables.Conflict, match="success"):
        tables.checked_inserts(e.withColumn("success", F.lit(True)), tables.read_events(spark, folder))
    with pytest.raises(tables.Conflict, match="different contents"):
        tables.checked_inserts(e.unionByName(e.withColumn("model", F.lit("m"))), tables.read_events(spark, folder).limit(0))
    older = e.drop("billing_route", "client").withColumn("odd", F.lit(1))
    older.write.parquet(f"{tmp_path}/foreign/dt=all")
    assert tables.read_foreign_events(spark, f"{tmp_path}/foreign").orderBy("event_id").select("dt", "client").collect()[1] == ("1970-01-02", None)
    assert [tables.valid_key(k) for k in ("a/dt=2024-01-31/x.parquet", "dt=2024-02-31/x.parquet", "dt=2024-01-31/../x.parquet", "x.parquet")] == [True, False, False, False]
    ledger = e.select(F.lit("local").alias("scope"), "event_id", F.to_json(F.struct(*COLUMNS)).alias("payload"))
    assert not tables.from_ledger(ledger).drop("scope").exceptAll(e).count()
    assert tables.masked(e.withColumn("prompt_text", F.lit(SECRET))).first()["prompt_text"] is None
    with pytest.raises(Exception, match="event without host_id"):
        required(e.withColumn("host_id", F.lit(None).cast("string"))).collect()
    assert conform(e).schema == EVENT_SCHEMA


def test_content_ids_and_health(spark):
    e = events(spark, {"event_id": "1"}, {"event_id": "2"}, {"event_id": "3", "model": "m"}, {"event_id": "4", "event_type": "tool.call"})
    out = tables.rekeyed(e).collect()
    assert len(out) == 3 and {r["event_id"] for r in out if r["event_type"] == "tool.call"} == {"4"} and not {"1", "2", "3"} & {r["event_id"] for r in out}
    expected = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "collector string")
    beats = spark.createDataFrame([("a", 100_000, 1, None), ("b", 60_000, 1, None), ("c", 99_000, None, "broke"), ("c", 1, 1, None)], health.BEATS)
    got = [(r["collector"], r["status"], r["issue"]) for r in health.collector_health(expected, beats, 100_000).collect()]
    assert got == [("d", "never_seen", None), ("c", "failed", "broke"), ("b", "silent", "no report for 40 s"), ("a", "healthy", None)]
    seen = health.Heartbeats()
    seen._beat("q", 5)
    assert seen.frame(spark).first()["rows"] == 5


def run(spark, spool, table, check, **more):
    q = ingest.start(ingest.spool(spark, spool), table, check, ingest.hook_events("h"), once=True, **more)
    q.awaitTermination(120)
    if q.exception():
        raise q.exception()


def test_streaming_is_idempotent(spark, tmp_path):
    spool = tmp_path / "spool"
    spool.mkdir()
    for k in range(6):
        name, body = hook("PreToolUse", k, tool_name="Bash", tool_use_id=f"t{k}")
        (spool / name).write_text(body)
    (spool / "1-bad.claude.json").write_text("{broken")
    (spool / ".2-partial.claude.json").write_text("{")
    table, rejects = str(tmp_path / "t"), str(tmp_path / "rejects")
    run(spark, str(spool), table, str(tmp_path / "c1"), rejects_folder=rejects)
    assert tables.read_events(spark, table).count() == 6 and spark.read.parquet(rejects).count() == 1
    run(spark, str(spool), table, str(tmp_path / "c2"))  # a new checkpoint replays all files
    assert tables.read_events(spark, table).count() == 6
    name, body = hook("PreToolUse", 9, tool_name="Edit", tool_use_id="t1")
    other = tmp_path / "other"
    other.mkdir()
    (other / name).write_text(body)
    with pytest.raises(Exception, match="tool_name"):
        run(spark, str(other), table, str(tmp_path / "c3"))
    assert tables.read_events(spark, table).count() == 6


def test_days_become_final(spark, tmp_path):
    table = str(tmp_path / "t")
    day = 86_400_000
    events(spark, *({"event_id": str(k), "ts": t, "dt": "x"} for k, t in enumerate((0, 5, day, 9 * day)))).write.parquet(table)
    stream = ingest.final_days(spark.readStream.schema(EVENT_SCHEMA).parquet(table))
    q = stream.writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["events"] for r in spark.sql("select * from days").collect()) == [1, 2]  # the last day may still change


def test_only_queries(spark):
    view = spark.range(3)
    assert ingest.run_query(spark, "select count(*) n from v", v=view).first()["n"] == 3
    assert ingest.run_query(spark, "with x as (select id from v) select sum(id) s from x -- all of it", v=view).first()["s"] == 3
    assert ingest.json_rows(spark.sql("select 1 a, cast(null as int) b")).first()["row"] == '{"a":1,"b":null}'
    for text in ("drop view v", "insert into v values (1)", "with x as (select 1 a) insert into v select * from x", "with x as (select 1 a) from x insert into v select a", "select 1; drop view v", "select 1 -- " + "x" * 70_000):
        with pytest.raises(ValueError):
            ingest.run_query(spark, text)


def test_shared_files_need_plain_names(spark, tmp_path):
    folder = str(tmp_path / "set")
    for name in ("dt=2024-01-02", "dt=2024-13-02", "dt=_schema"):
        events(spark, {"event_id": name}).coalesce(1).write.parquet(f"{folder}/{name}")
    assert [r["event_id"] for r in tables.read_shared_events(spark, folder).collect()] == ["dt=2024-01-02"]
    assert tables.read_shared_events(spark, str(tmp_path / "none")).count() == 0


def test_pages_continue_from_the_cursor(spark):
    none = spark.createDataFrame([], "scope string, event_id string, payload string")
    stones = spark.createDataFrame([], "scope string, event_id string")
    page = lambda *rows: spark.createDataFrame(rows, "scope string, sequence long, event_id string, deleted boolean, payload string")
    good = page(("r", 5, "a", False, "1"), ("r", 6, "b", False, "2"))
    assert tables.apply_changes(none, stones, good, cursor=4)[0].count() == 2 and tables.next_cursor(good, 4) == 6
    for bad in (page(("r", 4, "a", False, "1")), page(("r", 5, "a", False, "1"), ("r", 5, "b", False, "2"))):
        with pytest.raises(tables.Conflict):
            tables.apply_changes(none, stones, bad, cursor=4)
    assert tables.next_cursor(page(), 4) == 4


def test_backfill_ends_where_the_collector_began(spark):
    assert folds.backfill_boundary(["2024-01-02", "2024-01-03", "_schema"], 5) == 1_704_153_600_000 and folds.backfill_boundary(["_schema"], 5) == 5
    files = spark.createDataFrame([("a", 3, 10), ("b", 1, 99), ("c", 2, 10)], "file string, modified_ms long, last_ts long")
    done = spark.createDataFrame([("c",)], "file string")
    assert [tuple(r) for r in folds.backfill_plan(files, done, 50).collect()] == [("b", 1, "overlap"), ("c", 2, "done"), ("a", 3, "backfill")]


def test_login_evidence_of_transcripts_and_diagnostics(spark):
    import json

    ask = lambda id_, *betas: json.dumps({"type": "api-request", "sessionId": "s", "id": id_, "params": {"betas": list(betas)}})
    usage = {"input_tokens": 1, "output_tokens": 2, "cache_read_input_tokens": 3, "cache_creation_input_tokens": 4}
    say = lambda id_, ref, entry="cli": json.dumps({"type": "assistant", "sessionId": "s", "requestId": id_, "requestRef": ref, "entrypoint": entry, "timestamp": "2024-01-02T00:00:00Z", "message": {"model": "m", "usage": usage}})
    lines = [ask("a", "oauth"), ask("b", "oauth"), ask("b"), say("req_1", "a"), say("req_2", "b"), say("msg_3", "a"), say("req_4", "a", "sdk"), say("req_5", "none"), "{broken"]
    rows = spark.createDataFrame([("f", k, x) for k, x in enumerate(lines)], "file string, line_no int, line string")
    got = {r["request_id"]: r["subscribed"] for r in billing.transcript_evidence(rows, "oauth", ("cli",)).collect()}
    assert got == {"req_1": True, "req_2": False, "msg_3": False, "req_4": False, "req_5": False}
    turn = "turn.id=123e4567-e89b-12d3-a456-426614174000"
    bodies = [f'{turn}: endpoint="/responses" auth_header_attached=true auth_header_name="authorization" auth_mode="Chatgpt"', f"{turn} auth_mode=Some(ApiKey) tags_json={{}}", "no turn auth_mode= tags_json=", f"{turn} other"]
    logs = spark.createDataFrame([(k, 7, "t", b) for k, b in enumerate(bodies)], "id long, ts long, thread_id string, body string")
    got = [tuple(r) for r in billing.diagnostics_evidence(logs, -1).select("id", "ts", "kind", "subscribed", "route").orderBy("id").collect()]
    assert got == [(0, 7000, "request", True, "unknown"), (1, 7000, "turn", False, "api_key")]


def test_desktop_conversations(spark):
    uid = lambda k: f"00000000-0000-0000-0000-{k:012d}"
    words = lambda t: [{"type": "text", "text": t}, {"type": "image"}]
    messages = [
        {"uuid": uid(1), "sender": "human", "created_at": "2024-01-02T00:00:00Z", "content": words("abcde")},
        {"uuid": uid(2), "sender": "assistant", "stop_reason": "end", "created_at": "2024-01-02T00:00:01Z", "parent_message_uuid": uid(1), "content": words("é")},
        {"uuid": uid(3), "sender": "assistant", "created_at": "2024-01-02T00:00:02Z", "content": words("not done")},
        {"uuid": "x", "sender": "human", "created_at": "2024-01-02T00:00:03Z"},
        {"uuid": uid(4), "sender": "human", "created_at": "2024-01-02T00:00:04Z", "attachedFolders": ["/secret"]},
    ]
    tree = lambda sid, m, product="hub": json.dumps({"product": product, "conversationUuid": sid, "tree": {"kind": "hub_transcript", "conversationUuid": sid, "messages": m}})
    bodies = [tree(uid(9), messages), tree(uid(9), messages), tree(uid(8), messages[:2]), tree(uid(7), messages, "other"), "{broken"]
    raw = spark.createDataFrame([(b,) for b in bodies], "body string")
    out = desktop.conversations(raw, "h", spark.createDataFrame([(uid(8),), (uid(9),)], "session_id string"))
    got = [(r["session_id"][-1], r["event_type"], (r["turn_id"] or "")[-1:], r["estimated_input_tokens"], r["estimated_output_tokens"]) for r in out.collect()]
    one = lambda s: [(s, "message.received", "1", None, None), (s, "message.tokens.estimated", "1", 2, None), (s, "message.tokens.estimated", "1", None, 1), (s, "turn", "1", None, None)]
    want = [*one("9"), ("9", "turn", "4", None, None), ("9", desktop.FOLDER, "4", None, None), *one("8"), ("8", desktop.FOLDER, "1", None, None)]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and "secret" not in str(out.collect())
    seen = lambda org, model="claude-x", source="server_model_change": json.dumps({"version": 1, "conversationUuid": uid(9), "messageUuid": uid(2), "orgUuid": org, "model": model, "modelSource": source})
    raw = spark.createDataFrame([(b,) for b in (seen("o"), seen("o"), seen("p"), seen("o", "gpt"), seen("o", source="guess"))], "body string")
    models = desktop.response_models(raw, spark.createDataFrame([(uid(9), "o")], "session_id string, org_id string"), out, "h").collect()
    assert [(r["event_type"], r["model"], r["correlation_key"]) for r in models] == [("message.model.server_model_change", "claude-x", uid(2))]


def test_completed_responses(spark):
    uid = lambda k: f"00000000-0000-0000-0000-{k:012d}"
    user = lambda k, content: json.dumps({"uuid": k, "message": {"role": "user", "content": content}})
    usage = {"input_tokens": 3, "output_tokens": 4, "cache_read_input_tokens": -1}
    said = lambda id_, use=usage, **more: json.dumps({"uuid": uid(5), "timestamp": "2024-01-02T00:00:00Z", "message": {"role": "assistant", "id": id_, "model": "claude-x", "stop_reason": "end", "usage": use, "content": [{"type": "text", "text": "hi"}]} | more})
    lines = [user(uid(1), "hello"), user(uid(2), [{"type": "tool_result"}]), said("a", usage | {"output_tokens": 1}), said("a"), said("b", {"input_tokens": 0, "output_tokens": 0}), said("c", stop_reason=None), said("d", model="gpt"), user("odd", "again"), said("e")]
    rows = spark.createDataFrame([("f", "s", k, x) for k, x in enumerate(lines)], "file string, session_id string, line_no int, line string")
    got = {r["response_id"]: (r["output_tokens"], r["cache_read_tokens"], r["user_message_uuid"], r["text"]) for r in desktop.completed_responses(rows).collect()}
    assert got == {"a": (4, None, uid(1), "hi"), "e": (4, None, None, "hi")}


def test_rules_for_a_history_from_another_device(spark):
    call = {"agent": "claude-code", "session_id": "s", "event_type": "tool.call", "correlation_key": "t1", "ts": 5}
    api = {"agent": "claude-code", "session_id": "s", "event_type": "api.request", "model": "m", "input_tokens": 1, "output_tokens": 2}
    codex = {"session_id": "c", "agent": "codex", "source": "log", "event_type": "turn", "ts": 9}
    new = events(spark, call | {"event_id": "l1", "source": "log"}, api | {"event_id": "l2", "source": "log", "ts": 7}, codex | {"event_id": "l3", "model": "x"}, {"event_id": "l4", "session_id": "s", "source": "log", "event_type": "turn", "ts": 1}, {"event_id": "l5", "session_id": None, "source": "log"})
    old = events(spark, call | {"event_id": "r1", "source": "hook", "ts": 6}, api | {"event_id": "r2", "source": "otel"}, codex | {"event_id": "r3", "host_id": "other"}, {"event_id": "r4", "host_id": "other", "user_id": "u", "session_id": "s", "source": "log", "event_type": "turn", "ts": 1}, {"event_id": "r5", "session_id": None, "source": "log"})
    found = {(r["left_id"], r["right_id"]): r["rule"] for r in resolution.link_devices(new, old, resolution.device_rules(COLUMNS)).collect()}
    assert found == {("l4", "r4"): "same observation", ("l3", "r3"): "same record, other context", ("l1", "r1"): "same operation id, hook", ("l2", "r2"): "unique model and usage"}


def test_files_settle(spark):
    files = spark.createDataFrame([("quiet", 0, 0), ("busy", 99_000, 90_000), ("late", 699_000, 0)], "file string, modified_ms long, waiting_since_ms long")
    assert [r["file"] for r in ingest.settled(files, 100_000).collect()] == ["quiet"]
    assert {r["file"] for r in ingest.settled(files, 700_000).collect()} == {"quiet", "busy", "late"}
