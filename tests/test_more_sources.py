"""Exports in protobuf and every kind of attribute, settings files, sketches, revoked links, sorted tables."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from sparktrail.functions import normalize
from sparktrail.operators import folds, quantiles
from sparktrail.schema import EVENT_SCHEMA
from sparktrail.sources import protobuf, settings
from sparktrail.sources.events import read_events
from sparktrail.streaming import links


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def part(number, wire, data):
    return varint(number << 3 | wire) + data


def sized(number, data):
    return part(number, 2, varint(len(data)) + data)


def any_value(x):
    if isinstance(x, bool):
        return part(2, 0, varint(int(x)))
    if isinstance(x, int):
        return part(3, 0, varint(x))
    if isinstance(x, float):
        return part(4, 1, struct.pack("<d", x))
    if isinstance(x, bytes):
        return sized(7, x)
    if isinstance(x, list):
        return sized(5, b"".join(sized(1, any_value(v)) for v in x))
    if isinstance(x, dict):
        return sized(6, b"".join(sized(1, key_value(k, v)) for k, v in x.items()))
    return sized(1, x.encode())


def key_value(k, v):
    return sized(1, k.encode()) + sized(2, any_value(v))


def json_value(x):
    if isinstance(x, bool):
        return {"boolValue": x}
    if isinstance(x, int):
        return {"intValue": str(x)}
    if isinstance(x, float):
        return {"doubleValue": x}
    if isinstance(x, list):
        return {"arrayValue": {"values": [json_value(v) for v in x]}}
    return {"stringValue": x}


def exports(records, resource):
    """The same request in both encodings: records of (nanos, name, attributes, trace)."""
    message = b"".join(
        sized(2, part(1, 1, struct.pack("<Q", t)) + part(2, 0, varint(9)) + sized(3, b"INFO") + sized(5, any_value("text")) + b"".join(sized(6, key_value(k, v)) for k, v in a.items()) + part(8, 5, b"\0\0\0\1") + sized(9, trace) + part(11, 1, struct.pack("<Q", t + 1)) + sized(12, name.encode()))
        for t, name, a, trace in records
    )
    whole = sized(1, sized(1, b"".join(sized(1, key_value(k, v)) for k, v in resource.items())) + sized(2, sized(1, sized(1, b"scope")) + message) + sized(3, b"url"))
    logs = [{"timeUnixNano": str(t), "observedTimeUnixNano": str(t + 1), "eventName": name, "body": {"stringValue": "text"}, "traceId": trace.hex(), "attributes": [{"key": k, "value": json_value(v)} for k, v in a.items()]} for t, name, a, trace in records]
    text = json.dumps({"resourceLogs": [{"resource": {"attributes": [{"key": k, "value": json_value(v)} for k, v in resource.items()]}, "scopeLogs": [{"logRecords": logs}]}]})
    return whole, text


RECORDS = [
    (1_704_153_600_000_000_000, "claude_code.api_request", {"session.id": "s", "model": "größer", "input_tokens": 10, "output_tokens": "4", "cache_read_tokens": 2.9, "cost_usd": 0.5, "odd": [1, "a"]}, b"\1\2"),
    (1_704_153_601_000_000_000, "tool_result", {"session.id": "s", "tool_name": "Bash", "success": True, "duration_ms": 9}, b"\xff" * 16), (1_704_153_602_000_000_000, "tool_result", {"success": 0, "duration_ms": "x", "input_tokens": -5}, b""), (5, "unknown", {}, b""),
]


def test_both_encodings_give_the_same_events(spark):
    binary, text = exports(RECORDS, {"user.email": "a@b.c", "model": "shared"})
    raw = spark.createDataFrame([(1, bytearray(binary)), (2, bytearray(binary[:-3])), (3, bytearray(b"\x0b")), (4, None), (5, bytearray(b""))], "k int, body binary")
    out = protobuf.as_json(raw)
    assert {r["k"]: r["body"] is not None for r in out.collect()} == {1: True, 2: False, 3: False, 4: False, 5: True}
    events = lambda df: sorted(map(str, normalize.otlp_logs(df, "h", 7).collect()))
    assert events(out) == events(spark.createDataFrame([(text,)], "body string"))
    rows = {(r["event_type"], r["ts"]): r for r in normalize.otlp_logs(out, "h", 7).collect()}
    api = rows["api.request", 1_704_153_600_000]
    assert (api["model"], api["input_tokens"], api["output_tokens"], api["cache_read_tokens"], api["cost_usd"], api["user_id"]) == ("größer", 10, 4, 2, 0.5, "a@b.c")
    assert [(r["success"], r["duration_ms"]) for (_, t), r in sorted(rows.items()) if t > 1_704_153_600_000] == [(True, 9), (False, None)]


def test_broken_messages_are_errors_not_loops():
    binary, _ = exports(RECORDS, {"a": 1})
    rng = random.Random(1)
    for _ in range(400):
        data = bytearray(binary)
        for _ in range(rng.randrange(1, 4)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        try:
            protobuf.decode(memoryview(bytes(data[: rng.randrange(len(data) + 1)])), protobuf.REQUEST)
        except ValueError:
            pass
    deep = any_value(1)
    for _ in range(100):
        deep = sized(5, sized(1, deep))
    with pytest.raises(ValueError, match="too deep"):
        protobuf.decode(memoryview(deep), protobuf.ANY)


def test_every_kind_of_attribute_for_every_target(spark):
    values = {"stringValue": ["12", " 3 ", "1.5", "true", "x", ""], "intValue": ["7", "0"], "doubleValue": [2.9, -1.0], "boolValue": [True, False]}
    rows = [(k, json.dumps([{"key": "a", "value": {k: v}}, {"key": "a", "value": {"stringValue": "second"}}])) for k, some in values.items() for v in some] + [("list", '[{"key": "a", "value": {"arrayValue": {"values": []}}}]'), ("none", "[]")]
    df = spark.createDataFrame(rows, "kind string, body string").withColumn("m", F.from_json("body", normalize._ATTRIBUTES)).withColumn("v", F.element_at(normalize.attributes("m"), "a"))
    got = [tuple(r) for r in df.select("kind", normalize.as_text(F.col("v")), normalize.as_long(F.col("v")), normalize.as_double(F.col("v")), normalize.as_flag(F.col("v"))).collect()]
    s, n = "stringValue", None
    assert got == [
        (s, "12", 12, 12.0, n), (s, " 3 ", 3, 3.0, n), (s, "1.5", n, 1.5, n), (s, "true", n, n, True), (s, "x", n, n, n), (s, "", n, n, n), ("intValue", "7", 7, 7.0, True), ("intValue", "0", 0, 0.0, False),
        ("doubleValue", "2.9", 2, 2.9, n), ("doubleValue", "-1.0", -1, -1.0, n), ("boolValue", "true", n, n, True), ("boolValue", "false", n, n, False), ("list", n, n, n, n), ("none", n, n, n, n),
    ]


def test_servers_of_nested_settings(spark):
    rows = [
        ("h1", "/home/.claude.json", {"mcpServers": {"gh": {"command": "secret"}, "jira": {}}, "projects": {"/a": {"mcpServers": {"deep": {}, "gh": {}}, "x": 1}, "/b": {}, "/c": "odd", "/d": {"mcpServers": []}}}),
        ("h1", "/home/.claude/settings.json", {"other": 1}), ("h1", "/a/.mcp.json", {"mcpServers": {"local": {}}}), ("h2", "/x.json", {"mcpServers": {}}), ("h3", "/x.json", None), ("h4", "/x.json", {"mcpServers": {"ü 'q'": None}}),
    ]
    df = spark.createDataFrame([(h, p, "broken" if b is None else json.dumps(b)) for h, p, b in rows], "host_id string, path string, body string")
    names = sorted((r["path"], r["server"]) for r in settings.server_names(df).filter("host_id = 'h1'").collect())
    assert names == [("/a/.mcp.json", "local"), ("/home/.claude.json", "deep"), ("/home/.claude.json", "gh"), ("/home/.claude.json", "jira")]
    got = lambda **k: {r["host_id"]: json.loads(r["servers"]) for r in settings.configured_servers(df, **k).collect()}
    assert got() == {"h1": ["deep", "gh", "jira"], "h4": ["ü 'q'"]}
    assert got(folder="/a/")["h1"] == ["deep", "gh", "jira", "local"] and got(folder="/z")["h1"] == ["deep", "gh", "jira"]
    assert "secret" not in str(settings.server_names(df).collect())


def event(i, kind, ts, **more):
    base = {"event_id": i, "event_type": kind, "ts": ts, "dt": f"1970-01-{1 + ts // 86_400_000:02}", "host_id": "h", "agent": "claude-code", "source": "log"}
    return tuple((base | more).get(c) for c in EVENT_SCHEMA.names)


def test_sketches_of_days_merge_to_quantiles_of_ranges(spark):
    rng = random.Random(2)
    rows = [event(f"e{k}", "tool.result", rng.randrange(5) * 86_400_000 + k, session_id=f"s{k % 7}", tool_name=rng.choice(["a", "b"]), duration_ms=int(rng.lognormvariate(6, 2))) for k in range(6000)]
    rows += [event(f"f{k}", "tool.result", 5, tool_name="few", duration_ms=10 * k, session_id="s") for k in range(4)] + [event("n", "tool.result", 5, tool_name="a"), event("m", "tool.call", 5, tool_name="a", duration_ms=10**9)]
    e = spark.createDataFrame(rows, EVENT_SCHEMA)
    daily = quantiles.daily_sketches(e)
    assert daily.filter("tool_name = 'a'").count() == 5
    for first, last in (("1970-01-01", "1970-01-05"), ("1970-01-02", "1970-01-03")):
        got = {r["tool_name"]: r for r in quantiles.over_days(daily, first, last).collect()}
        want = {r["tool_name"]: r for r in quantiles.exact_over_days(e, first, last).collect()}
        assert got.keys() == want.keys()
        for name, r in got.items():
            assert r["n"] == want[name]["n"]
            values = sorted(x for (t, d, x) in ((v[EVENT_SCHEMA.names.index("tool_name")], v[EVENT_SCHEMA.names.index("dt")], v[EVENT_SCHEMA.names.index("duration_ms")]) for v in rows if v[EVENT_SCHEMA.names.index("event_type")] == "tool.result") if t == name and first <= d <= last and x is not None)
            assert len(values) == r["n"]
            for p in (0.5, 0.95):
                at = r[f"p{round(100 * p)}"]
                low, high = sum(x < at for x in values) / len(values), sum(x <= at for x in values) / len(values)
                assert low - 0.03 <= p <= high + 0.03  # twice the sketch's error
                assert want[name][f"p{round(100 * p)}"] == values[max(0, -(-int(p * 100) * len(values) // 100) - 1)]
    few = {r["tool_name"]: r for r in quantiles.over_days(daily, "1970-01-01", "1970-01-01").collect()}["few"]
    assert (few["p50"], few["p95"]) == (10, 30)


def test_a_second_link_undoes_the_first(spark, tmp_path):
    folder = lambda x: str(tmp_path / x)
    source = folder("in")
    api = lambda i, ts, key, **more: event(i, "api.request", ts, client="claude_desktop", session_id="desk", correlation_key=key, **more)
    link = lambda i, key, chat, ts=0: event(i, "message.usage.link", ts, correlation_confidence="content_match", session_id=chat, turn_id="m", parent_session_id="desk", correlation_key=key)
    day = 86_400_000
    batches = [
        [api("a", 0, "k1"), api("b", day, "k2"), event("other", "turn", 0, session_id="x")],
        [link("l1", "k1", "chat-1", 3 * day), link("l2", "k2", "chat-2", 3 * day)],
        [link("l3", "k1", "chat-9", 4 * day), api("c", 5 * day, "k2")],  # contradicts l1, days later; and one more for l2
        [event("r", "message.usage.link.rejected", 6 * day, session_id="desk", correlation_key="k2")],
    ]
    want = [{"a": "desk", "b": "desk", "other": "x"}, {"a": "chat-1", "b": "chat-2", "other": "x"}, {"a": "desk", "b": "chat-2", "c": "chat-2", "other": "x"}, {"a": "desk", "b": "desk", "c": "desk", "other": "x"}]
    write = links.linker(folder("events"), folder("facts"), folder("resolved"))
    for rows, after in zip(batches, want, strict=True):
        spark.createDataFrame(rows, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = spark.readStream.schema(EVENT_SCHEMA).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", folder("checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        assert {r["event_id"]: r["session_id"] for r in read_events(spark, folder("resolved")).collect()} == after
    last = spark.createDataFrame(batches[-1], EVENT_SCHEMA)
    write(last, 99)  # a batch that comes again
    assert {r["event_id"]: r["session_id"] for r in read_events(spark, folder("resolved")).collect()} == want[-1]


def test_tables_sort_unknown_values_last(spark):
    df = spark.createDataFrame([("a", 2), ("b", None), ("c", 1), ("d", 2), ("e", None)], "name string, n int")
    order = lambda down: [r["name"] for r in folds.sorted_table(df, "n", down, "name").collect()]
    assert order(True) == ["a", "d", "c", "b", "e"] and order(False) == ["c", "a", "d", "b", "e"]
