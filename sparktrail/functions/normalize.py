"""Raw records to events: hook calls, exported logs, session log files, plugin responses.

Each function takes a DataFrame of raw text and returns events; what isn't an event gives no row. Texts of prompts and
tools are never read, as the schemas of the JSON parsers don't have them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktrail.schema import conform

from .carry import Carried, Carry, by_windows
from .columns import day_of
from .scalars import event_id, folder_hash, mcp_server, mcp_tool, tool_kind

# fixed values: names of hook calls and log records, and the events that they are
HOOKS = {
    "PreToolUse": "tool.call", "PostToolUse": "tool.result", "PostToolUseFailure": "tool.result", "PermissionDenied": "tool.denied", "SessionStart": "session.start",
    "SessionEnd": "session.end", "SubagentStart": "subagent.start", "SubagentStop": "subagent.stop", "UserPromptSubmit": "turn", "Stop": "turn",
}
CODEX_HOOKS = {k: v for k, v in HOOKS.items() if k not in ("PostToolUseFailure", "PermissionDenied")}
RECORDS = {"api_request": "api.request", "api_error": "api.error", "tool_result": "tool.result", "tool_decision": "hook.decision", "user_prompt": "turn", "compaction": "compaction"}

_USAGE = "struct<input_tokens: long, output_tokens: long, cache_read_input_tokens: long, cache_creation_input_tokens: long>"
_HOOK = (
    "hook_event_name string, session_id string, cwd string, tool_use_id string, prompt_id string, effort string, timestamp string, agent_id string, agent_type string, tool_name string, "
    "tool_input struct<skill: string>, tool_response struct<success: boolean, error: string, error_type: string, usage: " + _USAGE + ">, error_type string, error string, duration_ms long, "
    "model string, decision_source string, source string, entrypoint string, usage " + _USAGE
)


def looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def millis(text: Column) -> Column:
    """Epoch milliseconds of a number (seconds, or milliseconds from 10^11 on) or an ISO time with offset."""
    number = text.try_cast("bigint")
    stamp = F.unix_millis(F.try_to_timestamp(text))
    return F.coalesce(F.when(F.abs(number) < 100_000_000_000, number * 1000).otherwise(number), stamp)


def _blank(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))


def hooks(raw: DataFrame, host: str, agent: str = "claude-code") -> DataFrame:
    """Events of hook calls: rows (name, body), name being the spool file's, which makes keys without a tool use stable."""
    h = raw.select("name", F.from_json("body", _HOOK).alias("h")).select("name", "h.*").withColumn("event_type", looked_up(F.col("hook_event_name"), HOOKS if agent == "claude-code" else CODEX_HOOKS)).filter("event_type is not null")
    sub = F.col("hook_event_name").isin("SubagentStart", "SubagentStop")
    result, denied = F.col("event_type") == "tool.result", F.col("event_type") == "tool.denied"
    h = h.withColumns({"agent_id": _blank("agent_id"), "agent_type": _blank("agent_type")})
    key = F.when(sub, F.col("agent_id")).otherwise(F.col("tool_use_id"))
    stamp = F.coalesce(millis(F.col("timestamp")), F.regexp_extract("name", r"^(\d+)-", 1).try_cast("bigint"))
    usage = F.coalesce("usage", "tool_response.usage")
    stop = F.col("event_type") == "subagent.stop"
    kind = tool_kind(F.col("tool_name"), shells=agent != "claude-code")
    return conform(
        h, event_id=event_id(F.lit(host), F.lit("hook"), F.col("event_type"), F.coalesce(key, F.concat_ws("#", F.coalesce("session_id", F.lit("")), "name"))), ts=stamp, dt=day_of(stamp), host_id=F.lit(host), agent=F.lit(agent),
        source=F.lit("hook"), turn_id=F.col("prompt_id"), cwd_hash=folder_hash(F.col("cwd")), correlation_key=key, correlation_confidence=F.when(key.isNotNull(), "exact").otherwise("none"),
        query_source=F.when(F.col("agent_id").isNotNull(), "subagent").when(~sub, "main"), tool_kind=kind, mcp_server=mcp_server(F.col("tool_name")), mcp_tool=mcp_tool(F.col("tool_name")),
        skill_name=F.when(kind == "skill", F.col("tool_input.skill")), duration_ms=F.when(result, F.col("duration_ms")), success=F.when(result, F.col("tool_response.success")),
        error_type=F.when(result, F.coalesce("tool_response.error", "tool_response.error_type", "error_type", "error")), decision=F.when(denied, "deny"), decision_source=F.when(denied, F.coalesce("decision_source", "source")),
        model=F.when(F.col("event_type") == "session.start", F.col("model")), input_tokens=F.when(stop, usage["input_tokens"]), output_tokens=F.when(stop, usage["output_tokens"]),
        cache_read_tokens=F.when(stop, usage["cache_read_input_tokens"]), cache_write_tokens=F.when(stop, usage["cache_creation_input_tokens"]), client=F.lit(None),
    )


_ATTRIBUTES = "array<struct<key: string, value: struct<stringValue: string, intValue: string, doubleValue: string, boolValue: boolean>>>"
_LOGS = f"resourceLogs array<struct<resource: struct<attributes: {_ATTRIBUTES}>, scopeLogs: array<struct<logRecords: array<struct<timeUnixNano: string, observedTimeUnixNano: string, eventName: string, body: struct<stringValue: string>, traceId: string, spanId: string, attributes: {_ATTRIBUTES}>>>>>>"


def attributes(column: str) -> Column:
    """A map of names to (kind, text) from a list of typed attributes; the first of a name counts.

    kind: string, int, double or bool; lists, maps and bytes have neither kind nor text.
    """
    kinds = {"string": "stringValue", "int": "intValue", "double": "doubleValue", "bool": "boolValue"}

    def read(x: Column) -> Column:
        kind, text = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name, field in reversed(kinds.items()):
            value = x["value"][field].cast("string")
            kind, text = F.when(value.isNotNull(), name).otherwise(kind), F.coalesce(value, text)
        return F.struct(kind.alias("kind"), text.alias("text")).cast("struct<kind: string, text: string>")

    listed = F.filter(F.coalesce(column, F.array().cast(_ATTRIBUTES)), lambda x: x["key"].isNotNull())
    names = F.array_distinct(F.transform(listed, lambda x: x["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.transform(F.filter(listed, lambda x: x["key"] == n), read), 1)))


def as_text(v: Column) -> Column:
    return v["text"]


def as_long(v: Column) -> Column:
    """Whole numbers, also written as texts; of doubles the whole part. Texts of fractions, and booleans, aren't numbers."""
    whole = F.trim(v["text"]).try_cast("bigint")
    return F.when(v["kind"] == "double", v["text"].try_cast("double").try_cast("bigint")).when(v["kind"].isin("int", "string"), whole)


def as_double(v: Column) -> Column:
    return F.when(v["kind"] != "bool", F.trim(v["text"]).try_cast("double"))


def as_flag(v: Column) -> Column:
    """Booleans and their texts; of whole numbers whether they aren't 0."""
    text = F.trim(v["text"])
    return F.when(v["kind"] == "int", text.try_cast("bigint") != 0).when(v["kind"].isin("bool", "string"), F.when(text == "true", True).when(text == "false", False))


def log_records(raw: DataFrame) -> DataFrame:
    """Log records of exported JSON requests (column body), with attributes; the record's go before the resource's."""
    r = raw.select(F.explode(F.from_json("body", _LOGS)["resourceLogs"]).alias("r")).select(attributes("r.resource.attributes").alias("shared"), F.explode("r.scopeLogs").alias("s"))
    r = r.select("shared", F.explode("s.logRecords").alias("l")).withColumn("own", attributes("l.attributes"))
    merged = F.map_concat("own", F.map_filter("shared", lambda k, _: ~F.map_contains_key(F.col("own"), k)))
    time = lambda c: F.nullif(F.col(c).try_cast("bigint"), F.lit(0))
    return r.select(merged.alias("a"), F.coalesce(F.nullif("l.eventName", F.lit("")), as_text(F.element_at("own", "event.name")), "l.body.stringValue").alias("name"), F.coalesce(time("l.timeUnixNano"), time("l.observedTimeUnixNano")).alias("nanos"), F.col("l.traceId").alias("trace"), F.col("l.spanId").alias("span"))


def otlp_logs(raw: DataFrame, host: str, now_ms: int) -> DataFrame:
    """Events of the first agent's log export."""
    r = log_records(raw).withColumn("short", F.regexp_replace("name", r"^claude_code\.", "")).withColumn("event_type", looked_up(F.col("short"), RECORDS)).filter("event_type is not null")
    a = lambda k: as_text(F.element_at("a", k))
    number = lambda k: as_long(F.element_at("a", k))
    blank = F.lit("")
    key = F.concat_ws(":", F.lit("record"), F.coalesce(a("session.id"), blank), F.col("nanos").cast("string"), F.coalesce("trace", blank), F.coalesce("span", blank), F.coalesce(a("tool_use_id"), blank))
    stamp = F.coalesce(F.expr("nanos div 1000000"), F.lit(now_ms))
    tool = a("tool_name")
    return conform(
        r, event_id=event_id(F.lit(host), F.lit("otel"), F.col("event_type"), key), ts=stamp, dt=day_of(stamp), org_id=a("organization.id"), user_id=a("user.email"), user_id_source=F.when(a("user.email").isNotNull(), "agent_email"),
        host_id=F.lit(host), agent=F.lit("claude-code"), source=F.lit("otel"), session_id=a("session.id"), correlation_key=a("tool_use_id"), correlation_confidence=F.when(a("tool_use_id").isNotNull(), "exact").otherwise("none"),
        tool_name=tool, tool_kind=tool_kind(tool), mcp_server=mcp_server(tool), mcp_tool=mcp_tool(tool), model=a("model"), effort=a("effort"), agent_type=a("agent.name"), query_source=a("query_source"),
        input_tokens=number("input_tokens"), output_tokens=number("output_tokens"), cache_read_tokens=number("cache_read_tokens"), cache_write_tokens=number("cache_creation_tokens"), cost_usd=as_double(F.element_at("a", "cost_usd")),
        duration_ms=number("duration_ms"), success=as_flag(F.element_at("a", "success")), error_type=F.when(F.col("event_type") == "api.error", a("error")), decision=a("decision"), decision_source=F.when(F.col("event_type") == "hook.decision", a("source")),
    )


def codex_responses(raw: DataFrame, host: str, now_ms: int) -> DataFrame:
    """API requests of the second agent's log export; warm-ups (two input tokens at most, nothing else) are dropped."""
    a = lambda k: as_text(F.element_at("a", k))
    n = lambda k: as_long(F.element_at("a", f"{k}_token_count"))
    r = log_records(raw).filter((a("event.name") == "codex.sse_event") & (a("event.kind") == "response.completed"))
    warm = (F.coalesce(n("input"), F.lit(0)) <= 2) & (F.coalesce(n("output"), F.lit(0)) + F.coalesce(n("cached"), F.lit(0)) + F.coalesce(n("reasoning"), F.lit(0)) == 0)
    stamp = F.coalesce(millis(a("event.timestamp")), F.expr("nanos div 1000000"), F.lit(now_ms))
    counters = F.concat_ws(":", *(F.coalesce(n(k).cast("string"), F.lit("")) for k in ("input", "output", "cached", "reasoning", "tool")))
    return conform(
        r.filter(~warm), event_id=event_id(F.lit(host), F.lit("usage"), F.lit("api.request"), F.concat_ws(":", F.coalesce(a("conversation.id"), F.lit("")), counters)), ts=stamp, dt=day_of(stamp), host_id=F.lit(host), agent=F.lit("codex"), source=F.lit("otel"),
        session_id=a("conversation.id"), event_type=F.lit("api.request"), provider=F.lit("openai"), model=a("model"), input_tokens=n("input"), output_tokens=n("output"), cache_read_tokens=n("cached"), reasoning_tokens=n("reasoning"), usage_source=F.lit("agent"), client=a("originator"),
    )


_LINE = (
    "type string, sessionId string, timestamp string, cwd string, version string, uuid string, promptId string, isMeta boolean, isSidechain boolean, agentId string, isCompactSummary boolean, requestId string, effort string, "
    "isApiErrorMessage boolean, message struct<id: string, model: string, usage: " + _USAGE + ", content: string>, attachment struct<type: string, names: array<string>, addedNames: array<string>>"
)
_CONTENT = "array<struct<type: string, id: string, name: string, input: struct<skill: string>, tool_use_id: string, is_error: boolean>>"


_MADE = (
    "event_type string, key string, ts long, session_id string, agent_version string, cwd string, agent_id string, turn_id string, model string, provider string, effort string, "
    "input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, reasoning_tokens long, tool_name string, skill_name string, "
    "correlation_key string, correlation_confidence string, success boolean, duration_ms long, configured_skills string"
)
_MADE_TYPES = dict(x.split() for x in _MADE.split(", "))


def _made(kind: str | Column, key: Column, when: Column | None = None, **fields: Column) -> Column:
    """An event as a struct of _MADE; null where `when` doesn't hold."""
    values = fields | {"event_type": F.lit(kind) if isinstance(kind, str) else kind, "key": key}
    whole = F.struct(*(values.get(c, F.lit(None)).cast(t).alias(c) for c, t in _MADE_TYPES.items()))
    return whole if when is None else F.when(when, whole)


def _transcript_facts(lines: DataFrame) -> DataFrame:
    """What single lines of session files say: (file, line_no, line) with their fields."""
    x = lines.withColumn("j", F.from_json("line", _LINE)).select(*lines.columns, "j.*").withColumn("ts", millis(F.col("timestamp")))
    x = x.withColumn("parts", F.from_json("message.content", _CONTENT))
    no = F.lit(False)
    prompt = (F.col("type") == "user") & ~F.coalesce("isMeta", no) & ~F.coalesce("isCompactSummary", no) & ~F.coalesce(F.exists("parts", lambda p: p["type"] == "tool_result"), no)
    asked = (F.col("type") == "assistant") & F.col("message.usage").isNotNull() & F.col("ts").isNotNull() & ~F.coalesce("isApiErrorMessage", no)
    listed = F.coalesce("attachment.names", "attachment.addedNames")
    timed = lambda kind: F.when(F.col("ts").isNotNull(), F.filter("parts", lambda p: p["type"] == kind))
    x = x.withColumns({"prompt": F.coalesce(prompt, no), "calls": timed("tool_use"), "results": timed("tool_result")})
    return x.withColumns(
        {
            "prompt_turn": F.when(F.col("prompt"), F.coalesce("promptId", "uuid")),
            "request": F.when(asked, F.coalesce("requestId", "message.id")),
            "skills": F.when(F.col("attachment.type") == "skill_listing", F.to_json(F.array_sort(F.array_distinct(listed)))),
            "defined": F.transform("calls", lambda p: F.struct(p["id"].alias("id"), p["name"].alias("name"), F.col("ts"))),
            "referred": F.transform("results", lambda p: p["tool_use_id"]),
        }
    )


#: A line's turn is the last prompt's, a request counts at its first line, a result finds its call by id.
TRANSCRIPT = Carried(last=("prompt_turn", "skills"), first=("sessionId", "version", "cwd", "agentId"), fresh="request", named=("defined", "referred"))


def transcripts(lines: DataFrame, host: str, carry: Carry = by_windows) -> DataFrame:
    """Events of session log files: rows (file, line_no, line), any number of files, whole ones unless `carry` keeps state.

    A file begins with session.start at its first time, unless it is a subagent's, and ends with session.end or
    subagent.stop; the former carries the last list of skills that was shown. Each line is read once, however many kinds of
    events it gives.
    """
    spec = TRANSCRIPT
    x = carry(_transcript_facts(lines), spec)
    if "type" not in x.columns:  # state hands on the line alone
        x = _transcript_facts(x)
    own = F.concat_ws("#", "file", F.col("line_no").cast("string"))
    line = {"ts": F.col("ts"), "session_id": F.col("sessionId"), "agent_version": F.col("version"), "cwd": F.col("cwd"), "agent_id": F.col("agentId"), "turn_id": F.col("last_prompt_turn")}
    whole = {"session_id": F.col("first_sessionId"), "agent_version": F.col("first_version"), "cwd": F.col("first_cwd"), "agent_id": F.col("first_agentId")}
    timed, main, u = F.col("ts").isNotNull(), F.col("first_agentId").isNull(), F.col("message.usage")
    no = F.lit(False)
    ends = F.coalesce("ended", no) & F.col("to_ts").isNotNull()
    calls = F.transform("calls", lambda p: _made("tool.call", F.coalesce(p["id"], own), correlation_key=p["id"], correlation_confidence=F.lit("exact"), skill_name=F.when(p["name"] == "Skill", p["input"]["skill"]), tool_name=p["name"], **line))

    def result(p: Column) -> Column:
        call = F.element_at(F.col("known"), p["tool_use_id"])
        took = F.when(F.col("ts") >= call["ts"], F.col("ts") - call["ts"])
        return _made("tool.result", F.coalesce(p["tool_use_id"], own), correlation_key=p["tool_use_id"], correlation_confidence=F.lit("exact"), success=~F.coalesce(p["is_error"], no), duration_ms=took, tool_name=call["name"], **line)

    counters = {"input_tokens": u["input_tokens"], "output_tokens": u["output_tokens"], "cache_read_tokens": u["cache_read_input_tokens"], "cache_write_tokens": u["cache_creation_input_tokens"]}
    single = F.array(
        _made("session.start", F.col("file"), F.col("begins") & main, **whole | {"ts": F.col("ts")}),
        _made("turn", F.coalesce("uuid", own), F.col("prompt") & timed, **line),
        _made("compaction", F.coalesce("uuid", own), F.coalesce("isCompactSummary", no) & timed, **line),
        _made("api.request", F.col("request"), F.coalesce("fresh", no), model=F.col("message.model"), provider=F.lit("anthropic"), **counters, **line),
        _made("api.error", F.coalesce("uuid", own), F.coalesce("isApiErrorMessage", no) & timed, model=F.col("message.model"), **line),
    )
    last = F.array(
        _made("session.end", F.col("file"), ends & main, configured_skills=F.col("last_skills"), turn_id=F.col("last_prompt_turn"), **whole | {"ts": F.col("to_ts")}),
        _made("subagent.stop", F.col("file"), ends & ~main, duration_ms=F.col("to_ts") - F.col("from_ts"), turn_id=F.col("last_prompt_turn"), **whole | {"ts": F.col("to_ts")}),
    )
    none = F.array().cast(f"array<struct<{_MADE}>>")
    made = F.concat(F.array_compact(single), F.coalesce(calls, none), F.coalesce(F.transform("results", result), none), F.array_compact(last))
    e = x.select(F.explode(made).alias("e")).select("e.*")
    tool = F.col("tool_name")
    return conform(
        e, event_id=event_id(F.lit(host), F.lit("log"), F.col("event_type"), F.col("key")), dt=day_of(F.col("ts")), host_id=F.lit(host), agent=F.lit("claude-code"), source=F.lit("log"), cwd_hash=folder_hash(F.col("cwd")),
        query_source=F.when(F.col("agent_id").isNotNull(), "subagent").otherwise("main"), tool_kind=tool_kind(tool), mcp_server=mcp_server(tool), mcp_tool=mcp_tool(tool),
    )


_ROLLOUT = "timestamp string, type string, payload string"


def _rollout_facts(lines: DataFrame) -> DataFrame:
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    x = lines.withColumn("j", F.from_json("line", _ROLLOUT)).select(*lines.columns, "j.*").withColumn("ts", millis(F.col("timestamp")))
    said = lambda kind, k: F.when((F.col("type") == kind) & F.col("ts").isNotNull(), get(k))
    event = F.when((F.col("type") == "event_msg") & F.col("ts").isNotNull(), get("type"))
    return x.withColumns(
        {
            "event": event, "session": said("session_meta", "id"), "cli": said("session_meta", "cli_version"), "named_model": said("turn_context", "model"), "named_effort": said("turn_context", "effort"),
            "turn": said("turn_context", "turn_id"), "usage": F.when(event == "token_count", get("info.total_token_usage")),
        }
    )


#: Session, model, effort and turn hold until they are said anew; a usage total is compared with the one before.
ROLLOUT = Carried(last=("session", "cli", "named_model", "named_effort", "turn"), previous=("usage",))


def rollouts(lines: DataFrame, host: str, carry: Carry = by_windows) -> DataFrame:
    """Events of the second agent's session files: rows (file, line_no, line), whole files unless `carry` keeps state.

    A usage total equal to the one before is no request. Lines without a time don't count.
    """
    x = carry(_rollout_facts(lines), ROLLOUT)
    if "type" not in x.columns:
        x = _rollout_facts(x)
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    n = lambda k: get(f"info.last_token_usage.{k}").try_cast("bigint")
    own = F.concat_ws("#", "file", F.col("line_no").cast("string"))
    line = {"ts": F.col("ts"), "session_id": F.col("last_session"), "agent_version": F.col("last_cli"), "model": F.col("last_named_model"), "effort": F.col("last_named_effort"), "turn_id": F.col("last_turn")}
    tool = F.coalesce(get("item.tool"), F.when(get("item.command").isNotNull(), "shell"))
    name = F.when(get("item.server").isNotNull(), F.concat(F.lit("mcp__"), get("item.server"), F.lit("__"), tool)).otherwise(tool)
    key, done = get("item.id"), (F.col("event") == "item_completed") & tool.isNotNull()
    used = F.col("usage").isNotNull() & ~F.col("usage").eqNullSafe(F.col("previous_usage"))
    made = F.array_compact(F.array(
        _made("session.start", own, (F.col("type") == "session_meta") & F.col("ts").isNotNull(), **line),
        _made("turn", own, F.col("event") == "task_started", **line),
        _made("api.request", own, used, input_tokens=n("input_tokens"), output_tokens=n("output_tokens"), cache_read_tokens=n("cached_input_tokens"), reasoning_tokens=n("reasoning_output_tokens"), **line),
        _made("tool.call", F.coalesce(key, own), done, tool_name=name, correlation_key=key, **line),
        _made("tool.result", F.coalesce(key, own), done, tool_name=name, correlation_key=key, success=get("item.exit_code").try_cast("bigint") == 0, duration_ms=get("item.duration_ms").try_cast("bigint"), **line),
    ))
    e = x.select(F.explode(made).alias("e")).select("e.*")
    tool = F.col("tool_name")
    return conform(
        e, event_id=event_id(F.lit(host), F.lit("log"), F.col("event_type"), F.col("key")), dt=day_of(F.col("ts")), host_id=F.lit(host), agent=F.lit("codex"), source=F.lit("log"), provider=F.lit("openai"),
        tool_kind=tool_kind(tool, shells=True), mcp_server=mcp_server(tool), mcp_tool=mcp_tool(tool),
    )


_PLUGIN = "session_id string, response_id string, model string, timestamp_ms long, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long"


def plugin_responses(raw: DataFrame, host: str, largest: int = 4096) -> DataFrame:
    """API requests from a plugin's reports (column body); reports too long, incomplete or with negative counts are dropped."""
    r = raw.filter(F.octet_length("body") <= largest).select(F.from_json("body", _PLUGIN).alias("p")).select("p.*")
    sound = F.col("response_id").rlike("^[A-Za-z0-9_-]{1,128}$") & F.col("session_id").rlike("^[A-Za-z0-9_-]{1,128}$") & (F.col("timestamp_ms") > 0)
    for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"):
        sound = sound & (F.col(c) >= 0)
    return conform(r.filter(sound), event_id=event_id(F.lit(host), F.lit("log"), F.lit("api.request"), F.col("response_id")), ts=F.col("timestamp_ms"), dt=day_of(F.col("timestamp_ms")), host_id=F.lit(host), agent=F.lit("claude-code"), source=F.lit("log"), event_type=F.lit("api.request"), correlation_key=F.col("response_id"), provider=F.lit("anthropic"), client=F.lit("claude_desktop"))


def usage_limits(raw: DataFrame) -> DataFrame:
    """(agent, account, observed_at, windows) from limit reports (column body); percents out of 0..100 are dropped."""
    kind = "agent string, account string, observed_at long, windows array<struct<name: string, used_percent: double, window_minutes: long, resets_at: long>>"
    r = raw.select(F.from_json("body", kind).alias("u")).select("u.*").filter("agent is not null and observed_at is not null")
    return r.withColumn("windows", F.filter("windows", lambda w: w["used_percent"].between(0, 100)))


def latest_limits(limits: DataFrame) -> DataFrame:
    """The last report of each agent and account (of equally late ones the greatest); reports are never summed."""
    return limits.groupBy("agent", "account").agg(F.max(F.struct("observed_at", "windows")).alias("x")).select("agent", "account", "x.*")
