"""An agent activity log derived from the driver's `events` table, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TODAY, SILENT_BEFORE_MS = "2024-01-30", 1_706_572_800_000

# Expressions that both engines read alike; {div} is integer division.
BASE = {
    "session_id": "CASE WHEN h % 97 <> 0 THEN 's' || CAST(u AS {text}) || '-' || CAST(ms {div} 864000000 AS {text}) END",
    "host_id": "'host-' || CAST(u % 7 AS {text})",
    "agent": "CASE WHEN u % 4 = 3 THEN 'codex' ELSE 'claude-code' END",
    "repo": "CASE WHEN u % 5 <> 0 THEN 'org/repo-' || CAST(u % 5 AS {text}) END",
    "tool_ix": "(u + h % 3) % 8",
    "agent_id": "CASE WHEN h % 11 < 3 THEN 'ag' || CAST(h % 3 AS {text}) END",
    "d": "CASE WHEN h % 23 = 0 THEN 10000 + h % 50000 ELSE h % 3000 END",
    "model": "CASE h % 3 WHEN 0 THEN 'claude-opus' WHEN 1 THEN 'claude-sonnet' END",
    "client": "CASE u % 3 WHEN 0 THEN 'claude_code_cli' WHEN 1 THEN 'claude_desktop_code' END",
    "user_id": "CASE WHEN u % 10 <> 0 THEN 'user-' || CAST(u AS {text}) END",
    "turn_id": "'t' || CAST(e {div} 10 AS {text})",
    "usable": "t IN ('click', 'view', 'error') AND NOT (t = 'error' AND h % 5 = 0)",
}
ROWS = {  # which source rows become which log rows
    "call": "usable", "resh": "usable", "reso": "usable AND h % 4 <> 0", "deny": "t = 'error' AND h % 5 = 0",
    "apio": "t = 'purchase' AND u % 3 <> 0", "apil": "t = 'purchase' AND u % 2 = 0", "apie": "t = 'purchase' AND h % 17 = 0", "sess": "t = 'signup'",
}
TYPED = {
    "source": "CASE WHEN tag IN ('reso', 'apio', 'apie') THEN 'otel' WHEN tag = 'apil' OR (tag = 'sess' AND h % 2 = 1) THEN 'log' ELSE 'hook' END",
    "event_type": "CASE tag WHEN 'call' THEN 'tool.call' WHEN 'resh' THEN 'tool.result' WHEN 'reso' THEN 'tool.result' WHEN 'deny' THEN 'tool.denied' WHEN 'apie' THEN 'api.error' WHEN 'sess' THEN CASE h % 5 WHEN 0 THEN 'session.start' WHEN 1 THEN 'session.end' WHEN 2 THEN 'turn' WHEN 3 THEN 'compaction' ELSE 'subagent.stop' END ELSE 'api.request' END",
    "ts": "CASE tag WHEN 'resh' THEN ms + 1 + h % 5000 WHEN 'reso' THEN ms + 2 + h % 5000 ELSE ms END",
}
FINAL = {
    "event_id": "CAST(e AS {text}) || '-' || tag", "session_id": "session_id", "host_id": "host_id", "agent": "agent", "repo": "repo", "source": "source", "event_type": "event_type", "ts": "ts",
    "agent_id": "agent_id", "client": "client", "user_id": "user_id", "turn_id": "turn_id", "model": "model",
    "agent_version": "CASE WHEN u % 6 <> 0 THEN '1.' || CAST(u % 3 AS {text}) || '.' || CAST(ms {div} 864000000 AS {text}) END",
    "estimated_input_tokens": "CASE WHEN event_type = 'turn' THEN h % 400 END", "estimated_output_tokens": "CASE WHEN event_type = 'subagent.stop' THEN h % 900 END",
    "agent_type": "CASE agent_id WHEN 'ag0' THEN 'Explore' WHEN 'ag1' THEN 'review' END",
    "query_source": "CASE WHEN agent_id IS NULL THEN 'main' ELSE 'subagent' END",
    "tool_name": "CASE WHEN event_type LIKE 'tool.%' THEN CASE tool_ix WHEN 0 THEN 'Bash' WHEN 1 THEN 'Read' WHEN 2 THEN 'mcp__github__search' WHEN 3 THEN 'mcp__jira__create' WHEN 4 THEN 'mcp__playwright__navigate' WHEN 5 THEN 'Skill' WHEN 6 THEN 'Edit' ELSE 'WebFetch' END END",
    "tool_kind": "CASE WHEN event_type LIKE 'tool.%' THEN CASE tool_ix WHEN 0 THEN 'bash' WHEN 2 THEN 'mcp' WHEN 3 THEN 'mcp' WHEN 4 THEN 'browser' WHEN 7 THEN 'browser' WHEN 5 THEN 'skill' ELSE 'builtin' END END",
    "mcp_server": "CASE WHEN event_type LIKE 'tool.%' THEN CASE tool_ix WHEN 2 THEN 'github' WHEN 3 THEN 'jira' WHEN 4 THEN 'playwright' END END",
    "skill_name": "CASE WHEN event_type LIKE 'tool.%' AND tool_ix = 5 THEN 'skill-' || CAST(k % 4 AS {text}) END",
    "correlation_key": "CASE WHEN event_type LIKE 'tool.%' AND h % 9 <> 0 THEN 'tu-' || CAST(e AS {text}) END",
    "success": "CASE WHEN tag IN ('resh', 'reso') THEN t <> 'error' END",
    "duration_ms": "CASE WHEN tag = 'reso' OR (tag = 'resh' AND h % 2 = 0) THEN d WHEN tag = 'apio' THEN h % 3000 WHEN tag = 'sess' AND h % 5 = 4 THEN h % 90000 END",
    "input_tokens": "CASE WHEN tag = 'apil' OR (tag = 'apio' AND h % 13 <> 0) THEN h % 60000 END",
    "output_tokens": "CASE WHEN tag IN ('apio', 'apil') THEN CAST(floor(v * 10) AS BIGINT) END",
    "cache_read_tokens": "CASE WHEN event_type = 'api.request' THEN (h * 7) % 50000 END",
    "cache_write_tokens": "CASE WHEN event_type = 'api.request' AND h % 10 <> 0 THEN h % 3000 END",
    "reasoning_tokens": "CASE WHEN tag = 'apil' THEN h % 100 END",
    "cost_usd": "CASE WHEN tag = 'apio' AND h % 7 <> 0 THEN v / 1000.0E0 END",
    "effort": "CASE WHEN event_type LIKE 'api.%' THEN CASE h % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END END",
    "configured_mcp_servers": "CASE WHEN event_type IN ('session.start', 'session.end') THEN CASE h % 4 WHEN 0 THEN '[\"github\",\"jira\"]' WHEN 1 THEN '[\"github\"]' WHEN 2 THEN '[\"jira\",\"notion\",\"playwright\"]' END END",
    "configured_skills": "CASE WHEN event_type = 'session.end' AND h % 3 <> 0 THEN CASE WHEN h % 2 = 0 THEN '[\"skill-0\",\"skill-1\"]' ELSE '[\"skill-1\",\"skill-9\"]' END END",
    "provider": "CASE WHEN agent = 'codex' THEN 'openai' ELSE 'anthropic' END",
    "billing_route": "CASE WHEN event_type = 'api.request' THEN CASE h % 6 WHEN 0 THEN 'subscription' WHEN 1 THEN 'api_key' WHEN 2 THEN 'router' END END",
}


def _list(columns: dict[str, str], **words: str) -> list[str]:
    return [f"{x.format(**words)} AS {name}" for name, x in columns.items()]


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan; a source row becomes up to four log rows by exploding the tags that hold for it."""
    words = {"div": "div", "text": "string"}
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)" if isinstance(events.schema["ts"].dataType, T.TimestampNTZType) else "unix_micros(ts)"
    raw = events.selectExpr("event_id AS e", "user_id AS u", "event_type AS t", "value AS v", f"{micros} div 1000 AS ms", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k", "(event_id * 2654435761) % 1000003 AS h")
    base = raw.selectExpr("*", *_list(BASE, **words))
    tags = F.array_compact(F.array(*(F.when(F.expr(p), F.lit(tag)) for tag, p in ROWS.items())))
    log = base.withColumn("tag", F.explode(tags)).selectExpr("*", *_list(TYPED, **words)).selectExpr(*_list(FINAL, **words))
    from sparktrail.functions.columns import day_of

    return log.withColumn("dt", day_of(F.col("ts")))


def _sql() -> str:
    words = {"div": "//", "text": "VARCHAR"}
    lines = lambda c: ", ".join(_list(c, **words))
    tags = " OR ".join(f"(tag = '{tag}' AND {p})" for tag, p in ROWS.items())
    tag_list = ", ".join(f"'{t}'" for t in ROWS)
    return (
        "raw AS (SELECT event_id AS e, user_id AS u, event_type AS t, value AS v, epoch_us(ts) // 1000 AS ms, CAST(json_extract(props, '$.k') AS BIGINT) AS k, (event_id * 2654435761) % 1000003 AS h FROM events), "
        f"base AS (SELECT *, {lines(BASE)} FROM raw), tagged AS (SELECT *, unnest([{tag_list}]) AS tag FROM base), "
        f"typed AS (SELECT *, {lines(TYPED)} FROM tagged WHERE {tags}), final AS (SELECT {lines(FINAL)} FROM typed), "
        "log AS (SELECT *, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS dt FROM final)"
    )


#: CTEs that end in `log`.
EVENT_LOG_SQL = _sql()
