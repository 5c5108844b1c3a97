"""Session files, rollouts and settings written from the event log and read again by the normalisers, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrail.functions import normalize
from sparktrail.session import shared_folder, stored
from sparktrail.sources.ledger import Ledger
from sparktrail.sources.settings import configured_servers

from .oracle import _q

COLUMNS = ["event_id", "event_type", "ts", "session_id", "turn_id", "tool_name", "tool_kind", "mcp_server", "model", "input_tokens", "output_tokens", "success", "duration_ms", "correlation_key"]


def _lines(e: DataFrame, line: Column) -> DataFrame:
    """A file for each session, a line for each row in the order of time and id."""
    order = Window.partitionBy("session_id").orderBy("ts", "event_id")
    numbered = e.filter("session_id is not null").withColumn("line_no", F.row_number().over(order))
    return stored(numbered.select(F.col("session_id").alias("file"), "line_no", line.alias("line")).filter("line is not null"))


def _written(**fields: Column | str) -> Column:
    return F.to_json(F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items())))


def transcript_events(e: DataFrame) -> DataFrame:
    kind, at = F.col("event_type"), {"timestamp": F.col("ts").cast("string"), "sessionId": F.col("session_id")}
    of_hook = F.col("source") == "hook"
    call = F.array(F.struct(F.lit("tool_use").alias("type"), F.col("event_id").alias("id"), F.col("tool_name").alias("name")))
    result = F.array(F.struct(F.lit("tool_result").alias("type"), F.regexp_replace("event_id", "resh$", "call").alias("tool_use_id"), (~F.col("success")).alias("is_error")))
    usage = F.struct("input_tokens", "output_tokens")
    said = F.struct(F.lit("x").alias("content"))
    line = (
        F.when((kind == "tool.call") & of_hook, _written(type="assistant", message=F.struct(call.alias("content")), **at))
        .when((kind == "tool.result") & of_hook, _written(type="user", message=F.struct(result.alias("content")), **at))
        .when((kind == "api.request") & (F.col("source") == "otel"), _written(type="assistant", requestId=F.col("turn_id"), message=F.struct("model", usage.alias("usage")), **at))
        .when(kind == "turn", _written(type="user", uuid=F.col("event_id"), message=said, **at))
        .when(kind == "compaction", _written(type="user", uuid=F.col("event_id"), isCompactSummary=F.lit(True), message=said, **at))
        .when(kind == "api.error", _written(type="assistant", uuid=F.col("event_id"), isApiErrorMessage=F.lit(True), message=F.struct("model"), **at))
    )
    return normalize.transcripts(_lines(e.filter("agent = 'claude-code'"), line), "h").select(COLUMNS)


_ID = "substr(sha256('h|log|{}|' || {}), 1, 32)"
_TOOL = ("CASE WHEN tool_name LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN CASE split_part(tool_name, '__', 2) WHEN 'playwright' THEN 'browser' ELSE 'mcp' END WHEN tool_name = 'Bash' THEN 'bash' WHEN tool_name "
    "= 'Skill' THEN 'skill' WHEN tool_name = 'WebFetch' THEN 'browser' WHEN tool_name IS NOT NULL THEN 'builtin' END")
_SERVER = "CASE WHEN starts_with(tool_name, 'mcp__') THEN split_part(tool_name, '__', 2) END"

_TRANSCRIPTS = _q([
    """used AS (SELECT *, CASE WHEN event_type = 'turn' THEN event_id END AS prompt FROM log WHERE agent = 'claude-code' AND session_id IS NOT NULL
        AND ((event_type IN ('tool.call', 'tool.result') AND source = 'hook') OR (event_type = 'api.request' AND source = 'otel') OR event_type IN ('turn', 'compaction', 'api.error')))""",
    "placed AS (SELECT *, last_value(prompt IGNORE NULLS) OVER w AS turn, row_number() OVER (PARTITION BY session_id, event_type, turn_id ORDER BY ts, event_id) AS nth FROM used WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))",
    "calls AS (SELECT event_id AS call_id, ts AS call_ts FROM placed WHERE event_type = 'tool.call')",
    "ends AS (SELECT session_id, min(ts) AS a, max(ts) AS b, arg_max(turn, (ts, event_id)) AS turn FROM placed GROUP BY session_id)"],
    f"""SELECT * EXCLUDE (tool), tool AS tool_name, {_TOOL.replace('tool_name', 'tool')} AS tool_kind, {_SERVER.replace('tool_name', 'tool')} AS mcp_server FROM (
  SELECT {_ID.format('tool.call', 'event_id')} AS event_id, event_type, ts, session_id, turn AS turn_id, tool_name AS tool, NULL::VARCHAR AS model, NULL::BIGINT AS input_tokens, NULL::BIGINT AS output_tokens, NULL::BOOLEAN AS success, NULL::BIGINT AS duration_ms, event_id AS correlation_key FROM placed WHERE event_type = 'tool.call'
  UNION ALL SELECT {_ID.format('tool.result', 'call_id')}, event_type, ts, session_id, turn, tool_name, NULL, NULL, NULL, success, ts - call_ts, call_id FROM placed JOIN calls ON call_id = regexp_replace(event_id, 'resh$', 'call') WHERE event_type = 'tool.result'
  UNION ALL SELECT {_ID.format('api.request', 'turn_id')}, event_type, ts, session_id, turn, NULL, model, input_tokens, output_tokens, NULL, NULL, NULL FROM placed WHERE event_type = 'api.request' AND nth = 1
  UNION ALL SELECT substr(sha256('h|log|' || event_type || '|' || event_id), 1, 32), event_type, ts, session_id, turn, NULL, CASE event_type WHEN 'api.error' THEN model END, NULL, NULL, NULL, NULL, NULL FROM placed WHERE event_type IN ('turn', 'compaction', 'api.error')
  UNION ALL SELECT {_ID.format('session.start', 'session_id')}, 'session.start', a, session_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ends
  UNION ALL SELECT {_ID.format('session.end', 'session_id')}, 'session.end', b, session_id, turn, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ends)""")  # fmt: skip


def rollout_events(e: DataFrame) -> DataFrame:
    kind, at = F.col("event_type"), {"timestamp": F.col("ts").cast("string")}
    message = lambda **f: _written(type="event_msg", payload=F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in f.items())), **at)
    total = F.struct((F.col("output_tokens") % 3).alias("total"))
    info = F.struct(total.alias("total_token_usage"), F.struct("input_tokens", "output_tokens").alias("last_token_usage"))
    item = F.struct(F.col("event_id").alias("id"), F.col("tool_name").alias("tool"), F.when(F.col("success"), 0).otherwise(1).alias("exit_code"), "duration_ms")
    first = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id")) == 1
    line = (
        F.when(F.col("first"), _written(type="session_meta", payload=F.struct(F.col("session_id").alias("id"), F.col("agent_version").alias("cli_version")), **at))
        .when(kind == "turn", _written(type="turn_context", payload=F.struct(F.col("event_id").alias("turn_id"), "model", "effort"), **at))
        .when(kind == "session.end", message(type="task_started"))
        .when(kind == "api.request", message(type="token_count", info=info))
        .when((kind == "tool.result") & (F.col("source") == "hook"), message(type="item_completed", item=item))
    )
    rows = e.filter("agent = 'codex' and session_id is not null").withColumn("first", first)
    return normalize.rollouts(_lines(rows, line), "h").select(COLUMNS)


_SHELL = "CASE WHEN tool_name LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN 'mcp' WHEN lower(tool_name) IN ('bash', 'shell', 'exec') THEN 'bash' WHEN tool_name IS NOT NULL THEN 'builtin' END"
_ROLLOUTS = _q([
    "placed AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS n FROM log WHERE agent = 'codex' AND session_id IS NOT NULL)",
    "kept AS (SELECT *, session_id || '#' || n AS own, CASE WHEN n > 1 AND event_type = 'turn' THEN event_id END AS said, CASE WHEN n > 1 AND event_type = 'turn' THEN model END AS said_model, CASE "
        "WHEN n > 1 AND event_type = 'api.request' AND output_tokens IS NOT NULL THEN output_tokens % 3 END AS total FROM placed)",
    "carried AS (SELECT *, last_value(said IGNORE NULLS) OVER w AS turn, last_value(said_model IGNORE NULLS) OVER w AS now_model, last_value(total IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY "
        "ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM kept WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))",
    "made AS (SELECT CASE WHEN n = 1 THEN 'session.start' WHEN event_type = 'session.end' THEN 'turn' WHEN event_type = 'api.request' AND total IS DISTINCT FROM before AND total IS NOT NULL THEN "
        "'api.request' WHEN event_type = 'tool.result' AND source = 'hook' THEN 'tool' END AS kind, * FROM carried)",
    "sides AS (SELECT * EXCLUDE (event_type), unnest(CASE kind WHEN 'tool' THEN ['tool.call', 'tool.result'] ELSE [kind] END) AS event_type FROM made WHERE kind IS NOT NULL)"],
    f"""SELECT substr(sha256('h|log|' || event_type || '|' || CASE WHEN kind = 'tool' THEN event_id ELSE own END), 1, 32) AS event_id, event_type, ts, session_id, turn AS turn_id, CASE WHEN kind = 'tool' THEN tool_name END AS tool_name, CASE WHEN kind = 'tool' THEN {_SHELL} END AS tool_kind,
    CASE WHEN kind = 'tool' THEN {_SERVER} END AS mcp_server, now_model AS model, CASE WHEN kind = 'api.request' THEN input_tokens END AS input_tokens, CASE WHEN kind = 'api.request' THEN output_tokens END AS output_tokens,
    CASE WHEN event_type = 'tool.result' THEN coalesce(success, false) END AS success, CASE WHEN event_type = 'tool.result' THEN duration_ms END AS duration_ms, CASE WHEN kind = 'tool' THEN made_key END AS correlation_key FROM (SELECT *, CASE WHEN kind = 'tool' THEN event_id END AS made_key FROM sides)""")  # fmt: skip


def host_servers(e: DataFrame) -> DataFrame:
    """Settings files as sessions' server lists would have them, half of them within a project."""
    names = F.from_json("configured_mcp_servers", "array<string>")
    servers = F.map_from_arrays(names, F.transform(names, lambda _: F.struct(F.lit("x").alias("command"))))
    inner = F.struct(F.struct(F.struct(servers.alias("mcpServers")).alias("/a/b")).alias("projects"))
    body = F.when(F.col("ts") % 2 == 0, F.to_json(F.struct(servers.alias("mcpServers")))).otherwise(F.to_json(inner))
    path = F.concat(F.lit("/home/"), "event_id", F.when(F.col("ts") % 3 == 0, F.lit("/.mcp.json")).otherwise(F.lit("/settings.json")))
    files = e.filter("configured_mcp_servers is not null").select("host_id", path.alias("path"), body.alias("body"))
    return configured_servers(files)


_HOST_SERVERS = _q([], "SELECT host_id, CAST(to_json(list_sort(list(DISTINCT name))) AS VARCHAR) AS servers FROM (SELECT host_id, unnest(from_json(configured_mcp_servers, '[\"VARCHAR\"]')) AS name FROM log WHERE configured_mcp_servers IS NOT NULL AND ts % 3 <> 0) GROUP BY host_id")

def ledger_rows(e: DataFrame) -> DataFrame:
    """Two pages of changes, made of the log's rows by their numbers, applied to a ledger of local rows."""
    number = F.regexp_extract("event_id", r"^(\d+)-", 1).cast("long")
    tag = F.array_position(F.array(*map(F.lit, ("call", "resh", "reso", "deny", "apio", "apil", "apie", "sess"))), F.regexp_extract("event_id", "-(.*)$", 1))
    rows = stored(e.select("event_id", "event_type", number.alias("n"), (number * 8 + tag).alias("sequence")))
    ledger, far = Ledger(e.sparkSession, shared_folder(e.sparkSession, "ledger")), 10**12
    ledger.record(rows.filter("n % 7 = 0").select("event_id", F.col("event_type").alias("payload")))
    ledger.apply_page("r", 0, far, rows.filter("n % 2 = 0").select("sequence", "event_id", F.lit(False).alias("deleted"), F.lit("v1").alias("payload")))
    gone = F.col("n") % 5 == 0
    ledger.apply_page("r", far, 2 * far, rows.filter("n % 3 = 0").select((F.col("sequence") + far).alias("sequence"), "event_id", gone.alias("deleted"), F.when(~gone, "v2").alias("payload")))
    ledger.compact()
    return ledger.rows()


_LEDGER = _q(["rows_ AS (SELECT event_id, event_type, CAST(regexp_extract(event_id, '^(\\d+)-', 1) AS BIGINT) AS n FROM log)"],
    "SELECT 'local' AS scope, event_id, event_type AS payload FROM rows_ WHERE n % 7 = 0 UNION ALL SELECT 'r', event_id, CASE WHEN n % 3 = 0 THEN 'v2' ELSE 'v1' END FROM rows_ WHERE (n % 2 = 0 OR n % 3 = 0) AND NOT (n % 15 = 0)")


OVER_EVENTS: dict[str, Callable[[DataFrame], DataFrame]] = {"transcript_events": transcript_events, "rollout_events": rollout_events, "host_servers": host_servers, "ledger_rows": ledger_rows}
SQL = {"transcript_events": _TRANSCRIPTS, "rollout_events": _ROLLOUTS, "host_servers": _HOST_SERVERS, "ledger_rows": _LEDGER}
