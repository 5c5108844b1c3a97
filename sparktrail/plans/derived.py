"""Queries over tables that are derived from the event log: identity, evidence, folds and normalisers, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrail.functions import normalize, scalars
from sparktrail.operators import billing, devices, folds, resolution, usage
from sparktrail.operators.patterns import patterns_rank
from sparktrail.schema import conform
from sparktrail.session import stored
from sparktrail.streaming.health import collector_health

from .event_log import TODAY
from .oracle import _PREF, _W14, ORACLE, SERVERS, _q, _usage

NOW_MS = 1_706_659_200_000


def _event_filters(e: DataFrame) -> DataFrame:
    """How many events each filter of the session page lets through."""
    shown = F.array_compact(F.array(*(F.when(folds.event_filter(k), F.lit(k)) for k in folds.EVENT_FILTERS)))
    return e.select(F.explode(shown).alias("filter")).groupBy("filter").agg(F.count("*").alias("events"))


_EVENT_FILTERS = _q([], """SELECT 'all' AS filter, count(*) AS events FROM log UNION ALL SELECT 'tools', count(*) FROM log WHERE event_type LIKE 'tool.%' UNION ALL SELECT 'api', count(*) FROM log WHERE event_type LIKE 'api.%'
  UNION ALL SELECT 'subagents', count(*) FROM log WHERE agent_id IS NOT NULL OR agent_type IS NOT NULL OR event_type LIKE 'subagent.%'
  UNION ALL SELECT 'failures', count(*) FROM log WHERE success = false OR event_type IN ('api.error', 'tool.denied')""")


def _applications(e: DataFrame) -> DataFrame:
    s = usage.sessions(e)
    return folds.by_application(s, "claude_code_cli").withColumn("kind", F.lit("cli")).unionByName(folds.by_application(s, "unknown").withColumn("kind", F.lit("unknown")))


_APPLICATIONS = f"WITH s AS ({ORACLE['sessions']}) SELECT *, 'cli' AS kind FROM s WHERE list_contains(string_split(client, ','), 'claude_code_cli') UNION ALL SELECT *, 'unknown' FROM s WHERE coalesce(client, '') = ''"

_LATENCY = _q(["newest AS (SELECT duration_ms FROM log WHERE source = 'hook' AND duration_ms IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 2000)", "placed AS (SELECT duration_ms, row_number() OVER (ORDER BY duration_ms) AS place, count(*) OVER () AS n FROM newest)"],
    "SELECT count(*) AS samples, min(duration_ms) FILTER (WHERE place >= ceil(0.5 * n)) AS p50, min(duration_ms) FILTER (WHERE place >= ceil(0.99 * n)) AS p99 FROM placed HAVING count(*) > 0")

_SERIES = f"""WITH d AS ({ORACLE['models_daily']}), t AS (SELECT model, CAST(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) AS BIGINT) AS tokens, count(CASE WHEN input_tokens IS NULL AND output_tokens IS NULL THEN 1 END) AS unknown_days FROM d GROUP BY model),
r AS (SELECT *, row_number() OVER (ORDER BY tokens DESC, model) AS k FROM t) SELECT model, tokens, unknown_days, CASE WHEN k <= 2 THEN CAST(k AS INTEGER) END AS slot FROM r"""
_FOLDED = f"WITH d AS ({ORACLE['models_daily']}), s AS ({_SERIES}) SELECT dt, CASE WHEN slot IS NULL THEN 'other' ELSE d.model END AS model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM d JOIN s USING (model) GROUP BY 1, 2"

_SERVERS = f"""WITH a AS ({ORACLE['web_mcp']}), b AS ({ORACLE['web_unused_mcp']})
SELECT coalesce(a.mcp_server, b.mcp_server) AS mcp_server, coalesce(b.configured, false) AS configured, CASE WHEN a.mcp_server IS NULL THEN b.calls ELSE a.calls END AS calls, CASE WHEN a.mcp_server IS NULL THEN 0 ELSE a.failures END AS failures,
  CASE WHEN a.mcp_server IS NULL THEN b.distinct_sessions ELSE a.distinct_sessions END AS distinct_sessions, CASE WHEN a.mcp_server IS NULL THEN b.last_called_dt ELSE a.last_called_dt END AS last_called_dt FROM a FULL JOIN b USING (mcp_server)"""

_FOCUS = f"SELECT *, CASE WHEN pattern_id IN ('retry_spiral', 'permission_denied_loop') THEN 1 ELSE 0 END AS focus FROM ({ORACLE['patterns_rank']})"

_CONTEXT_COLUMNS = ("repo", "cwd_hash", "provider", "turn_id", "model", "effort", "agent_version")


def _with_context(e: DataFrame) -> DataFrame:
    e = e.withColumn("cwd_hash", F.lit(None).cast("string"))
    asked = e.filter("event_type = 'api.request' and source = 'otel'")
    return folds.with_session_context(asked, folds.session_contexts(e.filter("source = 'log'"))).select("event_id", *_CONTEXT_COLUMNS, "billing_route")


_LATEST = ", ".join(f"arg_max({c}, (ts, event_id)) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in _CONTEXT_COLUMNS if c != "cwd_hash")
_WITH_CONTEXT = _q([f"known AS (SELECT session_id, {_LATEST} FROM log WHERE source = 'log' AND session_id IS NOT NULL GROUP BY session_id)"],
    "SELECT o.event_id, coalesce(o.repo, k.repo) AS repo, CAST(NULL AS VARCHAR) AS cwd_hash, coalesce(o.provider, k.provider) AS provider, coalesce(o.turn_id, k.turn_id) AS turn_id, coalesce(o.model, "
        "k.model) AS model, coalesce(o.effort, k.effort) AS effort, coalesce(k.agent_version, o.agent_version) AS agent_version, o.billing_route"
    " FROM log o LEFT JOIN known k ON o.session_id = k.session_id WHERE o.event_type = 'api.request' AND o.source = 'otel'")  # fmt: skip


def _files(e: DataFrame) -> DataFrame:
    """Files as a turn and their labels as a request's model would name them; a stand-in for session files."""
    label = F.when(F.col("model") == "claude-opus", "codex_cli").when(F.col("model") == "claude-sonnet", "chatgpt_desktop_cowork")
    return e.filter("event_type = 'api.request' and session_id is not null").select("host_id", "session_id", F.col("turn_id").alias("file"), F.struct("ts", "event_id").alias("line_no"), label.alias("client"))


_REGISTRY = """labelled AS (SELECT host_id, session_id, turn_id AS file, ts, event_id, CASE model WHEN 'claude-opus' THEN 'codex_cli' WHEN 'claude-sonnet' THEN 'chatgpt_desktop_cowork' END AS client FROM log WHERE event_type = 'api.request' AND session_id IS NOT NULL),
firsts AS (SELECT host_id, session_id, file, arg_min(client, (ts, event_id)) AS client FROM labelled WHERE client IS NOT NULL GROUP BY ALL),
registry AS (SELECT host_id, session_id, string_agg(DISTINCT client, ',' ORDER BY client) AS client FROM firsts GROUP BY ALL)"""


def _session_clients(e: DataFrame) -> DataFrame:
    named = e.filter("session_id is not null").groupBy("session_id", "host_id").agg(F.max(F.when(F.col("client") == "claude_desktop_code", "codex_desktop,zed").otherwise(F.col("client"))).alias("client"))
    return folds.with_clients(named, resolution.client_registry(_files(e)), "host-2")


_SESSION_CLIENTS = _q([_REGISTRY, "named AS (SELECT session_id, host_id, max(CASE client WHEN 'claude_desktop_code' THEN 'codex_desktop,zed' ELSE client END) AS client FROM log WHERE session_id IS NOT NULL GROUP BY ALL)"],
    "SELECT n.session_id, n.host_id, CASE WHEN r.client IS NULL THEN n.client WHEN n.client IS NULL THEN r.client WHEN list_contains(string_split(n.client, ','), 'codex_desktop') THEN "
        "array_to_string(list_sort(list_distinct(list_concat(list_filter(string_split(n.client, ','), lambda x: x <> 'codex_desktop'), string_split(r.client, ',')))), ',') ELSE n.client END AS client"
    " FROM named n LEFT JOIN registry r ON r.session_id = n.session_id AND r.host_id = n.host_id AND n.host_id = 'host-2'")  # fmt: skip

_FACTS = _q([_REGISTRY], "SELECT substr(sha256(host_id || '|log|session.client|originator-v1:' || session_id || ':' || client), 1, 32) AS event_id, host_id, session_id, client, CAST(0 AS BIGINT) AS ts, '1970-01-01' AS dt FROM registry WHERE client = 'chatgpt_desktop_cowork'")


def _linked(e: DataFrame) -> DataFrame:
    """The log with links, rejections and observed clients made of its own rows."""
    kind = F.col("event_type")
    base = e.select("event_id", "host_id", "agent", "source", "event_type", "session_id", "turn_id", "ts", F.when(kind == "api.request", "claude_desktop").otherwise(F.col("client")).alias("client"), "output_tokens",
                    F.coalesce("correlation_key", F.when(kind == "api.request", F.col("turn_id"))).alias("correlation_key"), F.lit(None).cast("string").alias("parent_session_id"), F.lit(None).cast("string").alias("correlation_confidence"))
    base = base.withColumn("client", F.when((F.col("agent") == "codex") & (kind == "turn"), None).otherwise(F.col("client")))
    asked = base.filter("event_type = 'api.request' and session_id is not null")
    links = asked.filter("output_tokens % 3 = 0").withColumns({"event_type": F.lit("message.usage.link"), "correlation_confidence": F.lit("content_match"), "parent_session_id": F.col("session_id"), "session_id": F.concat(F.lit("chat-"), "session_id"), "turn_id": F.concat(F.lit("m"), (F.col("output_tokens") % 4).cast("string"))})
    rejected = asked.filter("output_tokens % 10 = 0").withColumn("event_type", F.lit("message.usage.link.rejected"))
    clients = base.filter("event_type = 'turn' and agent = 'codex' and session_id is not null").withColumns({"event_type": F.lit("session.client"), "source": F.lit("log"), "correlation_confidence": F.lit("observed_originator"), "client": F.lit("chatgpt_desktop_cowork")})
    raw = base.unionByName(links).unionByName(rejected).unionByName(clients)
    return resolution.resolve_links(raw).select("event_id", "session_id", "turn_id", "client", "correlation_confidence")


_LINKED = _q([
    "mine AS (SELECT event_id, host_id, agent, event_type, session_id, turn_id, output_tokens, coalesce(correlation_key, CASE WHEN event_type = 'api.request' THEN turn_id END) AS k, CASE WHEN "
        "event_type = 'api.request' THEN 'claude_desktop' WHEN agent = 'codex' AND event_type = 'turn' THEN NULL ELSE client END AS client FROM log)",
    "no AS (SELECT DISTINCT host_id, session_id, k FROM mine WHERE event_type = 'api.request' AND session_id IS NOT NULL AND output_tokens % 10 = 0)",
    "yes AS (SELECT host_id, session_id, k, min(output_tokens % 4) AS m FROM mine b WHERE event_type = 'api.request' AND session_id IS NOT NULL AND output_tokens % 3 = 0 AND NOT EXISTS (SELECT 1 FROM "
        "no WHERE no.host_id = b.host_id AND no.session_id = b.session_id AND no.k = b.k) GROUP BY ALL HAVING count(DISTINCT output_tokens % 4) = 1)",
    "work AS (SELECT DISTINCT host_id, session_id FROM mine WHERE event_type = 'turn' AND agent = 'codex' AND session_id IS NOT NULL)"],
    "SELECT b.event_id, CASE WHEN y.m IS NULL THEN b.session_id ELSE 'chat-' || b.session_id END AS session_id, CASE WHEN y.m IS NULL THEN b.turn_id ELSE 'm' || y.m END AS turn_id, CASE WHEN b.agent "
        "= 'codex' AND b.client IS NULL AND w.host_id IS NOT NULL THEN 'chatgpt_desktop_cowork' ELSE b.client END AS client, CASE WHEN y.m IS NOT NULL THEN 'content_match' END AS correlation_confidence"
    " FROM mine b LEFT JOIN yes y ON b.event_type = 'api.request' AND y.host_id = b.host_id AND y.session_id = b.session_id AND y.k = b.k LEFT JOIN work w ON w.host_id = b.host_id AND w.session_id = b.session_id")  # fmt: skip


def _scoped(e: DataFrame) -> DataFrame:
    """Rows of two scopes, deletions and aliases made of the log's times."""
    rows = e.select("event_id", "ts", "event_type")
    ledger = rows.filter("ts % 3 <> 1").withColumn("scope", F.lit("local")).unionByName(rows.filter("ts % 3 <> 0").withColumn("scope", F.lit("r1"))).unionByName(rows.filter("ts % 5 = 0").withColumn("scope", F.lit("r2")))
    stones = rows.filter("ts % 11 = 0").select(F.lit("r1").alias("scope"), "event_id")
    calls = rows.filter("event_type = 'tool.call' and ts % 2 = 0")
    aliases = calls.select(F.lit("r1").alias("scope"), F.col("event_id").alias("local_id"), F.regexp_replace("event_id", "call$", "resh").alias("remote_id"))
    return resolution.resolve_scopes(ledger, "r1", stones, aliases)


_SCOPED = _q(["here AS (SELECT event_id, ts, event_type FROM log)", "dead AS (SELECT event_id FROM here WHERE ts % 11 = 0)", "there AS (SELECT event_id FROM here WHERE ts % 3 <> 0 UNION SELECT event_id FROM dead)",
              "gone AS (SELECT event_id FROM here WHERE event_type = 'tool.call' AND ts % 2 = 0 AND regexp_replace(event_id, 'call$', 'resh') IN (SELECT event_id FROM there))",
              "alive AS (SELECT * FROM here WHERE event_id NOT IN (SELECT event_id FROM dead))"],
    "SELECT event_id, ts, event_type, 'local' AS scope FROM alive WHERE ts % 3 <> 1 AND event_id NOT IN (SELECT event_id FROM gone) UNION ALL SELECT event_id, ts, event_type, 'r1' FROM alive WHERE ts % 3 <> 0 AND (ts % 3 = 1 OR event_id IN (SELECT event_id FROM gone))")


def _fingerprints(e: DataFrame) -> DataFrame:
    part = lambda kind, id_: e.filter(f"event_type = '{kind}' and source = 'hook' and repo is not null").select(F.col("event_id").alias(id_), F.concat_ws("/", "tool_name", "repo", "host_id", "user_id").alias("fingerprint"), "ts")
    return resolution.match_fingerprints(part("tool.call", "response_id"), part("tool.result", "message_id"), 4_000)


_FINGERPRINTS = _q([f"{n} AS (SELECT event_id, concat_ws('/', tool_name, repo, host_id, user_id) AS f, ts FROM log WHERE event_type = '{k}' AND source = 'hook' AND repo IS NOT NULL)" for n, k in (("r", "tool.call"), ("m", "tool.result"))]
    + ["p AS (SELECT r.event_id AS response_id, m.event_id AS message_id FROM r JOIN m ON r.f = m.f AND abs(r.ts - m.ts) <= 4000)"],
    "SELECT *, CASE WHEN count(*) OVER (PARTITION BY response_id) = 1 AND count(*) OVER (PARTITION BY message_id) = 1 THEN 'linked' ELSE 'rejected' END AS verdict FROM p")

# --- billing evidence, made of the requests' own counters -----------------------------------------------------------
_PAID = """u AS (SELECT * REPLACE (CASE WHEN output_tokens % 4 = 0 THEN billing_route END AS billing_route, CASE WHEN output_tokens % 9 = 0 THEN 'codex-auto-review' ELSE model END AS model) FROM log WHERE event_type = 'api.request'),
origins AS (SELECT event_id AS remote_id, event_id || '-local' AS local_id, 'host-9' AS host_id, CASE output_tokens % 3 WHEN 0 THEN 'router' WHEN 1 THEN 'openai' END AS provider, CASE WHEN output_tokens % 8 = 1 THEN 'subscription' END AS route FROM log WHERE event_type = 'api.request' AND output_tokens % 17 = 1),
diagnosed AS (SELECT event_id, CASE output_tokens % 5 WHEN 0 THEN 'router' WHEN 1 THEN 'api_key' ELSE 'subscription' END AS route FROM log WHERE event_type = 'api.request' AND output_tokens % 13 = 2),
reviews AS (SELECT host_id, turn_id, session_id AS thread_id FROM log WHERE event_type = 'api.request' AND output_tokens % 9 = 0 AND agent = 'codex' AND session_id IS NOT NULL),
turn_auth AS (SELECT host_id AS host, session_id, turn_id, ts - 500 AS ts, CASE output_tokens % 3 WHEN 0 THEN 'subscription' WHEN 1 THEN 'api_key' ELSE 'unknown' END AS route FROM log WHERE event_type = 'api.request' AND agent = 'codex' AND output_tokens % 2 = 0),
request_auth AS (SELECT host_id AS host, session_id, turn_id, ts + (output_tokens % 4) * 25000 AS ts, output_tokens % 5 <> 0 AS subscribed FROM log WHERE event_type = 'api.request' AND agent = 'codex' AND output_tokens % 3 <> 1),
key_requests AS (SELECT host_id AS host, session_id, turn_id, ts + (output_tokens % 5) * 20000 AS ts FROM log WHERE event_type = 'api.request' AND agent = 'codex' AND output_tokens % 7 = 0),
answers AS (SELECT host_id AS host, session_id, model, input_tokens AS i, output_tokens AS o, cache_read_tokens AS r, cache_write_tokens AS w, ts + (output_tokens % 4) * 25000 AS ts, event_id AS request_id, output_tokens % 4 <> 0 AS subscribed FROM u WHERE agent = 'claude-code')"""


def _paid(e: DataFrame) -> DataFrame:
    """The log, of whose requests only a quarter say how they were paid, and a ninth are automatic reviews."""
    asked = "event_type = 'api.request'"
    return e.withColumns({"billing_route": F.expr(f"CASE WHEN {asked} AND output_tokens % 4 = 0 THEN billing_route END"), "model": F.expr(f"CASE WHEN {asked} AND output_tokens % 9 = 0 THEN 'codex-auto-review' ELSE model END")})


def _evidence(e: DataFrame) -> billing.Evidence:
    asked, key = e.filter("event_type = 'api.request'"), ["host_id", "session_id AS auth_session_id", "turn_id"]
    codex, own = asked.filter("agent = 'codex'"), _paid(asked).filter("agent = 'claude-code'")
    return billing.Evidence(
        origins=asked.filter("output_tokens % 17 = 1").selectExpr("event_id AS remote_id", "event_id || '-local' AS local_id", "'host-9' AS host_id", "CASE output_tokens % 3 WHEN 0 THEN 'router' WHEN "
            "1 THEN 'openai' END AS provider", "CASE WHEN output_tokens % 8 = 1 THEN 'subscription' END AS route"),
        event_routes=asked.filter("output_tokens % 13 = 2").selectExpr("event_id", "CASE output_tokens % 5 WHEN 0 THEN 'router' WHEN 1 THEN 'api_key' ELSE 'subscription' END AS route"),
        review_turns=codex.filter("output_tokens % 9 = 0 and session_id is not null").selectExpr("host_id", "turn_id", "session_id AS thread_id"),
        turn_auth=codex.filter("output_tokens % 2 = 0").selectExpr(*key, "ts - 500 AS ts", "CASE output_tokens % 3 WHEN 0 THEN 'subscription' WHEN 1 THEN 'api_key' ELSE 'unknown' END AS route"),
        request_auth=codex.filter("output_tokens % 3 <> 1").selectExpr(*key, "ts + (output_tokens % 4) * 25000 AS ts", "output_tokens % 5 <> 0 AS subscribed"),
        key_requests=codex.filter("output_tokens % 7 = 0").selectExpr(*key, "ts + (output_tokens % 5) * 20000 AS ts"),
        responses=own.selectExpr("host_id", "session_id AS auth_session_id", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "ts + (output_tokens % 4) * 25000 AS ts", "event_id AS request_id", "output_tokens % 4 <> 0 AS subscribed"),
    )


def _requests(e: DataFrame) -> tuple[DataFrame, billing.Evidence]:
    """The log's requests and their evidence, which seven tables are made of: they are stored once."""
    asked = stored(e.filter("event_type = 'api.request'"))
    return _paid(asked), _evidence(asked)


# what is known of each turn, from all three kinds of records at once; then one look at a request's own turn
_TURNS = """turns AS (
  SELECT host, session_id, turn_id, list(DISTINCT route) FILTER (kind = 'login') AS routes, min(ts) FILTER (route = 'subscription') AS login_at, min(ts) FILTER (route = 'api_key') AS key_at,
         coalesce(list(ts) FILTER (kind = 'request'), []) AS asked_at, coalesce(list(ts) FILTER (kind = 'keyed'), []) AS keyed_at, list(DISTINCT subscribed) FILTER (kind = 'request') AS answers
  FROM (SELECT host, session_id, turn_id, 'login' AS kind, ts, route, NULL AS subscribed FROM turn_auth
        UNION ALL SELECT host, session_id, turn_id, 'request', ts, NULL, subscribed FROM request_auth
        UNION ALL SELECT host, session_id, turn_id, 'keyed', ts, NULL, NULL FROM key_requests)
  GROUP BY ALL)"""
_ROUTED = """routed AS (
  SELECT u.* REPLACE (coalesce(a.host_id, u.host_id) AS host_id), coalesce(a.local_id, u.event_id) AS known_as, a.provider AS seen_provider, a.route AS seen_route FROM u LEFT JOIN origins a ON a.remote_id = u.event_id)"""
_TOLD = """told AS (
  SELECT r.*, list_filter([r.seen_route, r.billing_route, d.route, CASE WHEN r.seen_provider = 'router' THEN 'router' END], lambda x: x IS NOT NULL) AS said, d.route AS diagnosed, coalesce(v.thread, r.session_id) AS auth
  FROM routed r LEFT JOIN diagnosed d ON d.event_id = r.known_as AND r.agent = 'codex'
  LEFT JOIN (SELECT host_id, turn_id, any_value(thread_id) AS thread FROM reviews GROUP BY ALL HAVING count(*) = 1) v ON v.host_id = r.host_id AND v.turn_id = r.turn_id AND r.agent = 'codex' AND r.model = 'codex-auto-review')"""
_ANSWERED = """answered AS (
  SELECT t.event_id, bool_and(x.subscribed) AS subscribed FROM told t JOIN answers x ON x.host = t.host_id AND x.session_id = t.auth AND x.model = t.model AND x.i = t.input_tokens AND x.o = t.output_tokens AND x.r = t.cache_read_tokens AND x.w = t.cache_write_tokens AND x.ts BETWEEN t.ts - 60000 AND t.ts + 60000
  WHERE t.agent = 'claude-code' AND t.source IN ('otel', 'log') AND coalesce(t.provider, 'anthropic') = 'anthropic' GROUP BY t.event_id HAVING count(DISTINCT x.request_id) = 1)"""
_WEIGHED = """weighed AS (
  SELECT t.event_id, t.provider, t.seen_provider, t.said, coalesce(t.billing_route, t.seen_route, t.diagnosed) AS first_said, coalesce(w.subscribed, false) AS answered, t.agent = 'codex' AND t.provider = 'openai' AS by_turn, t.source IN ('otel', 'log') AS logged,
         coalesce(e.routes, []) AS routes, coalesce(e.answers, []) AS answers, coalesce(e.login_at <= t.ts + 1000, false) AS login, coalesce(e.key_at <= t.ts + 1000, false) AS key,
         len(list_filter(e.asked_at, lambda x: abs(x - t.ts) <= 60000)) > 0 AS asked, len(list_filter(e.keyed_at, lambda x: abs(x - t.ts) <= 60000)) > 0 AS keyed
  FROM told t LEFT JOIN turns e ON e.host = t.host_id AND e.session_id = t.auth AND e.turn_id = t.turn_id LEFT JOIN answered w ON w.event_id = t.event_id)"""
_CLASSES = """classes AS (SELECT event_id, CASE
  WHEN provider = 'router' OR list_contains(said, 'router') THEN 'router' WHEN list_contains(said, 'api_key') THEN 'api_key' WHEN seen_provider <> provider THEN 'unknown' WHEN first_said IS NOT NULL THEN first_said
  WHEN answered OR (by_turn AND logged AND list_has_all(['subscription'], routes) AND NOT list_contains(answers, false) AND (login OR coalesce(asked, false))) THEN 'subscription'
  WHEN by_turn AND list_has_all(['api_key'], routes) AND NOT list_contains(answers, true) AND (key OR coalesce(keyed, false)) THEN 'api_key' ELSE 'unknown' END AS route FROM weighed)"""
_BILLED = [_PAID, _TURNS, _ROUTED, _TOLD, _ANSWERED, _WEIGHED, _CLASSES]
_CLASSIFIED = _q(_BILLED, "SELECT event_id, route FROM classes")
_BEST = _PREF.replace("FROM log", "FROM u")
_ROUTE_COUNTS = _q([*_BILLED, _BEST], "SELECT count(*) FILTER (WHERE route = 'subscription') AS subscription, count(*) FILTER (WHERE route = 'api_key') AS api_key, count(*) FILTER (WHERE route = "
    "'router') AS router, count(*) FILTER (WHERE route NOT IN ('subscription', 'api_key', 'router')) AS unknown FROM pref JOIN classes USING (event_id)", _W14)
_SUBSCRIBED = _q([*_BILLED, _BEST, "sub AS (SELECT pref.* FROM pref JOIN classes USING (event_id) WHERE route = 'subscription')", *_usage("sub")], "SELECT * FROM usage_all", _W14)


def _limits(e: DataFrame) -> DataFrame:
    """Reports of two windows as each exported request would leave them, written as JSON and read again; some percents are out of range."""
    rows = e.filter("event_type = 'api.request' and source = 'otel'")
    window = lambda name, used, minutes: F.struct(F.lit(name).alias("name"), F.expr(used).cast("double").alias("used_percent"), F.lit(minutes).alias("window_minutes"), (F.col("ts") + minutes * 60_000).alias("resets_at"))
    body = F.to_json(F.struct("agent", F.col("user_id").alias("account"), F.expr("ts * 1000 + output_tokens % 1000").alias("observed_at"), F.array(window("five hours", "output_tokens % 120", 300), window("week", "cache_read_tokens % 150", 10_080)).alias("windows")))
    return usage.subscription_usage(normalize.usage_limits(rows.select(body.alias("body"))))


_LIMITS = _q(["r AS (SELECT agent, user_id AS account, ts * 1000 + output_tokens % 1000 AS observed_at, ts, output_tokens % 120 AS short, cache_read_tokens % 150 AS long FROM log WHERE event_type = "
    "'api.request' AND source = 'otel' QUALIFY row_number() OVER (PARTITION BY agent, user_id ORDER BY ts * 1000 + output_tokens % 1000 DESC) = 1)",
              "w AS (SELECT agent, account, observed_at, 'five hours' AS name, CAST(short AS DOUBLE) AS used_percent, CAST(300 AS BIGINT) AS window_minutes, ts + 18000000 AS resets_at FROM r WHERE "
                  "short <= 100 UNION ALL SELECT agent, account, observed_at, 'week', CAST(long AS DOUBLE), CAST(10080 AS BIGINT), ts + 604800000 FROM r WHERE long <= 100)"],
    "SELECT * FROM w UNION ALL SELECT agent, account, observed_at, NULL, NULL, NULL, NULL FROM r WHERE short > 100 AND long > 100")


# --- normalisers and scalars -----------------------------------------------------------------------------------------
def _hooked(e: DataFrame) -> DataFrame:
    """Calls, results and denials of hooks, written as the JSON of hook calls and read again."""
    rows = e.filter("source = 'hook' and event_type in ('tool.call', 'tool.result', 'tool.denied') and agent = 'claude-code'")
    name = F.when(F.col("event_type") == "tool.call", "PreToolUse").when(F.col("event_type") == "tool.denied", "PermissionDenied").otherwise("PostToolUse")
    body = F.to_json(F.struct(name.alias("hook_event_name"), "session_id", F.col("ts").cast("string").alias("timestamp"), "tool_name", F.col("event_id").alias("tool_use_id"), "agent_id", "duration_ms", F.struct("success").alias("tool_response"), F.struct(F.col("skill_name").alias("skill")).alias("tool_input")))
    out = normalize.hooks(rows.select(F.concat("ts", F.lit("-x.json")).alias("name"), body.alias("body")), "h")
    return out.select("event_id", "ts", "dt", "session_id", "event_type", "tool_name", "tool_kind", "mcp_server", "mcp_tool", "skill_name", "success", "duration_ms", "correlation_key", "query_source", "decision", "agent_id")


_KIND = "CASE WHEN tool_name LIKE 'mcp\\_\\_%\\_\\_%' ESCAPE '\\' THEN CASE WHEN split_part(tool_name, '__', 2) IN ('playwright') THEN 'browser' ELSE 'mcp' END WHEN tool_name = 'Bash' THEN 'bash' WHEN tool_name = 'Skill' THEN 'skill' WHEN tool_name = 'WebFetch' THEN 'browser' ELSE 'builtin' END"
_MCP = "CASE WHEN starts_with(tool_name, 'mcp__') THEN split_part(tool_name, '__', {}) END"
_HOOKED = _q([], f"""SELECT substr(sha256('h|hook|' || event_type || '|' || event_id), 1, 32) AS event_id, ts, dt, session_id, event_type, tool_name, {_KIND} AS tool_kind, {_MCP.format(2)} AS mcp_server, {_MCP.format(3)} AS mcp_tool, CASE WHEN tool_name = 'Skill' THEN skill_name END AS skill_name,
  CASE WHEN event_type = 'tool.result' THEN success END AS success, CASE WHEN event_type = 'tool.result' THEN duration_ms END AS duration_ms, event_id AS correlation_key, CASE WHEN agent_id IS NULL THEN 'main' ELSE 'subagent' END AS query_source, CASE WHEN event_type = 'tool.denied' THEN 'deny' END AS decision, agent_id
  FROM log WHERE source = 'hook' AND event_type IN ('tool.call', 'tool.result', 'tool.denied') AND agent = 'claude-code'""")


def _reported(e: DataFrame) -> DataFrame:
    """Requests written as a plugin's reports and read again; those without all counters are dropped."""
    rows = e.filter("event_type = 'api.request'")
    body = F.to_json(F.struct("session_id", F.col("event_id").alias("response_id"), "model", F.col("ts").alias("timestamp_ms"), "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"))
    return normalize.plugin_responses(rows.select(body.alias("body")), "h").select("event_id", "ts", "dt", "session_id", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "correlation_key", "client")


_REPORTED = _q([], """SELECT substr(sha256('h|log|api.request|' || event_id), 1, 32) AS event_id, ts, dt, session_id, model, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, event_id AS correlation_key, 'claude_desktop' AS client
  FROM log WHERE event_type = 'api.request' AND session_id IS NOT NULL AND input_tokens >= 0 AND output_tokens >= 0 AND cache_read_tokens >= 0 AND cache_write_tokens >= 0""")


def _exported(e: DataFrame) -> DataFrame:
    """Requests and errors written as an exported JSON log and read again."""
    text = lambda k, c: F.struct(F.lit(k).alias("key"), F.struct(F.col(c).cast("string").alias("stringValue")).alias("value"))
    number = lambda k, c: F.struct(F.lit(k).alias("key"), F.struct(F.col(c).cast("string").alias("stringValue")).alias("value"))
    rows = e.filter("source = 'otel' and event_type in ('api.request', 'api.error') and agent = 'claude-code'")
    some = F.filter(F.array(text("session.id", "session_id"), text("model", "model"), text("effort", "effort"), number("input_tokens", "input_tokens"), number("output_tokens", "output_tokens"), number("duration_ms", "duration_ms")), lambda a: a["value"]["stringValue"].isNotNull())
    record = F.struct(F.concat("ts", F.lit("000000")).alias("timeUnixNano"), F.when(F.col("event_type") == "api.error", "claude_code.api_error").otherwise("claude_code.api_request").alias("eventName"), some.alias("attributes"), F.col("event_id").alias("traceId"))
    shared = F.struct(F.array(text("user.email", "user_id")).alias("attributes"))
    body = F.to_json(F.struct(F.array(F.struct(shared.alias("resource"), F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs")))
    return normalize.otlp_logs(rows.select(body.alias("body")), "h", NOW_MS).select("event_id", "ts", "dt", "event_type", "session_id", "user_id", "model", "effort", "input_tokens", "output_tokens", "duration_ms", "source", "agent")


_EXPORTED = _q([], """SELECT substr(sha256('h|otel|' || event_type || '|record:' || coalesce(session_id, '') || ':' || ts || '000000:' || event_id || '::'), 1, 32) AS event_id, ts, dt, event_type, session_id, user_id, model, effort, input_tokens, output_tokens, duration_ms, source, agent
  FROM log WHERE source = 'otel' AND event_type IN ('api.request', 'api.error') AND agent = 'claude-code'""")


def _names(e: DataFrame) -> DataFrame:
    t = F.col("tool_name")
    remote = F.concat(F.lit("https://me:secret@Example.org/"), "repo", F.lit("?token=1"))
    return e.filter("tool_name is not null").select("event_id", scalars.tool_kind(t).alias("tool_kind"), scalars.mcp_server(t).alias("mcp_server"), scalars.mcp_tool(t).alias("mcp_tool"), scalars.repository(remote).alias("remote"), scalars.glob_matches(F.col("repo"), ["org/repo-[", "org/repo-?", "*-9"]).alias("allowed"), scalars.folder_hash(F.col("repo")).alias("folder"))


_NAMES = _q([], f"SELECT event_id, {_KIND} AS tool_kind, {_MCP.format(2)} AS mcp_server, {_MCP.format(3)} AS mcp_tool, 'https://example.org/' || repo AS remote, coalesce(regexp_full_match(repo, "
    f"'org/repo-.|.*-9'), false) AS allowed, substr(sha256(repo), 1, 16) AS folder FROM log WHERE tool_name IS NOT NULL")


def _health(e: DataFrame) -> DataFrame:
    """Hosts as collectors; the last event of each is its last report."""
    expected = e.select(F.col("host_id").alias("collector")).distinct().unionByName(e.sparkSession.createDataFrame([("host-none",)], "collector string"))
    beats = e.filter("host_id <> 'host-3'").groupBy(F.col("host_id").alias("collector")).agg(F.max("ts").alias("ts"), F.count("*").alias("rows")).withColumn("error", F.when(F.col("collector") == "host-1", "broke"))
    return collector_health(expected, beats, NOW_MS, 600_000)


_HEALTH = _q([], f"""SELECT collector, CASE WHEN ts IS NULL THEN 'never_seen' WHEN collector = 'host-1' THEN 'failed' WHEN {NOW_MS} - ts > 600000 THEN 'silent' ELSE 'healthy' END AS status, ts AS last_ts,
  CASE WHEN ts IS NULL THEN NULL WHEN collector = 'host-1' THEN 'broke' WHEN {NOW_MS} - ts > 600000 THEN 'no report for ' || ({NOW_MS} - ts) // 1000 || ' s' END AS issue
  FROM (SELECT host_id AS collector, CASE WHEN host_id <> 'host-3' THEN max(ts) END AS ts FROM log GROUP BY host_id UNION ALL SELECT 'host-none', NULL)""")


def _marks(e: DataFrame) -> DataFrame:
    """A change noted on the day of the first call of each server and host, and again on that of the last; one server's list."""
    calls = e.filter("event_type = 'tool.call' and mcp_server is not null").groupBy("mcp_server", "host_id").agg(F.min("dt").alias("first"), F.max("dt").alias("last"))
    noted = calls.select(F.lit("mcp_bypass").alias("pattern_id"), F.col("mcp_server").alias("subject"), F.explode(F.array("first", "last", "last")).alias("dt"), F.concat(F.lit("calls of "), "mcp_server").alias("note"), "host_id")
    none = e.sparkSession.createDataFrame([], "pattern_id string, subject string, dt string, note string, host_id string, id string")
    marks = resolution.Marks.added(none, noted, "9999-01-01")
    return resolution.Marks.listed(marks, "mcp_bypass", "github", resolution.display_filter(device="all")).select("id", "pattern_id", "subject", "dt", "note", "host_id")


_MARKS = _q(["days AS (SELECT host_id, unnest(list_distinct([min(dt), max(dt)])) AS dt FROM log WHERE event_type = 'tool.call' AND mcp_server = 'github' GROUP BY host_id)"],
    "SELECT substr(sha256('mcp_bypass|github|' || dt || '|calls of github|' || host_id), 1, 32) AS id, 'mcp_bypass' AS pattern_id, 'github' AS subject, dt, 'calls of github' AS note, host_id FROM days")


def _latest(e: DataFrame) -> DataFrame:
    """Rows that were written twice, the second time a moment later, once each."""
    from sparktrail.operators.dedup import latest_by_id

    rows = e.select("event_id", "ts", "event_type")
    return latest_by_id(rows.unionByName(rows.filter("ts % 2 = 0").withColumn("ts", F.col("ts") + 7)))


def _devices(e: DataFrame) -> DataFrame:
    """A history that one device observed live and another imports from files, made of the log.

    The old device lacks a third of the files' rows, doesn't know the model of another third of the second agent's, and has
    exported turns a moment later; the new one has copies of half the hooks' calls as its files would have them.
    """
    e = stored(conform(e).withColumn("host_id", F.lit("old")))
    log, claude = F.col("source") == "log", F.col("agent") == "claude-code"
    third, turned = F.col("ts") % 3 == 0, F.col("event_type").isin("turn", "api.request")
    renamed = lambda df, prefix, **new: df.withColumns({"event_id": F.concat(F.lit(prefix), "event_id"), **new})
    vague = (F.col("agent") == "codex") & log & turned & (F.col("ts") % 3 == 1)
    forgotten = {c: F.when(~vague, F.col(c)) for c in ("model", "effort")}
    exported = renamed(e.filter(log & claude & third & (F.col("event_type") == "turn")), "o-", source=F.lit("otel"), ts=F.col("ts") + F.col("ts") % 90)
    previous = renamed(e.filter((~log & claude) | (log & ~third)), "p-", **forgotten).unionByName(exported)
    bound = log & claude & F.col("event_type").isin("session.start", "session.end") & third
    ends = e.filter(bound & F.col("session_id").isNotNull()).groupBy("session_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last"))
    one = ends.select(F.when(F.col("event_type") == "session.start", F.col("first")).otherwise(F.col("last")).alias("event_id"))
    files = e.filter(log & ~bound).unionByName(e.filter(bound).join(one.hint("merge"), "event_id", "left_semi"))
    calls = e.filter(claude & (F.col("source") == "hook") & F.col("event_type").isin("tool.call", "tool.result") & (F.col("ts") % 2 == 0))
    current = renamed(files, "c-").unionByName(renamed(calls, "k-", source=F.lit("log"), ts=F.col("ts") + 3)).withColumn("host_id", F.lit("new"))
    return devices.reconcile(current, previous, match_prompt_times=True)


_DEVICES = _q([
    "files AS (SELECT *, agent = 'claude-code' AS claude, ts % 3 = 0 AS missing, agent = 'codex' AND event_type IN ('turn', 'api.request') AND ts % 3 = 1 AND (model IS NOT NULL OR effort IS NOT NULL) AS vague FROM log WHERE source = 'log' AND session_id IS NOT NULL)",
    "live AS (SELECT * FROM log WHERE source = 'hook' AND agent = 'claude-code' AND session_id IS NOT NULL)",
    "bounds AS (SELECT session_id, event_type, CASE event_type WHEN 'session.start' THEN arg_min(event_id, (ts, event_id)) ELSE arg_max(event_id, (ts, event_id)) END AS event_id, CASE event_type WHEN "
        "'session.start' THEN min(ts) ELSE max(ts) END AS ts FROM files WHERE claude AND missing AND event_type IN ('session.start', 'session.end') GROUP BY session_id, event_type)",
    "resumed AS (SELECT session_id, event_type, CASE event_type WHEN 'session.start' THEN arg_min(event_id, (ts, event_id)) ELSE arg_max(event_id, (ts, event_id)) END AS event_id, max(ts) AS ts FROM live WHERE event_type IN ('session.start', 'session.end') GROUP BY session_id, event_type)"],
    """SELECT 'c-' || event_id AS left_id, 'p-' || event_id AS right_id, CASE WHEN vague THEN 'same record, other context' ELSE 'same observation' END AS rule FROM files WHERE NOT missing
  UNION ALL SELECT 'k-' || event_id, 'p-' || event_id, 'same operation id, hook' FROM live WHERE event_type IN ('tool.call', 'tool.result') AND ts % 2 = 0 AND correlation_key IS NOT NULL
  UNION ALL SELECT 'c-' || f.event_id, 'p-' || o.event_id, 'unique model and usage' FROM files f JOIN log o ON o.source = 'otel' AND o.event_type = 'api.request' AND o.agent = 'claude-code' AND o.session_id = f.session_id AND o.model = f.model AND o.input_tokens = f.input_tokens AND o.output_tokens = f.output_tokens
      AND coalesce(o.cache_read_tokens, -1) = coalesce(f.cache_read_tokens, -1) AND coalesce(o.cache_write_tokens, -1) = coalesce(f.cache_write_tokens, -1) WHERE f.claude AND f.missing AND f.event_type = 'api.request'
  UNION ALL SELECT 'c-' || b.event_id, 'p-' || r.event_id, 'transcript boundary within a live session' FROM bounds b JOIN resumed r USING (session_id, event_type) WHERE b.event_type = 'session.start' OR r.ts >= b.ts
  UNION ALL SELECT 'c-' || event_id, 'o-' || event_id, 'the only turn near in time' FROM files WHERE claude AND missing AND event_type = 'turn'""")  # fmt: skip


OVER_EVENTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "event_filters": _event_filters,
    "application_sessions": _applications,
    "hook_latency": lambda e: folds.nearest_rank(e.filter("source = 'hook'"), "duration_ms"),
    "model_series": lambda e: folds.model_series(usage.models_daily(e), 2),
    "folded_models": lambda e: folds.folded_series(usage.models_daily(e), folds.model_series(usage.models_daily(e), 2)),
    "mcp_page": lambda e: folds.merged_servers(usage.web_mcp(e), usage.web_unused_mcp(e, SERVERS)),
    "focused_patterns": lambda e: folds.focused(patterns_rank(e)),
    "session_context": _with_context,
    "client_registry": lambda e: resolution.client_registry(_files(e)),
    "session_clients": _session_clients,
    "classification_facts": lambda e: folds.classification_facts(resolution.client_registry(_files(e))).select("event_id", "host_id", "session_id", "client", "ts", "dt"),
    "resolved_links": _linked,
    "resolved_scopes": _scoped,
    "fingerprint_links": _fingerprints,
    "device_links": _devices,
    "latest_events": _latest,
    "billing_evidence": lambda e: billing.route_requests(*_requests(e)).select("event_id", "route"),
    "billing_routes": lambda e: usage.billing_routes(*_requests(e)),
    "subscription_models": lambda e: usage.subscription_models(*_requests(e)),
    "subscription_usage": _limits,
    "hook_events": _hooked,
    "plugin_events": _reported,
    "exported_events": _exported,
    "tool_names": _names,
    "collector_health": _health,
    "marks": _marks,
}
#: Days that a query covers; all for the others.
DAYS = dict.fromkeys(["application_sessions", "model_series", "folded_models", "mcp_page", "billing_routes", "subscription_models"], 14) | {"focused_patterns": 30}
SQL = {
    "event_filters": _EVENT_FILTERS, "application_sessions": _APPLICATIONS, "hook_latency": _LATENCY, "model_series": _SERIES, "folded_models": _FOLDED, "mcp_page": _SERVERS, "focused_patterns": _FOCUS, "session_context": _WITH_CONTEXT,
    "client_registry": _q([_REGISTRY], "SELECT * FROM registry"), "session_clients": _SESSION_CLIENTS, "classification_facts": _FACTS, "resolved_links": _LINKED, "resolved_scopes": _SCOPED, "fingerprint_links": _FINGERPRINTS, "device_links": _DEVICES,
    "latest_events": _q([], "SELECT event_id, CASE WHEN ts % 2 = 0 THEN ts + 7 ELSE ts END AS ts, "
        "event_type FROM log"), "billing_evidence": _CLASSIFIED, "billing_routes": _ROUTE_COUNTS, "subscription_models": _SUBSCRIBED, "subscription_usage": _LIMITS, "hook_events": _HOOKED, "plugin_events": _REPORTED, "exported_events": _EXPORTED, "tool_names": _NAMES,
    "collector_health": _HEALTH, "marks": _MARKS,
}
