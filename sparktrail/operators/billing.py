"""Which way a request was paid for: routes that were observed, then evidence of the login that the session used.

Evidence grows with the requests, so all its joins merge: none sends a side whole through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR_MS, EARLY_MS = 60_000, 1000


@dataclass(frozen=True)
class Evidence:
    """What is known beside the requests; see `observed_routes` and `classified` for the columns."""

    origins: DataFrame
    event_routes: DataFrame
    review_turns: DataFrame
    turn_auth: DataFrame
    request_auth: DataFrame
    responses: DataFrame
    key_requests: DataFrame


def route_requests(requests: DataFrame, known: Evidence) -> DataFrame:
    """requests with `route`, by all evidence."""
    told = observed_routes(requests, known.origins, known.event_routes, known.review_turns)
    return classified(told, known.turn_auth, known.request_auth, known.responses, known.key_requests).drop("explicit_route", "auth_session_id")


def _near(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of equal, known keys whose times are at most NEAR_MS apart; both have `ts`, the right one's becomes `at`.

    Times meet in spans of that length and their neighbours, so a key's rows are never all paired.
    """
    span = F.floor(F.col("ts") / NEAR_MS)
    wide = right.withColumn("_span", F.explode(F.sequence(span - 1, span + 1))).withColumnRenamed("ts", "at")
    return left.withColumn("_span", span).join(wide.hint("merge"), [*key, "_span"]).filter(F.abs(F.col("ts") - F.col("at")) <= NEAR_MS).drop("_span")


def observed_routes(requests: DataFrame, origins: DataFrame, event_routes: DataFrame, review_turns: DataFrame) -> DataFrame:
    """Add `explicit_route` and `auth_session_id` to requests.

    origins: (remote_id, local_id, host_id, provider, route) of requests known from another device. event_routes: (event_id,
    route) seen in diagnostics, any router going before any API key. review_turns: (host_id, turn_id, thread_id); an
    automatic review is judged by the thread that asked for it, if there is only one. Of all routes router goes first, then
    API key; two providers that contradict each other make the route unknown.
    """
    one = origins.groupBy(F.col("remote_id").alias("_remote")).agg(F.min(F.struct("local_id", "host_id", "provider", "route")).alias("o"))  # a request has one origin
    a = one.select("_remote", F.col("o.local_id").alias("_local"), F.col("o.host_id").alias("_host"), F.col("o.provider").alias("_provider"), F.col("o.route").alias("_route"))
    u = requests.join(a.hint("merge"), F.col("event_id") == F.col("_remote"), "left").withColumn("host_id", F.coalesce("_host", "host_id"))
    one = review_turns.groupBy(F.col("host_id").alias("_rh"), F.col("turn_id").alias("_rt")).agg(F.min("thread_id").alias("_thread"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    review = (F.col("agent") == "codex") & (F.col("model") == "codex-auto-review") & (F.col("turn_id") == F.col("_rt")) & (F.col("host_id") == F.col("_rh"))
    u = u.join(one.hint("merge"), review, "left")
    has = lambda r: F.bool_or(F.col("route") == r)
    seen = event_routes.groupBy(F.col("event_id").alias("_seen")).agg(F.when(has("router"), "router").when(has("api_key"), "api_key").otherwise("subscription").alias("_diagnosed"))
    u = u.join(seen.hint("merge"), (F.col("agent") == "codex") & (F.col("_seen") == F.coalesce("_local", "event_id")), "left")
    any_is = lambda r: F.coalesce(F.array_contains(F.array_compact(F.array("_route", "billing_route", "_diagnosed")), r), F.lit(False))
    route = F.when(any_is("router") | (F.col("_provider") == "router"), "router").when(any_is("api_key"), "api_key").when(F.col("_provider") != F.col("provider"), "unknown").otherwise(F.coalesce("billing_route", "_route", "_diagnosed"))
    out = u.withColumns({"explicit_route": route, "auth_session_id": F.coalesce("_thread", "session_id")})
    return out.select(*requests.columns, "explicit_route", "auth_session_id")


def subscribed_by_login(u: DataFrame, turn_auth: DataFrame, request_auth: DataFrame, responses: DataFrame) -> DataFrame:
    """(event_id): requests whose session is known to have been logged in with a subscription. See `classified`."""
    key = ["host_id", "auth_session_id", "turn_id"]
    codex = u.filter("agent = 'codex' and provider = 'openai' and source in ('otel', 'log')").select("event_id", *key, "ts")
    turns = turn_auth.groupBy(*key).agg(F.coalesce(F.bool_or(F.col("route") != "subscription"), F.lit(False)).alias("other"), F.min(F.when(F.col("route") == "subscription", F.col("ts"))).alias("since"))
    asked = request_auth.groupBy(*key).agg(F.bool_and("subscribed").alias("all"))
    told = codex.join(turns.hint("merge"), key, "left").join(asked.hint("merge"), key, "left").filter("not coalesce(other, false) and coalesce(all, true)")
    by_turn = told.filter(F.col("since") <= F.col("ts") + EARLY_MS).select("event_id")
    by_request = _near(told.filter("all").select("event_id", *key, "ts"), request_auth.select(*key, "ts"), key).select("event_id")
    sizes = ["host_id", "auth_session_id", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]
    claude = u.filter("agent = 'claude-code' and source in ('otel', 'log') and (provider is null or provider = 'anthropic')").select("event_id", *sizes, "ts")
    same = _near(claude, responses, sizes).groupBy("event_id").agg(F.count_distinct("request_id").alias("n"), F.bool_and("subscribed").alias("all")).filter("n = 1 and all").select("event_id")
    return by_turn.union(by_request).union(same).distinct()


def paid_by_key(u: DataFrame, turn_auth: DataFrame, request_auth: DataFrame, key_requests: DataFrame) -> DataFrame:
    """(event_id): requests whose session is known to have used an API key. See `classified`."""
    key = ["host_id", "auth_session_id", "turn_id"]
    codex = u.filter("agent = 'codex' and provider = 'openai'").select("event_id", *key, "ts")
    turns = turn_auth.groupBy(*key).agg(F.coalesce(F.bool_or(F.col("route") != "api_key"), F.lit(False)).alias("other"), F.min(F.when(F.col("route") == "api_key", F.col("ts"))).alias("since"))
    never = request_auth.filter("subscribed").select(*key).distinct()
    told = codex.join(turns.hint("merge"), key, "left").filter("not coalesce(other, false)").join(never.hint("merge"), key, "left_anti")
    by_turn = told.filter(F.col("since") <= F.col("ts") + EARLY_MS).select("event_id")
    return by_turn.union(_near(told.select("event_id", *key, "ts"), key_requests.select(*key, "ts"), key).select("event_id")).distinct()


def classified(u: DataFrame, turn_auth: DataFrame, request_auth: DataFrame, responses: DataFrame, key_requests: DataFrame) -> DataFrame:
    """Add `route` to the result of `observed_routes`: router, api_key, subscription or unknown.

    What was observed goes first. Else a login counts as subscription if the turn's records all say so from a second after
    the request at the latest, or all its requests do and one is within a minute; for the first agent, if exactly one response
    of the same model and counters lies within a minute and was subscribed. An API key counts by the same records, unless any
    request of the turn was subscribed. Unknown keys match nothing.

    turn_auth: (host_id, auth_session_id, turn_id, ts, route); request_auth: (..., ts, subscribed); key_requests: (..., ts);
    responses: (host_id, auth_session_id, model, four counters, ts, request_id, subscribed).
    """
    yes = subscribed_by_login(u, turn_auth, request_auth, responses).select(F.col("event_id").alias("_yes"))
    by_key = paid_by_key(u, turn_auth, request_auth, key_requests).select(F.col("event_id").alias("_key"))
    out = u.join(yes.hint("merge"), F.col("event_id") == F.col("_yes"), "left").join(by_key.hint("merge"), F.col("event_id") == F.col("_key"), "left")
    route = F.when(F.col("provider") == "router", "router").when(F.col("explicit_route").isNotNull(), F.col("explicit_route")).when(F.col("_yes").isNotNull(), "subscription").when(F.col("_key").isNotNull(), "api_key").otherwise("unknown")
    return out.withColumn("route", route).drop("_yes", "_key")


_AUTH = (
    "type string, sessionId string, id string, requestId string, requestRef string, timestamp string, entrypoint string, isApiErrorMessage boolean, billingMode string, "
    "params struct<betas: array<string>>, message struct<model: string, usage: struct<input_tokens: long, output_tokens: long, cache_read_input_tokens: long, cache_creation_input_tokens: long>>"
)


def transcript_evidence(lines: DataFrame, oauth_beta: str, direct: tuple[str, ...], allowed: Column | None = None) -> DataFrame:
    """`responses` of `classified`, without host, from session files: rows (file, line_no, line).

    A response was subscribed if it came directly (an entry point of `direct`, an id of the service's own) and every record
    of the request that it refers to, in the same session and file, had the login's beta. allowed: what else a line must fulfil.
    """
    from sparktrail.functions.normalize import millis

    x = lines.select("file", F.from_json("line", _AUTH).alias("j")).select("file", "j.*").filter("sessionId is not null")
    fine = F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False))
    oauth = F.coalesce(F.array_contains("params.betas", oauth_beta), F.lit(False)) & fine
    asked = x.filter("type = 'api-request' and id is not null").groupBy("file", "sessionId", F.col("id").alias("requestRef")).agg(F.bool_and(oauth).alias("oauth"))
    u = F.col("message.usage")
    said = x.filter("type = 'assistant' and not coalesce(isApiErrorMessage, false) and requestId is not null and message.model is not null").withColumn("ts", millis(F.col("timestamp")))
    counters = {"input_tokens": u["input_tokens"], "output_tokens": u["output_tokens"], "cache_read_tokens": u["cache_read_input_tokens"], "cache_write_tokens": u["cache_creation_input_tokens"]}
    said = said.withColumns(counters).dropna(subset=["ts", *counters])
    own = F.coalesce(F.col("requestId").startswith("req_") & F.col("entrypoint").isin(*direct), F.lit(False)) & fine
    out = said.withColumn("own", own).join(asked, ["file", "sessionId", "requestRef"], "left")
    return out.select(F.col("sessionId").alias("auth_session_id"), F.col("message.model").alias("model"), *counters, "ts", F.col("requestId").alias("request_id"), (F.col("own") & F.coalesce("oauth", F.lit(False))).alias("subscribed"))


def diagnostics_evidence(logs: DataFrame, cursor: int = 0) -> DataFrame:
    """(id, auth_session_id, turn_id, ts, kind, subscribed, route) from exported diagnostics (id, ts in seconds, thread_id, body).

    kind: turn or request. Only the attributes of a fixed form are read, never other text. Records up to the cursor are skipped.
    """
    body = F.col("body")
    holds = lambda text: F.coalesce(F.locate(text, body) > 0, F.lit(False))
    # fixed values: the attributes as they are written
    endpoint, header = ': endpoint="/responses"', ' auth_header_attached=true auth_header_name="authorization" auth_mode='
    rows = logs.filter((F.col("id") > cursor) & F.col("thread_id").isNotNull() & (holds(endpoint) | (holds(" auth_mode=") & holds(" tags_json="))))
    turn = F.regexp_extract(body, r'turn\.id="?([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})', 1)
    key = holds(" auth_mode=Some(ApiKey) tags_json=") | holds(f'{endpoint}{header}"ApiKey"')
    route = F.when(holds(" auth_mode=Some(Chatgpt) tags_json="), "subscription").when(key, "api_key").otherwise("unknown")
    out = rows.select("id", F.col("thread_id").alias("auth_session_id"), F.lower(turn).alias("turn_id"), (F.col("ts") * 1000).alias("ts"), F.when(holds(endpoint), "request").otherwise("turn").alias("kind"), holds(f'{endpoint}{header}"Chatgpt"').alias("subscribed"), route.alias("route"))
    return out.filter("turn_id <> ''")
