"""The sections of one session's page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrail.functions.columns import counted, iso_second, names, total, total_where

from .dedup import tool_results, without_result_copies

MINUTE_MS = 60_000
#: Bucket widths in minutes.
WIDTHS = (1, 2, 5, 10, 15, 30, 60, 120, 360, 720, 1440)


def one(e: DataFrame, session_id: str) -> DataFrame:
    if not 1 <= len(session_id) <= 128:
        raise ValueError("session_id must have 1 to 128 characters")
    return e.filter(F.col("session_id") == session_id)


def summary(e: DataFrame) -> DataFrame:
    """One row; none for an empty session."""
    is_ = lambda kind: F.col("event_type") == kind
    blank = F.lit("")
    out = e.agg(
        F.max("session_id").alias("session_id"), F.max("agent").alias("agent"), F.max("agent_version").alias("agent_version"), F.max("host_id").alias("host_id"), F.max("repo").alias("repo"), iso_second(F.min("ts")).alias("started_at"), iso_second(F.max("ts")).alias("ended_at"),
        (F.max("ts") - F.min("ts")).alias("duration_ms"), F.bool_or(is_("session.end")).alias("ended"), F.count("*").alias("events"),
        *(counted(is_(k)).alias(n) for n, k in (("turns", "turn"), ("tool_calls", "tool.call"), ("tool_denied", "tool.denied"), ("api_requests", "api.request"), ("api_errors", "api.error"), ("compactions", "compaction"))),
        F.count_distinct("agent_id").alias("subagents"), F.coalesce(names("model"), blank).alias("models"), F.coalesce(names("source"), blank).alias("sources"),
        *(total(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "cost_usd", "estimated_input_tokens", "estimated_output_tokens")),
        F.max("configured_mcp_servers").alias("configured_mcp_servers"), F.max("configured_skills").alias("configured_skills"), F.coalesce(names("effort"), blank).alias("efforts"), names("client").alias("client"),
    ).filter("events > 0")
    failed = without_result_copies(e).agg(counted(~F.col("success")).alias("failures"))
    return out.crossJoin(failed)  # one row each


def tools(e: DataFrame) -> DataFrame:
    call = F.col("event_type") == "tool.call"
    left = e.filter("tool_name is not null").groupBy("tool_name").agg(F.max("tool_kind").alias("tool_kind"), F.max("mcp_server").alias("mcp_server"), counted(call).alias("calls"), counted(call & F.col("agent_id").isNotNull()).alias("subagent_calls"), counted(F.col("event_type") == "tool.denied").alias("denied"))
    right = tool_results(e).groupBy(F.col("tool_name").alias("_t")).agg(counted(~F.col("success")).alias("failures"), F.percentile("duration_ms", F.lit(0.5)).alias("p50_duration_ms"), F.percentile("duration_ms", F.lit(0.95)).alias("p95_duration_ms"), total("duration_ms").alias("total_duration_ms"))
    return left.join(right, F.col("tool_name") == F.col("_t"), "left").drop("_t").withColumn("failures", F.coalesce("failures", F.lit(0).cast("long"))).orderBy(F.desc("calls"), "tool_name")


def subagents(e: DataFrame, slack_ms: int = 5000) -> DataFrame:
    """Per agent; models are its own, else those of otel requests of its type within its time span."""
    stop, request = F.col("event_type") == "subagent.stop", F.col("event_type") == "api.request"
    zero = F.lit(0)
    tokens = F.coalesce("input_tokens", zero) + F.coalesce("output_tokens", zero)
    has = F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()
    span = F.max("ts") - F.min("ts")
    agents = e.filter("agent_id is not null").groupBy("agent_id").agg(
        F.max("agent_type").alias("agent_type"), F.max("turn_id").alias("turn_id"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.coalesce(F.max(F.when(stop, F.col("duration_ms"))), F.when(span > 0, span)).alias("duration_ms"), F.count("*").alias("events"), counted(F.col("event_type") == "tool.call").alias("tool_calls"), counted(~F.col("success")).alias("failures"), counted(request).alias("api_requests"),
        F.coalesce(total_where(request & has, tokens), F.max(F.when(stop & has, tokens))).alias("tokens_est"), names("tool_name").alias("tools"), names("model").alias("own_models"), names("effort").alias("own_efforts"),
    )
    other = e.filter("agent_id is null and event_type = 'api.request'").select(F.col("agent_type").alias("_type"), F.col("ts").alias("_ts"), F.col("model").alias("_model"), F.col("effort").alias("_effort"))
    near = (F.col("agent_type") == F.col("_type")) & (F.col("agent_type") != "") & F.col("_ts").between(F.col("first_ts") - slack_ms, F.col("last_ts") + slack_ms)
    seen = agents.join(other, near).groupBy(F.col("agent_id").alias("_a")).agg(names("_model").alias("w_models"), names("_effort").alias("w_efforts"))
    out = agents.join(seen, F.col("agent_id") == F.col("_a"), "left")
    own, window = F.col("own_models").isNotNull() | F.col("own_efforts").isNotNull(), F.col("w_models").isNotNull() | F.col("w_efforts").isNotNull()
    out = out.withColumns({"models": F.coalesce("own_models", "w_models"), "efforts": F.coalesce("own_efforts", "w_efforts"), "model_source": F.when(own, "agent").when(window, "otel_window"), "started_at": iso_second(F.col("first_ts"))})
    columns = ["agent_id", "agent_type", "turn_id", "started_at", "duration_ms", "events", "tool_calls", "failures", "api_requests", "tokens_est", "tools", "models", "efforts", "model_source"]
    return out.orderBy("first_ts", "agent_id").select(columns)


def bucket_ms(duration_ms: int) -> int:
    """The smallest width that cuts a session into about 240 buckets at most."""
    return next((w * MINUTE_MS for w in WIDTHS if w * MINUTE_MS >= max(duration_ms, 0) // 240), WIDTHS[-1] * MINUTE_MS)


def timeline(e: DataFrame, width: int) -> DataFrame:
    zero = F.lit(0)
    tokens = F.coalesce("input_tokens", zero) + F.coalesce("output_tokens", zero)
    bucket = (F.floor(F.col("ts") / width) * width).alias("bucket_ts")
    return without_result_copies(e).groupBy(bucket).agg(
        F.count("*").alias("events"), counted(F.col("event_type") == "tool.call").alias("tool_calls"), counted(~F.col("success")).alias("failures"), counted(F.col("event_type") == "api.request").alias("api_requests"), total(tokens).alias("tokens"), counted(F.col("agent_id").isNotNull()).alias("subagent_events"),
    ).orderBy("bucket_ts")


EVENT_COLUMNS = ["ts", "event_type", "source", "tool_name", "tool_kind", "mcp_server", "skill_name", "agent_id", "agent_type", "duration_ms", "success", "model", "input_tokens", "output_tokens", "cost_usd", "turn_id", "effort", "correlation_key", "cache_read_tokens", "cache_write_tokens"]


def events(e: DataFrame, limit: int = 500) -> DataFrame:
    if not 1 <= limit <= 2000:
        raise ValueError("limit must be from 1 to 2000")
    return without_result_copies(e).orderBy("ts", "event_id").limit(limit).select(EVENT_COLUMNS)
