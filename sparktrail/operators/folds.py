"""What pages and reports make of query results: filters, merges, folds, and what is filled in from elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrail.functions.columns import day_of
from sparktrail.functions.scalars import event_id, refined_clients
from sparktrail.schema import conform

EVENT_FILTERS = ("all", "tools", "api", "subagents", "failures")


def event_filter(kind: str) -> Column:
    """Predicate of the session page's list of events."""
    t = F.col("event_type")
    return {
        "all": F.lit(True),
        "tools": t.startswith("tool."),
        "api": t.startswith("api."),
        "subagents": F.col("agent_id").isNotNull() | F.col("agent_type").isNotNull() | t.startswith("subagent."),
        "failures": ~F.coalesce("success", F.lit(True)) | t.isin("api.error", "tool.denied"),
    }[kind]


def by_application(sessions: DataFrame, application: str) -> DataFrame:
    """Sessions of one application, of all, or of none that is known."""
    if application == "all":
        return sessions
    if application == "unknown":
        return sessions.filter(F.coalesce("client", F.lit("")) == "")
    return sessions.filter(F.array_contains(F.split("client", ","), application))


def nearest_rank(samples: DataFrame, value: str, window: int = 2000) -> DataFrame:
    """(samples, p50, p99) of the newest samples (ts, event_id, value): the value at rank ceil(p n). No row without any."""
    newest = samples.filter(F.col(value).isNotNull()).orderBy(F.desc("ts"), F.desc("event_id")).limit(window)
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)")
    return newest.agg(F.count("*").alias("samples"), rank(0.5).cast("long").alias("p50"), rank(0.99).cast("long").alias("p99")).filter("samples > 0")


def model_series(daily: DataFrame, most: int = 6) -> DataFrame:
    """(model, tokens, slot, unknown_days): models by tokens of all days; slots 1 to `most`, null for those drawn together as others.

    unknown_days counts days with neither input nor output known. The order is over models, a short list.
    """
    zero = F.lit(0)
    tokens = F.sum(F.coalesce("input_tokens", zero) + F.coalesce("output_tokens", zero))
    out = daily.groupBy("model").agg(tokens.alias("tokens"), F.count_if(F.col("input_tokens").isNull() & F.col("output_tokens").isNull()).alias("unknown_days"))
    rank = F.row_number().over(Window.orderBy(F.desc("tokens"), "model"))
    return out.withColumn("slot", F.when(rank <= most, rank))


def folded_series(daily: DataFrame, series: DataFrame) -> DataFrame:
    """Tokens per day and model, those without a slot as `other`; null where nothing is known."""
    slots = series.select(F.col("model").alias("_m"), "slot")
    name = F.when(F.col("slot").isNotNull(), F.col("model")).otherwise("other")
    return daily.join(slots, F.col("model") == F.col("_m")).groupBy("dt", name.alias("model")).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def merged_servers(called: DataFrame, unused: DataFrame) -> DataFrame:
    """One row per server of either table: calls and failures of the first where it has it, the configured flag of the second."""
    b = unused.select(F.col("mcp_server").alias("_server"), F.col("configured").alias("_configured"), F.col("calls").alias("_calls"), F.col("distinct_sessions").alias("_sessions"), F.col("last_called_dt").alias("_last"))
    out = called.join(b, F.col("mcp_server") == F.col("_server"), "full_outer")
    mine = F.col("mcp_server").isNotNull()
    pick = lambda c, d: F.when(mine, F.col(c)).otherwise(F.col(d)).alias(c)
    return out.select(
        F.coalesce("mcp_server", "_server").alias("mcp_server"), F.coalesce("_configured", F.lit(False)).alias("configured"), pick("calls", "_calls"), F.when(mine, F.col("failures")).otherwise(F.lit(0).cast("long")).alias("failures"),
        pick("distinct_sessions", "_sessions"), pick("last_called_dt", "_last"),
    )


def sorted_table(df: DataFrame, column: str, descending: bool, *ties: str) -> DataFrame:
    """By a column, unknown values last either way; ties keep the order of the columns named."""
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *ties)


def focused(rank: DataFrame) -> DataFrame:
    """The pattern list with repeated failures and denials on top, then by sessions."""
    first = F.col("pattern_id").isin("retry_spiral", "permission_denied_loop")
    return rank.withColumn("focus", first.cast("int")).orderBy(F.desc("focus"), F.desc("sessions"), "pattern_id", "subject")


CONTEXT = {"repo": "repo", "cwd_hash": "cwd_hash", "provider": "provider", "turn_id": "turn_id", "model": "model", "effort": "effort"}


def session_contexts(log_events: DataFrame) -> DataFrame:
    """(session_id, context): the latest known value of each column that a session's own log tells."""
    at = F.struct("ts", "event_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    return log_events.filter("session_id is not null").groupBy("session_id").agg(*(last(c) for c in (*CONTEXT, "agent_version"))).select("session_id", F.struct(*CONTEXT, "agent_version").alias("context"))


def with_session_context(usage: DataFrame, contexts: DataFrame) -> DataFrame:
    """Usage rows with what only the session's log knows: missing values are filled, the version is the log's.

    A provider that is the router makes the billing route the router's. Sessions without a context stay as they are.
    """
    x = usage.join(contexts, "session_id", "left")
    known = F.col("context").isNotNull()
    new = {c: F.coalesce(c, F.col("context").getField(c)) for c in CONTEXT}
    new["agent_version"] = F.coalesce("context.agent_version", "agent_version")
    new["billing_route"] = F.when(known & (new["provider"] == "router"), "router").otherwise(F.col("billing_route"))
    return x.withColumns(new).select(*usage.columns)


def with_clients(sessions: DataFrame, registry: DataFrame, host: str) -> DataFrame:
    """Sessions whose client is unknown, or the older joint label, refined by what this host's files tell."""
    r = registry.filter(F.col("host_id") == host).select(F.col("session_id").alias("_s"), F.col("host_id").alias("_h"), F.col("client").alias("_observed"))
    x = sessions.join(r, (F.col("session_id") == F.col("_s")) & (F.col("host_id") == F.col("_h")), "left")
    return x.withColumn("client", F.when(F.col("_observed").isNotNull(), refined_clients(F.col("client"), F.col("_observed"))).otherwise(F.col("client"))).select(*sessions.columns)


def classification_facts(registry: DataFrame) -> DataFrame:
    """Facts of sessions that the desktop's cowork mode began: metadata without a time, the same on every replay."""
    r = registry.filter("client = 'chatgpt_desktop_cowork'")
    key = F.concat_ws(":", F.lit("originator-v1"), "session_id", "client")
    return conform(
        r, event_id=event_id(F.col("host_id"), F.lit("log"), F.lit("session.client"), key), agent=F.lit("codex"), source=F.lit("log"), event_type=F.lit("session.client"), ts=F.lit(0), dt=day_of(F.lit(0)), correlation_confidence=F.lit("observed_originator"),
    )


def backfill_boundary(days: list[str], first_started_ms: int) -> int:
    """Where history ends and the collector's own events begin: the earliest day in the table, else the first start."""
    from datetime import UTC, datetime

    known = []
    for d in days:
        try:
            known.append(int(datetime.strptime(d, "%Y-%m-%d").replace(tzinfo=UTC).timestamp() * 1000))
        except ValueError:  # a folder that is no day
            continue
    return min(known, default=first_started_ms)


def backfill_plan(files: DataFrame, done: DataFrame, boundary_ms: int) -> DataFrame:
    """(file, plan) of (file, modified_ms, last_ts), oldest first: done before, overlapping what was collected, or to be read."""
    seen = done.select(F.col("file").alias("_done")).distinct()
    plan = F.when(F.col("_done").isNotNull(), "done").when(F.col("last_ts") >= boundary_ms, "overlap").otherwise("backfill")
    return files.join(seen, F.col("file") == F.col("_done"), "left").withColumn("plan", plan).orderBy("modified_ms", "file").select("file", "modified_ms", "plan")
