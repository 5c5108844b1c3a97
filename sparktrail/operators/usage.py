"""Tool, server, skill, day, session and token queries over the event log. Each takes events and returns a relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrail.functions.columns import counted, iso_second, json_list, names, rate, total, total_where

from .billing import Evidence, route_requests
from .dedup import preferred_usage, tool_results, without_result_copies


def since(e: DataFrame, today: str, days: int) -> DataFrame:
    """Events of the `days` UTC days that end with `today`."""
    if not 1 <= days <= 365:
        raise ValueError("days must be from 1 to 365")
    return e.filter(F.col("dt") >= F.date_sub(F.lit(today).cast("date"), days - 1).cast("string"))


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def today(e: DataFrame, day: str) -> DataFrame:
    """The day's tokens per model, with the whole day's counts on each row. Failures count tool results once."""
    e = e.filter(F.col("dt") == day)
    whole = e.agg(F.count("*").alias("events"), counted(_is("tool.call")).alias("tool_calls"), counted(~F.col("success") & ~_is("tool.result")).alias("other_failures"))
    failed = tool_results(e).agg(counted(~F.col("success")).alias("result_failures"))
    per_model = e.groupBy("model").agg(total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), total("cost_usd").alias("cost_usd"))
    one_row = whole.crossJoin(failed).select("events", "tool_calls", (F.col("other_failures") + F.col("result_failures")).alias("failures"))
    return per_model.crossJoin(F.broadcast(one_row)).orderBy(F.desc_nulls_last("input_tokens"))  # one row


def _with_results(e: DataFrame, key: str, observed: list[Column], results: list[Column]) -> DataFrame:
    """Measures of all events of each key beside measures of its tool results, counted once."""
    e = e.filter(F.col(key).isNotNull())
    left = e.groupBy(key).agg(*observed)
    right = tool_results(e).groupBy(F.col(key).alias("_key")).agg(*results)
    return left.join(right, F.col(key) == F.col("_key"), "left").drop("_key").withColumn("failures", F.coalesce("failures", F.lit(0).cast("long")))


def _calls() -> Column:
    return counted(_is("tool.call")).alias("calls")


def _failures() -> Column:
    return counted(~F.col("success")).alias("failures")


def _percentiles() -> list[Column]:
    return [F.percentile("duration_ms", F.lit(p)).alias(f"p{round(100 * p)}_duration_ms") for p in (0.5, 0.95)]


def tools(e: DataFrame) -> DataFrame:
    return _with_results(e, "tool_name", [_calls()], [_failures(), *_percentiles()]).orderBy(F.desc("calls"), "tool_name")


def web_tools(e: DataFrame) -> DataFrame:
    return _with_results(e, "tool_name", [F.max("tool_kind").alias("tool_kind"), _calls()], [_failures(), *_percentiles()]).orderBy(F.desc("calls"), "tool_name")


def mcp(e: DataFrame) -> DataFrame:
    return _with_results(e, "mcp_server", [_calls(), F.count_distinct("session_id").alias("distinct_sessions")], [_failures()]).orderBy(F.desc("calls"), "mcp_server")


def web_mcp(e: DataFrame) -> DataFrame:
    last = F.max(F.when(_is("tool.call"), F.col("dt"))).alias("last_called_dt")
    return _with_results(e, "mcp_server", [_calls(), F.count_distinct("session_id").alias("distinct_sessions"), last], [_failures()]).orderBy(F.desc("calls"), "mcp_server")


def skills(e: DataFrame) -> DataFrame:
    observed = [_calls(), F.count_distinct("session_id").alias("distinct_sessions"), F.max("dt").alias("last_used_dt")]
    return _with_results(e, "skill_name", observed, [_failures()]).orderBy(F.desc("calls"), "skill_name")


def reach(e: DataFrame) -> DataFrame:
    """Calls by day, session and way of reaching a resource."""
    return e.filter(_is("tool.call") & F.col("tool_kind").isin("mcp", "bash", "browser")).groupBy("dt", "session_id", "tool_kind").agg(F.count("*").alias("calls")).orderBy("dt", "session_id", "tool_kind")


def overview(e: DataFrame) -> DataFrame:
    """Per day. Tokens are summed over all rows, whatever their source."""
    left = e.groupBy("dt").agg(F.count("*").alias("events"), counted(_is("tool.call")).alias("tool_calls"), total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), total("cost_usd").alias("cost_usd"))
    right = without_result_copies(e).filter(~F.col("success")).groupBy(F.col("dt").alias("_dt")).agg(F.count("*").alias("failures"))
    return left.join(right, F.col("dt") == F.col("_dt"), "left").drop("_dt").withColumn("failures", F.coalesce("failures", F.lit(0).cast("long"))).orderBy("dt")


def machines(e: DataFrame, today: str) -> DataFrame:
    """Per host: the last event, and events of the trailing 30 days."""
    start = F.date_sub(F.lit(today).cast("date"), 29).cast("string")
    return e.groupBy("host_id").agg(iso_second(F.max("ts")).alias("last_event_ts"), counted(F.col("dt") >= start).alias("events_30d")).orderBy(F.desc_nulls_last("last_event_ts"))


def filter_options(e: DataFrame) -> DataFrame:
    """Hosts and repositories to choose from; empty ones left out."""
    kinds = F.explode(F.array(F.struct(F.lit("host").alias("kind"), F.col("host_id").alias("name")), F.struct(F.lit("repo").alias("kind"), F.col("repo").alias("name"))))
    return e.select(kinds.alias("o")).select("o.kind", "o.name").filter("name <> ''").distinct().orderBy("kind", "name")


def sessions(e: DataFrame, limit: int = 50) -> DataFrame:
    """Newest sessions first; tokens over all rows, failures with tool results once."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be from 1 to 500")
    e = e.filter("session_id is not null")
    left = e.groupBy("session_id").agg(
        F.max("agent").alias("agent"), F.max("host_id").alias("host_id"), F.min("ts").alias("_first"), F.count("*").alias("events"), counted(_is("tool.call")).alias("tool_calls"),
        F.coalesce(names("model"), F.lit("")).alias("models"), total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), total("cost_usd").alias("cost_usd"), names("client").alias("client"),
    )
    newest = left.orderBy(F.desc("_first"), "session_id").limit(limit)
    shown = e.join(F.broadcast(newest.select("session_id")), "session_id", "left_semi")  # at most 500 ids
    right = without_result_copies(shown).filter(~F.col("success")).groupBy(F.col("session_id").alias("_s")).agg(F.count("*").alias("failures"))
    out = newest.join(right, F.col("session_id") == F.col("_s"), "left").withColumn("failures", F.coalesce("failures", F.lit(0).cast("long"))).withColumn("started_at", iso_second(F.col("_first")))
    return out.orderBy(F.desc("_first"), "session_id").drop("_s", "_first")


def configured(e: DataFrame, column: str, kinds: list[str] | None = None) -> DataFrame:
    """(session_id, name): distinct entries of the sessions' configuration snapshots."""
    rows = e.filter(F.col(column).isNotNull())
    if kinds:
        rows = rows.filter(F.col("event_type").isin(kinds) & F.col("session_id").isNotNull())
    return rows.select("session_id", F.explode(json_list(F.col(column))).alias("name")).distinct()


def unused_skills(e: DataFrame) -> DataFrame:
    have = configured(e, "configured_skills", ["session.start", "session.end"]).groupBy("name").agg(F.count("*").alias("sessions_configured"))
    used = e.filter(_is("tool.call") & F.col("skill_name").isNotNull()).groupBy("skill_name").agg(F.count("*").alias("calls"), F.count_distinct("session_id").alias("distinct_sessions"), F.max("dt").alias("last_used_dt"))
    out = have.join(used, F.col("name") == F.col("skill_name"), "full_outer")
    out = out.select(F.coalesce("name", "skill_name").alias("skill_name"), F.col("name").isNotNull().alias("configured"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("sessions_configured", "calls", "distinct_sessions")), "last_used_dt")
    return out.orderBy(F.desc(F.col("configured") & (F.col("calls") == 0)), F.desc("sessions_configured"), "calls", "skill_name")


def _called(e: DataFrame) -> DataFrame:
    return e.filter(_is("tool.call") & F.col("mcp_server").isNotNull()).groupBy("mcp_server").agg(F.count("*").alias("calls"), F.count_distinct("session_id").alias("distinct_sessions"), F.max("dt").alias("last_called_dt"))


def unused_mcp(e: DataFrame, servers: list[str]) -> DataFrame:
    """Configured servers against calls; the configured and never called first."""
    have = e.sparkSession.createDataFrame([(s,) for s in sorted(set(servers))], "name string")
    out = have.join(_called(e), F.col("name") == F.col("mcp_server"), "full_outer")
    out = out.select(F.coalesce("name", "mcp_server").alias("mcp_server"), F.col("name").isNotNull().alias("configured"), F.coalesce("calls", F.lit(0).cast("long")).alias("calls_in_range"), "last_called_dt")
    return out.orderBy(F.desc(F.col("configured") & (F.col("calls_in_range") == 0)), F.desc("configured"), "calls_in_range", "mcp_server")


def web_unused_mcp(e: DataFrame, servers: list[str]) -> DataFrame:
    have = e.sparkSession.createDataFrame([(s,) for s in sorted(set(servers))], "name string")
    out = have.join(_called(e), F.col("name") == F.col("mcp_server"), "full_outer")
    zero = F.lit(0).cast("long")
    return out.select(F.coalesce("name", "mcp_server").alias("mcp_server"), F.col("name").isNotNull().alias("configured"), F.coalesce("calls", zero).alias("calls"), F.coalesce("distinct_sessions", zero).alias("distinct_sessions"), "last_called_dt", zero.alias("sessions_configured"), F.lit(True).alias("configured_from_snapshot"))


def s3_unused_mcp(e: DataFrame) -> DataFrame:
    """Servers of session snapshots (any row that has one) against calls."""
    have = configured(e, "configured_mcp_servers").groupBy("name").agg(F.count_distinct("session_id").alias("sessions_configured"))
    out = have.join(_called(e), F.col("name") == F.col("mcp_server"), "full_outer")
    zero = F.lit(0).cast("long")
    known = F.col("name").isNotNull()
    return out.select(F.coalesce("name", "mcp_server").alias("mcp_server"), known.alias("configured"), *(F.coalesce(c, zero).alias(c) for c in ("calls", "distinct_sessions", "sessions_configured")), "last_called_dt", known.alias("configured_from_snapshot")).orderBy("calls", "mcp_server")


def first_context(e: DataFrame) -> DataFrame:
    """Per session with otel requests: their number, and the input and cache-read tokens of the earliest."""
    otel = e.filter(_is("api.request") & (F.col("source") == "otel") & F.col("session_id").isNotNull())
    seen = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("cache_read_tokens", F.lit(0))
    return otel.groupBy("session_id").agg(
        F.count("*").alias("api_requests"), *(total(c).alias(c) for c in ("input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens")),
        F.min_by(seen, F.struct("ts", "event_id")).alias("first_input_tokens"),
    )


def schema_tax(e: DataFrame) -> DataFrame:
    """Share of the first request's context in all input of a session; a row TOTAL comes last."""
    each = first_context(e)
    sums = ("api_requests", "input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens", "first_input_tokens")
    whole = each.agg(*(total(c).alias(c) for c in sums), total(F.col("input_tokens") + F.col("cache_read_tokens")).alias("_all")).withColumn("session_id", F.lit("TOTAL"))
    out = each.withColumn("_all", F.col("input_tokens") + F.col("cache_read_tokens")).unionByName(whole)
    share = F.lit(100.0) * F.col("first_input_tokens") / F.nullif("_all", F.lit(0)).cast("double")
    return out.select("session_id", *sums, share.alias("fixed_share_pct")).orderBy(F.col("session_id") == "TOTAL", F.desc_nulls_last("fixed_share_pct"))


def snapshots(e: DataFrame) -> DataFrame:
    """(session_id, start_ts, servers, n): each session's server list; that of its end goes before that of its start."""
    rows = e.filter(F.col("event_type").isin("session.start", "session.end") & F.col("configured_mcp_servers").isNotNull() & F.col("session_id").isNotNull())
    pick = rows.groupBy("session_id").agg(F.min_by(F.struct("ts", "configured_mcp_servers"), F.struct(F.col("event_type") != "session.end", "ts", "event_id")).alias("x"))
    servers = json_list(F.col("x.configured_mcp_servers"))
    return pick.select("session_id", F.col("x.ts").alias("start_ts"), servers.alias("servers"), F.greatest(F.size(servers), F.lit(1)).alias("n"))


def mcp_tax(e: DataFrame) -> DataFrame:
    """A session's first context, split equally among its configured servers and paid on every request."""
    priced = snapshots(e).join(first_context(e).select("session_id", "api_requests", "first_input_tokens"), "session_id", "left")
    used = e.filter(_is("tool.call") & F.col("mcp_server").isNotNull() & F.col("session_id").isNotNull()).select(F.col("session_id").alias("_s"), F.col("mcp_server").alias("_m")).distinct()
    placed = priced.select("session_id", "n", "api_requests", F.col("first_input_tokens").alias("size"), F.posexplode("servers").alias("at", "mcp_server"), "servers").withColumn("once", F.array_position("servers", F.col("mcp_server")) == F.col("at") + 1)
    each = placed.join(used, (F.col("session_id") == F.col("_s")) & (F.col("mcp_server") == F.col("_m")), "left")
    share = F.col("size").cast("double") / F.col("n") * F.col("api_requests")
    is_used = F.col("_s").isNotNull()
    # one row per server and size of the first context, however many sessions there are
    by_size = each.groupBy("mcp_server", "size").agg(
        F.count("*").alias("configured"), counted(is_used).alias("used"), total(share).alias("share"), total_where(~is_used, share).alias("unused_share"), counted(F.col("once")).alias("having"),
    )
    known = F.col("size").isNotNull()
    per = by_size.groupBy("mcp_server").agg(
        total("configured").alias("sessions_configured"), total("used").alias("sessions_used"), total(F.col("configured") - F.col("used")).alias("sessions_unused"), F.coalesce(total_where(known, "configured"), F.lit(0)).alias("sessions_with_usage"),
        F.round(total("share")).cast("long").alias("fixed_tokens_est"), F.round(total("unused_share")).cast("long").alias("unused_tokens_est"),
        F.percentile("size", F.lit(0.5), F.col("configured")).alias("_with"),
    )
    # the sessions without a server are all sessions less those with it
    sizes = priced.filter("first_input_tokens is not null").groupBy(F.col("first_input_tokens").alias("size")).agg(F.count("*").alias("sessions"))
    having = by_size.filter(known).select(F.col("mcp_server").alias("_server"), "size", "having")
    left = sizes.crossJoin(per.select(F.col("mcp_server").alias("_server"))).join(having, ["_server", "size"], "left").withColumn("others", F.col("sessions") - F.coalesce("having", F.lit(0)))
    without = left.filter("others > 0").groupBy("_server").agg(F.percentile("size", F.lit(0.5), F.col("others")).alias("_without"))
    out = per.join(without, F.col("mcp_server") == F.col("_server"), "left")
    return out.withColumn("marginal_first_tokens_est", F.round(F.col("_with") - F.col("_without")).cast("long")).drop("_with", "_without", "_server").orderBy(F.desc_nulls_last("unused_tokens_est"), F.desc_nulls_last("fixed_tokens_est"), "mcp_server")


def subagents(e: DataFrame, with_total: bool = True) -> DataFrame:
    """What ran inside subagents, per session: agents to sessions to TOTAL. Unknown durations make a session's unknown."""
    e = e.filter("session_id is not null")
    zero = F.lit(0)
    tokens = F.coalesce("input_tokens", zero) + F.coalesce("output_tokens", zero)
    has = F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()
    agents = e.filter("agent_id is not null").groupBy("session_id", "agent_id").agg(
        F.max("agent_type").alias("agent_type"), F.min("ts").alias("first"), F.max("ts").alias("last"), counted(_is("tool.call")).alias("calls"), counted(_is("api.request")).alias("requests"),
        total_where(_is("api.request") & has, tokens).alias("request_tokens"), F.max(F.when(_is("subagent.stop") & has, tokens)).alias("stop_tokens"), F.max(F.when(_is("subagent.stop"), F.col("duration_ms"))).alias("stop_ms"),
    )
    agents = agents.withColumn("ms", F.coalesce("stop_ms", F.when(F.col("last") > F.col("first"), F.col("last") - F.col("first")))).withColumn("tokens", F.coalesce("request_tokens", "stop_tokens"))
    per = agents.groupBy("session_id").agg(
        F.count("*").alias("subagents"), names("agent_type").alias("agent_types"), total("calls").alias("subagent_tool_calls"), total("requests").alias("subagent_api_requests"),
        F.when(F.count("*") == F.count("ms"), total("ms")).alias("subagent_duration_ms"), total("tokens").alias("subagent_tokens_est"), F.count("tokens").alias("subagents_with_usage"),
    )
    request = lambda source: total_where(_is("api.request") & (F.col("source") == source), tokens)
    whole = e.groupBy("session_id").agg(F.min("ts").alias("first_ts"), (F.max("ts") - F.min("ts")).alias("session_duration_ms"), counted(_is("tool.call")).alias("tool_calls"), F.coalesce(request("otel"), request("log")).alias("session_tokens_est"))
    rows = per.join(whole, "session_id").withColumns({"started_at": iso_second(F.col("first_ts")), "ord": F.lit(0)})
    if with_total:
        known = F.count("*") == F.count("subagent_duration_ms")
        sums = ["subagents", "subagent_tool_calls", "tool_calls", "session_duration_ms", "subagent_api_requests", "subagent_tokens_est", "session_tokens_est", "subagents_with_usage"]
        one = rows.agg(*(total(c).alias(c) for c in sums), F.when(known, total("subagent_duration_ms")).alias("subagent_duration_ms")).withColumns({"session_id": F.lit("TOTAL"), "ord": F.lit(1)})
        rows = rows.unionByName(one, allowMissingColumns=True)
    rows = rows.withColumns({"duration_share": F.round(rate(F.col("subagent_duration_ms"), F.col("session_duration_ms")), 3), "token_share": F.round(rate(F.col("subagent_tokens_est"), F.col("session_tokens_est")), 3)})
    columns = ["session_id", "started_at", "subagents", "agent_types", "subagent_tool_calls", "tool_calls", "subagent_duration_ms", "session_duration_ms", "duration_share", "subagent_api_requests", "subagent_tokens_est", "session_tokens_est", "token_share", "subagents_with_usage"]
    return rows.orderBy("ord", F.desc_nulls_last("subagents"), F.desc_nulls_last("first_ts")).select(*columns)


def coverage(e: DataFrame, all_events: DataFrame, silent_before_ms: int) -> DataFrame:
    """What the log has and lacks, in one row. Hosts are counted over all events."""
    has = F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()
    result, keyed = _is("tool.result"), F.col("correlation_key").isNotNull()
    # a row says something of the whole, of its session, of its result's key and of its agent: each is a group, summed before the shuffle
    fact = lambda kind, when, key: F.when(when, F.struct(F.lit(kind).alias("kind"), F.col("session_id").alias("s"), key.cast("string").alias("k")))
    nothing = F.lit(None)
    facts = F.array_compact(F.array(
        F.struct(F.lit("all").alias("kind"), nothing.cast("string").alias("s"), nothing.cast("string").alias("k")), fact("session", F.col("session_id").isNotNull(), nothing),
        fact("key", result & keyed, F.col("correlation_key")), fact("agent", F.col("agent_id").isNotNull() & F.col("event_type").isin("api.request", "subagent.stop"), F.col("agent_id")),
    ))
    grouped = e.withColumn("fact", F.explode(facts)).groupBy("fact").agg(
        F.count("*").alias("n"), counted(F.col("user_id").isNull()).alias("no_user"), counted(result).alias("results"), counted(result & ~keyed).alias("unkeyed"), F.max("ts").alias("last"),
        F.bool_or(_is("api.request") & has).alias("asked"), F.bool_or(has).alias("has"), F.bool_or(F.col("source") == "hook").alias("hook"), F.bool_or(F.col("source") == "otel").alias("otel"),
    )
    of = lambda kind: F.col("fact.kind") == kind
    whole = lambda c: F.coalesce(F.sum(F.when(of("all"), F.col(c))), F.lit(0)).cast("long")
    out = grouped.agg(
        whole("n").alias("events"), whole("no_user").alias("events_user_id_null"), whole("results").alias("tool_results_raw"), iso_second(F.max(F.when(of("all"), F.col("last")))).alias("last_event_ts"),
        counted(of("session")).alias("sessions"), counted(of("session") & ~F.col("asked")).alias("sessions_without_usage"), counted(of("key") & F.col("hook")).alias("tool_results_hook"), counted(of("key") & F.col("otel")).alias("tool_results_otel"),
        counted(of("key") & F.col("hook") & F.col("otel")).alias("tool_results_matched"), counted(of("agent")).alias("subagents"), counted(of("agent") & F.col("has")).alias("subagents_with_usage"),
        (whole("unkeyed") + counted(of("key"))).alias("tool_results_deduped"),
    )
    h = all_events.groupBy("host_id").agg(F.max("ts").alias("last")).agg(F.count("*").alias("hosts"), counted(F.col("last") < silent_before_ms).alias("hosts_silent_24h"))
    return out.crossJoin(h)  # one row each


def coverage_summary(c: DataFrame) -> DataFrame:
    """Whole percents of coverage (null for a whole of 0), and whether to warn: usage or match under 80 %, a silent host."""

    def percent(part: Column, whole: str) -> Column:
        return F.round(rate(part * 100, F.col(whole))).cast("long")

    out = c.select(
        percent(F.col("sessions") - F.col("sessions_without_usage"), "sessions").alias("usage_pct"), percent(F.col("tool_results_matched"), "tool_results_hook").alias("match_pct"),
        percent(F.col("tool_results_raw") - F.col("tool_results_deduped"), "tool_results_raw").alias("dropped_pct"), percent(F.col("subagents_with_usage"), "subagents").alias("subagent_usage_pct"),
        percent(F.col("events") - F.col("events_user_id_null"), "events").alias("attributed_pct"), "hosts", "hosts_silent_24h",
    )
    low = F.coalesce(F.col("usage_pct") < 80, F.lit(False)) | F.coalesce(F.col("match_pct") < 80, F.lit(False))
    return out.withColumn("warn", low | (F.col("hosts_silent_24h") > 0))


def complete() -> Column:
    """Requests whose four counters are known and consistent."""
    counters = [F.col(c) >= 0 for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")]
    sound = ~F.col("model").startswith("gpt-") | (F.col("input_tokens") >= F.col("cache_read_tokens") + F.col("cache_write_tokens"))
    return counters[0] & counters[1] & counters[2] & counters[3] & sound


USAGE = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]


def grouped_usage(requests: DataFrame) -> DataFrame:
    """Requests and tokens per model and effort, with the days to price as JSON."""
    from sparktrail.functions.columns import day_of

    requests = requests.withColumn("_fine", F.coalesce(complete(), F.lit(False))).withColumn("model", F.coalesce("model", F.lit("unknown")))
    fine = F.col("_fine")
    inside = F.col("agent_id").isNotNull() | F.col("agent_type").isNotNull() | F.col("query_source").startswith("agent:")
    inside = F.coalesce(inside, F.lit(False))
    reported = (F.col("cost_usd") >= 0) & (F.col("cost_usd") < float("inf"))
    zero = F.lit(0)
    tokens = F.coalesce("input_tokens", zero) + F.coalesce("output_tokens", zero)
    base = requests.groupBy("model", "effort").agg(
        F.count("*").alias("api_requests"), F.count_distinct("session_id").alias("sessions"), counted(inside).alias("subagent_api_requests"), total_where(inside, tokens).alias("subagent_tokens"),
        *(total(c).alias(c) for c in [*USAGE, "reasoning_tokens"]), total_where(reported, "cost_usd").alias("cost_usd"), counted(reported).alias("reported_cost_requests"),
        counted(fine).alias("complete_usage_requests"), *(total_where(fine, c).alias(f"complete_{c}") for c in USAGE),
    )
    days = requests.filter(fine).groupBy("model", "effort", day_of(F.col("ts")).alias("day")).agg(F.count("*").alias("n"), *(total(c).alias(c) for c in USAGE))
    entry = F.concat(F.lit('["'), "day", F.lit('",'), F.concat_ws(",", *(F.col(c).cast("string") for c in ["n", *USAGE])), F.lit("]"))
    priced = days.groupBy(F.col("model").alias("_m"), F.col("effort").alias("_e")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(entry)), ","), F.lit("]")).alias("price_days"))
    return base.join(priced, (F.col("model") == F.col("_m")) & F.col("effort").eqNullSafe(F.col("_e")), "left").drop("_m", "_e")


def models(e: DataFrame) -> DataFrame:
    """Usage and errors per model and effort; those that only failed have no usage, not 0."""
    usage = grouped_usage(preferred_usage(e))
    errors = e.filter(_is("api.error")).groupBy(F.coalesce("model", F.lit("unknown")).alias("_m"), F.col("effort").alias("_e")).agg(F.count("*").alias("api_errors"))
    out = usage.join(errors, (F.col("model") == F.col("_m")) & F.col("effort").eqNullSafe(F.col("_e")), "full_outer")
    zero = F.lit(0).cast("long")
    out = out.withColumns({"model": F.coalesce("model", "_m"), "effort": F.coalesce("effort", "_e")} | {c: F.coalesce(c, zero) for c in ("api_requests", "api_errors", "sessions", "subagent_api_requests")})
    return out.drop("_m", "_e").orderBy(F.desc(F.coalesce("input_tokens", zero) + F.coalesce("output_tokens", zero)), F.asc_nulls_last("model"), F.asc_nulls_last("effort"))


def models_daily(e: DataFrame) -> DataFrame:
    return preferred_usage(e).groupBy("dt", F.coalesce("model", F.lit("unknown")).alias("model")).agg(total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), total("cost_usd").alias("cost_usd")).orderBy("dt", "model")


def routed(requests: DataFrame) -> DataFrame:
    """Add `route`: router goes before what the request says; without any it is unknown."""
    return requests.withColumn("route", F.when(F.col("provider") == "router", "router").otherwise(F.coalesce("billing_route", F.lit("unknown"))))


def _with_routes(e: DataFrame, evidence: Evidence | None) -> DataFrame:
    r = preferred_usage(e)
    return routed(r) if evidence is None else route_requests(r, evidence)


def billing_routes(e: DataFrame, evidence: Evidence | None = None) -> DataFrame:
    """Requests by the way in which they were paid for; without evidence only what the requests themselves say counts."""
    known = ["subscription", "api_key", "router"]
    return _with_routes(e, evidence).agg(*(counted(F.col("route") == k).alias(k) for k in known), counted(~F.col("route").isin(known)).alias("unknown"))


def subscription_models(e: DataFrame, evidence: Evidence | None = None) -> DataFrame:
    return grouped_usage(_with_routes(e, evidence).filter("route = 'subscription'"))


def subscription_usage(limits: DataFrame) -> DataFrame:
    """One row for each window of the latest report of each agent and account, of (agent, account, observed_at, windows).

    Reports are states, never summed; a report whose windows were all dropped still has a row, without a window.
    """
    from sparktrail.functions.normalize import latest_limits

    return latest_limits(limits).select("agent", "account", "observed_at", F.explode_outer("windows").alias("w")).select("agent", "account", "observed_at", "w.*")
