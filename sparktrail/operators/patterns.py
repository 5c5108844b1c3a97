"""Stuck-agent patterns: sequences, islands, context jumps, slow tools and unused servers, with what they cost.

Every branch returns HIT columns. Sequence patterns read the next five events of a session from one window, so that a
session is sorted once and nothing is joined with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrail.functions.columns import day_of, json_list, rate, total
from sparktrail.session import stored, tasks_for

from .dedup import is_first_observation, tool_results
from .usage import first_context, snapshots

HIT = ["session_id", "pattern_id", "subject", "hit_key", "first_ts", "last_ts", "incidents", "detail"]
AHEAD = 5


def _in_session() -> Window:
    return Window.partitionBy("session_id").orderBy("ts", "event_id")


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())), {"ignoreNullFields": "false"})


def with_detours(e: DataFrame) -> DataFrame:
    """Add `first` (the row stands for its tool result) and `detours`: bash and browser calls among the next five events."""
    if {"first", "detours"} <= set(e.columns):
        return e
    call = (F.col("event_type") == "tool.call") & F.col("tool_kind").isin("bash", "browser")
    ahead = F.collect_list(F.when(call, F.struct("event_id", "tool_name", "ts"))).over(_in_session().rowsBetween(1, AHEAD))
    return e.withColumn("first", is_first_observation()).withColumn("detours", ahead)


#: What the branches read of an event.
READ = (
    "session_id event_id ts event_type source tool_name tool_kind mcp_server success duration_ms correlation_key agent_id query_source model "
    "input_tokens output_tokens cache_read_tokens cache_write_tokens configured_mcp_servers"
).split()


def by_session(e: DataFrame, tasks: int | None = None) -> DataFrame:
    """The log dealt by session to tasks of bounded size; filters and columns chosen later apply before that shuffle."""
    return e.repartition(tasks or tasks_for(e), "session_id")


def observed(e: DataFrame, tasks: int | None = None) -> DataFrame:
    """What all branches share, from one scan of the log and one deal by session: the columns that they read, which row stands
    for its tool result, the detours and tools around it. Stored, as each branch then reads a few columns of some rows.
    """
    rows = by_session(e.select(*READ), tasks)  # all windows below are within a session, so this is the only shuffle
    return stored(with_last_tools(with_detours(rows)))


def results_once(e: DataFrame) -> DataFrame:
    return e.filter("first") if "first" in e.columns else tool_results(e)


def failed_mcp() -> Column:
    return F.col("first") & ~F.col("success") & (F.col("tool_kind") == "mcp")


def bypass(e: DataFrame) -> DataFrame:
    """A failed MCP result and each bash or browser call within the next five events; events without a session don't take part."""
    hits = with_detours(by_session(e.filter("session_id is not null"))).filter(failed_mcp()).withColumn("x", F.explode("detours"))
    return hits.select("session_id", "mcp_server", F.col("x.tool_name").alias("following_tool_name"), F.col("ts").alias("fail_ts"), F.col("x.ts").alias("bypass_ts")).orderBy("session_id", "fail_ts", "bypass_ts")


def thrash(e: DataFrame) -> DataFrame:
    """Tools that failed three times or more and never worked in a session, and detours after a denial."""
    results = tool_results(e).filter("tool_name is not null")
    pairs = results.groupBy("session_id", "tool_name").agg(F.count_if(~F.col("success")).alias("incidents"), F.min(F.when(~F.col("success"), F.col("ts"))).alias("first_ts"), F.max(F.when(~F.col("success"), F.col("ts"))).alias("last_ts"), F.count_if("success").alias("worked"))
    columns = ["session_id", "kind", "tool_name", "incidents", "first_ts", "last_ts"]
    failures = pairs.filter("incidents >= 3 and worked = 0 and session_id is not null").withColumn("kind", F.lit("repeat_failure")).select(columns)
    denied = with_detours(by_session(e.filter("session_id is not null"))).filter("event_type = 'tool.denied'").withColumn("x", F.explode("detours"))
    detours = denied.select("session_id", F.lit("deny_detour").alias("kind"), "tool_name", F.lit(1).cast("long").alias("incidents"), F.col("ts").alias("first_ts"), F.col("x.ts").alias("last_ts"))
    return failures.unionByName(detours).orderBy("session_id", "first_ts")


def _hit(pattern: str, rows: DataFrame, subject: Column, key: Column, first: Column, last: Column, incidents: Column, detail: Column) -> DataFrame:
    return rows.select("session_id", F.lit(pattern).alias("pattern_id"), subject.alias("subject"), key.alias("hit_key"), first.alias("first_ts"), last.alias("last_ts"), incidents.cast("long").alias("incidents"), detail.alias("detail"))


def _detours(e: DataFrame, *patterns: str) -> DataFrame:
    """Hits of mcp_bypass and deny_detour, from one pass over the sessions."""
    bypassed = failed_mcp() & F.col("mcp_server").isNotNull()
    denied = (F.col("event_type") == "tool.denied") & F.col("tool_name").isNotNull()
    pattern = F.when(bypassed, "mcp_bypass").when(denied, "deny_detour")
    rows = with_detours(e).withColumn("pattern_id", pattern).filter(F.col("pattern_id").isin(*patterns)).withColumn("x", F.explode("detours"))
    was_bypassed = F.col("pattern_id") == "mcp_bypass"
    detail = F.when(was_bypassed, _json(failed_tool=F.col("tool_name"), detour_tool=F.col("x.tool_name"))).otherwise(_json(detour_tool=F.col("x.tool_name")))
    return rows.select(
        "session_id", "pattern_id", F.when(was_bypassed, F.col("mcp_server")).otherwise(F.col("tool_name")).alias("subject"), F.concat("event_id", F.lit(">"), "x.event_id").alias("hit_key"), F.col("ts").alias("first_ts"), F.col("x.ts").alias("last_ts"),
        F.lit(1).cast("long").alias("incidents"), detail.alias("detail"),
    )


def mcp_bypass(e: DataFrame) -> DataFrame:
    return _detours(e, "mcp_bypass")


def deny_detour(e: DataFrame) -> DataFrame:
    return _detours(e, "deny_detour")


def retry_spiral(e: DataFrame) -> DataFrame:
    """Three or more failures of a tool in a row; results of unknown success don't count."""
    rows = results_once(e).filter("tool_name is not null and success is not null")
    order = Window.partitionBy("session_id", "tool_name").orderBy("ts", "event_id")
    # successes so far stay the same during a run of failures
    runs = rows.withColumn("run", F.count_if("success").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("not success")
    found = runs.groupBy("session_id", "tool_name", "run").agg(F.min("event_id").alias("k"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"), F.max("mcp_server").alias("m")).filter("n >= 3")
    return _hit("retry_spiral", found, F.col("tool_name"), F.col("k"), F.col("a"), F.col("b"), F.col("n"), _json(mcp_server=F.col("m")))


def permission_denied_loop(e: DataFrame) -> DataFrame:
    """Two or more denials of one tool in a row, among a session's denials."""
    rows = e.filter("event_type = 'tool.denied' and tool_name is not null")
    w = _in_session()
    other = (F.lag("tool_name").over(w) != F.col("tool_name")).cast("int")
    runs = rows.withColumn("other", F.coalesce(other, F.lit(0))).withColumn("run", F.sum("other").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy("session_id", "tool_name", "run").agg(F.min("event_id").alias("k"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).filter("n >= 2")
    return _hit("permission_denied_loop", found, F.col("tool_name"), F.col("k"), F.col("a"), F.col("b"), F.col("n"), F.lit("{}"))


def with_last_tools(e: DataFrame) -> DataFrame:
    """Add `by_agent` and `plain`, the tools of the last results before a row of the same agent and of no agent, and `has_log`.

    An exported stream has no agent of its own: its tools are those of rows without an agent.
    """
    if {"by_agent", "plain", "has_log"} <= set(e.columns):
        return e
    agent = F.coalesce(F.concat(F.lit("+"), "agent_id"), F.lit("-"))
    before = Window.partitionBy("session_id", agent).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    result = F.col("event_type") == "tool.result"
    by_agent = F.last(F.when(result, F.col("tool_name")), ignorenulls=True).over(before)
    plain = F.last(F.when(result & F.col("agent_id").isNull(), F.col("tool_name")), ignorenulls=True).over(_in_session().rowsBetween(Window.unboundedPreceding, -1))
    has_log = F.max((F.col("event_type") == "api.request") & (F.col("source") == "log")).over(Window.partitionBy("session_id"))
    return e.withColumns({"by_agent": by_agent, "has_log": has_log, "plain": plain})


def context_jump(e: DataFrame) -> DataFrame:
    """A conversation's context that grows at once by 20,000 tokens and half, and stays; blamed on the last tool result.

    Log requests make the streams of a session that has any, otherwise the otel requests of the main conversation do.
    The last tool is a running value over the session's rows of the same agent: one pass, no join.
    """
    rows = with_last_tools(e.filter("event_type in ('api.request', 'tool.result')")).filter("event_type = 'api.request'")
    log = F.col("source") == "log"
    otel = (F.col("source") == "otel") & ~F.col("has_log") & (F.col("query_source").isNull() | (F.col("query_source") == "main"))
    zero = F.lit(0)
    ctx = F.coalesce("input_tokens", zero) + F.coalesce("cache_read_tokens", zero) + F.coalesce("cache_write_tokens", zero)
    rows = rows.filter(log | otel).withColumns({"ctx": ctx, "stream": F.when(log, F.coalesce("agent_id", F.lit(""))).otherwise(F.lit("")), "tool": F.when(log, F.col("by_agent")).otherwise(F.col("plain"))})
    w = Window.partitionBy("session_id", "stream", F.coalesce("model", F.lit(""))).orderBy("ts", "event_id")
    rows = rows.withColumns({"prev": F.lag("ctx").over(w), "next": F.lead("ctx").over(w)})
    grown = (F.col("prev") >= 5000) & (F.col("ctx") - F.col("prev") >= 20000) & (F.col("ctx") >= F.col("prev") * 1.5) & (F.col("next").isNull() | (F.col("next") >= F.col("ctx") * 0.8))
    detail = _json(kind=F.lit("jump"), ctx_tokens=F.col("ctx"), prev_ctx_tokens=F.col("prev"), delta_tokens=F.col("ctx") - F.col("prev"))
    return _hit("context_bloat", rows.filter(grown), F.coalesce("tool", F.lit("unknown")), F.col("event_id"), F.col("ts"), F.col("ts"), F.lit(1), detail)


def compaction(e: DataFrame) -> DataFrame:
    found = e.filter("event_type = 'compaction'").groupBy("session_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).filter("n >= 2")
    return _hit("context_bloat", found, F.lit("compaction"), F.lit("compaction"), F.col("a"), F.col("b"), F.col("n"), _json(kind=F.lit("compaction")))


def long_tool_tail(e: DataFrame) -> DataFrame:
    """MCP results of ten seconds and three medians of their server and tool."""
    rows = results_once(e).filter("tool_kind = 'mcp' and mcp_server is not null and duration_ms is not null")
    medians = rows.groupBy(F.col("mcp_server").alias("_m"), F.col("tool_name").alias("_t")).agg(F.median("duration_ms").alias("median_ms"))
    slow = rows.filter("duration_ms >= 10000").join(medians, (F.col("mcp_server") == F.col("_m")) & (F.col("tool_name") == F.col("_t"))).filter("duration_ms >= 3 * median_ms")
    detail = _json(tool_name=F.col("tool_name"), duration_ms=F.col("duration_ms"), median_ms=F.round("median_ms"))
    return _hit("long_tool_tail", slow, F.col("mcp_server"), F.col("event_id"), F.col("ts"), F.col("ts") + F.col("duration_ms"), F.lit(1), detail)


def unused_mcp_server(e: DataFrame) -> DataFrame:
    """Configured servers that a session never called, with an equal share of its context on each request."""
    each = snapshots(e).withColumn("server", F.explode("servers"))
    used = e.filter("event_type = 'tool.call' and mcp_server is not null").select("session_id", F.col("mcp_server").alias("server")).distinct()
    span = e.groupBy("session_id").agg(F.max("ts").alias("end_ts"))
    rows = each.join(used, ["session_id", "server"], "left_anti").join(span, "session_id").join(first_context(e).select("session_id", "api_requests", "first_input_tokens"), "session_id", "left")
    estimate = F.round(F.col("first_input_tokens").cast("double") / F.col("n") * F.col("api_requests")).cast("long")
    detail = _json(n_configured=F.col("n"), api_requests=F.col("api_requests"), allocation=F.lit("equal_split"), tokens_est=estimate)
    return _hit("unused_mcp_server", rows, F.col("server"), F.lit("unused"), F.col("start_ts"), F.col("end_ts"), F.lit(1), detail)


BRANCHES = {
    "mcp_bypass": mcp_bypass, "deny_detour": deny_detour, "retry_spiral": retry_spiral, "permission_denied_loop": permission_denied_loop,
    "context_jump": context_jump, "compaction": compaction, "long_tool_tail": long_tool_tail, "unused_mcp_server": unused_mcp_server,
}
DETOURS = ("mcp_bypass", "deny_detour")
BRANCH_OF = {"context_bloat": ["context_jump", "compaction"]}
#: Branches that only sum up: their rows add up before a shuffle, so they take the log as it is.
SUMMED = ("compaction", "unused_mcp_server")


def hits(e: DataFrame, pattern: str | None = None) -> DataFrame:
    """Hits of one pattern or of all, each with the otel tokens of its session within its time span (null: none known).

    All patterns together read the log once, see `observed`.
    """
    e = e.filter("session_id is not null")
    tasks = tasks_for(e)
    if not pattern:
        e = observed(e, tasks)
    dealt = by_session(e, tasks)
    wanted = BRANCH_OF.get(pattern, [pattern]) if pattern else list(BRANCHES)
    parts = [BRANCHES[name](e if name in SUMMED else dealt) for name in wanted if pattern or name not in DETOURS]
    if not pattern:
        parts.append(_detours(e, *DETOURS))  # all that it needs is in the row by now
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    own = found.filter("pattern_id = 'unused_mcp_server'").withColumn("wasted_tokens_est", F.get_json_object("detail", "$.tokens_est").cast("long"))
    return own if pattern == "unused_mcp_server" else own.unionByName(_priced(found.filter("pattern_id <> 'unused_mcp_server'"), e, tasks))


def _priced(found: DataFrame, e: DataFrame, tasks: int) -> DataFrame:
    """Add the tokens of the session's otel requests within each hit's time span, null without any request.

    One pass over a session: running sums of tokens and requests are read off before a span's first and after its last
    moment, and subtracted. A hit costs two rows, however many requests its span holds.
    """
    ends = F.array(F.struct(F.col("first_ts").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("last_ts").alias("at"), F.lit(2).alias("kind")))
    marks = found.select("session_id", F.explode(ends).alias("m"), F.struct(*HIT).alias("hit")).select("session_id", "m.at", "m.kind", "hit")
    tokens = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    spent = e.filter("event_type = 'api.request' and source = 'otel'").select("session_id", F.col("ts").alias("at"), F.lit(1).alias("kind"), tokens.alias("tokens"))
    w = Window.partitionBy("session_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = by_session(marks.unionByName(spent, allowMissingColumns=True), tasks)
    rows = rows.withColumn("so_far", F.struct(F.coalesce(F.sum("tokens").over(w), F.lit(0)).alias("tokens"), F.count("tokens").over(w).alias("n"))).filter("kind <> 1")
    side = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("so_far")))
    pairs = rows.groupBy("session_id", "hit.pattern_id", "hit.subject", "hit.hit_key").agg(F.first("hit").alias("hit"), side(0).alias("a"), side(2).alias("b"))
    return pairs.select("hit.*", F.when(F.col("b.n") > F.col("a.n"), F.col("b.tokens") - F.col("a.tokens")).cast("long").alias("wasted_tokens_est"))


def patterns(e: DataFrame) -> DataFrame:
    return hits(e).drop("hit_key").orderBy("session_id", "first_ts", "pattern_id", "subject")


def patterns_rank(e: DataFrame) -> DataFrame:
    h = hits(e).withColumn("dt", day_of(F.col("first_ts")))
    out = h.groupBy("pattern_id", "subject").agg(
        F.count_distinct("session_id").alias("sessions"), total("incidents").alias("incidents"), total("wasted_tokens_est").alias("wasted_tokens_est"), F.count("wasted_tokens_est").alias("priced_hits"),
        F.count("*").alias("hits"), F.min("dt").alias("first_seen_dt"), F.max("dt").alias("last_seen_dt"),
    )
    out = out.withColumn("priority", F.col("wasted_tokens_est") * F.col("sessions"))
    return out.orderBy(F.desc_nulls_last("priority"), F.desc("sessions"), F.desc("incidents"), "pattern_id", "subject")


def pattern_hits(e: DataFrame, pattern: str, subject: str, limit: int = 50) -> DataFrame:
    """The newest incidents of one pattern and subject."""
    if not pattern or not subject:
        raise ValueError("pattern and subject are required")
    if not 1 <= limit <= 500:
        raise ValueError("limit must be from 1 to 500")
    rows = hits(e, pattern).filter((F.col("pattern_id") == pattern) & (F.col("subject") == subject))
    return rows.select(day_of(F.col("first_ts")).alias("dt"), "session_id", "first_ts", "last_ts", "incidents", "wasted_tokens_est", "detail").orderBy(F.desc("first_ts"), "session_id", "last_ts", "detail").limit(limit)


def eligible(pattern: str, subject: str) -> Column:
    """Events that make a session one in which the pattern could have occurred."""
    kind, known = F.col("event_type"), F.col("success").isNotNull()
    on_server = (F.col("mcp_server") == subject) & (kind == "tool.result")
    return {
        "retry_spiral": (F.col("tool_name") == subject) & (((kind == "tool.result") & known) | (kind == "tool.denied")),
        "permission_denied_loop": (F.col("tool_name") == subject) & (((kind == "tool.result") & known) | (kind == "tool.denied")),
        "mcp_bypass": on_server & known,
        "long_tool_tail": on_server & F.col("duration_ms").isNotNull(),
        "unused_mcp_server": F.array_contains(json_list(F.col("configured_mcp_servers")), subject),
    }.get(pattern, (kind == "api.request") & F.col("input_tokens").isNotNull())


def pattern_timeline(e: DataFrame, pattern: str, subject: str) -> DataFrame:
    """Per day: sessions in which the pattern could occur, and in which it did."""
    could = e.filter(F.col("session_id").isNotNull() & eligible(pattern, subject)).select("session_id", "dt").distinct()
    days = could.groupBy("dt").agg(F.count("*").alias("sessions_total"))
    did = hits(e, pattern).filter((F.col("pattern_id") == pattern) & (F.col("subject") == subject)).withColumn("dt", day_of(F.col("first_ts")))
    per = did.join(could, ["session_id", "dt"]).groupBy("dt").agg(F.count_distinct("session_id").alias("sessions_hit"), total("incidents").alias("incidents"), total("wasted_tokens_est").alias("wasted_tokens_est"))
    zero = F.lit(0).cast("long")
    out = days.join(per, "dt", "left").withColumns({"sessions_hit": F.coalesce("sessions_hit", zero), "incidents": F.coalesce("incidents", zero)})
    return out.withColumn("rate_pct", rate(F.col("sessions_hit") * F.lit(100.0), F.col("sessions_total"))).orderBy("dt")


def compare_change(e: DataFrame, pattern: str, subject: str, mark: str, today: str, span: int = 14, collecting: bool = True) -> DataFrame:
    """Hit rates in equal spans of days before and after a change; neither the day of the change nor today counts.

    collection_unverified: the collector isn't known to run. waiting: nothing after it yet. insufficient: under 5 sessions
    or under 2 days on a side. Then no_recurrence, lower or recurring.
    """
    n = F.least(F.lit(span), F.datediff(F.lit(today).cast("date"), F.lit(mark).cast("date")) - 1)
    days = pattern_timeline(e, pattern, subject).withColumn("at", F.datediff(F.col("dt").cast("date"), F.lit(mark).cast("date"))).withColumn("n", n)
    sides = {"before": (F.col("at") < 0) & (F.col("at") >= -F.col("n")), "after": (F.col("at") > 0) & (F.col("at") <= F.col("n"))}
    zero = F.lit(0).cast("long")
    sums = []
    for side, inside in sides.items():
        for name, column in (("sessions", "sessions_total"), ("hits", "sessions_hit"), ("incidents", "incidents")):
            sums.append(F.coalesce(F.sum(F.when(inside, F.col(column))), zero).alias(f"{name}_{side}"))
        sums.append(F.count_if(inside).alias(f"days_{side}"))
    out = days.agg(*sums)
    out = out.withColumns({f"rate_{side}": rate(F.col(f"hits_{side}") * 100, F.col(f"sessions_{side}")) for side in sides})
    few = (F.least("sessions_before", "sessions_after") < 5) | (F.least("days_before", "days_after") < 2)
    status = F.when(F.lit(not collecting), "collection_unverified").when(F.col("sessions_after") == 0, "waiting").when(few, "insufficient").when(F.col("hits_after") == 0, "no_recurrence")
    return out.withColumn("status", status.when(F.col("rate_after") < F.col("rate_before"), "lower").otherwise("recurring"))
