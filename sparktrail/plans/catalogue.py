"""The query catalogue: a name, a function of (spark, sf_dir), and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrail.functions.scalars import token_estimate
from sparktrail.operators import patterns, pricing, session_detail, usage

from . import derived, written
from .event_log import SILENT_BEFORE_MS, TODAY, event_log
from .oracle import FETCHED, ORACLE, PLAN_PRICES, PRICES, SERVERS

#: Days that a query covers by default; all days for the others.
DAYS = {"overview": 14, "web_tools": 14, "web_mcp": 14, "web_skills": 14, "s3_unused_mcp": 14, "web_unused_mcp": 14, "sessions": 14, "models": 14, "models_daily": 14, "billing_routes": 14, "subscription_models": 14, "patterns_rank": 30, "pattern_hits": 30, "pattern_timeline": 60, "compare_change": 60}

_OVER_EVENTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "event_log": lambda e: e,
    "today": lambda e: usage.today(e, TODAY),
    "tools": usage.tools,
    "mcp": usage.mcp,
    "skills": usage.skills,
    "web_tools": usage.web_tools,
    "web_mcp": usage.web_mcp,
    "web_skills": usage.skills,
    "reach": usage.reach,
    "bypass": patterns.bypass,
    "thrash": patterns.thrash,
    "unused_mcp": lambda e: usage.unused_mcp(e, SERVERS),
    "web_unused_mcp": lambda e: usage.web_unused_mcp(e, SERVERS),
    "s3_unused_mcp": usage.s3_unused_mcp,
    "unused_skills": usage.unused_skills,
    "schema_tax": usage.schema_tax,
    "mcp_tax": usage.mcp_tax,
    "coverage": lambda e: usage.coverage(usage.since(e, TODAY, 30), e, SILENT_BEFORE_MS),
    "coverage_summary": lambda e: usage.coverage_summary(usage.coverage(usage.since(e, TODAY, 30), e, SILENT_BEFORE_MS)),
    "overview": usage.overview,
    "machines": lambda e: usage.machines(e, TODAY),
    "filter_options": usage.filter_options,
    "sessions": usage.sessions,
    "subagents": usage.subagents,
    "models": usage.models,
    "models_daily": usage.models_daily,
    "patterns": patterns.patterns,
    "patterns_rank": patterns.patterns_rank,
    "pattern_hits": lambda e: patterns.pattern_hits(e, "mcp_bypass", "github"),
    "pattern_timeline": lambda e: patterns.pattern_timeline(e, "mcp_bypass", "github"),
    "compare_change": lambda e: patterns.compare_change(e, "mcp_bypass", "github", "2024-01-15", TODAY),
}


def _prices(e: DataFrame) -> DataFrame:
    return pricing.price_table(e.sparkSession, PRICES)


def _periods(e: DataFrame) -> DataFrame:
    """Plans as the effort of an account's last request of the day would name them; a stand-in for observed plans."""
    seen = e.filter("event_type = 'api.request' and user_id is not null").groupBy(F.col("user_id").alias("account"), F.col("dt").alias("day")).agg(F.max_by("effort", F.struct("ts", "event_id")).alias("x"))
    plan, price = F.lit("unknown"), F.lit(None).cast("double")
    for key, (name, usd) in PLAN_PRICES.items():
        plan, price = F.when(F.col("x") == key, name).otherwise(plan), F.when(F.col("x") == key, usd).otherwise(price)
    return pricing.plan_history(seen.select("account", "day", plan.alias("plan"), price.alias("price")))


def _usage(e: DataFrame) -> DataFrame:
    return usage.grouped_usage(usage.preferred_usage(e))


_OVER_EVENTS |= {
    "cost_historical": lambda e: pricing.cost_historical(_usage(e), _prices(e), FETCHED),
    "cost_estimate": lambda e: pricing.cost_estimate(_usage(e), _prices(e), FETCHED),
    "cost_summary": lambda e: pricing.cost_summary(_usage(e), _prices(e), FETCHED),
    "router_api_cost": lambda e: pricing.router_api_cost(_usage(e), _prices(e), FETCHED),
    "plan_history": _periods,
    "period_fee": lambda e: pricing.period_fee(_periods(e), 14, TODAY),
    "subscription_comparison": lambda e: pricing.subscription_comparison(pricing.period_fee(_periods(e), 14, TODAY), pricing.cost_summary(_usage(e), _prices(e), FETCHED)),
}
DAYS |= dict.fromkeys(["cost_historical", "cost_estimate", "cost_summary", "router_api_cost"], 14)


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", token_estimate(F.col("text")).alias("tokens"))


def _branch(name: str) -> Callable[[DataFrame], DataFrame]:
    def run(e: DataFrame) -> DataFrame:
        kind = {"context_jump": "jump", "compaction": "compaction"}.get(name)
        found = patterns.hits(e, "context_bloat" if kind else name)
        return found.filter(F.get_json_object("detail", "$.kind") == kind) if kind else found

    return run


_OVER_EVENTS |= {f"pattern_{name}": _branch(name) for name in patterns.BRANCHES}


_OVER_EVENTS |= derived.OVER_EVENTS | written.OVER_EVENTS
DAYS |= derived.DAYS


def _busiest(e: DataFrame) -> str:
    return e.filter("session_id is not null").groupBy("session_id").count().orderBy(F.desc("count"), "session_id").first()["session_id"]


def _timeline(e: DataFrame) -> DataFrame:
    span = e.agg((F.max("ts") - F.min("ts")).alias("ms")).first()["ms"]
    return session_detail.timeline(e, session_detail.bucket_ms(span or 0))


_OVER_SESSION: dict[str, Callable[[DataFrame], DataFrame]] = {
    "session_summary": session_detail.summary,
    "session_tools": session_detail.tools,
    "session_subagents": session_detail.subagents,
    "session_models": usage.models,
    "session_timeline": _timeline,
    "session_events": session_detail.events,
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = event_log(spark, sf_dir)
        if name in _OVER_SESSION:
            return _OVER_SESSION[name](session_detail.one(e, _busiest(e)))
        return _OVER_EVENTS[name](usage.since(e, TODAY, DAYS[name]) if name in DAYS else e)

    return run


QUERIES = {name: _query(name) for name in (*_OVER_EVENTS, *_OVER_SESSION)} | {"token_estimates": token_estimates}
ORACLE_SQL = ORACLE | derived.SQL | written.SQL
