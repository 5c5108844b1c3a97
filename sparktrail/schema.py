"""The event schema: fixed, additive only, unknown values null. Order and types are the contract (fixed values)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the columns in order, and those that aren't text
COLUMNS = (
    "event_id ts dt org_id team_id user_id user_id_source host_id env_kind os agent agent_version session_id parent_session_id turn_id cwd_hash repo source "
    "correlation_key correlation_confidence event_type tool_name tool_kind mcp_server mcp_tool skill_name duration_ms success error_type decision decision_source "
    "provider model effort thinking input_tokens output_tokens cache_read_tokens cache_write_tokens reasoning_tokens cost_usd usage_source tool_input_json "
    "tool_output_excerpt prompt_text redaction_applied configured_mcp_servers agent_id agent_type query_source configured_skills client estimated_input_tokens "
    "estimated_output_tokens token_estimation_method billing_route"
).split()
LONGS = {"ts", "duration_ms", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "estimated_input_tokens", "estimated_output_tokens"}
FLAGS = {"success", "thinking", "redaction_applied"}
REQUIRED = ["event_id", "ts", "dt", "host_id", "agent", "source", "event_type"]
#: Columns that hold texts of prompts and tools; they never leave the machine.
BODIES = ["tool_input_json", "tool_output_excerpt", "prompt_text"]


def type_of(column: str) -> T.DataType:
    return T.LongType() if column in LONGS else T.BooleanType() if column in FLAGS else T.DoubleType() if column == "cost_usd" else T.StringType()


EVENT_SCHEMA = T.StructType([T.StructField(c, type_of(c), True) for c in COLUMNS])


def empty_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENT_SCHEMA)


def conform(df: DataFrame, **values: Column) -> DataFrame:
    """All columns of the schema in order, missing ones null, extra ones dropped."""
    have = {f.name for f in df.schema}
    return df.select(*(values.get(c, F.col(c) if c in have else F.lit(None)).cast(type_of(c)).alias(c) for c in COLUMNS))


def required(df: DataFrame) -> DataFrame:
    """Rows as they are; a null in a required column is an error that names it."""
    checks = {c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"event without {c}")).cast(type_of(c))).otherwise(F.col(c)) for c in REQUIRED}
    return df.withColumns(checks)
