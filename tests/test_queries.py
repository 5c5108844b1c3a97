"""The catalogue against DuckDB, and hand-computed answers on small logs."""

import math
import os

import duckdb
import pytest

from sparktrail import session
from sparktrail.operators import patterns, pricing, session_detail, usage
from sparktrail.plans import derived
from sparktrail.plans.catalogue import ORACLE_SQL, QUERIES
from sparktrail.schema import EVENT_SCHEMA, conform

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return None if v is None else v if isinstance(v, bool | int) else "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are needed")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.sql(ORACLE_SQL[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert ours == sorted((tuple(plain(r[k]) for k in at) for r in result.fetchall()), key=repr)


def log(spark, rows):
    """Events from dicts; ids, days and hosts are filled in."""
    full = []
    for k, r in enumerate(rows):
        r = {"event_id": f"e{k}", "ts": k * 1000, "dt": "1970-01-01", "host_id": "h", "agent": "claude-code", "source": "hook", "session_id": "s"} | r
        full.append(tuple(r.get(c) for c in EVENT_SCHEMA.names))
    return spark.createDataFrame(full, EVENT_SCHEMA)


def result(tool, ok, **more):
    return {"event_type": "tool.result", "tool_name": tool, "success": ok, **more}


def test_a_failure_seen_twice_counts_once(spark):
    e = log(spark, [result("Bash", False, correlation_key="a"), result("Bash", False, correlation_key="a", source="otel", duration_ms=250)])
    row = usage.tools(e).first()
    assert (row["failures"], row["p50_duration_ms"], row["calls"]) == (1, 250, 0)


def test_server_tax(spark):
    rows = []
    for s, servers, n, first, used in (("a", '["gh","jira"]', 2, 1000, "gh"), ("b", '["gh"]', 1, 400, None), ("c", '["jira"]', 3, 900, "jira"), ("d", '["gh"]', 0, 0, None)):
        rows.append({"session_id": s, "event_type": "session.start", "configured_mcp_servers": servers})
        rows += [{"session_id": s, "event_type": "api.request", "source": "otel", "input_tokens": first} for _ in range(n)]
        if used:
            rows.append({"session_id": s, "event_type": "tool.call", "mcp_server": used})
    e = log(spark, rows)
    got = {r["mcp_server"]: tuple(r[c] for c in ("sessions_configured", "sessions_used", "sessions_unused", "sessions_with_usage", "fixed_tokens_est", "unused_tokens_est", "marginal_first_tokens_est")) for r in usage.mcp_tax(e).collect()}
    assert got["gh"] == (3, 1, 2, 2, 1400, 400, -200)
    assert got["jira"][4:] == (3700, 1000, 550)
    waste = {(r["session_id"], r["subject"]): r["wasted_tokens_est"] for r in patterns.hits(e, "unused_mcp_server").collect()}
    assert waste == {("a", "jira"): 1000, ("b", "gh"): 400, ("d", "gh"): None}


def test_retry_spirals_need_three_in_a_row(spark):
    seq = [False, False, True, False, False, None, False, False]
    found = patterns.hits(log(spark, [result("Edit", ok) for ok in seq]), "retry_spiral").collect()
    assert [(r["incidents"], r["wasted_tokens_est"]) for r in found] == [(4, None)]
    assert not patterns.hits(log(spark, [result("Edit", ok) for ok in (False, False, True, False, False)]), "retry_spiral").count()


def test_bypass_within_five_events_and_its_cost(spark):
    api = {"event_type": "api.request", "source": "otel", "input_tokens": 700, "output_tokens": 100}
    call = {"event_type": "tool.call", "tool_name": "Bash", "tool_kind": "bash"}
    fail = result("mcp__gh__x", False, tool_kind="mcp", mcp_server="gh")
    turn = {"event_type": "turn"}
    e = log(spark, [fail, api, api, call, turn, turn, call])
    assert [r["wasted_tokens_est"] for r in patterns.hits(e, "mcp_bypass").collect()] == [1600]
    assert patterns.bypass(e).count() == 1


def test_denials_jumps_slow_tools(spark):
    deny = {"event_type": "tool.denied", "tool_name": "Bash"}
    assert [r["incidents"] for r in patterns.hits(log(spark, [deny, deny, deny | {"tool_name": "Edit"}, deny]), "permission_denied_loop").collect()] == [2]
    api = lambda n, **more: {"event_type": "api.request", "source": "log", "input_tokens": n, **more}
    jump = log(spark, [api(10_000), result("Read", True), api(60_000), api(55_000)])
    row = patterns.hits(jump, "context_bloat").first()
    assert row["subject"] == "Read" and '"delta_tokens":50000' in row["detail"]
    streams = log(spark, [api(10_000), api(60_000, agent_id="x"), api(12_000), api(61_000, agent_id="x")])
    assert not patterns.hits(streams, "context_bloat").count()
    slow = log(spark, [result("t", True, tool_kind="mcp", mcp_server="m", duration_ms=d) for d in (1000, 1000, 30_000)])
    assert [r["last_ts"] - r["first_ts"] for r in patterns.hits(slow, "long_tool_tail").collect()] == [30_000]


def test_durations_unknown_zero_mixed(spark):
    stop = lambda s, a, d: {"session_id": s, "agent_id": a, "event_type": "subagent.stop", "duration_ms": d}
    e = log(spark, [stop("u", "1", None), stop("z", "1", 0), stop("m", "1", 5), stop("m", "2", None)])
    got = {r["session_id"]: r["subagent_duration_ms"] for r in usage.subagents(e, with_total=False).collect()}
    assert got == {"u": None, "z": 0, "m": None}


def test_usage_prefers_one_source_and_errors_stay_unknown(spark):
    api = {"event_type": "api.request", "model": "m", "input_tokens": 500, "output_tokens": 50}
    e = log(spark, [api | {"source": "otel"}, api | {"source": "log"}, api | {"source": "log", "session_id": "t"}, {"event_type": "api.error", "model": "x", "source": "otel"}])
    got = {r["model"]: (r["api_requests"], r["input_tokens"], r["api_errors"]) for r in usage.models(e).collect()}
    assert got == {"m": (2, 1000, 0), "x": (0, None, 1)}


def test_bucket_widths():
    assert [session_detail.bucket_ms(x) for x in (0, 240 * 60_000, 240 * 60_001 * 2, 10**12)] == [60_000, 60_000, 300_000, 86_400_000]
    with pytest.raises(ValueError):
        session_detail.one(None, "")


def test_costs(spark):
    prices = pricing.price_table(spark, [("2024-01-01", "gpt-x", "openai", [(2.0, 8.0, 0.5, None)]), ("2024-02-01", "gpt-x", "openai", [(1.0, 4.0, 0.5, None), (2.0, 4.0, 0.5, None)])])
    rows = spark.createDataFrame([("gpt-x", "2024-01-31", 1_000_000, 0, 400_000, 0), ("gpt-x-2024-05-01", "2024-02-01", 1_000_000, 0, 0, 0), ("gpt-x", "2024-02-01", 10, 0, 20, 0), ("gpt-x", "2024-02-01", 10, 0, 0, 5), ("gpt-x", "2025-01-01", 10, 0, 0, 0), ("other", "2024-02-01", 1, 1, 0, 0)], "model string, day string, input long, output long, read long, write long")
    low, high = pricing.cost_range(pricing.F.col("variants"), pricing.F.col("provider"), pricing.TOKENS)
    got = {(r["model"], r["day"], r["read"], r["write"]): (r["low"], r["high"]) for r in pricing.priced(rows, prices, "2024-02-20").withColumns({"low": low, "high": high}).collect()}
    assert got["gpt-x", "2024-01-31", 400_000, 0] == pytest.approx((1.4, 1.4))  # cached tokens are a part of the input
    assert got["gpt-x-2024-05-01", "2024-02-01", 0, 0] == pytest.approx((1.0, 2.0))
    assert got["gpt-x", "2024-02-01", 20, 0] == (None, None) == got["gpt-x", "2024-02-01", 0, 5] == got["gpt-x", "2025-01-01", 0, 0] == got["other", "2024-02-01", 0, 0]
    newer = prices.unionByName(pricing.price_table(spark, [("2024-03-01", "gpt-x", "openai", [(1.0, 1.0, None, None)])]))
    assert pricing.accepted_history(prices, newer) and not pricing.accepted_history(newer, prices)


def test_all_columns_conform(spark):
    assert conform(spark.createDataFrame([(1,)], "ts int")).schema == EVENT_SCHEMA


def test_null_sessions_are_no_session(spark):
    fail = result("mcp__gh__x", False, tool_kind="mcp", mcp_server="gh", session_id=None)
    call = {"event_type": "tool.call", "tool_name": "Bash", "tool_kind": "bash", "session_id": None}
    assert patterns.bypass(log(spark, [fail, call])).count() == 0
    api = {"event_type": "api.request", "model": "m", "input_tokens": 5, "output_tokens": 5, "session_id": None}
    assert [r["api_requests"] for r in usage.models(log(spark, [api | {"source": "otel"}, api | {"source": "log"}])).collect()] == [1]


def test_costs_of_overlapping_spans(spark):
    api = lambda n: {"event_type": "api.request", "source": "otel", "input_tokens": n, "output_tokens": 1}
    deny = {"event_type": "tool.denied", "tool_name": "Bash"}
    call = {"event_type": "tool.call", "tool_name": "Bash", "tool_kind": "bash"}
    e = log(spark, [api(900), deny, api(10), call, api(20), call, api(50), result("t", True)])
    got = sorted(r["wasted_tokens_est"] for r in patterns.hits(e, "deny_detour").collect())
    assert got == [11, 32]


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """In a copy without the subpackage and its tests."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "sparktrail", tmp_path / "sparktrail", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    for present in (True, False):
        if not present:
            (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
        code = "import __spark_entry__ as e, bench; q, s = e.queries(), e.oracle_sql(); assert 'tools' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q) and set(s) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_the_log_is_dealt_by_its_rows_not_by_the_cores(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 2, raising=False)
    dealt, stored = [], patterns.stored
    monkeypatch.setattr(patterns, "stored", lambda df: dealt.append(df.rdd.getNumPartitions()) or stored(df))
    e = log(spark, [result("Edit", False, session_id=f"s{k % 10}") for k in range(40)])
    assert [(r["sessions"], r["incidents"]) for r in patterns.patterns_rank(e).collect()] == [(10, 40)]
    assert dealt == [20]
    jumps = patterns.hits(e, "context_bloat")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(session_id#" in jumps and "REPARTITION_BY_NUM" in jumps


def test_billing_evidence_is_never_broadcast(spark):
    e = log(spark, [{"event_type": "api.request", "source": "otel", "output_tokens": k, "provider": "anthropic"} for k in range(5)])
    out = usage._with_routes(*derived._requests(e))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
