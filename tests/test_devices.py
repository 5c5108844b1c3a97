"""Two devices' histories: boundaries, turns near in time, and what is an error."""

import pytest
from pyspark.sql import functions as F

from sparktrail.operators import devices, resolution
from sparktrail.schema import EVENT_SCHEMA


def rows(spark, *some):
    base = {"dt": "x", "host_id": "h", "agent": "claude-code", "session_id": "s"}
    return spark.createDataFrame([tuple((base | r).get(c) for c in EVENT_SCHEMA.names) for r in some], EVENT_SCHEMA)


def row(i, source, kind, ts, **more):
    return {"event_id": i, "source": source, "event_type": kind, "ts": ts, **more}


def pairs(df):
    return {(r["left_id"], r["right_id"]): r["rule"] for r in df.collect()}


def test_boundaries_are_the_outermost_live_ones(spark):
    file = rows(spark, row("a", "log", "session.start", 100), row("z", "log", "session.end", 900), row("y", "log", "session.end", 901, session_id="t"))
    live = rows(spark, row("s1", "hook", "session.start", 500), row("s2", "hook", "session.start", 90), row("e1", "hook", "session.end", 300), row("e2", "hook", "session.end", 950), row("e3", "hook", "session.end", 900, session_id="t"))
    assert pairs(devices.reconcile(file, live)) == dict.fromkeys([("a", "s2"), ("z", "e2")], devices.BOUNDARY)  # t's last end doesn't cover the file's


def test_turns_that_are_alone_near_each_other(spark):
    file = rows(spark, row("t1", "log", "turn", 1000), row("t2", "log", "turn", 1150), row("t3", "log", "turn", 5000))
    live = rows(spark, row("o1", "otel", "turn", 1049), row("o2", "otel", "turn", 1251 - 1), row("o4", "otel", "turn", 9000))
    with pytest.raises(Exception, match="unresolved turn in session s"):  # o1 is near t1 and t2
        devices.reconcile(file, live.withColumn("ts", F.when(F.col("event_id") == "o1", 1060).otherwise(F.col("ts"))), match_prompt_times=True).collect()
    assert pairs(devices.reconcile(file, live, match_prompt_times=True)) == dict.fromkeys([("t1", "o1"), ("t2", "o2")], devices.TURN)
    with pytest.raises(Exception, match="unresolved turn"):  # times aren't trusted unless it is said
        devices.reconcile(file, live).collect()
    assert pairs(devices.reconcile(file.filter("event_id = 't3'"), live)) == {}


def test_ambiguity_and_contradictions_are_errors(spark):
    api = lambda i, source, **more: row(i, source, "api.request", 7, model="m", input_tokens=1, output_tokens=2, **more)
    with pytest.raises(Exception, match="ambiguous unique model and usage"):
        devices.reconcile(rows(spark, api("a", "log")), rows(spark, api("x", "otel"), api("y", "otel"))).collect()
    with pytest.raises(Exception, match="ambiguous same operation id"):
        call = {"event_type": "tool.call", "correlation_key": "k", "ts": 3}
        devices.reconcile(rows(spark, {"event_id": "a", "source": "log", **call}, {"event_id": "b", "source": "log", **call, "ts": 4}), rows(spark, {"event_id": "x", "source": "hook", **call})).collect()
    with pytest.raises(Exception, match="conflicting reasoning tokens"):
        devices.reconcile(rows(spark, api("a", "log", reasoning_tokens=5)), rows(spark, api("x", "otel", reasoning_tokens=6))).collect()
    assert pairs(devices.reconcile(rows(spark, api("a", "log", reasoning_tokens=5)), rows(spark, api("x", "otel")))) == {("a", "x"): "unique model and usage"}
    with pytest.raises(Exception, match="two proposed counterparts"):
        devices.reconcile(rows(spark, row("a", "log", "session.start", 1), row("b", "log", "session.start", 2)), rows(spark, row("x", "hook", "session.start", 3))).collect()
    none = rows(spark)
    assert pairs(devices.reconcile(none, none)) == {}


def test_equal_observations_keep_their_number(spark):
    same = [row(f"l{k}", "log", "compaction", 5) for k in range(3)]
    old = [row(f"r{k}", "log", "compaction", 5, host_id="other", user_id="u") for k in range(2)]
    assert sorted(pairs(devices.reconcile(rows(spark, *same), rows(spark, *old)))) == [("l0", "r0"), ("l1", "r1")]


def test_deliveries_that_a_counterpart_covers(spark):
    from sparktrail.operators import resolution

    table = lambda kind, *some: spark.createDataFrame(list(some), kind)
    outbox = table("destination string, event_id string", ("d", "l1"), ("d", "l2"), ("d", "l3"), ("d", "l4"), ("other", "l1"))
    aliases = table("scope string, destination string, local_id string, remote_id string", ("r", "d", "l1", "r1"), ("r", "d", "l2", "r2"), ("r", "d", "l3", "r3"), ("s", "d", "l4", "r1"))
    ledger = table("scope string, event_id string", ("r", "r1"), ("local", "r3"))
    stones = table("scope string, event_id string", ("r", "r2"))
    assert sorted(map(tuple, resolution.covered_deliveries(outbox, aliases, ledger, stones).collect())) == [("d", "l1"), ("d", "l2")]


def test_origins_of_remote_requests(spark):
    from sparktrail.operators import resolution

    api = lambda i, **more: row(i, "otel", "api.request", 1, **more)
    local = rows(spark, api("l1", provider="router", billing_route="router"), api("l2"), api("l3", session_id="t"), api("l4"), api("both"), row("l6", "log", "turn", 1))
    remote = rows(spark, api("r1"), api("r2"), api("r3"), api("both"), api("r6"))
    aliases = spark.createDataFrame([("l1", "r1"), ("l2", "r2"), ("l4", "r2"), ("l3", "r3"), ("l1", "both"), ("l6", "r6"), ("l1", "r1")], "local_id string, remote_id string")
    got = [tuple(r) for r in resolution.origins(local, remote, aliases).collect()]
    assert got == [("r1", "l1", "h", "router", "router")]  # two for r2, another session for r3, a local id, no request


def test_nothing_that_grows_with_the_log_goes_through_the_driver(spark, monkeypatch):
    # read from files, whose small size Spark knows and would broadcast
    file = devices.stored(rows(spark, row("a", "log", "session.start", 100), row("t", "log", "turn", 1000), row("c", "log", "compaction", 5)))
    live = devices.stored(rows(spark, row("s", "hook", "session.start", 90), row("o", "otel", "turn", 1049), row("d", "log", "compaction", 5)))
    monkeypatch.setattr(resolution, "stored", lambda df: df)  # so that one plan shows all joins
    rules = [("same time", [F.col("ts")], False), ("same repo", [F.col("repo")], False)]
    for found in (resolution.link_devices(file, live, rules), devices.boundaries(file, live), devices.near_turns(file, live)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert pairs(resolution.link_devices(file, live, rules)) == {("c", "d"): "same time"}
    long = file.withColumn("repo", F.repeat(F.lit("x"), 5000))
    assert [len(r["k"]) for r in resolution._keyed(long, [F.col("repo")]).collect()] == [32] * 3  # however long a row is as text
