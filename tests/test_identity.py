"""One identity over all days, and what ad hoc queries may read."""

import pytest
from pyspark.sql import functions as F

from sparktrail.schema import conform, required
from sparktrail.sources import events as tables
from sparktrail.sources.identity import IdIndex
from sparktrail.streaming import ingest

DAY = 86_400_000


def rows(spark, *some):
    """(event_id, ts, tool_name)"""
    df = spark.createDataFrame(list(some), "event_id string, ts long, tool_name string")
    return required(conform(tables.day_column(df), host_id=F.lit("h"), agent=F.lit("a"), source=F.lit("hook"), event_type=F.lit("turn")))


def test_a_contradiction_on_another_day_is_an_error(spark, tmp_path):
    folder = str(tmp_path / "events")
    write = ingest.writer(folder, lambda x: x)
    write(rows(spark, ("e1", 0, "x"), ("e2", 5, "x")), 0)
    write(rows(spark, ("e3", 9 * DAY, "x"), ("e1", 0, "x")), 1)  # a replay beside something new
    with pytest.raises(tables.Conflict, match="e1 differs in ts, dt$"):
        write(rows(spark, ("e1", DAY, "x")), 2)
    with pytest.raises(tables.Conflict, match="e3 differs in ts, dt, tool_name$"):
        write(rows(spark, ("e4", 20 * DAY, "x"), ("e3", 2 * DAY, "y")), 3)
    with pytest.raises(tables.Conflict, match="e2 differs in tool_name$"):
        write(rows(spark, ("e2", 5, "y")), 4)
    stored = tables.read_events(spark, folder)
    assert sorted((r["event_id"], r["ts"]) for r in stored.collect()) == [("e1", 0), ("e2", 5), ("e3", 9 * DAY)]
    index = IdIndex(spark, f"{folder}_ids")
    assert sorted(r["event_id"] for r in index.read().collect()) == ["e1", "e2", "e3"]


def test_tables_without_an_index_get_one_and_broken_batches_complete_it(spark, tmp_path):
    folder = str(tmp_path / "events")
    tables.write_events(rows(spark, ("old", 0, "x")), folder)
    write = ingest.writer(folder, lambda x: x)
    with pytest.raises(tables.Conflict, match="old differs"):
        write(rows(spark, ("old", 3 * DAY, "x")), 0)
    # a batch whose events were written before its ids could be: it comes again
    tables.write_events(rows(spark, ("n1", DAY, "x")), folder)
    write(rows(spark, ("n1", DAY, "x"), ("n2", DAY, "x")), 1)
    assert tables.read_events(spark, folder).count() == 3
    with pytest.raises(tables.Conflict, match="n1 differs"):
        write(rows(spark, ("n1", 2 * DAY, "x")), 2)


def test_look_ups_read_only_the_directories_of_their_ids(spark, tmp_path):
    index = IdIndex(spark, str(tmp_path / "ids"), buckets=8)
    many = rows(spark, *((f"id{k}", k * DAY // 7, "x") for k in range(300)))
    assert index.found(many).count() == 0 and index.read() is None
    index.add(many.filter("event_id < 'id2'"))
    index.add(many)  # only what is missing
    assert index.read().count() == 300 == index.read().select("event_id").distinct().count()
    some = many.filter("event_id in ('id7', 'id250')").unionByName(rows(spark, ("unknown", 1, "x")))
    got = {r["event_id"]: r["dt"] for r in index.found(some).collect()}
    assert got == {r["event_id"]: r["dt"] for r in many.filter("event_id in ('id7', 'id250')").collect()}
    plan = index.found(some)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:200]
    small = index.compacted(str(tmp_path / "small"))
    assert small.read().exceptAll(index.read()).count() == 0 == index.read().exceptAll(small.read()).count()
    index.rebuild(many.filter("event_id = 'id1'"))
    assert index.read().count() == 1


def test_queries_reach_nothing_but_their_views(spark, tmp_path):
    path = str(tmp_path / "secret")
    spark.range(3).write.parquet(path)
    spark.range(4).createOrReplaceTempView("elsewhere")
    view = spark.range(5).withColumn("x", F.lit("elsewhere"))
    run = lambda text: ingest.run_query(spark, text, mine=view)
    assert run("SELECT count(*) AS n FROM mine WHERE x = 'elsewhere'").first()["n"] == 5
    assert run("WITH a AS (SELECT id FROM mine), b AS (SELECT id FROM a WHERE id > 1) SELECT * FROM b WHERE id IN (SELECT max(id) FROM Mine)").count() == 1
    assert run("VALUES (1), (2)").count() == 2 and run("SELECT m.id FROM mine m JOIN mine n ON m.id = n.id + 1").count() == 4
    refused = [
        f"SELECT * FROM parquet.`{path}`", "SELECT * FROM elsewhere", "SELECT * FROM mine WHERE id IN (SELECT id FROM elsewhere)", "SELECT (SELECT max(id) FROM elsewhere) AS x FROM mine",
        "WITH a AS (SELECT * FROM elsewhere) SELECT * FROM a", f"WITH a AS (SELECT 1) SELECT * FROM a, parquet.`{path}`", "SELECT reflect('java.lang.System', 'getProperty', 'user.dir')", "SELECT `Java_Method` ('a', 'b')",
        "SELECT try_reflect('a', 'b')", "WITH a AS (SELECT 1) INSERT INTO mine SELECT * FROM a", "DROP VIEW mine", "SELECT 1; SELECT 2", "SELECT * FROM default.mine", "SELECT * FROM mine EXCEPT SELECT id, x FROM (SELECT id, 'a' AS x FROM elsewhere)",
    ]
    for text in refused:
        with pytest.raises(ValueError):
            run(text)
