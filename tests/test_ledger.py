"""Versions of a ledger: pages count whole or not at all, and readers keep what they began with."""

import random

import pytest

from sparktrail.sources.events import Conflict
from sparktrail.sources.ledger import Ledger


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, str(tmp_path / "ledger"))


def page(spark, *rows):
    """(sequence, event_id, deleted, payload)"""
    return spark.createDataFrame(list(rows), "sequence long, event_id string, deleted boolean, payload string")


def held(ledger, at=None):
    return {(r["scope"], r["event_id"]): r["payload"] for r in ledger.rows(at).collect()}


def test_pages_and_cursors(spark, ledger):
    assert held(ledger) == {} and ledger.latest().number == 0
    ledger.apply_page("r", 0, 7, page(spark, (2, "a", False, "1"), (5, "b", False, "2"), (6, "a", False, "3")))
    assert held(ledger) == {("r", "a"): "3", ("r", "b"): "2"} and ledger.latest().cursors == {"r": 7}
    for start, through, rows in ((0, 9, ()), (6, 9, ()), (7, 6, ()), (7, 9, [(7, "c", False, "x")]), (7, 9, [(10, "c", False, "x")]), (7, 9, [(8, "c", False, "x"), (8, "d", False, "x")])):
        with pytest.raises(Conflict):
            ledger.apply_page("r", start, through, page(spark, *rows))
    for scope in ("", "local"):
        with pytest.raises(ValueError):
            ledger.apply_page(scope, 0, 1, page(spark))
    assert ledger.latest().number == 1
    ledger.apply_page("r", 7, 20, page(spark))  # nothing new up to 20
    ledger.apply_page("r", 20, 22, page(spark, (21, "a", True, None), (22, "a", False, "again")))
    ledger.apply_page("s", 0, 1, page(spark, (1, "a", False, "of s")))
    assert held(ledger) == {("r", "b"): "2", ("s", "a"): "of s"} and ledger.latest().cursors == {"r": 22, "s": 1}
    assert [tuple(r) for r in ledger.tombstones().collect()] == [("r", "a")]


def test_readers_see_all_of_a_page_or_nothing(spark, ledger):
    ledger.apply_page("r", 0, 2, page(spark, (1, "a", False, "1"), (2, "b", False, "1")))
    pinned = ledger.latest()
    rows = ledger.rows()  # not read yet
    ledger._write(page(spark, (3, "c", False, "half")).selectExpr("*", "'r' AS scope"), 2)  # a writer that was lost before its commit
    assert held(ledger) == {("r", "a"): "1", ("r", "b"): "1"}
    ledger.apply_page("r", 2, 4, page(spark, (3, "a", False, "2"), (4, "b", True, None)))
    assert sorted(r["payload"] for r in rows.collect()) == ["1", "1"]
    assert held(ledger, pinned) == {("r", "a"): "1", ("r", "b"): "1"} and held(ledger) == {("r", "a"): "2"}
    ledger.compact()
    assert held(ledger) == {("r", "a"): "2"} and len(ledger.latest().folders) == 1 and held(ledger, pinned) == {("r", "a"): "1", ("r", "b"): "1"}
    ledger.apply_page("r", 4, 5, page(spark, (5, "b", False, "back")))
    assert ("r", "b") not in held(ledger)  # a tombstone stays one after compaction


def test_of_two_writers_from_one_cursor_only_one_commits(spark, ledger, monkeypatch):
    ledger.apply_page("r", 0, 1, page(spark, (1, "a", False, "1")))
    other = Ledger(spark, ledger.folder)
    stale = ledger.latest()
    ledger.apply_page("r", 1, 2, page(spark, (2, "a", False, "mine")))
    monkeypatch.setattr(other, "latest", lambda: stale)  # it looked before
    with pytest.raises(Conflict, match="another writer"):
        other.apply_page("r", 1, 2, page(spark, (2, "a", False, "theirs")))
    assert held(ledger) == {("r", "a"): "mine"}


def test_local_records(spark, ledger):
    rows = lambda *some: spark.createDataFrame(list(some), "event_id string, payload string")
    ledger.record(rows(("a", "1"), ("b", "2"), ("a", "1")))
    ledger.record(rows(("a", "1"), ("c", "3")))
    for bad in (rows(("b", "other")), rows(("d", "1"), ("d", "2"))):
        with pytest.raises(Conflict):
            ledger.record(bad)
    assert held(ledger) == {("local", x): p for x, p in (("a", "1"), ("b", "2"), ("c", "3"))}
    assert ledger.changes().count() == 3


def test_any_run_of_pages_is_a_dictionary_with_deletions(spark, ledger):
    rng, want, dead, at = random.Random(5), {}, set(), 0
    for k in range(6):
        rows = []
        for s in range(at + 1, at + 1 + rng.randrange(6)):
            i, gone = rng.choice("abcdef"), rng.random() < 0.15
            rows.append((s, i, gone, None if gone else str(s)))
            if gone:
                dead.add(i)
                want.pop(i, None)
            elif i not in dead:
                want[i] = str(s)
        ledger.apply_page("r", at, at + 6, page(spark, *rows))
        at += 6
        if k == 3:
            ledger.compact()
    assert held(ledger) == {("r", i): p for i, p in want.items()}


def test_a_history_is_imported_once(spark, ledger):
    rows = lambda *some: spark.createDataFrame(list(some), "event_id string, payload string")
    ledger.record(rows(("a", "observed")))
    with pytest.raises(Conflict, match="no id"):
        ledger.import_history(rows(("", "x")), "parquet")
    ledger.import_history(rows(("a", "old"), ("b", "2"), ("b", "1")), "parquet")
    want = {("local", "a"): "observed", ("local", "b"): "1"}
    assert held(ledger) == want
    number = ledger.latest().number
    ledger.import_history(rows(("c", "later")), "parquet")
    assert held(ledger) == want and ledger.latest().number == number
    ledger.compact()
    ledger.import_history(rows(("c", "3")), "another")
    assert held(ledger) == want | {("local", "c"): "3"}


def test_exports_count_what_they_wrote(spark, tmp_path):
    from pyspark.sql import functions as F

    from sparktrail.schema import conform
    from sparktrail.sources import events

    days = spark.createDataFrame([(f"e{k}", f"2024-01-{k + 1:02}") for k in range(9)], "event_id string, dt string")
    events.write_events(conform(days, ts=F.lit(0)), str(tmp_path / "events"))
    assert events.write_export(spark, str(tmp_path / "events"), str(tmp_path / "out"), "2024-01-03", "2024-01-05") == (3, 56)
    assert events.write_export(spark, str(tmp_path / "events"), str(tmp_path / "none"), "2025-01-03", "2025-01-05") == (0, 56)
    with pytest.raises(ValueError):
        events.write_export(spark, str(tmp_path / "events"), str(tmp_path / "x"), "2024-01-05", "2024-01-03")
