import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sparktrail.llm import queries
from sparktrail.llm.periodic import find_runs, periodic_runs, regions, without_runs
from sparktrail.llm.text import utf8, word_hashes, words

from .corpus import documents, frame


def brute(ids, least=24, times=3):
    n, found = len(ids), {}
    for p in range(1, n // times + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and ids[j] == ids[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, times * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def periodic(rng, most=160):
    kinds = rng.choice([1, 2, 3, 8])
    ids = [rng.randrange(kinds) for _ in range(rng.randrange(most))]
    for _ in range(rng.randrange(3)):
        at, p = rng.randrange(len(ids) + 1), rng.randrange(1, 25)
        ids[at:at] = [rng.randrange(kinds) for _ in range(p)] * rng.randrange(2, 7)
    return ids


@pytest.mark.parametrize("least, times", [(24, 3), (6, 2), (26, 3), (24, 2), (10, 4), (1, 3)])
def test_runs_are_those_of_brute_force(least, times):
    rng = random.Random(least * 10 + times)
    for _ in range(250):
        ids = periodic(rng)
        assert find_runs(ids, least, times) == brute(ids, least, times), ids


@pytest.mark.parametrize("least, times", [(24, 3), (26, 3), (24, 2), (30, 4)])
def test_every_run_lies_in_a_region(least, times):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(least)
    for _ in range(150):
        rows = [[str(x) for x in periodic(rng, 60)] for _ in range(3)]
        raw, off = utf8(pa.array([" ".join(x) for x in rows]))
        start, end, first = words(raw, off)
        row = np.repeat(np.arange(3), np.diff(first))
        inside = set()
        for a, b in regions(word_hashes(raw, start, end), row, least, times):
            assert row[a] == row[b - 1]
            inside.update((int(row[a]), int(k - first[row[a]])) for k in range(a, b))
        for k, x in enumerate(rows):
            for s, n, _ in brute(x, least, times):
                assert {(k, i) for i in range(s, s + n)} <= inside


def expected(doc_id, text):
    """The contract, word by word."""
    some = (text or "").encode().split()
    n = len(some)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        some = [some[i] if i < a else some[a + (i - a) % p] for i in range(n)]
    runs = brute(some)
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    left = b" ".join(x for i, x in enumerate(some) if i not in gone)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (doc_id, len(runs), *top, runs and 1000 * top[1] // top[2] or None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def test_query_is_the_contract(spark, tmp_path):
    rng = random.Random(5)
    rows = documents(80)
    for i in range(1000, 1120):
        text = " ".join(f"k{x}" for x in periodic(rng, 300))
        rows.append((i, text, "en", "a", len(text)))
    rows.append((2000, "la la la " * 4000, "en", "a", 1))
    path = str(tmp_path / "documents.parquet")
    frame(spark, rows, extra=True).withColumns({c: F.lit("clash") for c in ("runs", "top", "collapsed", "n_words", "start")}).write.parquet(path)
    got = queries.queries()["op13_periodic"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is None, x) for x in r)
    want = [expected(r[0], r[1]) for r in rows]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert sum(r[1] > 0 for r in want) > 60


def test_texts_are_cut_to_first_periods(spark):
    rows = [(1, "a b  c\n" * 10 + "end", "en", "s", 75), (2, "plain  text", "en", "s", 11), (None, None, None, None, None), (3, "", "en", "s", 0), (2, "plain  text", "en", "s", 11)]
    docs = frame(spark, rows, extra=True).withColumns({c: F.lit("clash") for c in ("runs", "top", "collapsed", "document")})
    out = without_runs(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    got = sorted(out.select("doc_id", "text", "n_chars", "runs", "row").collect(), key=str)
    assert sorted([(1, "a b c end", 9), (2, "plain  text", 11), (2, "plain  text", 11), (3, "", 0), (None, None, None)], key=str) == [tuple(r)[:3] for r in got]
    assert {tuple(r)[3:] for r in got} == {("clash", "clash")}
    assert periodic_runs(docs.filter("false")).collect() == [] and without_runs(docs.filter("false")).collect() == []
