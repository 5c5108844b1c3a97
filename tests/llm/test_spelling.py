import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktrail.llm import queries, spelling
from sparktrail.llm.spelling import Trie, neighbours

from .corpus import frame


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts, ratio=5):
    """{word: (form, root, n, n_near, form_n)} by comparing all pairs."""
    forms, near = {}, {}
    for w, n in counts.items():
        some = [x for x in counts if one_apart(w, x)]
        near[w] = len(some)
        best = min(some, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None

    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w

    return {w: (forms[w], root(w), n, near[w], forms[w] and counts[forms[w]]) for w, n in counts.items()}


def vocabulary(rng, size, letters="abcé×"):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(size)})


@pytest.mark.parametrize("seed", range(6))
def test_automata_find_each_neighbour_once(seed):
    rng = random.Random(seed)
    known, asked = vocabulary(rng, 150, "abé" if seed % 2 else "abcdefgÿ"), vocabulary(rng, 60)
    trie = Trie.of([w.encode("latin-1") for w in known], np.arange(len(known)))
    again = Trie.unpacked(trie.packed())
    for name in ("keys", "word", "begin", "counts"):
        assert (getattr(trie, name) == getattr(again, name)).all()
    assert [w.decode("latin-1") for w in again.spelt(np.arange(len(known)))] == known
    for words in (known, asked):
        who, place = neighbours(again, [w.encode("latin-1") for w in words])
        got = sorted((words[i], known[j]) for i, j in zip(who, place, strict=True))
        assert got == sorted((a, b) for a in words for b in known if one_apart(a, b))


def test_edges():
    for known, asked in (([], ["a"]), ([""], ["", "a", "ab"]), (["aaaa"], ["aaa", "aaaaa", "aaaa", "aaab"]), (["a" * 3000], ["a" * 3001, "a" * 1500 + "b" + "a" * 1499])):
        trie = Trie.of([w.encode() for w in known], np.ones(len(known)))
        who, place = neighbours(trie, [w.encode() for w in asked])
        assert sorted(zip(who, place, strict=True)) == sorted((i, j) for i, a in enumerate(asked) for j, b in enumerate(known) if one_apart(a, b))


@pytest.mark.parametrize("limits", [{}, {"shard_words": 7, "pass_bytes": 1}, {"shard_words": 20, "pass_bytes": 2500}])
def test_groups_are_those_of_brute_force(spark, limits):
    rng = random.Random(8)
    counts = {w: rng.choice([5, 5, 6, 30, 31, 200, 1100, 6000, 40_000]) for w in vocabulary(rng, 160)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.group_variants(df, **limits).collect()}
    want = grouped(counts)
    assert got == want
    assert sum(r[1] not in (w, r[0]) for w, r in want.items()) > 3  # chains of several steps
    assert spelling.group_variants(df.filter("false")).collect() == []


def contract(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_query_is_the_contract(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    words = ["letters", "Letters", "ÀÉÎõüÿ", "Àéîõüÿ", "étage×÷s", "longer", "a" * 300, "sixers", "short", "日本letters本"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(400))), "en", "s", 0) for i in range(400)]
    rows += [(None, "letters " * 30, "en", "s", 0), (5, None, "en", "s", 0), (6, "", "en", "s", 0), rows[7], rows[7]]
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    frame(spark, rows, extra=True).withColumns({c: F.lit("clash") for c in ("word", "n", "form")}).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.queries()["op11_spelling"](spark, str(tmp_path))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = {r["word"]: tuple(r)[1:] for r in out.collect()}
    want = {w: (f, root, n, near, form_n) for w, (f, root, n, near, form_n) in grouped(contract((r[0], r[1]) for r in rows)).items()}
    assert got == want and sum(r[0] is not None for r in want.values()) > 4


def test_query_on_a_table(spark):
    path = "/root/testdata/sf0.001"
    got = {r["word"]: tuple(r)[1:] for r in queries.queries()["op11_spelling"](spark, path).collect()}
    assert got == grouped(contract(map(tuple, spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect())))
