"""Tokens, packing, mixing, classifiers, vector search and the pipeline."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparktrail.llm import classifier, mixing, packing, ranks, token_counts, toxicity, vectors
from sparktrail.llm import labelled as labelled_rows
from sparktrail.llm.tokenizer import ByteBpe, PreTokens

from .corpus import SCHEMA, documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE, PRE = ByteBpe(), PreTokens()


def exact(text):
    from tokenizers import Tokenizer

    from sparktrail.llm.tokenizer import tokenizer_path

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_those_of_the_tokenizer_file(text):
    assert BPE.encode(text).tolist() == exact(text)


def test_ids_of_the_corpus():
    for _, text, *_ in documents():
        assert BPE.encode(text or "").tolist() == exact(text or "")


def edited(text, changes):
    for a, b, new in reversed(changes):
        text = text[:a] + new + text[b:]
    return text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the ", " ", "\n", "  \n ", "word", "'s", "12", "é", "#", "😀", " x"]), max_size=200), st.integers(0, 10**9))
def test_tree_counts_as_a_full_encoding_after_edits(parts, seed):
    text, rng = "".join(parts), random.Random(seed)
    tree = token_counts.CountTree(text, PRE, leaf=rng.choice([1, 2, 5]))
    for _ in range(4):
        a = rng.randint(0, len(text))
        b = min(len(text), a + rng.choice([0, 0, 1, 3, 30]))
        new = rng.choice(["", " ", "\n", "q", " the", "'s", "\n\n x"])
        text = text[:a] + new + text[b:]
        tree.edit(a, b, new)
        assert tree.text() == text
        assert tree.total == sum(len(BPE.encode(p)) for p in PRE.split(text))


def test_token_counts(spark):
    rows = [*documents(40), (90, "mail a.b@c.org now\nx y\nx y\nx y", "en", "a", 1)]
    got = token_counts.count_tokens(frame(spark, rows, extra=True)).collect()
    ordinary = lambda t: sum(len(BPE.encode(p)) for p in PRE.split(t)) if "<|" in t else len(exact(t))
    want = []
    for doc_id, text, *_ in rows:
        changes = token_counts.cleaning_edits(text or "")
        after = edited(text or "", changes)
        want.append((doc_id, ordinary(text or ""), len(changes), ordinary(after), after))
    assert sorted([(r["doc_id"], r["n_tokens"], r["n_edits"], r["n_tokens_after"], r["text_after"]) for r in got], key=repr) == sorted(want, key=repr)
    big = "some words here " * 20_000
    tree = token_counts.CountTree(big, PRE)
    assert tree.edit(100_000, 100_004, "x") < 2_000  # only the region around the edit


def check_packing(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_and_packing(spark):
    rows = documents(60)
    docs = frame(spark, rows, extra=True)
    got = packing.pack_documents(docs, capacity=64).collect()
    pieces = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array([*exact(text or ""), 0], "<u4")
        first = len(ids) if len(ids) <= 64 else len(ids) % 64 or 64
        bounds = [0, *range(first, len(ids) + 1, 64)] if len(ids) > 64 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            pieces[doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces
    total = sum(r["length"] for r in got)
    assert check_packing(got, 64) <= total / 64 * 1.05 + 2
    kept = {(r["doc_id"], r["piece"]): r["ids"] for r in packing.pieces(docs, BPE, 64, keep_ids=True).collect() if r["doc_id"] is not None}
    assert kept[9, 0] == [*exact(rows[9][1]), 0][: len(kept[9, 0])]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=20))
def test_plan_places_every_piece_once(counts):
    plan = packing.plan_bins(counts, 60)
    rows, ranks_ = [], defaultdict(list)
    for length, first_rank, n, first, offset in plan:
        ranks_[length].extend(range(first_rank, first_rank + n))
        rows += [{"sequence_id": first + k, "offset": offset, "length": length} for k in range(n)]
    assert {k: len(v) for k, v in ranks_.items()} == counts
    assert all(v == list(range(len(v))) for v in ranks_.values())
    check_packing(rows, 60)
    large = Counter(r["sequence_id"] for r in rows if 3 * r["length"] > 60)
    assert not large or max(large.values()) <= 2


def shares(sizes, weights, most=3):
    """Targets by repeated rounds."""
    target, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > most * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / w for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("bucket", [20_000, 5])
def test_mixing(spark, monkeypatch, bucket):
    monkeypatch.setattr(ranks, "ROWS_A_BUCKET", bucket)
    rows = [(i, t, "en", s, 1) for i, (_, t, _, s, _) in enumerate(documents(80))] + [(900 + i, "tiny words", "en", "aa", 1) for i in range(2)]
    rows = [(i, t, lang, "c" if i % 2 else s, n) for i, t, lang, s, n in rows]
    got = mixing.mix(frame(spark, rows, extra=True)).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = shares(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    taken = Counter()
    for r in got:
        assert r["size"] == len(WORD.findall(rows_by_id(rows)[r["doc_id"]] or "")) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == round(want[s]) for s in want)
    again = mixing.mix(frame(spark, rows, partitions=7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    texts = mixing.mixed_documents(frame(spark, rows, extra=True))
    assert set(texts.columns) >= {"size", "document", "text"}
    words = Counter()
    for r in texts.collect():
        words[r["source"]] += len(WORD.findall(r["text"]))
    assert words == Counter({s: round(t) for s, t in want.items() if round(t)})


def rows_by_id(rows):
    return {r[0]: r[1] for r in rows}


def labelled(n=1200):
    rng = random.Random(5)
    words = [f"term{i}" for i in range(300)]
    bad = ["slur", "vilest", "vilely", "vileness"]
    rows, labels = [], []
    for i in range(n):
        some = rng.choices(words, k=rng.randint(30, 90))
        toxic, poor = rng.random() < 0.2, rng.random() < 0.3
        if toxic:
            for _ in range(6):
                some.insert(rng.randrange(len(some)), rng.choice(bad))
        if poor:
            some = [w for w in some[: len(some) // 4] for _ in range(4)] if i % 2 else [w + "###" for w in some]
        rows.append((i, " ".join(some), "en", "a", 1))
        labels.append((i, int(not poor), int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = labelled()
    rows += [(5000, None, "en", "a", 1), (5001, "", "en", "a", 1), (None, "slur slur vilest term1", "en", "a", 1)]
    labels = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows, extra=True)
    out = toxicity.toxic_scores(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in out if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    passages = toxicity.toxicity(docs, toxicity.fit(docs, labels)).filter("doc_id is null").first()["toxic_passages"]
    assert passages and passages[0]["start"] == 0
    none = toxicity.toxic_scores(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and not any(r["predicted"] for r in none)
    assert toxicity.toxic_scores(spark.createDataFrame([], SCHEMA), labels).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=40))
def test_maximal_segments(values):
    """As defined by recursion: the best segment, then the same on both sides of it."""

    def split(a, b):
        best = max(((sum(values[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, j = best[3], best[4]
        return [*split(a, i), (i, j, best[0]), *split(j, b)]

    assert toxicity.maximal_segments(np.array(values, np.float64)) == split(0, len(values))


def test_maximal_segments_take_linear_time():
    seconds = []
    for n in (100_000, 200_000):
        began = time.perf_counter()
        assert len(toxicity.maximal_segments(np.tile([1.0, -2.0], n // 2))) == n // 2
        assert len(toxicity.maximal_segments(np.tile([2.0, -1.0], n // 2))) == 1
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 5 * seconds[0] and seconds[1] < 5


def test_unit_counts_and_evidence_are_those_of_brute_force(spark):
    texts = [("Bad bad wörter here", 1), ("bad thing, other thing", 0), ("", 0), ("good wörter good", 0)]
    found = {r["unit"] % (1 << 64): (r["toxic"], r["clean"]) for r in toxicity._sampled_units(spark.createDataFrame(texts, "text string, y int")).collect()}
    want = defaultdict(lambda: [0, 0])
    for text, y in texts:
        tokens = [w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+", text)]
        for u in {(w, k) for w in tokens for k in (0, *(k for k in toxicity.BEGINNINGS if len(w) > k))}:
            want[u[0][: u[1]] if u[1] else u[0], u[1]][1 - y] += 1
    number = {}
    for (text, k), pair in want.items():
        raw = np.frombuffer(text.encode(), np.uint8)
        number[(int(toxicity.span_hash(toxicity.prefix_sums(raw), np.array([0]), np.array([len(raw)]))[0]) + k) % (1 << 64)] = tuple(pair)
    assert found == number
    model = toxicity.Model(np.zeros(1, np.uint64), np.zeros(1, np.float32), -0.5, rate=0.7, scale=0.2)
    scores = np.array([1.0, 3.0, -9.0, 0.5, -1.0, 4.0])
    total, segments = toxicity.evidence(model, scores)
    by_hand = [(0, 2, 0.7 * 4 - np.log(0.2 * 6)), (3, 4, 0.7 * 0.5 - np.log(0.2 * 6)), (5, 6, 0.7 * 4 - np.log(0.2 * 6))]
    assert segments == [x for x in by_hand if x[2] > 0] and total == pytest.approx(sum(x[2] for x in by_hand if x[2] > 0))


def test_training_rows_are_bounded_by_ids_with_several_rows(spark):
    rows, labels = labelled(60)
    docs = frame(spark, rows + rows[:5] * 40)
    found = labelled_rows.training_rows(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "toxic", 20).collect()
    assert len(found) == 20 and len({r["text"] for r in found}) == 20


def test_classifier(spark):
    rows, labels = labelled()
    rows += [(5000, None, "en", "a", 1), (5001, "", "en", "a", 1), (None, "some text", "en", "a", 1)]
    frame_ = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows, extra=True)
    out = classifier.quality_scores(docs, frame_).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in out if r["held_out"] and r["doc_id"] < 5000]
    assert len(out) == len(rows) and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert {round(r["score"], 3) for r in classifier.quality_scores(docs, frame_.limit(0)).collect()} == {0.5}
    assert classifier.quality_scores(spark.createDataFrame([], SCHEMA), frame_).count() == 0


def test_vector_search(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 9)).astype(np.float32)
    x[300:400] = x[5]  # many equal vectors
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(700, None, 0), (720, [0.0] * 9, 0), (740, [1.0] * 8 + [None], 0), (760, [float("nan")] * 9, 0), (780, [float("inf")] * 9, 0), (None, x[3].tolist(), 0), (800, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for size in (16_384, 150):
        monkeypatch.setattr(vectors, "BLOCK_ROWS", size)
        monkeypatch.setattr(vectors, "BLOCK_QUERIES", 20)
        got = defaultdict(list)
        for r in vectors.search(df, "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert sorted(got) == list(range(0, 700, 20))
        x64, hits = x.astype(np.float64), 0
        for q, found in got.items():
            s = x64 @ x64[q]
            want = sorted((i for i in range(700) if i != q), key=lambda i: (-s[i], i))[:20]
            hits += len(set(want) & {i for i, _ in found})
            assert len(found) == 20 and all(abs(s[i] - v) < 1e-9 for i, v in found)
            assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert hits >= 0.95 * 20 * len(got)
    wide = spark.createDataFrame([(i, [float(v) + 1e-9 for v in x[i]]) for i in range(30)], "vec_id long, embedding array<double>")
    row = vectors.search(wide, "vec_id = 0").filter("rank = 1").first()
    assert row["score"] == pytest.approx(max((x[1:30].astype(float) + 1e-9) @ (x[0].astype(float) + 1e-9)), abs=1e-13)
    few = df.filter("vec_id < 6")
    assert vectors.search(few, "vec_id = 0").count() == 5
    assert vectors.search(df.limit(0), "vec_id = 0").count() == 0


def test_repeated_rows_are_queries_and_candidates_of_their_own(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, rows[0], rows[7]], "vec_id long, embedding array<float>")
    found = [(r["rank"], r["vec_id"]) for r in vectors.search(df, "vec_id = 0").orderBy("rank").collect()]
    ids = np.array([i for i, _ in rows] + [0, 7])
    s = np.concatenate([x, x[[0, 7]]]).astype(np.float64) @ x[0].astype(np.float64)
    want = sorted((-v, i) for v, i in zip(s[1:], ids[1:], strict=True))[:20]
    assert found == sorted((k + 1, int(i)) for k, (_, i) in enumerate(want) for _ in range(2))


def test_the_codes_decide_what_is_reranked():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    ids, q = np.arange(6000), vectors.train(x[:3000].astype(np.float64))
    codes = q.assign(x.astype(np.float64))
    packed = (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)
    asked = np.arange(0, 6000, 300)
    truth = [set(np.argsort(-np.where(ids == i, -np.inf, x.astype(float) @ x[i].astype(float)))[:20]) for i in asked]
    own = q.residual(x.astype(np.float64), codes)
    # without a margin, with the one that is used, and with the bound that can't be passed
    for residual, deviations, least, most in ((np.zeros(6000), 4, 0.9, 0.051), (own, 4, 0.995, 0.2), (own, 6, 1.0, 1.0)):
        a, b, _, looked_at = vectors.scan(x[asked], asked, x, ids, ids, packed, residual, q, 20, 300, deviations)
        assert np.mean([len(t & set(b[a == k])) / 20 for k, t in enumerate(truth)]) >= least
        assert looked_at.min() >= 300 and looked_at.mean() <= most * 6000


@pytest.mark.parametrize("kind", ["directions", "norms", "clusters"])
def test_few_vectors_are_reranked_and_few_neighbours_missed(kind):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(16_384, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "norms":
        x *= rng.lognormal(size=(len(x), 1))
    if kind == "clusters":
        x = rng.normal(size=(40, 64))[rng.integers(0, 40, len(x))] + 0.3 * rng.normal(size=x.shape)
    x, ids = x.astype(np.float32), np.arange(len(x))
    q = vectors.train(x[:4096].astype(np.float64))
    codes = np.concatenate([q.assign(x[i : i + 2048].astype(np.float64)) for i in range(0, len(x), 2048)])
    residual = np.concatenate([q.residual(x[i : i + 2048].astype(np.float64), codes[i : i + 2048]) for i in range(0, len(x), 2048)])
    packed = (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)
    asked = np.arange(0, len(x), 400)
    a, b, _, looked_at = vectors.scan(x[asked], asked, x, ids, ids, packed, residual, q, 20, 400, 4.0)
    hits = 0
    for place, one in enumerate(asked):
        s = x.astype(np.float64) @ x[one].astype(np.float64)
        s[one] = -np.inf
        hits += len(set(b[a == place]) & set(np.argsort(-s)[:20]))
    assert hits >= 0.99 * 20 * len(asked) and looked_at.mean() < 0.1 * len(x) and looked_at.max() < 0.2 * len(x)


def test_no_neighbour_is_lost_in_a_group_of_near_equal_vectors():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(16_384, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:5461] = x[0] + 1e-4 * rng.normal(size=(5461, 64))
    x, ids = x.astype(np.float32), np.arange(len(x))
    q = vectors.train(x[::4].astype(np.float64))
    codes = np.concatenate([q.assign(x[i : i + 2048].astype(np.float64)) for i in range(0, len(x), 2048)])
    residual = np.concatenate([q.residual(x[i : i + 2048].astype(np.float64), codes[i : i + 2048]) for i in range(0, len(x), 2048)])
    packed = (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)
    asked = np.array([0, 17, 4000, 6000, 9000])
    a, b, _, _ = vectors.scan(x[asked], asked, x, ids, ids, packed, residual, q, 20, 400, 4.0)
    for place, one in enumerate(asked):
        s = x.astype(np.float64) @ x[one].astype(np.float64)
        s[one] = -np.inf
        assert set(b[a == place]) == set(np.argsort(-s)[:20])


def test_anisotropic_loss_falls():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]

    def loss(q):
        codes = q.assign(x)
        back = np.concatenate([q.books[s][codes[:, s]] for s in range(8)], axis=1)
        along = ((x - back) * x).sum(1)
        return (((x - back) ** 2).sum(1) + (q.weight - 1) * along**2).mean()

    assert loss(vectors.train(x, threshold=0.5, rounds=5)) < loss(vectors.train(x, threshold=0.5, rounds=0))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows, labels = labelled(400)
    rows += [(1000 + i, t, "en", s, n) for i, (_, t, _, s, n) in enumerate(documents(60))]
    spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == columns
        now = {r["doc_id"] for r in docs.collect()}
        assert ids is None or now <= ids
        ids = now
        if name == "toxicity":
            toxic = {i for i, _, t in labels if t}
            assert len(ids & toxic) < 0.1 * len(toxic) and len({i for i, _, t in labels if not t} - ids) < 5
    check_packing(docs.collect(), 2048)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.drop("sequence_id", "offset").collect()), key=repr) == sorted(map(tuple, docs.drop("sequence_id", "offset").collect()), key=repr)
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
