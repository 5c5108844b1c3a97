"""Columns that are called like the operators' own, and the classifier's parts against plain Python."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparktrail.llm import classifier, mixing, quality
from sparktrail.llm.text import utf8, window_hash

from .corpus import frame

#: Every name that a stage gives to a column of its own.
NAMES = (
    "toxic_score toxic_predicted toxic_passages rest document doc row text_hash begin copy taken size source_size target mix_key words_before target_source weight cap turn share first_open "
    "__cut kept_text cut_row cut_sha256 spans sha256 of_row anchors h hot runs first end block windows fp component component_id shingles label_id y held_out score predicted n key stays group lines host frequent"
).split()


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), "en", rng.choice(["a", "b", None]), 1) for i in range(40)]
    rows += [(100, rows[3][1], "en", "a", 1), (None, None, None, None, None), (101, "", "en", "b", 0)]
    docs = frame(spark, rows).withColumns({c: F.concat(F.lit(c), F.lit("-"), F.coalesce(F.col("doc_id"), F.lit(-1))) for c in NAMES})
    spark.createDataFrame([(0, 1, 1), (1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        kept = docs.select("doc_id", *NAMES).collect()
        assert kept
        for r in kept:
            assert all(r[c] == f"{c}-{-1 if r['doc_id'] is None else r['doc_id']}" for c in NAMES), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0


def test_frequent_lines_go_from_rows_with_clashing_names(spark):
    line = "the same footer line stands here in all of them"
    rows = [(i, f"{line}\n" + " ".join(f"u{i}x{k}" for k in range(40)), "en", "a", 1) for i in range(30)] + [(None, None, None, None, None)]
    docs = frame(spark, rows).withColumns({c: F.lit("clash") for c in NAMES})
    out = quality.without_frequent_lines(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == 30 and all(line not in r["text"] and r["frequent"] == "clash" for r in got)
    assert quality.without_frequent_lines(docs.filter("false")).count() == 0 and mixing.mixed_documents(docs.filter("false")).count() == 0


def plain_features(text):
    """Buckets with their numbers, from the words and bytes of one text."""
    data, counts = text.encode(), {}
    add = lambda b: counts.__setitem__(b, counts.get(b, 0) + 1)
    some = data.split()
    for a, b in zip([None, *some], some, strict=False):
        add(int(classifier.word_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0]) % classifier.BUCKETS)
        if a == b:
            add(classifier.REPEAT)
    for k in classifier.GRAMS:
        for i in range(len(data) - k + 1):
            add(int(window_hash(np.frombuffer(data[i : i + k], np.uint8), k)[0]) % classifier.BUCKETS)
    return counts


TEXTS = ["", "a", "two two words  two", "größer größer\nnaïve 日本", "x" * 50, "a b c d e f g h"]


def test_features_and_logits_are_those_of_plain_python():
    rng = np.random.default_rng(1)
    table = rng.normal(size=classifier.BUCKETS).astype(np.float32)
    raw, off = utf8(pa.array(TEXTS))
    got = classifier.logits(table, 0.25, raw, off)
    for k, text in enumerate(TEXTS):
        counts = plain_features(text)
        n = sum(counts.values())
        want = 0.25 + (sum(float(table[b]) * c for b, c in counts.items()) / n if n else 0)
        assert got[k] == pytest.approx(want, abs=1e-4), text


def test_training_is_gradient_descent_step_by_step():
    """The same steps in plain Python, one number at a time: the table and bias that come out are equal."""
    rows = []
    for text, y in zip(TEXTS[1:], (1, 0, 1, 0, 1), strict=True):
        counts = plain_features(text)
        buckets = np.array(sorted(counts), np.int32)
        weights = np.array([counts[b] for b in buckets.tolist()], np.float32)
        rows.append((buckets, weights / weights.sum(), y))
    dim, epochs, rate, seed = 3, 2, 0.5, 7
    table, bias = classifier.train(rows, dim, epochs, rate, seed)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (classifier.BUCKETS, dim)).astype(np.float32)
    used = sorted({int(b) for r in rows for b in r[0]})
    v = {b: [float(x) for x in vectors[b]] for b in used}
    out, own, done = [[0.0] * dim for _ in range(2)], [0.0, 0.0], 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            buckets, weights, y = rows[k]
            step = rate * (1 - done / (epochs * len(rows)))
            done += 1
            hidden = [sum(float(w) * v[int(b)][i] for b, w in zip(buckets, weights, strict=True)) for i in range(dim)]
            z = [sum(out[c][i] * hidden[i] for i in range(dim)) + own[c] for c in range(2)]
            top = max(z)
            p = [math.exp(x - top) for x in z]
            p = [x / sum(p) - (c == y) for c, x in enumerate(p)]
            back = [sum(p[c] * out[c][i] for c in range(2)) for i in range(dim)]
            for c in range(2):
                own[c] -= step * 0.1 * p[c]
                for i in range(dim):
                    out[c][i] -= step * p[c] * hidden[i]
            for b, w in zip(buckets, weights, strict=True):
                for i in range(dim):
                    v[int(b)][i] -= max(-0.5, min(0.5, step * len(buckets) * float(w) * back[i]))
    assert bias == pytest.approx(own[1] - own[0], abs=1e-5)
    for b in used:
        assert table[b] == pytest.approx(sum(v[b][i] * (out[1][i] - out[0][i]) for i in range(dim)), abs=1e-4)
