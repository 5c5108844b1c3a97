"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its hashed features (words, character n-grams across words, and a shared
feature for a word that repeats the one before it), followed by a softmax. Trained by stochastic gradient descent in
numpy on a bounded sample. As the output is linear in the mean, scoring needs one number per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, training_rows
from .text import slices, utf8, window_hash, word_hashes, words

BUCKETS = 1 << 18
GRAMS = (2, 3, 4)
_MASK = np.uint64(BUCKETS - 1)
REPEAT = 0  # bucket of a word that repeats its predecessor


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & _MASK).astype(np.int32)


def features(raw: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: buckets, and the rows' n + 1 offsets into them."""
    start, end, first = words(raw, off)
    hashes = word_hashes(raw, start, end)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    again = np.zeros(len(hashes), bool)
    if len(hashes):
        again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    at = np.flatnonzero(again)
    out = [(_bucket(hashes), first), (np.full(len(at), REPEAT, np.int32), np.searchsorted(at, first))]
    bytes_row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    for k in GRAMS:
        grams = window_hash(raw, k)
        whole = np.flatnonzero(bytes_row[: len(grams)] == bytes_row[k - 1 : k - 1 + len(grams)]) if len(grams) else np.zeros(0, np.int64)
        out.append((_bucket(grams[whole]), np.searchsorted(whole, off)))
    return out


def logits(table: np.ndarray, bias: float, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """bias + mean of the table's numbers over each row's features; rows without features: the bias."""
    total, count = np.zeros(len(off) - 1), np.zeros(len(off) - 1)
    for buckets, first in features(raw, off):
        sums = np.zeros(len(buckets) + 1)
        np.cumsum(table[buckets], out=sums[1:])
        total += sums[first[1:]] - sums[first[:-1]]
        count += np.diff(first)
    return bias + total / np.maximum(count, 1)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 1) -> tuple[np.ndarray, float]:
    """Table and bias from (buckets, weights that sum to 1, label) of each document; two output vectors, softmax loss."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    output, bias = np.zeros((2, dim), np.float32), np.zeros(2)
    steps, total = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            buckets, weights, y = rows[k]
            step = rate * (1 - steps / total)
            steps += 1
            some = vectors[buckets]
            hidden = weights @ some
            z = output @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = (p @ output).astype(np.float32)
            output -= (step * np.outer(p, hidden)).astype(np.float32)
            bias -= step * 0.1 * p
            # steps are scaled by the number of features, as each has a small weight in the mean
            vectors[buckets] = some - (step * len(buckets) * weights[:, None] * back).clip(-0.5, 0.5)
    return vectors @ (output[1] - output[0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, limit: int = 8000) -> tuple[np.ndarray, float]:
    """Train in one task on at most `limit` labelled documents that aren't held out; the model's size is fixed.

    Features are computed by many tasks. Without any labelled document the model gives 0.5 throughout.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column(0))
            lists, counts = [], []
            for k in range(batch.num_rows):
                some = [b for b, _ in features(raw[off[k] : off[k + 1]], np.array([0, off[k + 1] - off[k]]))]
                buckets, n = np.unique(np.concatenate(some), return_counts=True)
                lists.append(buckets)
                counts.append(n.astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32())), batch.column(1)], ["buckets", "counts", "y"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for b, n, y in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                buckets, counts = np.asarray(b.values), np.asarray(n.values)
                if len(buckets):
                    rows.append((buckets, counts / counts.sum(), int(y > 0)))
        rows.sort(key=lambda r: (len(r[0]), r[2], float(r[1][0]), int(r[0][-1])))  # the same order in every run
        table, bias = train(rows) if rows else (np.zeros(BUCKETS, np.float32), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([table.astype("<f4").tobytes()]), pa.array([bias])], ["model", "bias"])

    sample = training_rows(docs, labels, "quality", limit).repartition(16).mapInArrow(extract, "buckets array<int>, counts array<float>, y int")
    found = sample.repartition(1).mapInArrow(learn, "model binary, bias double").first()
    return np.frombuffer(found["model"], "<f4").copy(), found["bias"]


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, limit: int = 8000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; null and empty texts get the score of no features.

    A repeated row is scored each time; it counts once in training. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, limit))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value
        for batch in batches:
            raw_all, off_all = utf8(batch.column(2))
            for i, j in slices(off_all):
                z = logits(table, bias, raw_all[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i])
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:2], pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
