"""Toxic passages: maximal scoring segments over token log-odds.

Tokens are words (ASCII and Latin-1 letters in lower case, ASCII punctuation at no place), each scored as a whole and by its
beginnings, so that inflected forms of a stem count. Log-odds between toxic and other labelled documents have an
informative Dirichlet prior; those that are not significant fall back to the mean of what clean documents hold. A
linear scan finds all maximal scoring segments; the Karlin-Altschul parameters of clean text turn segment scores into
E-values, whose evidence summed over a document's significant passages is calibrated by a logistic fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, training_rows
from .text import mix, prefix_sums, slices, span_hash, utf8, window_hash

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[0x41:0x5B] += 0x20
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lengths, in code points, of the word beginnings that are scored beside the whole word.
BEGINNINGS = (4, 5)


def lower(raw: np.ndarray) -> np.ndarray:
    """UTF-8 with ASCII letters and those of Latin-1 (two bytes, the first 0xC3) in lower case."""
    out = _PLAIN[raw]
    latin = np.zeros(len(raw), bool)
    latin[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    out[latin] += 0x20
    return out


def units(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each token and its beginnings (tokens x 3), tokens' byte starts and ends, and the rows' token offsets."""
    inside = _INSIDE[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(raw))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = prefix_sums(lower(raw))
    chars = np.flatnonzero((raw & 0xC0) != 0x80)
    chars = np.append(chars, np.full(max(BEGINNINGS), len(raw)))
    at = np.searchsorted(chars, start)
    out = [span_hash(sums, start, end)]
    for k in BEGINNINGS:
        cut = chars[np.minimum(at + k, len(chars) - 1)]
        out.append(np.where(cut < end, span_hash(sums, start, np.minimum(cut, end)) + np.uint64(k), np.uint64(0)))
    return np.stack(out, axis=1), start, end, np.searchsorted(start, off)


@dataclass
class Model:
    """Bounded by the training sample: significant units, the score of all others, and the calibration."""

    keys: np.ndarray
    scores: np.ndarray
    other: float
    rate: float = 1.0  # lambda of the extreme-value distribution
    scale: float = 0.1  # K, where there is no clean document to fit it to
    slopes: np.ndarray = field(default_factory=lambda: np.zeros(2))
    intercept: float = -4.0

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def token_scores(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The largest score of a token's units, or `other` where none is significant; first: the rows' token offsets.

        A token equal to the one before it never adds to a passage: a word repeated a hundred times says no more than once.
        """
        flat = hashes.ravel()
        out = np.full(len(flat), -np.inf, np.float32)
        at = np.flatnonzero(self.maybe[(flat & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(at):
            k = np.minimum(np.searchsorted(self.keys, flat[at]), len(self.keys) - 1)
            hit = self.keys[k] == flat[at]
            out[at[hit]] = self.scores[k[hit]]
        best = out.reshape(hashes.shape).max(axis=1)
        best = np.where(np.isneginf(best), np.float32(self.other), best)
        again = np.zeros(len(best), bool)
        again[1:] = hashes[1:, 0] == hashes[:-1, 0]
        again[first[:-1][first[:-1] < len(best)]] = False
        return np.where(again, np.minimum(best, np.float32(self.other)), best)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time; runs of negative scores are summed at once.

    Each candidate keeps the place of the last one before it whose sum before is smaller. A search follows these links, so
    that a candidate passed over once is not looked at again.
    """
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    at = np.flatnonzero(scores > 0)
    starts, ends, befores, afters, links = [], [], [], [], []
    for i, before, after in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist(), strict=True):
        start, j = i, len(starts) - 1
        while True:
            while j >= 0 and befores[j] >= before:
                j = links[j]
            if j < 0 or afters[j] >= after:
                break
            start, before = starts[j], befores[j]
            next_ = links[j]
            for column in (starts, ends, befores, afters, links):
                del column[j:]
            j = next_
        for column, value in ((starts, start), (ends, i + 1), (befores, before), (afters, after), (links, j)):
            column.append(value)
    return [(a, b, after - before) for a, b, before, after in zip(starts, ends, befores, afters, strict=True)]


def evidence(model: Model, scores: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
    """Summed -log E of the segments with E < 1 in a document of that many tokens, and those segments."""
    found = []
    total = 0.0
    base = np.log(max(model.scale * len(scores), 1e-9))
    for a, b, s in maximal_segments(scores):
        e = model.rate * s - base
        if e > 0:
            found.append((a, b, e))
            total += e
    return total, found


def _without_copies(sample: DataFrame) -> DataFrame:
    """One document of each group of near copies in the sample, whose words would count as often as it was copied.

    Groups share one of three smallest hashes of five-token windows; the row with the smallest hash of its text stays.
    """

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw_all, off_all = utf8(batch.column(0))
            lows = []
            for i, j in slices(off_all):
                hashes, _, _, first = units(raw_all[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i])
                for a, b in zip(first[:-1], first[1:], strict=True):
                    windows = window_hash(hashes[a:b, 0], 5) if b - a >= 5 else mix(np.append(hashes[a:b, 0], np.uint64(b - a)))
                    lows.append([int(mix(windows ^ np.uint64(k)).min().view(np.int64)) for k in (1, 2, 3)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(lows, pa.list_(pa.int64()))], ["text", "y", "lows"])

    rows = sample.mapInArrow(smallest, "text string, y int, lows array<long>")
    for k in range(3):
        rows = rows.groupBy(F.col("lows")[k].alias("low")).agg(F.min_by(F.struct("text", "y", "lows"), F.xxhash64("text", "y")).alias("x")).select("x.*")
    return rows.select("text", "y")


def _sampled_units(sample: DataFrame) -> DataFrame:
    """(unit, toxic, clean): documents of each class that hold the unit, summed within tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw_all, off_all = utf8(batch.column(0))
            y = np.asarray(batch.column(1))
            for i, j in slices(off_all):
                hashes, _, _, first = units(raw_all[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i])
                each = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                label = np.repeat(y[i:j], [len(x) for x in each])
                keys, inverse = np.unique(np.concatenate(each), return_inverse=True)
                toxic = np.bincount(inverse, weights=label > 0, minlength=len(keys))
                clean = np.bincount(inverse, weights=label == 0, minlength=len(keys))
                some = keys != 0
                yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(toxic[some].astype(np.int64)), pa.array(clean[some].astype(np.int64))], ["unit", "toxic", "clean"])

    return sample.mapInArrow(count, "unit long, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _rate(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive solution of sum p exp(rate * score) = 1, by bisection."""
    p = weights / weights.sum()
    low, high = 1e-3, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if (p * np.exp(np.minimum(mid * scores, 300))).sum() > 1 else (mid, high)
    return max(low, 0.05)


def evidence_features(total: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """What the calibration sees of a document: its evidence, and its evidence by a hundred tokens, on logarithmic scales."""
    return np.stack([np.log1p(total), np.log1p(100 * total / np.maximum(tokens, 1))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and intercept by Newton's method, with a small ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.r_[np.full(x.shape[1] - 1, 0.1), 0.01]
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        w = p * (1 - p) + 1e-9
        step = np.linalg.solve((x * w[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b[:-1], float(b[-1])


def fit(docs: DataFrame, labels: DataFrame, limit: int = 20_000, prior: float = 0.05, z: float = 2.5) -> Model:
    """Learn from at most `limit` labelled documents that aren't held out.

    The Dirichlet prior holds `prior` times the sample's counts, spread over units as the sample has them.
    Without labels of both classes the model finds nothing significant and gives every document the same low score.
    """
    sample = _without_copies(training_rows(docs, labels, "toxic", limit)).repartition(8).persist()
    try:
        counts = _sampled_units(sample)
        totals = F.broadcast(counts.agg(F.sum("toxic").cast("double").alias("nt"), F.sum("clean").cast("double").alias("nc")))
        a = F.lit(prior) * (F.col("toxic") + F.col("clean"))
        whole = F.lit(prior) * (F.col("nt") + F.col("nc"))
        t, c = F.col("toxic") + a, F.col("clean") + a
        odds = F.log(t / (F.col("nt") + whole - t)) - F.log(c / (F.col("nc") + whole - c))
        scored = counts.crossJoin(totals).filter("nt > 0 and nc > 0").select("unit", odds.alias("odds"), F.sqrt(1 / t + 1 / c).alias("sd"), "clean")
        strong = scored.filter(F.abs("odds") > z * F.col("sd")).select("unit", (F.col("odds") - F.signum("odds") * F.col("sd")).alias("score"))
        rows = sorted((r["unit"] % (1 << 64), r["score"]) for r in strong.collect())  # at most what the sample holds
        model = Model(np.array([k for k, _ in rows], np.uint64), np.array([s for _, s in rows], np.float32), -0.5)
        if not rows:
            return model
        return _calibrated(model, sample)
    finally:
        sample.unpersist()


def _calibrated(model: Model, sample: DataFrame) -> Model:
    edges = np.linspace(-12, 12, 481)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(edges) - 1)
        for scores, y in _scored(batches, model):
            if y == 0:
                total += np.histogram(np.clip(scores, -11.9, 11.9), edges)[0]
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["counts"])

    counts = np.sum([np.array(r["counts"]) for r in sample.mapInArrow(histogram, "counts array<double>").collect()], axis=0)
    middle = (edges[1:] + edges[:-1]) / 2
    model.rate = _rate(middle, np.maximum(counts, 1e-12))

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0.0
        for scores, y in _scored(batches, model):
            if y == 0 and len(scores):
                n += 1
                total += len(scores) * np.exp(-model.rate * max((s for *_, s in maximal_segments(scores)), default=0.0))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    # the likeliest K of clean documents' highest scores x, whose distribution is exp(-K tokens exp(-rate x))
    sums = sample.mapInArrow(extremes, "n double, total double").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    if sums["total"]:
        model.scale = sums["n"] / sums["total"]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(evidence(model, s)[0], len(s), int(y)) for s, y in _scored(batches, model)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.float64(), pa.int64(), pa.int32()))], ["total", "tokens", "y"])

    rows = sample.mapInArrow(features, "total double, tokens long, y int").collect()  # three numbers of at most `limit` documents
    x = evidence_features(np.array([r["total"] for r in rows]), np.array([r["tokens"] for r in rows]))
    model.slopes, model.intercept = _logistic(x, np.array([r["y"] for r in rows]) > 0)
    return model


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[np.ndarray, int]]:
    for batch in batches:
        raw_all, off_all = utf8(batch.column(0))
        y = np.asarray(batch.column(1))
        for i, j in slices(off_all):
            hashes, _, _, first = units(raw_all[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i])
            scores = model.token_scores(hashes, first)
            for k in range(j - i):
                yield scores[first[k] : first[k + 1]], int(y[i + k])


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """All columns of docs but any of these names, and toxic_score, toxic_predicted (0/1), toxic_passages array<struct<start, end, evidence>>.

    Passages are byte ranges of the text. Null and empty texts have no passages and the score of no evidence. A repeated
    row is scored each time; it counts once in training. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the training sample
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))
    names = [c for c in docs.columns if c not in ("toxic_score", "toxic_predicted", "toxic_passages")]
    kept = docs.select(*(F.col(f"`{c}`") for c in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            raw_all, off_all = utf8(batch.column(names.index("text")))
            for i, j in slices(off_all):
                hashes, start, end, first = units(raw_all[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i])
                scores = model.token_scores(hashes, first)
                base = off_all[i : j + 1] - off_all[i]
                x, passages = [], []
                for k in range(j - i):
                    a = first[k]
                    total, found = evidence(model, scores[a : first[k + 1]])
                    x.append(total)
                    passages.append([{"start": int(start[a + s] - base[k]), "end": int(end[a + e - 1] - base[k]), "evidence": v} for s, e, v in found])
                p = 1 / (1 + np.exp(-np.clip(evidence_features(np.array(x), np.diff(first)) @ model.slopes + model.intercept, -40, 40)))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(passages, kind)], [*names, "toxic_score", "toxic_predicted", "toxic_passages"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, toxic_score double, toxic_predicted int, toxic_passages array<struct<start: long, end: long, evidence: double>>")


def toxic_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) of every document, learned from labels.toxic of those not held out.

    Null and empty texts get the score of no evidence, null ids aren't held out, a repeated row is scored each time, an
    empty table gives no rows. Of docs only doc_id and text are read.
    """
    out = toxicity(docs.select("doc_id", "text"), fit(docs, labels), threshold)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"), F.size("toxic_passages").alias("passages"))
