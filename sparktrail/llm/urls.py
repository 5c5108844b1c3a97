"""URL filters: rules on hosts and paths first, then logistic regression on hashed character n-grams of both.

The classifier is trained by numpy on a small table of labelled URLs, in one task, and has a fixed size. By default the table
is a bounded sample of the URLs that a rule judges, with the rule's verdict: what people decided about some hosts and paths
is carried over to the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import mix, slices, utf8, window_hash

BUCKETS = 1 << 18
GRAMS = (2, 3, 4, 5)
#: Rules are configuration that the driver and each task hold whole; this bounds it.
MAX_RULES = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """verdict ("allow" or "block") for a host and all its subdomains, where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rules(text: str) -> list[Rule]:
    """From lines or comma-separated items like `block example.org/es/`."""
    out = []
    for item in text.replace("\n", ",").split(","):
        if item.strip():
            verdict, at = item.split()
            host, slash, path = at.partition("/")
            if verdict not in ("allow", "block") or not host:
                raise ValueError(f"not a rule: {item.strip()}")
            out.append(Rule(verdict, host.translate(str.maketrans(_UPPER, _LOWER)), slash + path))
    return out


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path; both empty for null and for texts without `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    found = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(found(1), _UPPER, _LOWER), found(2)


class Matcher:
    """Finds the longest rule that fits a URL; of equally long ones the one whose host is longer."""

    def __init__(self, some: list[Rule]):
        self.by_host: dict[str, dict[str, Rule]] = {}
        for r in some:
            if self.by_host.setdefault(r.host, {}).setdefault(r.path, r).verdict != r.verdict:
                raise ValueError(f"contradicting rules for {r.name}")
        self.lengths = {h: sorted({len(p) for p in paths}, reverse=True) for h, paths in self.by_host.items()}

    def find(self, host: str, path: str) -> Rule | None:
        best, most, at = None, -1, 0
        while True:
            own = host[at:]
            for n in self.lengths.get(own, ()):
                if n <= len(path) and (r := self.by_host[own].get(path[:n])) is not None:
                    if len(own) + n > most:
                        best, most = r, len(own) + n
                    break
            at = host.find(".", at) + 1
            if not at:
                return best


def with_rules(pages: DataFrame, some: list[Rule]) -> DataFrame:
    """pages' columns, which must include host and path, and struct `ruled` <rule, verdict>, null where no rule fits."""
    if len(some) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    shared = pages.sparkSession.sparkContext.broadcast(Matcher(some))  # at most MAX_RULES
    names = pages.columns
    kind = pa.struct([("rule", pa.string()), ("verdict", pa.string())])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.find
        for batch in batches:
            hosts, paths = (batch.column(names.index(c)).to_pylist() for c in ("host", "path"))
            found = [find(h, p) for h, p in zip(hosts, paths, strict=True)]
            column = pa.array([r and {"rule": r.name, "verdict": r.verdict} for r in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*names, "ruled"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(match, f"{fields}, ruled struct<rule: string, verdict: string>")


def features(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of each row's host and path, kept apart, and the n + 1 offsets of the rows.

    Hosts and paths get a mark at both ends, so that a gram tells its place there. Grams are of UTF-8 bytes.
    """
    buckets, rows = [], []
    for salt, column in ((1, host), (2, path)):
        marked = pa.compute.binary_join_element_wise("\x02", column.fill_null(""), "\x03", "")
        raw, off = utf8(marked)
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        for k in GRAMS:
            grams = window_hash(raw, k)
            whole = np.flatnonzero(row[: len(grams)] == row[k - 1 :]) if len(grams) else np.zeros(0, np.int64)
            buckets.append(mix(grams[whole] + np.uint64(salt)) & np.uint64(BUCKETS - 1))
            rows.append(row[whole])
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return np.concatenate(buckets)[order].astype(np.int64), np.searchsorted(row[order], np.arange(len(host) + 1))


def logits(weights: np.ndarray, bias: float, buckets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """bias + sum of the weights of a row's features / the square root of their number."""
    total = np.zeros(len(buckets) + 1)
    np.cumsum(weights[buckets], out=total[1:])
    return bias + (total[off[1:]] - total[off[:-1]]) / np.sqrt(np.maximum(np.diff(off), 1))


def gradient(weights: np.ndarray, bias: float, buckets: np.ndarray, off: np.ndarray, y: np.ndarray, ridge: float) -> tuple[np.ndarray, float, float]:
    """Of the mean logistic loss plus ridge / 2 * |weights|**2: by weights, by bias, and the loss."""
    z = logits(weights, bias, buckets, off)
    p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    n = np.diff(off)
    each = np.repeat((p - y) / np.sqrt(np.maximum(n, 1)) / len(y), n)
    loss = np.mean(np.logaddexp(0, z) - y * z) + ridge / 2 * weights @ weights
    return np.bincount(buckets, each, BUCKETS) + ridge * weights, float(np.mean(p - y)), float(loss)


def train(buckets: np.ndarray, off: np.ndarray, y: np.ndarray, ridge: float = 1e-5, rounds: int = 150, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient steps scaled for each weight (Adam), on all rows at once; deterministic."""
    weights, bias = np.zeros(BUCKETS), 0.0
    used = np.unique(buckets)
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, rounds + 1):
        g, b, _ = gradient(weights, bias, buckets, off, y, ridge)
        g = np.r_[g[used], b]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (1 - (t - 1) / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weights[used] -= step[:-1]
        bias -= step[-1]
    return weights, float(bias)


def labelled_urls(ruled: DataFrame, limit: int = 10_000) -> DataFrame:
    """(host, path, y) of at most `limit` distinct URLs that a rule judges, those with the smallest hashes; y: 1 for block.

    Each verdict takes at most half, so that a rare one is learned too. A URL counts once, however often it occurs.
    """
    known = ruled.filter("ruled is not null").groupBy("host", "path").agg((F.max("ruled.verdict") == "block").cast("int").alias("y"))
    half = lambda y: known.filter(F.col("y") == y).orderBy(F.xxhash64("host", "path"), "host", "path").limit(limit // 2)
    return half(0).unionByName(half(1))


def fit(labelled: DataFrame, most: int = 10_000) -> tuple[np.ndarray, float]:
    """(weights, bias) from (host, path, y); at most `most` rows, which is checked. Trained in one task.

    Without labelled URLs everything is allowed; with those of one verdict only, that verdict is given throughout.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        weights, bias = np.zeros(BUCKETS), -1.0
        if table is not None and table.num_rows:
            if table.num_rows > most:
                raise ValueError(f"more than {most} labelled URLs")
            table = table.sort_by([("host", "ascending"), ("path", "ascending"), ("y", "ascending")]).combine_chunks()
            host, path, y = (c.combine_chunks() for c in table.columns)
            y = np.asarray(y).astype(np.float64)
            if y.min() < y.max():
                weights, bias = train(*features(host, path), y)
            else:
                bias = 1.0 if y[0] else -1.0
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])

    some = labelled.select(F.col("host").cast("string"), F.col("path").cast("string"), F.col("y").cast("int")).dropna()
    found = some.repartition(1).mapInArrow(learn, "weights binary, bias double").first()
    return (np.zeros(BUCKETS, np.float32), -1.0) if found is None else (np.frombuffer(found["weights"], "<f4").copy(), found["bias"])


def filter_urls(pages: DataFrame, some: list[Rule], labelled: DataFrame | None = None, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """pages as struct `page`, and host, path, rule, verdict and score of each url.

    The longest rule that fits decides; else block where the classifier's score, the probability of block, reaches the
    threshold. labelled: (host, path, y), `labelled_urls` of these pages by default. score is null where a rule decides.
    Null urls and those without `://` have an empty host and path and are scored as such. Repeated rows are judged each
    time; an empty table gives no rows; other columns may have any name.
    """
    page = F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("page")
    host, path = parts(F.col(f"`{url}`").cast("string"))
    ruled = with_rules(pages.select(page, host.alias("host"), path.alias("path")), some)
    if labelled is None:
        labelled = labelled_urls(with_rules(pages.select(host.alias("host"), path.alias("path")), some))
    shared = pages.sparkSession.sparkContext.broadcast(fit(labelled))  # of fixed size
    names = ruled.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            _, off = utf8(batch.column(names.index("path")))
            for i, j in slices(off):
                part = batch.slice(i, j - i)
                z = logits(weights, bias, *features(part.column(names.index("host")), part.column(names.index("path"))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], [*names, "score"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ruled.schema)
    scored = ruled.mapInArrow(score, f"{fields}, score double")
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page", "host", "path", "ruled.rule", F.coalesce("ruled.verdict", own).alias("verdict"), F.when(F.col("ruled").isNull(), F.col("score")).alias("score"))


def allowed(pages: DataFrame, some: list[Rule], **options) -> DataFrame:
    """The rows of pages whose url is allowed, unchanged."""
    out = filter_urls(pages, some, **options).filter("verdict = 'allow'")
    return out.select(*(F.col("page").getField(c).alias(c) for c in pages.columns))
