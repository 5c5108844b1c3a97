"""Quality rules: cross-document line frequency, after per-document base rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, numbered
from .text import mix, row_sums, slices, utf8, window_hash, word_hashes, words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
STATS = "row long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"


def normalised(line: bytes) -> bytes:
    """ASCII letters in lower case, runs of white space as one space, none at the ends."""
    return b" ".join(line.lower().split())


def line_hash(line: bytes) -> int:
    return xxhash.xxh64_intdigest(normalised(line)) - (1 << 63)


def _repeated_words(hashes: np.ndarray, off: np.ndarray, width: int) -> np.ndarray:
    """Per row, the words that lie in windows of `width` words found twice or more in the row."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keys = window_hash(hashes, width)
    starts = np.flatnonzero(row[: len(keys)] == row[width - 1 : width - 1 + len(keys)]) if len(keys) else np.zeros(0, int)
    keys = mix(keys[starts] + mix(row[starts].astype(np.uint64) + np.uint64(1)))
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    starts = starts[counts[inverse] > 1]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return row_sums((np.cumsum(edge)[:-1] > 0).astype(np.int64), off)


def _statistics(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw_all, off_all = utf8(batch.column(3))
        for i, j in slices(off_all):
            raw, off = raw_all[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i]
            start, end, first = words(raw, off)
            chars = np.zeros(len(raw) + 1, np.int64)
            np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])
            symbols = row_sums(_SYMBOL[raw], off)
            repeated = _repeated_words(word_hashes(raw, start, end), first, width)
            data, dups, lines, counts = raw.tobytes(), [], [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                seen, found, again = set(), {}, 0
                for line in data[a:b].split(b"\n"):
                    if n := len(line.split()):
                        again += line in seen
                        seen.add(line)
                        found[h] = found.get(h := line_hash(line), 0) + n
                dups.append(again)
                lines.append(list(found))
                counts.append(list(found.values()))
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], *(pa.array(x, pa.int64()) for x in (np.diff(first), row_sums(chars[end] - chars[start], first), symbols, dups, repeated)), pa.array(lines, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))],
                names=[f.split()[0] for f in STATS.split(", ")],
            )


def statistics(docs: DataFrame, host: str = "source", width: int = 8) -> DataFrame:
    """One row per document: counts, and the hashes of its distinct normalised lines with the words that each holds.

    A null text has no words and no lines. `row` tells apart rows with null or repeated doc_ids.
    """
    return _statistics_of(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col(f"`{host}`").cast("string").alias("host"), F.col("text").cast("string")), width)


def _statistics_of(rows: DataFrame, width: int = 8) -> DataFrame:
    return rows.mapInArrow(lambda batches: _statistics(batches, width), STATS)


def frequent_lines(stats: DataFrame, min_docs: int = 5, fraction: float = 0.02) -> DataFrame:
    """(row, removed_words, frequent): per document, its lines found in more of its host's documents than the limit.

    The limit is `fraction` of the host's documents, `min_docs` at least. A document counts once for a line; a null host
    is a host of its own. Counts are summed before the shuffle, so that a line of a third of all documents costs nothing.
    """
    lines = stats.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    limits = stats.groupBy(F.col("host").alias("h")).agg(F.greatest(F.lit(min_docs), F.floor(F.count("*") * F.lit(fraction))).alias("limit"))
    counts = lines.groupBy(F.col("host").alias("line_host"), F.col("line").alias("l")).agg(F.count("*").alias("docs")).filter(F.col("docs") > min_docs)
    above = counts.join(limits, F.col("line_host").eqNullSafe(F.col("h"))).filter(F.col("docs") > F.col("limit")).select("line_host", "l")
    hits = lines.join(above, (F.col("line") == F.col("l")) & F.col("host").eqNullSafe(F.col("line_host")))
    return hits.groupBy("row").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("frequent"))


def quality_rules(docs: DataFrame, host: str = "source", min_words: int = 20, max_repeat_percent: int = 30, min_left: float = 0.3, min_docs: int = 5, fraction: float = 0.02) -> DataFrame:
    """Statistics, verdicts and the frequent lines of every document.

    base_failed: fewer than min_words words, or over max_repeat_percent % of the words in repeated windows. depleted: the
    words outside frequent lines are fewer than min_words or than min_left of all. kept: neither. Null and empty texts fail,
    a repeated row counts and is judged each time, an empty table gives no rows.
    """
    stats = materialize(statistics(docs, host), "line-statistics")
    return _judged(stats, min_words, max_repeat_percent, min_left, min_docs, fraction)


def _judged(stats: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, min_left: float = 0.3, min_docs: int = 5, fraction: float = 0.02) -> DataFrame:
    found = frequent_lines(stats, min_docs, fraction)
    out = stats.drop("lines", "line_words").join(found, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    out = out.withColumn("base_failed", base).withColumn("depleted", (left < min_words) | (left < F.col("n_words") * F.lit(min_left)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def without_frequent_lines(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The kept documents with their frequent lines taken out of `text`; all other columns as they were.

    Null and empty texts fail the base rules and go; repeated rows count and are judged each time; a null host is a host of
    its own; an empty table gives no rows.
    """
    stored = numbered(docs)
    rows = stored.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc").getField(host).cast("string").alias("host"), F.col("doc.text").cast("string").alias("text"))
    verdicts = _judged(materialize(_statistics_of(rows), "line-statistics"), **limits).filter("kept").select("row", "frequent")

    @F.pandas_udf("string")
    def strip(text, frequent):
        import pandas as pd

        out = []
        for t, bad in zip(text, frequent, strict=True):
            if t is not None and bad is not None:
                bad = set(bad)
                t = "\n".join(x for x in t.split("\n") if not x.encode().split() or line_hash(x.encode()) not in bad)
            out.append(t)
        return pd.Series(out, dtype=object)

    text = strip("doc.text", "frequent")
    return stored.join(verdicts, "row").select(*((text if c == "text" else F.col("doc").getField(c)).alias(c) for c in docs.columns))
