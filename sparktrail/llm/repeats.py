"""Candidates for repeated windows of fixed length: an exact filter that both repeat removers share.

Every window of `length` symbols has an anchor: the smallest hash among its sub-windows of `gram` symbols. Equal windows
have equal anchors, so a window can only repeat if its anchor is found at two places at least. Windows that follow each
other mostly share an anchor, so a document has about one anchor per (length - gram) / 2 symbols.

A run is a maximal stretch of window starts with the same anchor; its block is the text that its windows cover. Each
window lies in exactly one block as a whole, and all blocks that can hold an equal window have the same anchor: blocks
grouped by anchor can be searched independently of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, numbered
from .text import CHUNK_BYTES, sliding_min, slices, utf8, window_hash, word_hashes, words

#: Blocks of one anchor up to which a single task compares them; beyond, windows are counted by Spark's own aggregation.
HOT_BLOCKS = 4096


@dataclass(frozen=True)
class Windows:
    length: int
    gram: int
    by_words: bool


@dataclass
class Stretch:
    """Consecutive symbols of rows first..last (or a part of one long row), with what is needed to cut text from them."""

    first: int
    off: np.ndarray  # offsets of the rows' symbols, relative to the stretch
    begin: int  # place of the stretch's first symbol in row `first`
    symbols: np.ndarray
    raw: np.ndarray
    start: np.ndarray | None  # byte bounds of words
    end: np.ndarray | None


def stretches(raw_all: np.ndarray, off_all: np.ndarray, w: Windows) -> Iterator[Stretch]:
    """Cut a batch into stretches of bounded size; parts of a long row overlap by length - 1 symbols."""
    for i, j in slices(off_all):
        raw, off = raw_all[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i]
        start = end = None
        if w.by_words:
            start, end, off = words(raw, off)
        n = int(off[-1])
        if j - i > 1 or n <= 2 * CHUNK_BYTES:
            yield Stretch(i, off, 0, word_hashes(raw, start, end) if w.by_words else raw, raw, start, end)
            continue
        for a in range(0, n, CHUNK_BYTES):
            b = min(n, a + CHUNK_BYTES + w.length - 1)
            if w.by_words:
                lo = start[a]
                part = raw[lo : end[b - 1]]
                s, e = start[a:b] - lo, end[a:b] - lo
                yield Stretch(i, np.array([0, b - a]), a, word_hashes(part, s, e), part, s, e)
            else:
                yield Stretch(i, np.array([0, b - a]), a, raw[a:b], raw[a:b], None, None)


def _anchors(x: Stretch, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes, each window's anchor, whether the window lies in one row, and the row of each symbol."""
    grams = window_hash(x.symbols, w.gram)
    anchor = sliding_min(grams, w.length - w.gram + 1)
    row = np.repeat(np.arange(len(x.off) - 1, dtype=np.int32), np.diff(x.off))
    return grams, anchor, row[: len(anchor)] == row[w.length - 1 : w.length - 1 + len(anchor)], row


def anchor_lists(x: Stretch, w: Windows) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of the anchors in it); a hash at two places or more of the row is listed twice."""
    grams, anchor, valid, row = _anchors(x, w)
    if not valid.any():
        return
    width = w.length - w.gram + 1
    low = np.where(valid, anchor, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    highest = ~sliding_min(~np.concatenate([pad, low, pad]), width)  # of the anchors of all windows that hold a gram
    at = np.flatnonzero((highest == grams) & (highest != 0))
    at_row = row[at]
    bounds = np.searchsorted(at_row, np.arange(len(x.off)))
    for k in range(len(x.off) - 1):
        if bounds[k] < bounds[k + 1]:
            some, counts = np.unique(grams[at[bounds[k] : bounds[k + 1]]], return_counts=True)
            yield x.first + k, np.concatenate([some, some[counts > 1]])


def runs(x: Stretch, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row (within the stretch), first window, end window and anchor of each run."""
    _, anchor, valid, row = _anchors(x, w)
    if not len(anchor):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1 : len(anchor)] != row[: len(anchor) - 1]) | (valid[1:] != valid[:-1])]
    first = np.flatnonzero(new)
    end = np.r_[first[1:], len(anchor)]
    good = valid[first]
    return row[first[good]], first[good], end[good], anchor[first[good]]


def with_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, text) and the stored (row, doc) that it reads: `row` tells apart rows with null or repeated doc_ids."""
    stored = numbered(docs)
    return stored.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text")), stored


def candidates(rows: DataFrame, w: Windows) -> DataFrame:
    """(row, doc_id, text, anchors array<struct<h, hot>>) of rows that may hold a repeated window; written once."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column(1))
            at, found = [], []
            for x in stretches(raw, off, w):
                for k, hashes in anchor_lists(x, w):
                    at.append(k)
                    found.append(hashes.view(np.int64))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.ListArray.from_arrays(pa.array(ends), values)], ["row", "hashes"])

    listed = materialize(rows.select("row", "text").mapInArrow(lists, "row long, hashes array<long>"), "anchors").select("row", F.explode("hashes").alias("h"))
    repeated = listed.groupBy("h").agg(F.count("*").alias("places")).filter("places > 1").select(F.col("h").alias("repeated"), (F.col("places") > HOT_BLOCKS).alias("hot"))
    found = listed.join(repeated, F.col("h") == F.col("repeated")).groupBy(F.col("row").alias("of_row")).agg(F.collect_set(F.struct("h", "hot")).alias("anchors"))
    return materialize(rows.join(found, F.col("row") == F.col("of_row")).drop("of_row"), "repeat-candidates")


BLOCKS = "h long, hot boolean, row long, doc_id long, start long, windows int, block binary"


def blocks(found: DataFrame, w: Windows, hot: bool) -> DataFrame:
    """The blocks of repeated anchors, hot ones or the others: block is bytes, or words joined by one space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw_all, off_all = utf8(batch.column(2))
            anchors = batch.column(3)
            flat, at = anchors.flatten(), np.r_[0, np.cumsum(np.asarray(anchors.value_lengths().fill_null(0)))]
            wanted = np.asarray(flat.field("h")).view(np.uint64)
            wanted_hot = np.asarray(flat.field("hot").cast(pa.int8())) > 0
            for x in stretches(raw_all, off_all, w):
                row, first, end, h = runs(x, w)
                keep = np.zeros(len(h), bool)
                bounds = np.searchsorted(row, np.arange(len(x.off)))
                for k in range(len(x.off) - 1):
                    i, j = at[x.first + k], at[x.first + k + 1]
                    some = wanted[i:j][wanted_hot[i:j] == hot]
                    if len(some):
                        keep[bounds[k] : bounds[k + 1]] = np.isin(h[bounds[k] : bounds[k + 1]], some)
                row, first, end, h = row[keep], first[keep], end[keep], h[keep]
                last = end + w.length - 1
                if w.by_words:
                    data = x.raw.tobytes()
                    texts = [b" ".join(data[a:b].split()) for a, b in zip(x.start[first].tolist(), x.end[last - 1].tolist(), strict=True)]
                else:
                    data = x.raw.tobytes()
                    texts = [data[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                src = pa.array(row.astype(np.int64) + x.first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(np.full(len(h), hot)), batch.column(0).take(src), batch.column(1).take(src), pa.array(first - x.off[row] + x.begin), pa.array((end - first).astype(np.int32)), pa.array(texts, pa.binary())],
                    [f.split()[0] for f in BLOCKS.split(", ")],
                )

    some = found.filter(F.exists("anchors", lambda a: a["hot"] == hot))  # mostly no row has a hot anchor
    return some.select("row", "doc_id", "text", "anchors").mapInArrow(cut, BLOCKS)


def grouped_chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows sorted by column h, in tables that hold whole anchors and about `limit` bytes of blocks."""
    held, size, last = [], 0, None
    for batch in batches:
        h = np.asarray(batch.column(0))
        lengths = np.asarray(pa.compute.binary_length(batch.column(6))).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        if len(h) and last is not None and h[0] == last:
            cuts = cuts[1:]
        begin = 0
        total = np.r_[0, np.cumsum(lengths)]
        for c in cuts.tolist():
            if size + total[c] - total[begin] >= limit:
                held.append(batch.slice(begin, c - begin))
                yield pa.Table.from_batches(held)
                held, size, begin = [], 0, c
        held.append(batch.slice(begin))
        size += int(total[-1] - total[begin])
        last = h[-1] if len(h) else last
    held = [b for b in held if b.num_rows]
    if held:
        yield pa.Table.from_batches(held)


def stretches_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)


def covered(starts: np.ndarray, ends: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Merged spans of symbols that windows with starts in [starts, ends) cover."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b - 1 + length)
        else:
            out.append([a, b - 1 + length])
    return [tuple(x) for x in out]
