"""Periodic runs of words, by Main and Lorentz's divide and conquer on interned word ids.

A run is a maximal stretch of words whose smallest period p fills it several times. A range of words is halved; Z-functions
of both halves, read from the middle, tell for every period how far a repetition reaches to either side of the middle, so
all repetitions that cross it are found in linear time. Repetitions that go on beyond the range are left to the range above,
which finds them whole; equal intervals are kept once, with their smallest period.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import stretches_of
from .text import mix, slices, utf8, window_hash, word_hashes, words

Run = tuple[int, int, int]  # start, length, period

#: Changes the words of a document before it is searched: (doc_id, number of words) to the place of each word, or None.
Rewrite = Callable[[int | None, int], np.ndarray | None]


def z_values(s: list[int], upto: int) -> list[int]:
    """For each place i in 1..upto - 1, how many symbols s[i:] and s share at their beginnings; at 0, nothing is counted."""
    s = [*s, -2]
    z = [0] * max(upto, 1)
    left = right = 0
    for i in range(1, upto):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while s[k] == s[i + k]:
            k += 1
        if k:
            z[i] = k
            left, right = i, i + k
    return z


def _crossing(u: list[int], v: list[int], least: int, times: int) -> Iterator[Run]:
    """Repetitions around the middle of u + v, starts relative to the middle: at least `least` symbols and `times` periods."""
    most = (len(u) + len(v)) // times
    to_right, to_left = min(most, len(v)), min(most, len(u))
    back = u[::-1]
    # back from the middle: in u itself, and from p symbols right of the middle; then the same the other way
    z_back = np.array(z_values([*back, -1, *v[:to_right][::-1], *back], len(u) + 1 + to_right))
    z_on = np.array(z_values([*v, -1, *u[len(u) - to_left :], *v], len(v) + 1 + to_left))
    p = np.arange(1, to_right + 1)
    before, after = z_back[len(u) + 1 + to_right - p], np.where(p < len(v), z_on[np.minimum(p, len(v))], 0)
    long = np.flatnonzero(before + p + after >= np.maximum(least, times * p))
    yield from zip((-before[long]).tolist(), (before + p + after)[long].tolist(), p[long].tolist(), strict=True)
    p = np.arange(1, to_left + 1)
    before, after = np.where(p < len(u), z_back[np.minimum(p, len(u))], 0), z_on[len(v) + 1 + to_left - p]
    long = np.flatnonzero(before + p + after >= np.maximum(least, times * p))
    yield from zip((-p - before)[long].tolist(), (before + p + after)[long].tolist(), p[long].tolist(), strict=True)


def find_runs(ids: list[int], least: int = 24, times: int = 3) -> list[Run]:
    """All runs of at least `least` symbols and `times` (2 or more) periods, by start and period."""
    n = len(ids)
    found: dict[tuple[int, int], int] = {}
    ranges = [(0, n)]
    while ranges:
        low, high = ranges.pop()
        if high - low < max(least, times):
            continue
        middle = (low + high) // 2
        ranges += [(low, middle), (middle, high)]
        for at, length, p in _crossing(ids[low:middle], ids[middle:high], least, times):
            a, b = middle + at, middle + at + length
            if a and a == low and ids[a - 1] == ids[a - 1 + p] or b < n and b == high and ids[b] == ids[b - p]:
                continue
            found[a, b] = min(p, found.get((a, b), p))
    return sorted((a, b - a, p) for (a, b), p in found.items())


def _in_repeated(hashes: np.ndarray, row: np.ndarray, width: int, times: int) -> np.ndarray:
    """Whether each word lies in a window of `width` words that is found `times` times or more in its row."""
    inside = np.zeros(len(hashes) + 1, np.int64)
    keys = window_hash(hashes, width)
    if len(keys):
        at = np.flatnonzero(row[: len(keys)] == row[width - 1 :])
        keys = mix(keys[at] + mix(row[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(keys)
        head = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]]) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.r_[head, len(keys)])
        at = at[order[np.repeat(size >= times, size)]]
        np.add.at(inside, at, 1)
        np.add.at(inside, at + width, -1)
    return np.cumsum(inside)[:-1] > 0


def regions(hashes: np.ndarray, row: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int]]:
    """Stretches of words outside which no run can be.

    A run of n >= least words with period p <= n / times agrees with itself p places on in n - p words, and 2p places on
    (for three periods or more) in n - 2p. So each of its words lies in a window of the least such length that is found
    twice, and in one found three times; hashes only ever add to the words kept.
    """
    short = least // times  # the longest period for which `least` is what bounds the length
    some = np.ones(len(hashes), bool)
    for n in range(min(times, 3), 1, -1):
        if some.any():
            some &= _in_repeated(hashes, row, min(least - (n - 1) * short, (times - n + 1) * (short + 1)), n)
    for a, b in zip(*stretches_of(some), strict=True):
        cuts = a + 1 + np.flatnonzero(row[a + 1 : b] != row[a : b - 1])
        for i, j in zip([a, *cuts.tolist()], [*cuts.tolist(), b], strict=True):
            if j - i >= least:
                yield int(i), int(j)


FOUND = "n_words long, runs array<struct<start: long, length: long, period: long>>, top struct<start: long, length: long, period: long>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _top(runs: list[Run]) -> Run | None:
    """The run of the greatest exponent; of equal ones the first, then that of the smaller period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _searched(batches: Iterator[pa.RecordBatch], least: int, times: int, rewrite: Rewrite | None) -> Iterator[pa.RecordBatch]:
    """Adds FOUND to batches whose last two columns are doc_id and text, in their place."""
    for batch in batches:
        raw_all, off_all = utf8(batch.column(batch.num_columns - 1))
        ids_all = batch.column(batch.num_columns - 2).to_pylist()
        for i, j in slices(off_all):
            raw, off = raw_all[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i]
            data = raw.tobytes()
            start, end, first = words(raw, off)
            count = np.diff(first)
            place = np.arange(len(start))
            moved = set()
            for k in range(j - i) if rewrite else ():
                if (to := rewrite(ids_all[i + k], int(count[k]))) is not None:
                    place[first[k] : first[k + 1]] = first[k] + to
                    moved.add(k)
            row = np.repeat(np.arange(j - i), count)
            found: dict[int, list[Run]] = {}
            for a, b in regions(word_hashes(raw, start, end)[place], row, least, times):
                numbers: dict[bytes, int] = {}
                at = place[a:b]
                ids = [numbers.setdefault(data[x:y], len(numbers)) for x, y in zip(start[at].tolist(), end[at].tolist(), strict=True)]
                if runs := find_runs(ids, least, times):
                    k = int(row[a])
                    found.setdefault(k, []).extend((a - int(first[k]) + s, n, p) for s, n, p in runs)
            texts = []
            for k in range(j - i):
                if k in found or k in moved:
                    keep = np.ones(count[k], bool)
                    for s, n, p in found.get(k, ()):
                        keep[s + p : s + n] = False
                    at = place[first[k] : first[k + 1]][keep]
                    texts.append(b" ".join([data[x:y] for x, y in zip(start[at].tolist(), end[at].tolist(), strict=True)]).decode())
                else:
                    texts.append(b" ".join(data[off[k] : off[k + 1]].split()).decode())
            lists = [sorted(found.get(k, [])) for k in range(j - i)]
            as_row = lambda x: x and dict(zip(("start", "length", "period"), x, strict=True))
            columns = [pa.array(count, pa.int64()), pa.array([[as_row(x) for x in some] for some in lists], pa.list_(_RUN)), pa.array([as_row(_top(some)) for some in lists], _RUN), pa.array(texts, pa.string())]
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], *columns], [*part.schema.names[:-2], "n_words", "runs", "top", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc_id, n_words, runs, top, collapsed) of every document, in one pass without a shuffle.

    runs: struct<start, length, period> of every run of at least `least` words and `times` periods, by start and period, in
    words numbered from 0; top: the run with the greatest length / period (ties: first start, then smaller period), null
    without runs; collapsed: the words joined by one space without those that a run holds beyond its first period.
    Null and empty texts have no words and no runs; repeated rows and null ids are documents like others; an empty table
    gives no rows; other columns don't matter, whatever their names. rewrite: may move the words of a document first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda batches: _searched(batches, least, times, rewrite), f"doc_id long, {FOUND}")


def without_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """docs with every run cut to its first period, in the texts that have one; these have their words joined by one space.

    Texts without a run, and null ones, stay as they are; n_chars, where it exists, is counted anew for texts that were cut.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"), F.lit(0).cast("long").alias("id"), F.col("text").cast("string"))
    found = rows.mapInArrow(lambda batches: _searched(batches, least, times, None), f"document {rows.schema['document'].dataType.simpleString()}, {FOUND}")
    cut = F.size("runs") > 0
    new = {"text": F.when(cut, F.col("collapsed")).otherwise(F.col("document.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.char_length("collapsed").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("document.n_chars"))
    return found.select(*(new.get(c, F.col("document").getField(c)).alias(c) for c in docs.columns))
