"""Exact removal of byte strings that occur more than once, by interval expansion on Burrows-Wheeler transforms.

Candidate blocks (see `repeats`) are dealt by anchor. A task joins some megabytes of distinct blocks, builds the suffix
array and the transform, and expands intervals breadth first by backward extension: after level l the right ends of the
intervals of all strings of up to l + 1 bytes are known, which are the places where neighbouring suffixes share l bytes
or fewer. It stops at the minimum length; suffixes not parted by then share that many bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Windows, blocks, candidates, covered, grouped_chunks, stretches_of, with_rows
from .text import POWERS, POWERS_2, utf8, window_hash

#: Bytes of blocks that one suffix array takes.
INDEX_BYTES = 3 << 20


#: Symbols whose order is found by one sort of 63-bit keys.
FIRST = 7


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes of symbols below 511, the end being smallest, and the keys of their first symbols in order.

    By prefix doubling from FIRST symbols on.
    """
    n = len(text)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(FIRST, np.int64)])
    key = padded[:n].copy()
    for k in range(1, FIRST):
        key = key << 9 | padded[k : n + k]
    order = np.argsort(key)
    first_keys = key[order]
    new = np.r_[True, first_keys[1:] != first_keys[:-1]]
    place = np.flatnonzero(new)[np.cumsum(new) - 1]  # a suffix's rank: the first place of its group
    rank = np.empty(n, np.int64)
    rank[order] = place
    done, depth = new & np.r_[new[1:], True], FIRST
    open_ = np.flatnonzero(~done)  # places in groups of two and more
    while len(open_):
        at = order[open_]
        follow = at + depth
        second = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        key = rank[at] * np.int64(n + 1) + second
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[open_] = at
        new = np.r_[True, key[1:] != key[:-1]]
        rank[at] = open_[np.flatnonzero(new)[np.cumsum(new) - 1]]
        open_ = open_[~(new & np.r_[new[1:], True])]
        depth *= 2
    return order, first_keys


def parted(text: np.ndarray, order: np.ndarray, first_keys: np.ndarray, length: int) -> np.ndarray:
    """Whether place k of the suffix order and the one before it differ in their first `length` symbols.

    Symbol 0 separates blocks and is never a part of an expanded string, so the answer holds for suffixes with `length`
    symbols before the next separator. Levels below FIRST are read off the sorted keys, the rest are expanded.
    """
    n = len(text)
    assert length >= FIRST
    bwt = text[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")  # place j of the first column comes from place by_symbol[j]
    to_first = np.empty(n, np.int32)
    to_first[by_symbol] = np.arange(n, dtype=np.int32)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    after, before = np.full(n, n, np.int32), np.full(n, -1, np.int32)  # nearest places with the same symbol
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    change = np.flatnonzero(first_keys[1:] != first_keys[:-1]) + 1
    ends = np.zeros(n + 1, bool)
    ends[change] = True
    ends[[0, n]] = True
    low, high = np.r_[0, change], np.r_[change, n]
    # to expand: strings of FIRST symbols whose right end no shorter string has, and without a separator
    key, following = first_keys[low] >> 9, np.r_[first_keys[change] >> 9, -1]
    clean = key == following
    for k in range(FIRST):
        clean &= (first_keys[low] >> (9 * k)) & 511 > 1
    low, high = low[clean], high[clean]
    for _ in range(FIRST, length):
        size = high - low
        which = np.repeat(np.arange(len(low)), size)
        at = np.arange(len(which)) + np.repeat(low - (np.cumsum(size) - size), size)
        live = bwt[at] != 0
        at, which = at[live], which[live]
        last = after[at] >= high[which]
        l_at, l_which = at[last], which[last]
        end = to_first[l_at].astype(np.int64) + 1
        fresh = ~ends[end]
        l_at, l_which, end = l_at[fresh], l_which[fresh], end[fresh]
        if not len(end):
            break
        ends[end] = True
        first = before[at] < low[which]
        f_key = which[first].astype(np.int64) << 9 | bwt[at[first]]
        by = np.argsort(f_key)
        begin = to_first[at[first][by]].astype(np.int64)
        low = begin[np.searchsorted(f_key[by], l_which.astype(np.int64) << 9 | bwt[l_at])]
        high = end
    return ends[:n]


def repeated_windows(texts: list[bytes], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each distinct block, whether each of its windows is found twice or more, blocks counted with their weights."""
    sizes = np.array([len(t) for t in texts])
    text = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).astype(np.uint16) + 1
    starts = np.cumsum(sizes + 1) - sizes - 1
    text[starts + sizes] = 0
    order, first_keys = suffix_array(text)
    group = np.cumsum(parted(text, order, first_keys, length))
    weight = np.zeros(len(text), np.int64)
    for s, n, k in zip(starts.tolist(), (sizes - length + 1).tolist(), weights.tolist(), strict=True):
        weight[s : s + n] = k
    total = np.bincount(group, weights=weight[order])
    again = np.empty(len(text), bool)
    again[order] = total[group] > 1
    return [again[s : s + n] for s, n in zip(starts.tolist(), (sizes - length + 1).tolist(), strict=True)]


def _indexed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for table in grouped_chunks(batches, INDEX_BYTES):
        distinct: dict[bytes, int] = {}
        of = np.array([distinct.setdefault(t, len(distinct)) for t in table.column("block").to_pylist()])
        flags = repeated_windows(list(distinct), np.bincount(of), length)
        spans = [stretches_of(f) for f in flags]
        counts = np.array([len(a) for a, _ in spans])[of]
        at = np.repeat(np.arange(len(of)), counts)
        row, start = np.asarray(table.column("row"))[at], np.asarray(table.column("start"))[at]
        a = np.concatenate([spans[k][0] for k in of.tolist()])
        b = np.concatenate([spans[k][1] for k in of.tolist()])
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(start + a), pa.array(start + b)], ["row", "first", "end"])


def _hot_runs(hot: DataFrame, length: int) -> DataFrame:
    """(row, first, end) for anchors with more blocks than one task takes: equal blocks are counted together, then windows.

    Both counts are Spark aggregations that add up before the shuffle; windows are told apart by 128-bit hashes.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second, kept = [], [], 0
            for text in batch.column(2).to_pylist():
                symbols = np.frombuffer(text, np.uint8)
                first.append(window_hash(symbols, length, POWERS).view(np.int64))
                second.append(window_hash(symbols, length, POWERS_2).view(np.int64))
                kept += 1
            kinds = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first, kinds), pa.array(second, kinds)], ["block_id", "weight", "x", "y"])

    hot = hot.withColumn("block_id", F.sha2("block", 256))
    distinct = hot.groupBy("block_id").agg(F.count("*").alias("weight"), F.first("block").alias("block")).select("block_id", "weight", "block")
    windows = distinct.mapInArrow(hashes, "block_id string, weight long, x array<long>, y array<long>").select("block_id", "weight", F.posexplode(F.arrays_zip("x", "y")).alias("at", "z"))
    windows = windows.select("block_id", "weight", "at", "z.x", "z.y")
    again = windows.groupBy("x", "y").agg(F.sum("weight").alias("n")).filter("n > 1").select(F.col("x").alias("rx"), F.col("y").alias("ry"))
    hits = windows.join(again, (F.col("x") == F.col("rx")) & (F.col("y") == F.col("ry"))).groupBy(F.col("block_id").alias("hit_id")).agg(F.collect_list("at").alias("at"))
    hits = hits.withColumn("at", F.array_sort("at"))
    # runs of consecutive window starts: a start without its predecessor begins one, one without its successor ends one
    begins = F.filter("at", lambda x, i: (i == 0) | (F.element_at("at", F.greatest(i, F.lit(1))) != x - 1))
    ends = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.element_at("at", F.least(i + 2, F.size("at"))) != x + 1))
    hits = hits.select("hit_id", F.arrays_zip(begins.alias("b"), ends.alias("e")).alias("runs"))
    out = hot.select("row", "start", "block_id").join(hits, F.col("block_id") == F.col("hit_id")).select("row", "start", F.explode("runs").alias("r"))
    return out.select("row", (F.col("start") + F.col("r.b")).alias("first"), (F.col("start") + F.col("r.e") + 1).alias("end"))


def repeated_spans(rows: DataFrame, length: int = 400, gram: int = 64) -> tuple[DataFrame, DataFrame]:
    """Candidates among stored (row, doc_id, text) and their runs (row, first, end) of repeated window starts."""
    w = Windows(length, gram, False)
    found = candidates(rows, w)
    dealt = blocks(found, w, False).repartition("h").sortWithinPartitions("h")
    cold = dealt.mapInArrow(lambda batches: _indexed(batches, length), "row long, first long, end long")
    return found, cold.unionByName(_hot_runs(blocks(found, w, True), length))


CUTS = "cut_row long, spans array<struct<start: long, end: long>>, kept_text string, cut_sha256 string"


def _cuts(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """CUTS of the rows that lose bytes: removed spans, the SHA-256 of the other bytes, and these as text."""
    found, runs = repeated_spans(rows, length, gram)
    by_row = runs.groupBy(F.col("row").alias("of_row")).agg(F.collect_list("first").alias("firsts"), F.collect_list("end").alias("ends"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column(1))
            spans, kept, digests = [], [], []
            for k, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                data = raw[off[k] : off[k + 1]].tobytes()
                gone = covered(np.array(a), np.array(b), length)
                parts = [data[i:j] for i, j in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(data)], strict=True)]
                spans.append([{"start": int(s), "end": int(e)} for s, e in gone])
                kept.append("".join(p.decode(errors="ignore") for p in parts))
                digests.append(hashlib.sha256(b"".join(parts)).hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(kept, pa.string()), pa.array(digests, pa.string())], ["cut_row", "spans", "kept_text", "cut_sha256"])

    return found.join(by_row, F.col("row") == F.col("of_row")).select("row", "text", "firsts", "ends").mapInArrow(cut, CUTS)


def remove_repeated(docs: DataFrame, length: int = 400, gram: int = 64) -> DataFrame:
    """(row, doc_id, n_bytes, spans, kept_sha256, text): every byte in a string of `length` bytes that also starts elsewhere is removed.

    spans: the removed byte ranges; kept_sha256: of the remaining bytes; text: these as text, without code points that were
    cut in two. A null text is empty. Equal rows are each other's copies. An empty table gives no rows.
    """
    rows, _ = with_rows(docs.select("doc_id", "text"))
    cuts = _cuts(rows, length, gram)
    text = F.coalesce("text", F.lit(""))
    base = rows.select("row", "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha256"), text.alias("text"))
    out = base.join(cuts, F.col("row") == F.col("cut_row"), "left").withColumn("kept_sha256", F.coalesce("cut_sha256", "sha256")).withColumn("text", F.coalesce("kept_text", "text"))
    return out.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start: long, end: long>>"))).drop("cut_row", "cut_sha256", "sha256", "kept_text")


def without_repeated(docs: DataFrame, length: int = 200, gram: int = 64) -> DataFrame:
    """docs with repeated byte strings cut out of `text`; code points cut in two go as a whole. All rows stay.

    n_chars, where it exists, is counted anew for texts that were cut. Null texts stay null, repeated rows are each other's
    copies, an empty table gives no rows.
    """
    rows, stored = with_rows(docs)
    cuts = _cuts(rows, length, gram).select("cut_row", "kept_text")
    joined = stored.join(cuts, F.col("row") == F.col("cut_row"), "left")
    new = {"text": F.coalesce("kept_text", "doc.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("kept_text").isNull(), F.col("doc.n_chars")).otherwise(F.char_length("kept_text").cast(docs.schema["n_chars"].dataType))
    return joined.select(*(new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))
