"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Large-item matching on a histogram: piece lengths are integers up to the capacity, so the whole packing problem is a
table of at most `capacity` counts. Pieces above one third of the capacity are paired greedily (longest first, with the
longest partner that fits; never more than two in a sequence), smaller ones then go, longest first, to the tightest
remaining gap. The plan says which ranks of which length go to which sequences; ranks are found by Spark.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import buckets_for, running_total
from .store import materialize
from .tokenizer import ByteBpe


def pieces(docs: DataFrame, tokenizer: ByteBpe, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids, if kept).

    A document is its token ids and end_id; a null or empty text is just end_id. Only documents longer than the
    capacity are cut; then the first piece takes the remainder. Null and repeated doc_ids are kept as they are.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_of, rows, kept = batch.column(0).to_pylist(), [], []
            for doc_id, text in zip(ids_of, batch.column(1), strict=True):
                ids = np.append(tokenizer.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                bounds = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                    if keep_ids:
                        kept.append(ids[a:b].astype(np.int32))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays, names = [*arrays, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, ranks, first sequence, offset): rank r of a length goes to sequence first + r - first rank."""
    left, used, plan, gaps, bins = dict(counts), dict.fromkeys(counts, 0), [], {}, 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        plan.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    open_gaps: list[int] = []

    def add_gap(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(open_gaps, gap)
            gaps[gap].append((first, n))

    large = sorted(x for x in counts if 3 * x > capacity)
    for x in reversed(large):
        while left[x]:
            fits = [y for y in large[: bisect_left(large, min(x, capacity - x) + 1)] if left[y] and (y != x or left[x] > 1)]
            y = fits[-1] if fits else None
            n = left[x] if y is None else left[x] // 2 if x == y else min(left[x], left[y])
            put(x, n, bins, 0)
            if y is not None:
                put(y, n, bins, x)
            add_gap(capacity - x - (y or 0), bins, n)
            bins += n
    for x in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        while left[x]:
            at = bisect_left(open_gaps, x)
            if at < len(open_gaps):
                gap = open_gaps[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    open_gaps.pop(at)
            else:
                gap, n = capacity, max(1, left[x] // (capacity // x))
                first, bins = bins, bins + n
            each = gap // x
            if left[x] < each * n:  # some sequences take `each`, one the rest, the others none
                each, full = (each, left[x] // each) if left[x] >= each else (left[x], 1)
                add_gap(gap, first + full, n - full)
                n = full
            for k in range(each):
                put(x, n, first, capacity - gap + k * x)
            add_gap(gap - each * x, first, n)
    return plan


def pack(pieces_: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to rows with length, doc_id, piece, start, ids_crc32.

    Only the histogram of lengths (at most `capacity` rows) comes to the driver. Equal lengths are interchangeable, so
    any rank order gives the same sequences; a frequent length is ranked by many tasks. An empty table gives no rows.
    """
    spark = pieces_.sparkSession
    counts = {r["length"]: r["n"] for r in pieces_.groupBy("length").agg(F.count("*").alias("n")).collect()}
    by_length: dict[int, list] = {}
    for length, first_rank, _, first, offset in plan_bins(counts, capacity):
        by_length.setdefault(length, []).append((first_rank, first, offset))
    rows = [(k, *map(list, zip(*v, strict=True))) for k, v in by_length.items()]
    plan = spark.createDataFrame(rows, "plan_length long, ranks array<long>, firsts array<long>, offsets array<long>")
    keyed = pieces_.withColumn("pack_key", F.xxhash64("doc_id", "piece", "start", "ids_crc32"))
    order = ["pack_key", "doc_id", "piece", "start"]
    ranked = running_total(keyed, "length", order, F.lit(1), buckets_for(sum(counts.values())), "pack_rank")
    at = F.size(F.filter("ranks", lambda r: r <= F.col("pack_rank")))
    return (
        ranked.join(F.broadcast(plan), F.col("length") == F.col("plan_length"))  # at most `capacity` rows
        .withColumn("at", at)
        .withColumn("sequence_id", F.element_at("firsts", F.col("at")) + F.col("pack_rank") - F.element_at("ranks", F.col("at")))
        .withColumn("offset", F.element_at("offsets", F.col("at")))
        .drop("pack_key", "pack_rank", "plan_length", "ranks", "firsts", "offsets", "at")
    )


def pack_documents(docs: DataFrame, tokenizer: ByteBpe | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise once (the small piece rows are written to the shared folder) and pack."""
    return pack(materialize(pieces(docs, tokenizer or ByteBpe(), capacity, end_id), "pieces"), capacity)
