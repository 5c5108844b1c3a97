"""SimHash near-duplicates, found by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, local_stars
from .store import materialize, numbered
from .text import CHUNK_BYTES, slices, utf8

#: Distinct fingerprints up to which three segments (radius 1) are used; beyond, two segments (radius 2) keep buckets small.
THREE_SEGMENTS = 1 << 24
#: Fingerprints that a bucket may hold before its lookups are split among tasks, and pairs compared at once.
BUCKET_ROWS, PAIRS_AT_ONCE = 50_000, 1 << 21


def _fingerprint(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Majority bits of each row's hashes; a row without hashes gets 0."""
    out = np.zeros(n, np.uint64)
    if len(hashes):
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        size = np.diff(np.r_[first, len(hashes)])
        out[rows[first]] = np.packbits(2 * ones > size[:, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(rows: DataFrame, shingle: int = 4) -> DataFrame:
    """(row, doc_id, fp) of (row, doc_id, text): SimHash of XXH64 (seed 42) over lower-cased word shingles; null, empty or blank text: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = partial(xxhash.xxh64_intdigest, seed=42)
        for batch in batches:
            raw, off = utf8(batch.column(2))
            for i, j in slices(off, CHUNK_BYTES >> 1):
                hashes, rows = [], []
                for k in range(i, j):
                    found = raw[off[k] : off[k + 1]].tobytes().lower().split()
                    if not found:
                        continue
                    text = b" ".join(found)
                    at = np.zeros(len(found) + 1, np.int64)
                    np.cumsum([len(w) + 1 for w in found], out=at[1:])
                    at = at.tolist()
                    some = map(digest, [text[a : b - 1] for a, b in zip(at, at[shingle:], strict=False)]) if len(found) >= shingle else [digest(text)]
                    some = np.fromiter(some, np.uint64)
                    hashes.append(some)
                    rows.append(np.full(len(some), k - i))
                fp = _fingerprint(np.concatenate(hashes), np.concatenate(rows), j - i) if hashes else np.zeros(j - i, np.uint64)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:2], pa.array(fp.view(np.int64))], ["row", "doc_id", "fp"])

    return rows.mapInArrow(run, "row long, doc_id long, fp long")


def _segments(parts: int) -> list[tuple[int, int]]:
    """(shift, bits) of each segment of a fingerprint."""
    cuts = [round(64 * k / parts) for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _ball(bits: int, radius: int) -> list[int]:
    return [sum(1 << x for x in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def _lookups(value: Column, flips: Column, segment: int) -> Column:
    return F.transform(flips, lambda x: F.struct((value.bitwiseXOR(x) + F.lit(segment << 40)).alias("key"), (x == 0).alias("own")))


def probes(fps: DataFrame, max_bits: int, parts: int) -> DataFrame:
    """(key, own, fp): each fingerprint in its bucket of each segment (own), and in all buckets within the segment's radius.

    Of two fingerprints that differ in at most max_bits bits, some segment differs in at most max_bits // parts.
    """
    columns: list[Column] = []
    for k, (shift, bits) in enumerate(_segments(parts)):
        value = F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << bits) - 1))
        flips = F.array(*(F.lit(x).cast("long") for x in _ball(bits, max_bits // parts)))
        columns.append(_lookups(value, flips, k))
    return fps.select("fp", F.explode(F.concat(*columns)).alias("p")).select("p.key", "p.own", "fp")


def _verify(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Compare the probes of each bucket with the bucket's own fingerprints; emit stars that span the links found."""
    parts = [[np.asarray(c) for c in (b.column(0), b.column(1).cast(pa.int8()), b.column(2))] for b in batches if b.num_rows]
    if not parts:
        return
    key, own, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    fp = fp.view(np.uint64)
    order = np.argsort(key[own > 0], kind="stable")
    table_key, table = key[own > 0][order], fp[own > 0][order]
    low, high = np.searchsorted(table_key, key, "left"), np.searchsorted(table_key, key, "right")
    some = np.flatnonzero(high > low)
    low, size, fp = low[some], (high - low)[some], fp[some]
    ends = np.cumsum(size)
    left, right = [], []
    held, i = 0, 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS_AT_ONCE, "right")))
        n = size[i:j]
        a = np.repeat(fp[i:j], n)
        b = table[np.repeat(low[i:j] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        near = (np.bitwise_count(a ^ b) <= max_bits) & (a < b)
        left.append(a[near].view(np.int64))
        right.append(b[near].view(np.int64))
        held += int(near.sum())
        if held > PAIRS_AT_ONCE:
            x, y = local_stars(np.concatenate(left), np.concatenate(right))
            left, right, held = [x], [y], len(x)
        i = j
    if held:
        x, y = local_stars(np.concatenate(left), np.concatenate(right))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly those linked by chains of max_bits bits or fewer.

    Each task emits a spanning forest of the links that it verified, not all pairs of a group. A bucket with more than
    BUCKET_ROWS fingerprints is dealt over several tasks; its lookups go to each of them.
    """
    n = fps.count()
    all_ = probes(fps, max_bits, 3 if n <= THREE_SEGMENTS else 2)
    size = 3 if n <= THREE_SEGMENTS else 2
    hot = materialize(all_.filter("own").groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > BUCKET_ROWS), "hot-buckets")
    salted = all_.withColumn("salt", F.lit(0))
    if not hot.isEmpty():
        split = F.ceil(F.coalesce("rows", F.lit(1)) / BUCKET_ROWS).cast("int")
        spread = all_.join(hot.withColumnRenamed("key", "hot_key"), F.col("key") == F.col("hot_key"), "left").withColumn("split", split)
        table = spread.filter("own").withColumn("salt", F.pmod(F.hash("fp"), F.col("split")))
        # a table row is also the lookup of its own fingerprint in the other parts
        lookups = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("split") - 1))).withColumn("own", F.lit(False))
        salted = table.select("key", "own", "fp", "salt").unionByName(lookups.filter("own is not null").select("key", "own", "fp", "salt"))
    rows = n * size * len(_ball(_segments(size)[0][1], max_bits // size))
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // 1_000_000)
    dealt = salted.repartition(parts, "key", "salt").select("key", "own", "fp")
    return dealt.mapInArrow(lambda batches: _verify(batches, max_bits), "a long, b long")


def _labelled(rows: DataFrame, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """The stored (row, doc_id, fp), and (fp, best, component) of each distinct fingerprint; best: its first document."""
    stored = materialize(fingerprints(rows, shingle), "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("best")
    nodes = materialize(stored.groupBy("fp").agg(best), "distinct-fingerprints")
    found = components(links(nodes.select("fp"), max_bits))
    return stored, nodes.join(found, nodes.fp == found.node, "left").select("fp", "best", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(row, doc_id, fp, component_id, component) per document; component_id: the smallest doc_id that chains of links reach.

    Equal fingerprints are one node, whatever their number. Null doc_ids never are a component_id unless a component has
    no other. Repeated rows give repeated rows; an empty table gives none.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    stored, labelled = _labelled(rows, shingle, max_bits)
    lowest = labelled.groupBy("component").agg(F.min("best.doc_id").alias("component_id"))
    of_fp = labelled.drop("best").join(lowest, "component").select(F.col("fp").alias("node_fp"), "component_id", "component")
    return stored.join(of_fp, F.col("fp") == F.col("node_fp"), "left").drop("node_fp")


def without_near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (null last; equal ones by row).

    The row that stays is found by aggregation over fingerprints and then over components, so that no group's rows meet in one task.
    """
    all_ = numbered(docs)
    _, labelled = _labelled(all_.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text")), shingle, max_bits)
    stay = labelled.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.row").alias("stays"))
    return all_.join(stay, F.col("row") == F.col("stays"), "left_semi").select("doc.*")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
