"""Near copies by the Jaccard similarity of word shingles: wide SimHash, multi-index hashing, exact verification.

The fingerprint is cut into segments. Two documents are a match if some segment differs in one bit at most and the
fingerprints in no more than a pair of the wanted similarity may. Of a segment that differs in one bit, one half is the same
in both: fingerprints are dealt by half segments, and a task enumerates the Hamming ball of the other half, fetches what the
table holds there and compares whole fingerprints. Chains of matches are groups; within a group shingle sets are compared
exactly, and chains of pairs of the wanted similarity are the near copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, local_stars
from .store import materialize, numbered
from .text import mix, slices, utf8, window_hash, word_hashes, words

#: Probability of missing a pair at the very threshold that the number of segments is chosen for.
MISS = 0.01
#: Fingerprints that a half segment's table may hold before it is split among tasks; tables looked up and pairs compared at once.
BUCKET_ROWS, TABLE_ROWS, PAIRS_AT_ONCE = 50_000, 200_000, 1 << 18
#: Shingles of one group's sets that a task compares; a larger group is cut into slices, and tasks compare pairs of slices.
GROUP_SHINGLES = 4_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Each byte's bits in eight lanes of a byte, so that one addition counts eight of them.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").ravel()


@dataclass(frozen=True)
class Layout:
    """Fingerprints of `bits`, cut into segments of `segment` bits, that match if their first `compared` bits differ in
    `distance` at most. Those bits are all of a fingerprint of up to 256, and enough to tell texts apart of a longer one,
    whose segments only serve to find it: what a row carries doesn't grow.
    """

    bits: int
    segment: int
    distance: int

    @property
    def segments(self) -> int:
        return self.bits // self.segment

    @property
    def compared(self) -> int:
        return min(self.bits, 256)

    @property
    def half(self) -> int:
        return self.segment // 2


def layout(documents: int, similarity: float) -> Layout:
    """By one rule for all sizes: a segment value is shared by 16 of so many documents at most, as chance has it; so many
    segments that a pair at the threshold is missed with a probability of MISS or less; a distance of four deviations more
    than such a pair's mean.

    Sets of the Jaccard similarity s have fingerprints whose bits differ with probability arccos(2 s / (1 + s)) / pi.
    """
    segment = next(b for b in (16, 20, 24, 28, 32) if documents <= 16 << b or b == 32)
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    hit = (1 - p) ** segment + segment * p * (1 - p) ** (segment - 1)
    bits = -(-math.ceil(math.log(MISS) / math.log1p(-hit)) * segment // 64) * 64
    compared = min(bits, 256)
    return Layout(bits, segment, math.ceil(compared * p + 4 * math.sqrt(compared * p * (1 - p))))


def shingle_sets(raw: np.ndarray, off: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct shingles of lower-cased words, and the n + 1 offsets of the rows.

    A row of fewer words has one shingle of all of them; one without words has none.
    """
    raw = _LOWER[raw]
    start, end, first = words(raw, off)
    hashes, count = word_hashes(raw, start, end), np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    keys = window_hash(hashes, shingle)
    inside = row[: len(keys)] == row[shingle - 1 : shingle - 1 + len(keys)] if len(keys) else np.zeros(0, bool)
    keys, rows = keys[inside], row[: len(keys)][inside]
    short = np.flatnonzero((count > 0) & (count < shingle))
    if len(short):
        whole = [window_hash(hashes[first[i] : first[i + 1]], int(count[i]))[0] ^ np.uint64(count[i]) for i in short]
        keys, rows = np.concatenate([keys, mix(np.array(whole, np.uint64))]), np.concatenate([rows, short])
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    keys, rows = keys[new], rows[new]
    return keys, np.searchsorted(rows, np.arange(len(count) + 1))


def wide_fingerprints(keys: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """SimHash of each row's keys, rows x bits / 8 bytes: a bit is 1 if set in over half the hashes."""
    out = np.zeros((len(at) - 1, bits // 8), np.uint8)
    size = np.diff(at)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    pieces = -(-size[some] // 255)  # lanes of a byte count up to 255
    first = np.cumsum(pieces) - pieces
    begin = np.repeat(at[:-1][some], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    for k in range(bits // 64):
        hashes = mix(keys ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
        lanes = np.add.reduceat(_LANES[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)], begin, axis=0)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(len(begin), 64), first, axis=0, dtype=np.int64)
        out[some, 8 * k : 8 * k + 8] = np.packbits(2 * ones > size[some][:, None], axis=1, bitorder="little")
    return out


SIGNATURE = "row long, doc_id long, n long, k1 long, k2 long, fp binary"


def _signatures(batches: Iterator[pa.RecordBatch], shingle: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The number of shingles, a 128-bit key of their set, and the fingerprint of each document."""
    for batch in batches:
        raw, off = utf8(batch.column(2))
        for i, j in slices(off):
            keys, at = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], shingle)
            some = np.flatnonzero(np.diff(at))
            sums = np.zeros((2, j - i), np.uint64)
            for k in range(2):
                if len(some):
                    sums[k, some] = np.add.reduceat(mix(keys ^ np.uint64(0xC2B2AE3D27D4EB4F * (k + 1) & (1 << 64) - 1)), at[:-1][some])
            fp = wide_fingerprints(keys, at, bits)
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(np.diff(at)), *(pa.array(x.view(np.int64)) for x in sums), pa.array([r.tobytes() for r in fp], pa.binary())], [f.split()[0] for f in SIGNATURE.split(", ")])


def _matrix(column: pa.Array, bits: int) -> np.ndarray:
    """The fingerprints of a batch as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, bits // 64)


def _codes(fp: np.ndarray, x: Layout) -> np.ndarray:
    """For each half segment of each fingerprint: segment, half, that half's bits, and the other half's as lowest bits."""
    bits = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")[:, : x.segments * x.segment].reshape(len(fp), x.segments, x.segment)
    value = bits.astype(np.int64) @ (np.int64(1) << np.arange(x.segment, dtype=np.int64))
    low, high = value & ((1 << x.half) - 1), value >> x.half
    place = np.arange(x.segments, dtype=np.int64) << (x.segment + 1)
    return np.stack([place + (high << x.half | low), place + (1 << x.segment) + (low << x.half | high)], axis=2).reshape(len(fp), -1)


def _halves(batches: Iterator[pa.RecordBatch], x: Layout) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            part = batch.slice(i, 2048)
            whole = _matrix(part.column(1), x.bits)
            codes, carried = _codes(whole, x), np.ascontiguousarray(whole[:, : x.compared // 64])
            at = pa.array(np.repeat(np.arange(part.num_rows), codes.shape[1]))
            flat = codes.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(flat >> x.half), pa.array(flat), part.column(0).take(at), pa.array([r.tobytes() for r in carried], pa.binary()).take(at)], ["key", "code", "node", "fp"])


def _bucket_keys(batches: Iterator[pa.RecordBatch], x: Layout) -> Iterator[pa.RecordBatch]:
    """(key, n): how many fingerprints of a batch each half segment's table gets."""
    for batch in batches:
        for i in range(0, batch.num_rows, 8192):
            keys, n = np.unique(_codes(_matrix(batch.slice(i, 8192).column(0), x.bits), x) >> x.half, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])


class _Matches:
    """Looks fingerprints up in tables; keeps the stars that span the matches found."""

    def __init__(self, x: Layout):
        self.x, self.left, self.right, self.held = x, [], [], 0

    def _compare(self, a_fp: np.ndarray, a: np.ndarray, b_fp: np.ndarray, b: np.ndarray, low: np.ndarray, size: np.ndarray) -> None:
        """Distances of lookups a to the `size` table rows from `low` on."""
        some = np.flatnonzero(size > 0)
        low, size, a, a_fp = low[some], size[some], a[some], a_fp[some]
        ends, i = np.cumsum(size), 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS_AT_ONCE, "right")))
            n = size[i:j]
            left = np.repeat(np.arange(i, j), n)
            right = np.repeat(low[i:j] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            far = np.bitwise_count(a_fp[left] ^ b_fp[right]).sum(axis=1, dtype=np.int32)
            near = (far <= self.x.distance) & (a[left] != b[right])
            if near.any():
                self.left.append(a[left[near]])
                self.right.append(b[right[near]])
                self.held += int(near.sum())
                if self.held > 1 << 21:
                    self._compact()
            i = j

    def _compact(self) -> None:
        a, b = local_stars(np.concatenate(self.left), np.concatenate(self.right))
        self.left, self.right, self.held = [a], [b], len(a)

    def table(self, code: np.ndarray, node: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(code, kind="stable")
        return code[order], node[order], fp[order]

    def within(self, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """All matches among a table's own rows; each flip is looked up from the side whose bit is 0."""
        code, node, fp = table
        first_half = np.flatnonzero((code >> self.x.segment) & 1 == 0)  # equal segments are compared once
        self._compare(fp[first_half], node[first_half], fp, node, first_half + 1, np.searchsorted(code, code[first_half], "right") - first_half - 1)
        for k in range(self.x.half):
            at = np.flatnonzero(code >> k & 1 == 0)
            flipped = code[at] | (1 << k)
            low = np.searchsorted(code, flipped, "left")
            self._compare(fp[at], node[at], fp, node, low, np.searchsorted(code, flipped, "right") - low)

    def lookups(self, table: tuple[np.ndarray, np.ndarray, np.ndarray], code: np.ndarray, node: np.ndarray, fp: np.ndarray) -> None:
        """All matches of other rows with a table's."""
        t_code, t_node, t_fp = table
        for f in (0, *(1 << k for k in range(self.x.half))):
            low = np.searchsorted(t_code, code ^ f, "left")
            self._compare(fp, node, t_fp, t_node, low, np.searchsorted(t_code, code ^ f, "right") - low)

    def stars(self) -> pa.RecordBatch:
        if self.held:
            self._compact()
        a, b = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in (self.left, self.right))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _matched(batches: Iterator[pa.RecordBatch], x: Layout) -> Iterator[pa.RecordBatch]:
    """Stars (a, b) of matches; rows come sorted by (key, part, lookup), so a table stands before its lookups."""
    found = _Matches(x)
    held: list[tuple] = []  # rows of tables: key, code, node, fp
    rows = 0
    last = None  # the table that lookups refer to, by the number of rows it was made from
    for batch in batches:
        key, code, node = (np.asarray(batch.column(k)) for k in range(3))
        fp = _matrix(batch.column(3), x.compared)
        own = ~np.asarray(batch.column(4).cast(pa.int8())).astype(bool)
        if own.any():
            if rows > TABLE_ROWS:  # all but the key at hand are complete
                many = [np.concatenate(c) for c in zip(*held, strict=True)]
                open_ = many[0] == many[0][-1]
                found.within(found.table(*(c[~open_] for c in many[1:])))
                held, rows = [tuple(c[open_] for c in many)], int(open_.sum())
            held.append((key[own], code[own], node[own], fp[own]))
            rows += int(own.sum())
        if not own.all():
            if last is None or last[0] != rows:
                many = [np.concatenate(c) for c in zip(*held, strict=True)]
                last = (rows, found.table(*many[1:]))
            found.lookups(last[1], code[~own], node[~own], fp[~own])
    if held:
        many = [np.concatenate(c) for c in zip(*held, strict=True)]
        found.within(found.table(*many[1:]))
    yield found.stars()


def matches(nodes: DataFrame, x: Layout) -> DataFrame:
    """Stars (a, b) that span the matches among (node, fp).

    A table with more than BUCKET_ROWS fingerprints is dealt over several tasks; each fingerprint is looked up in the
    parts after its own.
    """
    counts = nodes.select("fp").mapInArrow(lambda batches: _bucket_keys(batches, x), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    hot = materialize(counts.filter(F.col("n") > BUCKET_ROWS), "hot-halves")
    rows = nodes.select("node", "fp").mapInArrow(lambda batches: _halves(batches, x), "key long, code long, node long, fp binary")
    if hot.isEmpty():
        dealt = rows.withColumn("part", F.lit(0)).withColumn("lookup", F.lit(False))
    else:
        split = F.ceil(F.coalesce("n", F.lit(1)) / BUCKET_ROWS).cast("int")
        spread = rows.join(hot.withColumnRenamed("key", "hot_key"), F.col("key") == F.col("hot_key"), "left").withColumn("split", split)
        spread = spread.withColumn("own", F.pmod(F.xxhash64("node"), F.col("split").cast("long")).cast("int"))
        spread = spread.withColumn("part", F.explode(F.sequence(F.col("own"), F.col("split") - 1)))
        dealt = spread.withColumn("lookup", F.col("part") != F.col("own"))
    total = nodes.count() * 2 * x.segments
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 500_000)
    dealt = dealt.repartition(parts, "key", "part").sortWithinPartitions("key", "part", "lookup").select("key", "code", "node", "fp", "lookup")
    return dealt.mapInArrow(lambda batches: _matched(batches, x), "a long, b long")


def similar_stars(keys: np.ndarray, at: np.ndarray, group: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of one group that connect exactly those linked by chains of pairs of this Jaccard similarity or more.

    Each set is compared, by the postings of its keys, only with those that no chain has reached yet.
    """
    size = np.diff(at)
    of = np.repeat(np.arange(len(size)), size)
    _, ids, count = np.unique(mix(keys ^ mix(group.astype(np.uint64))[of]), return_inverse=True, return_counts=True)
    shared = count[ids] > 1
    ids, of = ids[shared], of[shared]
    own = np.searchsorted(of, np.arange(len(size) + 1))
    by = np.argsort(ids, kind="stable")
    sets, start = of[by], np.searchsorted(ids[by], np.arange(len(count) + 1))
    reached, left, right, open_rows = np.zeros(len(size), bool), [], [], len(by)
    for first in range(len(size)):
        if reached[first]:
            continue
        reached[first] = True
        queue = [first]
        while queue:
            i = queue.pop()
            mine = ids[own[i] : own[i + 1]]
            n = start[mine + 1] - start[mine]
            others = sets[np.repeat(start[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            others = others[~reached[others]]
            if not len(others):
                continue
            others, common = np.unique(others, return_counts=True)
            near = others[common >= similarity * (size[i] + size[others] - common) - 1e-9]
            if len(near):
                reached[near] = True
                left.append(np.full(len(near), i))
                right.append(near)
                queue.extend(near.tolist())
                if 2 * int(n.sum()) > open_rows // max(1, len(size)) and (gone := reached[sets]).mean() > 0.5:
                    by_key = np.repeat(np.arange(len(start) - 1), np.diff(start))[~gone]
                    sets, start = sets[~gone], np.searchsorted(by_key, np.arange(len(start)))
                    open_rows = len(sets)
    return tuple(np.concatenate(s) if s else np.zeros(0, np.int64) for s in (left, right))


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(component, node, keys): the shingle sets of texts, as 64-bit numbers."""
    for batch in batches:
        raw, off = utf8(batch.column(2))
        for i, j in slices(off):
            keys, at = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], shingle)
            sets = pa.array([keys[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:2], sets], ["component", "node", "keys"])


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Stars (a, b) of near copies; rows come sorted by block, whole blocks are compared some millions of shingles at a time."""

    def compare(held: list[tuple]) -> pa.RecordBatch:
        block, node = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        sets = [s for h in held for s in h[2]]
        at = np.concatenate([[0], np.cumsum([len(s) // 8 for s in sets])])
        a, b = similar_stars(np.frombuffer(b"".join(sets), np.uint64), at, block, similarity)
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    held, size = [], 0
    for batch in batches:
        block, node, sets = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2).to_pylist()
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist() if len(block) else []
        if held and len(block) and held[-1][0][-1] == block[0]:
            cuts = cuts[1:]
        begin = 0
        for c in [*cuts, len(block)]:
            if c < len(block) and size + sum(map(len, sets[begin:c])) >= GROUP_SHINGLES * 2 and (held or c > begin):
                held.append((block[begin:c], node[begin:c], sets[begin:c]))
                yield compare([h for h in held if len(h[0])])
                held, size, begin = [], 0, c
        held.append((block[begin:], node[begin:], sets[begin:]))
        size += sum(map(len, sets[begin:]))
    held = [h for h in held if len(h[0])]
    if held:
        yield compare(held)


def _exact(rows: DataFrame, loose: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Stars (a, b) of near copies within the groups (node, component)."""
    texts = rows.select(F.col("row"), "text").join(loose, F.col("row") == F.col("node")).select("component", "node", "text")
    sets = materialize(texts.mapInArrow(lambda batches: _sets(batches, shingle), "component long, node long, keys binary"), "shingle-sets")
    sizes = sets.groupBy(F.col("component").alias("of")).agg((F.sum(F.octet_length("keys")) / 8).alias("shingles"))
    large = materialize(sizes.filter(F.col("shingles") > GROUP_SHINGLES), "large-groups")
    if large.isEmpty():
        blocks = sets.select(F.xxhash64("component").alias("block"), "node", "keys")
    else:
        k = F.ceil(F.coalesce("shingles", F.lit(1)) / (GROUP_SHINGLES / 2)).cast("int")
        cut = sets.join(large, F.col("component") == F.col("of"), "left").withColumn("k", k)
        cut = cut.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("k").cast("long")).cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        cut = cut.filter((F.col("k") == 1) | (F.col("other") != F.col("mine")))  # a slice meets itself with every other slice
        blocks = cut.select(F.xxhash64("component", F.least("mine", "other"), F.greatest("mine", "other")).alias("block"), "node", "keys")
    dealt = blocks.repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(lambda batches: _verified(batches, similarity), "a long, b long")


def _labelled(rows: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and (n, k1, k2, best, component) of each distinct shingle set; best: its first document."""
    x = layout(rows.count(), similarity)
    signed = materialize(rows.select("row", "doc_id", "text").mapInArrow(lambda batches: _signatures(batches, shingle, x.bits), SIGNATURE), "signatures")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("best")
    nodes = materialize(signed.groupBy("n", "k1", "k2").agg(F.min("row").alias("node"), best, F.min("fp").alias("fp")), "distinct-sets")
    loose = components(matches(nodes.filter("n > 0").select("node", "fp"), x))
    near = components(_exact(rows, materialize(loose, "matched"), shingle, similarity)).select(F.col("node").alias("labelled"), "component")
    return signed, nodes.join(near, F.col("node") == F.col("labelled"), "left").select("n", "k1", "k2", "best", F.coalesce("component", "node").alias("component"))


def _rows(stored: DataFrame) -> DataFrame:
    return stored.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"))


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row, doc_id, component) per document: chains of pairs whose sets of shingles have this Jaccard similarity or more.

    Every link is exact; one at the threshold is found with a probability of 0.99 or more, and more similar ones almost
    surely. Equal sets are one node; texts without words (null, empty) are copies of one another. Repeated rows are
    copies; an empty table gives no rows.
    """
    signed, labelled = _labelled(_rows(numbered(docs, "doc_id", "text")), shingle, similarity)
    return signed.select("row", "doc_id", "n", "k1", "k2").join(labelled.drop("best"), ["n", "k1", "k2"]).select("row", "doc_id", "component")


def without_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (null last; equal ones by row).

    The row that stays is found by aggregation over sets and then over components, so that no group's rows meet in one task.
    """
    stored = numbered(docs)
    _, labelled = _labelled(_rows(stored), shingle, similarity)
    stay = labelled.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.row").alias("stays"))
    return stored.join(stay, F.col("row") == F.col("stays"), "left_semi").select("doc.*")
