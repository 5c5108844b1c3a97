"""Removal of repeated phrases with Aho-Corasick automata.

Candidate blocks (see `repeats`) are dealt by anchor, which is the sharding: all places where a window of words can occur
again are in its anchor's shard. A task confirms the windows that recur among its distinct blocks, compiles them into an
automaton over word numbers, and streams the blocks through it to locate every occurrence. The earliest occurrence of
each window stays, the others go. Documents outside the shards hold no window twice, so nothing of them is left out. Anchors
with too many blocks for a task are cut into several shards, each with the windows that Spark's aggregation confirmed.
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
from .store import materialize
from .text import POWERS, POWERS_2, prefix_sums, span_hash, utf8, window_hash, words

#: Bytes of blocks that one automaton covers.
SHARD_BYTES = 2 << 20


def occurrences(sequence: list[int], windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, pattern): all places in a sequence of word numbers of the patterns that start at `windows` in it."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for k, at in enumerate(windows.tolist()):
        automaton.add_word(tuple(sequence[at : at + length]), k)
    automaton.make_automaton()
    found = np.fromiter((x for pair in automaton.iter(tuple(sequence)) for x in pair), np.int64).reshape(-1, 2)
    return found[:, 0] - (length - 1), found[:, 1]


def later_windows(texts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> list[np.ndarray]:
    """For the earliest occurrence of each distinct block: whether each of its windows also starts earlier.

    doc, start: where that occurrence stands, in the order that decides (documents by rank).
    """
    numbers: dict[bytes, int] = {}
    lists = [t.split(b" ") for t in texts]
    sequence: list[int] = []
    for some in lists:
        sequence.extend([numbers.setdefault(x, len(numbers) + 1) for x in some])
        sequence.append(0)
    sizes = np.array([len(x) for x in lists])
    first = np.cumsum(sizes + 1) - sizes - 1
    counts = sizes - length + 1
    place = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    block = np.repeat(np.arange(len(texts)), counts)
    keys = window_hash(np.array(sequence, np.uint64), length)[place]
    _, at, inverse, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    recurring = place[at[n > 1]]
    later = np.zeros(len(sequence), bool)
    if len(recurring):
        where, pattern = occurrences(sequence, recurring, length)
        owner = np.searchsorted(first, where, "right") - 1
        order = np.lexsort((start[owner] + where - first[owner], doc[owner], pattern))
        head = np.r_[True, pattern[order][1:] != pattern[order][:-1]]
        later[where[order[~head]]] = True
    return [later[a : a + k] for a, k in zip(first.tolist(), counts.tolist(), strict=True)]


def _located(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for table in grouped_chunks(batches, SHARD_BYTES):
        row, doc = np.asarray(table.column("row")), table.column("doc_id")
        known = np.asarray(doc.is_valid())
        ids = np.asarray(doc.fill_null(0))
        start, n = np.asarray(table.column("start")), np.asarray(table.column("windows"))
        order = np.lexsort((start, row, ids, ~known))  # null doc_ids come last
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        same_doc = np.r_[False, (row[order][1:] == row[order][:-1])]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(~same_doc)
        distinct: dict[bytes, int] = {}
        of = np.array([distinct.setdefault(t, len(distinct)) for t in table.column("block").to_pylist()])
        lead = np.full(len(distinct), len(order))
        np.minimum.at(lead, of, place)
        lead = order[lead]
        flags = later_windows(list(distinct), rank[lead], start[lead], length)
        rows, firsts, ends = [], [], []
        leads = np.zeros(len(of), bool)
        leads[lead] = True
        others = np.flatnonzero(~leads)
        rows.append(row[others])
        firsts.append(start[others])
        ends.append(start[others] + n[others])
        for k, f in zip(lead.tolist(), flags, strict=True):
            if f.any():
                a, b = stretches_of(f)
                rows.append(np.full(len(a), row[k]))
                firsts.append(start[k] + a)
                ends.append(start[k] + b)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (rows, firsts, ends)], ["row", "first", "end"])


def _located_in_shard(blocks_: pa.Table, patterns: pa.Table, length: int) -> pa.Table:
    """(row, first, end) of the places of confirmed windows in a shard's blocks, but for the earliest of each.

    blocks_: lead (struct with row and start), block. patterns: at (row, start of a block), k (a window of it), earliest. The
    windows' texts are read off the blocks, compiled into an automaton over word numbers, and all blocks stream through it.
    """
    import ahocorasick

    rows, firsts = [], []
    if patterns.num_rows:
        leads = blocks_.column("lead").to_pylist()
        numbers: dict[bytes, int] = {}
        sequences = [[numbers.setdefault(x, len(numbers) + 1) for x in t.split(b" ")] for t in blocks_.column("block").to_pylist()]
        place = {(x["row"], x["start"]): i for i, x in enumerate(leads)}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for at, k, earliest in zip(*(patterns.column(c).to_pylist() for c in ("at", "k", "earliest")), strict=True):
            some = sequences[place[at["row"], at["start"]]]
            automaton.add_word(tuple(some[k : k + length]), (earliest["row"], earliest["start"]))
        automaton.make_automaton()
        for lead, sequence in zip(leads, sequences, strict=True):
            for end, first in automaton.iter(tuple(sequence)):
                here = (lead["row"], lead["start"] + end - length + 1)
                if here != first:
                    rows.append(here[0])
                    firsts.append(here[1])
    first = pa.array(firsts, pa.int64())
    return pa.table({"row": pa.array(rows, pa.int64()), "first": first, "end": pa.compute.add(first, 1)})


def _hot_runs(hot: DataFrame, length: int) -> DataFrame:
    """(row, first, end) for anchors with more blocks than one task takes.

    All but the earliest occurrence of a block are removed as a whole. The windows of the earliest ones are confirmed by an
    aggregation that adds up before the shuffle, by 128-bit hashes; the blocks are dealt into shards of bounded size, each with
    one copy of every confirmed window that it holds, and an automaton locates them there. All but the earliest place of
    a window go.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = [], []
            for text in batch.column(2).to_pylist():
                raw = np.frombuffer(text, np.uint8)
                a, b, _ = words(raw, np.array([0, len(raw)]))
                for family, out in ((POWERS, first), (POWERS_2, second)):
                    out.append(window_hash(span_hash(prefix_sums(raw, family), a, b, family), length, family).view(np.int64))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first, kind), pa.array(second, kind)], ["shard", "lead", "x", "y"])

    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row", "start")
    hot = hot.withColumn("block_id", F.sha2("block", 256)).withColumn("at", order)
    lead = hot.groupBy("block_id").agg(F.min("at").alias("lead"), F.first("block").alias("block"))
    rest = hot.join(lead.select(F.col("block_id").alias("lead_id"), "lead"), (F.col("block_id") == F.col("lead_id")) & (F.col("at") != F.col("lead")))
    rest = rest.select("row", F.col("start").alias("first"), (F.col("start") + F.col("windows")).alias("end"))
    lead = materialize(lead, "hot-blocks")
    total = lead.agg(F.sum(F.length("block"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("block_id"), F.lit(total // SHARD_BYTES + 1)).alias("shard")
    dealt = lead.select(shard, "lead", "block")
    kind = "struct<unknown: boolean, doc_id: long, row: long, start: long>"
    windows = dealt.mapInArrow(hashes, f"shard long, lead {kind}, x array<long>, y array<long>").select("shard", "lead", F.posexplode(F.arrays_zip("x", "y")).alias("k", "z"))
    windows = windows.select("shard", "lead", "k", F.struct("lead.unknown", "lead.doc_id", "lead.row", (F.col("lead.start") + F.col("k")).alias("start")).alias("at"), "z.x", "z.y")
    earliest = windows.groupBy("x", "y").agg(F.min("at").alias("earliest"), F.count("*").alias("n")).filter("n > 1").select(F.col("x").alias("ex"), F.col("y").alias("ey"), "earliest")
    held = windows.groupBy("shard", "x", "y").agg(F.min(F.struct("lead", "k")).alias("one"))
    patterns = held.join(earliest, (F.col("x") == F.col("ex")) & (F.col("y") == F.col("ey"))).select("shard", F.col("one.lead").alias("at"), "one.k", "earliest")
    located = dealt.groupBy("shard").cogroup(patterns.groupBy("shard")).applyInArrow(lambda a, b: _located_in_shard(a, b, length), "row long, first long, end long")
    return rest.unionByName(located)


def remove_phrases(docs: DataFrame, length: int = 20, gram: int = 6) -> DataFrame:
    """(row, doc_id, n_words, n_removed, spans, kept, kept_sha256): words of windows of `length` words that start earlier go.

    Earlier: in a smaller doc_id (null last, equal ones by row), or before in the same row. spans: removed word ranges;
    kept: the remaining words joined by one space, null where nothing was removed. A null text has no words.
    An empty table gives no rows.
    """
    w = Windows(length, gram, True)
    rows, _ = with_rows(docs.select("doc_id", "text"))
    found = candidates(rows, w)
    dealt = blocks(found, w, False).repartition("h").sortWithinPartitions("h")
    runs = dealt.mapInArrow(lambda batches: _located(batches, length), "row long, first long, end long").unionByName(_hot_runs(blocks(found, w, True), length))
    by_row = runs.groupBy(F.col("row").alias("of_row")).agg(F.collect_list("first").alias("firsts"), F.collect_list("end").alias("ends"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column(1))
            spans, kept, digests = [], [], []
            for k, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                some = raw[off[k] : off[k + 1]].tobytes().split()
                gone = covered(np.array(a), np.array(b), length)
                left = b" ".join(x for i, j in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(some)], strict=True) for x in some[i:j])
                spans.append([{"start": int(s), "end": int(e)} for s, e in gone])
                kept.append(left.decode())
                digests.append(hashlib.sha256(left).hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(kept, pa.string()), pa.array(digests, pa.string())], ["cut_row", "spans", "kept", "cut_sha256"])

    schema = "cut_row long, spans array<struct<start: long, end: long>>, kept string, cut_sha256 string"
    cuts = found.join(by_row, F.col("row") == F.col("of_row")).select("row", "text", "firsts", "ends").mapInArrow(cut, schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column(2))
            lists = [raw[a:b].tobytes().split() for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in lists], pa.int64()), pa.array([hashlib.sha256(b" ".join(x)).hexdigest() for x in lists], pa.string())], ["row", "doc_id", "n_words", "sha256"])

    base = rows.mapInArrow(joined, "row long, doc_id long, n_words long, sha256 string")
    out = base.join(cuts, F.col("row") == F.col("cut_row"), "left").withColumn("kept_sha256", F.coalesce("cut_sha256", "sha256"))
    out = out.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start: long, end: long>>"))).drop("cut_row", "cut_sha256", "sha256")
    return out.withColumn("n_removed", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]))
