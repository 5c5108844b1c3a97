"""Spelling variants: words that differ by one inserted, deleted or replaced letter, grouped under the most frequent form.

The vocabulary is cut into shards of bounded size, each a compact trie. Shards are broadcast, as many at a time as a fixed
number of bytes allows, and each word's Levenshtein automaton of distance one is intersected with every shard depth first: a
branch that has spent its edit is followed to its end before the word's own path goes on. Tries of neighbouring words share
few beginnings with other words, so most words leave most shards after a letter or two.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .text import utf8

#: Words of the vocabulary in one trie, and bytes of tries that are broadcast at a time.
SHARD_WORDS, PASS_BYTES = 50_000, 32 << 20
#: Words whose automata are stepped through a trie together.
BLOCK_WORDS = 2048
#: Distinct words that a counting task holds before it passes them on.
HELD_WORDS = 300_000


def _letters(least: int) -> re.Pattern:
    return re.compile("[a-zÀ-ÿ]{%d,}" % least)


def count_words(docs: DataFrame, least_length: int = 6, least_count: int = 5, drop_every: int = 0) -> DataFrame:
    """(word, n): maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF; only A-Z lower-cased) and their number, over all texts.

    drop_every: if it divides the crc32 of `<doc_id>:<run>`, that run loses the letter at crc32 % length in that document
    (rows without an id lose none). Then words shorter than least_length or rarer than least_count are left out. Null texts
    have no words, repeated rows count each time, an empty table gives no rows. Tasks add up before the shuffle.
    """
    pattern = _letters(least_length)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            raw, off = utf8(batch.column(1))
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                found = Counter(pattern.findall(raw[off[k] : off[k + 1]].tobytes().lower().decode()))
                if drop_every and doc_id is not None:
                    prefix = zlib.crc32(f"{doc_id}:".encode())
                    dropped = [(w, h) for w in found if (h := zlib.crc32(w.encode(), prefix)) % drop_every == 0]
                    changed: Counter[str] = Counter()
                    for w, h in dropped:
                        at = h % len(w)
                        n = found.pop(w)
                        if len(w) > least_length:
                            changed[w[:at] + w[at + 1 :]] += n
                    found.update(changed)
                for w, n in found.items():
                    total[w] += n
                if len(total) > HELD_WORDS:
                    yield out()
                    total.clear()
        if total:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("text is not null")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


@dataclass
class Trie:
    """Nodes in breadth-first order, the root first: children of a node stand together, in the order of their letters.

    keys: parent << 8 | letter of nodes 1, 2, ...; word: a node's place in the sorted words, or -1; begin: each node's first
    child (n + 1 numbers). Letters are code points up to U+00FF, one byte each.
    """

    keys: np.ndarray
    word: np.ndarray
    begin: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, words: list[bytes], counts: np.ndarray) -> Trie:
        """Of distinct words in ascending order."""
        length = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(length) - length
        letters = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        node, live = np.zeros(len(words), np.int64), np.arange(len(words))
        keys, ends, nodes, depth = [], [], 1, 0
        while len(live):
            done = length[live] == depth
            ends.append(np.stack([node[live[done]], live[done]]))
            live = live[~done]
            key = node[live] << 8 | letters[start[live] + depth]
            new = np.r_[True, key[1:] != key[:-1]][: len(key)]
            keys.append(key[new])
            node[live] = nodes - 1 + np.cumsum(new)
            nodes += len(keys[-1])
            depth += 1
        word = np.full(nodes, -1, np.int32)
        at, which = np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), np.int64)
        word[at] = which
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        return cls(keys, word, np.searchsorted(keys >> 8, np.arange(nodes + 1)) + 1, np.asarray(counts, np.int64))

    def packed(self) -> bytes:
        """Letters and numbers of children instead of keys: some six bytes a node."""
        few = np.diff(self.begin)
        return b"".join(x.tobytes() for x in (np.array([len(self.word), len(self.counts)]), (self.keys & 255).astype(np.uint8), few.astype(np.uint8), self.word, self.counts))

    @classmethod
    def unpacked(cls, data: bytes) -> Trie:
        n, words = np.frombuffer(data, np.int64, 2).tolist()
        letters = np.frombuffer(data, np.uint8, n - 1, 16).astype(np.int64)
        few = np.frombuffer(data, np.uint8, n, 16 + n - 1)
        word = np.frombuffer(data, np.int32, n, 16 + 2 * n - 1)
        counts = np.frombuffer(data, np.int64, words, 16 + 6 * n - 1)
        begin = np.r_[1, 1 + np.cumsum(few, dtype=np.int64)]
        return cls(np.repeat(np.arange(n), few) << 8 | letters, word, begin, counts)

    def spelt(self, places: np.ndarray) -> list[bytes]:
        """The words at these places, read off the way up to the root."""
        node_of = np.zeros(len(self.counts), np.int64)
        ends = np.flatnonzero(self.word >= 0)
        node_of[self.word[ends]] = ends
        out = []
        for node in node_of[places].tolist():
            letters = bytearray()
            while node:
                key = int(self.keys[node - 1])
                letters.append(key & 255)
                node = key >> 8
            out.append(bytes(letters[::-1]))
        return out

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The children by these letters, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(node), -1)
        key = node << 8 | letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at + 1, -1)


def neighbours(trie: Trie, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(place in `words`, place in the trie) of all pairs at distance one, each once.

    State (i, 0) of an automaton has read i letters and the trie's own path has read the same. From there the one edit is a
    letter of the trie in place of letter i, one put in before it (another than letter i, else the same word arises by
    putting it in later), or letter i left out (only the last of equal letters in a row). State (i, 1) must read the rest.
    """
    length = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(length) - length
    letters = np.append(np.frombuffer(b"".join(words), np.uint8).astype(np.int64), -1)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def follow(who: np.ndarray, node: np.ndarray, i: np.ndarray) -> None:
        """States that have spent their edit, to their ends."""
        while len(who):
            ended = i == length[who]
            hit = trie.word[node[ended]]
            found.append((who[ended][hit >= 0], hit[hit >= 0]))
            who, node, i = who[~ended], node[~ended], i[~ended]
            node = trie.child(node, letters[start[who] + i])
            live = node >= 0
            who, node, i = who[live], node[live], i[live] + 1

    who, node, depth = np.arange(len(words)), np.zeros(len(words), np.int64), 0
    while len(who):
        left = length[who] - depth
        here = np.where(left > 0, letters[np.minimum(start[who] + depth, len(letters) - 1)], -1)
        after = np.where(left > 1, letters[np.minimum(start[who] + depth + 1, len(letters) - 1)], -1)
        drop = (left > 0) & (here != after)
        follow(who[drop], node[drop], np.full(np.count_nonzero(drop), depth + 1))
        few = trie.begin[node + 1] - trie.begin[node]
        at = np.repeat(np.arange(len(who)), few)
        child = np.arange(len(at)) - np.repeat(np.cumsum(few) - few, few) + np.repeat(trie.begin[node], few)
        other = (trie.keys[child - 1] & 255) != here[at]
        at, child = at[other], child[other]
        follow(who[at], child, np.full(len(at), depth))
        put = left[at] > 0
        follow(who[at[put]], child[put], np.full(np.count_nonzero(put), depth + 1))
        on = np.flatnonzero(left > 0)
        node = trie.child(node[on], here[on])
        who, node, depth = who[on][node >= 0], node[node >= 0], depth + 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]).astype(np.int64)


def _sorted_shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Tries of at most `most` words each from words in ascending order."""
    words: list[bytes] = []
    counts: list[int] = []

    def out() -> pa.RecordBatch:
        data = Trie.of(words, np.array(counts, np.int64)).packed()
        return pa.RecordBatch.from_arrays([pa.array([words[0].decode("latin-1")]), pa.array([data], pa.binary()), pa.array([len(data)], pa.int64())], ["first_word", "trie", "bytes"])

    for batch in batches:
        for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.append(w.encode("latin-1"))
            counts.append(n)
            if len(words) == most:
                yield out()
                words.clear()
                counts.clear()
    if words:
        yield out()


def shards(vocabulary: DataFrame, words: int, most: int = SHARD_WORDS) -> DataFrame:
    """(first_word, trie, bytes) of a vocabulary of so many distinct words: ranges of words, of at most `most` each."""
    dealt = vocabulary.repartitionByRange(max(1, -(-words // most)), "word").sortWithinPartitions("word")
    return dealt.select("word", "n").mapInArrow(lambda batches: _sorted_shards(batches, most), "first_word string, trie binary, bytes long")


FOUND = "word string, n_near long, form_n long, form string"


def _searched(batches: Iterator[pa.RecordBatch], tries: list[Trie]) -> Iterator[pa.RecordBatch]:
    """FOUND of words that have neighbours in these tries, which are in the order of their words."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK_WORDS):
            column = batch.column(0).slice(i, BLOCK_WORDS)
            words = [w.encode("latin-1") for w in column.to_pylist()]
            near, best_n, best = np.zeros(len(words), np.int64), np.full(len(words), -1), np.full((len(words), 2), -1)
            for k, trie in enumerate(tries):
                who, place = neighbours(trie, words)
                if not len(who):
                    continue
                near += np.bincount(who, minlength=len(words))
                n = trie.counts[place]
                order = np.lexsort((place, -n, who))
                head = order[np.r_[True, who[order][1:] != who[order][:-1]]]
                better = head[n[head] > best_n[who[head]]]  # of equal ones the earlier trie has the smaller word
                best_n[who[better]] = n[better]
                best[who[better]] = np.stack([np.full(len(better), k), place[better]], axis=1)
            hit = np.flatnonzero(near)
            form = np.empty(len(words), object)
            for k in np.unique(best[hit, 0]).tolist():
                at = hit[best[hit, 0] == k]
                form[at] = [w.decode("latin-1") for w in tries[k].spelt(best[at, 1])]
            yield pa.RecordBatch.from_arrays([column.take(pa.array(hit)), pa.array(near[hit]), pa.array(best_n[hit]), pa.array(form[hit].tolist(), pa.string())], ["word", "n_near", "form_n", "form"])


def near_words(vocabulary: DataFrame, shard_words: int = SHARD_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """FOUND per word of a stored vocabulary (word, n) that has words at distance one: their number, and the most frequent
    of them (ties: the smallest). Words must be distinct and of letters up to U+00FF.

    Tries are written, then broadcast in passes of at most `pass_bytes` (one at least); each pass looks every word up and
    writes a row per word that has neighbours there, never pairs. Passes are added up at the end.
    """
    spark = vocabulary.sparkSession
    words = vocabulary.count()
    tries = materialize(shards(vocabulary, words, shard_words), "tries")
    sizes = tries.select("first_word", "bytes").orderBy("first_word").collect()  # a row per `shard_words` words
    passes, room = [], 0
    for r in sizes:
        if not passes or room + r["bytes"] > pass_bytes:
            passes.append([])
            room = 0
        passes[-1].append(r["first_word"])
        room += r["bytes"]
    parts = []
    for some in passes:
        rows = tries.filter(F.col("first_word").between(some[0], some[-1])).select("first_word", "trie").collect()
        shared = spark.sparkContext.broadcast([bytes(r["trie"]) for r in sorted(rows, key=lambda r: r["first_word"])])  # at most pass_bytes
        dealt = vocabulary.select("word").repartition(max(spark.sparkContext.defaultParallelism, words // 20_000), F.xxhash64("word"))

        def look_up(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from _searched(batches, [Trie.unpacked(x) for x in shared.value])

        parts.append(materialize(dealt.mapInArrow(look_up, FOUND), "near-words"))
        shared.destroy()
    if not parts:
        return spark.createDataFrame([], FOUND)
    out = parts[0].withColumn("turn", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("turn", F.lit(k)))
    # of equally frequent ones the earlier pass has the smaller word
    best = F.max_by(F.struct("form", "form_n"), F.struct("form_n", -F.col("turn")))
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.form_n", "b.form")


def group_variants(vocabulary: DataFrame, ratio: float = 5, **limits) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n).

    form: the near word of largest n (ties: the smallest in code point order), if that is at least `ratio` (over 1) times
    the word's n, else null, and form_n its n. root: the end of the chain of forms, the word itself without one. A
    vocabulary of no words gives no rows. Each step of a chain multiplies n, so a fixed number of doublings reaches all ends.
    """
    vocabulary = materialize(vocabulary.select("word", "n"), "vocabulary")
    near = near_words(vocabulary, **limits).select(F.col("word").alias("near_word"), "n_near", "form_n", "form")
    joined = vocabulary.join(near, F.col("word") == F.col("near_word"), "left").drop("near_word")
    has = F.col("form_n") >= F.lit(ratio) * F.col("n")
    joined = joined.withColumns({"form": F.when(has, F.col("form")), "form_n": F.when(has, F.col("form_n")), "n_near": F.coalesce("n_near", F.lit(0)).cast("long")})
    out = materialize(joined.withColumn("root", F.coalesce("form", "word")), "forms")
    most, least = out.agg(F.max("n"), F.min("n")).first()
    steps, n = 0, float(least or 1)
    while n * ratio <= (most or 0):
        n *= ratio
        steps += 1
    reach = 1
    while reach < steps:
        ends = out.select(F.col("word").alias("at"), F.col("root").alias("next")).filter(F.col("at") != F.col("next"))
        out = out.join(ends, F.col("root") == F.col("at"), "left").withColumn("root", F.coalesce("next", "root")).drop("at", "next")
        out = materialize(out, "roots")
        reach *= 2
    return out.select("word", "form", "root", "n", "n_near", "form_n")
