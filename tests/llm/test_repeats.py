"""Quality rules, SimHash, suffix arrays and phrases against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from sparktrail.llm import components, near_copies, phrases, quality, repeats, simhash, store, suffix_array

from .corpus import SCHEMA, documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(row):
    return (row[0] is None, row[0] or 0)


@pytest.mark.parametrize("extra", [False, True])
def test_base_statistics(spark, extra):
    got = sorted(map(tuple, quality.quality_rules(frame(spark, extra=extra)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=repr)
    want = []
    for doc_id, text, *_ in documents():
        text = text or ""
        words = WORD.findall(text)
        seen, dups = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dups += line in seen
                seen.add(line)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        n = Counter(windows)
        again = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(8)}
        symbols = sum(text.count(c) for c in "#*$%&|<>")
        want.append((doc_id, len(words), sum(map(len, words)), symbols, dups, len(again), len(words) < 20 or 100 * len(again) > 30 * len(words)))
    assert got == sorted(want, key=repr)


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    own = lambda i: " ".join(f"u{i}x{k}" for k in range(30))
    rows = [(i, f"Shared  LINE here\n{own(i)}", "en", "a", 1) for i in range(12)] + [(100 + i, f"{own(i + 50)}\nshared line here", "en", "b", 1) for i in range(3)]
    rows.append((200, "shared line here\n" + "\n".join(["shared LINE here"] * 20), "en", "a", 1))
    docs = frame(spark, rows)
    out = {r["doc_id"]: r for r in quality.quality_rules(docs, min_docs=5, fraction=0.1).collect()}
    assert all(out[i]["removed_words"] == 3 and out[i]["kept"] for i in range(12))
    assert all(out[100 + i]["removed_words"] == 0 for i in range(3))  # few documents of host b have it
    assert out[200]["depleted"] and not out[200]["kept"]
    text = {r["doc_id"]: r["text"] for r in quality.without_frequent_lines(docs, min_docs=5, fraction=0.1).collect()}
    assert text[3] == own(3) and 200 not in text and "shared line here" in text[101]


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(fps, ids, bits=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(fps))]


@pytest.mark.parametrize("hot", [50_000, 1])
def test_simhash_components(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", hot)
    rows = documents(90, seed=4)
    got = simhash.near_duplicates(frame(spark, rows, extra=True)).select("doc_id", simhash.hex_fingerprint(simhash.F.col("fp")), "component_id").collect()
    fps = [fingerprint(r[1]) for r in rows]
    want = [(r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, components_of(fps, [r[0] for r in rows]), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("parts", [3, 2])
def test_links_are_exact_on_dense_fingerprints(spark, monkeypatch, parts):
    if parts == 2:
        monkeypatch.setattr(simhash, "THREE_SEGMENTS", 0)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 12, np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(12):
            for k in rng.choice(64, rng.integers(1, 8), replace=False).tolist():
                b ^= 1 << k
            fps.add(b)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    from sparktrail.llm.components import components

    got = {r["node"] % (1 << 64): r["component"] for r in components(simhash.links(df)).collect()}
    want = components_of(fps, list(range(len(fps))))
    groups = Counter(want)
    for i, f in enumerate(fps):
        for j in range(i):
            if groups[want[i]] > 1 and groups[want[j]] > 1:
                assert (got[f] == got[fps[j]]) == (want[i] == want[j])
        assert groups[want[i]] > 1 or f not in got


def test_one_of_each_group_stays(spark):
    rows = [(i, "alpha beta gamma delta epsilon zeta " * 9, "en", "a", 1) for i in range(7)] + [(50, "quite another text with its own words", "en", "a", 1)]
    kept = simhash.without_near_duplicates(frame(spark, [*rows, rows[0]], extra=True))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 50]
    assert "component" in kept.columns


def jaccard_components(rows, shingle=5, similarity=0.8):
    sets = []
    for r in rows:
        words = (r[1] or "").encode().lower().split()
        sets.append({tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1)} if len(words) >= shingle else {tuple(words)} - {()})
    low = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y) and low[i] != low[j]:
                low = [min(low[i], low[j]) if v in (low[i], low[j]) else v for v in low]
    return low


def near_copy_rows(seed):
    rng = np.random.default_rng(seed)
    texts = [None, "", " \n", "one", "One ", "two words", "a b c d e", "A  b c d e"]
    for size in (30, 60, 200, 900):
        for _ in range(12):
            words = [f"w{x}" for x in rng.integers(0, 5000, size)]
            texts.append(" ".join(words))
            for share in (0.01, 0.02, 0.03, 0.05):  # of words changed; similarities from about 0.6 to 0.95
                texts.append(" ".join(f"v{i}" if rng.random() < share else w for i, w in enumerate(words)))
    return [(i, t, "en", "a", 1) for i, t in enumerate(texts)] + [(None, texts[-1], "en", "a", 1), (3, "one", "en", "a", 1)]


@pytest.mark.parametrize(("bucket", "table", "shingles"), [(50_000, 200_000, 4_000_000), (3, 5, 2_000)])
def test_near_copies_are_those_of_brute_force(spark, monkeypatch, bucket, table, shingles):
    monkeypatch.setattr(near_copies, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(near_copies, "TABLE_ROWS", table)
    monkeypatch.setattr(near_copies, "GROUP_SHINGLES", shingles)
    rows = near_copy_rows(7)
    docs = frame(spark, rows, partitions=1)
    stored = docs.collect()
    found = near_copies.near_copies(docs).orderBy("row").collect()
    assert [r["doc_id"] for r in found] == [r["doc_id"] for r in stored]
    groups = [Counter(), Counter()]
    number = {}
    for r, low in zip(found, jaccard_components(stored), strict=True):
        assert number.setdefault(r["component"], low) == low
        groups[0][r["component"]] += 1
        groups[1][low] += 1
    assert sorted(groups[0].values()) == sorted(groups[1].values())


def test_wide_fingerprints_have_majority_bits():
    rng = np.random.default_rng(2)
    keys, at = rng.integers(0, 2**64, 1300, np.uint64), np.array([0, 0, 1, 3, 260, 1300])
    got = near_copies.wide_fingerprints(keys, at, 128)
    for k in range(2):
        hashes = near_copies.mix(keys ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)).tolist()
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            want = sum(1 << x for x in range(64) if 2 * sum(h >> x & 1 for h in hashes[a:b]) > b - a)
            assert got[i, 8 * k : 8 * k + 8].tobytes() == want.to_bytes(8, "little")


@pytest.mark.parametrize("documents", [1_000, 1 << 21, 1 << 40])
def test_layouts_miss_one_of_a_hundred_pairs_at_most(documents):
    x = near_copies.layout(documents, 0.8)
    p = np.arccos(1.6 / 1.8) / np.pi
    hit = (1 - p) ** x.segment + x.segment * p * (1 - p) ** (x.segment - 1)
    assert (1 - hit) ** x.segments <= 0.01 and x.bits % 64 == 0 and x.segments < 256


def test_long_fingerprints_carry_256_bits(spark):
    x = near_copies.Layout(320, 20, 3)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 256, (3, 40), np.uint8)
    near, far = base.copy(), base.copy()
    near[:, 3] ^= 1  # within the bits that are compared
    near[:, 39] ^= 255  # beyond them
    far[:, 5:9] ^= 0x55
    fps = [r.tobytes() for r in np.concatenate([base, near, far])]
    found = {tuple(sorted((r["a"], r["b"]))) for r in near_copies.matches(spark.createDataFrame(list(enumerate(fps)), "node long, fp binary"), x).collect()}
    assert found == {(0, 3), (1, 4), (2, 5)}


def test_every_close_pair_of_fingerprints_is_matched(spark):
    rng = np.random.default_rng(4)
    x = near_copies.Layout(64, 16, 6)
    base = rng.integers(0, 2**64, 40, np.uint64)
    fps = [int(b) for b in base]
    for b in base.tolist():
        for _ in range(5):
            fps.append(b ^ sum(1 << int(k) for k in set(rng.integers(0, 64, 5))))
    rows = spark.createDataFrame([(i, f.to_bytes(8, "little")) for i, f in enumerate(fps)], "node long, fp binary")
    found = {(r["a"], r["b"]) for r in near_copies.matches(rows, x).collect()}
    label = list(range(len(fps)))
    for a, b in found:
        label = [min(label[a], label[b]) if v in (label[a], label[b]) else v for v in label]
    want = list(range(len(fps)))
    for i, f in enumerate(fps):
        for j in range(i):
            d = f ^ fps[j]
            if d.bit_count() <= 6 and min((d >> s & 0xFFFF).bit_count() for s in (0, 16, 32, 48)) <= 1:
                want = [min(want[i], want[j]) if v in (want[i], want[j]) else v for v in want]
    assert label == want


def test_pipeline_drops_near_copies_of_similarity_over_0_8(spark):
    import corpus_pipeline

    rows = near_copy_rows(8)
    kept = corpus_pipeline.near_duplicates_out(spark, frame(spark, rows, extra=True), "")
    want = {}
    for r, low in zip(rows, jaccard_components(rows), strict=True):
        want.setdefault(low, r[0])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want.values())
    assert "component" in kept.columns and near_copies.without_near_copies(frame(spark, []).limit(0)).count() == 0


def removed_bytes(rows, length):
    count = Counter()
    data = [(r[1] or "").encode() for r in rows]
    for b in data:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for r, b in zip(rows, data, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.sum(gone & ~np.r_[False, gone[:-1]]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((r[0], len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot,chunk,part", [(4096, 3 << 20, 1 << 19), (0, 3 << 20, 1 << 19), (4096, 600, 1 << 19), (4096, 3 << 20, 700)])
def test_repeated_bytes(spark, monkeypatch, hot, chunk, part):
    monkeypatch.setattr(repeats, "HOT_BLOCKS", hot)
    monkeypatch.setattr(suffix_array, "INDEX_BYTES", chunk)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", part)
    rows = documents(60, seed=7)
    got = suffix_array.remove_repeated(frame(spark, rows, extra=True), length=120, gram=32).select("doc_id", "n_bytes", "spans", "kept_sha256", "text").collect()
    assert sum(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in got) >= len(got) - 5  # but for code points cut in two
    got = [(r[0], r[1], sum(s["end"] - s["start"] for s in r[2]), len(r[2]), r[3]) for r in got]
    assert sorted(got, key=repr) == removed_bytes(rows, 120)


def test_repeated_bytes_are_cut_from_texts(spark):
    rows = documents(60, seed=7)
    out = suffix_array.without_repeated(frame(spark, rows, extra=True), length=120, gram=32)
    assert out.count() == len(rows)
    texts = [r["text"] for r in out.collect()]
    want = {h for *_, h in removed_bytes(rows, 120)}
    whole = sum(hashlib.sha256((t or "").encode()).hexdigest() in want for t in texts)
    assert whole >= len(rows) - 5  # but for code points cut in two


def removed_words(rows, length):
    order = sorted(range(len(rows)), key=lambda i: (*key(rows[i]), i))
    seen, out = set(), []
    for i in order:
        words = (rows[i][1] or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - length + 1):
            w = tuple(words[k : k + length])
            if w in seen:
                gone[k : k + length] = [True] * length
            seen.add(w)
        out.append((rows[i][0], len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot,chunk,part", [(4096, 2 << 20, 1 << 19), (0, 2 << 20, 1 << 19), (0, 900, 1 << 19), (4096, 300, 1 << 19), (4096, 2 << 20, 300)])
def test_repeated_phrases(spark, monkeypatch, hot, chunk, part):
    monkeypatch.setattr(repeats, "HOT_BLOCKS", hot)
    monkeypatch.setattr(phrases, "SHARD_BYTES", chunk)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", part)
    rows = documents(60, seed=9)
    got = phrases.remove_phrases(frame(spark, rows, extra=True)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == removed_words(rows, 20)


@pytest.mark.parametrize("name", ["bytes", "texts", "phrases", "copies", "simhash", "lines"])
def test_results_do_not_depend_on_how_files_are_split(spark, monkeypatch, name):
    """The settings that cut files into splits change before every table that an operator writes."""
    rows = documents(80, seed=11)
    docs = frame(spark, rows, partitions=9)
    run = {
        "bytes": lambda: suffix_array.remove_repeated(docs, length=120, gram=32).drop("row"),
        "texts": lambda: suffix_array.without_repeated(docs, length=120, gram=32),
        "phrases": lambda: phrases.remove_phrases(docs).drop("row", "cut_row"),
        "copies": lambda: near_copies.without_near_copies(docs),
        "simhash": lambda: simhash.without_near_duplicates(docs),
        "lines": lambda: quality.without_frequent_lines(docs),
    }[name]
    want = sorted(map(repr, run().collect()))
    written, sizes = store.materialize, [1, 1 << 27, 3000, 1 << 20]

    def unsettled(df, label):
        found = written(df, label)
        sizes.append(sizes.pop(0))
        spark.conf.set("spark.sql.files.maxPartitionBytes", sizes[0])
        spark.conf.set("spark.sql.files.openCostInBytes", sizes[1])
        return found

    for module in (store, repeats, near_copies, simhash, quality, components):
        monkeypatch.setattr(module, "materialize", unsettled)
    try:
        assert sorted(map(repr, run().collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for out in (quality.quality_rules(empty), simhash.near_duplicates(empty), simhash.without_near_duplicates(empty), suffix_array.remove_repeated(empty), suffix_array.without_repeated(empty), phrases.remove_phrases(empty)):
        assert out.count() == 0
