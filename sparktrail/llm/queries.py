"""The numbered queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    out = quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    out = pack_documents(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_fingerprint, near_duplicates

    out = near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_encoded_again")


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_array import remove_repeated

    out = remove_repeated(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "text")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxic_scores

    return toxic_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import remove_phrases

    return remove_phrases(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .classifier import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import search

    return search(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import count_words, group_variants

    return group_variants(count_words(_table(spark, sf_dir, "documents"), drop_every=199))


#: The rules that op12's contract names.
URL_RULES = "allow org/, block example.org/es/, block example.org/en/1, allow com/fr/, block com/de/"


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import filter_urls, rules

    out = filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules(URL_RULES))
    return out.select("page.page_id", "host", "path", "rule", "verdict", "score")


def _looped(doc_id: int | None, n: int):
    """The places of a document's words where every tenth document gets a periodic tail (null ids: none)."""
    import zlib

    import numpy as np

    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import periodic_runs

    out = periodic_runs(_table(spark, sf_dir, "documents"), least=24, times=3, rewrite=_looped)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_packing": op2_packing,
        "op3_simhash": op3_simhash,
        "op4_token_counts": op4_token_counts,
        "op5_suffix_array": op5_suffix_array,
        "op6_mixing": op6_mixing,
        "op7_toxicity": op7_toxicity,
        "op8_phrases": op8_phrases,
        "op9_classifier": op9_classifier,
        "op10_vectors": op10_vectors,
        "op11_spelling": op11_spelling,
        "op12_url_filters": op12_url_filters,
        "op13_periodic": op13_periodic,
    }


_WORD = r"[^\x20\x09-\x0D]+"

_OP1 = rf"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
base AS (
  SELECT doc_id, source, text, regexp_extract_all(text, '{_WORD}') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM docs),
windows AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 7], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS pos FROM base)),
again AS (SELECT doc_id, pos FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
repeated AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(pos, pos + 8)) AS place FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, source, array_to_string(regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}'), ' ') AS line, len(regexp_extract_all(x, '{_WORD}')) AS n
          FROM (SELECT doc_id, source, unnest(lines) AS x FROM base)),
hosts AS (SELECT source, greatest(5, floor(count(*) * 0.02)) AS most FROM docs GROUP BY source),
frequent AS (SELECT l.source, line FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, line, most HAVING count(DISTINCT doc_id) > most),
gone AS (SELECT doc_id, sum(n) AS n FROM lines l JOIN frequent f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source GROUP BY doc_id),
sums AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(g.n, 0) AS BIGINT) AS removed_words
  FROM base LEFT JOIN repeated r USING (doc_id) LEFT JOIN gone g USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM sums)
SELECT *, NOT base_failed AND n_words - removed_words >= 20 AND n_words - removed_words >= 0.3 * n_words AS kept FROM judged
"""

_OP8 = rf"""
WITH base AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
windows AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 19], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS pos FROM base)),
later AS (SELECT doc_id, pos FROM windows QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1),
gone AS (SELECT doc_id, list(DISTINCT place) AS places FROM (SELECT doc_id, unnest(range(pos, pos + 20)) AS place FROM later) GROUP BY doc_id),
kept AS (SELECT b.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed, words, places FROM base b LEFT JOIN gone USING (doc_id)),
left_ AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM (SELECT doc_id, places, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM kept) k WHERE places IS NULL OR NOT list_contains(places, pos) GROUP BY doc_id)
SELECT k.doc_id, n_words, n_removed, sha256(coalesce(l.text, '')) AS kept_sha256 FROM kept k LEFT JOIN left_ l USING (doc_id)
"""

_OP10 = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored QUALIFY rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are tested against brute force in tests/llm."""
    return {"op1_quality": _OP1, "op8_phrases": _OP8, "op10_vectors": _OP10}
