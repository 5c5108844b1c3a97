"""Maximum inner product search with score-aware (anisotropic) quantisation.

Vectors are quantised by products of four-bit codebooks whose training and assignment weigh the part of the residual
parallel to the vector more than the rest, since only that part changes high inner products much. A search adds up
table entries for the codes of a block of vectors, reranks the best of the block by exact inner products, and then every other
vector that, by the norm of its residual, could well be among the nearest: however many these are, none is cut off.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import materialize

#: Rows of the index that a task scans at a time, and queries that it answers; both bound its memory. A row is sent to every
#: block of queries, so large blocks of queries keep the shuffle small: rows * queries / BLOCK_QUERIES vectors.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 16_384


@dataclass
class Quantiser:
    """books: subspaces x 16 x width. Vectors are padded with zeros to subspaces * width components."""

    books: np.ndarray
    weight: float  # of the squared parallel residual, relative to the rest
    dims: int = 0  # of the vectors that it was fitted to

    def parts(self, x: np.ndarray) -> np.ndarray:
        s, _, d = self.books.shape
        return np.pad(x, ((0, 0), (0, s * d - x.shape[1]))).reshape(len(x), s, d)

    def assign(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes of each vector, by coordinate descent over subspaces on the weighted loss."""
        parts = self.parts(x)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None, None]
        plain = ((parts[:, :, None, :] - self.books[None]) ** 2).sum(-1)
        along = ((parts[:, :, None, :] - self.books[None]) * unit[:, :, None, :]).sum(-1)
        codes = plain.argmin(-1)
        rows = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(rounds):
            for s in range(len(self.books)):
                others = total - along[rows, s, codes[:, s]]
                best = (plain[:, s] + (self.weight - 1) * (others[:, None] + along[:, s]) ** 2).argmin(1)
                codes[:, s] = best
                total = others + along[rows, s, best]
        return codes

    def residual(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Norm of each vector's difference from what its codes stand for."""
        parts = self.parts(x)
        return np.sqrt(((parts - self.books[np.arange(len(self.books)), codes]) ** 2).sum((1, 2)))

    def refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """The codebooks that minimise the weighted loss for given codes: one linear system."""
        s, k, d = self.books.shape
        parts = self.parts(x)
        norm = np.maximum(np.linalg.norm(x, axis=1), 1e-12)
        unit = parts / norm[:, None, None]
        v = np.zeros((len(x), s, k, d), np.float32)
        rows = np.arange(len(x))
        right = np.zeros((s, k, d))
        count = np.zeros((s, k))
        for j in range(s):
            v[rows, j, codes[:, j]] = unit[:, j]
            np.add.at(right[j], codes[:, j], parts[:, j] + (self.weight - 1) * norm[:, None] * unit[:, j])
            count[j] = np.bincount(codes[:, j], minlength=k)
        v = v.reshape(len(x), -1)
        left = (self.weight - 1) * (v.T @ v).astype(np.float64)
        left[np.diag_indices_from(left)] += np.repeat(count.ravel(), d) + 1e-3
        self.books = np.linalg.solve(left, right.ravel() + 1e-3 * self.books.ravel()).reshape(s, k, d)


def train(x: np.ndarray, width: int = 2, threshold: float = 0.2, rounds: int = 5, seed: int = 1) -> Quantiser:
    """Fit to a sample. threshold: the share of a norm from which inner products matter; it sets the parallel weight."""
    n, dims = x.shape
    s = math.ceil(dims / width)
    rng = np.random.default_rng(seed)
    weight = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
    q = Quantiser(np.zeros((s, 16, width)), weight)
    parts = q.parts(x)
    for j in range(s):
        centres = parts[rng.choice(n, 16, replace=n < 16), j].astype(np.float64)
        for _ in range(8):
            near = ((parts[:, j, None] - centres) ** 2).sum(-1).argmin(1)
            count = np.bincount(near, minlength=16)
            sums = np.stack([np.bincount(near, weights=parts[:, j, i], minlength=16) for i in range(width)], 1)
            centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        q.books[j] = centres
    for _ in range(rounds):
        q.refit(x, q.assign(x))
    return q


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, embedding) of vectors that take part: not null, no null or non-finite component, not zero."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    kind = "double" if isinstance(vectors.schema["embedding"].dataType.elementType, T.DoubleType) else "float"
    return vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>")).filter("vec_id is not null and embedding is not null").filter(fine)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def index(rows: DataFrame, quantiser: Quantiser) -> DataFrame:
    """Add `codes`, two four-bit codes a byte, and `residual`, the norm of what the codes leave out."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                x = _matrix(part.column(2)).astype(np.float64)
                codes = quantiser.assign(x)
                residual = quantiser.residual(x, codes)
                codes = codes.astype(np.uint8)
                codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
                packed = codes[:, ::2] | codes[:, 1::2] << 4
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(residual)], ["row", "vec_id", "embedding", "codes", "residual"])

    return rows.mapInArrow(encode, f"row long, vec_id long, embedding {rows.schema['embedding'].dataType.simpleString()}, codes binary, residual double")


def scan(queries: np.ndarray, query_rows: np.ndarray, x: np.ndarray, rows_of: np.ndarray, ids: np.ndarray, codes: np.ndarray, residual: np.ndarray, q: Quantiser, k: int, rerank: int, deviations: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, vec_id, score) of the k best of a block for each query, and how many vectors each query reranked.

    Equal vectors are scanned once and all counted. After the `rerank` best by their codes, every vector is reranked whose
    approximate score comes within a margin of the k-th exact score (one more for the query itself). The margin is what the
    inner product of query and residual is likely to reach: |query| * residual / sqrt(dims), which is its standard deviation
    for a residual of any direction, times `deviations`; with sqrt(dims) of them and more it is the bound that can't be passed.
    Where many vectors have nearly the same codes, all of them are reranked, as none can be told from the others.
    """
    order = np.argsort(ids, kind="stable")
    x, ids, rows_of, codes, residual = np.ascontiguousarray(x[order]), ids[order], rows_of[order], codes[order], residual[order]
    _, first, copy = np.unique(x.view(f"V{x.itemsize * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
    by_copy = np.argsort(copy, kind="stable")  # ids of each distinct vector, smallest first
    bounds = np.searchsorted(copy[by_copy], np.arange(len(first) + 1))
    x64, codes = x[first].astype(np.float64), codes[first].T.astype(np.intp)
    residual = residual[first]
    reach = np.linalg.norm(x64, axis=1) + residual
    likely = residual * min(1.0, deviations / np.sqrt(x.shape[1])) + 1e-5 * reach  # the second term bears the rounding of table sums
    many, enough = min(rerank, len(first)), min(k + 1, len(first))
    out, looked_at = [], np.zeros(len(queries), np.int64)
    parts = q.parts(queries.astype(np.float64))
    pad = codes.shape[0] * 2 - len(q.books)
    for a in range(0, len(queries), 64):
        some = parts[a : a + 64]
        tables = np.einsum("nsd,skd->nsk", some, q.books).astype(np.float32)
        tables = np.pad(tables, ((0, 0), (0, pad), (0, 0)))
        pairs = (tables[:, 1::2, :, None] + tables[:, ::2, None, :]).reshape(len(some), -1, 256)  # entry for each byte of two codes
        score = np.zeros((len(some), len(first)), np.float32)
        for j in range(codes.shape[0]):
            score += pairs[:, j].take(codes[j], axis=1)
        some64 = queries[a : a + 64].astype(np.float64)
        norm = np.linalg.norm(some64, axis=1)
        best = np.argpartition(-score, many - 1, axis=1)[:, :many] if many < len(first) else np.tile(np.arange(many), (len(some), 1))
        found: list[tuple] = []
        for r in range(len(some)):
            slack = 1e-12 * norm[r] * reach.max()
            rows = best[r]
            exact = x64[rows] @ some64[r]
            kth = np.partition(exact, len(exact) - enough)[len(exact) - enough]
            near = score[r] + norm[r] * likely >= kth - slack
            near[rows] = False
            others = np.flatnonzero(near)
            if len(others):
                rows, exact = np.concatenate([rows, others]), np.concatenate([exact, x64[others] @ some64[r]])
                kth = np.partition(exact, len(exact) - enough)[len(exact) - enough]
            looked_at[a + r] = len(rows)
            top = rows[exact >= kth - slack]
            exact = (x64[top] * some64[r]).sum(1)  # rounds alike wherever a vector stands, so that ties are ties
            mine = [(-s, ids[j]) for t, s in zip(top, exact, strict=True) for j in by_copy[bounds[t] : bounds[t + 1]][: k + 1] if rows_of[j] != query_rows[a + r]]
            mine.sort()
            found.extend((a + r, i, -s) for s, i in mine[:k])
        out.append([np.array(c, t) for c, t in zip(zip(*found, strict=True), (np.int64, np.int64, np.float64), strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)])
    at, found_ids, scores = (np.concatenate([c[i] for c in out]) if out else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64)))
    return at, found_ids, scores, looked_at


def fit(rows: DataFrame, sample: int) -> Quantiser | None:
    """A quantiser of at most `sample` vectors, those with the smallest hashes, trained in a task; None without any.

    The vectors of the most frequent length count.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [np.asarray(v.values) for batch in batches for v in batch.column(0)]
        if some:
            lengths = np.array([len(v) for v in some])
            dims = int(np.bincount(lengths).argmax())
            q = train(np.array([v for v in some if len(v) == dims], np.float64))
            yield pa.RecordBatch.from_arrays([pa.array([dims]), pa.array([q.weight]), pa.array(list(q.books.shape[:1]), pa.int64()), pa.array([q.books.tobytes()])], ["dims", "weight", "parts", "books"])

    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(sample).select("embedding").repartition(1)
    found = picked.mapInArrow(learn, "dims long, weight double, parts long, books binary").first()
    if found is None:
        return None
    q = Quantiser(np.frombuffer(found["books"]).reshape(found["parts"], 16, -1).copy(), found["weight"])
    q.dims = found["dims"]
    return q


def search(vectors: DataFrame, asked: str, k: int = 20, rerank: int = 400, sample: int = 10_000, deviations: float = 4.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by inner product of each row that fulfils `asked`, an SQL condition.

    All rows but the query's own are candidates. A repeated row is a query of its own and the other's candidate, so its id
    has k rows for each; equal scores go by vec_id. Vectors that are null, zero, or hold null or non-finite components take
    no part, nor do rows without an id, nor vectors of another length than most of the sample. An empty table gives no rows.

    The quantiser is fitted on at most `sample` vectors; every usable vector is indexed, once, and written. Blocks of queries
    meet blocks of vectors; of each block a task reranks `rerank` distinct vectors per query and all others within the margin
    of `deviations` (see `scan`), and passes on k. Fewer candidates than k give fewer rows. A neighbour is missed only where its
    residual and the query go together by more than that many standard deviations.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors), "vectors")
    quantiser = fit(rows, sample)
    if quantiser is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    indexed = materialize(index(rows.filter(F.size("embedding") == quantiser.dims), quantiser), "vector-index")
    queries = indexed.filter(asked).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    row_blocks, query_blocks = math.ceil(indexed.count() / BLOCK_ROWS), max(1, math.ceil(queries.count() / BLOCK_QUERIES))
    block = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    table = indexed.withColumn("row_block", block("row", row_blocks)).withColumn("query_block", every(query_blocks))
    queries = queries.withColumn("query_block", block("query_row", query_blocks)).withColumn("row_block", every(row_blocks))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        if not left.num_rows or not right.num_rows:
            at, b, c = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(right.num_rows, -1)
            matrix = lambda c: _matrix(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c)
            whole = {c: np.asarray(right.column(c)) for c in ("row", "vec_id", "residual")}
            at, b, c, _ = scan(matrix(left.column("query")), np.asarray(left.column("query_row")), matrix(right.column("embedding")), whole["row"], whole["vec_id"], codes, whole["residual"], quantiser, k, rerank, deviations)
        place = pa.array(at)
        return pa.table({"query_row": left.column("query_row").take(place), "query_id": left.column("query_id").take(place), "vec_id": b, "score": c})

    best = queries.groupBy("query_block", "row_block").cogroup(table.groupBy("query_block", "row_block")).applyInArrow(meet, "query_row long, query_id long, vec_id long, score double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
