"""Nearest neighbours with score-aware anisotropic quantisation, four-bit table scans and exact reranking.

Nearness by Euclidean distance is an inner product: |q - x|^2 = |q|^2 - 2 (q.x - |x|^2 / 2). Every row is indexed: its
vector as four-bit codes, WIDTH dimensions to a code, and its exact squared norm. The codebooks minimise
|r|^2 + (ETA - 1) (r.x / |x|)^2 over residuals r: error along the vector, which moves large inner products, costs ETA
times as much as error across it. Codes are chosen by coordinate descent under the same loss.

A search scans the codes of all rows in blocks with one table of 16 entries for each code of a query. In each block every
row that scores at least as well as the SHORTLIST-th (ties included) is reranked on the original vectors in double precision;
blocks' best k meet in a window over each query. Queries are broadcast in chunks of about CHUNK.

The codebooks are fitted on at most TRAIN_ROWS rows (the least by a hash of vec_id); that is the one sample.

Defined cases: rows with a null id, and vectors that are null, zero, of another dimension than the commonest (least of
equally common) or that hold null or non-finite components take no part; a repeated vec_id stays a candidate for each row, and queries
with its least vector; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.runtime import stored

WIDTH, CODES, ETA, ROUNDS = 2, 16, 4.0, 6
TRAIN_ROWS, CHUNK, SHORTLIST, NEIGHBOURS, EVERY = 20_000, 4096, 64, 10, 100


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, embedding array<double>) of the rows that take part, and their dimension."""
    chosen = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    chosen = chosen.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))
    sizes = chosen.groupBy(F.size("embedding").alias("n")).count().orderBy(F.col("count").desc(), "n").limit(1).collect()
    n = sizes[0].n if sizes else 0
    return chosen.where(F.size("embedding") == n), n


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)


class Codebook:
    """Codebooks for each WIDTH dimensions; the last group is padded with zeros."""

    def __init__(self, n: int):
        self.n, self.groups = n, -(-n // WIDTH)
        self.books = np.zeros((self.groups, CODES, WIDTH))

    def split(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.groups * WIDTH - self.n))).reshape(len(x), self.groups, WIDTH)

    def fit(self, x: np.ndarray) -> Codebook:
        r, parts = np.random.default_rng(5), self.split(x)
        for g in range(self.groups):
            self.books[g] = parts[r.integers(0, len(x), CODES), g] + r.normal(0, 1e-6, (CODES, WIDTH))
        for k in range(ROUNDS):
            codes, along, unit = self.encode(x, ETA if k else 1.0)
            for g in range(self.groups):
                u, own, code = unit[:, g], parts[:, g], codes[:, g]
                rest = along - ((own - self.books[g][code]) * u).sum(1)  # residual along the vector from other groups
                outer = np.eye(WIDTH) + (ETA - 1) * u[:, :, None] * u[:, None, :]
                right = (outer @ own[:, :, None])[:, :, 0] + (ETA - 1) * rest[:, None] * u
                for c in range(CODES):
                    mine = code == c
                    if mine.any():
                        self.books[g, c] = np.linalg.solve(outer[mine].sum(0), right[mine].sum(0))
                along = rest + ((own - self.books[g][code]) * u).sum(1)
        return self

    def encode(self, x: np.ndarray, eta: float = ETA, passes: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, the residual along each vector, and the unit vectors."""
        parts = self.split(x)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        gaps = [parts[:, g][:, None, :] - self.books[g][None] for g in range(self.groups)]
        square = [(d**2).sum(2) for d in gaps]
        along_of = [(d * unit[:, g][:, None, :]).sum(2) for g, d in enumerate(gaps)]
        rows = np.arange(len(x))
        codes = np.stack([s.argmin(1) for s in square], axis=1) if self.groups else np.zeros((len(x), 0), int)
        along = sum((a[rows, codes[:, g]] for g, a in enumerate(along_of)), np.zeros(len(x)))
        for _ in range(passes if eta > 1 else 0):
            for g in range(self.groups):
                rest = along - along_of[g][rows, codes[:, g]]
                codes[:, g] = (square[g] + (eta - 1) * (rest[:, None] + along_of[g]) ** 2).argmin(1)
                along = rest + along_of[g][rows, codes[:, g]]
        return codes, along, unit

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with all codes: groups x queries x CODES."""
        return np.einsum("qgw,gcw->gqc", self.split(q), self.books).astype(np.float32)


def build_index(vectors: DataFrame, n: int, train_rows: int = TRAIN_ROWS) -> tuple[DataFrame, Codebook]:
    """Every row with its four-bit codes (two to a byte) and squared norm, stored; and the codebooks."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(train_rows).collect()
    book = Codebook(n)
    if sample:
        book.fit(np.array([r.embedding for r in sorted(sample, key=lambda r: (r.vec_id, r.embedding))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), n)
            codes = book.encode(x)[0].astype(np.uint8)
            if codes.shape[1] % 2:
                codes = np.pad(codes, ((0, 0), (0, 1)))
            packed = codes[:, ::2] | (codes[:, 1::2] << 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in packed], pa.binary()), pa.array((x**2).sum(1))], ["vec_id", "embedding", "codes", "square"])

    return stored(vectors.mapInArrow(run, "vec_id long, embedding array<double>, codes binary, square double"), "ann-index"), book


def search(index: DataFrame, book: Codebook, ids: np.ndarray, queries: np.ndarray, k: int = NEIGHBOURS, shortlist: int = SHORTLIST) -> DataFrame:
    """query_id, vec_id, score: the best k of every block of rows for each of a bounded number of queries."""
    tables = book.tables(queries)
    width = -(-book.groups // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int]]] = [[] for _ in ids]
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                names = batch.column(0).to_numpy()
                packed = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, width)
                codes = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(packed), -1)
                half = (batch.column(3).to_numpy() / 2).astype(np.float32)
                x = _matrix(batch.column(1), book.n)
                for first in range(0, len(ids), 256):
                    some = slice(first, min(first + 256, len(ids)))
                    score = np.repeat(-half[None], some.stop - some.start, axis=0)
                    for g in range(book.groups):
                        score += tables[g, some][:, codes[:, g]]
                    keep = min(shortlist + 1, len(names))
                    bound = np.partition(score, len(names) - keep, axis=1)[:, len(names) - keep]
                    for row in range(some.stop - some.start):
                        near = np.flatnonzero(score[row] >= bound[row])
                        far = np.sqrt(((x[near] - queries[first + row]) ** 2).sum(1))
                        order = np.lexsort((names[near], far))[: k + 1]  # the query's own row may be among them
                        best[first + row] = sorted([*best[first + row], *zip(far[order].tolist(), names[near][order].tolist(), strict=True)])[: k + 1]
        out = [(int(q), v, s) for q, found in zip(ids, best, strict=True) for s, v in found]
        if out:
            q, v, s = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(rows: DataFrame, every: int = EVERY, k: int = NEIGHBOURS, shortlist: int = SHORTLIST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row whose vec_id is divisible by every."""
    vectors, n = usable(rows)
    index, book = build_index(vectors, n)
    asked = index.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    chunks = max(1, -(-asked.count() // CHUNK))
    found = None
    for c in range(chunks):
        some = sorted(asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).collect(), key=lambda r: r.vec_id)
        part = search(index, book, np.array([r.vec_id for r in some], np.int64), np.array([r.embedding for r in some], float).reshape(len(some), n), k, shortlist)
        found = part if found is None else found.union(part)
    # one row of the query's id at distance 0 is the query's own; further rows with its id are candidates like others
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0)
    marked = found.withColumn("own", own)
    again = F.row_number().over(Window.partitionBy("query_id", "own").orderBy("score", "vec_id"))
    found = marked.withColumn("again", again).where("not own or again > 1").drop("own", "again")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
