"""Nearest neighbours by inner product with score-aware anisotropic quantisation.

Vectors are product-quantised to four bits for each subspace. The codebooks and the codes minimise
an anisotropic loss, which weighs the residual parallel to the vector more than
the residual across it, as only the former disturbs the largest inner products. A search
adds up entries of each query's tables (16 for each subspace) over the codes of a block of
rows, and computes the exact products of the best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import first_by_hash

CENTRES = 16
#: Rows meet BLOCK_QUERIES queries at a time, so they are shuffled once for each block of queries, and queries once for each block of rows.
BLOCK_ROWS = 8_192
BLOCK_QUERIES = 16_384
#: Queries whose tables are in memory at a time.
TABLE_QUERIES = 512


@dataclass(frozen=True)
class Codebook:
    """``centres[s]``: the 16 centres of subspace s. ``parallel``: weight of the parallel residual, in parts of the other's."""

    centres: np.ndarray
    parallel: float

    @property
    def width(self) -> int:
        return self.centres.shape[0] * self.centres.shape[2]

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.width - x.shape[1])))

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss |r|^2 + (parallel - 1) (r . u)^2, u the vector's direction."""
        parts, _, dims = self.centres.shape
        x = self.padded(x).astype(np.float32)
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        xs, us = x.reshape(len(x), parts, dims), unit.reshape(len(x), parts, dims)
        across = np.empty((len(x), parts, CENTRES), np.float32)  # |x_s - c|^2
        along = np.empty_like(across)  # (x_s - c) . u_s
        for s in range(parts):
            c = self.centres[s]
            across[:, s] = (xs[:, s] ** 2).sum(axis=1)[:, None] - 2 * xs[:, s] @ c.T + (c**2).sum(axis=1)
            along[:, s] = (xs[:, s] * us[:, s]).sum(axis=1)[:, None] - us[:, s] @ c.T
        codes = across.argmin(axis=2)
        rows = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
        for _ in range(rounds):
            for s in range(parts):
                rest = total - along[rows, s, codes[:, s]]
                loss = across[:, s] + (self.parallel - 1) * (rest[:, None] + along[:, s]) ** 2
                codes[:, s] = loss.argmin(axis=1)
                total = rest + along[rows, s, codes[:, s]]
        return codes.astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of each query's parts with all centres: (queries, subspaces, 16)."""
        parts, _, dims = self.centres.shape
        q = self.padded(queries).astype(np.float32).reshape(len(queries), parts, dims)
        return np.einsum("qsd,scd->qsc", q, self.centres, optimize=True)


def train(sample: np.ndarray, parts: int = 32, parallel: float = 4.0, rounds: int = 8, seed: int = 7) -> Codebook:
    """Codebooks of a sample by alternating anisotropic encoding and weighted least squares.

    With the codes fixed, the loss is quadratic in all centres of a subspace: each row asks its
    centre to meet x_s under the matrix I + (parallel - 1) u_s u_s', given the other subspaces' residual.
    """
    width = sample.shape[1]
    parts = max(1, min(parts, width))
    dims = -(-width // parts)
    book = Codebook(np.zeros((parts, CENTRES, dims), np.float32), parallel)
    x = book.padded(sample).astype(np.float32)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    xs, us = x.reshape(len(x), parts, dims), unit.reshape(len(x), parts, dims)
    rng = np.random.default_rng(seed)
    for s in range(parts):
        book.centres[s] = xs[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), s]
    for _ in range(rounds):
        codes = book.encode(sample, rounds=1)
        along = np.stack([((xs[:, s] - book.centres[s][codes[:, s]]) * us[:, s]).sum(axis=1) for s in range(parts)], axis=1)
        total = along.sum(axis=1)
        for s in range(parts):
            rest = total - along[:, s]
            outer = np.eye(dims) + (parallel - 1) * us[:, s, :, None] * us[:, s, None, :]
            aim = np.einsum("nde,ne->nd", outer, xs[:, s]) + (parallel - 1) * rest[:, None] * us[:, s]
            for c in range(CENTRES):
                own = codes[:, s] == c
                if own.any():
                    book.centres[s, c] = np.linalg.solve(outer[own].sum(axis=0) + 1e-6 * np.eye(dims), aim[own].sum(axis=0))
                else:
                    book.centres[s, c] = xs[rng.integers(len(x)), s]
            along[:, s] = ((xs[:, s] - book.centres[s][codes[:, s]]) * us[:, s]).sum(axis=1)
            total = rest + along[:, s]
    return book


def valid_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: no null id, no null, empty or zero vector, no null, infinite or NaN component.

    Single-precision vectors stay so, as they are shuffled; products are in double precision either way.
    """
    single = rows.schema[vector].dataType.simpleString() == "array<float>"
    v = F.col(vector).cast("array<float>" if single else "array<double>")
    fine = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    return rows.select(F.col(key).cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id is not null").where(F.coalesce(fine, F.lit(False)))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in vectors])


def _coded(vectors: DataFrame, book: Codebook) -> DataFrame:
    """``vectors`` with their codes, one byte for each two subspaces; vectors of another width have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            codes = np.full(len(frame), None, object)
            fits = np.flatnonzero([book.width - len(v) in range(book.centres.shape[2]) for v in frame["v"]])
            if len(fits):
                four_bits = book.encode(_matrix(frame["v"].iloc[fits]))
                if four_bits.shape[1] % 2:
                    four_bits = np.pad(four_bits, ((0, 0), (0, 1)))
                codes[fits] = [row.tobytes() for row in four_bits[:, 0::2] * 16 + four_bits[:, 1::2]]
            yield frame.assign(code=codes)

    kind = vectors.schema["v"].dataType.simpleString()
    return vectors.mapInPandas(run, f"vec_id bigint, v {kind}, code binary")


class _Block:
    """The distinct vectors of a block of rows with their codes, and the ids of each in ascending order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: pd.Series):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], np.ascontiguousarray(x[order]) + 0.0  # -0.0 becomes 0.0
        _, first, group = np.unique(x.view(f"V{x.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
        self.x = x[first]
        by = np.argsort(group, kind="stable")
        self.ids, self.start = ids[by], np.searchsorted(group[by], np.arange(len(first) + 1))
        codes = codes.to_numpy()[order][first]
        self.pairs = None if codes[0] is None else np.ascontiguousarray(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1).T)

    def near(self, queries: np.ndarray, book: Codebook, rerank: int) -> Iterator[np.ndarray]:
        """For each query the places of the ``rerank`` vectors that the tables put first, and of all that tie with the last; without codes all places."""
        n = len(self.x)
        if self.pairs is None or n <= rerank:
            yield from (np.arange(n) for _ in queries)
            return
        for at in range(0, len(queries), TABLE_QUERIES):
            tables = book.tables(queries[at : at + TABLE_QUERIES])
            if tables.shape[1] % 2:
                tables = np.pad(tables, ((0, 0), (0, 1), (0, 0)))
            # Two four-bit tables side by side make one of 256 entries.
            tables = (tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(len(tables), -1, 256)
            for table in tables:
                rough = table[0][self.pairs[0]]
                for s in range(1, len(self.pairs)):
                    rough += table[s][self.pairs[s]]
                yield np.flatnonzero(rough >= np.partition(rough, n - rerank)[n - rerank])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, book: Codebook, k: int, rerank: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its at most k best rows here: (query id, row ids, exact scores)."""
        for query, vector, near in zip(query_ids, queries, self.near(queries, book, rerank)):
            exact = (self.x[near] * vector).sum(axis=1)
            order = np.argsort(-exact, kind="stable")
            # Rows of as many distinct vectors as could hold the k best, ties included.
            near, exact = near[order], exact[order]
            if len(near) > k + 1:
                keep = exact >= exact[k]
                near, exact = near[keep], exact[keep]
            ids = [self.ids[self.start[g] : min(self.start[g + 1], self.start[g] + k + 1)] for g in near]
            scores = np.repeat(exact, [len(i) for i in ids])
            ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
            other = ids != query
            ids, scores = ids[other], scores[other]
            best = np.lexsort((ids, -scores))[:k]
            yield query, ids[best], scores[best]


def fit(vectors: DataFrame, sample_rows: int = 20_000, parts: int = 32, parallel: float = 4.0) -> Codebook | None:
    """A codebook of the ``sample_rows`` participating vectors first in hash order, of the most common width; None without any."""
    rows = first_by_hash(vectors, sample_rows, "vec_id", "v").select("v").toPandas()
    if not len(rows):
        return None
    widths = rows["v"].map(len)
    width = int(widths.mode()[0])
    return train(_matrix(rows["v"][widths == width]), parts, parallel)


def search(vectors: DataFrame, queries: DataFrame, book: Codebook, k: int = 20, rerank: int = 200, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Each query's k best rows by exact inner product: query_id, rank (from 1), vec_id, score.

    ``vectors`` and ``queries``: (vec_id, v) of ``valid_vectors``. Rows and queries meet in
    blocks, each pair of blocks a task's group of bounded size; rows are coded once, before that. In a pair of blocks the four-bit tables
    choose ``rerank`` distinct vectors (and all that tie with the last) for each query, whose exact products
    decide. So the number of reranked candidates grows with the blocks. A query is never its own candidate; ties
    go to the smaller id; fewer candidates than k give fewer rows. Vectors of other widths than
    the codebook's dimension meet queries of their own width only, without quantisation. Ids are taken to be unique:
    of repeated ids each row is a candidate, and each repeated query is answered once.
    """
    schema = "query_id bigint, vec_id bigint, score double"
    rows_n, queries_n = vectors.count(), queries.count()
    row_blocks, query_blocks = -(-rows_n // block_rows) or 1, -(-queries_n // block_queries) or 1
    place = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = _coded(vectors.select("vec_id", "v"), book).select("vec_id", "v", "code", place(row_blocks).alias("row_block"), F.lit(False).alias("query")).withColumn("query_block", every(query_blocks))
    asked = queries.dropDuplicates(["vec_id"]).select("vec_id", "v", F.lit(None).cast("binary").alias("code"), F.lit(True).alias("query"), place(query_blocks).alias("query_block"))
    both = left.unionByName(asked.withColumn("row_block", every(row_blocks)))

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in frame.groupby(frame["v"].map(len)):
            theirs, mine = own[~own["query"]], own[own["query"]]
            if not len(theirs) or not len(mine):
                continue
            block = _Block(theirs["vec_id"].to_numpy(np.int64), _matrix(theirs["v"]), theirs["code"])
            out += block.search(mine["vec_id"].to_numpy(np.int64), _matrix(mine["v"]), book, k, rerank)
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        query, ids, scores = zip(*out)
        return pd.DataFrame({"query_id": np.repeat(query, [len(i) for i in ids]), "vec_id": np.concatenate(ids), "score": np.concatenate(scores)})

    found = both.groupBy("row_block", "query_block").applyInPandas(meet, schema)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
