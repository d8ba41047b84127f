"""Exact top-k inner products of quantised vectors, by multi-resolution segment statistics.

A vector is cut into segments; each keeps its mean and its deviation. For two vectors the sum
over segments of s ((mean - mean')^2 + (dev - dev')^2) is a lower bound of their squared
distance, so with |q|^2 + |v|^2 - 2 <q, v> = distance^2 it bounds the inner product from above.

The segments follow the query: its components are put in order of size, the largest first. At
the coarsest level the leading quarter are segments of their own, of one component each, and all
others are one segment. Each finer level splits further components off that one. So most of
the query's length is known exactly early on, also where vectors have no structure of their own.
A level is worked out for the rows that the coarser ones left; the last one is the product.

Queries and rows meet in blocks of bounded size; every pair of blocks is searched. One block of
rows in sixteen is searched first: what it finds is each query's bound in all the others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.vectors import best_rows, block_of, blocks_for, every_block, first_copies, matrix, packed_vectors, ranked, rows_for
from riskweave.session import store

NEIGHBOURS = 5
SCALE = 256.0
LEVELS = (16, 20, 24, 28, 32, 40, 48, 64)  # components out of 64 that are known, coarse to fine
VECTOR_BLOCK = 4096
QUERY_BLOCK = 8192
SEED_STRIDE = 16  # one block of rows in so many is searched first
_FIRST = 128  # rows searched before there is a bound; each further run is twice as long
_DEEP = 64  # beyond so many rows for one id in k, all are scored


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(256 x) of each component; whole numbers in double precision, cut to its range."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(SCALE * x))


def levels_of(dim: int) -> list[int]:
    return sorted({-(-dim * n // LEVELS[-1]) for n in LEVELS})


def rest_bound(sum_a, squares_a, sum_b, squares_b, width: int):
    """No inner product of two segments of `width` components with these sums and sums of squares
    is higher."""
    mean = sum_a * sum_b / width
    dev_a = np.sqrt(np.maximum(squares_a - sum_a * sum_a / width, 0))
    dev_b = np.sqrt(np.maximum(squares_b - sum_b * sum_b / width, 0))
    return mean + dev_a * dev_b


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, as 64-bit integers; sums beyond those are cut to their range."""
    if a.size == 0:
        return np.zeros(len(a), np.int64)
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2.0**53:
        return (a * b).sum(axis=1).astype(np.int64)
    top = 2**63 - 1
    return np.array(
        [max(-top - 1, min(top, sum(int(x) * int(y) for x, y in zip(r, s)))) for r, s in zip(a, b)], np.int64
    )


def best_in_block(vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query_id, vec_id, score): the k best rows of a block for each query of a block, without
    those below the query's `least`."""
    out = [np.zeros((0, 3), np.int64)]
    if len(vectors) and len(queries):
        vectors = first_copies(vectors, k + 1)
        block = Block(quantised(matrix(vectors["vec"])), vectors["id"].to_numpy(), k)
        for q, own, least in zip(quantised(matrix(queries["vec"])), queries["id"], queries["least"]):
            out.append(block.best(q, own, least))
    return pd.DataFrame(np.concatenate(out), columns=["query_id", "vec_id", "score"])


class Block:
    """A block of rows, searched one query at a time. `products` counts the multiplied components."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, k: int):
        self.x, self.ids, self.k = x, ids, k
        self.by_component = np.ascontiguousarray(x.T)
        self.sums, self.squares = x.sum(axis=1), (x * x).sum(axis=1)
        # a query's own id takes up to that many more rows
        self.deep = rows_for(k, ids)
        self.levels = levels_of(x.shape[1])
        self.top = np.abs(x).max(initial=0)
        self.products = 0

    def best(self, q: np.ndarray, own: int, least: float) -> np.ndarray:
        """(query_id, vec_id, score) of the k best rows that score `least` or more."""
        scores, rows, size = np.zeros(0, np.int64), np.zeros(0, np.int64), len(self.ids)
        start, run = 0, size if least > -np.inf or self.deep > _DEEP else _FIRST
        while start < size:
            end = min(size, start + run)
            alive = start + np.flatnonzero(self.ids[start:end] != own)
            alive = self._survivors(q, alive, least)
            scores = np.r_[scores, exact_products(np.broadcast_to(q, (len(alive), len(q))), self.x[alive])]
            rows = np.r_[rows, alive]
            if self.deep <= _DEEP and len(scores) >= self.deep:
                # so many rows hold k different ids
                least = max(least, np.partition(scores, -self.deep)[-self.deep])
                keep = scores >= least
                scores, rows = scores[keep], rows[keep]
            start, run = end, 2 * run
        return np.stack(best_rows(np.full(len(rows), own), self.ids[rows], scores, self.k), axis=1).astype(np.int64)

    def _survivors(self, q: np.ndarray, alive: np.ndarray, least: float) -> np.ndarray:
        dim = len(q)
        if least == -np.inf:
            self.products += dim * len(alive)
            return alive
        # sums of products of this size are off by less than this
        slack = 1e-9 * (1 + np.abs(q).max(initial=0) * self.top * dim)
        order = np.argsort(-np.abs(q), kind="stable")
        whole = self.squares[alive]
        known, sums, squares, done = np.zeros(len(alive)), self.sums[alive], whole, 0
        for level in self.levels:
            at = order[done:level]
            part = self.by_component[np.ix_(at, alive)]
            self.products += part.size
            known, done = known + q[at] @ part, level
            bound = known + slack
            if done < dim:
                sums, squares = sums - part.sum(axis=0), squares - np.einsum("ij,ij->j", part, part)
                rest = q[order[done:]]
                off = 1e-14 * dim
                bound += rest_bound(sums, squares + off * whole, rest.sum(), rest @ rest * (1 + off), dim - done)
            keep = ~(bound < least)  # sums beyond all numbers stay
            alive, known, sums, squares, whole = alive[keep], known[keep], sums[keep], squares[keep], whole[keep]
        return alive


def top_products(
    vectors: DataFrame,
    queries: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = NEIGHBOURS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest integer inner product per query.

    A query does not find rows with its own id. Ties go to the smaller id. Rows with a null id
    and vectors that are null, empty or hold a null or non-finite component take no part; zero
    vectors do. Only vectors of equal length meet. Ids that occur more than once count once,
    with their best vector. Empty tables give an empty result.
    """
    base = store(packed_vectors(vectors, id_column, vector_column, True), "vectors")
    asked = store(packed_vectors(queries, id_column, vector_column, True).dropDuplicates(), "queries")
    count = lambda df, name: df.groupBy("dim").agg(F.count(F.lit(1)).alias(name))
    # a row for each length of vectors
    blocks = store(
        count(base, "rows").join(count(asked, "asks"), "dim").select(
            "dim",
            blocks_for(F.col("rows"), VECTOR_BLOCK).alias("parts"),
            blocks_for(F.col("asks"), QUERY_BLOCK).alias("turns"),
        ),
        "blocks",
    )
    dealt = base.join(F.broadcast(blocks), "dim").select(
        "dim", block_of(F.col("id"), F.col("parts")).alias("part"), every_block(F.col("turns")).alias("turn"), "id", "vec"
    )
    early = F.col("part") % SEED_STRIDE == 0

    def asking(queries: DataFrame, least: Column) -> DataFrame:
        return queries.join(F.broadcast(blocks), "dim").select(
            "dim", every_block(F.col("parts")).alias("part"), block_of(F.col("id"), F.col("turns")).alias("turn"),
            "id", "vec", F.coalesce(least, F.lit(-np.inf)).alias("least"),
        )

    first = ranked(_searched(dealt.where(early), asking(asked, F.lit(-np.inf)).where(early), k), k)
    first = store(first.drop("rank"), "first")
    # a score that k rows reach, for each query that has found so many
    bounds = first.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("have"), F.min("score").alias("low"))
    known = F.when(F.col("have") == k, F.col("low").cast("double"))
    rest = _searched(dealt.where(~early), asking(asked.join(bounds, "id", "left"), known).where(~early), k)
    return ranked(first.unionByName(rest), k)


def _searched(dealt: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    group = ["dim", "part", "turn"]
    return (
        dealt.groupBy(*group)
        .cogroup(asking.groupBy(*group))
        .applyInPandas(lambda v, q: best_in_block(v, q, k), "query_id long, vec_id long, score long")
    )
