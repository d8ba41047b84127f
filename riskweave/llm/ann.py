"""Approximate nearest neighbours by cross-polytope hashing.

A vector is padded to a power of two and turned by fast pseudo-rotations: random signs and a
Hadamard transform, three times. Of the turned vector at most HASH_WIDTH components count, so
that the number of cells does not grow with the dimension. Each half of them hashes to its
largest signed axis, and the pair is the cell of a table. A query looks up the cells of lowest cost, its own
first. Rows of a table are dealt by the first axis and checked for the second one where they
meet; candidates are reranked by their exact cosine in the same place, so no candidate pairs
are written down.

Every row is in every table. Buckets of any size are split into blocks of a bounded number of
rows, and all of them are searched. Queries for which the cells hold fewer rows than wanted are
compared with all rows of their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.vectors import (
    best_rows,
    block_of,
    blocks_for,
    every_block,
    first_copies,
    matrix,
    packed_vectors,
    ranked,
    rows_for,
)
from riskweave.session import store

TABLES = 16
PROBES = 160  # of the cells of a table, for each query; more where vectors are wider than the hash
NEIGHBOURS = 5
HASH_WIDTH = 64
VECTOR_BLOCK = 4096
QUERY_BLOCK = 4096
SEED = 42
_SLICE = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the orthonormal Hadamard matrix, in O(n log n) each."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def padded(dim: int) -> int:
    return max(4, 1 << (dim - 1).bit_length())


def rotated(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """The components that count of unit vectors, padded and turned by the rotation of a table."""
    width = padded(x.shape[1])
    signs = np.random.default_rng([seed, table, width]).choice([-1.0, 1.0], (3, width))
    y = np.zeros((len(x), width))
    # scaled by the largest component first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    y[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    for s in signs:
        y = hadamard(y * s)
    return y[:, :HASH_WIDTH]


def _axes(half: np.ndarray) -> np.ndarray:
    """The nearest signed axis: 2 i or 2 i + 1."""
    at = np.abs(half).argmax(axis=1)
    return 2 * at + (half[np.arange(len(half)), at] < 0)


def _costs(half: np.ndarray) -> np.ndarray:
    """Of each signed axis: the squared shortfall against the nearest one."""
    signed = np.stack([half, -half], axis=2).reshape(len(half), -1)
    return (signed.max(axis=1, keepdims=True) - signed) ** 2


def cells(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = y.shape[1] // 2
    return _axes(y[:, :half]), _axes(y[:, half:])


def probes(y: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` cells of lowest cost for each row, the cell of the row itself first."""
    half = y.shape[1] // 2
    a, b = _costs(y[:, :half]), _costs(y[:, half:])
    cost = (a[:, :, None] + b[:, None, :]).reshape(len(y), -1)
    order = np.argsort(cost, axis=1, kind="stable")[:, : min(count, cost.shape[1])]
    return order // b.shape[1], order % b.shape[1]


def probes_for(dim: int, count: int) -> int:
    """Twice as many at 128 components, five times at 768: the hash says less of wide vectors."""
    return count * max(1, (padded(dim) // (HASH_WIDTH // 2)).bit_length() - 1)


def _by_dim(batch: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    for dim, rows in batch.groupby("dim"):
        yield int(dim), rows, matrix(rows["vec"])


def indexed(vectors: DataFrame, tables: int, seed: int, with_vectors: bool) -> DataFrame:
    """(dim, tab, cell, second, id[, vec]): a row for each vector and table."""

    def hash_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows, x in _by_dim(batch):
                for t in range(tables):
                    first, second = cells(rotated(x, t, seed))
                    out = {"dim": dim, "tab": t, "cell": first, "second": second, "id": rows["id"].to_numpy()}
                    if with_vectors:
                        out["vec"] = rows["vec"].to_numpy()
                    yield pd.DataFrame(out)

    extra = ", vec binary" if with_vectors else ""
    return vectors.mapInPandas(hash_rows, "dim int, tab int, cell int, second int, id long" + extra)


def probed(queries: DataFrame, tables: int, count: int, seed: int) -> DataFrame:
    """(dim, tab, cell, seconds, id, vec): for each query and table a row per first axis, with
    the second axes to look at there as bytes of 32-bit numbers."""

    def hash_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows, x in _by_dim(batch):
                for t in range(tables):
                    out = []
                    for a in range(0, len(x), _SLICE):
                        part = rows.iloc[a : a + _SLICE]
                        first, second = probes(rotated(x[a : a + _SLICE], t, seed), probes_for(dim, count))
                        for f, s, i, v in zip(first, second, part["id"], part["vec"]):
                            out += [(dim, t, int(c), s[f == c].astype("<i4").tobytes(), i, v) for c in np.unique(f)]
                    yield pd.DataFrame(out, columns=["dim", "tab", "cell", "seconds", "id", "vec"])

    return queries.mapInPandas(hash_rows, "dim int, tab int, cell int, seconds binary, id long, vec binary")


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, each row by the same order of sums."""
    dot = (a * b).sum(axis=1)
    return dot / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def nearest_in_cell(vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query_id, vec_id, score): the k nearest rows of a block for each query that looks there."""
    vectors = first_copies(vectors, k + 1) if len(vectors) else vectors
    out = []
    if len(vectors) and len(queries):
        x, ids = matrix(vectors["vec"]), vectors["id"].to_numpy()
        unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        second = vectors["second"].to_numpy()
        wide, deep = 2 * min(padded(x.shape[1]), HASH_WIDTH), rows_for(k, ids)
        for a in range(0, len(queries), _SLICE):
            part = queries.iloc[a : a + _SLICE]
            q, own = matrix(part["vec"]), part["id"].to_numpy()
            looks = np.zeros((len(part), wide), bool)
            for i, s in enumerate(part["seconds"]):
                looks[i, np.frombuffer(s, "<i4")] = True
            near = (q / np.sqrt((q * q).sum(axis=1, keepdims=True))) @ unit.T
            near[~looks[:, second] | (own[:, None] == ids[None, :])] = -np.inf
            # the product's rounding depends on the place; what is close is measured again
            kth = np.partition(near, -deep, axis=1)[:, -deep] if near.shape[1] > deep else np.full(len(part), -2.0)
            i, j = np.nonzero(near >= np.maximum(kth - 1e-9, -2.0)[:, None])
            out.append(best_rows(own[i], ids[j], cosine(q[i], x[j]), k))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 3
    return pd.DataFrame({"query_id": columns[0].astype("int64"), "vec_id": columns[1].astype("int64"), "score": columns[2]})


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = NEIGHBOURS,
    tables: int = TABLES,
    count: int = PROBES,
    seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): k rows of largest cosine found for each query, or all
    that there are.

    A query does not find rows with its own id. Ties go to the smaller id. Rows with a null id
    and vectors that are null, empty, zero or hold a null or non-finite component take no part;
    neither do they as queries. Only vectors of equal length meet. Ids that occur more than
    once count once, with their best vector. Empty tables give an empty result.
    """
    base = store(packed_vectors(vectors, id_column, vector_column, False), "vectors")
    asked = store(packed_vectors(queries, id_column, vector_column, False).dropDuplicates(), "queries")
    look = store(probed(asked, tables, count, seed), "probes")
    # at most a row for each table and first axis, for each length of vectors
    sizes = indexed(base, tables, seed, False).groupBy(*_CELL).agg(F.count(F.lit(1)).alias("rows"))
    found = store(ranked(_met(indexed(base, tables, seed, True), sizes, look, k), k), "found")
    short = short_queries(base, asked, found, k)
    if short.isEmpty():
        return found
    # a query's other vectors are in `found` or in the pass over all rows
    rest = found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti")
    return rest.unionByName(ranked(_all_met(base, short, k), k))


_CELL = ["dim", "tab", "cell"]


def _met(rows: DataFrame, sizes: DataFrame, look: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the nearest rows of each block of a cell for the queries there."""
    asks = look.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("asks"))
    blocks = store(
        sizes.join(asks, _CELL).select(
            *_CELL,
            blocks_for(F.col("rows"), VECTOR_BLOCK).alias("parts"),
            blocks_for(F.col("asks"), QUERY_BLOCK).alias("turns"),
        ),
        "blocks",
    )
    bounded = F.broadcast(blocks)
    dealt = rows.join(bounded, _CELL).select(
        *_CELL, block_of(F.col("id"), F.col("parts")).alias("part"), every_block(F.col("turns")).alias("turn"),
        "second", "id", "vec",
    )
    asking = look.join(bounded, _CELL).select(
        *_CELL, every_block(F.col("parts")).alias("part"), block_of(F.col("id"), F.col("turns")).alias("turn"),
        "seconds", "id", "vec",
    )
    group = [*_CELL, "part", "turn"]
    return (
        dealt.groupBy(*group)
        .cogroup(asking.groupBy(*group))
        .applyInPandas(
            lambda v, q: nearest_in_cell(v, q, k), "query_id long, vec_id long, score double"
        )
    )


def short_queries(base: DataFrame, asked: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The vectors (id, dim, vec) of the queries with fewer than `k` rows found, though there may
    be more: ids are counted once for each length of a query's vectors."""
    counts = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("have"))
    few = asked.join(counts, "id", "left").where(F.coalesce("have", F.lit(0)) < k)
    ids = base.select("dim", "id").distinct()
    # a row for each length of vectors
    there = ids.groupBy("dim").agg(F.count(F.lit(1)).alias("ids"))
    own = ids.withColumn("own", F.lit(1))
    each = few.select("id", "dim", "have").distinct().join(F.broadcast(there), "dim").join(own, ["dim", "id"], "left")
    most = each.groupBy("id").agg(
        F.sum(F.col("ids") - F.coalesce("own", F.lit(0))).alias("most"), F.first("have").alias("have")
    )
    more = most.where(F.coalesce("have", F.lit(0)) < F.col("most")).select("id")
    return store(few.join(more, "id", "left_semi").select("id", "dim", "vec"), "short")


def _all_met(base: DataFrame, short: DataFrame, k: int) -> DataFrame:
    """The nearest among all rows of a query's length: one cell for each length."""
    none = {"tab": F.lit(0), "cell": F.lit(0)}
    rows = base.withColumns(none | {"second": F.lit(0)})
    sizes = rows.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("rows"))
    return _met(rows, sizes, short.withColumns(none | {"seconds": F.unhex(F.lit("00000000"))}), k)
