"""What both vector searches share: packed vectors, bounded blocks, the nearest rows per query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def packed_vectors(df: DataFrame, id_column: str, vector_column: str, zero_allowed: bool) -> DataFrame:
    """(id BIGINT, dim, vec): vectors as float64 bytes, unusable ones left out.

    Left out are null ids, null and empty vectors, vectors with a null or non-finite component,
    and zero vectors unless allowed.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, v in zip(b["id"], b["vec"]):
                x = np.asarray(v, np.float64)
                if x.size and np.isfinite(x).all() and (zero_allowed or x.any()):
                    rows.append((i, x.size, x.tobytes()))
            if rows:
                yield pd.DataFrame(rows, columns=["id", "dim", "vec"])

    slim = df.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vec")
    ).where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    return slim.mapInPandas(pack, "id long, dim int, vec binary")


def matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def first_copies(rows: pd.DataFrame, keep: int) -> pd.DataFrame:
    """Of equal vectors the `keep` smallest ids, in order of ids, each id and vector once.

    Copies score alike and ties go to the smaller id, so with one more copy than rows wanted
    (a query may be one of them) no further copy can be among the wanted ones.
    """
    rows = rows.drop_duplicates(["id", "vec"]).sort_values("id", kind="stable", ignore_index=True)
    return rows[rows.groupby("vec", sort=False).cumcount() < keep].reset_index(drop=True)


def best_rows(
    query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, id, score) for each query: highest score, then smallest id; an id
    counts once for a query, with its best score."""
    falling = -score if score.dtype.kind == "f" else ~score  # ~ can't overflow
    order = np.lexsort((ids, falling, query))
    order = order[~pd.DataFrame({"q": query[order], "i": ids[order]}).duplicated().to_numpy()]
    q = query[order]
    begin = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    at = np.arange(len(q)) - np.maximum.accumulate(np.where(begin, np.arange(len(q)), 0))
    order = order[at < k]
    return query[order], ids[order], score[order]


def rows_for(k: int, ids: np.ndarray) -> int:
    """How many best rows hold k different ids, if some ids have several rows."""
    most = np.unique(ids, return_counts=True)[1].max(initial=1)
    return int((k - 1) * most + 1)


def block_of(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks).cast("int")


def every_block(blocks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), blocks - 1))


def blocks_for(count: Column, rows: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(count / F.lit(rows))).cast("int")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of each query; an id counts once."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        once.withColumn("rank", F.row_number().over(order).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
