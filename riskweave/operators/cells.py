"""Threshold sweeps without pairing rows and thresholds.

Between two neighbouring cuts every row is treated alike, so rows are first summed up into the
cells between all cuts that a sweep uses. The cells number at most a few per cut whatever the
table's size; any policy is then evaluated on cells. One narrow shuffle serves a whole sweep.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.scores import confidence
from riskweave.operators.velocity import MONEY

EDGE = float("inf")


def _bucket(df: DataFrame, value: Column, cuts: Sequence[float], name: str) -> DataFrame:
    """Number of cuts <= value, by binary search in the JVM."""
    splits = [-EDGE, *sorted(set(float(c) for c in cuts)), EDGE]
    if len(splits) < 3:
        return df.withColumn(name, F.lit(0.0))
    return (
        Bucketizer(splits=splits, inputCol="_at", outputCol=name, handleInvalid="keep")
        .transform(df.withColumn("_at", value.cast("double")))
        .drop("_at")
    )


def score_cells(
    scored: DataFrame,
    score_cuts: Sequence[float] = (),
    confidence_cuts: Sequence[float] = (),
    by: Sequence[str] = (),
) -> DataFrame:
    """(by, y, p, n, amount): one row per cell and label. `p` is the cell's smallest score and
    stands for all of them under every test p >= c, p > c, p <= c, p < c for a score cut c and
    max(p, 1-p) >= t for a confidence cut t."""
    p = F.col("p")
    cut = [*score_cuts, 0.5]
    cells = _bucket(scored, p, cut, "_ge")
    cells = _bucket(cells, -p, [-c for c in cut], "_le")
    cells = _bucket(cells, confidence(p), confidence_cuts, "_conf")
    amount = (
        F.coalesce(F.sum(F.col("amount").cast(MONEY)), F.lit(0))
        if "amount" in scored.columns
        else F.lit(0)
    )
    return (
        cells.groupBy(*by, "_ge", "_le", "_conf", "y")
        .agg(
            F.min("p").alias("p"),
            F.count(F.lit(1)).alias("n"),
            amount.cast("decimal(38,6)").alias("amount"),
        )
        .drop("_ge", "_le", "_conf")
    )


def over_points(cells: DataFrame, points: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """Every cell once per operating point: a handful of cells times a given short list."""
    entries = [
        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, point)]) for point in points
    ]
    return cells.withColumn("_point", F.explode(F.array(*entries))).select(
        *cells.columns, "_point.*"
    )
