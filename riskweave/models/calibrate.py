"""Probability calibration on a slice that the model did not see."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.scores import logit, sigmoid
from riskweave.operators.ordered import row_positions, scan
from riskweave.session import store


def _score_counts(scored: DataFrame) -> DataFrame:
    """(p, y, n) per distinct score and label: the fits below iterate over this, not over rows."""
    return scored.groupBy("p", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))


@dataclass(frozen=True)
class PlattMap:
    """p_calibrated = sigmoid(a * logit(p) + b)."""

    a: float
    b: float

    def apply(self, p: Column) -> Column:
        return sigmoid(F.lit(self.a) * logit(p) + F.lit(self.b))


RIDGE = 1e-9  # a part of the rows; only keeps a fit on separable rows finite
MOST_STEPS = 60


def fit_platt(scored: DataFrame) -> PlattMap:
    """Two-parameter logistic fit on the log-odds, by Newton steps on the counts of distinct scores.

    A step sends six sums to the driver. A step that makes the loss worse is halved. No rows give
    the map that changes nothing."""
    rows = store(_score_counts(scored).select(logit(F.col("p")).alias("z"), "y", "n"), "scores")
    total = rows.agg(F.sum("n")).first()[0]
    if not total:
        return PlattMap(1.0, 0.0)
    ridge = RIDGE * total

    def sums(a: float, b: float):
        m = F.lit(a) * F.col("z") + F.lit(b)
        p, z, n = sigmoid(m), F.col("z"), F.col("n")
        h = n * p * (1 - p)
        # log(1 + exp(m)) - y m without overflow
        loss = n * (F.greatest(m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m))) - F.col("y") * m)
        return rows.agg(
            F.sum(loss), F.sum(n * (p - F.col("y")) * z), F.sum(n * (p - F.col("y"))),
            F.sum(h * z * z), F.sum(h * z), F.sum(h),
        ).first()

    at, step = np.zeros(2), np.zeros(2)
    now = sums(*at)
    for _ in range(MOST_STEPS):
        grad = np.array(now[1:3]) + ridge * at
        step = np.linalg.solve(np.array([[now[3], now[4]], [now[4], now[5]]]) + ridge * np.eye(2), grad)
        size = 1.0
        while True:
            new = sums(*(at - size * step))
            if new[0] <= now[0] + 1e-9 * abs(now[0]) or size < 1e-6:
                break
            size /= 2
        at, now = at - size * step, new
        if np.abs(step).max() < 1e-12 * max(1.0, np.abs(at).max()):
            break
    return PlattMap(float(at[0]), float(at[1]))


BLOCK_ROWS = 1 << 18


def pooled(rates: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each place, the number of the block it is pooled into: neighbours that do not rise are
    pooled until all blocks do."""
    total: list[float] = []
    weight: list[float] = []
    size: list[int] = []
    for r, w in zip(rates.tolist(), weights.tolist()):
        s, n = r * w, 1
        while total and total[-1] * w >= s * weight[-1]:
            s, w, n = s + total.pop(), w + weight.pop(), n + size.pop()
        total.append(s)
        weight.append(w)
        size.append(n)
    return np.repeat(np.arange(len(size)), size)


@dataclass(frozen=True)
class IsotonicMap:
    """Rising steps (lo, hi, rate): the rate from lo to hi, a straight line between steps, the end
    values outside."""

    steps: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds `p_isotonic`. Distinct scores are placed among the steps by ordered scans, in
        both directions, since steps may be as many as scores."""
        ends = F.array(F.col("lo"), F.col("hi"))
        points = self.steps.select(F.explode(F.array_distinct(ends)).alias("p"), "rate").select(
            "p", F.struct("p", "rate").alias("point"), F.lit(0).alias("ask")
        )
        asks = df.select(F.col("p").cast("double").alias("p")).where("p is not null").distinct()
        asks = asks.select("p", F.lit(None).cast(points.schema["point"].dataType).alias("point"), F.lit(1).alias("ask"))
        rows = points.unionByName(asks)
        before = scan(rows, ["p", "ask"], last=["point"]).where("ask = 1")
        after = scan(rows.withColumn("_down", -F.col("p")), ["_down", "ask"], last=["point"]).where("ask = 1")
        a, b = F.col("a"), F.col("b")
        share = F.try_divide(F.col("_p") - a["p"], b["p"] - a["p"])
        line = a["rate"] + (b["rate"] - a["rate"]) * F.coalesce(share, F.lit(0.0))
        found = before.select("p", F.col("point_prev").alias("a")).join(
            after.select("p", F.col("point_prev").alias("b")), "p"
        ).withColumnRenamed("p", "_p")
        found = found.select("_p", F.coalesce(line, a["rate"], b["rate"]).alias("p_isotonic"))
        return df.join(found, F.col("p").cast("double") == F.col("_p"), "left").drop("_p")


def fit_isotonic(scored: DataFrame, block_rows: int = BLOCK_ROWS) -> IsotonicMap:
    """Monotone step fit by pooling adjacent violators, block by block.

    Distinct scores in order are cut into blocks of a bounded number, each pooled in one task.
    What is left is cut again, half a block further on, so that neighbours that were parted now
    meet, until no two neighbours across a cut fall. Pooling in any order ends in the same steps.
    Of each round, the number of falling neighbours at cuts reaches the driver.
    """
    steps = scored.where("p is not null").groupBy(F.col("p").cast("double").alias("lo")).agg(
        F.max(F.col("p").cast("double")).alias("hi"),
        F.avg("y").alias("rate"),
        F.count(F.lit(1)).cast("double").alias("n"),
    )

    def pool(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("lo", ignore_index=True)
        rows["total"] = rows["rate"] * rows["n"]
        out = rows.groupby(pooled(rows["rate"].to_numpy(), rows["n"].to_numpy())).agg(
            cut=("cut", "first"), lo=("lo", "first"), hi=("hi", "last"), total=("total", "sum"), n=("n", "sum")
        )
        out["rate"] = out["total"] / out["n"]
        return out[["cut", "lo", "hi", "rate", "n"]]

    shift = 0
    while True:
        placed = row_positions(steps, ["lo"], "at")
        dealt = placed.withColumn("cut", F.floor((F.col("at") + F.lit(shift)) / F.lit(block_rows)))
        steps = store(
            dealt.select("cut", "lo", "hi", "rate", "n").groupBy("cut").applyInPandas(
                pool, "cut long, lo double, hi double, rate double, n double"
            ),
            "steps",
        )
        # a row per block
        ends = steps.groupBy("cut").agg(F.min_by("rate", "lo").alias("first"), F.max_by("rate", "lo").alias("last"))
        ahead = ends.select((F.col("cut") + 1).alias("cut"), F.col("last").alias("ahead"))
        falling = ends.join(ahead, "cut").where(F.col("first") <= F.col("ahead")).count()
        steps = steps.drop("cut")
        if not falling:
            return IsotonicMap(steps.select("lo", "hi", "rate"))
        shift = block_rows // 2 - shift


def calibrated_scores(
    scored: DataFrame, platt: PlattMap, isotonic: IsotonicMap
) -> DataFrame:
    """The scored table three times over: scale raw, platt and isotonic."""
    both = isotonic.transform(scored).withColumn("p_platt", platt.apply(F.col("p")))
    scales = F.array(
        F.struct(F.lit("raw").alias("scale"), F.col("p").alias("p")),
        F.struct(F.lit("platt").alias("scale"), F.col("p_platt").alias("p")),
        F.struct(F.lit("isotonic").alias("scale"), F.col("p_isotonic").alias("p")),
    )
    keep = [c for c in scored.columns if c != "p"]
    return both.withColumn("_s", F.explode(scales)).select(*keep, "_s.*")
