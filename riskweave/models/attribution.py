"""Per-row feature contributions in log-odds, and their ranking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.features import with_absent_inputs
from riskweave.functions.scores import display_name
from riskweave.models.boosting import BoosterModel
from riskweave.models.detector import expected_inputs
from riskweave.models.forest import Forest, unpacked


def feature_labels(vectors: DataFrame) -> list[str]:
    """Names of the vector's slots, from its metadata, with the block as a prefix."""
    attributes = vectors.schema["features"].metadata["ml_attr"]["attrs"]
    slots = sorted(
        ((a["idx"], a.get("name", str(a["idx"]))) for kind in attributes.values() for a in kind)
    )
    names = []
    for _, name in slots:
        block = "cat" if "_hot_" in name else "num"
        plain = name.removesuffix("_filled").removesuffix("_number")
        names.append(f"{block}__{plain.replace('_hot_', '_')}")
    return names


Step = tuple[int, float, bool, bool, float]  # feature, cut, missing goes left, went left, share


def leaf_paths(forest: Forest, tree: int) -> tuple[list[tuple[float, list[Step]]], float]:
    """(value, steps from the root) of every leaf, and the tree's expected value. A step's share
    is the part of the parent's train rows that took it."""
    paths, expected = [], 0.0
    pending = [(int(forest.start[tree]), [], 1.0)]
    while pending:
        node, steps, reach = pending.pop()
        if forest.left[node] < 0:
            value = float(forest.value[node])
            paths.append((value, steps))
            expected += reach * value
            continue
        test = int(forest.feature[node]), float(forest.cut[node]), bool(forest.missing_left[node])
        for child, left in ((int(forest.left[node]), True), (int(forest.right[node]), False)):
            share = float(forest.count[child]) / float(forest.count[node])
            pending.append((child, [*steps, (*test, left, share)], reach * share))
    return paths, expected


def _took(x: np.ndarray, feature: int, cut: float, missing_left: bool) -> np.ndarray:
    """Whether a test sends rows to the left."""
    column = x[:, feature]
    return np.where(np.isnan(column), missing_left, column <= cut)


def leaf_contributions(
    x: np.ndarray, value: float, steps: Sequence[Step], known: dict | None = None
) -> dict[int, np.ndarray]:
    """Shapley values of one leaf for all rows of x. A feature on the path lets a row through (1)
    or not (0); left out, it passes the share of train rows that took this way.

    The weighted sum over all subsets of the others is the integral over t in [0, 1] of the
    product of share * (1 - t) + pass * t, a polynomial, which Gauss-Legendre nodes, half as many
    as there are features, integrate exactly. It depends only on which features let a row
    through, so it is worked out once for each such pattern where there are fewer than rows.
    `known` keeps the outcomes of tests for other leaves and the same rows.
    """
    known = {} if known is None else known
    passes: dict[int, np.ndarray] = {}
    shares: dict[int, float] = {}
    for feature, cut, missing_left, left, share in steps:
        test = feature, cut, missing_left
        if test not in known:
            known[test] = _took(x, *test)
        took = known[test] == left
        passes[feature] = passes[feature] & took if feature in passes else took
        shares[feature] = shares.get(feature, 1.0) * share
    features = list(passes)
    m = len(features)
    if not m:
        return {}
    pattern = None
    if 1 << m < len(x):
        pattern = np.zeros(len(x), np.int64)
        for i, f in enumerate(features):
            pattern |= passes[f].astype(np.int64) << i
        through = (np.arange(1 << m) >> np.arange(m)[:, None] & 1).astype(np.float64)
    else:
        through = np.stack([passes[f] for f in features]).astype(np.float64)
    share = np.array([shares[f] for f in features])[:, None]
    reach = np.zeros_like(through)
    nodes, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
    for t, weight in zip((nodes + 1) / 2, weights / 2):
        factor = share * (1 - t) + through * t
        ahead, behind = np.ones_like(factor), np.ones_like(factor)
        np.cumprod(factor[:-1], axis=0, out=ahead[1:])
        behind[:-1] = np.cumprod(factor[:0:-1], axis=0)[::-1]
        reach += weight * ahead * behind
    found = value * reach * (through - share)
    return dict(zip(features, found if pattern is None else found[:, pattern]))


def contributions(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Every row with `contributions` (one per slot), `base` and `margin`, in log-odds. Rows stay
    in their partitions; the packed trees travel with the tasks."""
    classifier = model.stages[-1]
    ready = with_absent_inputs(df, expected_inputs(model))
    vectors = PipelineModel(model.stages[:-1]).transform(ready)
    kind = type(classifier).__name__
    if kind.startswith("LogisticRegression"):
        return _linear(classifier, vectors, df)
    if not isinstance(classifier, BoosterModel):
        raise ValueError(f"contributions need boosted trees or a linear model, not {kind}")
    packed = classifier.getOrDefault("forest")
    raw = vectors.select(
        *[F.col(f"`{c}`") for c in df.columns], vector_to_array("features").alias("x")
    )

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = unpacked(packed)
        trees = [leaf_paths(forest, t) for t in range(forest.trees)]
        base = forest.base + sum(expected for _, expected in trees)
        for batch in batches:
            if batch.empty:
                continue
            x = np.stack(batch["x"].to_numpy()).astype(np.float64)
            total = np.zeros_like(x)
            for paths, _ in trees:
                known: dict = {}
                for value, steps in paths:
                    for feature, part in leaf_contributions(x, value, steps, known).items():
                        total[:, feature] += part
            out = batch.drop(columns=["x"])
            out["margin"] = forest.margins(x)
            out["contributions"] = list(total)
            out["base"] = base
            yield out

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return raw.mapInPandas(
        explain, f"{schema}, margin double, contributions array<double>, base double"
    )


def _linear(classifier, vectors: DataFrame, df: DataFrame) -> DataFrame:
    """coefficient * (x - mean), the means taken over the explained rows."""
    width = len(classifier.coefficients)
    rows = vectors.withColumn("x", vector_to_array("features"))
    means = rows.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(width)]).select(
        F.array(*[f"m{i}" for i in range(width)]).alias("m")
    )
    weights = F.array(*[F.lit(float(c)) for c in classifier.coefficients])
    rows, mean = rows.withColumn("_mean", means.scalar()), F.col("_mean")

    def product(a: Column, b: Column) -> Column:
        terms = F.zip_with(a, b, lambda u, v: u * v)
        return F.aggregate(terms, F.lit(0.0), lambda acc, u: acc + u)

    centred = F.zip_with(F.col("x"), mean, lambda u, v: u - v)
    return rows.select(
        *df.columns,
        (product(F.col("x"), weights) + classifier.intercept).alias("margin"),
        F.zip_with(centred, weights, lambda u, v: u * v).alias("contributions"),
        (product(mean, weights) + classifier.intercept).alias("base"),
    )


def additivity_error(explained: DataFrame) -> DataFrame:
    """Largest gap between the margin and base plus contributions."""
    total = F.aggregate("contributions", F.lit(0.0), lambda acc, x: acc + x)
    gap = F.abs(F.col("margin") - (F.col("base") + total))
    return explained.agg(F.max(gap).alias("max_abs_error"))


def attribution_ranking(explained: DataFrame, names: Sequence[str], k: int = 15) -> DataFrame:
    """Top k features by mean absolute contribution, with the signed mean beside it, over all
    rows and over positives only."""
    label = F.array(*[F.lit(n) for n in names])
    scopes = F.array(F.lit("all"), F.when(F.col("is_fraud") == 1, "fraud"))
    long = (
        explained.select(
            F.filter(scopes, lambda r: r.isNotNull()).alias("scopes"),
            F.posexplode("contributions").alias("slot", "c"),
        )
        .withColumn("scope", F.explode("scopes"))
    )
    means = long.groupBy("scope", "slot").agg(
        F.avg(F.abs("c")).alias("mean_abs"), F.avg("c").alias("mean_signed")
    )
    ranked = means.groupBy("scope").agg(
        F.slice(
            F.array_sort(
                F.collect_list(
                    F.struct((-F.col("mean_abs")).alias("order"), "slot", "mean_abs", "mean_signed")
                )
            ),
            1,
            k,
        ).alias("top")
    )
    return ranked.select("scope", F.posexplode("top").alias("place", "t")).select(
        "scope",
        (F.col("place") + 1).alias("rank"),
        display_name(label[F.col("t.slot")]).alias("feature"),
        F.col("t.mean_abs").alias("mean_abs"),
        F.col("t.mean_signed").alias("mean_signed"),
    )
