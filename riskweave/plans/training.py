"""Train, evaluate and calibrate on the time split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.features import add_time_features
from riskweave.models import calibrate, detector
from riskweave.operators import drift, ranking
from riskweave.operators.curves import decoupled_curve, review_curve
from riskweave.operators.splits import temporal_grouped_split
from riskweave.options import DECOUPLED_POINTS, REVIEW_THRESHOLDS, Options
from riskweave.schema import numeric_columns
from riskweave.session import freeze


@dataclass(frozen=True)
class TrainingRun:
    model: PipelineModel
    scored: DataFrame  # the test side, scored once
    headline: DataFrame
    curve: DataFrame
    reference: DataFrame


def train_and_evaluate(tx: DataFrame, options: Options = Options()) -> TrainingRun:
    """Time features, split, fit, score; metrics read the written scores, not the model."""
    train, test = temporal_grouped_split(add_time_features(tx), options.test_size)
    train = freeze(train)
    model = detector.fit(
        train, options.model, options.seed, options.rounds, options.learning_rate
    )
    scored = freeze(detector.scored_table(model, test))
    return TrainingRun(
        model,
        scored,
        headline_report(scored, train),
        review_curve(scored, REVIEW_THRESHOLDS),
        drift.reference_stats(train, numeric_columns(train), options.psi_bins),
    )


def headline_report(scored: DataFrame, train: DataFrame) -> DataFrame:
    """One row: sizes, ranking metrics and the demoted metrics at 0.5."""
    ranked = ranking.ranking_metrics(ranking.score_groups(scored)).select(
        "average_precision", "roc_auc"
    )
    plain = ranking.pointwise_metrics(scored).select(
        F.col("n").alias("n_test"),
        F.col("positives").alias("n_test_fraud"),
        "accuracy",
        "always_negative_accuracy",
        "base_rate",
        "recall",
    )
    return plain.withColumns(
        {
            "average_precision": ranked.select("average_precision").scalar(),
            "roc_auc": ranked.select("roc_auc").scalar(),
            "n_train": train.agg(F.count(F.lit(1)).alias("n")).scalar(),
            "n_train_fraud": train.agg(F.sum("is_fraud").alias("n")).scalar(),
        }
    )


@dataclass(frozen=True)
class CalibrationRun:
    platt: calibrate.PlattMap
    summary: DataFrame  # per slice and scale: Brier, average precision, score range
    reliability: DataFrame
    curve: DataFrame
    decoupled: DataFrame
    calibrated: DataFrame  # the test side with p, on every scale


def calibration_report(tx: DataFrame, options: Options = Options()) -> CalibrationRun:
    """Model on the fit slice, both maps on the calibration slice, errors on the test side. The
    shipped map is Platt's by rule: it is strictly monotone and cannot change a ranking."""
    train, test = temporal_grouped_split(add_time_features(tx), options.test_size)
    fit_rows, slice_rows = temporal_grouped_split(train, options.calibration_size)
    model = detector.fit(
        freeze(fit_rows), options.model, options.seed, options.rounds, options.learning_rate
    )
    held = freeze(detector.scored_table(model, slice_rows))
    tested = freeze(detector.scored_table(model, test))
    platt, isotonic = calibrate.fit_platt(held), calibrate.fit_isotonic(held)
    both = calibrate.calibrated_scores(held, platt, isotonic).withColumn(
        "slice", F.lit("calibration")
    )
    on_test = freeze(calibrate.calibrated_scores(tested, platt, isotonic))
    both = both.unionByName(on_test.withColumn("slice", F.lit("test")))
    keys = ["slice", "scale"]
    plain = ranking.pointwise_metrics(both, keys).select(
        *keys, "n", "positives", "brier", "score_min", "score_max"
    )
    ap = ranking.average_precision(both, keys)
    chosen = on_test.where(F.col("scale") == "platt")
    raw = on_test.where(F.col("scale") == "raw")
    reliability = (
        ranking.reliability_curve(raw)
        .withColumn("scale", F.lit("raw"))
        .unionByName(ranking.reliability_curve(chosen).withColumn("scale", F.lit("platt")))
    )
    return CalibrationRun(
        platt,
        plain.join(ap, keys),
        reliability,
        review_curve(chosen, REVIEW_THRESHOLDS),
        decoupled_curve(chosen, DECOUPLED_POINTS),
        on_test,
    )
