"""Rolling-origin evaluation: only the fits loop over folds."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.features import add_time_features
from riskweave.models import calibrate, detector
from riskweave.operators import resample, rolling, splits
from riskweave.operators.reconcile import count_mismatches, require_equal
from riskweave.options import OPERATING_THRESHOLD, Options
from riskweave.session import side_by_side, store


@dataclass(frozen=True)
class RollingReport:
    folds: list[splits.Fold]
    scores: DataFrame  # fold, transaction_id, y, p, p_raw_slice, p_calibrated, slice_rate
    audit: DataFrame
    metrics: DataFrame
    thresholds: DataFrame
    calibration: DataFrame
    intervals: DataFrame


def fold_scores(tx: DataFrame, folds: list[splits.Fold], options: Options) -> DataFrame:
    """Test windows of all folds, scored by the fold's model and by its calibrated model."""

    def fit(rows: DataFrame):
        return detector.fit(
            rows, options.model, options.seed, options.rounds, options.learning_rate
        )

    seen = store(splits.with_first_seen(tx), "seen")

    def one(fold: splits.Fold) -> DataFrame:
        first = F.col("first_seen")
        train = seen.where(first < F.lit(fold.cut))
        test = seen.where(first >= F.lit(fold.cut))
        if fold.end is not None:
            test = test.where(first < F.lit(fold.end))
        cut = splits.cut_timestamp(
            train.drop("first_seen"), 1 - options.calibration_size
        )
        model, slice_model = side_by_side(fit, [train, train.where(first < F.lit(cut))])
        held = store(
            detector.scored_table(slice_model, train.where(first >= F.lit(cut))), "held"
        )
        platt = calibrate.fit_platt(held)
        rate = held.agg(F.avg("y").alias("rate")).first()["rate"]
        own = detector.scored_table(model, test).select("transaction_id", "timestamp", "y", "p")
        other = detector.scored_table(slice_model, test).select(
            "transaction_id", F.col("p").alias("p_raw_slice")
        )
        return store(
            own.join(other, "transaction_id")
            .withColumn("p_calibrated", platt.apply(F.col("p_raw_slice")))
            .withColumn("slice_rate", F.lit(rate))
            .withColumn("fold", F.lit(fold.index)),
            "fold",
        )

    # as many folds as there are train fractions
    return reduce(DataFrame.unionByName, side_by_side(one, folds))


def calibration_by_fold(scores: DataFrame) -> DataFrame:
    """Brier scores (raw, Platt, constant slice rate) and expected against observed frauds."""
    y = F.col("y")

    def brier(column: str):
        return F.avg((F.col(column) - y) * (F.col(column) - y))

    return scores.groupBy("fold").agg(
        brier("p_raw_slice").alias("brier_raw"),
        brier("p_calibrated").alias("brier_platt"),
        brier("slice_rate").alias("brier_constant"),
        F.sum("p_calibrated").alias("expected_frauds"),
        F.sum("y").alias("observed_frauds"),
    )


def rolling_report(tx: DataFrame, options: Options = Options()) -> RollingReport:
    rows = add_time_features(tx)
    folds = splits.build_folds(rows, options.train_fractions, options.min_test_fraud)
    audit = store(splits.leakage_audit(rows, folds), "audit")
    # before any fit: a fold that leaks is an error, not a line in a report
    require_equal(audit.where((F.col("straddling_rows") > 0) | F.col("train_seen_after_cut")), "leakage between folds")
    scores = fold_scores(rows, folds, options)
    pooled = rolling.with_pool(scores)
    return RollingReport(
        folds,
        scores,
        audit,
        rolling.fold_metrics(scores, calibrated="p_calibrated"),
        rolling.threshold_metrics(pooled, (0.5, OPERATING_THRESHOLD), ["fold"]),
        calibration_by_fold(pooled),
        resample.window_bootstrap(scores, options.resamples, options.seed),
    )


HEADLINE = (
    "n_train", "n_test", "n_test_fraud", "average_precision", "ci_lower", "ci_upper", "recall",
)


def headline(report: RollingReport, fold: int) -> DataFrame:
    """One row: what identifies the model and split of a fold. Metrics are rounded to 4 digits."""
    own = F.col("fold") == fold
    sizes = report.audit.where(own).select("fold", F.col("train_rows").alias("n_train"))
    plain = report.metrics.where(own).select(
        "fold", F.col("n_rows").alias("n_test"), F.col("frauds").alias("n_test_fraud"), "average_precision"
    )
    interval = report.intervals.where(own & (F.col("metric") == "average_precision")).select(
        "fold", "ci_lower", "ci_upper"
    )
    half = report.thresholds.where(own & (F.col("threshold") == 0.5)).select("fold", "recall")
    row = sizes.join(plain, "fold").join(interval, "fold").join(half, "fold")
    metrics = HEADLINE[3:]
    return row.select("fold", *HEADLINE[:3], *[F.round(m, 4).alias(m) for m in metrics])


def same_headline(report: RollingReport, fold: int, stored: DataFrame) -> DataFrame:
    """The fold's headline beside a stored one (a row of `headline`), where any field differs;
    empty when both describe the same model and split."""
    return count_mismatches(headline(report, fold), stored, "fold", HEADLINE)


def check_headline(report: RollingReport, fold: int, stored: DataFrame) -> None:
    require_equal(same_headline(report, fold, stored), "headline of a fold")
