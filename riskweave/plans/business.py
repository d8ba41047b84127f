"""The business case: policies at one operating point, their intervals and the sweep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from riskweave.operators import curves, policies, reconcile, resample
from riskweave.options import OPERATING_THRESHOLD, SENSITIVITY_GRID, Options

SHARED_COUNTS = (
    "n_sent_to_review",
    "n_flagged_fraud",
    "fraud_caught_auto",
    "fraud_in_review_queue",
    "fraud_missed",
)


@dataclass(frozen=True)
class BusinessCase:
    outcomes: DataFrame
    comparison: DataFrame
    sensitivity: DataFrame
    neighbours: DataFrame
    intervals: DataFrame


def business_case(
    scored: DataFrame, t: float = OPERATING_THRESHOLD, options: Options = Options()
) -> BusinessCase:
    """`scored` is read several times: pass a written table."""
    sweep = policies.sensitivity_table(scored, SENSITIVITY_GRID)
    return BusinessCase(
        policies.policy_outcomes(scored, policies.four_policies(t)),
        policies.compare_policies(scored, t),
        sweep,
        curves.neighbouring_points(sweep, t),
        resample.policy_bootstrap(scored, t, options.resamples, options.seed),
    )


def check_against_stored(scored: DataFrame, stored: DataFrame) -> None:
    """Fails unless the counts match the stored curve at every threshold both have."""
    thresholds = [r["review_threshold"] for r in stored.select("review_threshold").collect()]
    rebuilt = curves.review_curve(scored, thresholds)
    reconcile.require_equal(
        reconcile.count_mismatches(rebuilt, stored, "review_threshold", SHARED_COUNTS),
        "review-band counts",
    )
