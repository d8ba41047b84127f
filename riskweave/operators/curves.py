"""Review-band curves, decoupled cuts and priced operating points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.scores import FRAUD, LEGIT, REVIEW, decide, decide_split, ratio
from riskweave.operators.cells import over_points, score_cells
from riskweave.options import REVIEW_THRESHOLDS


def _lane_counts(rows: DataFrame, lane: Column, keys: Sequence[str]) -> DataFrame:
    """The curve columns from weighted cells and a lane expression."""
    n, fraud = F.col("n"), F.col("y") == 1

    def total(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, n)), F.lit(0)).cast("long")

    laned = rows.withColumn("_lane", lane)
    in_lane = F.col("_lane")
    counted = laned.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        total(in_lane == REVIEW).alias("n_sent_to_review"),
        total(in_lane == FRAUD).alias("n_flagged_fraud"),
        total((in_lane == FRAUD) & fraud).alias("fraud_caught_auto"),
        total((in_lane == REVIEW) & fraud).alias("fraud_in_review_queue"),
        total((in_lane == LEGIT) & fraud).alias("fraud_missed"),
        total(fraud).alias("fraud_total"),
    )
    return counted.select(
        *keys,
        ratio(F.col("n_rows") - F.col("n_sent_to_review"), F.col("n_rows")).alias("coverage"),
        "n_sent_to_review",
        "n_flagged_fraud",
        ratio(F.col("fraud_caught_auto"), F.col("n_flagged_fraud")).alias(
            "precision_on_flagged"
        ),
        "fraud_caught_auto",
        "fraud_in_review_queue",
        "fraud_missed",
        ratio(F.col("fraud_caught_auto"), F.col("fraud_total")).alias("recall_auto"),
    )


def review_curve(
    scored: DataFrame,
    thresholds: Sequence[float] = REVIEW_THRESHOLDS,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per review threshold: coverage, queue, flags, precision, caught, missed, recall."""
    cells = score_cells(scored, confidence_cuts=thresholds, by=by)
    rows = over_points(cells, [(float(t),) for t in thresholds], ["review_threshold"])
    lane = decide(F.col("p"), F.col("review_threshold"))
    return _lane_counts(rows, lane, [*by, "review_threshold"])


def decoupled_curve(
    scored: DataFrame, points: Sequence[tuple[float, float]], by: Sequence[str] = ()
) -> DataFrame:
    """One row per (flag_at, clear_at) pair; the lanes must not overlap."""
    for flag_at, clear_at in points:
        if not flag_at > clear_at:
            raise ValueError(f"flag_at {flag_at} must be above clear_at {clear_at}")
    cuts = [c for pair in points for c in pair]
    cells = score_cells(scored, score_cuts=cuts, by=by)
    rows = over_points(cells, [(float(a), float(b)) for a, b in points], ["flag_at", "clear_at"])
    lane = decide_split(F.col("p"), F.col("flag_at"), F.col("clear_at"))
    return _lane_counts(rows, lane, [*by, "flag_at", "clear_at"])


def expected_cost(
    curve: DataFrame, missed_fraud: Column, false_flag: Column, review: Column
) -> DataFrame:
    """Adds the price of every operating point. Queued frauds cost one review, not a miss."""
    false_flags = F.col("n_flagged_fraud") - F.col("fraud_caught_auto")
    return curve.withColumn("n_false_flags", false_flags).withColumn(
        "expected_cost",
        F.col("fraud_missed") * missed_fraud
        + false_flags * false_flag
        + F.col("n_sent_to_review") * review,
    )


def price_curve(curve: DataFrame, scenarios: Sequence[tuple]) -> DataFrame:
    """The curve once per cost scenario, priced."""
    rows = over_points(
        curve,
        scenarios,
        ["scenario", "cost_missed_fraud", "cost_false_flag", "cost_review"],
    )
    return expected_cost(
        rows, F.col("cost_missed_fraud"), F.col("cost_false_flag"), F.col("cost_review")
    )


def price_scenarios(curve: DataFrame, scenarios: Sequence[tuple]) -> DataFrame:
    """Cheapest threshold per scenario (the lowest among equals) against full automation."""
    t, cost = F.col("review_threshold"), F.col("expected_cost")
    return (
        price_curve(curve, scenarios)
        .groupBy("scenario")
        .agg(
            F.min_by(t, F.struct(cost, t)).alias("min_cost_threshold"),
            F.min(cost).alias("min_expected_cost"),
            F.max(F.when(t == 0.5, cost)).alias("full_automation_cost"),
        )
        .withColumn(
            "savings_vs_full_automation",
            F.col("full_automation_cost") - F.col("min_expected_cost"),
        )
    )


def neighbouring_points(curve: DataFrame, at: float, step: float = 0.01) -> DataFrame:
    wanted = [round(at + d, 2) for d in (-step, 0.0, step)]
    return curve.where(F.round("review_threshold", 2).isin(wanted))


def dashboard_curve(scored: DataFrame, grid: Sequence[float]) -> DataFrame:
    """Coverage and precision over a fixed grid; points that flag nothing are dropped."""
    curve = review_curve(scored, grid).select(
        "review_threshold", "coverage", "precision_on_flagged"
    )
    return curve.dropna(subset=["precision_on_flagged"])
