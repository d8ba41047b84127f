"""Policies in operations units: alerts, queues, rates per 10,000 and amounts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.scores import confidence, decide, decide_split, ratio
from riskweave.operators.cells import over_points, score_cells
from riskweave.options import OPERATING_THRESHOLD, PER, SENSITIVITY_GRID


def flagged(kind: Column, p: Column, t: Column) -> Column:
    """Rows a policy flags. `band` decides only from confidence t up, `single` flags from t up,
    `low` flags everything the band does not clear."""
    return (
        F.when(kind == "band", (confidence(p) >= t) & (p >= 0.5))
        .when(kind == "single", p >= t)
        .when(kind == "low", p > 1 - t)
    )


def queued(kind: Column, p: Column, t: Column) -> Column:
    return (kind == "band") & (confidence(p) < t)


def check_disjoint(rows: DataFrame) -> DataFrame:
    """Fails the job if a row is both flagged and queued."""
    both = F.col("flagged") & F.col("queued")
    return rows.withColumn(
        "flagged",
        F.when(both, F.raise_error(F.lit("a row is both flagged and queued")).cast("boolean"))
        .otherwise(F.col("flagged")),
    )


def outcome(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts, rates and amounts per group of weighted rows
    (n, amount, y, flagged, queued)."""
    n, amount = F.col("n"), F.col("amount")
    fraud, flag, queue = F.col("y") == 1, F.col("flagged"), F.col("queued")
    clear = ~flag & ~queue

    def count(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, n)), F.lit(0)).cast("long")

    def money(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, amount)), F.lit(0)).cast("double")

    c = F.col
    sums = (
        check_disjoint(rows)
        .groupBy(*by)
        .agg(
            F.sum(n).cast("long").alias("n_transactions"),
            count(flag).alias("alerts_auto_flagged"),
            count(flag & fraud).alias("true_alerts"),
            count(queue).alias("sent_to_review"),
            count(queue & fraud).alias("fraud_in_review"),
            count(clear & fraud).alias("fraud_missed"),
            count(fraud).alias("fraud_total"),
            money(fraud).alias("fraud_amount_total"),
            money(flag & fraud).alias("fraud_amount_caught_auto"),
            money(queue & fraud).alias("fraud_amount_in_review"),
            money(clear & fraud).alias("fraud_amount_missed"),
            money(flag & ~fraud).alias("legit_amount_auto_flagged"),
        )
    )
    full = (
        sums.withColumn("false_alerts", c("alerts_auto_flagged") - c("true_alerts"))
        .withColumn("legit_sent_to_review", c("sent_to_review") - c("fraud_in_review"))
        .withColumn(
            "legit_flagged_or_queued", c("false_alerts") + c("legit_sent_to_review")
        )
        .withColumn("flagged_or_queued", c("alerts_auto_flagged") + c("sent_to_review"))
        .withColumn("fraud_caught_auto", c("true_alerts"))
    )
    per_10k = {
        "alerts_per_10k": "alerts_auto_flagged",
        "false_alerts_per_10k": "false_alerts",
        "review_queue_per_10k": "sent_to_review",
        "legit_flagged_or_queued_per_10k": "legit_flagged_or_queued",
        "flagged_or_queued_per_10k": "flagged_or_queued",
        "fraud_missed_per_10k": "fraud_missed",
    }
    for name, source in per_10k.items():
        full = full.withColumn(name, c(source) * F.lit(PER) / c("n_transactions"))
    caught_amount = c("fraud_amount_caught_auto")
    return (
        full.withColumn("precision_on_alerts", ratio(c("true_alerts"), c("alerts_auto_flagged")))
        .withColumn("false_alerts_per_true_alert", ratio(c("false_alerts"), c("true_alerts")))
        .withColumn("fraud_share_caught_auto", ratio(c("true_alerts"), c("fraud_total")))
        .withColumn(
            "fraud_share_surfaced",
            ratio(c("true_alerts") + c("fraud_in_review"), c("fraud_total")),
        )
        .withColumn("fraud_share_missed", ratio(c("fraud_missed"), c("fraud_total")))
        .withColumn("review_queue_fraud_rate", ratio(c("fraud_in_review"), c("sent_to_review")))
        .withColumn(
            "fraud_amount_share_caught_auto", ratio(caught_amount, c("fraud_amount_total"))
        )
        .withColumn(
            "fraud_amount_share_surfaced",
            ratio(caught_amount + c("fraud_amount_in_review"), c("fraud_amount_total")),
        )
        .withColumn(
            "fraud_amount_share_missed", ratio(c("fraud_amount_missed"), c("fraud_amount_total"))
        )
    )


def policy_rows(
    scored: DataFrame, policies: Sequence[tuple[str, str, float]], by: Sequence[str] = ()
) -> DataFrame:
    """Cells once per (policy, kind, t) with that policy's masks."""
    thresholds = [t for _, _, t in policies]
    lows = [1 - t for _, kind, t in policies if kind == "low"]
    cells = score_cells(scored, [*thresholds, *lows], thresholds, by)
    rows = over_points(cells, policies, ["policy", "kind", "t"])
    p, kind, t = F.col("p"), F.col("kind"), F.col("t")
    return rows.withColumn("flagged", flagged(kind, p, t)).withColumn(
        "queued", queued(kind, p, t)
    )


def policy_outcomes(
    scored: DataFrame, policies: Sequence[tuple[str, str, float]], by: Sequence[str] = ()
) -> DataFrame:
    return outcome(policy_rows(scored, policies, by), [*by, "policy"])


def four_policies(t: float) -> list[tuple[str, str, float]]:
    """A: one cut at 0.5. B: one cut at t. C: the review band at t. D: one cut at 1-t."""
    return [("A", "single", 0.5), ("B", "single", t), ("C", "band", t), ("D", "low", t)]


def compare_policies(scored: DataFrame, t: float = OPERATING_THRESHOLD) -> DataFrame:
    """One row of differences between the four policies."""
    rows = policy_rows(scored, four_policies(t))
    table = outcome(rows, ["policy"])

    def of(policy: str, name: str) -> Column:
        return F.max(F.when(F.col("policy") == policy, F.col(name)))

    touched = F.col("flagged") | F.col("queued")
    # C and D surface the same rows if they agree on every cell
    surfaced = (
        rows.groupBy("p", "y")
        .agg(
            F.bool_or((F.col("policy") == "C") & touched).alias("c"),
            F.bool_or((F.col("policy") == "D") & touched).alias("d"),
        )
        .agg(F.bool_and(F.col("c") == F.col("d")).alias("same"))
    )
    a_fa, c_fa = of("A", "false_alerts"), of("C", "false_alerts")
    b_fa = of("B", "false_alerts")
    return table.agg(
        a_fa.alias("a_false_alerts"),
        b_fa.alias("b_false_alerts"),
        c_fa.alias("c_false_alerts"),
        ratio(a_fa - b_fa, a_fa).alias("b_vs_a_false_alert_reduction"),
        ratio(a_fa - c_fa, a_fa).alias("c_vs_a_false_alert_reduction"),
        of("A", "fraud_missed").alias("a_fraud_missed"),
        of("B", "fraud_missed").alias("b_fraud_missed"),
        of("C", "fraud_missed").alias("c_fraud_missed"),
        of("A", "flagged_or_queued").alias("a_flagged_or_queued"),
        of("C", "flagged_or_queued").alias("c_flagged_or_queued"),
        of("A", "legit_flagged_or_queued").alias("a_legit_flagged_or_queued"),
        of("C", "legit_flagged_or_queued").alias("c_legit_flagged_or_queued"),
        of("C", "sent_to_review").alias("c_vs_a_added_review_queue"),
        of("C", "review_queue_per_10k").alias("c_vs_a_added_review_queue_per_10k"),
        (of("B", "alerts_auto_flagged") == of("C", "alerts_auto_flagged")).alias(
            "c_vs_b_same_alerts"
        ),
        (b_fa == c_fa).alias("c_vs_b_same_false_alerts"),
        (of("B", "fraud_missed") - of("C", "fraud_missed")).alias(
            "c_vs_b_reviewed_instead_of_cleared"
        ),
        of("B", "fraud_amount_missed").alias("b_fraud_amount_missed"),
        of("C", "fraud_amount_missed").alias("c_fraud_amount_missed"),
        of("C", "alerts_auto_flagged").alias("c_alerts"),
        of("D", "alerts_auto_flagged").alias("d_alerts"),
        of("C", "precision_on_alerts").alias("c_precision_on_alerts"),
        of("D", "precision_on_alerts").alias("d_precision_on_alerts"),
    ).withColumn("c_vs_d_same_surfaced_set", surfaced.scalar())


SENSITIVITY_COLUMNS = (
    "alerts_per_10k",
    "false_alerts_per_10k",
    "review_queue_per_10k",
    "review_share_of_traffic",
    "precision_on_alerts",
    "fraud_caught_auto",
    "fraud_in_review",
    "fraud_missed",
    "fraud_amount_share_caught_auto",
    "fraud_amount_share_surfaced",
    "fraud_amount_share_missed",
)


def sensitivity_table(
    scored: DataFrame, thresholds: Sequence[float] = SENSITIVITY_GRID
) -> DataFrame:
    """The review band at every threshold of the sweep."""
    cells = score_cells(scored, confidence_cuts=thresholds)
    rows = over_points(cells, [(float(t),) for t in thresholds], ["review_threshold"])
    p, t, band = F.col("p"), F.col("review_threshold"), F.lit("band")
    rows = rows.withColumn("flagged", flagged(band, p, t)).withColumn(
        "queued", queued(band, p, t)
    )
    table = outcome(rows, ["review_threshold"]).withColumn(
        "review_share_of_traffic", ratio(F.col("sent_to_review"), F.col("n_transactions"))
    )
    return table.select("review_threshold", *SENSITIVITY_COLUMNS)


def lane_totals(
    scored: DataFrame,
    t: float | None = None,
    cuts: tuple[float, float] | None = None,
    minutes_per_review: float = 5.0,
) -> DataFrame:
    """Per lane: rows, frauds, fraud and legit amounts, and analyst hours per 10,000 rows for
    the review lane. Either one threshold or a (flag_at, clear_at) pair."""
    if cuts is not None:
        if not cuts[0] > cuts[1]:
            raise ValueError("the flag cut must be above the clear cut")
        cells = score_cells(scored, score_cuts=cuts)
        lane = decide_split(F.col("p"), *cuts)
    else:
        cells = score_cells(scored, confidence_cuts=[t])
        lane = decide(F.col("p"), t)
    fraud = F.col("y") == 1
    table = cells.groupBy(lane.alias("lane")).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(fraud, F.col("n"))), F.lit(0)).alias("frauds"),
        F.coalesce(F.sum(F.when(fraud, F.col("amount"))), F.lit(0))
        .cast("double")
        .alias("fraud_amount"),
        F.coalesce(F.sum(F.when(~fraud, F.col("amount"))), F.lit(0))
        .cast("double")
        .alias("legit_amount"),
    )
    rows = cells.agg(F.sum("n").alias("n")).scalar()
    hours = F.col("n") * F.lit(PER) / rows * F.lit(minutes_per_review) / F.lit(60.0)
    return table.withColumn("review_hours", F.when(F.col("lane") == "review", hours))


def trade_off(scored: DataFrame, grid: Sequence[float]) -> DataFrame:
    """Queue share, false alerts per 10,000 and misses over a fine threshold grid."""
    table = sensitivity_table(scored, grid)
    return table.select(
        "review_threshold", "review_share_of_traffic", "false_alerts_per_10k", "fraud_missed"
    )
