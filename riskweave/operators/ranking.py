"""Ranking and probability metrics of scored tables (p, y)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.scores import ratio
from riskweave.operators.ordered import (
    equal_count_bin,
    row_positions,
    scan,
    summary_quantiles,
)


def score_groups(scored: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by, p, n, pos): rows and positives per distinct score, summed before any ordering."""
    w = F.col(weight) if weight else F.lit(1).cast("long")
    return scored.groupBy(*by, "p").agg(
        F.sum(w).alias("n"), F.coalesce(F.sum(F.when(F.col("y") == 1, w)), F.lit(0)).alias("pos")
    )


def ranked_groups(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Score groups from the highest score down with the rows and positives above them."""
    down = groups.withColumn("_down", -F.col("p"))
    return scan(down, ["_down"], sums=["n", "pos"], within=by)


def _average_precision() -> Column:
    precision = (F.col("pos_before") + F.col("pos")) / (F.col("n_before") + F.col("n"))
    return F.sum(ratio(F.col("pos"), F.col("pos_total")) * precision)


def average_precision(
    scored: DataFrame, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Sum over distinct scores of recall gain times precision; null without a positive."""
    return ranking_metrics(score_groups(scored, by, weight), by).select(*by, "average_precision")


def ranking_metrics(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average precision, ROC-AUC (ties count half) and recall at 0.5 from one scan of the score
    groups."""
    ranked = ranked_groups(groups, by)
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    negatives = F.max(F.col("n_total") - F.col("pos_total"))
    wins = F.sum(neg * (F.col("pos_before") + pos / 2))
    return ranked.groupBy(*by).agg(
        F.when(F.max("pos_total") > 0, _average_precision()).alias("average_precision"),
        ratio(wins, F.max("pos_total") * negatives).alias("roc_auc"),
        ratio(F.sum(F.when(F.col("p") >= 0.5, pos).otherwise(0)), F.max("pos_total")).alias(
            "recall"
        ),
        F.max("n_total").alias("n"),
        F.max("pos_total").alias("pos"),
    )


def pointwise_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Everything that needs no ordering, in one aggregation: confusion counts at 0.5,
    accuracies, base rate, Brier score, log loss, score range, expected positives."""
    p, y = F.col("p"), F.col("y")
    fraud, flag = y == 1, p >= 0.5
    clipped = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    c = F.col
    table = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(fraud).alias("positives"),
        F.count_if(flag & fraud).alias("tp"),
        F.count_if(flag & ~fraud).alias("fp"),
        F.count_if(~flag & fraud).alias("fn"),
        F.count_if(~flag & ~fraud).alias("tn"),
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(-F.when(fraud, F.log(clipped)).otherwise(F.log(1 - clipped))).alias("log_loss"),
        F.min(p).alias("score_min"),
        F.max(p).alias("score_max"),
        F.sum(p).alias("expected_positives"),
    )
    return (
        table.withColumn("accuracy", (c("tp") + c("tn")) / c("n"))
        .withColumn("always_negative_accuracy", (c("n") - c("positives")) / c("n"))
        .withColumn("base_rate", c("positives") / c("n"))
        .withColumn("precision", ratio(c("tp"), c("tp") + c("fp")))
        .withColumn("recall", ratio(c("tp"), c("positives")))
        .withColumn("f1", ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")))
        .withColumn("tpr", ratio(c("tp"), c("positives")))
        .withColumn("fpr", ratio(c("fp"), c("fp") + c("tn")))
        .withColumn("fnr", ratio(c("fn"), c("positives")))
    )


def constant_rate_brier(scored: DataFrame, rate: Column | float) -> DataFrame:
    """Brier score of predicting one rate for every row."""
    gap = F.lit(rate) - F.col("y") if isinstance(rate, float) else rate - F.col("y")
    return scored.agg(F.avg(gap * gap).alias("brier_constant"))


def calibration_error(
    scored: DataFrame,
    bins: int = 10,
    by: Sequence[str] = (),
    tie: Sequence[str] = ("transaction_id",),
) -> DataFrame:
    """Expected calibration error over equal-count bins of the sorted scores."""
    return calibration_bins(scored, bins, by, tie).groupBy(*by).agg(
        (F.sum(F.abs(F.col("sum_p") - F.col("sum_y"))) / F.sum("n")).alias("ece")
    )


def calibration_bins(
    scored: DataFrame,
    bins: int = 10,
    by: Sequence[str] = (),
    tie: Sequence[str] = ("transaction_id",),
) -> DataFrame:
    """Rows, score sum and positives per equal-count bin."""
    ranked = row_positions(scored.select(*by, "p", "y", *tie), ["p", *tie], "position", by)
    bin_ = equal_count_bin(F.col("position"), F.col("position_count"), bins)
    return ranked.groupBy(*by, bin_.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("sum_p"), F.sum("y").alias("sum_y")
    )


def weighted_calibration_error(
    cells: DataFrame, bins: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """The same error from weighted cells (by, p, y, w), rows ordered by (p, y). A cell that
    crosses a bin edge is divided at the edge, so rows need not be written out."""
    ranked = scan(cells, ["p", "y"], ["w"], within=by).where("w > 0")
    count = F.col("w_total")
    small, longer = F.floor(count / bins), count % bins

    def start(b: Column) -> Column:
        return b * small + F.least(b, longer)

    past = F.col("w_before") + F.col("w")
    first = equal_count_bin(F.col("w_before"), count, bins)
    final = equal_count_bin(past - 1, count, bins)
    parts = ranked.withColumn("bin", F.explode(F.sequence(first, final)))
    held = F.least(past, start(F.col("bin") + 1)) - F.greatest(
        F.col("w_before"), start(F.col("bin"))
    )
    sums = parts.groupBy(*by, "bin").agg(
        F.sum(held).alias("n"),
        F.sum(held * F.col("p")).alias("sum_p"),
        F.sum(held * F.col("y")).alias("sum_y"),
    )
    return sums.groupBy(*by).agg(
        (F.sum(F.abs(F.col("sum_p") - F.col("sum_y"))) / F.sum("n")).alias("ece")
    )


def reliability_curve(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score and positive rate per quantile bin. A score equal to an edge belongs to the
    bin below it; empty bins do not appear."""
    names = {f"e{i}": i / bins for i in range(1, bins)}
    edges = summary_quantiles(scored, "p", names)
    groups = score_groups(scored).withColumn(
        "edges", edges.select(F.array(*names).alias("edges")).scalar()
    )
    below = F.size(F.filter("edges", lambda e: e < F.col("p")))
    return groups.groupBy(below.alias("bin")).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_predicted"),
        (F.sum("pos") / F.sum("n")).alias("observed_rate"),
    )
