"""Threshold tables and fold metrics, per fold and pooled in the same pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.scores import confidence, ratio, wilson_bounds
from riskweave.operators.cells import over_points, score_cells
from riskweave.operators.ranking import calibration_error, ranking_metrics, score_groups
from riskweave.options import PER


def threshold_metrics(
    scored: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Flags at p >= t with Wilson intervals on recall, precision and false alerts, and the load
    of the review band at the same t."""
    cells = score_cells(scored, thresholds, thresholds, by)
    rows = over_points(cells, [(float(t),) for t in thresholds], ["threshold"])
    p, t, n, fraud = F.col("p"), F.col("threshold"), F.col("n"), F.col("y") == 1
    flag, queue = p >= t, confidence(p) < t

    def total(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, n)), F.lit(0)).cast("long")

    c = F.col
    sums = rows.groupBy(*by, "threshold").agg(
        F.sum(n).alias("rows"),
        total(fraud).alias("frauds"),
        total(flag).alias("n_flagged"),
        total(flag & fraud).alias("frauds_flagged"),
        total(flag & ~fraud).alias("false_alerts"),
        total(queue).alias("sent_to_review"),
        total(queue & fraud).alias("frauds_in_review"),
        total(~queue & (p < 0.5) & fraud).alias("frauds_cleared_unseen"),
    )
    recall = wilson_bounds(c("frauds_flagged"), c("frauds"))
    precision = wilson_bounds(c("frauds_flagged"), c("n_flagged"))
    false = wilson_bounds(c("false_alerts"), c("rows"))
    return sums.select(
        *by,
        "threshold",
        "n_flagged",
        "frauds_flagged",
        "false_alerts",
        "sent_to_review",
        "frauds_in_review",
        "frauds_cleared_unseen",
        ratio(c("frauds_flagged"), c("frauds")).alias("recall"),
        recall[0].alias("recall_lower"),
        recall[1].alias("recall_upper"),
        ratio(c("frauds_flagged"), c("n_flagged")).alias("precision"),
        precision[0].alias("precision_lower"),
        precision[1].alias("precision_upper"),
        (c("false_alerts") * PER / c("rows")).alias("false_alerts_per_10k"),
        (false[0] * PER).alias("false_alerts_lower"),
        (false[1] * PER).alias("false_alerts_upper"),
        (c("sent_to_review") * PER / c("rows")).alias("review_per_10k"),
    )


def with_pool(rows: DataFrame) -> DataFrame:
    """Every row for its own fold and once more for fold 0, the pool."""
    zero = F.lit(0).cast(rows.schema["fold"].dataType)
    return rows.withColumn("fold", F.explode(F.array(F.col("fold"), zero)))


def fold_metrics(rows: DataFrame, bins: int = 10, calibrated: str = "p") -> DataFrame:
    """Average precision, lift over the base rate and calibration error per fold and pooled; the
    pooled row also holds the range and mean of average precision over folds.

    `rows` holds (transaction_id, fold, y, p) and the calibrated score's column."""
    both = with_pool(rows)
    ranked = ranking_metrics(score_groups(both, ["fold"]), ["fold"])
    scale = both.select("fold", "transaction_id", "y", F.col(calibrated).alias("p"))
    ece = calibration_error(scale, bins, ["fold"])
    base = F.col("pos") / F.col("n")
    table = ranked.join(ece, "fold").select(
        "fold",
        F.col("n").alias("n_rows"),
        F.col("pos").alias("frauds"),
        base.alias("base_rate"),
        "average_precision",
        ratio(F.col("average_precision"), base).alias("lift"),
        "ece",
    )
    # one row per fold: the window covers a handful of rows
    over = Window.partitionBy(F.lit(0))
    own = F.when(F.col("fold") > 0, F.col("average_precision"))
    pool = F.col("fold") == 0
    return table.select(
        "*",
        F.when(pool, F.min(own).over(over)).alias("fold_min"),
        F.when(pool, F.max(own).over(over)).alias("fold_max"),
        F.when(pool, F.avg(own).over(over)).alias("fold_mean"),
    )
