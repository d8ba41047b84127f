"""Metrics of scored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.catalog.common import (
    EVENTS_SQL,
    SCORED_SQL,
    TEST_SQL,
    events_tx,
    order_sql,
    query,
    rounded,
    scored,
    scored_events,
    scored_test,
    stand_in,
    with_sql,
)
from riskweave.catalog.split_queries import FOLDS_SQL, OPTIONS, cuts_sql
from riskweave.functions.scores import decide, wilson_bounds
from riskweave.operators import ranking, splits
from riskweave.operators.ordered import equal_count_bin, row_positions
from riskweave.operators.resample import points_per_positive
from riskweave.operators.rolling import fold_metrics, threshold_metrics
from riskweave.session import freeze

ALL_SQL = with_sql(EVENTS_SQL, SCORED_SQL)


def decide_sql(p: str, t: str) -> str:
    return (
        f"CASE WHEN greatest({p}, 1 - {p}) < {t} THEN 'review' "
        f"WHEN {p} >= 0.5e0 THEN 'fraud' ELSE 'legit' END"
    )


@query(
    "a1_decide",
    ALL_SQL
    + f"""SELECT transaction_id, {decide_sql("p", "0.7e0")} AS decision,
  greatest(p, 1 - p) AS confidence FROM scored""",
)
def decisions(spark, folder):
    p = F.col("p")
    return scored_events(spark, folder).select(
        "transaction_id",
        decide(p, 0.7).alias("decision"),
        F.greatest(p, 1 - p).alias("confidence"),
    )


def ranked_sql(source: str, by: str = "") -> str:
    """Distinct scores from the top with cumulative counts; `by` is '' or 'col, '."""
    part = f"PARTITION BY {by.rstrip(', ')} " if by else ""
    return f"""g AS (SELECT {by}p, count(*) AS n, sum(y) AS pos FROM {source} GROUP BY {by}p),
r AS (SELECT *, sum(n) OVER ({part}ORDER BY p DESC) AS cn, sum(pos) OVER ({part}ORDER BY p DESC)
        AS cp, sum(n) OVER ({part.strip()}) AS tn, sum(pos) OVER ({part.strip()}) AS tp FROM g)"""


AP_SQL = "round(sum(CASE WHEN tp > 0 THEN pos / CAST(tp AS DOUBLE) * (cp / CAST(cn AS DOUBLE)) END), 9)"
AUC_SQL = """round(sum((n - pos) * (cp - pos + pos / 2.0e0))
  / nullif(CAST(max(tp) AS DOUBLE) * CAST(max(tn) - max(tp) AS DOUBLE), 0), 9)"""


@query(
    "a11_average_precision",
    with_sql(EVENTS_SQL, SCORED_SQL, ranked_sql("scored"))
    + f"SELECT {AP_SQL} AS average_precision FROM r",
)
def average_precision(spark, folder):
    return rounded(
        ranking.average_precision(scored_events(spark, folder)), ["average_precision"]
    )


@query(
    "a12_roc_auc",
    with_sql(
        EVENTS_SQL,
        SCORED_SQL.replace("AS y,", "AS y, category,"),
        ranked_sql("scored", "category, "),
    )
    + f"""SELECT category, {AP_SQL} AS average_precision, {AUC_SQL} AS roc_auc,
  CAST(max(tn) AS BIGINT) AS n, CAST(max(tp) AS BIGINT) AS pos FROM r GROUP BY 1""",
)
def roc_auc(spark, folder):
    """Both ranking metrics per category."""
    tx = events_tx(spark, folder)
    rows = scored(tx).join(tx.select("transaction_id", "category"), "transaction_id")
    groups = ranking.score_groups(rows, ["category"])
    out = ranking.ranking_metrics(groups, ["category"]).drop("recall")
    return rounded(out, ["average_precision", "roc_auc"])


POINTWISE = {
    "a13_accuracy": ["n", "accuracy", "always_negative_accuracy", "base_rate"],
    "a14_recall_at_half": ["positives", "tp", "recall"],
    "a15_brier": ["brier"],
    "a16_classification_metrics": [
        "tp", "fp", "fn", "tn", "log_loss", "f1", "tpr", "fpr", "fnr", "precision", "recall",
    ],
    "a19_score_range": ["score_min", "score_max"],
    "a20_expected_positives": ["expected_positives", "positives"],
}
POINTWISE_SQL = ALL_SQL + """, c AS (SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS positives,
  count(*) FILTER (p >= 0.5e0 AND y = 1) AS tp, count(*) FILTER (p >= 0.5e0 AND y = 0) AS fp,
  count(*) FILTER (p < 0.5e0 AND y = 1) AS fn, count(*) FILTER (p < 0.5e0 AND y = 0) AS tn,
  round(avg((p - y) * (p - y)), 9) AS brier,
  round(avg(CASE WHEN y = 1 THEN -ln(least(greatest(p, 1e-15), 1 - 1e-15))
    ELSE -ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)) END), 9) AS log_loss,
  min(p) AS score_min, max(p) AS score_max, round(sum(p), 6) AS expected_positives FROM scored),
m AS (SELECT *, (tp + tn) / CAST(n AS DOUBLE) AS accuracy,
  (n - positives) / CAST(n AS DOUBLE) AS always_negative_accuracy,
  positives / CAST(n AS DOUBLE) AS base_rate, tp / CAST(tp + fp AS DOUBLE) AS precision,
  tp / CAST(positives AS DOUBLE) AS recall, 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) AS f1,
  tp / CAST(positives AS DOUBLE) AS tpr, fp / CAST(fp + tn AS DOUBLE) AS fpr,
  fn / CAST(positives AS DOUBLE) AS fnr FROM c)
SELECT {columns} FROM m"""


def _pointwise(columns):
    def run(spark, folder):
        out = ranking.pointwise_metrics(scored_events(spark, folder))
        out = rounded(out, ["brier", "log_loss"])
        return rounded(out, ["expected_positives"], 6).select(*columns)

    return run


for _name, _columns in POINTWISE.items():
    query(_name, POINTWISE_SQL.replace("{columns}", ", ".join(_columns)))(_pointwise(_columns))


@query(
    "a15_constant_rate_brier",
    ALL_SQL + "SELECT round(avg((0.2e0 - y) * (0.2e0 - y)), 9) AS brier_constant FROM scored",
)
def constant_brier(spark, folder):
    return rounded(
        ranking.constant_rate_brier(scored_events(spark, folder), 0.2), ["brier_constant"]
    )


def bins_sql(source: str, k: int) -> str:
    return f"""b AS (SELECT p, y, ntile({k}) OVER (ORDER BY p, transaction_id) - 1 AS bin
  FROM {source})"""


@query(
    "a17_calibration_error",
    with_sql(EVENTS_SQL, SCORED_SQL, bins_sql("scored", 10))
    + """, s AS (SELECT bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy FROM b GROUP BY 1)
SELECT round(sum(abs(sp - sy)) / sum(n), 9) AS ece FROM s""",
)
def calibration_error(spark, folder):
    return rounded(ranking.calibration_error(scored_events(spark, folder)), ["ece"])


@query(
    "w6_equal_count_bins",
    with_sql(EVENTS_SQL, SCORED_SQL)
    + """SELECT transaction_id, ntile(7) OVER (ORDER BY p, transaction_id) - 1 AS bin
FROM scored""",
)
def equal_count_bins(spark, folder):
    rows = scored_events(spark, folder).select("p", "transaction_id")
    placed = row_positions(rows, ["p", "transaction_id"])
    bin_ = equal_count_bin(F.col("position"), F.col("position_count"), 7)
    return placed.select("transaction_id", bin_.cast("long").alias("bin"))


@query(
    "a18_reliability_curve",
    with_sql(EVENTS_SQL, SCORED_SQL)
    + """, e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q
  FROM scored),
b AS (SELECT p, y, len(list_filter(q, lambda x: x < p)) AS bin FROM scored, e)
SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(avg(p), 9) AS mean_predicted,
  avg(y) AS observed_rate FROM b GROUP BY 1""",
)
def reliability(spark, folder):
    return rounded(ranking.reliability_curve(scored_events(spark, folder)), ["mean_predicted"])


def wilson_sql(k: str, n: str) -> str:
    z2 = "(1.959964e0 * 1.959964e0)"
    den = f"(1 + {z2} / {n})"
    centre = f"(({k} / CAST({n} AS DOUBLE) + {z2} / (2 * {n})) / {den})"
    half = (
        f"(1.959964e0 / {den} * sqrt({k} / CAST({n} AS DOUBLE) * (1 - {k} / CAST({n} AS DOUBLE))"
        f" / {n} + {z2} / (4 * CAST({n} AS DOUBLE) * {n})))"
    )
    return (
        f"CASE WHEN {n} > 0 THEN round(greatest(0e0, {centre} - {half}), 9) END, "
        f"CASE WHEN {n} > 0 THEN round(least(1e0, {centre} + {half}), 9) END"
    )


@query(
    "s1_wilson_interval",
    with_sql(EVENTS_SQL)
    + ", c AS (SELECT entity_id, sum(is_fraud) AS k, count(*) AS n FROM tx GROUP BY 1), "
    + "w(entity_id, k, n, lo, hi) AS (SELECT entity_id, CAST(k AS BIGINT), n, "
    + wilson_sql("k", "n")
    + " FROM c) SELECT * FROM w",
)
def wilson(spark, folder):
    counts = events_tx(spark, folder).groupBy("entity_id").agg(
        F.sum("is_fraud").alias("k"), F.count(F.lit(1)).alias("n")
    )
    lo, hi = wilson_bounds(F.col("k"), F.col("n"))
    return rounded(counts.withColumns({"lo": lo, "hi": hi}), ["lo", "hi"])


@query(
    "s6_points_per_positive",
    ALL_SQL
    + """SELECT CAST(sum(y) AS BIGINT) AS positives, 100 / CAST(sum(y) AS DOUBLE) AS points
FROM scored""",
)
def recall_points(spark, folder):
    return points_per_positive(scored_events(spark, folder))


THRESHOLD_SQL = """, t(threshold) AS (VALUES (0.5e0), (0.95e0)),
c AS (SELECT {by}threshold, count(*) AS n, sum(y) AS frauds,
  count(*) FILTER (p >= threshold) AS n_flagged,
  count(*) FILTER (p >= threshold AND y = 1) AS frauds_flagged,
  count(*) FILTER (p >= threshold AND y = 0) AS false_alerts,
  count(*) FILTER (greatest(p, 1 - p) < threshold) AS sent_to_review,
  count(*) FILTER (greatest(p, 1 - p) < threshold AND y = 1) AS frauds_in_review,
  count(*) FILTER (greatest(p, 1 - p) >= threshold AND p < 0.5e0 AND y = 1)
    AS frauds_cleared_unseen
  FROM {source} CROSS JOIN t GROUP BY {by}threshold),
w({byc}threshold, n_flagged, frauds_flagged, false_alerts, sent_to_review, frauds_in_review,
  frauds_cleared_unseen, recall, precision, false_alerts_per_10k, review_per_10k,
  recall_lower, recall_upper, precision_lower, precision_upper, fa_lower, fa_upper) AS (
  SELECT {by}threshold, n_flagged, frauds_flagged, false_alerts, sent_to_review,
  frauds_in_review, frauds_cleared_unseen, frauds_flagged / CAST(nullif(frauds, 0) AS DOUBLE),
  frauds_flagged / CAST(nullif(n_flagged, 0) AS DOUBLE),
  false_alerts * 10000 / CAST(n AS DOUBLE), sent_to_review * 10000 / CAST(n AS DOUBLE),
  """ + wilson_sql("frauds_flagged", "frauds") + ", " + wilson_sql(
    "frauds_flagged", "n_flagged"
) + ", " + wilson_sql("false_alerts", "n") + """ FROM c)
SELECT {by}threshold, n_flagged, frauds_flagged, false_alerts, sent_to_review, frauds_in_review,
  frauds_cleared_unseen, recall, recall_lower, recall_upper, precision, precision_lower,
  precision_upper, false_alerts_per_10k, round(fa_lower * 10000, 6) AS false_alerts_lower,
  round(fa_upper * 10000, 6) AS false_alerts_upper, review_per_10k FROM w"""


def _presented(df):
    out = rounded(
        df, ["recall_lower", "recall_upper", "precision_lower", "precision_upper"]
    )
    for name in ("false_alerts_lower", "false_alerts_upper"):
        # the same two roundings as the SQL
        out = out.withColumn(name, F.round(F.round(F.col(name) / 10000, 9) * 10000, 6))
    return out


@query(
    "a21_threshold_metrics",
    with_sql(EVENTS_SQL, TEST_SQL)
    + THRESHOLD_SQL.format(by="", byc="", source="scored"),
)
def thresholds(spark, folder):
    return _presented(threshold_metrics(scored_test(spark, folder), (0.5, 0.95)))


FOLD_ROWS_SQL = (
    with_sql(EVENTS_SQL, order_sql(), cuts_sql(), FOLDS_SQL, SCORED_SQL)
    + """, f AS (SELECT fold, scored.* FROM scored JOIN ent USING (entity_id)
  JOIN folds ON first_seen >= cut AND (fold_end IS NULL OR first_seen < fold_end)),
both_ AS (SELECT * FROM f UNION ALL SELECT * REPLACE (0 AS fold) FROM f)"""
)


def fold_rows(spark, folder):
    tx = events_tx(spark, folder)
    folds = splits.build_folds(tx, OPTIONS.train_fractions, OPTIONS.min_test_fraud)
    placed = splits.assign_folds(tx, folds).where(F.col("fold").isNotNull())
    return placed.select(
        "transaction_id",
        "timestamp",
        "entity_id",
        "amount",
        F.col("is_fraud").alias("y"),
        stand_in(F.col("amount")).alias("p"),
        F.col("fold").cast("long").alias("fold"),
    )


@query(
    "a22_fold_and_pooled_metrics",
    FOLD_ROWS_SQL
    + ", "
    + ranked_sql("both_", "fold, ")
    + f""", ap AS (SELECT fold, {AP_SQL} AS average_precision, CAST(max(tn) AS BIGINT) AS n_rows,
  CAST(max(tp) AS BIGINT) AS frauds, max(tp) / CAST(max(tn) AS DOUBLE) AS base_rate
  FROM r GROUP BY 1),
b AS (SELECT fold, p, y, ntile(10) OVER (PARTITION BY fold ORDER BY p, transaction_id) AS bin
  FROM both_),
s AS (SELECT fold, bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy FROM b GROUP BY 1, 2),
e AS (SELECT fold, round(sum(abs(sp - sy)) / sum(n), 9) AS ece FROM s GROUP BY 1),
x AS (SELECT min(average_precision) AS lo, max(average_precision) AS hi,
  round(avg(average_precision), 6) AS mean FROM ap WHERE fold > 0)
SELECT ap.*, round(average_precision / base_rate, 6) AS lift, ece,
  CASE WHEN fold = 0 THEN lo END AS fold_min, CASE WHEN fold = 0 THEN hi END AS fold_max,
  CASE WHEN fold = 0 THEN mean END AS fold_mean
FROM ap JOIN e USING (fold), x""",
)
def folds_and_pool(spark, folder):
    out = rounded(fold_metrics(freeze(fold_rows(spark, folder))), ["average_precision", "ece"])
    out = rounded(out, ["fold_min", "fold_max"])
    return rounded(out.withColumn("fold", F.col("fold").cast("long")), ["lift", "fold_mean"], 6)


@query(
    "a23_decision_counts_and_latency",
    ALL_SQL
    + f"""SELECT {decide_sql("p", "0.7e0")} AS decision, count(*) AS n,
  round(avg(amount), 9) AS mean_ms, round(quantile_cont(amount, 0.5), 9) AS p50_ms,
  round(quantile_cont(amount, 0.95), 9) AS p95_ms, round(quantile_cont(amount, 0.99), 9) AS p99_ms
FROM scored GROUP BY 1""",
)
def decision_latency(spark, folder):
    """Counts and value quantiles per decision; the event value stands for the latency."""
    from riskweave.operators.ordered import summary_quantiles
    from riskweave.operators.requests import LATENCY_LEVELS

    rows = scored_events(spark, folder).withColumn("decision", decide(F.col("p"), 0.7))
    counts = rows.groupBy("decision").agg(
        F.count(F.lit(1)).alias("n"), F.avg("amount").alias("mean_ms")
    )
    quantiles = summary_quantiles(rows, "amount", LATENCY_LEVELS, ["decision"])
    return rounded(
        counts.join(quantiles, "decision"), ["mean_ms", "p50_ms", "p95_ms", "p99_ms"]
    )
