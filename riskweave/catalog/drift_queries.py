"""Drift between the train and the test side."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.catalog.common import (
    EVENTS_SQL,
    SIDES_SQL,
    events_tx,
    query,
    rounded,
    scored,
    with_sql,
)
from riskweave.catalog.resample_queries import RESAMPLES, SEED, headline_sql
from riskweave.functions.features import add_time_features
from riskweave.operators import drift, resample
from riskweave.operators.reconcile import flag_agreement
from riskweave.operators.splits import temporal_grouped_split

COLUMNS = ["amount", "f_k", "f_sparse", "hour_of_day", "day_of_week"]
PROBS = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"


def drift_sides(spark, folder):
    """Train and test rows with time features and a column that is often missing."""
    tx = events_tx(spark, folder).withColumn(
        "f_sparse", F.when(F.col("f_k") % 4 != 0, F.col("amount") * 2)
    )
    train, test = temporal_grouped_split(add_time_features(tx))
    # the window drifts in one column
    return train, test.withColumn("f_k", F.col("f_k") * 1.5)


LONG_SQL = with_sql(
    EVENTS_SQL,
    SIDES_SQL,
    """wide AS (SELECT side, amount, CASE WHEN side = 'test' THEN f_k * 1.5e0 ELSE f_k END AS f_k,
  CASE WHEN f_k % 4 <> 0 THEN amount * 2 END AS f_sparse,
  CAST(hour(timestamp) AS DOUBLE) AS hour_of_day,
  CAST(isodow(timestamp) - 1 AS DOUBLE) AS day_of_week
  FROM tx JOIN side ON tx.entity_id = side.entity_id)""",
    "long AS ("
    + " UNION ALL ".join(
        f"SELECT side, '{c}' AS feature, {c} AS value FROM wide" for c in COLUMNS
    )
    + ")",
    f"""edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, {PROBS}))) AS edges,
  count(*) FILTER (value IS NULL) / CAST(count(*) AS DOUBLE) AS null_fraction,
  count(value) AS n_reference FROM long WHERE side = 'train' GROUP BY 1)""",
    """bins AS (SELECT side, feature, edges, len(list_filter(edges, lambda e: e <= value)) AS bin,
  count(*) AS n FROM long JOIN edges USING (feature) WHERE value IS NOT NULL GROUP BY ALL)""",
    """grid AS (SELECT side, feature, unnest(range(len(edges) + 1)) AS bin
  FROM edges CROSS JOIN (VALUES ('train'), ('test')) s(side))""",
    """shares AS (SELECT side, feature, bin, coalesce(n, 0)
  / CAST(sum(n) OVER (PARTITION BY side, feature) AS DOUBLE) AS share
  FROM grid LEFT JOIN bins USING (side, feature, bin))""",
)


@query(
    "d1_reference_stats",
    LONG_SQL
    + """SELECT feature, len(edges) AS n_edges,
  round(list_sum(edges), 6) AS edge_sum, round(edges[1], 9) AS first_edge,
  round(edges[len(edges)], 9) AS last_edge, null_fraction, n_reference FROM edges""",
)
def reference_stats(spark, folder):
    train, _ = drift_sides(spark, folder)
    out = drift.reference_stats(train, COLUMNS)
    total = F.aggregate("inner_edges", F.lit(0.0), lambda acc, x: acc + x)
    return out.select(
        "feature",
        F.size("inner_edges").cast("long").alias("n_edges"),
        F.round(total, 6).alias("edge_sum"),
        F.round(F.col("inner_edges")[0], 9).alias("first_edge"),
        F.round(F.element_at("inner_edges", -1), 9).alias("last_edge"),
        "null_fraction",
        "n_reference",
    )


@query(
    "d2_bin_proportions",
    LONG_SQL + "SELECT side, feature, CAST(bin AS INT) AS bin, share FROM shares",
)
def bin_proportions(spark, folder):
    train, test = drift_sides(spark, folder)
    reference = drift.reference_stats(train, COLUMNS)
    seen = drift.bin_proportions(drift.value_counts(test, COLUMNS), reference)
    both = reference.select(F.lit("train").alias("side"), "feature", "proportions").unionByName(
        seen.select(F.lit("test").alias("side"), "feature", "proportions")
    )
    return both.select("side", "feature", F.posexplode("proportions").alias("bin", "share"))


PSI_SQL = """, floored AS (SELECT feature, bin, side, greatest(share, 1e-4)
  / sum(greatest(share, 1e-4)) OVER (PARTITION BY side, feature) AS s FROM shares),
psi AS (SELECT feature, sum((w.s - r.s) * ln(w.s / r.s)) AS psi
  FROM floored r JOIN floored w USING (feature, bin)
  WHERE r.side = 'train' AND w.side = 'test' GROUP BY 1)"""


def _features(spark, folder):
    train, test = drift_sides(spark, folder)
    reference = drift.reference_stats(train, COLUMNS)
    return drift.drift_features(reference, test, 0.1, 0.25, COLUMNS)


@query("d3_psi", LONG_SQL + PSI_SQL + " SELECT feature, round(psi, 9) AS psi FROM psi")
def psi(spark, folder):
    return rounded(_features(spark, folder).select("feature", "psi"), ["psi"])


@query(
    "d4_drift_report",
    LONG_SQL
    + PSI_SQL
    + """, nulls AS (SELECT feature, count(*) FILTER (value IS NULL) / CAST(count(*) AS DOUBLE)
  AS null_fraction FROM long WHERE side = 'test' GROUP BY 1)
SELECT feature, round(psi, 9) AS psi,
  CASE WHEN psi >= 0.25e0 THEN 'alert' WHEN psi >= 0.1e0 THEN 'watch' ELSE 'stable' END AS status,
  nulls.null_fraction, edges.null_fraction AS null_fraction_reference
FROM psi JOIN nulls USING (feature) JOIN edges USING (feature)""",
)
def drift_report(spark, folder):
    return rounded(_features(spark, folder), ["psi"])


@query(
    "d4_absent_column_per_day",
    LONG_SQL
    + """ SELECT DISTINCT CAST(strftime(timestamp, '%Y-%m-%d') AS VARCHAR) AS day, 'amount' AS feature,
  'missing_from_window' AS status
FROM tx JOIN side ON tx.entity_id = side.entity_id WHERE side = 'test'""",
)
def absent_per_day(spark, folder):
    """A column that no window has is reported for each window."""
    train, test = drift_sides(spark, folder)
    reference = drift.reference_stats(train, COLUMNS)
    days = test.withColumn("day", F.date_format("timestamp", "yyyy-MM-dd")).drop("amount")
    rows = drift.drift_features(reference, days, 0.1, 0.25, COLUMNS, ["day"])
    return rows.where("status = 'missing_from_window'").select("day", "feature", "status")


@query(
    "d4_empty_window",
    LONG_SQL + " SELECT DISTINCT feature, 'all_null_in_window' AS status FROM edges",
)
def empty_window(spark, folder):
    train, test = drift_sides(spark, folder)
    reference = drift.reference_stats(train, COLUMNS)
    rows = drift.drift_features(reference, test.where("false"), 0.1, 0.25, COLUMNS)
    return rows.select("feature", "status")


@query(
    "d4_drift_summary",
    LONG_SQL
    + PSI_SQL
    + """ SELECT arg_max(feature, psi) AS worst_feature, round(max(psi), 9) AS worst_psi,
  count(*) FILTER (psi >= 0.25e0) AS n_alerts,
  count(*) FILTER (psi >= 0.1e0 AND psi < 0.25e0) AS n_watch, count(*) AS n_features FROM psi""",
)
def drift_summary(spark, folder):
    return rounded(drift.drift_summary(_features(spark, folder)), ["worst_psi"])


WASSERSTEIN_SQL = """, vc AS (SELECT feature, value, count(*) FILTER (side = 'train') AS nr,
  count(*) FILTER (side = 'test') AS nc FROM long WHERE value IS NOT NULL GROUP BY 1, 2),
cdf AS (SELECT feature, value - lag(value) OVER w AS gap,
  coalesce(sum(nr) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    / CAST(sum(nr) OVER (PARTITION BY feature) AS DOUBLE) AS fr,
  coalesce(sum(nc) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    / CAST(sum(nc) OVER (PARTITION BY feature) AS DOUBLE) AS fc
  FROM vc WINDOW w AS (PARTITION BY feature ORDER BY value)),
sd AS (SELECT feature, stddev_pop(value) AS sd FROM long WHERE side = 'train' GROUP BY 1),
ws AS (SELECT feature, sum(abs(fr - fc) * gap) / greatest(max(sd), 0.001e0) AS score
  FROM cdf JOIN sd USING (feature) GROUP BY 1)"""


@query(
    "d5_normed_wasserstein",
    LONG_SQL + WASSERSTEIN_SQL + " SELECT feature, round(score, 9) AS score FROM ws",
)
def wasserstein(spark, folder):
    train, test = drift_sides(spark, folder)
    return rounded(drift.wasserstein(train, test, COLUMNS), ["score"])


JS_SQL = """, sh AS (SELECT feature, nr / CAST(sum(nr) OVER (PARTITION BY feature) AS DOUBLE) AS r,
  nc / CAST(sum(nc) OVER (PARTITION BY feature) AS DOUBLE) AS c FROM vc),
js AS (SELECT feature, sqrt(greatest(sum(
    CASE WHEN r > 0 THEN r * ln(r / ((r + c) / 2)) ELSE 0 END
    + CASE WHEN c > 0 THEN c * ln(c / ((r + c) / 2)) ELSE 0 END) / 2, 0)) AS score
  FROM sh GROUP BY 1)"""


@query(
    "d6_jensen_shannon",
    LONG_SQL
    + WASSERSTEIN_SQL
    + JS_SQL
    + """ SELECT feature, round(score, 9) AS score FROM js
WHERE feature IN ('hour_of_day', 'day_of_week')""",
)
def jensen_shannon(spark, folder):
    train, test = drift_sides(spark, folder)
    out = drift.jensen_shannon(train, test, ["hour_of_day", "day_of_week"])
    return rounded(out, ["score"])


# seven weekdays count as categories here
DISTANCE_SQL = (
    LONG_SQL
    + WASSERSTEIN_SQL
    + JS_SQL
    + """, few AS (SELECT feature, count(DISTINCT value) <= 7 AS few FROM long
  WHERE side = 'train' GROUP BY 1),
dist AS (SELECT feature, CASE WHEN few THEN 'jensen_shannon' ELSE 'wasserstein' END AS method,
  CASE WHEN few THEN js.score ELSE ws.score END AS score
  FROM few JOIN js USING (feature) JOIN ws USING (feature))"""
)


def _distances(spark, folder):
    train, test = drift_sides(spark, folder)
    return drift.distance_drift(train, test, COLUMNS, max_categories=7)


@query(
    "d7_column_drift",
    DISTANCE_SQL
    + " SELECT feature, method, round(score, 9) AS score, score > 0.1e0 AS drifted FROM dist",
)
def column_drift(spark, folder):
    return rounded(_distances(spark, folder), ["score"])


@query(
    "d7_dataset_drift",
    DISTANCE_SQL
    + """ SELECT count(*) AS columns, count(*) FILTER (score > 0.1e0) AS drifted_columns,
  round(avg(CASE WHEN score > 0.1e0 THEN 1e0 ELSE 0e0 END), 9) AS drifted_share,
  avg(CASE WHEN score > 0.1e0 THEN 1e0 ELSE 0e0 END) >= 0.5e0 AS dataset_drift,
  count(*) FILTER (method = 'wasserstein') AS wasserstein_columns,
  count(*) FILTER (method = 'jensen_shannon') AS jensen_shannon_columns FROM dist""",
)
def dataset_drift(spark, folder):
    return rounded(drift.dataset_drift(_distances(spark, folder)), ["drifted_share"])


@query(
    "j9_flag_agreement",
    DISTANCE_SQL
    + PSI_SQL
    + """ SELECT count(*) FILTER (d AND q) AS both, count(*) FILTER (d AND NOT q) AS left_only,
  count(*) FILTER (q AND NOT d) AS right_only
FROM (SELECT score > 0.1e0 AS d, psi >= 0.1e0 AS q FROM dist JOIN psi USING (feature))""",
)
def agreement(spark, folder):
    by_distance = _distances(spark, folder).where("drifted")
    by_psi = _features(spark, folder).where(F.col("status").isin("watch", "alert"))
    return flag_agreement(by_distance, by_psi, "feature")


@query(
    "d8_window_performance",
    f"""WITH r AS ({headline_sql("train")}), c AS ({headline_sql("test")})
SELECT metric, r.point AS reference_point, c.point AS current_point,
  round(c.point - r.point, 6) AS change,
  r.point BETWEEN c.ci_lower AND c.ci_upper AS reference_inside_current,
  c.point BETWEEN r.ci_lower AND r.ci_upper AS current_inside_reference
FROM r JOIN c USING (metric)""",
)
def window_performance(spark, folder):
    """The bootstrap tables of both sides next to each other."""
    train, test = temporal_grouped_split(events_tx(spark, folder))
    tables = [resample.headline_of_draws(scored(t), RESAMPLES, SEED) for t in (train, test)]
    out = rounded(drift.window_performance(*tables), ["reference_point", "current_point"])
    return rounded(out, ["change"], 6)
