"""Review bands, policies and prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.catalog.common import (
    EVENTS_SQL,
    ORDERS_SQL,
    SCORED_SQL,
    TEST_SQL,
    events_tx,
    orders_tx,
    query,
    scored,
    scored_events,
    scored_test,
    values_sql,
    with_sql,
)
from riskweave.catalog.metric_queries import ALL_SQL, decide_sql
from riskweave.functions.scores import FRAUD, REVIEW
from riskweave.operators import curves, policies
from riskweave.options import (
    COST_GRID,
    DASHBOARD_GRID,
    DECOUPLED_POINTS,
    REVIEW_THRESHOLDS,
    SENSITIVITY_GRID,
    TRADE_OFF_GRID,
)

T = 0.75  # operating threshold that splits the stand-in scores into three filled lanes

LANE_COLUMNS = """avg(CASE WHEN lane <> 'review' THEN 1.0e0 ELSE 0.0e0 END) AS coverage,
  count(*) FILTER (lane = 'review') AS n_sent_to_review,
  count(*) FILTER (lane = 'fraud') AS n_flagged_fraud,
  count(*) FILTER (lane = 'fraud' AND y = 1)
    / CAST(nullif(count(*) FILTER (lane = 'fraud'), 0) AS DOUBLE) AS precision_on_flagged,
  count(*) FILTER (lane = 'fraud' AND y = 1) AS fraud_caught_auto,
  count(*) FILTER (lane = 'review' AND y = 1) AS fraud_in_review_queue,
  count(*) FILTER (lane = 'legit' AND y = 1) AS fraud_missed,
  count(*) FILTER (lane = 'fraud' AND y = 1)
    / CAST(nullif(count(*) FILTER (y = 1), 0) AS DOUBLE) AS recall_auto"""


def curve_sql(grid, source="scored") -> str:
    return (
        values_sql("t", ["review_threshold"], [(float(v),) for v in grid])
        + f""",
curve AS (SELECT review_threshold, {LANE_COLUMNS}
  FROM (SELECT review_threshold, y, {decide_sql("p", "review_threshold")} AS lane
        FROM {source} CROSS JOIN t) GROUP BY 1)"""
    )


@query(
    "a2_review_curve",
    with_sql(EVENTS_SQL, TEST_SQL, curve_sql(REVIEW_THRESHOLDS)) + "SELECT * FROM curve",
)
def review_curve(spark, folder):
    return curves.review_curve(scored_test(spark, folder))


@query(
    "j3_threshold_sweep",
    with_sql(
        ORDERS_SQL,
        SCORED_SQL.replace("20e0", "200000e0"),
        curve_sql(SENSITIVITY_GRID),
    )
    + "SELECT * FROM curve",
)
def threshold_sweep(spark, folder):
    return curves.review_curve(scored(orders_tx(spark, folder), 200000.0), SENSITIVITY_GRID)


@query(
    "a3_decoupled_curve",
    with_sql(
        EVENTS_SQL,
        SCORED_SQL,
        values_sql("t", ["flag_at", "clear_at"], [*DECOUPLED_POINTS, (0.7, 0.3), (0.8, 0.1)]),
    )
    + f"""SELECT flag_at, clear_at, {LANE_COLUMNS} FROM (
  SELECT flag_at, clear_at, y, CASE WHEN p >= flag_at THEN 'fraud' WHEN p <= clear_at THEN 'legit'
    ELSE 'review' END AS lane FROM scored CROSS JOIN t) GROUP BY 1, 2""",
)
def decoupled_curve(spark, folder):
    points = [*DECOUPLED_POINTS, (0.7, 0.3), (0.8, 0.1)]
    return curves.decoupled_curve(scored_events(spark, folder), points)


# own examples: name, cost of a missed fraud, of a false flag, of one review
COST_SCENARIOS = (
    ("small_baskets", 60.0, 8.0, 1.5),
    ("large_invoices", 900.0, 12.0, 6.0),
    ("slow_reviews", 150.0, 3.0, 35.0),
)
PRICED_SQL = (
    with_sql(
        EVENTS_SQL,
        SCORED_SQL,
        curve_sql(COST_GRID),
        values_sql("s", ["scenario", "cm", "cf", "cr"], COST_SCENARIOS),
    )
    + """, priced AS (SELECT scenario, review_threshold,
  n_flagged_fraud - fraud_caught_auto AS n_false_flags,
  fraud_missed * cm + (n_flagged_fraud - fraud_caught_auto) * cf + n_sent_to_review * cr
    AS expected_cost FROM curve CROSS JOIN s)"""
)


@query(
    "a4_expected_cost_curve",
    PRICED_SQL + "SELECT scenario, review_threshold, n_false_flags, expected_cost FROM priced",
)
def expected_cost_curve(spark, folder):
    curve = curves.review_curve(scored_events(spark, folder), COST_GRID)
    return curves.price_curve(curve, COST_SCENARIOS).select(
        "scenario", "review_threshold", "n_false_flags", "expected_cost"
    )


@query(
    "a5_price_scenarios",
    PRICED_SQL
    + """, best AS (SELECT *, row_number() OVER (PARTITION BY scenario
  ORDER BY expected_cost, review_threshold) AS k FROM priced)
SELECT b.scenario, b.review_threshold AS min_cost_threshold, b.expected_cost AS min_expected_cost,
  a.expected_cost AS full_automation_cost,
  a.expected_cost - b.expected_cost AS savings_vs_full_automation
FROM best b JOIN priced a ON a.scenario = b.scenario AND a.review_threshold = 0.5 WHERE b.k = 1""",
)
def price_scenarios(spark, folder):
    return curves.price_scenarios(
        curves.review_curve(scored_events(spark, folder), COST_GRID), COST_SCENARIOS
    )


@query(
    "t2_argmin_with_ties",
    PRICED_SQL
    + """SELECT scenario, arg_min(review_threshold, (expected_cost, review_threshold)) AS first_min,
  max(expected_cost) AS highest_cost FROM priced GROUP BY 1""",
)
def argmin_with_ties(spark, folder):
    curve = curves.review_curve(scored_events(spark, folder), COST_GRID)
    t, cost = F.col("review_threshold"), F.col("expected_cost")
    return curves.price_curve(curve, COST_SCENARIOS).groupBy("scenario").agg(
        F.min_by(t, F.struct(cost, t)).alias("first_min"), F.max(cost).alias("highest_cost")
    )


def outcome_sql(by: str) -> str:
    """Policy outcome columns from rows (by, y, amount, f, q)."""
    money = "CAST(coalesce(sum(CAST(amount AS DECIMAL(20,6))) FILTER ({}), 0) AS DOUBLE)"
    m = {k: money.format(v) for k, v in {
        "all": "y = 1", "caught": "f AND y = 1", "review": "q AND y = 1",
        "missed": "NOT f AND NOT q AND y = 1", "blocked": "f AND y = 0"}.items()}
    return f"""o AS (SELECT {by}, count(*) AS n_transactions,
  count(*) FILTER (f) AS alerts_auto_flagged, count(*) FILTER (f AND y = 1) AS true_alerts,
  count(*) FILTER (q) AS sent_to_review, count(*) FILTER (q AND y = 1) AS fraud_in_review,
  count(*) FILTER (NOT f AND NOT q AND y = 1) AS fraud_missed,
  count(*) FILTER (y = 1) AS fraud_total, {m["all"]} AS fraud_amount_total,
  {m["caught"]} AS fraud_amount_caught_auto, {m["review"]} AS fraud_amount_in_review,
  {m["missed"]} AS fraud_amount_missed, {m["blocked"]} AS legit_amount_auto_flagged
  FROM masked GROUP BY {by}),
o2 AS (SELECT *, alerts_auto_flagged - true_alerts AS false_alerts,
  sent_to_review - fraud_in_review AS legit_sent_to_review,
  alerts_auto_flagged - true_alerts + sent_to_review - fraud_in_review AS legit_flagged_or_queued,
  alerts_auto_flagged + sent_to_review AS flagged_or_queued, true_alerts AS fraud_caught_auto
  FROM o),
outcome AS (SELECT *,
  alerts_auto_flagged * 10000 / CAST(n_transactions AS DOUBLE) AS alerts_per_10k,
  false_alerts * 10000 / CAST(n_transactions AS DOUBLE) AS false_alerts_per_10k,
  sent_to_review * 10000 / CAST(n_transactions AS DOUBLE) AS review_queue_per_10k,
  legit_flagged_or_queued * 10000 / CAST(n_transactions AS DOUBLE)
    AS legit_flagged_or_queued_per_10k,
  flagged_or_queued * 10000 / CAST(n_transactions AS DOUBLE) AS flagged_or_queued_per_10k,
  fraud_missed * 10000 / CAST(n_transactions AS DOUBLE) AS fraud_missed_per_10k,
  true_alerts / nullif(CAST(alerts_auto_flagged AS DOUBLE), 0) AS precision_on_alerts,
  false_alerts / nullif(CAST(true_alerts AS DOUBLE), 0) AS false_alerts_per_true_alert,
  true_alerts / nullif(CAST(fraud_total AS DOUBLE), 0) AS fraud_share_caught_auto,
  (true_alerts + fraud_in_review) / nullif(CAST(fraud_total AS DOUBLE), 0) AS fraud_share_surfaced,
  fraud_missed / nullif(CAST(fraud_total AS DOUBLE), 0) AS fraud_share_missed,
  fraud_in_review / nullif(CAST(sent_to_review AS DOUBLE), 0) AS review_queue_fraud_rate,
  fraud_amount_caught_auto / nullif(fraud_amount_total, 0) AS fraud_amount_share_caught_auto,
  (fraud_amount_caught_auto + fraud_amount_in_review) / nullif(fraud_amount_total, 0)
    AS fraud_amount_share_surfaced,
  fraud_amount_missed / nullif(fraud_amount_total, 0) AS fraud_amount_share_missed FROM o2)"""


MASKS_SQL = f"""masked AS (SELECT policy, y, amount,
  CASE kind WHEN 'single' THEN p >= t WHEN 'low' THEN p > 1e0 - t
    ELSE greatest(p, 1 - p) >= t AND p >= 0.5e0 END AS f,
  kind = 'band' AND greatest(p, 1 - p) < t AS q
  FROM scored CROSS JOIN (VALUES ('A', 'single', 0.5e0), ('B', 'single', {T}e0),
    ('C', 'band', {T}e0), ('D', 'low', {T}e0)) v(policy, kind, t))"""
POLICY_SQL = with_sql(EVENTS_SQL, SCORED_SQL, MASKS_SQL, outcome_sql("policy"))


@query("a6_policy_outcome", POLICY_SQL + "SELECT * FROM outcome")
def policy_outcome(spark, folder):
    return policies.policy_outcomes(scored_events(spark, folder), policies.four_policies(T))


@query(
    "a7_policy_masks",
    with_sql(EVENTS_SQL, SCORED_SQL, MASKS_SQL)
    + """SELECT policy, count(*) FILTER (f) AS flagged, count(*) FILTER (q) AS queued,
  count(*) FILTER (NOT f AND NOT q) AS cleared FROM masked GROUP BY 1""",
)
def policy_masks(spark, folder):
    rows = policies.policy_rows(scored_events(spark, folder), policies.four_policies(T))

    def held(where):
        return F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))

    flag, queue = F.col("flagged"), F.col("queued")
    return rows.groupBy("policy").agg(
        held(flag).alias("flagged"),
        held(queue).alias("queued"),
        held(~flag & ~queue).alias("cleared"),
    )


def _of(policy: str, name: str, alias: str) -> str:
    return f"max({name}) FILTER (policy = '{policy}') AS {alias}"


@query(
    "a8_compare_policies",
    POLICY_SQL
    + f""", w AS (SELECT {", ".join([
    _of("A", "false_alerts", "a_false_alerts"), _of("B", "false_alerts", "b_false_alerts"),
    _of("C", "false_alerts", "c_false_alerts"), _of("A", "fraud_missed", "a_fraud_missed"),
    _of("B", "fraud_missed", "b_fraud_missed"), _of("C", "fraud_missed", "c_fraud_missed"),
    _of("A", "flagged_or_queued", "a_flagged_or_queued"),
    _of("C", "flagged_or_queued", "c_flagged_or_queued"),
    _of("A", "legit_flagged_or_queued", "a_legit_flagged_or_queued"),
    _of("C", "legit_flagged_or_queued", "c_legit_flagged_or_queued"),
    _of("C", "sent_to_review", "c_vs_a_added_review_queue"),
    _of("C", "review_queue_per_10k", "c_vs_a_added_review_queue_per_10k"),
    _of("B", "alerts_auto_flagged", "b_alerts"), _of("C", "alerts_auto_flagged", "c_alerts"),
    _of("D", "alerts_auto_flagged", "d_alerts"),
    _of("B", "fraud_amount_missed", "b_fraud_amount_missed"),
    _of("C", "fraud_amount_missed", "c_fraud_amount_missed"),
    _of("C", "precision_on_alerts", "c_precision_on_alerts"),
    _of("D", "precision_on_alerts", "d_precision_on_alerts")])} FROM outcome)
SELECT * EXCLUDE (b_alerts),
  (a_false_alerts - b_false_alerts) / nullif(CAST(a_false_alerts AS DOUBLE), 0)
    AS b_vs_a_false_alert_reduction,
  (a_false_alerts - c_false_alerts) / nullif(CAST(a_false_alerts AS DOUBLE), 0)
    AS c_vs_a_false_alert_reduction,
  b_alerts = c_alerts AS c_vs_b_same_alerts,
  b_false_alerts = c_false_alerts AS c_vs_b_same_false_alerts,
  b_fraud_missed - c_fraud_missed AS c_vs_b_reviewed_instead_of_cleared,
  (SELECT bool_and((greatest(p, 1 - p) < {T}e0 OR p >= {T}e0) = (p > 1e0 - {T}e0)) FROM scored)
    AS c_vs_d_same_surfaced_set
FROM w""",
)
def compare_policies(spark, folder):
    return policies.compare_policies(scored_events(spark, folder), T)


def sensitivity_sql(grid) -> str:
    return (
        with_sql(
            EVENTS_SQL,
            SCORED_SQL,
            values_sql("t", ["review_threshold"], [(float(v),) for v in grid]),
        )
        + """, masked AS (SELECT review_threshold, y, amount,
  greatest(p, 1 - p) >= review_threshold AND p >= 0.5e0 AS f,
  greatest(p, 1 - p) < review_threshold AS q FROM scored CROSS JOIN t), """
        + outcome_sql("review_threshold")
    )


SENSITIVITY_SELECT = "SELECT review_threshold, " + ", ".join(
    policies.SENSITIVITY_COLUMNS
).replace(
    "review_share_of_traffic",
    "sent_to_review / CAST(n_transactions AS DOUBLE) AS review_share_of_traffic",
) + " FROM outcome"


@query("a9_sensitivity_table", sensitivity_sql(SENSITIVITY_GRID) + SENSITIVITY_SELECT)
def sensitivity(spark, folder):
    return policies.sensitivity_table(scored_events(spark, folder))


@query(
    "a10_neighbouring_points",
    sensitivity_sql(SENSITIVITY_GRID)
    + SENSITIVITY_SELECT
    + " WHERE round(review_threshold, 2) IN (0.74e0, 0.75e0, 0.76e0)",
)
def neighbouring_points(spark, folder):
    return curves.neighbouring_points(
        policies.sensitivity_table(scored_events(spark, folder)), T
    )


@query(
    "a24_lane_totals",
    ALL_SQL
    + f""", l AS (SELECT {decide_sql("p", "0.75e0")} AS lane, y, amount FROM scored)
SELECT lane, count(*) AS n, count(*) FILTER (y = 1) AS frauds,
  CAST(coalesce(sum(CAST(amount AS DECIMAL(20,6))) FILTER (y = 1), 0) AS DOUBLE) AS fraud_amount,
  CAST(coalesce(sum(CAST(amount AS DECIMAL(20,6))) FILTER (y = 0), 0) AS DOUBLE) AS legit_amount,
  CASE WHEN lane = 'review' THEN count(*) * 10000 / CAST((SELECT count(*) FROM l) AS DOUBLE)
    * 5e0 / 60e0 END AS review_hours
FROM l GROUP BY 1""",
)
def lane_totals(spark, folder):
    out = policies.lane_totals(scored_events(spark, folder), T)
    return out.withColumn("n", F.col("n").cast("long"))


@query(
    "a24_trade_off_curve",
    sensitivity_sql(TRADE_OFF_GRID)
    + """SELECT review_threshold, sent_to_review / CAST(n_transactions AS DOUBLE)
  AS review_share_of_traffic, false_alerts_per_10k, fraud_missed FROM outcome""",
)
def trade_off(spark, folder):
    return policies.trade_off(scored_events(spark, folder), TRADE_OFF_GRID)


@query(
    "a25_dashboard_curve",
    with_sql(EVENTS_SQL, SCORED_SQL, curve_sql(DASHBOARD_GRID))
    + """SELECT review_threshold, coverage, precision_on_flagged FROM curve
WHERE precision_on_flagged IS NOT NULL""",
)
def dashboard(spark, folder):
    return curves.dashboard_curve(scored_events(spark, folder), DASHBOARD_GRID)


@query(
    "t1_top_frauds_by_amount",
    with_sql(ORDERS_SQL)
    + """SELECT transaction_id, amount FROM tx WHERE is_fraud = 1
ORDER BY amount DESC, transaction_id LIMIT 20""",
)
def top_frauds(spark, folder):
    frauds = orders_tx(spark, folder).where("is_fraud = 1").select("transaction_id", "amount")
    return frauds.orderBy(F.desc("amount"), "transaction_id").limit(20)


@query(
    "r2_alert_feed",
    with_sql(EVENTS_SQL, SCORED_SQL)
    + f""", d AS (SELECT scored.*, {decide_sql("p", "0.75e0")} AS decision FROM scored)
SELECT epoch_us(d.timestamp) AS timestamp_us, d.transaction_id, d.entity_id, d.amount, category,
  decision, round(p, 4) AS p_fraud, round(greatest(p, 1 - p), 4) AS confidence,
  y AS true_is_fraud
FROM d JOIN tx ON d.transaction_id = tx.transaction_id WHERE decision IN ('fraud', 'review')""",
)
def alert_feed(spark, folder):
    from riskweave.catalog.common import stand_in
    from riskweave.streaming.replay import alert_rows

    rows = events_tx(spark, folder).withColumn("p", stand_in(F.col("amount")))
    feed = alert_rows(rows, T).where(F.col("decision").isin(FRAUD, REVIEW))
    return feed.withColumn("timestamp_us", F.unix_micros("timestamp")).drop("timestamp")
