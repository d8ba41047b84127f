"""Bootstrap intervals.

The `_drawn` form draws rows from md5, so the SQL makes the same draws and all values agree. The
Poisson form is compared by its point values and by what must hold of its intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.catalog.common import EVENTS_SQL, TEST_SQL, query, rounded, scored_test, with_sql
from riskweave.catalog.metric_queries import AP_SQL, FOLD_ROWS_SQL, fold_rows, ranked_sql
from riskweave.operators import resample

RESAMPLES, SEED, T = 1000, 42, 0.75


def draws_sql(source: str, window: str = "", tie: str = "transaction_id") -> str:
    """drawn(resample, window, row columns): the draws of `drawn_rows`."""
    part = f"PARTITION BY {window} " if window else ""
    name = f"CAST({window} AS VARCHAR)" if window else "''"
    keys = f"{window}, " if window else ""
    group = f"GROUP BY {window}" if window else ""
    picks = " UNION ALL ".join(
        f"""SELECT {keys}resample, n, block * 2 + {k} AS j,
      CAST('0x' || substr(h, {1 + 16 * k}, 15) AS BIGINT) % n AS position FROM digest"""
        for k in range(2)
    )
    match = f"draws.{window} = placed.{window} AND " if window else ""
    return f"""placed AS (SELECT *, row_number() OVER ({part}ORDER BY {tie}) - 1 AS position
  FROM {source}),
sizes AS (SELECT {keys}count(*) AS n FROM {source} {group}),
blocks AS (SELECT {keys}n, unnest(range((n + 1) // 2)) AS block FROM sizes),
digest AS (SELECT {keys}n, resample, block, md5('{SEED}:' || {name} || ':'
    || CAST(resample AS VARCHAR) || ':' || CAST(block AS VARCHAR)) AS h
  FROM blocks CROSS JOIN range({RESAMPLES}) r(resample)),
draws AS ({picks}),
drawn AS (SELECT draws.resample, placed.* FROM draws JOIN placed
  ON {match}draws.position = placed.position WHERE draws.j < draws.n)"""


INTERVAL_SQL = """round(quantile_cont(value, 0.025), 9) AS ci_lower,
  round(quantile_cont(value, 0.975), 9) AS ci_upper"""
BASE_SQL = with_sql(EVENTS_SQL, TEST_SQL, draws_sql("scored"))


@query(
    "o14_resample_draws",
    BASE_SQL + "SELECT CAST(resample AS INT) AS resample, p, y, count(*) AS w FROM drawn GROUP BY 1, 2, 3",
)
def draws(spark, folder):
    return resample.drawn_rows(scored_test(spark, folder), ["p", "y"], RESAMPLES, SEED)


HEADLINE_TAIL = (
    ", "
    + ranked_sql("drawn", "resample, ")
    + f""", ap AS (SELECT 'average_precision' AS metric, resample, {AP_SQL.replace(", 9)", ", 15)")}
  AS value FROM r GROUP BY resample),
rec AS (SELECT 'recall' AS metric, resample, count(*) FILTER (p >= 0.5e0 AND y = 1)
  / nullif(CAST(count(*) FILTER (y = 1) AS DOUBLE), 0) AS value FROM drawn GROUP BY resample),
samples AS (SELECT * FROM ap UNION ALL SELECT * FROM rec),
"""
    + ranked_sql("scored").replace("g AS", "g0 AS").replace("FROM g)", "FROM g0)").replace(
        "r AS", "r0 AS"
    )
    + f"""
SELECT metric, {INTERVAL_SQL}, round(quantile_cont(value, 0.975) - quantile_cont(value, 0.025), 9)
  AS ci_width, round(stddev_samp(value), 9) AS std_error,
  count(*) FILTER (value IS NULL) AS degenerate,
  round(CASE WHEN metric = 'recall' THEN (SELECT count(*) FILTER (p >= 0.5e0 AND y = 1)
      / CAST(sum(y) AS DOUBLE) FROM scored)
    ELSE (SELECT sum(pos / CAST(tp AS DOUBLE) * (cp / CAST(cn AS DOUBLE))) FROM r0) END, 9) AS point
FROM samples GROUP BY metric"""
)


def headline_sql(side: str) -> str:
    """The headline bootstrap of one side of the split."""
    chosen = TEST_SQL.replace("WHERE side = 'test'", f"WHERE side = '{side}'")
    return with_sql(EVENTS_SQL, chosen, draws_sql("scored")) + HEADLINE_TAIL


@query("s2_headline_bootstrap", headline_sql("test"))
def headline(spark, folder):
    out = resample.headline_of_draws(scored_test(spark, folder), RESAMPLES, SEED)
    return rounded(out, ["ci_lower", "ci_upper", "ci_width", "std_error", "point"])


def both_scorers(spark, folder):
    """The stand-in score against a coarser one."""
    return scored_test(spark, folder).select(
        "transaction_id",
        "y",
        F.col("p").alias("p_incumbent"),
        (F.floor(F.col("p") * 37 % 10) / 10.0).alias("p_challenger"),
    )


@query(
    "s3_paired_delta_bootstrap",
    with_sql(
        EVENTS_SQL,
        TEST_SQL,
        """two AS (SELECT transaction_id, y, p AS p_incumbent,
  floor(p * 37 % 10) / 10e0 AS p_challenger FROM scored)""",
        draws_sql("two"),
        """long AS (SELECT resample, 'i' AS scorer, y, p_incumbent AS p FROM drawn
  UNION ALL SELECT resample, 'c', y, p_challenger FROM drawn
  UNION ALL SELECT -1, 'i', y, p_incumbent FROM two
  UNION ALL SELECT -1, 'c', y, p_challenger FROM two)""",
        ranked_sql("long", "resample, scorer, "),
        f"""ap AS (SELECT resample, scorer, {AP_SQL.replace(", 9)", ", 15)")} AS ap
  FROM r GROUP BY 1, 2)""",
        """d AS (SELECT resample, max(ap) FILTER (scorer = 'c') - max(ap) FILTER (scorer = 'i')
  AS value FROM ap GROUP BY 1)""",
    )
    + f"""SELECT {INTERVAL_SQL}, round(avg(CASE WHEN value > 0 THEN 1e0 ELSE 0e0 END), 9) AS win_share,
  quantile_cont(value, 0.025) > 0 OR quantile_cont(value, 0.975) < 0 AS excludes_zero,
  (SELECT round(value, 9) FROM d WHERE resample = -1) AS delta FROM d WHERE resample >= 0""",
)
def paired_delta(spark, folder):
    out = resample.paired_delta_of_draws(both_scorers(spark, folder), RESAMPLES, SEED)
    return rounded(out, ["ci_lower", "ci_upper", "win_share", "delta"])


POLICY_METRICS = {
    "a_false_alerts_per_10k": "fa_a * 10000 / n",
    "c_false_alerts_per_10k": "fa_c * 10000 / n",
    "false_alert_reduction_share": "(fa_a - fa_c) / nullif(fa_a, 0)",
    "c_review_queue_per_10k": "queue * 10000 / n",
    "c_precision_on_alerts": "hits_c / nullif(flags_c, 0)",
    "a_fraud_share_missed": "missed_a / nullif(frauds, 0)",
    "c_fraud_share_missed": "missed_c / nullif(frauds, 0)",
    "a_fraud_amount_share_missed": "amt_missed_a / nullif(amt, 0)",
    "c_fraud_amount_share_missed": "amt_missed_c / nullif(amt, 0)",
    "c_fraud_amount_share_caught_auto": "amt_caught_c / nullif(amt, 0)",
    "c_fraud_amount_share_surfaced": "amt_surfaced_c / nullif(amt, 0)",
    "c_legit_flagged_or_queued_per_10k": "(fa_c + queue_legit) * 10000 / n",
    "paired_a_minus_c_frauds_cleared": "missed_a - missed_c",
    "paired_c_minus_a_amount_share_surfaced": "(amt_surfaced_c - amt_surfaced_a) / nullif(amt, 0)",
    "paired_reduction_share_of_a_cleared": "(missed_a - missed_c) / nullif(missed_a, 0)",
}


def _n(where: str) -> str:
    return f"CAST(count(*) FILTER ({where}) AS DOUBLE)"


def _amt(where: str) -> str:
    return (
        f"CAST(coalesce(sum(CAST(amount AS DECIMAL(20,6))) FILTER ({where}), 0) AS DOUBLE)"
    )


@query(
    "s4_policy_bootstrap",
    BASE_SQL
    + f""", m AS (SELECT resample, y = 1 AS f, amount, p >= 0.5e0 AS a,
  greatest(p, 1 - p) >= {T}e0 AND p >= 0.5e0 AS c, greatest(p, 1 - p) < {T}e0 AS q FROM drawn),
s AS (SELECT resample, CAST(count(*) AS DOUBLE) AS n, {_n("f")} AS frauds,
  {_n("a AND NOT f")} AS fa_a, {_n("c AND NOT f")} AS fa_c, {_n("c")} AS flags_c,
  {_n("c AND f")} AS hits_c, {_n("q")} AS queue, {_n("q AND NOT f")} AS queue_legit,
  {_n("NOT a AND f")} AS missed_a, {_n("NOT c AND NOT q AND f")} AS missed_c,
  {_amt("f")} AS amt, {_amt("NOT a AND f")} AS amt_missed_a,
  {_amt("NOT c AND NOT q AND f")} AS amt_missed_c, {_amt("c AND f")} AS amt_caught_c,
  {_amt("(c OR q) AND f")} AS amt_surfaced_c, {_amt("a AND f")} AS amt_surfaced_a
  FROM m GROUP BY 1),
samples AS ("""
    + " UNION ALL ".join(
        f"SELECT '{k}' AS metric, CASE WHEN frauds > 0 AND fa_a > 0 AND flags_c > 0 "
        f"THEN {v} END AS value FROM s"
        for k, v in POLICY_METRICS.items()
    )
    + f""")
SELECT metric, {INTERVAL_SQL}, count(*) FILTER (value IS NULL) AS degenerate
FROM samples GROUP BY 1""",
)
def policy_intervals(spark, folder):
    out = resample.policy_of_draws(scored_test(spark, folder), T, RESAMPLES, SEED)
    return rounded(out, ["ci_lower", "ci_upper"])


WINDOW_SQL = (
    FOLD_ROWS_SQL
    + ", "
    + draws_sql("f", "fold")
    + """, dd AS (SELECT resample, fold, p, y, p * p AS c FROM drawn UNION ALL
  SELECT resample, 0, p, y, p * p FROM drawn UNION ALL
  SELECT -1, fold, p, y, p * p FROM f UNION ALL SELECT -1, 0, p, y, p * p FROM f), """
    + ranked_sql("dd", "resample, fold, ")
    + f""", ap AS (SELECT resample, fold, {AP_SQL.replace(", 9)", ", 15)")} AS ap, max(tp) AS tp
  FROM r GROUP BY 1, 2),
b AS (SELECT resample, fold, c, y, ntile(10) OVER (PARTITION BY resample, fold ORDER BY c, y)
  AS bin FROM dd),
bs AS (SELECT resample, fold, bin, count(*) AS n, sum(c) AS sp, sum(y) AS sy FROM b
  GROUP BY 1, 2, 3),
e AS (SELECT resample, fold, sum(abs(sp - sy)) / sum(n) AS ece FROM bs GROUP BY 1, 2),
every AS (SELECT resample, fold, 'average_precision' AS metric, ap AS value FROM ap
  UNION ALL SELECT resample, fold, 'ece', CASE WHEN tp > 0 THEN ece END FROM e JOIN ap
    USING (resample, fold)),
samples AS (SELECT * FROM every WHERE resample >= 0),
point AS (SELECT fold, metric, round(value, 9) AS point FROM every WHERE resample < 0)"""
)


@query(
    "s5_window_bootstrap",
    WINDOW_SQL
    + f"""
SELECT fold, metric, any_value(point) AS point, {INTERVAL_SQL},
  round(quantile_cont(value, 0.975) - quantile_cont(value, 0.025), 9) AS ci_width,
  count(*) FILTER (value IS NULL) AS degenerate
FROM samples JOIN point USING (fold, metric) GROUP BY 1, 2""",
)
def window_intervals(spark, folder):
    rows = fold_rows(spark, folder).withColumn("p_calibrated", F.col("p") * F.col("p"))
    out = resample.window_of_draws(rows, RESAMPLES, SEED)
    return rounded(out, ["point", "ci_lower", "ci_upper", "ci_width"])


def _held(df, point: str = "point"):
    """Whether the interval holds the value of the rows themselves."""
    return df.withColumn(
        "holds", (F.col("ci_lower") <= F.col(point)) & (F.col(point) <= F.col("ci_upper"))
    )


@query(
    "s2_headline_bootstrap_poisson",
    with_sql(
        EVENTS_SQL,
        TEST_SQL,
        ranked_sql("scored"),
    )
    + """SELECT 'recall' AS metric, round(count(*) FILTER (p >= 0.5e0 AND y = 1)
    / CAST(sum(y) AS DOUBLE), 9) AS point, 0 AS degenerate, true AS holds FROM scored
UNION ALL SELECT 'average_precision',
  round(sum(pos / CAST(tp AS DOUBLE) * (cp / CAST(cn AS DOUBLE))), 9), 0, true FROM r""",
)
def headline_poisson(spark, folder):
    out = _held(resample.headline_bootstrap(scored_test(spark, folder), RESAMPLES, SEED))
    return rounded(out, ["point"]).select("metric", "point", "degenerate", "holds")


@query(
    "s3_paired_delta_poisson",
    with_sql(
        EVENTS_SQL,
        TEST_SQL,
        """long AS (SELECT 'i' AS scorer, y, p FROM scored
  UNION ALL SELECT 'c', y, floor(p * 37 % 10) / 10e0 FROM scored)""",
        ranked_sql("long", "scorer, "),
        f"""ap AS (SELECT scorer, {AP_SQL.replace(", 9)", ", 15)")} AS ap FROM r GROUP BY 1)""",
    )
    + """SELECT round(max(ap) FILTER (scorer = 'c') - max(ap) FILTER (scorer = 'i'), 9) AS delta,
  true AS holds FROM ap""",
)
def paired_poisson(spark, folder):
    out = resample.paired_delta_bootstrap(both_scorers(spark, folder), RESAMPLES, SEED)
    return rounded(_held(out, "delta"), ["delta"]).select("delta", "holds")


@query(
    "s4_policy_bootstrap_poisson",
    " UNION ALL ".join(
        f"SELECT '{k}' AS metric, true AS ordered, 0 AS degenerate" for k in POLICY_METRICS
    ),
)
def policy_poisson(spark, folder):
    out = resample.policy_bootstrap(scored_test(spark, folder), T, RESAMPLES, SEED)
    return out.select("metric", (F.col("ci_lower") <= F.col("ci_upper")).alias("ordered"), "degenerate")


@query(
    "s5_window_bootstrap_poisson",
    WINDOW_SQL.replace(f"range({RESAMPLES})", "range(1)")
    + """
SELECT fold, metric, point FROM point""",
)
def window_poisson(spark, folder):
    rows = fold_rows(spark, folder).withColumn("p_calibrated", F.col("p") * F.col("p"))
    out = resample.window_bootstrap(rows, RESAMPLES, SEED)
    return rounded(out, ["point"]).select("fold", "metric", "point")


@query(
    "o14_poisson_counts",
    with_sql(EVENTS_SQL, TEST_SQL)
    + "SELECT y, count(*) AS n, true AS five_sigma FROM scored GROUP BY 1",
)
def poisson_weights(spark, folder):
    """The mean weight of a class over all resamples is the number of its rows."""
    scored = scored_test(spark, folder)
    sums = {"y0": (F.col("y") == 0).cast("int"), "y1": (F.col("y") == 1).cast("int")}
    drawn = resample.poisson_sums(resample.grouped(scored, ["p", "y"]), sums, RESAMPLES, SEED)
    means = drawn.agg(F.avg("y0").alias("y0"), F.avg("y1").alias("y1"))
    mean = means.select(F.posexplode(F.array("y0", "y1")).alias("y", "mean"))
    n = scored.groupBy(F.col("y").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    near = F.abs(F.col("mean") - F.col("n")) <= 5 * F.sqrt(F.col("n") / RESAMPLES)
    return n.join(mean, "y").select("y", "n", near.alias("five_sigma"))
