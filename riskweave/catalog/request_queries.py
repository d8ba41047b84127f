"""Request logs. Events stand for requests: the value is the
latency in ms, error events are failures, the user picks the load level, the key the instance."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.catalog.common import query, rounded, table
from riskweave.operators import requests
from riskweave.session import scratch_path

LOG_SQL = """log AS (SELECT event_id, user_id, epoch_us(ts) AS start_us,
  value AS latency_ms, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
  CAST(pow(2, user_id % 6) AS BIGINT) AS concurrency,
  'run' || CAST(event_id % 3 AS VARCHAR) AS run,
  CASE WHEN event_id % 2 = 0 THEN 'on' ELSE 'off' END AS arm,
  'i' || CAST(CAST(json_extract_string(props, '$.k') AS INT) % 12 AS VARCHAR) AS instance,
  epoch_us((SELECT min(ts) FROM events)) AS t0, epoch_us((SELECT max(ts) FROM events)) AS t1
  FROM events)"""


def log(spark, folder):
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    bounds = events.agg(
        F.unix_micros(F.min("ts")).alias("t0"), F.unix_micros(F.max("ts")).alias("t1")
    )
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        "event_id",
        "user_id",
        F.unix_micros("ts").alias("start_us"),
        F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.pow(F.lit(2.0), F.col("user_id") % 6).cast("long").alias("concurrency"),
        F.concat(F.lit("run"), (F.col("event_id") % 3).cast("string")).alias("run"),
        F.when(F.col("event_id") % 2 == 0, "on").otherwise("off").alias("arm"),
        F.concat(F.lit("i"), (k % 12).cast("string")).alias("instance"),
        bounds.select("t0").scalar().alias("t0"),
        bounds.select("t1").scalar().alias("t1"),
    )


LEVEL_SQL = LOG_SQL + """, lv AS (SELECT {keys}, count(*) AS requests,
  count(*) FILTER (status = 200) AS ok, count(*) FILTER (status <> 200) AS errors,
  avg(CASE WHEN status <> 200 THEN 1e0 ELSE 0e0 END) AS error_rate,
  count(*) FILTER (status = 200) / ((t1 - t0 - 7200000000) / 1e6) AS req_per_s,
  max(latency_ms) FILTER (status = 200) AS max_ms,
  round(avg(latency_ms) FILTER (status = 200), 9) AS mean_ms,
  round(quantile_cont(latency_ms, 0.5) FILTER (status = 200), 9) AS p50_ms,
  round(quantile_cont(latency_ms, 0.95) FILTER (status = 200), 9) AS p95_ms,
  round(quantile_cont(latency_ms, 0.99) FILTER (status = 200), 9) AS p99_ms
  FROM log WHERE start_us >= t0 + 3600000000 AND start_us + latency_ms * 1000 <= t1 - 3600000000
  GROUP BY {keys}, t0, t1)"""
MS = ["mean_ms", "p50_ms", "p95_ms", "p99_ms"]


def levels(spark, folder, keys):
    hour = 3_600_000_000
    out = requests.level_summary(
        log(spark, folder), [*keys, "t0", "t1"], F.col("t0") + hour, F.col("t1") - hour
    )
    return rounded(out.drop("t0", "t1"), MS)


@query(
    "l1_level_summary",
    "WITH " + LEVEL_SQL.format(keys="run, concurrency") + " SELECT * FROM lv",
)
def level_summary(spark, folder):
    return levels(spark, folder, ["run", "concurrency"])


@query(
    "w7_throughput_knee",
    "WITH "
    + LEVEL_SQL.format(keys="run, concurrency")
    + """, nx AS (SELECT *, lead(req_per_s) OVER (PARTITION BY run ORDER BY concurrency) AS nxt
  FROM lv), c AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY concurrency) AS k FROM nx
  WHERE req_per_s > 0 AND nxt / req_per_s < 1.1e0)
SELECT run, concurrency AS knee_concurrency, req_per_s AS knee_req_per_s, p99_ms AS knee_p99_ms,
  nxt / req_per_s AS next_level_gain FROM c WHERE k = 1""",
)
def knee(spark, folder):
    return requests.throughput_knee(levels(spark, folder, ["run", "concurrency"]), ["run"])


@query(
    "l2_run_summary",
    "WITH "
    + LEVEL_SQL.format(keys="run, concurrency")
    + """, pk AS (SELECT *, row_number() OVER (PARTITION BY run
    ORDER BY req_per_s DESC, concurrency) AS k FROM lv),
ft AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY req_per_s DESC, concurrency) AS k
  FROM lv WHERE p99_ms <= 100e0 AND errors = 0),
te AS (SELECT run, CAST(sum(errors) AS BIGINT) AS total_errors FROM lv GROUP BY 1)
SELECT te.run, pk.concurrency AS peak_concurrency, pk.req_per_s AS peak_req_per_s,
  pk.p50_ms AS peak_p50_ms, pk.p99_ms AS peak_p99_ms, ft.concurrency AS best_concurrency,
  ft.req_per_s AS best_req_per_s, ft.p99_ms AS best_p99_ms, total_errors
FROM te JOIN pk ON te.run = pk.run AND pk.k = 1
LEFT JOIN ft ON te.run = ft.run AND ft.k = 1""",
)
def run_summary(spark, folder):
    return requests.run_summary(levels(spark, folder, ["run", "concurrency"]), ["run"], 100.0)


@query(
    "s8_spread",
    "WITH "
    + LOG_SQL
    + """, o AS (SELECT concurrency, arm, latency_ms, row_number() OVER
    (PARTITION BY concurrency, arm ORDER BY latency_ms) - 1 AS k,
    count(*) OVER (PARTITION BY concurrency, arm) AS n FROM log)
SELECT concurrency, arm, min(latency_ms) AS low,
  round(quantile_cont(latency_ms, 0.5), 9) AS median,
  max(latency_ms) FILTER (k = n // 2) AS upper_median, max(latency_ms) AS high
FROM o GROUP BY 1, 2""",
)
def spread(spark, folder):
    out = requests.spread(log(spark, folder), "latency_ms", ["concurrency", "arm"])
    return rounded(out, ["median"])


@query(
    "l3_arm_comparison",
    "WITH "
    + LEVEL_SQL.format(keys="run, concurrency, arm")
    + """, a AS (SELECT concurrency, arm, count(*) AS runs, CAST(sum(errors) AS BIGINT) AS errors,
  min(req_per_s) AS low, quantile_cont(req_per_s, 0.5) AS median, max(req_per_s) AS high,
  min(p99_ms) AS p99_low, quantile_cont(p99_ms, 0.5) AS p99_median, max(p99_ms) AS p99_high
  FROM lv GROUP BY 1, 2)
SELECT concurrency, """
    + ", ".join(
        f"max({n}) FILTER (arm = '{a}') AS {p}_{n}"
        for a, p in (("on", "shipped"), ("off", "before"))
        for n in (
            "runs", "errors", "low", "median", "high", "p99_low", "p99_median", "p99_high",
        )
    )
    + """, round(max(median) FILTER (arm = 'on') / max(median) FILTER (arm = 'off'), 9) AS median_ratio,
  round(max(low) FILTER (arm = 'on') / max(high) FILTER (arm = 'off'), 9) AS worst_case_ratio
FROM a GROUP BY 1""",
)
def arm_comparison(spark, folder):
    results = levels(spark, folder, ["run", "concurrency", "arm"])
    out = requests.arm_comparison(results, ["concurrency"], "on", "off")
    return rounded(out, ["median_ratio", "worst_case_ratio"])


STACKS_SQL = """st AS (SELECT 'main;' || event_type || ';leaf' || CAST(user_id % 17 AS VARCHAR) AS stack,
  event_id % 5 + 1 AS samples FROM events)"""


def stacks(spark, folder):
    """Stack lines written as text and read back."""
    events = table(spark, folder, "events")
    line = F.concat(
        F.lit("main;"), "event_type", F.lit(";leaf"), (F.col("user_id") % 17).cast("string"),
        F.lit(" "), (F.col("event_id") % 5 + 1).cast("string"),
    )
    noise = F.when(F.col("event_id") % 50 == 0, F.lit("no count here")).otherwise(line)
    path = scratch_path(spark, "stacks")
    events.select(F.explode(F.array_distinct(F.array(line, noise))).alias("value")).write.text(path)
    return requests.parse_stacks(spark.read.text(path))


BUCKETS = {"errors": ";error;", "any_view": "view|purchase", "leaf_1": "leaf1$"}


@query(
    "l4_stack_shares",
    "WITH "
    + STACKS_SQL
    + " "
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS bucket,
  CAST(coalesce(sum(samples) FILTER (regexp_matches(stack, '{rx}')), 0) AS BIGINT) AS samples,
  coalesce(sum(samples) FILTER (regexp_matches(stack, '{rx}')), 0)
    / CAST(sum(samples) AS DOUBLE) * 100 AS share_percent FROM st"""
        for name, rx in BUCKETS.items()
    ),
)
def stack_shares(spark, folder):
    return requests.stack_shares(stacks(spark, folder), BUCKETS)


@query(
    "l4_top_leaf_frames",
    "WITH "
    + STACKS_SQL
    + """ SELECT 'leaf' || regexp_extract(stack, 'leaf(.*)$', 1) AS frame,
  CAST(sum(samples) AS BIGINT) AS samples,
  sum(samples) / CAST((SELECT sum(samples) FROM st) AS DOUBLE) * 100 AS share_percent
FROM st GROUP BY 1 ORDER BY samples DESC, frame LIMIT 10""",
)
def top_leaves(spark, folder):
    return requests.top_leaf_frames(stacks(spark, folder))


HOUR_SQL = LOG_SQL + """, hb AS (SELECT run, (start_us - t0) // 3600000000 * 3600 AS offset_s,
  count(*) AS requests, count(*) FILTER (status <> 200) AS failed, max(t0) / 1e6 AS t0_s,
  floor((max(t1) - max(t0)) / 1e6) AS dur FROM log GROUP BY 1, 2)"""


def hour_buckets(spark, folder):
    hour = 3_600_000_000
    offset = F.expr(f"(start_us - t0) div {hour} * 3600")
    return (
        log(spark, folder)
        .groupBy("run", offset.alias("offset_s"), "t0", "t1")
        .agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") != 200).alias("failed"))
    )


# 2024-01-03, 2024-01-06 and 2024-01-09 UTC
WINDOWS = [
    ("early", None, 1704240000.0),
    ("middle", 1704240000.0, 1704499200.0),
    ("late", 1704758400.0, None),
    ("never", 1.0, 2.0),
]


@query(
    "l5_bucket_windows",
    "WITH "
    + HOUR_SQL
    + """, wd("window", lo, hi) AS (VALUES ('early', NULL, 1704240000e0),
  ('middle', 1704240000e0, 1704499200e0), ('late', 1704758400e0, NULL), ('never', 1e0, 2e0)),
x AS (SELECT run, "window", offset_s, requests, failed, offset_s + 3600 <= dur
    AND (lo IS NULL OR t0_s + offset_s >= lo) AND (hi IS NULL OR t0_s + offset_s + 3600 <= hi)
    AS inside FROM hb CROSS JOIN wd)
SELECT run, "window", count(*) FILTER (inside) AS full_buckets,
  min(offset_s) FILTER (inside) AS from_s, max(offset_s + 3600) FILTER (inside) AS to_s,
  CAST(coalesce(sum(requests) FILTER (inside), 0) AS BIGINT) AS requests,
  CAST(coalesce(sum(failed) FILTER (inside), 0) AS BIGINT) AS failed,
  CASE WHEN count(*) FILTER (inside) > 0 THEN sum(requests) FILTER (inside)
    / CAST(3600 * count(*) FILTER (inside) AS DOUBLE) END AS req_per_s
FROM x GROUP BY 1, 2""",
)
def bucket_windows(spark, folder):
    """Also J5: buckets that lie wholly inside a window."""
    return requests.bucket_windows(
        hour_buckets(spark, folder),
        WINDOWS,
        ["run"],
        F.col("t0") / 1e6,
        F.lit(3600),
        F.floor((F.col("t1") - F.col("t0")) / 1e6),
    )


@query(
    "j5_contained_buckets",
    "WITH "
    + HOUR_SQL
    + """ SELECT run, count(*) AS full_buckets, CAST(sum(requests) AS BIGINT) AS requests FROM hb
WHERE offset_s + 3600 <= dur AND t0_s + offset_s >= 1704240000e0
  AND t0_s + offset_s + 3600 <= 1704758400e0 GROUP BY 1""",
)
def contained_buckets(spark, folder):
    out = requests.bucket_windows(
        hour_buckets(spark, folder),
        [("span", 1704240000.0, 1704758400.0)],
        ["run"],
        F.col("t0") / 1e6,
        F.lit(3600),
        F.floor((F.col("t1") - F.col("t0")) / 1e6),
    )
    return out.select("run", "full_buckets", "requests")


@query(
    "l6_instance_spread",
    "WITH "
    + LOG_SQL
    + """, c AS (SELECT run, instance, count(*) AS requests FROM log
    WHERE NOT (instance = 'i3' AND event_id % 20 <> 3) GROUP BY 1, 2),
t AS (SELECT *, sum(requests) OVER (PARTITION BY run) AS total FROM c)
SELECT run, CAST(total AS BIGINT) AS total,
  count(*) FILTER (total > 0 AND requests >= 0.05e0 * total) AS serving, count(*) AS running
FROM t GROUP BY 1, 2""",
)
def instance_spread(spark, folder):
    seen = ~((F.col("instance") == "i3") & (F.col("event_id") % 20 != 3))
    counts = log(spark, folder).where(seen).groupBy("run", "instance").agg(
        F.count(F.lit(1)).alias("requests")
    )
    return requests.instance_spread(counts, ["run"])


SAMPLES_SQL = LOG_SQL + """, sm AS (SELECT run, start_us AS t, user_id % 5 + 1 AS current,
  user_id % 5 + CAST(event_id % 2 AS BIGINT) + 1 AS desired, latency_ms AS cpu_percent FROM log)"""


def samples(spark, folder):
    base = F.col("user_id") % 5 + 1
    return log(spark, folder).select(
        "run",
        F.col("start_us").alias("t"),
        base.alias("current"),
        (base + F.col("event_id") % 2).alias("desired"),
        F.col("latency_ms").alias("cpu_percent"),
    )


TIMELINE_SQL = """, top AS (SELECT run, max(desired) AS top FROM sm GROUP BY 1)
SELECT run, min(current) AS replicas_min, max(current) AS replicas_max,
  min(t) FILTER (desired = top) AS desired_max_first_seen,
  min(t) FILTER (current = top) AS current_max_first_seen, max(cpu_percent) AS cpu_percent_max
FROM sm JOIN top USING (run) GROUP BY 1"""


@query("l7_replica_timeline", "WITH " + SAMPLES_SQL + TIMELINE_SQL)
def replica_timeline(spark, folder):
    return requests.replica_timeline(samples(spark, folder), ["run"])


@query(
    "w8_first_time_at_maximum",
    "WITH "
    + SAMPLES_SQL
    + """ SELECT run, min(t) AS desired_max_first_seen FROM (SELECT *, max(desired) OVER
  (PARTITION BY run) AS m FROM sm) WHERE desired = m GROUP BY 1""",
)
def first_at_maximum(spark, folder):
    out = requests.replica_timeline(samples(spark, folder), ["run"])
    return out.select("run", "desired_max_first_seen")


RUNS_SQL = LOG_SQL + """, rn AS (SELECT user_id, max(arm2) AS arm, count(*) AS requests,
  count(*) FILTER (status <> 200 AND latency_ms > 60) AS failed, user_id % 10 <> 0 AS valid
  FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'on' ELSE 'off' END AS arm2 FROM log) GROUP BY user_id),
fa AS (SELECT arm, count(*) AS valid_runs, count(*) FILTER (failed > 0) AS runs_with_failure,
  CAST(sum(failed) AS BIGINT) AS failed_total, CAST(sum(requests) AS BIGINT) AS requests_total
  FROM rn WHERE valid GROUP BY 1)"""


def runs(spark, folder):
    bad = (F.col("status") != 200) & (F.col("latency_ms") > 60)
    return (
        log(spark, folder)
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("requests"), F.count_if(bad).alias("failed"))
        .withColumn("arm", F.when(F.col("user_id") % 2 == 0, "on").otherwise("off"))
        .withColumn("valid", F.col("user_id") % 10 != 0)
    )


@query("l8_failures_by_arm", "WITH " + RUNS_SQL + " SELECT * FROM fa")
def failures_by_arm(spark, folder):
    return requests.failures_by_arm(runs(spark, folder))


@query(
    "s7_fisher_exact",
    "WITH "
    + RUNS_SQL
    + """, c AS (SELECT max(runs_with_failure) FILTER (arm = 'off') AS off_failing,
  max(valid_runs) FILTER (arm = 'off') AS off_runs,
  max(runs_with_failure) FILTER (arm = 'on') AS on_failing,
  max(valid_runs) FILTER (arm = 'on') AS on_runs FROM fa),
i AS (SELECT *, unnest(range(greatest(off_failing, off_failing + on_failing - on_runs),
  least(off_failing + on_failing, off_runs) + 1)) AS k FROM c)
SELECT off_failing, off_runs, on_failing, on_runs, round(sum(exp(
  lgamma(off_runs + 1) - lgamma(k + 1) - lgamma(off_runs - k + 1)
  + lgamma(on_runs + 1) - lgamma(off_failing + on_failing - k + 1)
  - lgamma(on_runs - (off_failing + on_failing - k) + 1)
  - (lgamma(off_runs + on_runs + 1) - lgamma(off_failing + on_failing + 1)
     - lgamma(off_runs + on_runs - off_failing - on_failing + 1)))), 7) AS p_value
FROM i GROUP BY 1, 2, 3, 4""",
)
def fisher(spark, folder):
    by_arm = requests.failures_by_arm(runs(spark, folder))
    return rounded(requests.failure_test(by_arm, "off", "on"), ["p_value"], 7)


COUNTERS_SQL = LOG_SQL + """, c0 AS (SELECT instance, count(*) AS requests FROM log
  WHERE start_us < t0 + (t1 - t0) / 2 AND instance <> 'i7' GROUP BY 1),
c1 AS (SELECT instance, count(*) AS requests FROM log GROUP BY 1),
dl AS (SELECT c1.instance, c1.requests - coalesce(c0.requests, 0) AS requests
  FROM c1 LEFT JOIN c0 ON c1.instance = c0.instance)"""


def counters(spark, folder):
    rows = log(spark, folder)
    half = rows.where(
        (F.col("start_us") < F.col("t0") + (F.col("t1") - F.col("t0")) / 2)
        & (F.col("instance") != "i7")
    )
    count = F.count(F.lit(1)).alias("requests")
    return half.groupBy("instance").agg(count), rows.groupBy("instance").agg(count)


@query("l10_counter_delta", "WITH " + COUNTERS_SQL + " SELECT * FROM dl")
def counter_delta(spark, folder):
    return requests.counter_delta(*counters(spark, folder))


@query(
    "l10_counters_complete",
    "WITH "
    + COUNTERS_SQL
    + """ SELECT CAST(sum(requests) AS BIGINT) AS delta_total, bool_and(requests >= 0) AS monotone,
  abs((SELECT sum(requests) FROM c0) - 100) <= 2 AS total_matches FROM dl""",
)
def counters_complete(spark, folder):
    before, after = counters(spark, folder)
    return requests.counters_complete(before, requests.counter_delta(before, after), 100)


@query(
    "l11_replacement_check",
    "WITH "
    + LOG_SQL
    + """, b AS (SELECT DISTINCT run || instance AS instance FROM log WHERE run = 'run0'),
a AS (SELECT DISTINCT run || instance AS instance FROM log WHERE run <> 'run0'
  OR instance = 'i1'),
k AS (SELECT count(*) AS n FROM (SELECT instance FROM a INTERSECT SELECT instance FROM b))
SELECT count(*) AS instances_after, max(k.n) AS instances_kept,
  count(*) > 0 AND max(k.n) = 0 AS every_instance_replaced FROM a CROSS JOIN k""",
)
def replacement(spark, folder):
    rows = log(spark, folder).withColumn("name", F.concat("run", "instance"))
    before = rows.where("run = 'run0'").select(F.col("name").alias("instance"))
    after = rows.where("run <> 'run0' OR instance = 'i1'").select(
        F.col("name").alias("instance")
    )
    return requests.replaced(before, after)


@query(
    "l12_failure_gate",
    "WITH "
    + LOG_SQL
    + """, s AS (SELECT run,
  count(*) FILTER (status = 500 AND latency_ms < 20) AS failed_5xx,
  count(*) FILTER (status = 500 AND latency_ms >= 20 AND run = 'run1') AS failed_other_status,
  count(*) FILTER (status = 500 AND latency_ms > 100000) AS failed_connection FROM log GROUP BY 1)
SELECT run, failed_5xx + failed_other_status + failed_connection AS failed_total,
  concat_ws(',', CASE WHEN failed_5xx > 0 THEN 'failed_5xx' END,
    CASE WHEN failed_other_status > 0 THEN 'failed_other_status' END,
    CASE WHEN failed_connection > 0 THEN 'failed_connection' END) AS problems FROM s""",
)
def failure_gate(spark, folder):
    bad, ms = F.col("status") == 500, F.col("latency_ms")
    phases = log(spark, folder).select(
        "run",
        (bad & (ms < 20)).cast("long").alias("failed_5xx"),
        (bad & (ms >= 20) & (F.col("run") == "run1")).cast("long").alias("failed_other_status"),
        (bad & (ms > 100000)).cast("long").alias("failed_connection"),
    )
    classes = ["failed_5xx", "failed_other_status", "failed_connection"]
    return requests.failure_gate(phases, classes, ["run"])


RELEASE_SQL = COUNTERS_SQL + """, f AS (SELECT run, count(*) FILTER (status = 500) AS n FROM log GROUP BY 1),
b AS (SELECT DISTINCT run || instance AS instance FROM log WHERE run = 'run0'),
a AS (SELECT DISTINCT run || instance AS instance FROM log WHERE run = 'run2'),
r AS (SELECT max(t1) - max(start_us) FILTER (instance = 'i1') AS margin FROM log),
k AS (SELECT (SELECT count(*) FROM a) AS n, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS kept),
g AS (SELECT 'no failures in ' || run AS "check", n = 0 AS holds, CAST(n AS VARCHAR) AS found FROM f
  UNION ALL SELECT 'rollout ended under load', margin > 0, CAST(margin AS VARCHAR) FROM r
  UNION ALL SELECT 'every instance replaced', n > 0 AND kept = 0, CAST(kept AS VARCHAR) FROM k
  UNION ALL SELECT 'counters complete', bool_and(requests >= 0) AND (SELECT abs((SELECT sum(requests) FROM c0)
    - count(*) FILTER (start_us < t0 + (t1 - t0) / 2 AND instance <> 'i7')) <= 2 FROM log),
    CAST(sum(requests) AS VARCHAR) FROM dl)"""


def release(spark, folder):
    rows = log(spark, folder)
    bad = rows.select("run", (F.col("status") == 500).cast("long").alias("failed"))
    end = F.max(F.when(F.col("instance") == "i1", F.col("start_us")))
    rollout = rows.agg(end.alias("rollout_end_us"), F.max("t1").alias("load_end_us"))
    named = rows.withColumn("instance", F.concat("run", "instance"))
    before, after = counters(spark, folder)
    sent = rows.where(
        (F.col("start_us") < F.col("t0") + (F.col("t1") - F.col("t0")) / 2) & (F.col("instance") != "i7")
    )
    return requests.release_gate(
        requests.failure_gate(bad, ["failed"], ["run"]),
        rollout,
        requests.replaced(named.where("run = 'run0'"), named.where("run = 'run2'")),
        requests.counters_complete(
            before, requests.counter_delta(before, after), sent.agg(F.count(F.lit(1)).alias("n")).scalar()
        ),
        "run",
    )


@query("l12_release_gate", "WITH " + RELEASE_SQL + " SELECT * FROM g")
def release_gate(spark, folder):
    """Failures of every phase, the end of the rollout, replaced instances and counters."""
    return release(spark, folder)


@query(
    "l12_release_passes",
    "WITH "
    + RELEASE_SQL
    + """ SELECT bool_and(holds) AS passes,
  array_to_string(list_sort(list("check") FILTER (NOT holds)), '; ') AS problems FROM g""",
)
def release_passes(spark, folder):
    return requests.gate_passes(release(spark, folder))
