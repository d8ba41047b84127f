"""Summaries of request logs, load runs and replica samples.

A request is (run, level, start_us, latency_ms, status, ...), one row each; a level result is one
row per (run, concurrency). Request tables are large and use exact distributed quantiles; level
results and replica samples are grouped by run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.scores import fisher_one_sided, ratio
from riskweave.operators.ordered import scan, summary_quantiles

KNEE_GAIN = 1.10
LATENCY_BUDGET_MS = 10.0
LATENCY_LEVELS = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}


def level_summary(
    requests: DataFrame, by: Sequence[str], window_from_us: Column, window_to_us: Column
) -> DataFrame:
    """Requests that start and end inside the window: counts, error rate, throughput of good
    requests and their latency quantiles."""
    end = F.col("start_us") + F.col("latency_ms") * 1000
    inside = requests.where((F.col("start_us") >= window_from_us) & (end <= window_to_us))
    good = F.col("status") == 200
    seconds = (window_to_us - window_from_us) / F.lit(1e6)
    counts = inside.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(good).alias("ok"),
        F.count_if(~good).alias("errors"),
        F.avg((~good).cast("double")).alias("error_rate"),
        (F.count_if(good) / seconds).alias("req_per_s"),
        F.max(F.when(good, F.col("latency_ms"))).alias("max_ms"),
        F.avg(F.when(good, F.col("latency_ms"))).alias("mean_ms"),
    )
    quantiles = summary_quantiles(inside.where(good), "latency_ms", LATENCY_LEVELS, by)
    return counts.join(quantiles, list(by), "left")


def throughput_knee(levels: DataFrame, run: Sequence[str], gain: float = KNEE_GAIN) -> DataFrame:
    """First level whose successor gains less than `gain`; idle levels are passed over."""
    w = Window.partitionBy(*run).orderBy("concurrency")
    grown = levels.withColumn("_next", F.lead("req_per_s").over(w)).where(
        (F.col("req_per_s") > 0) & (ratio(F.col("_next"), F.col("req_per_s")) < gain)
    )
    first = F.min_by(F.struct("concurrency", "req_per_s", "p99_ms", "_next"), "concurrency")
    knee = grown.groupBy(*run).agg(first.alias("k"))
    return knee.select(
        *run,
        F.col("k.concurrency").alias("knee_concurrency"),
        F.col("k.req_per_s").alias("knee_req_per_s"),
        F.col("k.p99_ms").alias("knee_p99_ms"),
        (F.col("k._next") / F.col("k.req_per_s")).alias("next_level_gain"),
    )


def run_summary(
    levels: DataFrame, run: Sequence[str], budget_ms: float = LATENCY_BUDGET_MS
) -> DataFrame:
    """Peak level, best level within the latency budget without errors, and total errors. The
    lower concurrency wins among equals."""
    rank = F.struct(F.col("req_per_s"), -F.col("concurrency"))
    level = F.struct("concurrency", "req_per_s", "p50_ms", "p99_ms")
    fits = (F.col("p99_ms") <= budget_ms) & (F.col("errors") == 0)
    table = levels.groupBy(*run).agg(
        F.max_by(level, rank).alias("peak"),
        F.max_by(F.when(fits, level), F.when(fits, rank)).alias("best"),
        F.sum("errors").alias("total_errors"),
    )
    return table.select(
        *run,
        F.col("peak.concurrency").alias("peak_concurrency"),
        F.col("peak.req_per_s").alias("peak_req_per_s"),
        F.col("peak.p50_ms").alias("peak_p50_ms"),
        F.col("peak.p99_ms").alias("peak_p99_ms"),
        F.col("best.concurrency").alias("best_concurrency"),
        F.col("best.req_per_s").alias("best_req_per_s"),
        F.col("best.p99_ms").alias("best_p99_ms"),
        "total_errors",
    )


def spread(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Minimum, true median, upper median and maximum of a value per group."""
    known = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("_k")
    )
    ranked = scan(known, [value], ["_k"], within=by)
    first, past = F.col("_k_before"), F.col("_k_before") + F.col("_k")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < past), F.col(value)))

    upper = at(F.floor(F.col("_k_total") / 2))
    lower = at(F.floor((F.col("_k_total") - 1) / 2))
    return ranked.groupBy(*by).agg(
        F.min(value).alias("low"),
        ((lower + upper) / 2).alias("median"),
        upper.alias("upper_median"),
        F.max(value).alias("high"),
    )


def arm_comparison(
    results: DataFrame, by: Sequence[str], shipped: str, before: str
) -> DataFrame:
    """Throughput and p99 of two arms per group over rounds, the ratio of medians and the worst
    case: slowest shipped round over fastest earlier one."""
    keys = [*by, "arm"]
    speed = spread(results, "req_per_s", keys).drop("upper_median")
    tail = spread(results, "p99_ms", keys).select(
        *keys, F.col("low").alias("p99_low"), F.col("median").alias("p99_median"),
        F.col("high").alias("p99_high"),
    )
    runs = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("errors").alias("errors")
    )
    table = runs.join(speed, keys, "left").join(tail, keys, "left")

    def of(arm: str, name: str) -> Column:
        return F.max(F.when(F.col("arm") == arm, F.col(name)))

    names = ["runs", "errors", "low", "median", "high", "p99_low", "p99_median", "p99_high"]
    return (
        table.where(F.col("arm").isin(shipped, before))
        .groupBy(*by)
        .agg(
            *[of(shipped, n).alias(f"shipped_{n}") for n in names],
            *[of(before, n).alias(f"before_{n}") for n in names],
        )
        .withColumn("median_ratio", ratio(F.col("shipped_median"), F.col("before_median")))
        .withColumn("worst_case_ratio", ratio(F.col("shipped_low"), F.col("before_high")))
    )


def parse_stacks(lines: DataFrame) -> DataFrame:
    """(stack, samples) from lines `frame;frame;frame count`; other lines are dropped."""
    line = F.col("value")
    return lines.where(line.rlike(r"^.+ \d+$")).select(
        F.regexp_extract(line, r"^(.*) \d+$", 1).alias("stack"),
        F.regexp_extract(line, r" (\d+)$", 1).cast("long").alias("samples"),
    )


def stack_shares(stacks: DataFrame, buckets: dict[str, str]) -> DataFrame:
    """Share of samples, in percent, whose stack matches each pattern; patterns may overlap."""
    total = F.sum("samples")
    hits = [
        F.sum(F.when(F.col("stack").rlike(rx), F.col("samples")).otherwise(0)).alias(f"h{i}")
        for i, rx in enumerate(buckets.values())
    ]
    sums = stacks.agg(total.alias("total"), *hits)
    entries = [
        F.struct(
            F.lit(name).alias("bucket"),
            F.col(f"h{i}").alias("samples"),
            (ratio(F.col(f"h{i}"), F.col("total")) * 100).alias("share_percent"),
        )
        for i, name in enumerate(buckets)
    ]
    return sums.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def top_leaf_frames(stacks: DataFrame, k: int = 10) -> DataFrame:
    """The k most sampled innermost frames (names break ties)."""
    total = stacks.agg(F.sum("samples").alias("n")).scalar()
    leaf = F.regexp_extract("stack", r"([^;]*)$", 1)
    return (
        stacks.groupBy(leaf.alias("frame"))
        .agg(F.sum("samples").alias("samples"))
        .orderBy(F.desc("samples"), "frame")
        .limit(k)
        .withColumn("share_percent", ratio(F.col("samples"), total) * 100)
    )


def bucket_windows(
    buckets: DataFrame,
    windows: Sequence[tuple[str, float | None, float | None]],
    by: Sequence[str],
    start: Column,
    width: Column,
    duration: Column,
) -> DataFrame:
    """Requests per named wall-clock window. Only buckets that lie wholly inside the phase and
    the window count; an open bound is None. A window without buckets has a null rate.

    `buckets` holds (offset_s, requests, failed); `start` is the phase's epoch second."""
    at, end = start + F.col("offset_s"), start + F.col("offset_s") + width
    entries = [
        F.struct(
            F.lit(i).alias("window_no"),
            F.lit(name).alias("window"),
            F.lit(lo).cast("double").alias("lo"),
            F.lit(hi).cast("double").alias("hi"),
        )
        for i, (name, lo, hi) in enumerate(windows)
    ]
    inside = (
        (F.col("offset_s") + width <= duration)
        & (F.col("w.lo").isNull() | (at >= F.col("w.lo")))
        & (F.col("w.hi").isNull() | (end <= F.col("w.hi")))
    )
    tagged = buckets.withColumn("w", F.explode(F.array(*entries))).withColumn("_in", inside)
    full = F.count_if("_in")
    n = F.coalesce(F.sum(F.when(F.col("_in"), F.col("requests"))), F.lit(0))
    return tagged.groupBy(*by, F.col("w.window").alias("window")).agg(
        full.alias("full_buckets"),
        F.min(F.when(F.col("_in"), F.col("offset_s"))).alias("from_s"),
        F.max(F.when(F.col("_in"), F.col("offset_s") + width)).alias("to_s"),
        n.alias("requests"),
        F.coalesce(F.sum(F.when(F.col("_in"), F.col("failed"))), F.lit(0)).alias("failed"),
        F.when(full > 0, n / F.sum(F.when(F.col("_in"), width))).alias("req_per_s"),
    )


def instance_spread(counts: DataFrame, by: Sequence[str], floor: float = 0.05) -> DataFrame:
    """Requests in total, instances that serve at least `floor` of them, instances running."""
    totals = counts.groupBy(*by).agg(F.sum("requests").alias("total"))
    joined = counts.join(totals, list(by))
    serving = (F.col("total") > 0) & (F.col("requests") >= floor * F.col("total"))
    return joined.groupBy(*by, "total").agg(
        F.count_if(serving).alias("serving"), F.count(F.lit(1)).alias("running")
    )


def replica_timeline(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Replica range, the first times the largest wanted size was wanted and was running (null
    if never), and the top utilisation. `samples` holds (t, current, desired, cpu_percent)."""
    top = samples.groupBy(*by).agg(F.max("desired").alias("_top"))
    first = {n: F.min(F.when(F.col(n) == F.col("_top"), F.col("t"))) for n in
             ("desired", "current")}
    return (
        samples.join(top, list(by))
        .groupBy(*by)
        .agg(
            F.min("current").alias("replicas_min"),
            F.max("current").alias("replicas_max"),
            first["desired"].alias("desired_max_first_seen"),
            first["current"].alias("current_max_first_seen"),
            F.max("cpu_percent").alias("cpu_percent_max"),
        )
    )


def failures_by_arm(runs: DataFrame) -> DataFrame:
    """Valid runs per arm: how many had a failure, and the totals."""
    return (
        runs.where("valid")
        .groupBy("arm")
        .agg(
            F.count(F.lit(1)).alias("valid_runs"),
            F.count_if(F.col("failed") > 0).alias("runs_with_failure"),
            F.sum("failed").alias("failed_total"),
            F.sum("requests").alias("requests_total"),
        )
    )


def failure_test(by_arm: DataFrame, off: str, on: str) -> DataFrame:
    """One-sided Fisher p-value that `off` has at least as many failing runs by chance."""

    def of(arm: str, name: str) -> Column:
        return F.max(F.when(F.col("arm") == arm, F.col(name)))

    table = by_arm.agg(
        of(off, "runs_with_failure").alias("off_failing"),
        of(off, "valid_runs").alias("off_runs"),
        of(on, "runs_with_failure").alias("on_failing"),
        of(on, "valid_runs").alias("on_runs"),
    )
    p = fisher_one_sided(
        F.col("off_failing"), F.col("off_runs"), F.col("on_failing"), F.col("on_runs")
    )
    return table.withColumn("p_value", p)


def counter_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(instance, requests): growth of each instance's counter; a new instance starts at 0."""
    earlier = before.select("instance", F.col("requests").alias("_earlier"))
    grown = F.col("requests") - F.coalesce(F.col("_earlier"), F.lit(0))
    return after.join(earlier, "instance", "left").select("instance", grown.alias("requests"))


def counters_complete(
    before: DataFrame, delta: DataFrame, client_requests: Column | int, slack: int = 2
) -> DataFrame:
    """Whether no counter went down and the first total is within `slack` of the client's."""
    seen = before.agg(F.sum("requests").alias("n"))
    wanted = F.lit(client_requests) if isinstance(client_requests, int) else client_requests
    return delta.agg(
        F.sum("requests").alias("delta_total"),
        F.bool_and(F.col("requests") >= 0).alias("monotone"),
    ).withColumn("total_matches", F.abs(seen.scalar() - wanted) <= slack)


def replaced(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether every instance was replaced: the sets are disjoint and the second is not empty."""
    kept = before.select("instance").intersect(after.select("instance"))
    return after.select("instance").distinct().agg(
        F.count(F.lit(1)).alias("instances_after")
    ).withColumn(
        "instances_kept", kept.agg(F.count(F.lit(1)).alias("n")).scalar()
    ).withColumn(
        "every_instance_replaced",
        (F.col("instances_after") > 0) & (F.col("instances_kept") == 0),
    )


def failure_gate(phases: DataFrame, classes: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Failures over all classes per phase, and the list of classes that failed."""
    sums = phases.groupBy(*by).agg(*[F.sum(c).alias(c) for c in classes])
    total = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    violated = F.filter(
        F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in classes]), lambda x: x.isNotNull()
    )
    return sums.select(
        *by, total.alias("failed_total"), F.array_join(violated, ",").alias("problems")
    )


def release_gate(
    failures: DataFrame, rollout: DataFrame, replacement: DataFrame, counters: DataFrame, by: str
) -> DataFrame:
    """(check, holds, found): everything that a release under load must show.

    `failures` is `failure_gate`'s table, a check per phase; `rollout` one row (rollout_end_us,
    load_end_us); `replacement` and `counters` are the rows of `replaced` and
    `counters_complete`. What was not measured (a null) does not hold.
    """
    phases = failures.select(
        F.concat(F.lit("no failures in "), F.col(by)).alias("check"),
        (F.col("failed_total") == 0).alias("holds"),
        F.col("failed_total").cast("string").alias("found"),
    )
    margin = F.col("load_end_us") - F.col("rollout_end_us")
    ended = rollout.select(
        F.lit("rollout ended under load").alias("check"), (margin > 0).alias("holds"), margin.cast("string").alias("found")
    )
    new = replacement.select(
        F.lit("every instance replaced").alias("check"),
        F.col("every_instance_replaced").alias("holds"),
        F.col("instances_kept").cast("string").alias("found"),
    )
    whole = counters.select(
        F.lit("counters complete").alias("check"),
        (F.col("monotone") & F.col("total_matches")).alias("holds"),
        F.col("delta_total").cast("string").alias("found"),
    )
    rows = phases.unionByName(ended).unionByName(new).unionByName(whole)
    return rows.withColumn("holds", F.coalesce("holds", F.lit(False)))


def gate_passes(gate: DataFrame) -> DataFrame:
    """One row: whether all checks hold, and those that do not, by name."""
    failing = F.array_sort(F.collect_list(F.when(~F.col("holds"), F.col("check"))))
    return gate.agg(
        F.coalesce(F.bool_and("holds"), F.lit(False)).alias("passes"), F.array_join(failing, "; ").alias("problems")
    )
