import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskweave.catalog import QUERIES
from riskweave.operators import requests


def levels(spark, data):
    full = [("r", *row) for row in data]
    return spark.createDataFrame(
        full, "run string, concurrency int, req_per_s double, p50_ms double, p99_ms double, errors int"
    )


def test_knee_is_the_first_level_without_gain(spark):
    df = levels(spark, [(1, 100.0, 1.0, 2.0, 0), (2, 190.0, 1.0, 3.0, 0), (4, 205.0, 1.0, 9.0, 0),
                        (8, 400.0, 1.0, 20.0, 0)])
    got = requests.throughput_knee(df, ["run"]).first()
    assert got["knee_concurrency"] == 2 and math.isclose(got["next_level_gain"], 205 / 190)


def test_idle_levels_and_steady_growth_have_no_knee(spark):
    df = levels(spark, [(1, 0.0, None, None, 5), (2, 100.0, 1.0, 1.0, 0), (4, 200.0, 1.0, 1.0, 0)])
    assert requests.throughput_knee(df, ["run"]).count() == 0


def test_best_level_needs_the_budget_and_no_errors(spark):
    df = levels(spark, [(1, 100.0, 1.0, 5.0, 0), (2, 190.0, 2.0, 9.0, 1), (4, 205.0, 3.0, 30.0, 0)])
    got = requests.run_summary(df, ["run"]).first()
    assert (got["peak_concurrency"], got["best_concurrency"], got["total_errors"]) == (4, 1, 1)
    slow = levels(spark, [(1, 100.0, 1.0, 50.0, 0)])
    assert requests.run_summary(slow, ["run"]).first()["best_concurrency"] is None


def test_only_requests_inside_the_window_count(spark):
    data = [(0, 1.0, 200), (10_000, 2.0, 200), (20_000, 4.0, 500), (29_500, 1.0, 200)]
    df = spark.createDataFrame(
        [("r", *d) for d in data], "run string, start_us long, latency_ms double, status int"
    )
    got = requests.level_summary(df, ["run"], F.lit(5_000), F.lit(30_000)).first()
    assert (got["requests"], got["ok"], got["errors"]) == (2, 1, 1)
    assert got["error_rate"] == 0.5 and math.isclose(got["req_per_s"], 1 / 0.025)
    assert got["p50_ms"] == 2.0 and got["max_ms"] == 2.0


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0, 1.0, 3.0], [1.0, 1.0, 4.0, 9.0]])
def test_true_and_upper_median(spark, values):
    import statistics

    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    got = requests.spread(df, "v", ["k"]).first()
    assert got["low"] == min(values) and got["high"] == max(values)
    assert got["median"] == statistics.median(values)
    assert got["upper_median"] == sorted(values)[len(values) // 2]


def test_arm_ratios(spark):
    data = [("a", s, 10.0, 0) for s in (100.0, 120.0, 110.0)]
    data += [("b", s, 30.0, 1) for s in (50.0, 55.0, 40.0)]
    df = spark.createDataFrame(
        [("x", *d) for d in data], "k string, arm string, req_per_s double, p99_ms double, errors int"
    )
    got = requests.arm_comparison(df, ["k"], "a", "b").first()
    assert got["median_ratio"] == 110 / 50 and got["worst_case_ratio"] == 100 / 55
    assert (got["shipped_runs"], got["before_errors"]) == (3, 3)


def test_stack_shares_may_overlap(spark):
    lines = ["main;score;fit 6", "main;json 3", "main;score;json 1", "broken line", "x notanumber"]
    df = spark.createDataFrame([(t,) for t in lines], "value string")
    stacks = requests.parse_stacks(df)
    got = dict(rows(requests.stack_shares(stacks, {"score": "score", "json": "json", "no": "zzz"}),
                    "bucket", "share_percent"))
    assert got == {"score": 70.0, "json": 40.0, "no": 0.0}
    top = requests.top_leaf_frames(stacks, 1).first()
    assert (top["frame"], top["samples"]) == ("fit", 6)


def test_bucket_windows_count_full_buckets_only(spark):
    df = spark.createDataFrame(
        [(0, 100, 0), (10, 110, 1), (20, 120, 0), (30, 50, 0)], "offset_s int, requests int, failed int"
    ).withColumn("run", F.lit("r"))
    got = {
        r["window"]: r
        for r in requests.bucket_windows(
            df, [("all", None, None), ("mid", 1005.0, 1030.0), ("none", 5000.0, None)],
            ["run"], F.lit(1000), F.lit(10), F.lit(35),
        ).collect()
    }
    assert (got["all"]["full_buckets"], got["all"]["requests"]) == (3, 330)
    assert (got["mid"]["full_buckets"], got["mid"]["requests"], got["mid"]["failed"]) == (2, 230, 1)
    assert got["mid"]["req_per_s"] == 11.5
    assert got["none"]["full_buckets"] == 0 and got["none"]["req_per_s"] is None


def test_instance_spread(spark):
    df = spark.createDataFrame(
        [("r", "a", 1000), ("r", "b", 900), ("r", "c", 30), ("r", "d", 0)],
        "run string, instance string, requests long",
    )
    got = requests.instance_spread(df, ["run"]).first()
    assert (got["serving"], got["running"], got["total"]) == (2, 4, 1930)


def test_replica_timeline(spark):
    data = [(0, 2, 2, 50), (5, 2, 5, 390), (10, 3, 5, 300), (15, 5, 5, 200), (20, 5, 4, None)]
    df = spark.createDataFrame(
        [("r", *d) for d in data], "run string, t int, current int, desired int, cpu_percent int"
    )
    got = requests.replica_timeline(df, ["run"]).first()
    assert (got["replicas_min"], got["replicas_max"], got["cpu_percent_max"]) == (2, 5, 390)
    assert (got["desired_max_first_seen"], got["current_max_first_seen"]) == (5, 15)


def test_failures_leave_out_invalid_runs(spark):
    data = [("off", 4, 100, True), ("off", 0, 100, True), ("off", 9, 100, False), ("on", 0, 90, True)]
    df = spark.createDataFrame(data, "arm string, failed int, requests int, valid boolean")
    got = {r["arm"]: r for r in requests.failures_by_arm(df).collect()}
    assert (got["off"]["valid_runs"], got["off"]["runs_with_failure"]) == (2, 1)
    assert got["off"]["failed_total"] == 4 and got["on"]["requests_total"] == 90
    assert requests.failure_test(requests.failures_by_arm(df), "off", "on").first()[
        "p_value"
    ] == pytest.approx(2 / 3)


def test_counters_and_replacement(spark):
    schema = "instance string, requests long"
    before = spark.createDataFrame([("a", 10), ("b", 20)], schema)
    after = spark.createDataFrame([("a", 15), ("b", 18), ("c", 7)], schema)
    delta = requests.counter_delta(before, after)
    assert rows(delta) == [("a", 5), ("b", -2), ("c", 7)]
    check = requests.counters_complete(before, delta, 31).first()
    assert not check["monotone"] and check["total_matches"]
    assert not requests.replaced(before, after).first()["every_instance_replaced"]
    fresh = spark.createDataFrame([("x", 1)], schema)
    assert requests.replaced(before, fresh).first()["every_instance_replaced"]
    none = spark.createDataFrame([], schema)
    assert not requests.replaced(before, none).first()["every_instance_replaced"]


def test_gate_lists_violations(spark):
    df = spark.createDataFrame(
        [("steady", 0, 0, 0), ("restart", 2, 0, 1)], "phase string, a int, b int, c int"
    )
    got = {r["phase"]: r for r in requests.failure_gate(df, ["a", "b", "c"], ["phase"]).collect()}
    assert (got["steady"]["failed_total"], got["steady"]["problems"]) == (0, "")
    assert (got["restart"]["failed_total"], got["restart"]["problems"]) == (3, "a,c")


def test_release_gate_names_what_does_not_hold(spark):
    failures = spark.createDataFrame([("steady", 0), ("rollout", 3)], "phase string, failed_total long")
    rollout = spark.createDataFrame([(5, 9)], "rollout_end_us long, load_end_us long")
    new = spark.createDataFrame([(2, 0, True)], "instances_after long, instances_kept long, every_instance_replaced boolean")
    counted = spark.createDataFrame([(10, True, None)], "delta_total long, monotone boolean, total_matches boolean")
    gate = requests.release_gate(failures, rollout, new, counted, "phase")
    assert {r["check"]: r["holds"] for r in gate.collect()} == {
        "no failures in steady": True, "no failures in rollout": False, "rollout ended under load": True,
        "every instance replaced": True, "counters complete": False,
    }
    assert tuple(requests.gate_passes(gate).first()) == (False, "counters complete; no failures in rollout")
    late = spark.createDataFrame([(9, 9)], "rollout_end_us long, load_end_us long")
    again = requests.release_gate(failures, late, new, counted, "phase")
    assert "rollout ended under load" in requests.gate_passes(again).first()["problems"]


def events_from(spark, folder, first_day):
    """An event of each run per half hour, over five days."""
    ts = F.timestamp_add("minute", F.col("id") * 10, F.lit(first_day).cast("timestamp_ntz"))
    spark.range(5 * 144).select(
        F.col("id").alias("event_id"), ts.alias("ts"), F.lit(7).cast("long").alias("user_id"), F.lit("view").alias("event_type"),
        F.lit(5.0).alias("value"), F.lit('{"k": 1}').alias("props"),
    ).write.parquet(f"{folder}/events.parquet")


def test_bucket_windows_are_points_in_time(spark, tmp_path):
    """Windows lie where they lie, whenever the first request was."""
    events_from(spark, str(tmp_path), "2024-01-05")
    windows = {
        (r["run"], r["window"]): r["full_buckets"]
        for r in QUERIES["l5_bucket_windows"](spark, str(tmp_path)).collect()
    }
    # the 5th lies in the middle window; from the 9th to the last full hour in the late one
    assert {windows[f"run{i}", "early"] or 0 for i in range(3)} == {0}
    assert {windows[f"run{i}", "middle"] for i in range(3)} == {24}
    assert {windows[f"run{i}", "late"] for i in range(3)} == {23}
    held = QUERIES["j5_contained_buckets"](spark, str(tmp_path)).collect()
    assert {(r["full_buckets"], r["requests"]) for r in held} == {(96, 192)}
