import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskweave.operators import velocity

START = datetime(2024, 1, 1)
SCHEMA = "transaction_id string, timestamp timestamp, entity_id string, amount double"


def frame(spark, entries):
    data = [
        (f"t{i:04d}", START + timedelta(seconds=s), e, a) for i, (s, e, a) in enumerate(entries)
    ]
    return spark.createDataFrame(data, SCHEMA)


def column(df, name):
    return [r[name] for r in df.orderBy("transaction_id").collect()]


def test_window_is_open_at_the_row_and_closed_at_its_start(spark):
    df = frame(spark, [(0, "a", 10.0), (30, "a", 30.0), (120, "a", 40.0)])
    out = velocity.stream_velocity(df, {"1min": 60_000_000})
    assert column(out, "f_vel_count_1min") == [0, 1, 0]
    assert column(out, "f_vel_amt_sum_1min") == [0, 10, 0]
    assert column(out, "f_vel_amt_mean_1min") == [None, 10, None]
    assert column(out, "f_vel_amt_ratio_1min") == [None, 3, None]
    assert column(out, "f_vel_seconds_since_prev") == [None, 30, 90]


def test_a_row_exactly_one_window_back_counts(spark):
    df = frame(spark, [(0, "a", 5.0), (60, "a", 7.0)])
    assert column(velocity.stream_velocity(df, {"w": 60_000_000}), "f_vel_count_w") == [0, 1]


def test_rows_at_the_same_time_do_not_see_each_other(spark):
    out = velocity.stream_velocity(frame(spark, [(5, "a", 1.0), (5, "b", 2.0)]))
    assert column(out, "f_vel_count_24h") == [0, 0]
    assert column(out, "f_vel_seconds_since_prev") == [None, 0]


def test_entities_are_apart(spark):
    df = frame(spark, [(0, "e1", 1.0), (10, "e2", 2.0), (20, "e1", 3.0)])
    assert column(velocity.stream_velocity(df), "f_vel_count_1h") == [0, 1, 2]
    assert column(velocity.entity_velocity(df), "f_ent_count_1h") == [0, 0, 1]
    assert column(velocity.entity_velocity(df), "f_ent_seconds_since_prev") == [None, None, 20]


def test_entity_columns_need_repeating_entities(spark):
    alone = velocity.add_velocity(frame(spark, [(0, "a", 1.0), (9, "b", 1.0)]))
    assert not [c for c in alone.columns if c.startswith("f_ent_")]
    again = velocity.add_velocity(frame(spark, [(0, "a", 1.0), (9, "a", 1.0)]))
    assert len(velocity.velocity_columns(again)) == 34


def brute(entries, i, width, by_entity):
    s, e, a = entries[i]
    past = [
        x[2]
        for x in entries
        if s - width <= x[0] < s and (not by_entity or x[1] == e) and x[2] is not None
    ]
    return len(past), sum(past)


@pytest.mark.parametrize("by_entity", [False, True])
def test_against_brute_force_with_a_burst_and_missing_amounts(spark, by_entity):
    rng = random.Random(3)
    entries = []
    for i in range(400):
        burst = i % 3 == 0
        second = rng.choice([100, 101, 102]) if burst else rng.randrange(4000)
        amount = None if i % 17 == 0 else round(rng.uniform(1, 90), 2)
        entries.append((second, "hot" if burst else f"e{rng.randrange(12)}", amount))
    df = frame(spark, entries)
    fn, prefix = (
        (velocity.entity_velocity, "f_ent_")
        if by_entity
        else (velocity.stream_velocity, "f_vel_")
    )
    out = fn(df, {"1min": 60_000_000, "10min": 600_000_000}).orderBy("transaction_id").collect()
    for i, row in enumerate(out):
        for label, width in (("1min", 60), ("10min", 600)):
            n, total = brute(entries, i, width, by_entity)
            assert row[f"{prefix}count_{label}"] == n
            assert math.isclose(row[f"{prefix}amt_sum_{label}"], total, abs_tol=1e-6)


def test_long_entities_go_by_the_scan_and_others_in_tasks(spark, monkeypatch):
    """Both ways, and both at once, give the same rows; amounts of any size and sign."""
    rng = random.Random(5)
    odd = [None, 0.0, -3.25, 1e12, 9e13, -9e13, 0.1, 1e-6]
    entries = [
        (rng.randrange(300) / 8, "hot" if i % 2 else f"e{rng.randrange(6)}", rng.choice(odd))
        for i in range(300)
    ]
    entries += [(rng.choice([1e8, -1e9]), "hot", 5.5), (3, None, 2.0), (4, None, 3.0)]
    df = frame(spark, entries)
    windows = {"1s": 1_000_000, "10s": 10_000_000, "9000d": 777_600_000_000_000}
    want = None
    for most in (0, 20, 1 << 18):
        monkeypatch.setattr(velocity, "POINTS_AT_ONCE", most or 1)
        got = sorted(map(repr, velocity.entity_velocity(df, windows).collect()))
        want = want or got
        assert len(got) == len(entries) and got == want


def test_short_entities_write_one_row_per_time_point(spark, monkeypatch):
    """No shifted copies, one for every window, where an entity fits into a task."""

    def never(*a, **k):
        raise AssertionError("scanned")

    monkeypatch.setattr(velocity, "scan", never)
    df = frame(spark, [(0, "a", 1.0), (30, "a", 2.0), (30, "b", 4.0), (30, "a", 8.0), (90, "a", 16.0)])
    out = velocity.entity_velocity(df, {"1min": 60_000_000, "1h": 3_600_000_000})
    assert column(out, "f_ent_count_1min") == [0, 1, 0, 1, 2]
    assert column(out, "f_ent_amt_sum_1h") == [0, 1, 0, 1, 11]
    assert column(out, "f_ent_seconds_since_prev") == [None, 30, None, 0, 60]
    assert not velocity.entity_velocity(df.limit(0)).count()


def test_rows_without_a_time_change_no_windows(spark):
    entries = [(0, "a", 1.0), (30, "a", 2.0), (40, "b", 4.0), (90, "b", 8.0)]
    df = frame(spark, entries)
    lost = df.where("transaction_id = 't0003'").withColumn("timestamp", F.lit(None).cast("timestamp"))
    with_lost = velocity.entity_velocity(df.unionByName(lost)).drop("f_ent_seconds_since_prev")
    plain = velocity.entity_velocity(df).drop("f_ent_seconds_since_prev")
    assert sorted(map(repr, with_lost.collect())) == sorted(map(repr, plain.collect()))


def test_later_rows_never_change_earlier_features(spark):
    entries = [(i * 7, f"e{i % 3}", float(i)) for i in range(60)]
    full = column(velocity.entity_velocity(frame(spark, entries)), "f_ent_amt_sum_5min")
    half = column(velocity.entity_velocity(frame(spark, entries[:30])), "f_ent_amt_sum_5min")
    assert full[:30] == half


def test_daily_running_count(spark):
    day = 86_400
    df = frame(spark, [(0, "a", 1.0), (5, "a", 1.0), (5, "b", 1.0), (day + 1, "a", 1.0)])
    out = velocity.daily_running_count(df)
    assert column(out, "entity_daily_tx_count") == [0, 1, 0, 0]


def test_degenerate_columns_look_at_every_slice(spark):
    one = spark.createDataFrame([(1.0, 2.0, None), (1.0, 3.0, None)], "a double, b double, c double")
    two = spark.createDataFrame([(1.0, 2.0, 1.0), (4.0, 2.0, 2.0)], "a double, b double, c double")
    found = {r[0] for r in velocity.degenerate_columns([one, two], ["a", "b", "c"]).collect()}
    assert found == {"a", "b", "c"}
    assert not velocity.degenerate_columns([two], ["a"]).collect()
