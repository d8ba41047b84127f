from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskweave.operators.drift import drift_features, reference_stats
from riskweave.operators.velocity import entity_velocity
from riskweave.streaming import drift_windows, online_velocity, replay

START = datetime(2024, 1, 1)
SCHEMA = (
    "transaction_id string, timestamp timestamp, entity_id string, amount double,"
    "category string, is_fraud int"
)
WINDOWS = {"1min": 60_000_000, "1h": 3_600_000_000}


def batch(spark, entries, at=0):
    data = [
        (f"t{at + i:03d}", START + timedelta(seconds=s), e, a, "c", int(a > 50))
        for i, (s, e, a) in enumerate(entries)
    ]
    return spark.createDataFrame(data, SCHEMA)


def deliver(spark, folder, df):
    df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return replay.open_stream(spark, f"{folder}/in", df.schema)


def run_velocity(stream, folder, **kw):
    online_velocity.run_online_velocity(
        stream, f"{folder}/out", f"{folder}/state", f"{folder}/chk", WINDOWS, **kw
    ).awaitTermination()


def test_stream_features_equal_the_batch_operator(spark, tmp_path):
    entries = [(i * 20, "hot" if i % 3 else f"e{i % 2}", float(i)) for i in range(60)]
    for part in range(3):
        piece = batch(spark, entries[part * 20 : part * 20 + 20], part * 20)
        run_velocity(deliver(spark, str(tmp_path), piece), str(tmp_path))
    got = spark.read.parquet(f"{tmp_path}/out")
    want = entity_velocity(batch(spark, entries), WINDOWS)
    names = ["transaction_id", *[c for c in got.columns if c.startswith("f_ent_")]]
    assert set(names) == {"transaction_id", *[c for c in want.columns if c.startswith("f_ent_")]}
    assert rows(got, *names[:3]) == rows(want, *names[:3])
    assert got.select(names).exceptAll(want.select(names)).count() == 0


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    run_velocity(deliver(spark, str(tmp_path), batch(spark, [(100, "a", 1.0)])), str(tmp_path))
    late = batch(spark, [(50, "a", 2.0), (95, "a", 3.0), (120, "a", 4.0)], 10)
    run_velocity(
        deliver(spark, str(tmp_path), late), str(tmp_path), lateness_us=10_000_000
    )
    got = dict(rows(spark.read.parquet(f"{tmp_path}/out"), "transaction_id", "f_ent_count_1min"))
    assert got == {"t000": 0, "t011": 0, "t012": 2}


def test_a_batch_that_runs_again_leaves_the_same_files(spark, tmp_path):
    write = online_velocity.velocity_writer(f"{tmp_path}/out", f"{tmp_path}/state", WINDOWS)
    first, second = batch(spark, [(0, "a", 1.0)]), batch(spark, [(30, "a", 2.0)], 5)
    write(first, 0)
    write(second, 1)
    once = rows(spark.read.parquet(f"{tmp_path}/out"), "transaction_id", "f_ent_count_1min")
    write(second, 1)
    again = rows(spark.read.parquet(f"{tmp_path}/out"), "transaction_id", "f_ent_count_1min")
    assert once == again == [("t000", 0.0), ("t005", 1.0)]


def test_alerts_leave_out_legit_rows_and_survive_a_restart(spark, tmp_path):
    def scorer(df):
        return df.withColumn("p", F.col("amount") / 100)

    def run(df):
        replay.replay_alerts(
            deliver(spark, str(tmp_path), df), scorer, 0.8, f"{tmp_path}/out", f"{tmp_path}/chk"
        ).awaitTermination()

    run(batch(spark, [(0, "a", 95.0), (1, "a", 5.0), (2, "b", 60.0)]))
    run(batch(spark, [(3, "a", 99.0)], 10))
    found = replay.written_alerts(spark, f"{tmp_path}/out")
    got = rows(found, "transaction_id", "row_index", "decision", "true_is_fraud")
    assert got == [("t000", 0, "fraud", 1), ("t002", 2, "review", 1), ("t010", 3, "fraud", 1)]
    assert len(found.columns) == 10


def test_a_batch_of_alerts_that_runs_again_keeps_its_numbers(spark, tmp_path):
    def scorer(df):
        return df.withColumn("p", F.lit(0.9))

    write = replay.alert_writer(scorer, 0.5, str(tmp_path))
    parts = [batch(spark, [(s, "a", 60.0) for s in range(k * 10, k * 10 + 4)], k * 10) for k in range(3)]
    for n in (0, 1, 1, 0, 2):
        write(parts[n], n)
    got = rows(replay.written_alerts(spark, str(tmp_path)), "row_index", "transaction_id")
    ids = [r["transaction_id"] for p in parts for r in p.orderBy("timestamp").collect()]
    assert got == list(enumerate(ids))


def test_gaps_reach_back_beyond_all_windows(spark, tmp_path, monkeypatch):
    """Entities that come back after days, over batches that merge the latest times."""
    monkeypatch.setattr(online_velocity, "MERGE_EVERY", 2)
    day = 86_400
    entries = [(0, "a", 1.0), (5, "b", 2.0), (3 * day, "a", 3.0), (4 * day, "c", 1.0), (9 * day, "b", 2.0), (9 * day + 7, "a", 1.0)]
    write = online_velocity.velocity_writer(f"{tmp_path}/out", f"{tmp_path}/state", WINDOWS)
    whole = batch(spark, entries)
    for n in range(len(entries)):
        piece = whole.where(F.col("transaction_id") == f"t{n:03d}")
        write(piece, n)
        if n % 2:
            write(piece, n)  # runs again
    got = spark.read.parquet(f"{tmp_path}/out")
    name = "f_ent_seconds_since_prev"
    assert rows(got, "transaction_id", name) == rows(entity_velocity(whole, WINDOWS), "transaction_id", name)


def test_event_log_holds_no_feature_values(spark):
    df = batch(spark, [(0, "a", 95.0)]).withColumn("p", F.lit(0.95))
    assert set(replay.event_log(df, 0.5).columns) == set(replay.LOG_COLUMNS)
    assert rows(replay.decision_counts(replay.event_log(df, 0.5))) == [("fraud", 1)]


@pytest.fixture
def reference(spark):
    calm = batch(spark, [(i, "a", float(i % 50)) for i in range(500)])
    return reference_stats(calm, ["amount"])


def test_windows_are_judged_against_the_frozen_reference(spark, tmp_path, reference):
    day = 86_400
    entries = [(i, "a", float(i % 50)) for i in range(200)]
    entries += [(day + i, "a", 49.0) for i in range(100)]
    df = batch(spark, entries)

    def run(piece):
        drift_windows.run_window_drift(
            deliver(spark, str(tmp_path), piece), reference, ["amount"], "1 day", "2 days",
            0.1, 0.25, f"{tmp_path}/out", f"{tmp_path}/chk",
        ).awaitTermination()

    run(df.where("transaction_id < 't250'"))
    run(df.where("transaction_id >= 't250'"))
    got = drift_windows.latest_windows(spark.read.parquet(f"{tmp_path}/out"))
    found = {r["window_start"]: r for r in got.collect()}
    assert found[START]["status"] == "stable" and found[START]["n"] == 200
    second = found[START + timedelta(days=1)]
    assert second["status"] == "alert" and second["n"] == 100
    want = drift_features(
        reference, df.where("transaction_id >= 't200'"), 0.1, 0.25, ["amount"]
    ).first()["psi"]
    assert second["psi"] == pytest.approx(want)
