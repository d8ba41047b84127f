from datetime import datetime, timedelta

import pytest
from conftest import rows

from riskweave.operators import splits

START = datetime(2024, 1, 1)
SCHEMA = "transaction_id string, timestamp timestamp, entity_id string, is_fraud int"


def frame(spark, entries):
    data = [
        (f"t{i:03d}", START + timedelta(seconds=s), e, y) for i, (s, e, y) in enumerate(entries)
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_split_keeps_entities_whole_and_in_time_order(spark):
    df = frame(spark, [(i, f"e{(i * i) % 17}", 0) for i in range(200)])
    train, test = splits.temporal_grouped_split(df, 0.3)
    a = {r["entity_id"] for r in train.collect()}
    b = {r["entity_id"] for r in test.collect()}
    assert a and b and not a & b
    assert train.count() + test.count() == 200
    first = {r["entity_id"]: r["first_seen"] for r in splits.entity_first_seen(df).collect()}
    assert max(first[e] for e in a) <= min(first[e] for e in b)


def test_budget_counts_rows_before_an_entity(spark):
    # entity sizes 1, 3, 1 in first-seen order; half of 5 rows is 2.5
    df = frame(spark, [(0, "a", 0), (1, "b", 0), (2, "b", 0), (3, "b", 0), (4, "c", 0)])
    train, _ = splits.temporal_grouped_split(df, 0.5)
    assert {r["entity_id"] for r in train.collect()} == {"a", "b"}


def test_one_entity_with_a_third_of_all_rows(spark):
    df = frame(spark, [(i, "hot" if i % 3 == 0 else f"e{i}", 0) for i in range(300)])
    train, test = splits.temporal_grouped_split(df, 0.2)
    assert train.where("entity_id = 'hot'").count() == 100
    assert test.where("entity_id = 'hot'").count() == 0


def test_ties_at_the_cut_all_go_right(spark):
    df = frame(spark, [(s, f"e{i}", 0) for i, s in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 7, 9])])
    cut = splits.cut_timestamp(df, 0.8)
    left, right = splits.split_before(df, cut)
    assert cut == START + timedelta(seconds=7)
    assert (left.count(), right.count()) == (7, 3)


@pytest.mark.parametrize("fraction", [0.0, 1.0, -0.1, 1.5])
def test_fraction_must_be_inside(spark, fraction):
    with pytest.raises(ValueError):
        splits.cut_timestamps(frame(spark, [(0, "a", 0)]), [fraction])


def test_a_cut_needs_an_entity_beyond_it(spark):
    with pytest.raises(ValueError):
        splits.cut_timestamp(frame(spark, [(0, "a", 0), (1, "a", 0)]), 0.5)


def test_folds_tile_the_rows_after_the_first_cut(spark):
    df = frame(spark, [(i, f"e{i}", int(i % 4 == 0)) for i in range(100)])
    folds = splits.build_folds(df, (0.2, 0.4, 0.6, 0.8), 1)
    assert [f.index for f in folds] == [1, 2, 3, 4]
    assert all(a.end == b.cut for a, b in zip(folds, folds[1:])) and folds[-1].end is None
    counts = dict(rows(splits.assign_folds(df, folds).groupBy("fold").count().dropna()))
    assert counts == {1: 20, 2: 20, 3: 20, 4: 20}
    audit = splits.leakage_audit(df, folds).orderBy("fold").collect()
    assert [r["train_rows"] for r in audit] == [20, 40, 60, 80]
    assert all(r["straddling_rows"] == 0 and not r["train_seen_after_cut"] for r in audit)


def test_short_windows_merge_leftmost_first(spark):
    frauds = {25, 45, 46, 47, 65, 66, 67, 85, 86, 87}
    df = frame(spark, [(i, f"e{i}", int(i in frauds)) for i in range(100)])
    folds = splits.build_folds(df, (0.2, 0.4, 0.6, 0.8), 3)
    assert [f.merged_windows for f in folds] == [2, 1, 1]
    with pytest.raises(ValueError):
        splits.build_folds(df, (0.2, 0.4), 50)
    with pytest.raises(ValueError):
        splits.build_folds(df, (0.4, 0.2), 1)


def test_last_short_window_merges_to_the_left():
    at = [START + timedelta(days=i) for i in range(4)]
    merged = splits.merge_short_windows(
        [(at[0], at[1], 9), (at[1], at[2], 9), (at[2], None, 1)], 5
    )
    assert [(f.cut, f.end, f.merged_windows) for f in merged] == [
        (at[0], at[1], 1),
        (at[1], None, 2),
    ]


def test_audit_sees_a_straddling_entity(spark):
    # folds that were built for other rows
    df = frame(spark, [(0, "a", 0), (10, "b", 1)])
    fold = splits.Fold(1, START, None, 1)
    audit = splits.leakage_audit(df, [fold]).first()
    assert audit["train_rows"] == 0 and audit["test_rows"] == 2


def test_boundary_is_measured(spark):
    train = frame(spark, [(0, "a", 0), (5, "a", 0), (9, "a", 0)])
    test = frame(spark, [(5, "b", 0), (5, "c", 0), (7, "b", 0)])
    got = splits.split_boundary(train, test).first()
    assert not got["ordered"]
    assert (got["train_rows_later"], got["train_rows_at_boundary"]) == (1, 1)
    assert got["test_rows_at_boundary"] == 2


def test_moved_rows_show_up(spark):
    a = spark.createDataFrame([("1", "train"), ("2", "test")], "transaction_id string, side string")
    b = spark.createDataFrame([("1", "train"), ("2", "train")], "transaction_id string, side string")
    assert splits.rows_moved(a, a).count() == 0
    assert splits.rows_moved(a, b).count() == 2
