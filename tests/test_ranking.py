import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskweave.operators import ranking, rolling


def frame(spark, p, y):
    data = [(f"t{i:04d}", int(b), float(a)) for i, (a, b) in enumerate(zip(p, y))]
    return spark.createDataFrame(data, "transaction_id string, y int, p double")


def brute_ap(p, y):
    total, out, seen, hit = sum(y), 0.0, 0, 0
    for score in sorted(set(p), reverse=True):
        at = [b for a, b in zip(p, y) if a == score]
        seen, hit = seen + len(at), hit + sum(at)
        out += sum(at) / total * hit / seen
    return out


def test_hand_worked_average_precision(scored):
    got = ranking.average_precision(scored).first()[0]
    assert math.isclose(got, (1 + 2 / 3 + 3 / 4 + 4 / 6) / 4)


def test_ties_and_a_hot_score(spark):
    rng = random.Random(2)
    p = [0.2 if i % 3 == 0 else round(rng.random(), 2) for i in range(600)]
    y = [int(rng.random() < a * 0.5) for a in p]
    got = ranking.ranking_metrics(ranking.score_groups(frame(spark, p, y))).first()
    pairs = [(a, b) for a, q in zip(p, y) if q for b, r in zip(p, y) if not r]
    auc = sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)
    assert math.isclose(got["average_precision"], brute_ap(p, y))
    assert math.isclose(got["roc_auc"], auc)


def test_no_positive_leaves_it_undefined(spark):
    got = ranking.ranking_metrics(ranking.score_groups(frame(spark, [0.1, 0.2], [0, 0]))).first()
    assert got["average_precision"] is None and got["roc_auc"] is None


def test_calibration_error_by_hand(spark):
    df = frame(spark, [0.1, 0.3, 0.6, 0.8], [0, 0, 1, 1])
    assert math.isclose(ranking.calibration_error(df, 2).first()[0], 0.25)


@pytest.mark.parametrize("bins", [2, 7, 10])
def test_calibration_error_against_array_split(spark, bins):
    rng = np.random.default_rng(4)
    p = np.round(rng.random(333), 2)
    y = (rng.random(333) < p).astype(int)
    order = np.argsort(p, kind="mergesort")
    want = sum(abs(p[i].sum() - y[i].sum()) for i in np.array_split(order, bins)) / 333
    assert math.isclose(ranking.calibration_error(frame(spark, p, y), bins).first()[0], want)


def test_weighted_cells_equal_repeated_rows(spark):
    rng = np.random.default_rng(9)
    p, y, w = np.round(rng.random(60), 1), rng.integers(0, 2, 60), rng.integers(0, 5, 60)
    cells = spark.createDataFrame(
        [(float(a), int(b), int(c)) for a, b, c in zip(p, y, w)], "p double, y int, w long"
    ).groupBy("p", "y").agg(F.sum("w").alias("w"))
    got = ranking.weighted_calibration_error(cells, 6).first()[0]
    rep = sorted((a, b) for a, b, c in zip(p, y, w) for _ in range(c))
    ps, ys = np.array([r[0] for r in rep]), np.array([r[1] for r in rep])
    parts = np.array_split(np.arange(len(rep)), 6)
    want = sum(abs(ps[i].sum() - ys[i].sum()) for i in parts) / len(rep)
    assert math.isclose(got, want)


def test_reliability_puts_an_edge_in_the_bin_below(spark):
    df = frame(spark, [0.0, 0.5, 1.0], [0, 1, 1])
    got = rows(ranking.reliability_curve(df, 2), "bin", "n", "mean_predicted", "observed_rate")
    assert got == [(0, 2, 0.25, 0.5), (1, 1, 1.0, 1.0)]


def test_pointwise_metrics(scored):
    got = ranking.pointwise_metrics(scored).first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (2, 1, 2, 1)
    assert got["accuracy"] == 0.5 and got["always_negative_accuracy"] == 2 / 6
    assert got["f1"] == 4 / 7 and got["fpr"] == 0.5 and got["fnr"] == 0.5
    assert math.isclose(got["expected_positives"], 2.95)


def test_pool_and_folds_in_one_pass(spark):
    rng = np.random.default_rng(1)
    data = [
        (f"t{i}", int(i % 2) + 1, int(rng.random() < 0.4), round(float(rng.random()), 2))
        for i in range(200)
    ]
    df = spark.createDataFrame(data, "transaction_id string, fold int, y int, p double")
    got = {r["fold"]: r for r in rolling.fold_metrics(df).collect()}
    for fold in (1, 2):
        part = [(r[3], r[2]) for r in data if r[1] == fold]
        assert math.isclose(got[fold]["average_precision"], brute_ap(*zip(*part)))
    assert math.isclose(got[0]["average_precision"], brute_ap(*zip(*[(r[3], r[2]) for r in data])))
    values = [got[1]["average_precision"], got[2]["average_precision"]]
    assert (got[0]["fold_min"], got[0]["fold_max"]) == (min(values), max(values))
    assert got[0]["n_rows"] == 200


def test_threshold_table(scored):
    got = {r["threshold"]: r for r in rolling.threshold_metrics(scored, (0.5, 0.95)).collect()}
    assert (got[0.5]["n_flagged"], got[0.5]["frauds_flagged"], got[0.5]["sent_to_review"]) == (3, 2, 0)
    assert (got[0.95]["n_flagged"], got[0.95]["sent_to_review"]) == (1, 4)
    assert got[0.95]["frauds_cleared_unseen"] == 1
    assert got[0.5]["recall_lower"] < 0.5 < got[0.5]["recall_upper"]
