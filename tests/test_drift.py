import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import drift

NONE = None


@pytest.fixture(scope="module")
def reference(spark):
    rng = np.random.default_rng(0)
    values = rng.lognormal(3, 1, 2000)
    data = [(float(v), i % 24, None) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "amount double, hour int, empty double")
    return values, df, drift.reference_stats(df, ["amount", "hour", "empty"])


def report(spark, reference, rows, columns=("amount",), schema="amount double"):
    window = spark.createDataFrame(rows, schema)
    got = drift.drift_features(reference[2], window, 0.1, 0.25, ["amount", "hour"])
    return {r["feature"]: r for r in got.collect()}


def test_reference_has_decile_edges_and_no_empty_feature(reference):
    values, _, stats = reference
    got = {r["feature"]: r for r in stats.collect()}
    assert set(got) == {"amount", "hour"}
    want = np.quantile(values, np.linspace(0, 1, 11)[1:-1])
    assert np.allclose(got["amount"]["inner_edges"], want)
    assert np.allclose(got["amount"]["proportions"], 0.1, atol=0.001)
    assert got["amount"]["n_reference"] == 2000


def test_same_rows_have_no_drift(spark, reference):
    rows = [(float(v),) for v in reference[0]]
    got = report(spark, reference, rows)
    assert got["amount"]["psi"] == pytest.approx(0, abs=1e-12)
    assert got["amount"]["status"] == "stable"
    assert got["hour"]["status"] == "missing_from_window"


def test_out_of_range_values_alert(spark, reference):
    got = report(spark, reference, [(1e9,)] * 500)
    assert got["amount"]["status"] == "alert"


def test_missing_values_are_reported_not_binned(spark, reference):
    got = report(spark, reference, [(None,)] * 400 + [(50.0,)] * 100)
    assert got["amount"]["null_fraction"] == 0.8
    got = report(spark, reference, [(None,)] * 3)
    assert got["amount"]["status"] == "all_null_in_window" and got["amount"]["psi"] is None
    got = report(spark, reference, [(float("nan"),)] * 3)
    assert got["amount"]["null_fraction"] == 1.0


def test_value_on_an_edge_goes_right(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double")
    edges = F.array(F.lit(1.0), F.lit(2.0))
    assert sorted(r[0] for r in df.select(drift.bin_of(F.col("v"), edges)).collect()) == [1, 2, 2]


def test_summary_names_the_worst(spark, reference):
    window = spark.createDataFrame(
        [(1e9, 0)] * 50 + [(1e9, 12)] * 50, "amount double, hour int"
    )
    rows = drift.drift_features(reference[2], window, 0.1, 0.25, ["amount", "hour"])
    got = drift.drift_summary(rows).first()
    assert got["n_alerts"] == 2 and got["n_features"] == 2
    assert got["worst_psi"] == max(r["psi"] for r in rows.collect())


def test_wasserstein_by_hand(spark):
    a = spark.createDataFrame([(0.0,), (1.0,), (3.0,)], "v double")
    b = spark.createDataFrame([(5.0,), (6.0,), (8.0,)], "v double")
    got = drift.wasserstein(a, b, ["v"]).first()["score"]
    assert math.isclose(got, 5 / np.std([0, 1, 3]))
    assert drift.wasserstein(a, a, ["v"]).first()["score"] == 0


def test_jensen_shannon_ends(spark):
    a = spark.createDataFrame([(0.0,), (0.0,)], "v double")
    b = spark.createDataFrame([(1.0,)], "v double")
    assert math.isclose(drift.jensen_shannon(a, b, ["v"]).first()["score"], math.sqrt(math.log(2)))
    assert drift.jensen_shannon(a, a, ["v"]).first()["score"] == 0


def test_a_column_known_on_one_side_only(spark):
    a = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    b = spark.createDataFrame([(None,)], "v double")
    assert drift.wasserstein(a, b, ["v"]).first()["score"] is None


def test_methods_follow_cardinality(spark):
    a = spark.createDataFrame([(float(i), i % 3) for i in range(60)], "v double, c int")
    b = spark.createDataFrame([(float(i) + 100, i % 3) for i in range(60)], "v double, c int")
    table = drift.distance_drift(a, b, ["v", "c"])
    got = {r["feature"]: (r["method"], r["drifted"]) for r in table.collect()}
    assert got == {"v": ("wasserstein", True), "c": ("jensen_shannon", False)}
    whole = drift.dataset_drift(table).first()
    assert whole["drifted_share"] == 0.5 and whole["dataset_drift"]
