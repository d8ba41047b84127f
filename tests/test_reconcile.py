import json

import pytest
from conftest import rows

from riskweave.operators import reconcile


def docs(spark, *bodies):
    return spark.createDataFrame(
        [(i, json.dumps(b)) for i, b in enumerate(bodies)], "id int, doc string"
    )


def diff(spark, old, new, **kw):
    got = reconcile.json_differences(docs(spark, old), docs(spark, new), "id", "doc", **kw)
    return rows(got, "path", "state")


def test_equal_documents(spark):
    body = {"a": [1, {"b": None}], "c": {}, "d": "x"}
    assert diff(spark, body, body) == []
    assert diff(spark, {"a": 1, "b": 2}, {"b": 2, "a": 1.0}) == []


def test_paths_of_differences(spark):
    old = {"a": 1, "b": {"c": [1, 2]}, "gone": True}
    new = {"a": 2, "b": {"c": [1, 3]}, "fresh": None}
    assert diff(spark, old, new) == [
        ("/a", "differs"), ("/b/c[1]", "differs"), ("/fresh", "right_only"), ("/gone", "left_only"),
    ]


def test_ignored_keys_and_paths(spark):
    old = {"at": 1, "x": {"at": {"deep": 1}, "y": 1}, "env": {"v": 1}, "fat": 3}
    new = {"at": 2, "x": {"at": {"deep": 2}, "y": 1}, "env": {"v": 2}, "fat": 4}
    got = diff(spark, old, new, ignored_keys=["at"], ignored_paths=["/env"])
    assert got == [("/fat", "differs")]


def test_contract_tolerates_defaults_one_way(spark):
    wanted = {"cpu": "1", "port": None, "probe": None}
    found = {"cpu": "1", "port": 0, "extra": [], "flag": False}
    same = reconcile.contract_differences(docs(spark, wanted), docs(spark, found), "id", "doc")
    assert same.count() == 0
    found = {"cpu": "2", "port": 8080, "extra": "on"}
    bad = reconcile.contract_differences(docs(spark, wanted), docs(spark, found), "id", "doc")
    assert [p for p, in rows(bad, "path")] == ["/cpu", "/extra", "/port"]
    lost = reconcile.contract_differences(docs(spark, {"cpu": "1"}), docs(spark, {}), "id", "doc")
    assert lost.count() >= 1


def test_tolerance_and_missing_metrics(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", None)], "k string, value double")
    b = spark.createDataFrame([("x", 1.004), ("y", 2.5), ("z", None), ("w", 1.0)], "k string, value double")
    got = reconcile.metric_mismatches(a, b, ["k"], tolerance=0.01)
    assert rows(got, "k", "state") == [("w", "right_only"), ("y", "differs")]
    exact = reconcile.metric_mismatches(a, b, ["k"])
    assert [k for k, _ in rows(exact, "k", "state")] == ["w", "x", "y"]


def test_guard_raises_on_differing_counts(spark):
    a = spark.createDataFrame([(0.5, 1, None), (0.9, 2, 3)], "t double, n int, m int")
    b = spark.createDataFrame([(0.5, 1, None), (0.9, 2, 4), (0.99, 7, 7)], "t double, n int, m int")
    reconcile.require_equal(reconcile.count_mismatches(a, a, "t", ["n", "m"]), "same")
    with pytest.raises(reconcile.MismatchError, match="curve"):
        reconcile.require_equal(reconcile.count_mismatches(a, b, "t", ["n", "m"]), "curve")


def test_agreement_of_two_flaggers(spark):
    a = spark.createDataFrame([("x",), ("y",)], "f string")
    b = spark.createDataFrame([("y",), ("z",), ("w",)], "f string")
    assert tuple(reconcile.flag_agreement(a, b, "f").first()) == (1, 1, 2)
    assert rows(reconcile.agreement_rows(a, b, "f")) == [
        ("w", "right_only"), ("x", "left_only"), ("y", "both"), ("z", "right_only"),
    ]
