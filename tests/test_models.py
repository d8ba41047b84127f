import math
from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskweave.functions.features import class_weights, missing_inputs
from riskweave.models import attribution, calibrate, detector, grid, registry
from riskweave.operators.drift import reference_stats
from riskweave.operators.ranking import average_precision
from riskweave.options import Options
from riskweave.plans import business, rolling_report, training

SCHEMA = (
    "transaction_id string, timestamp timestamp, entity_id string, amount double,"
    "category string, is_fraud int, f_a double, f_b double"
)


@pytest.fixture(scope="module")
def tx(spark):
    """Rows where f_a carries the signal, with gaps in f_b."""
    rng = np.random.default_rng(7)
    data = []
    for i in range(600):
        a = float(rng.normal())
        fraud = int(rng.random() < 1 / (1 + math.exp(-(2 * a - 1))))
        data.append((
            f"t{i:04d}", datetime(2024, 1, 1) + timedelta(minutes=13 * i), f"e{i // 3}",
            float(rng.integers(1, 500)), f"c{i % 3}", fraud, a,
            None if i % 5 == 0 else float(rng.normal()),
        ))
    return spark.createDataFrame(data, SCHEMA).persist()


@pytest.fixture(scope="module")
def linear(tx):
    return detector.fit(tx, "logreg")


def test_weights_balance_the_classes(spark):
    df = spark.createDataFrame([(0,)] * 9 + [(1,)] * 3, "is_fraud int")
    assert rows(class_weights(df)) == [(0, 12 / 18), (1, 2.0)]


def test_registry_refuses_taken_and_unknown_names():
    with pytest.raises(ValueError):
        registry.register("gbt")(lambda *a: None)
    with pytest.raises(ValueError):
        registry.create("nothing", 1, 1, 0.1)
    assert {"gbt", "gbt_deep", "gbt_shallow", "forest", "logreg"} <= set(registry.available())

    @registry.register("mine")
    def _mine(seed, rounds, rate):
        return registry.create("logreg", seed, rounds, rate)

    assert "mine" in registry.available()


def test_the_signal_is_found(tx, linear):
    scored = detector.scored_table(linear, tx)
    assert average_precision(scored).first()[0] > 0.6
    assert scored.count() == 600


def test_unseen_category_and_absent_columns_score(tx, linear):
    odd = tx.withColumn("category", F.lit("new")).drop("f_b")
    scored = detector.score(linear, odd)
    assert scored.where(F.col("p").between(0, 1)).count() == 600
    assert "f_b" not in scored.columns


def test_missing_inputs_are_listed(tx, linear):
    names = list(detector.expected_inputs(linear))
    assert set(names) == {"amount", "f_a", "f_b", "category"}
    got = tx.drop("f_a").select(missing_inputs(tx.drop("f_a"), names).alias("m"))
    assert {tuple(sorted(r["m"])) for r in got.collect()} == {("f_a",), ("f_a", "f_b")}


def test_a_column_without_values_is_left_out(tx):
    model = detector.fit(tx.withColumn("f_none", F.lit(None).cast("double")), "logreg")
    assert "f_none" not in detector.expected_inputs(model)


def test_decisions_add_up(tx, linear):
    got = detector.score_and_decide(linear, tx, 0.8)
    for r in got.collect():
        assert r["confidence"] == max(r["p"], 1 - r["p"])
        assert (r["decision"] == "review") == (r["confidence"] < 0.8)


def test_saved_bundle_scores_alike(spark, tx, linear, tmp_path):
    reference = reference_stats(tx, ["amount", "f_a"])
    detector.save_bundle(linear, reference, str(tmp_path))
    again, stored = detector.load_bundle(spark, str(tmp_path))
    assert detector.rescored_rows(linear, again, tx).count() == 0
    assert stored.exceptAll(reference).count() == 0


def test_platt_recovers_a_known_map(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0.05, 0.95, 6000)
    true = 1 / (1 + np.exp(-(0.5 * np.log(p / (1 - p)) - 1)))
    y = (rng.random(6000) < true).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
    platt = calibrate.fit_platt(df)
    assert platt.a == pytest.approx(0.5, abs=0.1) and platt.b == pytest.approx(-1, abs=0.1)
    out = rows(df.select("p", platt.apply(F.col("p")).alias("q")))
    assert all(a[1] < b[1] for a, b in zip(out, out[1:]) if a[0] < b[0])


def test_isotonic_is_monotone_and_clipped(spark):
    df = spark.createDataFrame(
        [(0.1, 0), (0.2, 1), (0.3, 0), (0.6, 1), (0.7, 1)], "p double, y int"
    )
    model = calibrate.fit_isotonic(df)
    ask = spark.createDataFrame([(0.0,), (0.1,), (0.25,), (0.65,), (0.99,)], "p double")
    got = [r["p_isotonic"] for r in model.transform(ask).orderBy("p").collect()]
    assert got == sorted(got) and got[0] == 0.0 and got[-1] == 1.0 and got[2] == 0.5


def max_of_least_means(p, y):
    """Distinct scores and their rates: of all stretches up to a place the largest of the least
    means of those that reach beyond it."""
    kinds = np.unique(p)
    total = [(y[p == v].sum(), (p == v).sum()) for v in kinds]
    n = len(kinds)

    def mean(j, k):
        return sum(t for t, _ in total[j : k + 1]) / sum(c for _, c in total[j : k + 1])

    return kinds, [max(min(mean(j, k) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]


@pytest.mark.parametrize("kind", ["rising", "falling", "noise", "level"])
def test_isotonic_fit_in_blocks_of_any_size(spark, kind):
    rng = np.random.default_rng(11)
    p = np.round(rng.uniform(0, 1, 260), 2 if kind == "noise" else 3)
    chance = {"rising": p, "falling": 1 - p, "noise": 0.3 + 0.4 * p, "level": 0 * p}[kind]
    y = (rng.random(260) < chance).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
    kinds, want = max_of_least_means(p, y)
    for block in (4, 1000):
        model = calibrate.fit_isotonic(df, block)
        got = {r["p"]: r["p_isotonic"] for r in model.transform(df.select("p")).distinct().collect()}
        assert [got[v] for v in kinds] == pytest.approx(want, abs=1e-12)
        steps = model.steps.orderBy("lo").collect()
        assert all(a["hi"] < b["lo"] and a["rate"] < b["rate"] for a, b in zip(steps, steps[1:]))


def test_isotonic_of_nothing_and_of_nulls(spark):
    schema = "p double, y int"
    some = calibrate.fit_isotonic(spark.createDataFrame([(0.5, 1), (None, 0)], schema))
    asked = spark.createDataFrame([(None,), (0.1,), (0.9,)], "p double")
    assert [r["p_isotonic"] for r in some.transform(asked).orderBy("p").collect()] == [None, 1.0, 1.0]
    none = calibrate.fit_isotonic(spark.createDataFrame([], schema))
    assert {r["p_isotonic"] for r in none.transform(asked).collect()} == {None}


def test_platt_on_separable_and_single_class_rows(spark):
    for rows_ in ([(0.1, 0), (0.2, 0), (0.8, 1)], [(0.3, 0), (0.4, 0)]):
        platt = calibrate.fit_platt(spark.createDataFrame(rows_, "p double, y int"))
        assert math.isfinite(platt.a) and math.isfinite(platt.b)
    assert calibrate.fit_platt(spark.createDataFrame([], "p double, y int")) == calibrate.PlattMap(1.0, 0.0)


def test_the_linear_penalty_is_that_of_one_row(spark):
    """Against Newton steps on the summed loss plus half the squared scaled coefficients."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-1.5 * x))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "f_x double, is_fraud int")
    df = df.withColumn("amount", F.lit(None).cast("double"))
    line = detector.fit(df, "logreg").stages[-1]
    w = len(y) / (2 * np.bincount(y))[y]
    z = x / x.std(ddof=1)
    design, at = np.column_stack([np.ones(300), z]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ at))
        grad = design.T @ (w * (p - y)) + [0, at[1]]
        at = at - np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + np.diag([0, 1.0]), grad)
    assert line.coefficients[0] * x.std(ddof=1) == pytest.approx(at[1], rel=1e-2)
    free = line.coefficients[0] * x.std(ddof=1)
    assert free < 1.1 * at[1]


@pytest.mark.parametrize("name", ["gbt", "gbt_shallow", "logreg"])
def test_contributions_rebuild_the_margin(tx, name):
    model = detector.fit(tx, name, 1, 4, 0.2)
    explained = attribution.contributions(model, tx)
    assert attribution.additivity_error(explained).first()[0] < 1e-9
    scored = {r["transaction_id"]: r["p"] for r in detector.score(model, tx).collect()}
    for r in explained.limit(50).collect():
        assert 1 / (1 + math.exp(-r["margin"])) == pytest.approx(scored[r["transaction_id"]])


def test_leaf_contributions_are_shapley_values():
    """One leaf, two features, against the definition."""
    x = np.array([[0.0, 0.0], [0.0, 9.0], [9.0, 9.0]])
    path = [(0, 5.0, False, True, 0.25), (1, 5.0, False, True, 0.5)]
    got = attribution.leaf_contributions(x, 8.0, path)
    for i, (a, b) in enumerate([(1, 1), (1, 0), (0, 0)]):
        def value(knows_a, knows_b, a=a, b=b):
            return 8.0 * (a if knows_a else 0.25) * (b if knows_b else 0.5)

        first = (value(1, 0) - value(0, 0) + value(1, 1) - value(0, 1)) / 2
        second = (value(0, 1) - value(0, 0) + value(1, 1) - value(1, 0)) / 2
        assert got[0][i] == pytest.approx(first) and got[1][i] == pytest.approx(second)


def test_contributions_equal_subset_enumeration():
    """Five features, one of them twice on the path and one missing, against all subsets."""
    rng = np.random.default_rng(5)
    steps = [(0, 0.2, True, True, 0.4), (1, 0.5, False, False, 0.7), (2, 0.1, False, True, 0.3),
             (0, -0.5, False, False, 0.8), (3, 0.0, True, True, 0.9), (4, 0.3, False, True, 0.25)]
    x = rng.normal(size=(40, 5))
    x[::7, 3] = np.nan
    got = attribution.leaf_contributions(x, 3.0, steps)
    share = {0: 0.4 * 0.8, 1: 0.7, 2: 0.3, 3: 0.9, 4: 0.25}
    for row, values in enumerate(x):
        passes = {f: 1.0 for f in share}
        for f, cut, missing_left, left, _ in steps:
            goes_left = missing_left if np.isnan(values[f]) else values[f] <= cut
            passes[f] *= goes_left == left
        for i in share:
            others = [f for f in share if f != i]
            want = 0.0
            for size in range(len(share)):
                weight = math.factorial(size) * math.factorial(4 - size) / math.factorial(5)
                for known in combinations(others, size):
                    part = math.prod(passes[f] if f in known else share[f] for f in others)
                    want += weight * 3.0 * part * (passes[i] - share[i])
            assert got[i][row] == pytest.approx(want, abs=1e-12)


def test_ranking_keeps_the_sign_beside_the_size(spark):
    df = spark.createDataFrame(
        [([2.0, 0.5], 1), ([-2.0, 0.5], 0)], "contributions array<double>, is_fraud int"
    )
    got = attribution.attribution_ranking(df, ["num__a", "cat__b"], 2)
    assert rows(got, "scope", "rank", "feature", "mean_abs", "mean_signed") == [
        ("all", 1, "a", 2.0, 0.0), ("all", 2, "b", 0.5, 0.5),
        ("fraud", 1, "a", 2.0, 2.0), ("fraud", 2, "b", 0.5, 0.5),
    ]


def test_feature_labels_cover_every_slot(tx, linear):
    vectors = linear.transform(tx)
    names = attribution.feature_labels(vectors)
    assert len(names) == len(vectors.first()["features"])
    assert names[0] == "cat__category_c0" and "num__f_a" in names and "num__f_b_missing" in names


def test_selection_reads_validation_only(spark):
    table = spark.createDataFrame(
        [("base", "a", 0.5, 0.9, 1.0), ("base", "b", 0.7, 0.1, 1.0), ("wide", "a", 0.7, 0.2, 1.0)],
        "feature_set string, variant string, validation_ap double, test_ap double, test_recall double",
    )
    variants = (grid.Variant("a", "gbt", 1, 0.1), grid.Variant("b", "gbt", 1, 0.1))
    got = grid.selection(table, variants, ["base", "wide"]).first()
    assert got["incumbent"] == "base|a" and got["selected_by_validation"] == "base|b"
    assert got["best_velocity"] == "wide|a" and got["best_on_test"] == "base|a"


def test_training_run(tx):
    run = training.train_and_evaluate(tx, Options(model="logreg"))
    row = run.headline.first()
    assert row["n_train"] + row["n_test"] == 600
    assert row["average_precision"] > row["base_rate"]
    assert run.curve.count() == 8
    assert {r["feature"] for r in run.reference.collect()} >= {"amount", "f_a", "hour_of_day"}


def test_calibration_run_keeps_the_ranking(tx):
    run = training.calibration_report(tx, Options(model="logreg"))
    got = {(r["slice"], r["scale"]): r for r in run.summary.collect()}
    assert set(got) == {(s, k) for s in ("calibration", "test") for k in ("raw", "platt", "isotonic")}
    test = got["test", "platt"]
    assert test["average_precision"] == pytest.approx(got["test", "raw"]["average_precision"])
    assert test["brier"] < got["test", "raw"]["brier"] + 0.02
    assert run.decoupled.count() == 6 and run.curve.count() == 8


def test_rolling_run(tx):
    options = Options(model="logreg", resamples=10, train_fractions=(0.4, 0.7), min_test_fraud=5)
    run = rolling_report.rolling_report(tx, options)
    folds = {r["fold"]: r for r in run.metrics.collect()}
    assert set(folds) == {0, 1, 2}
    assert folds[0]["n_rows"] == folds[1]["n_rows"] + folds[2]["n_rows"]
    assert all(r["straddling_rows"] == 0 for r in run.audit.collect())
    assert run.intervals.count() == 6 and run.thresholds.count() == 6
    by_fold = {r["fold"]: r for r in run.calibration.collect()}
    assert by_fold[0]["observed_frauds"] == folds[0]["frauds"]


def test_business_case_and_its_guard(tx, linear):
    scored = detector.scored_table(linear, tx)
    case = business.business_case(scored, 0.8, Options(resamples=10))
    assert case.outcomes.count() == 4 and case.sensitivity.count() == 50
    assert case.neighbours.count() == 3 and case.intervals.count() == 15
    from riskweave.operators.curves import review_curve

    stored = review_curve(scored, (0.5, 0.9))
    business.check_against_stored(scored, stored)
    with pytest.raises(ValueError):
        business.check_against_stored(
            scored, stored.withColumn("fraud_missed", F.col("fraud_missed") + 1)
        )


def test_a_grid_goes_on_where_it_ended(tx, tmp_path, monkeypatch):
    half = tx.where("transaction_id < 't0300'"), tx.where("transaction_id >= 't0300'")
    sets = {"base": grid.Slices(*half, *half)}
    variants = [grid.Variant("a", "gbt", 2, 0.1), grid.Variant("b", "gbt_shallow", 2, 0.1)]
    first = grid.grid_scores(sets, variants[:1], 1, str(tmp_path)).count()
    assert first == 2 * half[1].count()
    asked = []
    fit_all = detector.fit_all
    monkeypatch.setattr(detector, "fit_all", lambda t, s, seed: asked.append([x[0] for x in s]) or fit_all(t, s, seed))
    scores = grid.grid_scores(sets, variants, 1, str(tmp_path))
    assert asked == [["gbt_shallow"], ["gbt_shallow"]] and scores.count() == 2 * first
    assert {tuple(r) for r in scores.select("variant", "slice").distinct().collect()} == {
        (v, s) for v in "ab" for s in ("test", "validation")
    }
    asked.clear()
    assert grid.grid_scores(sets, variants, 1, str(tmp_path)).count() == 2 * first and asked == []
