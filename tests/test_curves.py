import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskweave.operators import curves, policies
from riskweave.operators.cells import score_cells
from riskweave.options import REVIEW_THRESHOLDS

NAMES = (
    "coverage", "n_sent_to_review", "n_flagged_fraud", "precision_on_flagged",
    "fraud_caught_auto", "fraud_in_review_queue", "fraud_missed", "recall_auto",
)


@pytest.fixture(scope="module")
def random_scores(spark):
    """Scores that often sit exactly on a cut."""
    rng = random.Random(11)
    pool = [0.0, 0.05, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.95, 1.0, 1 - 0.95, 1 - 0.7, 1 - 0.9]
    data = []
    for i in range(800):
        p = rng.choice(pool) if i % 2 else round(rng.random(), 3)
        data.append((f"t{i}", round(rng.uniform(1, 500), 2), int(rng.random() < 0.3), p))
    return data, spark.createDataFrame(data, "transaction_id string, amount double, y int, p double")


def lanes(p, t):
    return "review" if max(p, 1 - p) < t else "fraud" if p >= 0.5 else "legit"


def brute(data, lane_of):
    marked = [(lane_of(p), y) for _, _, y, p in data]
    flags = [y for lane, y in marked if lane == "fraud"]
    frauds = [lane for lane, y in marked if y]
    return (
        sum(lane != "review" for lane, _ in marked) / len(marked),
        sum(lane == "review" for lane, _ in marked),
        len(flags),
        sum(flags) / len(flags) if flags else None,
        sum(flags),
        frauds.count("review"),
        frauds.count("legit"),
        sum(flags) / len(frauds) if frauds else None,
    )


def test_hand_worked_curve(scored):
    got = {r["review_threshold"]: r for r in curves.review_curve(scored, (0.5, 0.8, 0.99)).collect()}
    assert tuple(got[0.5][n] for n in NAMES) == (1.0, 0, 3, 2 / 3, 2, 0, 2, 0.5)
    assert tuple(got[0.8][n] for n in NAMES) == (4 / 6, 2, 2, 0.5, 1, 2, 1, 0.25)
    assert tuple(got[0.99][n] for n in NAMES) == (0.0, 6, 0, None, 0, 4, 0, 0.0)


def test_curve_equals_brute_force_on_the_cuts(random_scores):
    data, df = random_scores
    for r in curves.review_curve(df, REVIEW_THRESHOLDS).collect():
        want = brute(data, lambda p, t=r["review_threshold"]: lanes(p, t))
        assert tuple(r[n] for n in NAMES) == want


def test_decoupled_curve_equals_brute_force(random_scores):
    data, df = random_scores
    points = [(0.5, 0.05), (0.8, 0.2), (0.95, 0.4), (0.6, 0.5)]
    for r in curves.decoupled_curve(df, points).collect():
        def lane(p, f=r["flag_at"], c=r["clear_at"]):
            return "fraud" if p >= f else "legit" if p <= c else "review"

        assert tuple(r[n] for n in NAMES) == brute(data, lane)


def test_decoupled_generalises_the_band(random_scores):
    _, df = random_scores
    band = curves.review_curve(df, (0.7, 0.9)).orderBy("review_threshold")
    pairs = curves.decoupled_curve(df, [(t, 1 - t) for t in (0.7, 0.9)]).orderBy("flag_at")
    assert [tuple(r[n] for n in NAMES) for r in band.collect()] == [
        tuple(r[n] for n in NAMES) for r in pairs.collect()
    ]


def test_overlapping_cuts_are_an_error(scored):
    with pytest.raises(ValueError):
        curves.decoupled_curve(scored, [(0.4, 0.4)])
    with pytest.raises(ValueError):
        policies.lane_totals(scored, cuts=(0.2, 0.3))


def test_frauds_fall_into_exactly_one_lane(random_scores):
    data, df = random_scores
    total = sum(y for _, _, y, _ in data)
    for r in curves.review_curve(df).collect():
        assert r["fraud_caught_auto"] + r["fraud_in_review_queue"] + r["fraud_missed"] == total


def test_no_fraud_leaves_recall_undefined(spark):
    df = spark.createDataFrame([(0.9, 0), (0.1, 0)], "p double, y int")
    row = curves.review_curve(df, (0.5,)).first()
    assert row["recall_auto"] is None and row["precision_on_flagged"] == 0.0


def test_cells_do_not_grow_with_rows(random_scores):
    _, df = random_scores
    cells = score_cells(df, (0.2, 0.8), (0.5, 0.9))
    assert cells.count() < 40
    assert cells.agg(F.sum("n")).first()[0] == 800


def curve_row(spark):
    return spark.createDataFrame(
        [(0.8, 100, 40, 30, 5)],
        "review_threshold double, n_sent_to_review long, n_flagged_fraud long,"
        "fraud_caught_auto long, fraud_missed long",
    )


def test_price_of_one_point(spark):
    got = curves.expected_cost(curve_row(spark), F.lit(200), F.lit(10), F.lit(2)).first()
    assert (got["n_false_flags"], got["expected_cost"]) == (10, 1300)


def test_cheapest_threshold_is_the_first_of_equals(spark):
    curve = spark.createDataFrame(
        [(0.5, 0, 10, 5, 3), (0.6, 0, 10, 5, 1), (0.7, 0, 10, 5, 1)],
        "review_threshold double, n_sent_to_review long, n_flagged_fraud long,"
        "fraud_caught_auto long, fraud_missed long",
    )
    got = curves.price_scenarios(curve, [("s", 100.0, 1.0, 1.0)]).first()
    assert got["min_cost_threshold"] == 0.6 and got["savings_vs_full_automation"] == 200


def test_policy_counts_partition_frauds_and_scale_with_amounts(random_scores):
    _, df = random_scores
    one = policies.policy_outcomes(df, policies.four_policies(0.9)).collect()
    ten = policies.policy_outcomes(
        df.withColumn("amount", F.col("amount") * 10), policies.four_policies(0.9)
    ).collect()
    by_name = {r["policy"]: r for r in ten}
    for r in one:
        s = by_name[r["policy"]]
        assert r["fraud_caught_auto"] + r["fraud_in_review"] + r["fraud_missed"] == r["fraud_total"]
        assert abs(s["fraud_amount_missed"] - 10 * r["fraud_amount_missed"]) < 1e-6
        assert s["fraud_amount_share_missed"] == pytest.approx(r["fraud_amount_share_missed"])


def test_band_and_low_threshold_surface_the_same_rows(random_scores):
    _, df = random_scores
    got = policies.compare_policies(df.where("p <> 1 - 0.9D"), 0.9).first()
    assert got["c_vs_d_same_surfaced_set"]
    assert got["c_vs_b_same_alerts"] and got["c_alerts"] <= got["d_alerts"]


def test_flagged_and_queued_row_fails(spark):
    bad = spark.createDataFrame(
        [(1, 1.0, 1, True, True)], "n long, amount double, y int, flagged boolean, queued boolean"
    )
    with pytest.raises(Exception, match="both flagged and queued"):
        policies.outcome(bad, ["y"]).collect()


def test_lane_hours(scored):
    got = {r["lane"]: r for r in policies.lane_totals(scored, 0.8, minutes_per_review=6.0).collect()}
    assert got["review"]["n"] == 2
    assert got["review"]["review_hours"] == pytest.approx(2 / 6 * 10000 * 6 / 60)
    assert got["fraud"]["review_hours"] is None


def test_dashboard_drops_points_without_flags(scored):
    got = rows(curves.dashboard_curve(scored, (0.5, 0.99)), "review_threshold")
    assert got == [(0.5,)]
