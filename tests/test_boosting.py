"""Boosted trees: coding, growth, number of tasks, missing values, scoring, saving."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskweave.models import attribution, boosting, detector, forest
from riskweave.models.boosting import Growth
from riskweave.operators.ranking import average_precision

FIELDS = ("start", "feature", "cut", "missing_left", "left", "right", "value", "count")


def made(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 1] = rng.integers(0, 4, n)
    margin = 2 * x[:, 0] + (x[:, 1] == 2) + np.abs(x[:, 2]) - 2
    y = (rng.random(n) < 1 / (1 + np.exp(-margin))).astype(int)
    x[rng.random(n) < 0.2, 0] = np.nan
    # missing where the label is 1 more often: the gap itself says something
    x[(rng.random(n) < 0.3) & (y == 1), 3] = np.nan
    return x, y


@pytest.fixture(scope="module")
def rows(spark):
    x, y = made(1500)
    data = [([None if np.isnan(v) else float(v) for v in r], int(c), float(1 + c)) for r, c in zip(x, y)]
    return spark.createDataFrame(data, "x array<double>, y int, w double")


@pytest.fixture(scope="module")
def coded(rows):
    return boosting.coded_rows(rows)


def equal(a, b):
    return a.base == b.base and all((getattr(a, f) == getattr(b, f)).all() for f in FIELDS)


def test_edges_part_all_values_or_quantiles():
    values = np.array([3.0, 1.0, np.nan, 2.0, 2.0])
    assert boosting.feature_edges(values, np.ones(5)).tolist() == [1.5, 2.5]
    assert boosting.feature_edges(np.array([np.nan, 4.0]), np.ones(2)).tolist() == []
    rng = np.random.default_rng(0)
    many = rng.normal(size=20_000)
    edges = boosting.feature_edges(many, np.ones(len(many)))
    assert len(edges) <= boosting.BINS - 1 and (np.diff(edges) > 0).all()
    shares = np.diff(np.searchsorted(np.sort(many), edges)) / len(many)
    assert shares.max() < 0.01
    near = np.array([1.0, np.nextafter(1.0, 2)])
    cut = boosting.feature_edges(near, np.ones(2))
    assert cut[0] >= near[0] and cut[0] < near[1]


@pytest.mark.parametrize("growth", [Growth(6, 0.3, 8, 20, 1.0), Growth(4, 0.3, 31, 10, 0.0)])
def test_trees_do_not_depend_on_the_tasks(coded, growth):
    one = boosting.grown(coded, growth, 1)
    assert equal(one, boosting.grown(coded, growth, 3))


def test_trees_do_not_depend_on_order_or_partitions(rows, coded):
    growth = Growth(4, 0.3)
    turned = boosting.coded_rows(rows.orderBy(F.desc("w"), F.col("x")[2]).repartition(7))
    assert equal(boosting.grown(coded, growth, 1), boosting.grown(turned, growth, 1))


def plain_best_gain(x, y, w, l2, smallest):
    """Of all cuts between distinct values and both ways of the missing, at equal scores."""
    p = (w * y).sum() / w.sum()
    g, h = w * (p - y), w * p * (1 - p)
    best = 0.0
    for f in range(x.shape[1]):
        known = np.unique(x[~np.isnan(x[:, f]), f])
        for cut in known:
            for to_left in (False, True):
                left = np.where(np.isnan(x[:, f]), to_left, x[:, f] <= cut)
                if min(left.sum(), (~left).sum()) < smallest:
                    continue
                parts = [(g[s].sum(), h[s].sum()) for s in (left, ~left)]
                gain = sum(a * a / (b + l2) for a, b in parts) - g.sum() ** 2 / (h.sum() + l2)
                best = max(best, gain)
    return best


def test_first_split_is_the_best_there_is(spark):
    x, y = made(230, 4)
    w = np.where(y == 1, 2.0, 0.5)
    data = [([None if np.isnan(v) else float(v) for v in r], int(c), float(u)) for r, c, u in zip(x, y, w)]
    coded = boosting.coded_rows(spark.createDataFrame(data, "x array<double>, y int, w double"))
    tree = boosting.grown(coded, Growth(1, 1.0, 2, 15, 0.7), 1)
    assert tree.left[0] == 1 and len(tree.left) == 3
    v = x[:, tree.feature[0]]
    left = np.where(np.isnan(v), tree.missing_left[0], v <= tree.cut[0])
    p = (w * y).sum() / w.sum()
    g, h = w * (p - y), w * p * (1 - p)
    gain = sum(g[s].sum() ** 2 / (h[s].sum() + 0.7) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 0.7)
    assert gain == pytest.approx(plain_best_gain(x, y, w, 0.7, 15), rel=1e-9)
    assert tree.count.tolist() == [230, left.sum(), (~left).sum()]
    for node, side in ((1, left), (2, ~left)):
        assert tree.value[node] == pytest.approx(-g[side].sum() / (h[side].sum() + 0.7), rel=1e-9)


def test_leaves_and_rows_keep_to_their_bounds(coded):
    for growth in (Growth(5, 0.1, 8, 50, 1.0), Growth(5, 0.1, 63, 10, 0.0)):
        trees = boosting.grown(coded, growth)
        for t in range(trees.trees):
            leaves = trees.leaves_of(t)
            assert 1 < len(leaves) <= growth.leaves
            assert trees.count[leaves].min() >= growth.smallest
            assert trees.count[leaves].sum() == 1500


def test_masks_score_as_walking_does(coded):
    trees = boosting.grown(coded, Growth(15, 0.3, 63, 5, 0.0))
    x, _ = made(3000, 9)
    x[0] = np.nan
    x[1] = np.inf
    x[2] = -np.inf
    x[3:200] = trees.cut[trees.left >= 0][:197, None]  # values that equal cuts
    assert np.array_equal(trees.margins(x), trees.walked(x))
    assert np.array_equal(forest.unpacked(trees.packed()).margins(x), trees.margins(x))
    assert trees.margins(x[:0]).shape == (0,)


def test_one_class_few_rows_and_no_rows(spark):
    schema = "x array<double>, y int, w double"
    alike = spark.createDataFrame([([1.0, None], 0, 1.0)] * 50, schema)
    trees = boosting.grown(boosting.coded_rows(alike), Growth(2))
    assert (trees.left == -1).all()
    assert forest.probabilities(trees.margins(np.array([[1.0, np.nan]])))[0] < 1e-6
    few = boosting.coded_rows(spark.createDataFrame([([1.0], 0, 1.0), ([2.0], 1, 1.0)], schema))
    assert forest.probabilities(boosting.grown(few, Growth(2)).margins(np.array([[1.0]])))[0] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        boosting.coded_rows(alike.where("false"))


def test_more_rows_than_the_sample_of_edges(spark, rows, monkeypatch):
    monkeypatch.setattr(boosting, "EDGE_ROWS", 200)
    coded = boosting.coded_rows(rows)
    assert coded.rows == 1500
    assert boosting.grown(coded, Growth(1)).count[0] == 1500  # edges are sampled, rows are not


def table(spark, n, seed):
    x, y = made(n, seed)
    data = [
        (f"t{i}", *[None if np.isnan(v) else float(v) for v in r], f"c{i % 3}", int(c))
        for i, (r, c) in enumerate(zip(x, y))
    ]
    schema = "transaction_id string, f_a double, f_b double, f_c double, f_d double, category string, is_fraud int"
    return spark.createDataFrame(data, schema).withColumns(
        {"timestamp": F.lit(None).cast("timestamp"), "entity_id": F.lit("e"), "amount": F.lit(1.0)}
    )


def test_not_worse_than_the_library_of_spark(spark):
    train, test = table(spark, 4000, 1), table(spark, 4000, 2)
    own = detector.fit(train, "gbt", rounds=40)
    numeric, categorical = detector.usable_inputs(train)
    other = Pipeline(
        stages=[
            *detector.preprocessor(numeric, categorical),
            GBTClassifier(featuresCol="features", labelCol="is_fraud", weightCol="weight", maxIter=40, stepSize=0.1),
        ]
    ).fit(detector.balanced(train))
    ap = [average_precision(detector.scored_table(m, test)).first()[0] for m in (own, other)]
    assert ap[0] >= ap[1] - 0.005


def test_a_gap_says_something(spark):
    """Scores of rows whose f_d is missing are higher, as their labels are."""
    train = table(spark, 3000, 3)
    scored = detector.score(detector.fit(train, "gbt", rounds=20), train)
    means = {r["gap"]: r["p"] for r in scored.groupBy(F.col("f_d").isNull().alias("gap")).agg(F.avg("p").alias("p")).collect()}
    assert means[True] > means[False] + 0.2


def test_saved_and_loaded_models_score_alike(spark, tmp_path):
    train = table(spark, 600, 5)
    model = detector.fit(train, "gbt_shallow", rounds=5)
    model.write().overwrite().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m")
    assert detector.rescored_rows(model, again, train).count() == 0
    assert detector.score(again, train.where("false")).count() == 0
    assert set(detector.expected_inputs(again)) == {"amount", "f_a", "f_b", "f_c", "f_d", "category"}


def test_fits_side_by_side_equal_single_fits(spark):
    train = table(spark, 500, 6)
    settings = [("gbt", 3, 0.1), ("gbt_shallow", 5, 0.2), ("logreg", 1, 0.1)]
    for model, (name, n, rate) in zip(detector.fit_all(train, settings), settings):
        single = detector.fit(train, name, rounds=n, learning_rate=rate)
        assert detector.rescored_rows(model, single, train).count() == 0


def test_the_estimator_reads_vectors(rows):
    vectors = rows.select(array_to_vector(F.transform("x", lambda v: F.coalesce(v, F.lit(float("nan"))))).alias("features"),
                          F.col("y").alias("is_fraud"), F.col("w").alias("weight"))
    model = boosting.Booster(Growth(3)).fit(vectors)
    assert model.transform(vectors).where("p > 0 and p < 1").count() == 1500


@pytest.mark.parametrize("name", ["logreg", "forest"])
def test_models_of_spark_carry_no_summary(spark, name):
    """The summary would drag the session into the tasks that score."""
    train = table(spark, 300, 7)
    model = detector.fit(train, name, rounds=3)
    assert not model.stages[-1].hasSummary
    assert detector.score(model, train).where("p between 0 and 1").count() == 300


def test_contributions_by_pattern_equal_those_row_by_row(coded):
    """Many rows share the patterns of a path; a single row has none to share."""
    trees = boosting.grown(coded, Growth(2, 0.3, 15, 10, 0.0))
    x, _ = made(600, 11)
    for value, steps in attribution.leaf_paths(trees, 1)[0]:
        known: dict = {}
        found = attribution.leaf_contributions(x, value, steps, known)
        assert set(known) == {step[:3] for step in steps}
        for i in (0, 5, 599):
            alone = attribution.leaf_contributions(x[i : i + 1], value, steps)
            assert {f: part[i] for f, part in found.items()} == {f: part[0] for f, part in alone.items()}


def test_tasks_meet_by_files(tmp_path):
    """Sums over tasks without a message of Spark's; only the last exchange's files stay."""

    def task(rank):
        swap = boosting._by_file(str(tmp_path), rank, 3)
        return [swap(np.full((2, 3), 10 * step + rank, np.int64)).tolist() for step in range(40)]

    with ThreadPoolExecutor(3) as pool:
        sums = list(pool.map(task, range(3)))
    assert sums == [[[[30 * step + 3] * 3] * 2 for step in range(40)]] * 3
    assert sorted(f.name for f in tmp_path.iterdir()) == ["39-0", "39-1", "39-2"]


def test_features_share_passes():
    """Joint sums of packed codes are the sums per feature, with many rows and with few."""
    rng = np.random.default_rng(3)
    known = [254, 1, 200, 23, 1, 0, 6]
    codes = np.stack([rng.integers(0, k + 1, 40_000) for k in known]).astype(np.uint8)
    codes[:, rng.random(40_000) < 0.1] = boosting.MISSING
    held = boosting._Codes(known)
    held.packed = held.pack(codes)
    assert len(held.packs) < len(known) / 2
    g, h = rng.integers(-(2**28), 2**28, (2, 40_000)).astype(float)
    for rows in (None, np.arange(0, 40_000, 2), np.arange(7)):
        at = slice(None) if rows is None else rows
        got = held.histogram(rows, g[at], h[at])
        for f, column in enumerate(codes):
            want = [np.bincount(column[at], w, 256) for w in (g[at], h[at], None)]
            assert (got[:, f] == want).all()
