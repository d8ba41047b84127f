"""The random forest: draws, splits, number of tasks, votes, saving."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskweave.models import boosting, detector, random_forest, registry
from riskweave.operators.ranking import average_precision

FIELDS = ("start", "feature", "cut", "left", "right", "value", "count")


def made(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 1] = rng.integers(0, 4, n)
    margin = 2 * x[:, 0] + (x[:, 1] == 2) + np.abs(x[:, 2]) - 2
    return x, (rng.random(n) < 1 / (1 + np.exp(-margin))).astype(int)


def frame(spark, n, seed=1):
    x, y = made(n, seed)
    data = [(f"t{i}", [float(v) for v in r], int(c), 1.0 + 1.7 * int(c)) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "transaction_id string, x array<double>, is_fraud int, weight double")
    df = df.repartition(5)
    return df.withColumn("features", array_to_vector("x"))


@pytest.fixture(scope="module")
def coded(spark):
    return boosting.coded_vectors(frame(spark, 1500), "features", "is_fraud", "weight", bins=32)


def test_draws_are_poisson_and_differ():
    often = random_forest.drawn(3, 1, 40, 5000)
    assert often.mean() == pytest.approx(1, abs=0.02) and often.var() == pytest.approx(1, abs=0.03)
    assert (often == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    assert not (often[0] == often[1]).all()
    assert not (often == random_forest.drawn(3, 2, 40, 5000)).all()
    assert not (often == random_forest.drawn(4, 1, 40, 5000)).all()
    assert (random_forest.drawn(3, 1, 1, 9) == 1).all()


def test_each_node_looks_at_distinct_features():
    looked = random_forest.looked_at(42, 3, 50, 10)
    assert looked.shape == (50, 8, 4) and (np.diff(looked, axis=-1) > 0).all()
    assert set(looked.ravel().tolist()) == set(range(10))
    assert random_forest.looked_at(42, 1, 1, 3).tolist() == [[[0, 1, 2], [0, 1, 2]]]


def test_trees_do_not_depend_on_the_number_of_tasks(coded):
    one = random_forest.grown(coded, 7, 4, 5, tasks=1)
    assert one.trees == 7 and (one.left >= 0).sum() > 7 * 5
    for tasks in (2, 9):
        other = random_forest.grown(coded, 7, 4, 5, tasks=tasks)
        assert all((getattr(one, f) == getattr(other, f)).all() for f in FIELDS)
    other = random_forest.grown(coded, 7, 4, 6)
    assert len(other.cut) != len(one.cut) or (other.cut != one.cut).any()


def test_a_single_tree_takes_the_best_splits_of_all_rows(coded):
    x, y = made(1500)
    w = 1.0 + 1.7 * y
    tree = random_forest.grown(coded, 1, 3, 5)

    def impurity(rows):
        a, b = w[rows & (y == 0)].sum(), w[rows & (y == 1)].sum()
        return 2 * a * b / (a + b) if a + b else 0.0

    def check(node, rows, depth):
        if tree.left[node] < 0:
            assert tree.value[node] == pytest.approx(w[rows & (y == 1)].sum() / w[rows].sum())
            assert depth == 3 or (y[rows] == y[rows][0]).all()
            return
        left = x[:, tree.feature[node]] <= tree.cut[node]
        best = min(
            impurity(rows & (x[:, f] <= c)) + impurity(rows & (x[:, f] > c))
            for f, cuts in enumerate(coded.edges)
            for c in cuts
            if 0 < (rows & (x[:, f] <= c)).sum() < rows.sum()
        )
        assert impurity(rows & left) + impurity(rows & ~left) == pytest.approx(best)
        check(tree.left[node], rows & left, depth + 1)
        check(tree.right[node], rows & ~left, depth + 1)

    check(0, np.ones(1500, bool), 0)


def test_votes_are_as_good_as_those_of_sparks_forest(spark):
    train, test = frame(spark, 3000, 2), frame(spark, 3000, 3)
    own = random_forest.RandomForest(40, 6, 42).fit(train)
    theirs = RandomForestClassifier(numTrees=40, maxDepth=6, seed=42, labelCol="is_fraud", weightCol="weight").fit(train)
    scored = [
        own.transform(test).select("transaction_id", F.col("is_fraud").alias("y"), "p"),
        theirs.transform(test).select(
            "transaction_id", F.col("is_fraud").alias("y"), vector_to_array("probability")[1].alias("p")
        ),
    ]
    mine, other = (average_precision(s).first()[0] for s in scored)
    assert mine == pytest.approx(other, abs=0.02)
    apart = scored[0].join(scored[1].withColumnRenamed("p", "q").drop("y"), "transaction_id")
    assert apart.agg(F.avg(F.abs(F.col("p") - F.col("q")))).first()[0] < 0.05


def test_rows_all_alike_and_of_one_label(spark):
    alike = spark.createDataFrame([([1.0, 2.0], i % 2, 1.0) for i in range(40)], "x array<double>, y int, w double")
    trees = random_forest.grown(boosting.coded_rows(alike, bins=32), 3, 2, 1)
    assert len(trees.left) == 3 and 0 < trees.margins(np.array([[1.0, 2.0]]))[0] < 1
    pure = spark.createDataFrame([([float(i)], 1, 1.0) for i in range(40)], "x array<double>, y int, w double")
    assert random_forest.grown(boosting.coded_rows(pure, bins=32), 3, 2, 1).margins(np.array([[1.0]]))[0] == pytest.approx(1)
    # a lone row that some trees never draw
    lone = spark.createDataFrame([([1.0], 1, 1.0)], "x array<double>, y int, w double")
    assert random_forest.grown(boosting.coded_rows(lone, bins=32), 9, 2, 1).margins(np.array([[1.0]]))[0] == pytest.approx(1)


def test_registered_forest_keeps_its_size_and_survives_saving(spark, tmp_path):
    kept = registry.create("forest", 42, 200, 0.1)
    assert isinstance(kept, random_forest.RandomForest) and kept.size == (200, 6)
    train = frame(spark, 300, 4).select(
        "transaction_id", F.col("x")[0].alias("amount"),
        F.when(F.col("x")[2] > 0, F.col("x")[2]).alias("f_gap"), "is_fraud",
    )
    model = detector.fit(train, "forest", rounds=4)
    model.write().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert again.stages[-1].trees().trees == 4
    assert detector.rescored_rows(model, again, train).count() == 0
    assert detector.score(model, train).where("p between 0 and 1").count() == 300
