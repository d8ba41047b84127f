import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import resample


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    data = []
    for i in range(400):
        p = round(float(rng.random()), 2)
        data.append((f"t{i:03d}", i % 2 + 1, float(rng.integers(1, 300)), int(rng.random() < p), p))
    return data, spark.createDataFrame(
        data, "transaction_id string, fold int, amount double, y int, p double"
    )


def test_every_resample_draws_as_many_rows_as_there_are(table):
    _, df = table
    drawn = resample.drawn_rows(df, ["transaction_id"], 20, 1, tie="transaction_id")
    sizes = [r[1] for r in drawn.groupBy("resample").agg(F.sum("w")).collect()]
    assert sizes == [400] * 20


def test_draws_depend_on_the_seed_only(table):
    _, df = table
    a = resample.drawn_rows(df, ["p", "y"], 5, 1)
    b = resample.drawn_rows(df.repartition(7), ["p", "y"], 5, 1)
    c = resample.drawn_rows(df, ["p", "y"], 5, 2)
    assert a.exceptAll(b).count() == 0
    assert a.exceptAll(c).count() > 0


def test_windows_are_drawn_apart(table):
    _, df = table
    drawn = resample.drawn_rows(df, ["y"], 4, 3, within="fold")
    sizes = {r[0]: r[1] for r in drawn.groupBy("fold").agg(F.sum("w")).collect()}
    assert sizes == {1: 800, 2: 800}


def test_poisson_counts_agree_with_draws_on_average(table):
    data, df = table
    exact = {r["metric"]: r for r in resample.headline_of_draws(df, 300, 1).collect()}
    loose = {r["metric"]: r for r in resample.headline_bootstrap(df, 300, 1).collect()}
    for name in ("average_precision", "recall"):
        assert exact[name]["point"] == pytest.approx(loose[name]["point"])
        assert exact[name]["ci_lower"] < exact[name]["point"] < exact[name]["ci_upper"]
        for end in ("ci_lower", "ci_upper"):
            assert exact[name][end] == pytest.approx(loose[name][end], abs=0.03)


def test_poisson_counts_have_the_law():
    keys = np.arange(4000, dtype=np.int64) * 7919
    for size in (1, 3, 200, 5000):
        counts = resample.poisson_counts(keys, np.full(4000, size), 5, 9)
        assert counts.dtype == np.int64
        assert counts.mean() == pytest.approx(size, abs=5 * np.sqrt(size / counts.size))
        assert counts.var() == pytest.approx(size, rel=0.1)
        again = resample.poisson_counts(keys[::-1], np.full(4000, size), 5, 9)
        assert (again[::-1] == counts).all()  # the key decides, not the place
    big = resample.poisson_counts(np.array([1]), np.array([10**11]), 2, 1)
    assert (abs(big - 10**11) < 10**7).all()


def test_poisson_sums_have_the_right_mean(table):
    _, df = table
    sums = {f"y{k}": (F.col("y") == k).cast("int") for k in (0, 1)}
    drawn = resample.poisson_sums(resample.grouped(df, ["p", "y"]), sums, 500, 5)
    means = drawn.agg(F.avg("y0"), F.avg("y1")).first()
    counts = dict(df.groupBy("y").count().collect())
    for y in (0, 1):
        assert means[y] == pytest.approx(counts[y], rel=0.03)


def test_ranked_samples_against_sorting(table, spark, monkeypatch):
    """Average precision and calibration error of each resample, from the counts themselves."""
    monkeypatch.setattr(resample, "SLICE", 7)
    _, df = table
    groups = resample.grouped(df, ["p", "y"]).collect()
    keys, sizes = np.array([g["key"] for g in groups]), np.array([g["n"] for g in groups])
    counts = resample.poisson_counts(keys, sizes, 6, 3)
    frame = resample.grouped(df, ["p", "y"]).withColumn("ranking", F.lit("x"))
    ap = resample.ranked_samples(frame.withColumn("score", -F.col("p")), 6, 3).collect()
    ece = resample.ranked_samples(frame.withColumn("score", F.col("p")), 6, 3, 10).collect()
    for r in range(6):
        rows = [(g["p"], g["y"]) for g, c in zip(groups, counts[:, r]) for _ in range(c)]
        rows.sort()
        p, y = np.array(rows).T
        total, value = y.sum(), 0.0
        for s in sorted(set(p), reverse=True):
            value += y[p == s].sum() / total * y[p >= s].sum() / (p >= s).sum()
        assert next(x for x in ap if x["resample"] == r)["average_precision"] == pytest.approx(value)
        parts = np.array_split(np.arange(len(p)), 10)
        gap = sum(abs(p[i].sum() - y[i].sum()) for i in parts) / len(p)
        found = next(x for x in ece if x["resample"] == r)
        assert found["n"] == len(p) and found["ece"] == pytest.approx(gap)


def test_resamples_without_a_positive_are_counted(spark):
    data = [(f"t{i}", int(i == 0), i / 10) for i in range(6)]
    df = spark.createDataFrame(data, "transaction_id string, y int, p double")
    got = {r["metric"]: r for r in resample.headline_bootstrap(df, 100, 1).collect()}
    # (5/6)^6 of the resamples miss the one positive
    assert 15 < got["average_precision"]["degenerate"] < 55
    assert got["average_precision"]["degenerate"] == got["recall"]["degenerate"]


def test_identical_scorers_have_no_delta(table):
    _, df = table
    pair = df.select(
        "transaction_id", "y", F.col("p").alias("p_incumbent"), F.col("p").alias("p_challenger")
    )
    got = resample.paired_delta_bootstrap(pair, 30, 2).first()
    assert (got["delta"], got["ci_lower"], got["ci_upper"]) == (0, 0, 0)
    assert got["win_share"] == 0 and not got["excludes_zero"]


def test_a_clearly_worse_challenger_excludes_zero(table):
    _, df = table
    pair = df.select(
        "transaction_id", "y", F.col("p").alias("p_incumbent"), (1 - F.col("p")).alias("p_challenger")
    )
    got = resample.paired_delta_bootstrap(pair, 50, 2).first()
    assert got["delta"] < 0 and got["ci_upper"] < 0 and got["excludes_zero"]


def test_policy_intervals_hold_their_points(table):
    _, df = table
    got = {r["metric"]: r for r in resample.policy_bootstrap(df, 0.7, 100, 4).collect()}
    assert len(got) == 15
    share = df.where("y = 1 and p < 0.5").count() / df.where("y = 1").count()
    row = got["a_fraud_share_missed"]
    assert row["ci_lower"] < share < row["ci_upper"]


def test_window_bootstrap_has_a_pool(table):
    _, df = table
    rows = df.withColumn("p_calibrated", F.col("p"))
    got = resample.window_bootstrap(rows, 30, 6).collect()
    assert {(r["fold"], r["metric"]) for r in got} == {
        (f, m) for f in (0, 1, 2) for m in ("average_precision", "ece")
    }


@pytest.mark.parametrize("within", [None, "fold"])
def test_draws_of_many_pages(table, monkeypatch, within):
    """Pages, slabs and blocks much smaller than the table, against md5 row by row."""
    data, df = table
    for name, value in (("PAGE", 64), ("SLAB", 3), ("_BLOCKS", 16)):
        monkeypatch.setattr(resample, name, value)
    want = collections.Counter()
    for fold in (1, 2) if within else ("",):
        rows = sorted(d for d in data if fold in ("", d[1]))
        for r in range(7):
            for j in range(len(rows)):
                digest = hashlib.md5(f"9:{fold}:{r}:{j // 2}".encode()).hexdigest()
                row = rows[int(digest[16 * (j % 2) :][:15], 16) % len(rows)]
                want[(r, fold, row[4], row[3])] += 1
    got = resample.drawn_rows(df, ["p", "y"], 7, 9, within).collect()
    assert {(g["resample"], g["fold"] if within else "", g["p"], g["y"]): g["w"] for g in got} == want


def test_draws_tell_null_from_nan(spark):
    df = spark.createDataFrame([("a", None), ("b", float("nan")), ("c", 1.0), ("d", None)], "transaction_id string, p double")
    got = resample.drawn_rows(df, ["p"], 40, 1).groupBy("p").agg(F.sum("w").alias("w")).collect()
    assert len(got) == 3 and sum(g["w"] for g in got) == 160


def test_draws_travel_in_few_bits():
    rng = np.random.default_rng(4)
    for n, most in ((1 << 18, 3), (1 << 12, 9), (3, 1000)):
        places = np.sort(rng.integers(0, 1 << 18, n)).astype(np.uint32)
        sent = resample._squeezed(places)
        assert (resample._unsqueezed(sent) == places).all()
        assert len(sent) * 8 <= most * n


def test_windows_are_written_added_up(table, monkeypatch):
    """Equal rows of several pages are one row by the time they are written."""
    kept, plain = [], resample.store

    def keep(rows, name="stored"):
        found = plain(rows, name)
        if name == "pooled":
            kept.append(found)
        return found

    _, df = table
    monkeypatch.setattr(resample, "PAGE", 16)
    monkeypatch.setattr(resample, "store", keep)
    rows = df.select("transaction_id", "fold", "y", F.lit(0.5).alias("p"), F.lit(0.25).alias("p_calibrated"))
    resample.window_of_draws(rows, 5, 1)
    drawn = next(k for k in kept if "resample" in k.columns)
    assert drawn.count() == drawn.where("fold <> 0").select("resample", "fold", "y").distinct().count() * 2
