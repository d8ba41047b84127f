import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskweave.operators.ordered import (
    equal_count_bin,
    exact_quantiles,
    row_positions,
    scan,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, and half of those one time."""
    rng = random.Random(5)
    out = []
    for i in range(3000):
        hot = i % 3 == 0
        key = "hot" if hot else f"k{rng.randrange(40)}"
        at = 7 if hot and i % 2 else rng.randrange(50)
        out.append((key, at, i, rng.randrange(10)))
    return out, spark.createDataFrame(out, "key string, at int, id int, v long")


def test_scan_equals_a_plain_loop_under_skew(skewed):
    data, df = skewed
    got = scan(df, ["at", "id"], ["v"], last=["v"], within=["key"], buckets=7)
    want, sums, prev = {}, {}, {}
    for key, at, i, v in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        want[i] = (sums.get(key, 0), prev.get(key))
        sums[key], prev[key] = sums.get(key, 0) + v, v
    found = {r["id"]: (r["v_before"], r["v_prev"]) for r in got.collect()}
    assert found == want
    assert {(r["key"], r["v_total"]) for r in got.collect()} == set(sums.items())


def test_hot_key_spreads_over_buckets(skewed):
    from riskweave.operators.ordered import BUCKET, range_order

    _, df = skewed
    ranged = range_order(df, ["key", "at", "id"], 8)
    largest = max(r["count"] for r in ranged.groupBy(BUCKET).count().collect())
    assert largest < 1000  # the hot key alone has 1,000 rows


def test_previous_value_skips_nulls_across_buckets(spark):
    data = [(i, i if i in (0, 40) else None) for i in range(100)]
    df = spark.createDataFrame(data, "at int, v int")
    got = dict(rows(scan(df, ["at"], last=["v"], buckets=9), "at", "v_prev"))
    assert got[0] is None and got[1] == 0 and got[40] == 0 and got[41] == 40 and got[99] == 40


def test_positions_are_contiguous(skewed):
    data, df = skewed
    got = rows(row_positions(df, ["at", "id"]), "position", "id")
    order = [r[2] for r in sorted(data, key=lambda r: (r[1], r[2]))]
    assert got == list(enumerate(order))


@pytest.mark.parametrize("n,k", [(10, 3), (4, 10), (7, 7), (100, 9)])
def test_equal_count_bins_put_longer_bins_first(spark, n, k):
    df = spark.range(n).select(
        "id", equal_count_bin(F.col("id"), F.lit(n).cast("long"), k).alias("bin")
    )
    want = [i for i, part in enumerate(np.array_split(np.arange(n), k)) for _ in part]
    assert [b for _, b in rows(df, "id", "bin")] == want


def test_quantiles_interpolate_like_numpy(skewed):
    data, df = skewed
    levels = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {
        (r["key"], r["level"]): r["quantile"]
        for r in exact_quantiles(df, "at", levels, ["key"]).collect()
    }
    for key in {r[0] for r in data}:
        values = [r[1] for r in data if r[0] == key]
        for q in levels:
            assert math.isclose(got[key, q], np.quantile(values, q), rel_tol=1e-12)
