from __future__ import annotations

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from edge_rows import CLASHING

from riskweave.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_of(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    return found


def edge_vectors(spark):
    """Copies by the hundred, unusable vectors, other lengths, repeated ids, huge components."""
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], 0) for i in range(60)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 0) for i in range(300)]
    rows += [(2000, None, 0), (2050, [0.0] * 6, 0), (2100, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0)]
    rows += [(2150, [float("nan")] + [1.0] * 5, 0), (2200, [float("inf")] + [1.0] * 5, 0), (2250, [], 0)]
    rows += [(3000, [1.0, 2.0], 0), (3001, [2.0, 4.0], 0), (3050, [3.0], 0), (None, [1.0] * 6, 0)]
    rows += [(0, [0.5] * 6, 1), (5, [0.25] * 6, 1), (50, rows[50][1], 0), (7, rows[7][1], 0)]
    rows += [(4000, [1e30, -1e30, 0.0, 0.0, 0.0, 1.0], 0), (4001, [3e38, 1.0, 1.0, 1.0, 1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *[f"{i} as `{c}`" for i, c in enumerate(CLASHING)]), rows


def usable(rows, zero):
    out = []
    for i, v, _ in rows:
        x = np.array([np.nan if c is None else c for c in v or []], np.float32).astype(float)
        if i is not None and x.size and np.isfinite(x).all() and (zero or x.any()):
            out.append((i, x))
    return out


def brute(rows, zero, score, k=5):
    found = {}
    vectors = usable(rows, zero)
    for q, x in vectors:
        if q % 50:
            continue
        best = found.setdefault(q, {})
        for i, y in vectors:
            if i != q and len(x) == len(y):
                s = score(x, y)
                best[i] = max(best.get(i, s), s)
    return {
        q: sorted(b.items(), key=lambda p: (-p[1], p[0]))[:k] for q, b in found.items() if b
    }


def integer_product(x, y):
    s = sum(int(a) * int(b) for a, b in zip(np.floor(256 * x), np.floor(256 * y)))
    return max(-(2**63), min(2**63 - 1, s))


def test_top_products_of_edge_vectors(spark):
    df, rows = edge_vectors(spark)
    assert rows_of(topk.top_products(df, df.where("vec_id % 50 = 0"))) == brute(rows, True, integer_product)
    none = df.where("false")
    assert topk.top_products(none, none).count() == 0


@pytest.mark.parametrize("dim", [1, 3, 7, 33, 64])
def test_top_products_in_small_blocks(spark, monkeypatch, dim):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(dim)
    centre = rng.normal(size=(8, dim))
    rows = [(i, (centre[i % 8] + 0.2 * rng.normal(size=dim)).tolist(), 0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = rows_of(topk.top_products(df, df.where("vec_id % 50 = 0")))
    assert got == brute(rows, True, integer_product)


@pytest.mark.parametrize("width", [1, 2, 20])
def test_bounds_hold(width):
    rng = np.random.default_rng(width)
    a, b = rng.normal(size=(50, 1, width)) * 100, rng.normal(size=(1, 60, width)) * 100
    b[0, :10] = a[:10, 0]
    bound = topk.rest_bound(a.sum(2), (a * a).sum(2), b.sum(2), (b * b).sum(2), width)
    assert (bound >= (a * b).sum(2) - 1e-6).all()


@pytest.mark.parametrize("folder, most", [("sf0.01", 0.75), ("sf0.1", 0.5)])
def test_bounds_save_products(folder, most):
    """Of the products of a full search, in one block without a bound from other blocks."""
    data = pq.read_table(f"/root/testdata/{folder}/embeddings.parquet").to_pandas()
    x, ids = topk.quantised(np.array(data.embedding.tolist(), float)), data.vec_id.to_numpy()
    block = topk.Block(x, ids, 5)
    asked = np.flatnonzero(ids % 50 == 0)
    for i in asked:
        score = (x @ x[i]).astype(np.int64)
        order = np.lexsort((ids, -score))
        order = order[order != i][:5]
        got = block.best(x[i], ids[i], -np.inf)
        assert got[:, 1].tolist() == ids[order].tolist() and got[:, 2].tolist() == score[order].tolist()
    assert block.products <= most * len(asked) * x.size
    before = block.products
    for i in asked:
        # with the final bound, as most blocks have it
        got = block.best(x[i], ids[i], np.sort(x @ x[i])[-6])
        assert len(got) == 5
    assert block.products - before <= (most - 0.04) * len(asked) * x.size


def test_top_products_of_the_largest_numbers(spark):
    rows = [(i, [1e308 * (-1) ** i, 1.0, float(i)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rows_of(topk.top_products(df, df.where("vec_id % 50 = 0")))
    assert got[0] == [(i, 2**63 - 1) for i in (2, 4, 6, 8, 10)]


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = ann.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
    assert np.allclose(ann.hadamard(y), x)


def test_probes_start_with_the_own_cell():
    y = ann.rotated(np.random.default_rng(0).normal(size=(40, 10)), 3)
    first, second = ann.cells(y)
    a, b = ann.probes(y, 5)
    assert (a[:, 0] == first).all() and (b[:, 0] == second).all()


def test_all_probes_find_the_exact_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 50)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    df, rows = edge_vectors(spark)

    def cosine(x, y):
        return float(ann.cosine(x[None], y[None])[0])

    got = rows_of(ann.nearest_neighbours(df, df.where("vec_id % 50 = 0"), tables=1, count=10_000))
    want = brute(rows, False, cosine)
    assert got.keys() == want.keys()
    for q, best in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in best]
        assert np.allclose([s for _, s in got[q]], [s for _, s in best], rtol=0, atol=1e-15)
    none = df.where("false")
    assert ann.nearest_neighbours(none, none).count() == 0


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = df.toPandas()
    x, ids = np.array(data.embedding.tolist(), float), data.vec_id.to_numpy()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.flatnonzero(ids % 50 == 0)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -2
    true = {ids[q]: set(ids[np.argsort(-near[n])[:5]]) for n, q in enumerate(asked)}
    got = rows_of(ann.nearest_neighbours(df, df.where("vec_id % 50 = 0")))
    hits = sum(len(true[q] & {i for i, _ in got[q]}) for q in true)
    assert hits >= 0.9 * 5 * len(true)


@pytest.mark.parametrize("count, dim", [(3, 64), (10, 64), (20, 300)])
def test_small_tables_are_found_whole(spark, count, dim):
    """With the default parameters, all neighbours in tables smaller or little larger than k."""
    rng = np.random.default_rng(count)
    rows = [(i, rng.normal(size=dim).tolist(), 0) for i in range(count)] + [(100, [1.0, 2.0], 0), (101, [2.0, -1.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = rows_of(ann.nearest_neighbours(df, df))
    for i in range(count):
        assert len(got[i]) == min(5, count - 1)
    assert [j for j, _ in got[100]] == [101] and [j for j, _ in got[101]] == [100]


def test_wide_vectors_keep_their_recall():
    """Probed cells hold the neighbours of clustered vectors of 768 dimensions."""
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(200, 768))
    x = centre[np.arange(2000) % 200] + 0.5 * rng.normal(size=(2000, 768))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit[:20] @ unit.T
    near[np.arange(20), np.arange(20)] = -2
    true = np.argsort(-near, axis=1)[:, :5]
    hit = np.zeros(true.shape, bool)
    for t in range(ann.TABLES):
        y = ann.rotated(x, t)
        first, second = ann.cells(y)
        a, b = ann.probes(y[:20], ann.PROBES)
        for q in range(20):
            looked = set(zip(a[q], b[q]))
            hit[q] |= [(first[j], second[j]) in looked for j in true[q]]
    assert hit.mean() >= 0.9
