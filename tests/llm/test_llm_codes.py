from __future__ import annotations

import hashlib
from collections import defaultdict
from math import floor, isfinite

import numpy as np
import pytest

from riskweave.llm import codes


def plain(rows, parts=8, entries=16, rounds=6):
    """{(id, label): [(code, error)]} and the digest, with Python's whole numbers only."""
    kept = [(i, [floor(4096 * x) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(kept[0][1]) // parts
    cut = lambda v, k: v[k * width : (k + 1) * width]
    books = [[cut(v, k) for _, v, _ in kept[:entries]] for k in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        members = [defaultdict(list) for _ in range(parts)]
        for _, v, _ in kept:
            for k in range(parts):
                members[k][near(cut(v, k), books[k])[1]].append(cut(v, k))
        for k in range(parts):
            for e, some in members[k].items():
                books[k][e] = [sum(c) // len(some) for c in zip(*some)]
    out = []
    for i, v, c in kept:
        found = [near(cut(v, k), books[k]) for k in range(parts)]
        out.append((i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), c))
    label = defaultdict(int)
    for _, _, error, c in out:
        label[c] += error
    text = ",".join(str(x) for book in books for e in book for x in e)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return sorted((str(i), code, error, label[c], digest) for i, code, error, c in out)


def found(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = codes.compressed(df).collect()
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got)


def as_read(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]


def test_equals_whole_number_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    assert found(spark, rows) == plain(rows)


def test_copies_ties_and_bad_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(8 * i % 91, [float(x) for x in rng.integers(-3, 3, 16)], i % 3 or None) for i in range(91)]
    rows += [(200 + i, [1.0] * 16, 5) for i in range(300)]  # a hot label of copies
    rows += [rows[-1], rows[-1]]
    rows += [(0, None, 1), (1, [None] * 16, 1), (2, [float("nan")] * 16, 1), (3, [float("inf")] * 16, 1)]
    rows = [r for r in rows if r[0] != 50] + [(None, [0.5] * 16, None)]
    assert found(spark, rows) == plain(as_read(rows))


def test_few_rows_other_lengths_and_none(spark):
    few = [(i, [float(i)] * 8, None) for i in range(3)]
    assert found(spark, few) == plain(few)
    assert found(spark, []) == []
    other = [*few, (9, [1.0] * 16, 1), (10, [], 1), (11, [1.0] * 10, 1)]
    got = {r[0]: r for r in found(spark, other)}
    assert len(got) == 6 and got["10"][1] == "00" * 8 and got["11"][2] == 0
    assert [got[str(i)][:3] for i in range(3)] == [r[:3] for r in plain(few)]


def test_extra_columns_that_clash(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    more = df.selectExpr("*", "1 AS _id", "2 AS code", "3 AS dim", "4 AS vec", "5 AS error", "6 AS _part")
    key = lambda r: (r.vec_id, r.code, r.error)
    assert sorted(map(key, codes.compressed(more).collect())) == sorted(map(key, codes.compressed(df).collect()))


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30] * 8, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="too large"):
        codes.compressed(df).collect()


def test_masks_give_the_exact_nearest():
    rng = np.random.default_rng(3)
    for spread in (3, 50, 1 << 20):
        for n in (1, 2, 16, 64):
            book = codes.Codebook(rng.integers(-spread, spread, (n, 5)))
            x = rng.integers(-2 * spread, 2 * spread, (400, 5))
            every = ((x[:, None, :] - book.entries[None]) ** 2).sum(axis=2)
            for guess in (None, rng.integers(0, n, 400)):
                at, best = book.nearest(x, guess)
                assert (at == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()


def test_masks_leave_few_candidates():
    rng = np.random.default_rng(4)
    book = codes.Codebook(rng.integers(-1000, 1000, (16, 8)))
    x = book.entries[rng.integers(0, 16, 2000)] + rng.integers(-50, 50, (2000, 8))
    at, best = book.nearest(x)
    masks = book.candidates(x, np.sqrt(best).astype(np.int64) + 1)
    assert sum(bin(m).count("1") for m in masks.tolist()) < 2 * len(x)
