from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
import xxhash
from edge_rows import LONG, edge_documents, empty_documents
from pyspark.sql import functions as F

from riskweave.llm import simhash
from riskweave.llm.components import _large_star, _small_star, connected_components
from riskweave.session import store

SMALL = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, distance=4):
    """rows: (id, fingerprint). The smallest id that each row reaches."""
    parent = {f: f for _, f in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    found = sorted(parent)
    for i, a in enumerate(found):
        for b in found[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    low = defaultdict(list)
    for i, f in rows:
        if i is not None:
            low[find(f)].append(i)
    return [(i, format(f, "016x"), min(low[find(f)], default=None)) for i, f in rows]


@pytest.mark.parametrize(
    "text", [None, "", "  \t", "One", "a b c", "A b C d", "é É ß x\x0by\x1cz  w q", "w " * 500, "a b c d e f g"]
)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_of_blocks(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["x", "yy", "zzz"]) + str(rng.randint(0, 50)) for _ in range(3000))
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("segments", [1, 2, 3, 4, 5])
def test_links_are_all_pairs_within_the_distance(spark, segments):
    rng = random.Random(segments)
    found = set()
    while len(found) < 60:
        base = rng.getrandbits(64)
        for _ in range(4):
            found.add(base)
            for bit in rng.sample(range(64), rng.randint(1, 3)):
                base ^= 1 << bit
    distance = 2 if segments == 1 else 4
    signed = [(f - (1 << 64) if f >> 63 else f) for f in found]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {tuple(r) for r in simhash.hamming_links(df, distance, segments).distinct().collect()}
    wide = {f: f % (1 << 64) for f in signed}
    want = {
        (a, b) for a in signed for b in signed if a < b and (wide[a] ^ wide[b]).bit_count() <= distance
    }
    assert got == want


def test_dense_families_write_few_links(spark):
    """Two balls of variants and a chain: whole components, without a row for each linked pair."""
    rng = random.Random(7)

    def varied(fp):
        for bit in rng.sample(range(64), rng.randint(1, 4)):
            fp ^= 1 << bit
        return fp

    found = {rng.getrandbits(64) for _ in range(300)}
    for centre in (rng.getrandbits(64), 0):
        found |= {varied(centre) for _ in range(600)}
    link = rng.getrandbits(64)
    for _ in range(600):
        found.add(link)
        link = varied(link)
    want = {f: root for f, _, root in plain_components([(f, f) for f in found])}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in found}
    df = spark.createDataFrame([(f,) for f in signed.values()], "fp long")
    got = {r.fp: r.root for r in simhash.fingerprint_roots(df).collect()}
    assert len(got) == len(found)
    assert len({(want[f], got[signed[f]]) for f in found}) == len(set(want.values())) == len(set(got.values()))
    first = simhash.first_links(df, 4, 3)
    parts = simhash._rooted(df, df.fp, connected_components(first)).select("fp", "root")
    written = first.count() + simhash.crossing_links(parts, 4, 3).count()
    assert written <= len(found) < simhash.hamming_links(df).distinct().count() / 10


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200)]
    links += [(7, 7), (300, 300), (0, 1)]
    got = dict(connected_components(spark.createDataFrame(links, "u long, v long")).collect())
    want = {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)} | {201: 200, 202: 200}
    assert got == want
    none = spark.createDataFrame([], "u long, v long")
    assert connected_components(none).count() == 0


def test_groups_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    got = sorted(tuple(r) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted(plain_components(rows))


def test_edge_rows(spark):
    near = LONG.split()
    near[500] = "other"
    docs = edge_documents(spark, [(3, " ".join(near), "en", "a", 1)])
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    key = lambda r: tuple(map(str, r))
    want = sorted(plain_components(rows), key=key)
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=key) == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 3, 4, 8]
    assert kept.where("doc_id is null").count() == 1  # its text has no near copy
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0
    assert simhash.keep_first(empty_documents(spark)).count() == 0


def test_joins_broadcast_nothing(spark):
    """A few MB of fingerprints look small enough, but their keys are many times as large."""
    fps = store(spark.range(200).select(F.xxhash64("id").alias("fp")), "fps")
    grouped = fps.withColumn("root", F.col("fp"))
    marked = fps.withColumn("id", F.col("fp"))
    found = [
        simhash.hamming_links(fps),
        simhash.first_links(fps, 4, 3),
        simhash.crossing_links(grouped, 4, 3),
        simhash.fingerprint_groups(marked, "id"),
        _large_star(fps.select(F.col("fp").alias("u"), F.shiftright("fp", 1).alias("v"))),
        _small_star(fps.select(F.col("fp").alias("u"), F.shiftright("fp", 1).alias("v"))),
    ]
    for df in found:
        assert df.count() >= 0
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
