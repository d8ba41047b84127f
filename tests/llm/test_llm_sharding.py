from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from edge_rows import edge_documents, empty_documents

from riskweave.llm import sharding


def check(docs, shards=8):
    rows = sharding.interleaved(docs, shards=shards).collect()
    texts = docs.select("doc_id", "text").collect()
    want = [(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in texts]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r["size"], r.text_crc32)) for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return rows


def test_every_shard_has_the_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = check(docs)
    source = {r.doc_id: r.source for r in docs.collect()}
    n = Counter(source.values())
    mix = Counter((source[r.doc_id], r.shard) for r in rows)
    assert all(abs(mix[s, k] - n[s] / 8) <= 2 for s in n for k in range(8))


def test_seed_and_shard_count(spark):
    docs = spark.range(1000).selectExpr("id as doc_id", "'t' as text", "if(id < 700, 'a', null) as source")
    one = {r.doc_id: (r.shard, r.slot) for r in check(docs, 3)}
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.interleaved(docs.repartition(5), shards=3).collect()}
    other = {r.doc_id: (r.shard, r.slot) for r in sharding.interleaved(docs, shards=3, seed=1).collect()}
    assert one == again != other


def test_edge_rows(spark):
    docs = edge_documents(spark)
    check(docs)
    check(docs, 64)
    assert sharding.interleaved(empty_documents(spark)).count() == 0
    same = spark.range(500).selectExpr("cast(7 as long) as doc_id", "'t' as text", "'a' as source")
    check(same)
