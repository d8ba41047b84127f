from __future__ import annotations

import hashlib
import random

import pytest
from edge_rows import edge_documents, empty_documents

from riskweave.llm import bpe


@pytest.fixture(scope="module")
def encoder():
    return bpe.ByteEncoder()


def want(encoder, text):
    ids = encoder.encoding.encode_ordinary(text or "")
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), digest(" ".join(map(str, ids)).encode()), digest((text or "").encode())


def noise(rng, n):
    return "".join(rng.choice("ab '\n  12,.!é s日") * rng.choice([1, 1, 1, 2, 9, 40]) for _ in range(n))


def test_encoder_equals_the_library(encoder):
    rng = random.Random(1)
    for text in ["", " " * 3000 + "a", "a" * 3000, "é😀 ñ ' 's", "\x00 \t z"] + [noise(rng, 40) for _ in range(300)]:
        ids = encoder.encode(text)
        assert [int(i) for i in ids.split()] == encoder.encoding.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_a_full_memo_changes_nothing(encoder):
    small, text = bpe.ByteEncoder(memo_entries=3), noise(random.Random(2), 200)
    assert small.encode(text) == encoder.encode(text)


def test_pieces_of_overlapping_chunks(encoder):
    rng, several = random.Random(3), 0
    for _ in range(1500):
        text = noise(rng, rng.randint(1, 120))
        chunk, overlap = rng.choice([10, 30, 64]), rng.choice([3, 8, 20])
        n = -(-len(text) // chunk)
        edges = [
            (k, *bpe.chunk_edges(text[k * chunk : k * chunk + chunk + overlap], k, k == n - 1, chunk, overlap, encoder.boundaries))
            for k in range(n)
        ]
        cuts = bpe.piece_cuts(edges)
        pieces = [text[a:b] for a, b in zip(cuts, cuts[1:] + [None])]
        several += len(pieces) > 1
        assert "".join(map(encoder.encode, pieces)) == encoder.encode(text)
    assert several > 50


def check(encoder, docs, **options):
    rows = bpe.encode_documents(docs, **options).collect()
    texts = docs.select("doc_id", "text").collect()
    expected = [(r.doc_id, *want(encoder, r.text)) for r in texts]
    assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in rows)


def test_documents_and_edge_rows(spark, encoder):
    rng = random.Random(4)
    long = [(20 + i, noise(rng, 3000), "en", "a", 1) for i in range(4)]
    long += [(30, "a" * 9000, "en", "a", 1), (31, " " * 9000, "en", "a", 1), (32, " " * 9000 + "x", "en", "a", 1)]
    docs = edge_documents(spark, long)
    check(encoder, docs)
    check(encoder, docs, chunk=500, overlap=40)
    check(encoder, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), chunk=1000, overlap=64)
    assert bpe.encode_documents(empty_documents(spark)).count() == 0


def test_long_texts_are_cut_into_pieces(spark):
    text = "some words, and 12 numbers of ordinary text. " * 2000
    docs = spark.createDataFrame([(0, text)], "_row long, text string")
    pieces = bpe.encoded_pieces(docs, "text", chunk=2000, overlap=100).orderBy("at").collect()
    assert len(pieces) == -(-len(text) // 2000)
    assert b"".join(bytes(p.raw) for p in pieces).decode() == text
