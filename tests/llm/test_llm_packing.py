from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from edge_rows import LONG, edge_documents, empty_documents

from riskweave.llm import packing


@pytest.fixture(scope="module")
def encoder():
    return packing.WordEncoder()


def whole(encoder, text):
    return encoder.tokenizer.encode(text, add_special_tokens=False).ids


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


def test_encoder_equals_the_tokenizer(encoder):
    rng = random.Random(1)
    texts = ["", "<|endoftext|> a", "İ Σας", "it's 12½ 'LL 're", "a\x1cb\x85c\xa0d", "é é", LONG[:500]]
    texts += ["".join(chr(rng.randrange(256)) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += ["".join(rng.choice("ab'sS 1!é\n日") for _ in range(rng.randint(1, 40))) for _ in range(400)]
    for t in texts:
        assert ids_of(encoder, t) == whole(encoder, t), repr(t)


def test_a_full_memo_changes_nothing(encoder):
    small = packing.WordEncoder(memo_entries=5)
    for t in ["a b c d e f g h", "h g f, e d c b a", "x y", "a b c d e f g h"]:
        assert small.encode(t) == encoder.encode(t)


@pytest.mark.parametrize("n", [0, 1, 2, 50, 3000])
def test_best_two_fit_is_a_packing(n):
    lengths = np.random.default_rng(n).integers(1, 101, n)
    number, offset = packing.best_two_fit(lengths, 100)
    fill = {}
    for k, at, size in sorted(zip(number.tolist(), offset.tolist(), lengths.tolist())):
        assert at == fill.get(k, 0)
        fill[k] = at + size
    assert all(f <= 100 for f in fill.values())
    if n == 3000:
        assert len(fill) <= 1.01 * (lengths.sum() / 100) + 1


def test_two_documents_replace_a_smaller_one():
    # greedy fills 60 + 20 and leaves a gap of 20; 21 and 19 fit in place of the 20
    number, _ = packing.best_two_fit(np.array([60, 21, 20, 19]), 100)
    assert number[0] == number[1] == number[3] or len(set(number.tolist())) == 2
    number, _ = packing.best_two_fit(np.array([60, 30, 25, 15, 15, 55]), 100)
    assert len(set(number.tolist())) == 2


def test_pieces_cover_every_document(spark, encoder):
    docs = edge_documents(spark)
    rows = packing.pack(docs, pool_rows=4).collect()
    texts = [(r.doc_id, whole(encoder, r.text or "") + [0]) for r in docs.collect()]
    want = []
    for doc, ids in texts:
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want.append((doc, piece, at, len(part), zlib.crc32(part.tobytes())))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048
    assert packing.pack(empty_documents(spark)).count() == 0


def test_ids_can_be_kept(spark, encoder):
    docs = spark.createDataFrame([("x", "some words here")], "name string, body string")
    row = packing.tokenized_pieces(docs, "name", "body", with_ids=True).first()
    assert row.name == "x"
    assert np.frombuffer(row.ids, "<u4").tolist() == whole(encoder, "some words here") + [0]
