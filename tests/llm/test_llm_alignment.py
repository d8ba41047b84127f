from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from edge_rows import edge_documents, empty_documents

from riskweave.llm import alignment


@pytest.fixture(scope="module")
def both():
    return alignment.TwoEncoders()


def library(both, text):
    """Ids of both libraries for the whole text, or None."""
    if not text:
        return None
    a = both.a.encode(" " + text, add_special_tokens=False).ids
    b = both.b.encode(text)
    whole = (" " + text).encode()
    same = b"".join(both.bytes_a[i] for i in a) == whole == b"".join(both.bytes_b[i] for i in b)
    return (a, b) if same else None


def plain_groups(both, a, b):
    ea, eb = np.cumsum(both.length_a[a]), np.cumsum(both.length_b[b])
    common = np.intersect1d(ea, eb)
    cut_a, cut_b = ((np.searchsorted(e, common) + 1).tolist() for e in (ea, eb))
    return list(zip([0, *cut_a], cut_a, [0, *cut_b], cut_b))


def plain_report(both, rows):
    """One row per document, everything worked out anew."""
    aligned, links = [], Counter()
    for doc, text in rows:
        ids = library(both, text)
        groups = plain_groups(both, *ids) if ids else []
        own = [(ids[0][q - 1], ids[1][s - 1]) for _, q, _, s in groups]
        links.update(own)
        aligned.append((doc, ids, groups, own))
    best = Counter()
    for (_, b), n in links.items():
        best[b] = max(best[b], n)
    out = []
    for doc, ids, groups, own in aligned:
        digest = ""
        if groups:
            names = lambda x: ",".join(map(str, x))
            text = ";".join(f"{names(ids[0][p:q])}|{names(ids[1][r:s])}" for p, q, r, s in groups)
            digest = hashlib.sha256(text.encode()).hexdigest()
        n = [len(ids[0]), len(ids[1])] if ids else [0, 0]
        hits = sum(links[x] == best[x[1]] for x in own)
        out.append((str(doc), *n, len(groups), len(own), hits, sum(links[x] for x in own), digest))
    return sorted(out)


def report(docs, **options):
    rows = alignment.alignment_report(docs, **options).collect()
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((str(r.doc_id), *[r[n] for n in names]) for r in rows)


AWKWARD = [
    "<|endoftext|> in a text", "<s> and </s> <unk>", "<0x41>", "a▁b", "▁", "trailing space ", "two  spaces", " ", "  ",
    " lead", "\n", "a \n b", "a\x1c b", "tab\t x", "nbsp\xa0 y\xa0", "é😀 日本語 नमस्ते", "\x00", "a　 b", "é",
    "x" * 500, " " * 300, "don't they're 12345 ...!!!", "ﬁ ½ Ⅷ", "﻿bom", "a\r\n b \r",
]


def noise(rng):
    return "".join(rng.choice("ab 'é\n  12,.!s日▁　\x1c\t") * rng.choice([1, 1, 1, 2, 7]) for _ in range(rng.randint(1, 60)))


def test_encoders_equal_the_libraries(both):
    rng = random.Random(1)
    for text in AWKWARD + [noise(rng) for _ in range(800)]:
        want, slabs = library(both, text), both.encode(text)
        if want is None:
            assert slabs == [], text
        else:
            assert [i for s in slabs for i in s[0].tolist()] == want[0], text
            assert [i for s in slabs for i in s[1].tolist()] == want[1], text
    assert both.encode(None) == both.encode("") == []


def test_slow_path_and_full_memo_change_nothing(both):
    small = alignment.TwoEncoders(memo_entries=3)
    assert small.fast is not None
    text = noise(random.Random(2)).replace("▁", "") + " some words and more"
    same = lambda x, y: all((p == q).all() for s, t in zip(x, y) for p, q in zip(s, t))
    assert same(small.encode(text), both.encode(text))
    small.fast = None
    small.memo.clear()
    assert same(small.encode(text), both.encode(text))


def test_runs_and_groups_by_hand():
    assert alignment.run_length([1, 2, 3, 9], [1, 2, 3, 8], 0, 0) == 3
    assert alignment.run_length([5], [5], 0, 0) == 1
    assert alignment.run_length([4, 5], [5], 0, 0) == 0
    assert alignment.run_length([1, 2], [1, 2, 3], 0, 0) == 2
    # an index shift of one that the run goes on with
    assert alignment.align([1, 2, 4, 6, 9], [2, 4, 6, 7, 9]) == ([0], [3])


def test_alignment_equals_set_intersection():
    rng = random.Random(3)
    for _ in range(600):
        n = rng.randint(1, 300)
        ends = [sorted(set(rng.sample(range(1, n + 1), int(n * rng.random()))) | {n}) for _ in range(2)]
        if rng.random() < 0.4:  # long one-to-one stretches
            ends[1] = sorted(set(ends[0]) ^ set(rng.sample(range(1, n + 1), min(2, n - 1)))) or [n]
            ends[1] = sorted({*ends[1], n})
        common = sorted(set(ends[0]) & set(ends[1]))
        got = alignment.align(*ends)
        assert got == tuple([e.index(c) for c in e if c not in set(common)] for e in ends)


def test_probing_is_exponential():
    """A stretch of n tokens takes a number of slices that grows with log n."""

    class Counted(list):
        slices = 0

        def __getitem__(self, at):
            Counted.slices += isinstance(at, slice)
            return super().__getitem__(at)

    ends = Counted(range(1, 100_001))
    assert alignment.run_length(ends, list(ends), 0, 0) == 100_000
    assert Counted.slices < 20


def test_reports(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain_report(both, [(r.doc_id, r.text) for r in docs.collect()])
    assert report(docs) == want
    # many small blocks give the same counts
    assert report(docs, block_links=500, block_documents=3) == want


def test_edge_rows(spark, both):
    rng = random.Random(4)
    extra = [(100 + i, t, "en", "a", 1) for i, t in enumerate(AWKWARD + [noise(rng) for _ in range(40)])]
    docs = edge_documents(spark, extra)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert report(docs) == plain_report(both, rows)
    assert report(empty_documents(spark)) == []
    named = docs.selectExpr("cast(doc_id as string) as doc_id", "text", "1 as block", "2 as pair", "3 as links", "4 as n")
    assert report(named, block_links=50) == plain_report(both, rows)


def test_slabs_of_a_long_text(spark, both, monkeypatch):
    text = "some words, and 12 numbers of ordinary text. " * 300
    whole = both.encode(text)
    monkeypatch.setattr(alignment, "SLAB", 7)
    parts = both.encode(text)
    assert len(parts) > 100
    for k in (0, 1):
        assert [i for s in parts for i in s[k].tolist()] == whole[0][k].tolist()
    joined = b";".join(alignment.groups_text(both, s, alignment.groups_of(both, s)) for s in parts)
    assert joined == alignment.groups_text(both, whole[0], alignment.groups_of(both, whole[0]))


def test_aligned_documents(spark, both):
    docs = spark.createDataFrame([(1, "some words déjà vu"), (2, None), (3, "a▁b")], "doc_id long, text string")
    rows = {r.doc_id: r for r in alignment.aligned_documents(docs).collect()}
    a, b = library(both, "some words déjà vu")
    assert (rows[1].a_ids, rows[1].b_ids) == (a, b)
    groups = plain_groups(both, a, b)
    assert rows[1].a_ends == [g[1] for g in groups] and rows[1].b_ends == [g[3] for g in groups]
    assert rows[2].a_ids == rows[3].b_ends == []
