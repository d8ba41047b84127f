"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints that differ in at most `distance` bits
agree in some segment up to a small radius, so the Hamming ball of that radius around each
segment is enumerated, matching table rows are fetched, and whole distances are verified inside
the join. With `distance = segments * a + b`, the first b + 1 segments need radius a and the
others radius a - 1. Fewer segments mean longer keys, so fewer false matches, and more probes.

Joins are sort-merge joins by hint. Left to itself Spark sizes a table by its file: a few MB of
fingerprints look small enough to broadcast, also when an array of keys is made of each of them.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.components import connected_components
from riskweave.llm.rows import unwrapped, wrapped
from riskweave.session import store

WORDS = 4
SEED = 42
DISTANCE = 4
SEGMENTS = 3
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BLOCK = 1 << 20


def _word_blocks(data: bytes):
    """Lists of words from about a megabyte of text each; no word is cut."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + _BLOCK)
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included.

    Lower-cases A-Z only. Fewer words than a shingle has: the whole sequence is one shingle.
    No word at all, or null: zero.
    """
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    votes, total, tail = np.zeros(64, np.int64), 0, []
    for block in _word_blocks(data):
        words = tail + block
        n = len(words)
        if n < WORDS:
            tail = words
            continue
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: n - WORDS + 1].tolist()
        digest = xxhash.xxh64_digest
        hashes = b"".join(
            [digest(joined[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :].tolist())]
        )
        votes += _votes(hashes)
        total += n - WORDS + 1
        tail = words[n - WORDS + 1 :]
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int.from_bytes(np.packbits(2 * votes > total).tobytes(), "big")


def _votes(hashes: bytes) -> np.ndarray:
    """How often each bit is set, the highest first."""
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(rows), 1 << 14):
        votes += np.unpackbits(rows[i : i + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return votes


@F.pandas_udf(T.LongType())
def fingerprint_column(text: pd.Series) -> pd.Series:
    found = np.fromiter((fingerprint(t) for t in text), np.uint64, len(text))
    return pd.Series(found.view(np.int64))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def segment_widths(segments: int, bits: int = 64) -> list[int]:
    return [bits // segments + (i >= segments - bits % segments) for i in range(segments)]


def probe_radii(segments: int, distance: int) -> list[int]:
    """Radius of each segment's ball; below zero: that segment needs no probe."""
    a, b = divmod(distance, segments)
    return [a if i <= b else a - 1 for i in range(segments)]


def _ball(width: int, radius: int) -> list[int]:
    """Bit masks of at most `radius` set bits."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _probes(segment: int, key: Column, masks: list[int]) -> Column:
    ball = F.array(*[F.lit(_signed(m)).cast("long") for m in masks])
    return F.transform(
        ball, lambda m: F.struct(F.lit(segment).alias("segment"), key.bitwiseXOR(m).alias("key"))
    )


def _table_and_probes(fingerprints: DataFrame, distance: int, segments: int) -> tuple[DataFrame, DataFrame]:
    """Two tables of (segment, key) with the columns of `fingerprints` as `row`: the keys of each
    `fp`, and all keys that one at `distance` or less may have in a segment."""
    tables, probes, shift = [], [], 0
    for i, (width, radius) in enumerate(
        zip(segment_widths(segments), probe_radii(segments, distance))
    ):
        key = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(_signed((1 << width) - 1)))
        shift += width
        if radius < 0:
            continue
        tables.append(F.struct(F.lit(i).alias("segment"), key.alias("key")))
        probes.append(_probes(i, key, _ball(width, radius)))
    row = F.struct("*").alias("row")
    table = fingerprints.select(row, F.inline(F.array(*tables)))
    return table, fingerprints.select(row, F.inline(F.flatten(F.array(*probes))))


def _near(a: Column | str, b: Column | str, distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def hamming_links(
    fingerprints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS
) -> DataFrame:
    """(u, v), u < v: all pairs of the distinct BIGINT `fp` at `distance` differing bits or fewer.

    A pair may appear more than once. Only verified pairs leave the join.
    """
    table, probe = _table_and_probes(fingerprints.select("fp"), distance, segments)
    met = probe.select("segment", "key", F.col("row.fp").alias("u")).hint("merge").join(
        table.select("segment", "key", F.col("row.fp").alias("v")), ["segment", "key"]
    )
    return met.where((F.col("u") < F.col("v")) & _near("u", "v", distance)).select("u", "v")


def first_links(fingerprints: DataFrame, distance: int, segments: int) -> DataFrame:
    """(u, v), at most one for each `fp` u: the smallest v among the smallest fingerprints of the
    buckets that u looks up, where it is at `distance` or less. The work is a row per probe,
    however many fingerprints a bucket holds."""
    table, probe = _table_and_probes(fingerprints.select("fp"), distance, segments)
    lowest = table.groupBy("segment", "key").agg(F.min("row.fp").alias("v"))
    met = probe.select("segment", "key", F.col("row.fp").alias("u")).hint("merge").join(lowest, ["segment", "key"])
    return met.where((F.col("u") > F.col("v")) & _near("u", "v", distance)).groupBy("u").agg(F.min("v").alias("v"))


def crossing_links(grouped: DataFrame, distance: int, segments: int) -> DataFrame:
    """(u, v), u < v, each once: the pairs of groups that a link joins. `grouped`: (fp, root).

    Pairs inside a group end in the join, and equal pairs of groups are made one before the
    shuffle.
    """
    table, probe = _table_and_probes(grouped.select("fp", "root"), distance, segments)
    met = probe.select("segment", "key", F.col("row.fp").alias("a"), F.col("row.root").alias("u")).hint("merge").join(
        table.select("segment", "key", F.col("row.fp").alias("b"), F.col("row.root").alias("v")), ["segment", "key"]
    )
    return met.where((F.col("u") < F.col("v")) & _near("a", "b", distance)).select("u", "v").distinct()


def fingerprint_roots(distinct: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(fp, root) for distinct `fp`: fingerprints that links join, over any number of them, have
    the same root, one of them.

    Links are followed in two steps, so that a dense family of k fingerprints does not write its
    k^2 / 2 pairs: first one link for each fingerprint, contracted; then only links between what
    is still apart.
    """
    fps = distinct.select("fp")
    parts = connected_components(first_links(fps, distance, segments))
    grouped = store(_rooted(fps, F.col("fp"), parts).select("fp", "root"), "groups")
    joined = connected_components(crossing_links(grouped, distance, segments))
    grouped = grouped.withColumnRenamed("root", "part")
    return _rooted(grouped, F.col("part"), joined).select("fp", "root")


def _rooted(rows: DataFrame, node: Column, components: DataFrame) -> DataFrame:
    return rows.hint("merge").join(components, node == components.node, "left").withColumn("root", F.coalesce("root", node))


def fingerprint_groups(
    marked: DataFrame, id_column: str, distance: int = DISTANCE, segments: int = SEGMENTS
) -> DataFrame:
    """(fp, root, component_id) for each distinct `fp` of `marked`.

    `root` names the component by one of its fingerprints; `component_id` is the smallest
    non-null id in it, null only if all its ids are null.
    """
    distinct = store(marked.groupBy("fp").agg(F.min(id_column).alias("low")), "fingerprints")
    rooted = distinct.hint("merge").join(fingerprint_roots(distinct, distance, segments), "fp")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.select("fp", "root").hint("merge").join(lows, "root")


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    distance: int = DISTANCE,
    segments: int = SEGMENTS,
) -> DataFrame:
    """(id, fingerprint, component_id), a row for each row of `docs`.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows keep one
    row each. A null id takes part and never names a component that has other ids. Other
    columns are not read. An empty table gives an empty result.
    """
    marked = store(
        docs.select(F.col(id_column).alias("id"), fingerprint_column(F.col(text_column)).alias("fp")),
        "simhash",
    )
    groups = fingerprint_groups(marked, "id", distance, segments)
    return marked.hint("merge").join(groups, "fp").select(
        F.col("id").alias(id_column), hex_digits(F.col("fp")).alias("fingerprint"), "component_id"
    )


def keep_first(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    distance: int = DISTANCE,
    segments: int = SEGMENTS,
) -> DataFrame:
    """`docs` with one row of each group of near-duplicates: the one with the smallest id.

    Of repeated rows one stays; a group whose ids are all null keeps one row.
    """
    marked = store(
        wrapped(
            docs,
            id=F.col(id_column),
            fp=fingerprint_column(F.col(text_column)),
            row=F.monotonically_increasing_id(),
        ),
        "marked",
    )
    groups = fingerprint_groups(marked.select("id", "fp"), "id", distance, segments).select(
        F.col("fp").alias("group_fp"), "root", "component_id"
    )
    # the rows to keep are chosen among narrow ones; whole rows are joined once
    first = marked.select("id", "fp", "row").hint("merge").join(
        groups, (F.col("fp") == F.col("group_fp")) & F.col("id").eqNullSafe(F.col("component_id"))
    )
    kept = first.groupBy("root").agg(F.min("row").alias("row"))
    return unwrapped(marked.join(kept, "row", "left_semi"), docs)
