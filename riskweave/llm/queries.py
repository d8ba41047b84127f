"""Registered queries of the training-data operators, with SQL where it can express them.

Each query reads whole tables and takes its rows through its operator, with production
parameters; digests and counts of its columns are derived here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from riskweave.llm import (
    alignment,
    ann,
    bpe,
    codes,
    mixing,
    packing,
    pii,
    secrets,
    sharding,
    simhash,
    topk,
    toxicity,
    warc,
)
from riskweave.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op3_ann(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return ann.nearest_neighbours(rows, rows.where("vec_id % 50 = 0"))


def op4_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return topk.top_products(rows, rows.where("vec_id % 50 = 0"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
    max(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0 GROUP BY ALL
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


# what an earlier run read by: the rule of URLs was narrower before its second version
EARLIER_RULES = [
    replace(r, version=1, pattern=r"://[^\s:/@]{1,256}:[^\s/@]{1,256}@") if r.kind == "url" else r
    for r in secrets.RULES
]


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """The whole table against a ledger in which an earlier instalment of it, half of the rows,
    was read by earlier rules: their blobs are read again by the raised rule only."""
    docs, ledger = table(spark, folder, "documents"), scratch_path(spark, "secret-ledger")
    secrets.scan_into(docs.where(F.xxhash64("doc_id") >= 0), ledger, EARLIER_RULES)
    return secrets.report(docs, ledger=ledger)


# (kind, pattern, characters at least, group they are counted in), written apart from the operator
SECRETS_SQL = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),  # the same as runs of 24 or more, in fewer matches
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]*", 0, 0),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?", 0, 0),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("url", r"://[^\s:/@]+:[^\s/@]+@", 0, 0),
]


def _op5_sql() -> str:
    """Matches and what lies between them, per rule; their lengths added up are the positions."""
    found, spans = [], []
    for i, (kind, plain, least, group) in enumerate(SECRETS_SQL):
        pattern = "'" + plain.replace("'", "''") + "'"
        found.append(f"regexp_extract_all(t, {pattern}) AS h{i}, regexp_split_to_array(t, {pattern}) AS g{i}")
        start = (
            f"(list_sum(list_transform(g{i}[1:k], lambda x: length(x)))"
            f" + coalesce(list_sum(list_transform(h{i}[1:k - 1], lambda x: length(x))), 0))::BIGINT"
        )
        hit = f"regexp_extract(z.h, {pattern}, {group})" if group else "z.h"
        spans.append(
            f"list_filter(list_transform(range(1, len(h{i}) + 1), lambda k: "
            f"{{'s': {start}, 'r': {i}, 'k': '{kind}', 'h': h{i}[k]}}), "
            f"lambda z: length({hit}) >= {least})"
        )
    base = ["assign", "access", "hex"]
    counts = ", ".join(f"len(list_filter(a, lambda z: z.k = '{k}')) AS n_{k}" for k in base)
    text = "array_to_string(list_transform({}, lambda z: z.k || ':' || z.s || ':' || (z.s + length(z.h))), ',')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, {", ".join(found)} FROM d),
s AS (SELECT doc_id, list_sort(list_concat({", ".join(spans)})) AS a FROM m)
SELECT doc_id, {counts},
  sha256({text.format(f"list_filter(a, lambda z: z.r < {len(base)})")}) AS base_sha256,
  {text.format("a")} AS spans
FROM s
"""


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(table(spark, folder, "documents"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, folder, "pages"))


OP8_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest FROM pages
),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.interleaved(table(spark, folder, "documents"))
    return placed.withColumns(
        {"law": F.lit(sharding.LAW), "grown_shard": F.lit(None).cast("int")}
    )


OP9_SQL = """
WITH crc AS (
  SELECT list(c ORDER BY n) AS steps FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) t(n))
),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
    xor(4294967295, list_reduce(
      list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
        lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS text_crc32,
    md5((CASE WHEN source IS NULL THEN 'true' ELSE 'false' END) || coalesce(source, '')) AS stratum,
    ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k
  FROM documents, crc
),
r AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY k, doc_id, text_crc32, size) - 1 AS rk,
    count(*) OVER (PARTITION BY stratum) AS n FROM d
),
p AS (
  SELECT *, row_number() OVER (ORDER BY (2 * rk + 1) / (2 * n)::DOUBLE, stratum, rk) - 1 AS pos,
    count(*) OVER () AS total FROM r
),
s AS (
  SELECT *, CASE WHEN pos < (total % 8) * (total // 8 + 1) THEN pos // (total // 8 + 1)
    ELSE total % 8 + (pos - (total % 8) * (total // 8 + 1)) // greatest(total // 8, 1) END AS shard FROM p
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
  (pos - shard * (total // 8) - least(shard, total % 8))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM s
"""


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(table(spark, folder, "documents"))


def op11_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mix = mixing.mixed(table(spark, folder, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op12_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.compressed(table(spark, folder, "embeddings")).drop("label")


def _op12_sql() -> str:
    """Rounds of assignment and replacement, one after the other, in plain integer SQL."""
    distance = "list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = """WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS MATERIALIZED (
  SELECT vec_id, label, j, q[j * (len(q) // 8) + 1 : (j + 1) * (len(q) // 8)] AS v FROM k, range(8) r(j)
),
b0 AS MATERIALIZED (
  SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS e, v FROM p
  WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 16)
)"""
    for n in range(6):
        parts += f""",
a{n} AS MATERIALIZED (
  SELECT p.j, p.v, arg_min(b.e, struct_pack(d := {distance}, e := b.e)) AS e
  FROM p JOIN b{n} b ON p.j = b.j GROUP BY p.vec_id, p.j, p.v
),
m{n} AS MATERIALIZED (
  SELECT j, e, list(f ORDER BY i) AS v FROM (
    SELECT j, e, i, CAST(floor(sum(v[i])::DOUBLE / count(*)) AS BIGINT) AS f
    FROM (SELECT j, e, v, unnest(range(1, len(v) + 1)) AS i FROM a{n}) GROUP BY j, e, i) GROUP BY j, e
),
b{n + 1} AS MATERIALIZED (
  SELECT b.j, b.e, coalesce(m.v, b.v) AS v FROM b{n} b LEFT JOIN m{n} m ON b.j = m.j AND b.e = m.e
)"""
    return (
        parts
        + f""",
f AS MATERIALIZED (
  SELECT p.vec_id, any_value(p.label) AS label, p.j, min(struct_pack(d := {distance}, e := b.e)) AS z
  FROM p JOIN b6 b ON p.j = b.j GROUP BY p.vec_id, p.j
),
c AS (
  SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', z.e), '' ORDER BY j) AS code,
    sum(z.d)::BIGINT AS error FROM f GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY j, e)) FROM b6) AS codebooks_sha256
FROM c"""
    )


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.alignment_report(table(spark, folder, "documents"))


LLM_QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_ann": op3_ann,
    "op4_topk": op4_topk,
    "op5_secrets": op5_secrets,
    "op6_packing": op6_packing,
    "op7_pii": op7_pii,
    "op8_warc": op8_warc,
    "op9_sharding": op9_sharding,
    "op10_bpe": op10_bpe,
    "op11_mixing": op11_mixing,
    "op12_codes": op12_codes,
    "op13_alignment": op13_alignment,
    "pipeline": corpus_pipeline.run,
}
LLM_SQL: dict[str, str] = {
    "op4_topk": OP4_SQL,
    "op5_secrets": _op5_sql(),
    "op8_warc": OP8_SQL,
    "op9_sharding": OP9_SQL,
    "op12_codes": _op12_sql(),
}
