"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by its SHA-256. The ledger holds, per blob, which rule
versions have read it and what they found. A scan reads only blobs with rule versions that the
ledger lacks, each blob once however many paths hold it, and joins the findings back to all
paths. A rule whose version rises is scanned anew, the others are not.

Everything on this path is SQL expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.rows import DOC, unwrapped, wrapped
from riskweave.llm.spans import match_spans, replace_spans, span_text
from riskweave.session import store


@dataclass(frozen=True)
class Rule:
    """A pattern; `least` code points in the whole match, or in group `group` if given.

    Matches that are too short are found first and dropped then, so they hide what they cover.
    `contains`: strings of which a text with a match holds one, to pass over other texts.
    """

    kind: str
    pattern: str
    version: int = 1
    least: int = 0
    group: int = 0
    contains: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Loops over single characters only, which the regular expression engine runs without recursion.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=6,
        group=2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, contains=("AKIA",)),
    # the same as matches of [0-9a-f]+ of 24 or more characters, which can't overlap
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", contains=("eyJ",)),
    Rule(
        "pem",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?",
        contains=("PRIVATE KEY",),
    ),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", contains=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", contains=("xox",)),
    # a run holds no "/", so none is read again from a later "://"
    Rule("url", r"://[^\s:/@]+:[^\s/@]+@", version=2, contains=("://",)),
)
RULES = BASE_RULES + MORE_RULES
MARK = "[SECRET]"

_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
LEDGER_SCHEMA = f"blob string, rules array<string>, spans {_SPANS}"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    found = match_spans(text, rule.pattern)
    if rule.least:
        part = (
            (lambda s: F.regexp_extract(s["hit"], rule.pattern, rule.group))
            if rule.group
            else (lambda s: s["hit"])
        )
        found = F.filter(found, lambda s: F.length(part(s)) >= rule.least)
    found = F.transform(
        found,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), s["end"].alias("end")
        ),
    )
    none = F.array().cast(_SPANS)
    if rule.contains:
        may = F.lit(False)
        for part in rule.contains:
            may = may | F.contains(text, F.lit(part))
        found = F.when(may, found).otherwise(none)
    return found


def scan_blobs(
    docs: DataFrame,
    ledger: DataFrame | None = None,
    rules: Sequence[Rule] = RULES,
    text_column: str = "text",
) -> DataFrame:
    """New ledger rows: a row for each blob of `docs` that some rule version has not read.

    `rules` names the rule versions that read it now, `spans` what they found (with positions
    in code points, end exclusive). A null text is an empty one.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    blobs = docs.select(blob_of(F.col(text_column)).alias("blob"), text.alias("_text"))
    every = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        todo = blobs.dropDuplicates(["blob"]).withColumn("rules", every)
    else:
        read = (
            ledger.select("blob", F.explode("rules").alias("rule"))
            .where(F.col("rule").isin([r.key for r in rules]))
            .groupBy("blob")
            .agg(F.collect_set("rule").alias("_read"))
        )
        done = read.where(F.size("_read") == len(rules)).select("blob")
        todo = (
            # copies go before the joins, so that a text of many rows is one row there
            blobs.dropDuplicates(["blob"])
            .join(done, "blob", "left_anti")
            .join(read, "blob", "left")
            .withColumn("rules", F.array_except(every, F.coalesce("_read", F.array().cast("array<string>"))))
        )
    none = F.array().cast(_SPANS)
    parts = [
        F.when(
            F.array_contains("rules", r.key), _rule_spans(F.col("_text"), r, i)
        ).otherwise(none)
        for i, r in enumerate(rules)
    ]
    return todo.select("blob", "rules", F.array_sort(F.concat(*parts)).alias("spans"))


def current_findings(ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, spans) of the blobs in which the given rule versions found something."""
    keys = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.key)])
    current = F.filter(
        "spans", lambda s: F.array_contains(F.col("rules"), F.coalesce(F.try_element_at(keys, s["kind"]), F.lit("")))
    )
    rows = ledger.select("blob", current.alias("spans")).where(F.size("spans") > 0)
    return rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def scan(
    docs: DataFrame,
    ledger: DataFrame | None = None,
    rules: Sequence[Rule] = RULES,
    text_column: str = "text",
    name: str = "spans",
) -> tuple[DataFrame, DataFrame]:
    """`docs` with an array of findings in column `name`, and the ledger rows to add.

    Only blobs that the ledger lacks are read. Spans are sorted by start, then by the order of
    `rules`. Rows without a finding get an empty array; null and empty texts, repeated rows and
    rows with null ids are kept, and an empty table gives an empty result.
    """
    added = store(scan_blobs(docs, ledger, rules, text_column), "ledger")
    whole = added if ledger is None else ledger.select("blob", "rules", "spans").unionByName(added)
    findings = current_findings(whole, rules).select(F.col("blob").alias("found_blob"), "spans")
    joined = wrapped(docs, blob=blob_of(F.col(text_column))).join(
        findings, F.col("blob") == F.col("found_blob"), "left"
    )
    spans = F.coalesce("spans", F.array().cast(_SPANS))
    return unwrapped(joined, docs, **{name: spans}), added


def read_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger kept in a folder, all instalments of it; None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(LEDGER_SCHEMA).parquet(folder)


def scan_into(
    docs: DataFrame,
    folder: str,
    rules: Sequence[Rule] = RULES,
    text_column: str = "text",
    name: str = "spans",
) -> DataFrame:
    """`scan` against the ledger kept in `folder`, which gets the new rows as one more instalment.

    An instalment that fails leaves nothing behind, and one that is run again finds nothing left
    to read.
    """
    spark = docs.sparkSession
    scan_blobs(docs, read_ledger(spark, folder), rules, text_column).write.mode("append").parquet(folder)
    findings = current_findings(read_ledger(spark, folder), rules).select(F.col("blob").alias("found_blob"), "spans")
    joined = wrapped(docs, blob=blob_of(F.col(text_column))).join(findings, F.col("blob") == F.col("found_blob"), "left")
    return unwrapped(joined, docs, **{name: F.coalesce("spans", F.array().cast(_SPANS))})


def report(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", ledger: str | None = None
) -> DataFrame:
    """Per row: id, counts of the base kinds, digest of the base spans, all spans as text.

    With the folder of a ledger only pairs of blob and rule version that it lacks are read."""
    slim = docs.select(F.col(id_column), F.col(text_column))
    if ledger is None:
        found, _ = scan(slim, text_column=text_column)
    else:
        found = scan_into(slim, ledger, text_column=text_column)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    counts = [
        F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
        for kind in [r.kind for r in BASE_RULES]
    ]
    return found.select(
        F.col(id_column),
        *counts,
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def redact(
    docs: DataFrame, text_column: str = "text", length_column: str | None = "n_chars"
) -> DataFrame:
    """`docs` with a mark in place of every secret; texts without one stay as they are.

    All rows and columns are kept; `length_column`, where the table has it, follows the text of
    the rows that change.
    """
    # own names: an output column of the same name would be taken for them inside expressions
    found, _ = scan(wrapped(docs, own_text=F.col(text_column)), text_column="own_text", name="own_spans")
    hit, old = F.size("own_spans") > 0, F.col("own_text")
    text = F.when(hit, replace_spans(old, F.col("own_spans"), MARK)).otherwise(old)
    changed = {text_column: text}
    if length_column in docs.columns:
        size = F.length(text).cast(docs.schema[length_column].dataType)
        changed[length_column] = F.when(hit, size).otherwise(F.col(DOC).getField(length_column))
    return unwrapped(found, docs, **changed)
