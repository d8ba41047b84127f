"""Personal data: generators propose spans, boosted trees judge them, thresholds select.

Generators of high recall propose spans, which may overlap. Spans that pass the strict check of
their kind are always kept. The others are judged by gradient-boosted trees on format and
context features. The trees learn from three quarters of all candidates with weak labels: strict
spans and what overlaps them count as personal, failed checks and spans inside longer tokens do
not. The threshold is the lowest probability at which the other quarter reaches the wanted
precision.

Everything on this path is SQL expressions and `pyspark.ml`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.spans import match_spans, replace_spans, span_text
from riskweave.session import store

PRECISION = 0.98
TREES, DEPTH, SEED = 10, 4, 42
BEFORE, AFTER = 24, 8
MARK = "[PII]"


@dataclass(frozen=True)
class Generator:
    """`kind` of the spans that pass the strict check, `loose` of others that the trees accept."""

    kind: str | None
    loose: str
    pattern: str
    contains: str = ""


# Strict kinds first, in the order of their names in results. Loops run over single characters
# or can't be left again, so the regular expression engine needs no recursion. Where a match
# could only start inside a run, a look-behind keeps it from trying.
GENERATORS = (
    Generator(
        "email", "email_like",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
    ),
    Generator("ip", "ip_like", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"),
    Generator("card", "card_like", r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+"),
    Generator("phone", "phone_like", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    Generator(
        None, "phone_local",
        r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    ),
    Generator(None, "id_number", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
    Generator(
        None, "email_words",
        r"(?i)[a-z0-9._%+-]{1,64}\x20?[(\[]at[)\]]\x20?[a-z0-9-]{1,64}(?:\x20?[(\[]dot[)\]]\x20?[a-z0-9-]{1,64}){1,4}",
    ),
)
BASE_KINDS = tuple(g.kind for g in GENERATORS if g.kind)
KINDS = BASE_KINDS + tuple(g.loose for g in GENERATORS)
_SMALL = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
_CUES = r"(?i)(mail|tel|phone|call|fax|mobil|contact|addr|card|visa|iban|ssn|\bip\b)"
_FOUND = "array<struct<start:int,rank:int,kind:string,end:int>>"

_CANDIDATES = (
    "array<struct<start:int,end:int,gen:int,strict:boolean,hit:string,before:string,after:string>>"
)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _strict(kind: str | None, hit: Column) -> Column:
    digits = _digits(hit)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.rlike(_SMALL))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(False)


def candidates(text: Column) -> Column:
    """array<struct<start, end, gen, strict, hit, before, after>> of all generators."""
    parts = []
    for i, g in enumerate(GENERATORS):
        found = _tagged(match_spans(text, g.pattern, BEFORE, AFTER), i, g.kind)
        if g.contains:
            found = F.when(F.contains(text, F.lit(g.contains)), found).otherwise(F.array().cast(_CANDIDATES))
        parts.append(found)
    return F.concat(*parts)


def _tagged(spans: Column, number: int, kind: str | None) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit(number).alias("gen"),
            _strict(kind, s["hit"]).alias("strict"),
            *[s[c].alias(c) for c in ("hit", "before", "after")],
        ),
    )


def _count(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{pattern}]", ""))


def features() -> dict[str, Column]:
    """Format and context of a candidate. The strict checks are not among them."""
    hit, before, after = F.col("hit"), F.col("before"), F.col("after")
    digits = _digits(hit)
    named = {
        "f_length": F.length(hit),
        "f_digits": F.length(digits),
        "f_letters": _count(hit, "A-Za-z"),
        "f_blanks": _count(hit, r"\x20"),
        "f_dots": _count(hit, "."),
        "f_dashes": _count(hit, "-"),
        "f_brackets": _count(hit, r"()\[\]"),
        "f_plus": F.startswith(hit, F.lit("+")).cast("int"),
        "f_first": F.coalesce(F.try_element_at(F.split(digits, ""), F.lit(1)).try_cast("int"), F.lit(-1)),
        "f_second": F.coalesce(F.substring(digits, 2, 1).try_cast("int"), F.lit(-1)),
        "f_kinds_of_digit": F.size(F.array_distinct(F.split(digits, ""))),
        "f_glued_before": before.rlike(r"[A-Za-z0-9_=/+-]$").cast("int"),
        "f_glued_after": after.rlike(r"^[A-Za-z0-9_=/+@-]").cast("int"),
        "f_cue": before.rlike(_CUES).cast("int"),
        "f_colon": before.rlike(r"[:=]\s*$").cast("int"),
        "f_bare": (F.length(before) == 0).cast("int"),
    }
    for i in range(len(GENERATORS)):
        named[f"f_gen_{i}"] = (F.col("gen") == i).cast("int")
    return {k: v.cast("double") for k, v in named.items()}


def _assembled(rows: DataFrame) -> DataFrame:
    named = features()
    return VectorAssembler(inputCols=list(named), outputCol="features").transform(rows.withColumns(named))


def _with_overlaps(rows: DataFrame) -> DataFrame:
    """`rows` with `overlaps`: a strict span of another generator covers part of the candidate.

    Spans of one generator don't overlap, so the last one to begin before a candidate and the
    first one to begin after it decide. A window holds the candidates of one text.
    """
    texts = Window.partitionBy("_row")
    earlier = texts.orderBy("start", "end", "gen").rowsBetween(Window.unboundedPreceding, -1)
    later = texts.orderBy(F.desc("start"), F.desc("end"), F.desc("gen")).rowsBetween(Window.unboundedPreceding, -1)
    hit = F.lit(False)
    for i in range(len(BASE_KINDS)):
        one = F.col("strict") & (F.col("gen") == i)
        reaches = F.max(F.when(one, F.col("end"))).over(earlier) > F.col("start")
        begins = F.min(F.when(one, F.col("start"))).over(later) < F.col("end")
        hit = hit | ((F.col("gen") != i) & (F.coalesce(reaches, F.lit(False)) | F.coalesce(begins, F.lit(False))))
    return rows.withColumn("overlaps", hit)


def weak_labels(rows: DataFrame) -> DataFrame:
    """`rows` with `label`: 1 for personal data, 0 for not, unlabelled candidates left out."""
    glued = F.col("before").rlike("[A-Za-z0-9_]$") | F.col("after").rlike("^[A-Za-z0-9_]")
    base = F.col("gen") < len(BASE_KINDS)
    label = (
        F.when(F.col("strict") | F.col("overlaps"), 1.0).when(base | glued, 0.0).otherwise(F.lit(None).cast("double"))
    )
    return rows.withColumn("label", label).where("label is not null")


@dataclass(frozen=True)
class Judge:
    model: GBTClassificationModel | None
    threshold: float

    def accepted(self, rows: DataFrame) -> DataFrame:
        """The rows that the trees hold for personal data; none without a model."""
        if self.model is None:
            return rows.where(F.lit(False))
        scored = self.model.transform(_assembled(rows))
        return scored.where(vector_to_array("probability")[1] >= self.threshold)


def fit_judge(rows: DataFrame) -> Judge:
    """Trees and threshold from all weakly labelled candidates.

    Three quarters of them, chosen by hash, are learnt from, the threshold comes from the rest.
    Without candidates of both labels there is nothing to learn, and no candidate is accepted.
    """
    order = F.xxhash64("_row", "start", "end", "gen")
    known = store(weak_labels(rows).withColumn("_order", order), "candidates")
    rest = F.pmod(F.col("_order"), F.lit(4)) == 3
    learn, check = _assembled(known.where(~rest)), known.where(rest)
    if learn.select("label").distinct().count() < 2:
        return Judge(None, 1.0)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label")
    model = trees.fit(learn)
    scored = model.transform(_assembled(check)).select(
        F.floor(vector_to_array("probability")[1] * 1000).cast("int").alias("bin"), "label"
    )
    # a row for each of at most 1,001 bins
    bins = scored.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")).collect()
    n = good = 0.0
    threshold = 1.0
    for b in sorted(bins, key=lambda r: -r["bin"]):
        n, good = n + b["n"], good + b["good"]
        if good >= PRECISION * n:
            threshold = b["bin"] / 1000
    return Judge(model, max(threshold, 0.5))


def _span(rank: Column, kind: Column) -> Column:
    return F.struct(
        F.col("start").alias("start"), rank.cast("int").alias("rank"), kind.alias("kind"), F.col("end").alias("end")
    )


def detect(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, spans): the ids of `docs` and an array of found spans for each row.

    Spans are sorted by start, then by kind, strict kinds first; positions are code points, the
    end exclusive. Null and empty texts have none. All rows are kept, repeated rows and rows
    with null ids as well. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    # numbered and kept, since later passes must see the same numbers
    marked = store(
        docs.select(F.col(id_column).alias("_id"), F.monotonically_increasing_id().alias("_row"), candidates(text).alias("_candidates")),
        "spans",
    )
    rows = _with_overlaps(marked.select("_row", F.explode("_candidates").alias("c")).select("_row", "c.*"))
    judge = fit_judge(rows)
    loose = F.array(*[F.lit(g.loose) for g in GENERATORS])
    added = (
        judge.accepted(rows.where(~F.col("strict")))
        .select(
            "_row",
            _span(F.col("gen") + len(BASE_KINDS), F.element_at(loose, F.col("gen") + 1)).alias("_span"),
        )
        .groupBy(F.col("_row").alias("_added_row"))
        .agg(F.collect_list("_span").alias("_added"))
    )
    kinds = F.array(*[F.lit(k) for k in BASE_KINDS])
    strict = F.transform(
        F.filter("_candidates", lambda x: x["strict"]),
        lambda x: F.struct(
            x["start"].alias("start"),
            x["gen"].alias("rank"),
            F.element_at(kinds, x["gen"] + 1).alias("kind"),
            x["end"].alias("end"),
        ),
    ).cast(_FOUND)
    joined = marked.join(added, F.col("_row") == F.col("_added_row"), "left")
    spans = F.array_sort(F.concat(strict, F.coalesce(F.col("_added").cast(_FOUND), F.array().cast(_FOUND))))
    return joined.select(F.col("_id").alias(id_column), spans.alias("spans"))


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, counts of the strict kinds, digest of their spans, all spans as text."""
    found = detect(docs, id_column, text_column)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))
    counts = [
        F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS
    ]
    return found.select(
        F.col(id_column),
        *counts,
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """`text` with a mark in place of the spans."""
    return replace_spans(text, spans, MARK)
