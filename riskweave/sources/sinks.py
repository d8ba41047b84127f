"""Report, score and metric sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.text import metric_name
from riskweave.operators.ordered import row_positions
from riskweave.operators.reconcile import metric_mismatches, require_equal

SCORE_DECIMALS = 8
AMOUNT_DECIMALS = 2


def write_report(report: DataFrame, folder: str, name: str, source: str) -> None:
    """A snapshot named after the data source, and the latest report beside it. The plan runs
    once: the second copy is read from the first."""
    snapshot = f"{folder}/{name}_{source}"
    stamped = report.withColumn("data_source", F.lit(source))
    keep = {"mode": "overwrite", "ignoreNullFields": False}  # a column of nulls is kept
    stamped.write.json(snapshot, **keep)
    again = report.sparkSession.read.schema(stamped.schema).json(snapshot)
    again.write.json(f"{folder}/{name}", **keep)


def score_export(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(position, p, amount) in time order with rounded values, and the positions of frauds."""
    placed = row_positions(
        scored.select("timestamp", "transaction_id", "y", "p", "amount"),
        ["timestamp", "transaction_id"],
    )
    rows = placed.select(
        "position",
        F.round("p", SCORE_DECIMALS).alias("p"),
        F.round("amount", AMOUNT_DECIMALS).alias("amount"),
    )
    return rows, placed.where("y = 1").select("position")


def write_score_export(scored: DataFrame, folder: str) -> None:
    rows, frauds = score_export(scored)
    rows.write.mode("overwrite").parquet(f"{folder}/rows")
    frauds.write.mode("overwrite").parquet(f"{folder}/fraud_positions")


def read_score_export(spark: SparkSession, folder: str) -> DataFrame:
    """(position, p, y, amount) rebuilt from an export."""
    return rebuild_scores(
        spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/fraud_positions")
    )


def rebuild_scores(rows: DataFrame, frauds: DataFrame) -> DataFrame:
    hit = frauds.select("position", F.lit(1).alias("_hit"))
    return rows.join(hit, "position", "left").select(
        "position", "p", F.coalesce("_hit", F.lit(0)).alias("y"), "amount"
    )


def metric_rows(
    table: DataFrame,
    run: str,
    variant: str,
    metrics: Sequence[str],
    step: str | None = None,
    prefix: str = "",
) -> DataFrame:
    """Numeric cells of a report as (run, variant, metric, step, value); nulls are left out."""
    at = F.round(F.col(step) * 100).cast("int") if step else F.lit(0)
    entries = [
        F.struct(
            metric_name(F.lit(prefix + m)).alias("metric"), F.col(m).cast("double").alias("value")
        )
        for m in metrics
    ]
    return (
        table.select(
            F.lit(run).alias("run"),
            F.col(variant).cast("string").alias("variant"),
            at.alias("step"),
            F.explode(F.array(*entries)).alias("e"),
        )
        .select("run", "variant", "e.metric", "step", "e.value")
        .where(F.col("value").isNotNull())
    )


def append_metrics(
    rows: DataFrame,
    folder: str,
    params: Mapping[str, str] | None = None,
    tags: Mapping[str, str] | None = None,
) -> None:
    def as_map(entries: Mapping[str, str] | None):
        flat = [F.lit(x) for pair in (entries or {}).items() for x in pair]
        return F.create_map(*flat).cast("map<string,string>")

    rows.withColumn("params", as_map(params)).withColumn("tags", as_map(tags)).write.mode(
        "append"
    ).partitionBy("run").parquet(folder)


def read_metrics(spark: SparkSession, folder: str, run: str) -> DataFrame:
    return spark.read.parquet(folder).where(F.col("run") == run)


def metric_store_differences(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Metrics that differ, are missing from the store, or are only there."""
    return metric_mismatches(expected, stored, ["variant", "metric", "step"])


def tag_differences(stored: DataFrame, tags: Mapping[str, str]) -> DataFrame:
    """Variants whose stored tags differ from the expected ones."""
    wrong = F.lit(False)
    for name, value in tags.items():
        wrong = wrong | ~F.col("tags")[name].eqNullSafe(F.lit(value))
    return stored.where(wrong).select("variant").distinct()


def check_metric_store(
    stored: DataFrame, expected: DataFrame, tags: Mapping[str, str] | None = None
) -> None:
    require_equal(metric_store_differences(stored, expected), "metric store")
    if tags:
        require_equal(tag_differences(stored, tags), "metric store tags")
