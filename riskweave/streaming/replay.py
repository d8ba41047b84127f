"""Scoring a stream of transactions into alerts and an event log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from riskweave.functions.scores import FRAUD, REVIEW, confidence, decide
from riskweave.operators.ordered import row_positions
from riskweave.session import store
from riskweave.sources.transactions import path_exists

Scorer = Callable[[DataFrame], DataFrame]
# The columns an event log may hold. Feature values never enter it.
LOG_COLUMNS = ("timestamp", "transaction_id", "decision", "p_fraud", "missing_count", "latency_ms")


def open_stream(
    spark: SparkSession, folder: str, schema: StructType, kind: str = "parquet",
    glob: str | None = None, files_per_batch: int | None = None,
) -> DataFrame:
    """Files of a folder as a stream; `files_per_batch` bounds the size of a micro-batch."""
    reader = spark.readStream.schema(schema).format(kind)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def alert_rows(scored: DataFrame, threshold: float) -> DataFrame:
    """The alert columns of every scored row; callers keep fraud and review. `row_index` is the
    row's place in the replay, if the rows have one."""
    p = F.col("p")
    return scored.select(
        "timestamp",
        *[c for c in scored.columns if c == "row_index"],
        "transaction_id",
        "entity_id",
        "amount",
        "category",
        decide(p, threshold).alias("decision"),
        F.round(p, 4).alias("p_fraud"),
        F.round(confidence(p), 4).alias("confidence"),
        F.col("is_fraud").alias("true_is_fraud"),
    )


def alerts(scored: DataFrame, threshold: float) -> DataFrame:
    return alert_rows(scored, threshold).where(F.col("decision").isin(FRAUD, REVIEW))


def event_log(scored: DataFrame, threshold: float, missing: Column | None = None) -> DataFrame:
    """Metadata only: decision, score, how many inputs were missing, and the time from the event
    to the batch that scored it, in milliseconds."""
    p = F.col("p")
    count = F.size(missing) if missing is not None else F.lit(0)
    return scored.select(
        "timestamp",
        "transaction_id",
        decide(p, threshold).alias("decision"),
        F.round(p, 4).alias("p_fraud"),
        count.alias("missing_count"),
        (F.unix_millis(F.current_timestamp()) - F.unix_millis("timestamp")).alias("latency_ms"),
    )


def alert_writer(scorer: Scorer, threshold: float, output: str):
    """A foreachBatch function that numbers the rows of the whole replay without gaps.

    Within a batch rows are numbered in order of time and id; a batch goes on where the one
    before ended, which it reads from that one's count. Counts and alerts of a batch overwrite
    its own folders only, so a batch that runs again leaves the same files.
    """

    def ended(spark: SparkSession, batch_id: int) -> int:
        path = f"{output}/ends/batch={batch_id}"
        return spark.read.parquet(path).first()["rows"] if batch_id >= 0 and path_exists(spark, path) else 0

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        begin = ended(spark, batch_id - 1)
        rows = store(batch, "replayed")
        placed = row_positions(rows.withColumn("_at", F.col("timestamp")), ["_at", "transaction_id"], "row_index")
        placed = placed.withColumn("row_index", F.col("row_index") + F.lit(begin)).drop("_at", "row_index_count")
        alerts(scorer(placed), threshold).write.mode("overwrite").parquet(f"{output}/alerts/batch={batch_id}")
        end = rows.agg((F.count(F.lit(1)) + F.lit(begin)).alias("rows"))
        end.write.mode("overwrite").parquet(f"{output}/ends/batch={batch_id}")

    return write


def replay_alerts(
    stream: DataFrame, scorer: Scorer, threshold: float, output: str, checkpoint: str
) -> StreamingQuery:
    """Scores the stream and writes alerts, exactly once under restarts, until the input is used
    up. Read them with `written_alerts`."""
    return (
        stream.writeStream.foreachBatch(alert_writer(scorer, threshold, output))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def written_alerts(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.option("basePath", f"{output}/alerts").parquet(f"{output}/alerts/*").drop("batch")


def replay_log(
    stream: DataFrame, scorer: Scorer, threshold: float, output: str, checkpoint: str,
    missing: Column | None = None,
) -> StreamingQuery:
    return (
        event_log(scorer(stream), threshold, missing)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def decision_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))
