"""Drift of a stream against the frozen reference, per tumbling window.

State is one histogram per (window, feature) with a counter per bin, so it does not grow with
the rows of a window, and partial sums reach it already combined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskweave.functions.scores import ratio
from riskweave.operators.drift import bin_of, known_double, psi


def window_histograms(
    stream: DataFrame, reference: DataFrame, columns: list[str], width: str, lateness: str,
    bins: int = 10,
) -> DataFrame:
    """(window_start, feature, n, known, b0..): counts per bin of the reference's edges."""
    # a column that the stream lacks has no known value
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            (known_double(c) if c in stream.columns else F.lit(None).cast("double")).alias("value"),
        )
        for c in columns
    ]
    long = (
        stream.withWatermark("timestamp", lateness)
        .select("timestamp", F.explode(F.array(*entries)).alias("e"))
        .select("timestamp", "e.*")
        # one row per feature
        .join(F.broadcast(reference.select("feature", "inner_edges")), "feature")
        .withColumn("bin", bin_of(F.col("value"), F.col("inner_edges")))
    )
    return (
        long.groupBy(F.window("timestamp", width).alias("w"), "feature")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("value").alias("known"),
            *[
                F.count_if(F.col("value").isNotNull() & (F.col("bin") == b)).alias(f"b{b}")
                for b in range(bins)
            ],
        )
        .select(F.col("w.start").alias("window_start"), "feature", "n", "known",
                *[f"b{b}" for b in range(bins)])
    )


def window_drift(
    histograms: DataFrame, reference: DataFrame, watch: float, alert: float, bins: int = 10
) -> DataFrame:
    """psi and status of every histogram row."""
    counts = F.slice(F.array(*[f"b{b}" for b in range(bins)]), 1, F.size("proportions"))
    joined = histograms.join(
        F.broadcast(reference.select("feature", "proportions")), "feature"
    ).withColumn("seen", F.transform(counts, lambda c: ratio(c, F.col("known"))))
    value = F.when(F.col("known") > 0, psi(F.col("proportions"), F.col("seen")))
    status = (
        F.when(F.col("psi").isNull(), "all_null_in_window")
        .when(F.col("psi") >= alert, "alert")
        .when(F.col("psi") >= watch, "watch")
        .otherwise("stable")
    )
    return joined.withColumn("psi", value).select(
        "window_start", "feature", "n", "psi", status.alias("status"),
        (1 - F.col("known") / F.col("n")).alias("null_fraction"),
    )


def run_window_drift(
    stream: DataFrame, reference: DataFrame, columns: list[str], width: str, lateness: str,
    watch: float, alert: float, output: str, checkpoint: str, bins: int = 10,
) -> StreamingQuery:
    """Writes the changed (window, feature) rows of each batch; `latest_windows` reads them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        window_drift(batch, reference, watch, alert, bins).write.mode("overwrite").parquet(
            f"{output}/batch={batch_id}"
        )

    histograms = window_histograms(stream, reference, columns, width, lateness, bins)
    return (
        histograms.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_windows(rows: DataFrame) -> DataFrame:
    """The last state of every (window, feature)."""
    kept = [c for c in rows.columns if c not in ("window_start", "feature", "batch")]
    return (
        rows.groupBy("window_start", "feature")
        .agg(F.max_by(F.struct(*kept), "batch").alias("r"))
        .select("window_start", "feature", "r.*")
    )
