"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: folder of parquet tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores.
Every query runs once to warm up and once timed, its whole result written to a no-op sink.
Batch scoring is the closest to the published throughput: a fitted model over all events,
best of five.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.catalog import QUERIES
from riskweave.functions.features import add_time_features
from riskweave.models import detector
from riskweave.operators.splits import temporal_grouped_split
from riskweave.session import build_session, freeze

HEADLINES = (
    "p1_temporal_grouped_split",
    "p6_rolling_folds",
    "w1_stream_velocity",
    "w2_entity_velocity",
    "a2_review_curve",
    "a5_price_scenarios",
    "a8_compare_policies",
    "a9_sensitivity_table",
    "a11_average_precision",
    "a17_calibration_error",
    "a22_fold_and_pooled_metrics",
    "s2_headline_bootstrap_poisson",
    "s4_policy_bootstrap_poisson",
    "d4_drift_report",
    "d7_dataset_drift",
    "j1_left_join_dimension",
    "l1_level_summary",
    "o11_running_sums",
    "src1_creditcard_csv",
    "r1_replay_alerts",
)


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return round(time.perf_counter() - start, 3)


def batch_scoring(spark, folder: str) -> tuple[float, float, int]:
    """(fit seconds, best scoring seconds, rows scored), on the line items as transactions."""
    cores = spark.sparkContext.defaultParallelism
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").repartition(cores)
    tx = lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.col("l_suppkey").cast("string").alias("entity_id"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_linestatus").alias("category"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_fraud"),
        F.col("l_quantity").alias("f_quantity"),
        F.col("l_discount").alias("f_discount"),
        F.col("l_tax").alias("f_tax"),
    )
    rows = freeze(add_time_features(tx))
    train = freeze(temporal_grouped_split(rows)[0])
    models = []
    fit_seconds = timed(lambda: models.append(detector.fit(train, "gbt")))
    scored = detector.scored_table(models[0], rows).select(F.sum("p"))
    best = min(timed(lambda: drain(scored)) for _ in range(5))
    return fit_seconds, best, rows.count()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINES:
        fn = QUERIES[name]
        drain(fn(spark, folder))
        seconds[name] = timed(lambda fn=fn: drain(fn(spark, folder)))
    fit_seconds, best, rows = batch_scoring(spark, folder)
    seconds["fit_boosted_trees_200_rounds"] = fit_seconds
    seconds["batch_scoring"] = best
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "batch_scoring_rows": rows,
                "batch_scoring_rows_per_sec": round(rows / best),
            }
        )
    )


if __name__ == "__main__":
    main()
