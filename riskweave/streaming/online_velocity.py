"""Trailing counts and sums per entity for a stream.

State is a table of the entities' recent time points, written per micro-batch and partitioned by
day; each batch reads the days that its windows reach back to and runs the same skew-safe
operator as a batch job. A hot entity therefore never sits in one task's state store.

The gap to an entity's latest transaction may reach back further than any window. It comes from a
second table, a row per entity that a batch touched; every so often a batch writes all entities'
latest times in one, and older ones are no longer read.

Rows older than the watermark are dropped, as is history no window can reach. Every batch
overwrites only its own partitions, so a batch that runs again leaves the same files.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskweave.operators.velocity import ENTITY_PREFIX, entity_velocity
from riskweave.options import VELOCITY_WINDOWS
from riskweave.session import freeze
from riskweave.sources.transactions import path_exists

STATE_COLUMNS = ("transaction_id", "timestamp", "entity_id", "amount")
MERGE_EVERY = 16  # batches whose latest times are read one by one
SINCE = f"{ENTITY_PREFIX}seconds_since_prev"


def _day_folders(spark: SparkSession, folder: str, from_day: str) -> list[str]:
    """The state's day folders from a day on. Only the day level is listed, so a batch costs the
    same however long the stream has run; older days may be deleted at any time."""
    if not path_exists(spark, folder):
        return []
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    names = [status.getPath().getName() for status in found]
    return [
        f"{folder}/{n}" for n in names if n.startswith("day=") and n >= f"day={from_day}"
    ]


def _history(spark: SparkSession, folder: str, batch_id: int, from_us: int) -> DataFrame | None:
    """Earlier batches' rows from `from_us` on."""
    from_day = datetime.fromtimestamp(from_us / 1e6, timezone.utc).strftime("%Y-%m-%d")
    folders = _day_folders(spark, folder, from_day)
    if not folders:
        return None
    rows = spark.read.option("basePath", folder).parquet(*folders)
    return rows.where(
        (F.col("batch") < batch_id) & (F.unix_micros("timestamp") >= from_us)
    ).select(*STATE_COLUMNS)


def _latest(spark: SparkSession, folder: str, batch_id: int) -> DataFrame | None:
    """(entity_id, last_us) over all batches before this one, from the last merged one on."""
    merged = (batch_id - 1) // MERGE_EVERY * MERGE_EVERY if batch_id else 0
    paths = [f"{folder}/batch={n}" for n in range(merged, batch_id)]
    paths = [path for path in paths if path_exists(spark, path)]
    if not paths:
        return None
    rows = spark.read.parquet(*paths)
    return rows.groupBy("entity_id").agg(F.max("last_us").alias("last_us"))


def velocity_writer(
    output: str, state: str, windows: Mapping[str, int] = VELOCITY_WINDOWS, lateness_us: int = 0
):
    """A foreachBatch function."""
    reach = max(windows.values())
    features = [
        f"{ENTITY_PREFIX}{kind}_{label}"
        for label in windows
        for kind in ("count", "amt_sum", "amt_mean", "amt_ratio")
    ] + [SINCE]

    def progress(spark: SparkSession, batch_id: int) -> int | None:
        path = f"{state}/progress/batch={batch_id}"
        return spark.read.parquet(path).first()["max_us"] if path_exists(spark, path) else None

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = freeze(batch)
        at = F.unix_micros("timestamp")
        first, last = rows.agg(F.min(at), F.max(at)).first()
        seen = progress(spark, batch_id - 1)
        top = max((t for t in (seen, last) if t is not None), default=None)
        if first is not None:
            if seen is not None:
                rows = rows.where(at >= seen - lateness_us)
            pool = rows.withColumn("_fresh", F.lit(True))
            history = _history(spark, f"{state}/rows", batch_id, first - reach)
            if history is not None:
                pool = pool.unionByName(
                    history.withColumn("_fresh", F.lit(False)), allowMissingColumns=True
                )
            done = entity_velocity(pool, windows).where("_fresh")
            own = rows.groupBy("entity_id").agg(F.max(at).alias("last_us"))
            latest = _latest(spark, f"{state}/latest", batch_id)
            if latest is not None:
                # rows without a predecessor in reach, at most one per entity and batch
                same = F.col("entity_id").eqNullSafe(F.col("_entity"))
                before = latest.withColumnsRenamed({"entity_id": "_entity", "last_us": "_last_us"})
                gap = (at - F.col("_last_us")) / F.lit(1e6)
                done = done.join(before, same & F.col(SINCE).isNull(), "left").withColumn(
                    SINCE, F.coalesce(SINCE, gap)
                )
                if batch_id % MERGE_EVERY == 0:
                    own = own.unionByName(latest).groupBy("entity_id").agg(F.max("last_us").alias("last_us"))
            own.write.mode("overwrite").parquet(f"{state}/latest/batch={batch_id}")
            done.select(*batch.columns, *features).write.mode("overwrite").parquet(
                f"{output}/batch={batch_id}"
            )
            # rebalance: one file per day for a small batch, several for a hot day
            (
                rows.select(*STATE_COLUMNS, F.to_date("timestamp").alias("day"))
                .withColumn("batch", F.lit(batch_id))
                .hint("rebalance", "day")
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("day", "batch")
                .parquet(f"{state}/rows")
            )
        elif batch_id % MERGE_EVERY == 0:
            latest = _latest(spark, f"{state}/latest", batch_id)
            if latest is not None:
                latest.write.mode("overwrite").parquet(f"{state}/latest/batch={batch_id}")
        spark.range(1).select(F.lit(top).cast("long").alias("max_us")).write.mode(
            "overwrite"
        ).parquet(f"{state}/progress/batch={batch_id}")

    return write


def run_online_velocity(
    stream: DataFrame, output: str, state: str, checkpoint: str,
    windows: Mapping[str, int] = VELOCITY_WINDOWS, lateness_us: int = 0,
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(velocity_writer(output, state, windows, lateness_us))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
