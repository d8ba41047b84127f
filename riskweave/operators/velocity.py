"""Trailing-window features over the stream and over each entity.

A window [t-w, t) of running totals is a difference of two prefix sums. A burst of rows in one
second is summed up to one time point before the shuffle. Entities of up to `POINTS_AT_ONCE` time
points are answered many at a time inside tasks. For longer ones, and for the stream as a whole, one
global scan of the time points and their shifted copies answers every window at once; the range
order spreads them, so no entity sits in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.ordered import scan
from riskweave.options import VELOCITY_WINDOWS
from riskweave.schema import NO_ENTITY
from riskweave.session import store

STREAM_PREFIX = "f_vel_"
ENTITY_PREFIX = "f_ent_"
# Sums of amounts are taken in decimal: differences of double prefix sums lose digits.
MONEY = "decimal(20,6)"
POINTS_AT_ONCE = 1 << 18  # time points of the longest entity that a task takes whole


def _points(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (entity,) time point."""
    return (
        df.select(*keys, F.unix_micros("timestamp").alias("_us"), "transaction_id", "amount")
        .groupBy(*keys, "_us")
        .agg(
            F.count("amount").alias("_n"),
            F.coalesce(F.sum(F.col("amount").cast(MONEY)), F.lit(0)).cast("decimal(30,6)").alias("_amt"),
            F.min("transaction_id").alias("_first_id"),
        )
        # longs from here on: text buffers would turn the later aggregation into a sort
        .withColumn("_first", F.xxhash64("_first_id"))
        .drop("_first_id")
    )


def _trailing(df: DataFrame, windows: Mapping[str, int], entity: str | None) -> DataFrame:
    """One row per (entity,) time point: totals of every window in front of it."""
    if not entity:
        return _by_scan(_points(df, []), windows, None)
    points = store(_points(df, [entity]), "points")
    sizes = points.groupBy(entity).agg(
        F.count(F.lit(1)).alias("_size"), F.count_if(F.col("_us").isNull()).alias("_untimed")
    )
    long = F.col("_size") > POINTS_AT_ONCE
    n, longest, untimed = sizes.agg(F.sum("_size"), F.count_if(long), F.sum("_untimed")).first()
    if untimed:  # an entity's first gap looks past its rows without a time, which needs all entities
        return _by_scan(points, windows, entity)
    if not longest:
        return _by_entity(points, n or 0, windows, entity)
    # at most one row per POINTS_AT_ONCE points
    spread = F.broadcast(store(sizes.where(long).select(entity), "long"))
    return _by_entity(points.join(spread, entity, "left_anti"), n, windows, entity).unionByName(
        _by_scan(points.join(spread, entity, "left_semi"), windows, entity)
    )


def _sums(amounts: pa.Array) -> list[np.ndarray]:
    """Running sums in front of every place, and in front of the end, of 128-bit decimals: lowest
    32 bits, next 32 bits, the rest. Exact up to 2^31 amounts."""
    whole = np.frombuffer(amounts.buffers()[1], np.uint64)
    whole = whole[2 * amounts.offset : 2 * (amounts.offset + len(amounts))].reshape(-1, 2)
    low, rest = whole[:, 0], whole[:, 1].astype(np.int64)
    parts = (low & np.uint64(0xFFFFFFFF)).astype(np.int64), (low >> np.uint64(32)).astype(np.int64), rest
    return [np.r_[np.int64(0), np.cumsum(p)] for p in parts]


def _money(low: np.ndarray, middle: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The nearest double to a decimal of six places, given in the parts of `_sums`."""
    about = low + middle * 2.0**32 + high * 2.0**64
    out = (low + (middle << 32)) / 1e6
    for i in np.flatnonzero(np.abs(about) >= 2.0**52):
        out[i] = (int(low[i]) + (int(middle[i]) << 32) + (int(high[i]) << 64)) / 10**6
    return out


def window_totals(table: pa.Table, windows: Mapping[str, int], entity: str) -> pa.Table:
    """The result of `_trailing` for time points of whole entities, in any order."""
    code = table[entity].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    us = table["_us"].to_numpy()
    order = np.lexsort((us, code))
    table = table.take(pa.array(order))
    code, us = code[order].astype(np.int64), us[order]
    times = np.unique(us)
    place = code * (len(times) + 1)
    keys = place + np.searchsorted(times, us)
    own = np.arange(len(us))
    counts = np.r_[0, np.cumsum(table["_n"].to_numpy())]
    sums = _sums(table["_amt"].combine_chunks())
    first = np.r_[True, code[1:] != code[:-1]][: len(us)]
    out = {
        entity: table[entity],
        "_us": table["_us"],
        "_first": table["_first"],
        "_prev_us": pa.array(np.r_[us[:1], us[:-1]], pa.int64(), mask=first),
    }
    starts = {
        label: np.searchsorted(keys, place + np.searchsorted(times, us - width))
        for label, width in windows.items()
    }
    out |= {f"_n_{label}": pa.array(counts[own] - counts[at], pa.int64()) for label, at in starts.items()}
    out |= {
        f"_amt_{label}": pa.array(_money(*[s[own] - s[at] for s in sums]), pa.float64())
        for label, at in starts.items()
    }
    return pa.table(out)


def _by_entity(points: DataFrame, n: int, windows: Mapping[str, int], entity: str) -> DataFrame:
    """Whole entities, as many at a time as a task can hold."""
    least = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = F.pmod(F.xxhash64(entity), F.lit(max(least, -(-n // POINTS_AT_ONCE)))).alias("_group")
    schema = ", ".join(
        [f"`{entity}` string, _us long, _first long, _prev_us long"]
        + [f"`_n_{label}` long" for label in windows]
        + [f"`_amt_{label}` double" for label in windows]
    )
    return points.groupBy(groups).applyInArrow(lambda t: window_totals(t, windows, entity), schema)


def _by_scan(points: DataFrame, windows: Mapping[str, int], entity: str | None) -> DataFrame:
    """The same by one scan over all points and their copies at each window's start."""
    keys = [entity] if entity else []
    nil = F.lit(0)
    asks = [
        F.struct(
            F.lit(label).alias("label"),
            (F.col("_us") - F.lit(width)).alias("at"),
            nil.cast("long").alias("n"),
            nil.cast("decimal(30,6)").alias("amt"),
            F.lit(None).cast("long").alias("point"),
        )
        for label, width in windows.items()
    ]
    own = F.struct(
        F.lit("").alias("label"),
        F.col("_us").alias("at"),
        F.col("_n").alias("n"),
        F.col("_amt").alias("amt"),
        F.col("_us").alias("point"),
    )
    rows = points.select(
        *keys, "_us", "_first", F.explode(F.array(own, *asks)).alias("e")
    ).select(
        *keys,
        "_us",
        F.when(F.col("e.label") == "", F.col("_first")).alias("_first"),
        "e.*",
        # a shifted copy sorts in front of the point at the same time
        F.when(F.col("e.label") == "", 1).otherwise(0).alias("kind"),
        *([F.when(F.col("e.label") == "", F.col(entity)).alias("owner")] if entity else []),
    )
    scanned = scan(
        rows,
        [*keys, "at", "kind"],
        sums=["n", "amt"],
        last=["point", *(["owner"] if entity else [])],
    )

    def held(label: str, name: str) -> Column:
        return F.max(F.when(F.col("label") == label, F.col(name)))

    same = F.col("owner_prev") == F.col(entity) if entity else F.lit(True)
    return scanned.groupBy(*keys, "_us").agg(
        F.max("_first").alias("_first"),
        F.max(F.when((F.col("label") == "") & same, F.col("point_prev"))).alias("_prev_us"),
        *[
            (held("", "n_before") - held(label, "n_before")).alias(f"_n_{label}")
            for label in windows
        ],
        *[
            (held("", "amt_before") - held(label, "amt_before")).cast("double").alias(
                f"_amt_{label}"
            )
            for label in windows
        ],
    )


def _features(
    df: DataFrame, windows: Mapping[str, int], entity: str | None, prefix: str
) -> DataFrame:
    keys = [entity] if entity else []
    at = _trailing(df, windows, entity)
    out = df.withColumn("_us", F.unix_micros("timestamp")).join(at, [*keys, "_us"])
    for label in windows:
        n, total = F.col(f"_n_{label}"), F.col(f"_amt_{label}")
        mean = F.when(n > 0, total / n)
        out = (
            out.withColumn(f"{prefix}count_{label}", n.cast("double"))
            .withColumn(f"{prefix}amt_sum_{label}", total)
            .withColumn(f"{prefix}amt_mean_{label}", mean)
            .withColumn(
                f"{prefix}amt_ratio_{label}", F.when(mean > 0, F.col("amount") / mean)
            )
        )
    # rows that share a time point follow each other at distance 0, in id order
    gap = F.when(
        F.xxhash64("transaction_id") == F.col("_first"), F.col("_us") - F.col("_prev_us")
    ).otherwise(F.lit(0))
    seconds = gap / F.lit(1e6)
    if entity is None:
        seconds = F.floor(seconds).cast("double")
    out = out.withColumn(f"{prefix}seconds_since_prev", seconds)
    spare = [c for c in at.columns if c not in keys]
    return out.drop(*spare)


def stream_velocity(
    df: DataFrame, windows: Mapping[str, int] = VELOCITY_WINDOWS
) -> DataFrame:
    """Count, sum, mean and amount-over-mean of the stream in [t-w, t), and the gap in seconds."""
    return _features(df, windows, None, STREAM_PREFIX)


def _with_named_entities(df: DataFrame, body: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`body` over rows whose missing entity has a name; the missing ones are null again after."""
    named = df.withColumns(
        {"_given": F.col("entity_id"), "entity_id": F.coalesce(F.col("entity_id").cast("string"), F.lit(NO_ENTITY))}
    )
    return body(named).withColumn("entity_id", F.col("_given")).drop("_given")


def entity_velocity(
    df: DataFrame, windows: Mapping[str, int] = VELOCITY_WINDOWS
) -> DataFrame:
    """The same per `entity_id`, with fractional gaps."""
    return _with_named_entities(df, lambda d: _features(d, windows, "entity_id", ENTITY_PREFIX))


def entities_repeat(df: DataFrame) -> DataFrame:
    """One row: whether some entity has more than one transaction."""
    return (
        df.groupBy("entity_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.count(F.lit(1)).alias("entities"),
            F.sum("n").alias("rows"),
            (F.count(F.lit(1)) < F.sum("n")).alias("repeats"),
        )
    )


def add_velocity(df: DataFrame, windows: Mapping[str, int] = VELOCITY_WINDOWS) -> DataFrame:
    """Stream features, and entity features only if some entity repeats."""
    out = stream_velocity(df, windows)
    if entities_repeat(df).first()["repeats"]:
        out = entity_velocity(out, windows)
    return out


def daily_running_count(df: DataFrame) -> DataFrame:
    """`entity_daily_tx_count`: this entity's earlier transactions on the same calendar day."""
    keyed = df.withColumn("_day", F.to_date("timestamp"))
    counted = _with_named_entities(
        keyed.withColumn("_one", F.lit(1).cast("long")),
        lambda d: scan(d, ["timestamp", "transaction_id"], ["_one"], within=["entity_id", "_day"]),
    )
    return counted.withColumnRenamed("_one_before", "entity_daily_tx_count").drop(
        "_day", "_one", "_one_total"
    )


def velocity_columns(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if c.startswith((STREAM_PREFIX, ENTITY_PREFIX)))


def degenerate_columns(slices: list[DataFrame], columns: list[str]) -> DataFrame:
    """Columns with fewer than two distinct non-null values in any of the slices.

    Judged in one pass per slice by comparing the smallest with the largest value."""
    found = None
    for part in slices:
        flags = part.agg(
            *[
                (F.min(c).isNull() | (F.min(c) == F.max(c))).alias(c)
                for c in columns
            ]
        )
        long = flags.select(
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("column"), F.col(c).alias("dead"))
                        for c in columns
                    ]
                )
            ).alias("e")
        ).select("e.*")
        found = long if found is None else found.unionByName(long)
    return found.where("dead").select("column").distinct()
