"""Order-dependent results over whole tables.

A window without a partition key puts the whole table on one task, and a window on a hot key
puts that key's rows there. Here the rows are range-partitioned on the full sort key, so equal
leading keys spread over several buckets; each bucket is scanned on its own, and the state in
front of a bucket (running sums, last values) comes from a table with one row per bucket.

The bucket numbers must not change between the two passes. A range exchange samples its
bounds and may choose others when it runs again, so the numbered rows are written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NullType as VoidType

from riskweave.session import freeze, store

BUCKET = "_bucket"


def range_order(df: DataFrame, order: Sequence[str], buckets: int | None = None) -> DataFrame:
    """`df` with a bucket number that rises with the sort key, written once."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn(BUCKET, F.spark_partition_id())
    # a checkpoint runs the plan twice, but takes columns without a type
    plain = not any(isinstance(f.dataType, VoidType) for f in ranged.schema)
    return store(ranged, "ordered") if plain else freeze(ranged)


def scan(
    df: DataFrame,
    order: Sequence[str],
    sums: Sequence[str] = (),
    last: Sequence[str] = (),
    within: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Adds what precedes each row in ascending `order`, separately for each `within` group.

    `<c>_before` and `<c>_total` for every column in `sums`; `<c>_prev`, the latest non-null
    earlier value, for every column in `last`. `order` must be unique within a group, as far
    as rows with a non-zero value are concerned. `within` columns must not be null.
    """
    ranged = range_order(df, [*within, *order], buckets)
    return scan_ranged(ranged, order, sums, last, within)


def scan_ranged(
    ranged: DataFrame,
    order: Sequence[str],
    sums: Sequence[str] = (),
    last: Sequence[str] = (),
    within: Sequence[str] = (),
) -> DataFrame:
    """`scan` over a table that `range_order` already made, for [*within, *order]."""
    key = F.struct(*order)
    per_bucket = ranged.groupBy(*within, BUCKET).agg(
        *[F.sum(c).alias(f"{c}_in") for c in sums],
        *[
            F.max_by(
                F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), key)
            ).alias(f"{c}_tail")
            for c in last
        ],
    )
    groups = within or [F.lit(0)]
    ahead = Window.partitionBy(*groups).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    # One row per bucket, or per (group, bucket) pair; a range order gives at most
    # buckets + groups of those.
    carry = per_bucket.select(
        *within,
        BUCKET,
        *[F.sum(f"{c}_in").over(ahead).alias(f"{c}_carry") for c in sums],
        *[F.sum(f"{c}_in").over(whole).alias(f"{c}_total") for c in sums],
        *[F.last(f"{c}_tail", ignorenulls=True).over(ahead).alias(f"{c}_lead") for c in last],
    )
    if within:
        # equal keys compress so well that many rows may look small enough to broadcast
        ranged = ranged.hint("merge")
    else:
        carry = F.broadcast(carry)
    inside = (
        Window.partitionBy(*within, BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = ranged.join(carry, [*within, BUCKET])
    zero = F.lit(0)
    for c in sums:
        before = F.coalesce(F.sum(c).over(inside), zero) + F.coalesce(F.col(f"{c}_carry"), zero)
        joined = joined.withColumn(f"{c}_before", before)
    for c in last:
        joined = joined.withColumn(
            f"{c}_prev",
            F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"{c}_lead")),
        )
    spare = [f"{c}_carry" for c in sums] + [f"{c}_lead" for c in last]
    return joined.drop(BUCKET, *spare)


def row_positions(
    df: DataFrame, order: Sequence[str], name: str = "position", within: Sequence[str] = ()
) -> DataFrame:
    """Contiguous positions 0..n-1 in `order` (unique), and the row count `<name>_count`."""
    counted = scan(df.withColumn("_one", F.lit(1).cast("long")), order, ["_one"], within=within)
    return (
        counted.withColumnRenamed("_one_before", name)
        .withColumnRenamed("_one_total", f"{name}_count")
        .drop("_one")
    )


def equal_count_bin(position: Column, count: Column, bins: int) -> Column:
    """Bin of a 0-based position when `count` rows are cut into `bins` runs, longer runs first."""
    small = F.floor(count / bins)
    longer = count % bins
    edge = longer * (small + 1)
    return F.when(position < edge, F.floor(position / (small + 1))).otherwise(
        longer + F.floor((position - edge) / F.greatest(small, F.lit(1)))
    )


def exact_quantiles(
    df: DataFrame, value: str, levels: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolated quantiles: one row per group and level, (level, quantile, n).

    Counts distinct values first, ranks them with `scan`, and keeps the at most two values
    per level that hold the wanted ranks. Nothing is collected into one aggregation buffer.
    """
    known = df.where(F.col(value).isNotNull())
    distinct = known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return ranked_quantiles(scan(distinct, [value], ["_n"], within=by), value, levels, by)


def ranked_quantiles(
    ranked: DataFrame, value: str, levels: Sequence[float], by: Sequence[str]
) -> DataFrame:
    """Quantiles of distinct values with counts `_n` that `scan` has ranked."""
    wanted = F.array(*[F.lit(float(q)) for q in levels])
    at = (F.col("level") * (F.col("_n_total") - 1)).cast("double")
    first, past = F.col("_n_before"), F.col("_n_before") + F.col("_n")

    def holds(q: Column) -> Column:
        spot = q * (F.col("_n_total") - 1)
        low, high = F.floor(spot), F.ceil(spot)
        return ((low >= first) & (low < past)) | ((high >= first) & (high < past))

    hits = ranked.withColumn("level", F.explode(F.filter(wanted, holds))).select(
        *by,
        "level",
        F.col("_n_total").alias("n"),
        (at - F.floor(at)).alias("_frac"),
        F.when((F.floor(at) >= first) & (F.floor(at) < past), F.col(value)).alias("_lo"),
        F.when((F.ceil(at) >= first) & (F.ceil(at) < past), F.col(value)).alias("_hi"),
    )
    lo, hi = F.max("_lo"), F.max("_hi")
    return hits.groupBy(*by, "level", "n").agg(
        (lo + (hi - lo) * F.max("_frac")).alias("quantile")
    )


def summary_quantiles(
    df: DataFrame, value: str, named: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """`exact_quantiles` with one column per name."""
    long = exact_quantiles(df, value, sorted(set(named.values())), by)
    return long.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("level") == float(q), F.col("quantile"))).alias(name)
            for name, q in named.items()
        ]
    )
