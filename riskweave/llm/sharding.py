"""Sharding by proportional stratified interleaving.

The rows of each source are put in a seeded random order and ranked. A row's fractional rank,
its place within its source as a part of one, tells where it belongs in the whole, so rows
sorted by fractional rank hold every source in proportion at every point. The shards are runs
of that order with row counts at most one apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import store

SHARDS = 8
SEED = 42
LAW = "rows"


def shuffle_key(id_column: Column, seed: int = SEED) -> Column:
    """A number of 60 bits from the digest of seed and id, the same in any engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def positions(df: DataFrame, order: Sequence[str], name: str, within: Sequence[str] = ()) -> DataFrame:
    """0-based places in `order`, whole or `within` groups (not null), and the number of rows
    there as `<name>_count`.

    Rows are range-partitioned on the full key and written, so that a hot group spreads over
    ranges that stay as they are. Each range is ranked on its own and goes on where the ranges
    before it end; their counts are a row for each range, or each group of a range.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(ranges, *within, *order)
    spread = store(spread.withColumn("_range", F.spark_partition_id()), "ranges")
    counts = spread.groupBy(*within, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    group = [*within] or [F.lit(0)]
    ahead = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *within, "_range",
        F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*group)).alias(f"{name}_count"),
    )
    inside = Window.partitionBy(*within, "_range").orderBy(*order)
    # without groups the counts are a row for each range
    joined = spread.hint("merge").join(counts, [*within, "_range"]) if within else spread.join(F.broadcast(counts), "_range")
    return joined.withColumn(name, F.row_number().over(inside) - 1 + F.col("_before")).drop("_range", "_before")


def interleaved(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot), a row for each row of `docs`.

    Ties in the random order are broken by id, checksum and size; rows alike in all of them are
    interchangeable. Rows without a source are a source of their own. A null text has no bytes.
    Equal texts are rows like any other: each is placed by its own id. With fewer rows than
    shards the last shards stay empty; an empty table gives an empty result.
    """
    data = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    source = F.coalesce(F.col(source_column).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("_id"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        # a digest, as names may be long and null needs one as well
        F.md5(F.concat(F.col(source_column).isNull().cast("string"), source).cast("binary")).alias("_stratum"),
        shuffle_key(F.col(id_column), seed).alias("_key"),
        F.col(id_column).isNull().alias("_null"),
        # tells rows alike in all else apart, so that many of them spread over tasks
        F.monotonically_increasing_id().alias("_row"),
    )
    inner = ["_key", "_null", "_id", "text_crc32", "size", "_row"]
    ranked = positions(rows, inner, "_rank", within=["_stratum"])
    # (2 rank + 1) / (2 n): the middle of the row's share of its source
    part = (2 * F.col("_rank") + 1) / (2 * F.col("_rank_count")).cast("double")
    placed = positions(ranked.withColumn("_part", part), ["_part", "_stratum", "_rank"], "_at")
    return cut(placed, F.col("_at"), F.col("_at_count"), shards).select(
        F.col("_id").alias(id_column), "size", "text_crc32", "shard", "slot"
    )


def cut(df: DataFrame, position: Column, count: Column, shards: int) -> DataFrame:
    """`shard` and `slot` of a 0-based position: runs of equal counts, the longer ones first."""
    small, longer = F.floor(count / shards), count % shards
    edge = longer * (small + 1)  # where the shorter runs begin
    shard = F.when(position < edge, F.floor(position / (small + 1))).otherwise(
        longer + F.floor((position - edge) / F.greatest(small, F.lit(1)))
    )
    begin = shard * small + F.least(shard, longer)
    return df.withColumns({"shard": shard.cast("int"), "slot": (position - begin).cast("long")})
