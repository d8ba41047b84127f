"""Row-level feature expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_time_features(df: DataFrame) -> DataFrame:
    """hour_of_day, and day_of_week with Monday = 0."""
    return df.withColumn("hour_of_day", F.hour("timestamp")).withColumn(
        "day_of_week", F.weekday("timestamp")
    )


def fill_time_features(df: DataFrame) -> DataFrame:
    """Derives the two from the timestamp where a request did not give them."""
    derived = {"hour_of_day": F.hour("timestamp"), "day_of_week": F.weekday("timestamp")}
    for name, value in derived.items():
        given = F.col(name) if name in df.columns else F.lit(None).cast("int")
        df = df.withColumn(name, F.coalesce(given, value))
    return df


def missing_inputs(df: DataFrame, expected: Sequence[str]) -> Column:
    """Names of the expected inputs that a row lacks."""
    names = [
        F.when(F.col(c).isNull(), F.lit(c)) if c in df.columns else F.lit(c) for c in expected
    ]
    return F.filter(F.array(*names), lambda x: x.isNotNull())


def absent_inputs(df: DataFrame, expected: Sequence[str]) -> list[str]:
    """Expected inputs that no row of the batch can have."""
    return [c for c in expected if c not in df.columns]


def with_absent_inputs(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Adds absent inputs as nulls; `expected` maps names to types."""
    for name, kind in expected.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def numeric_or_rejected(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Casts request fields to numbers; `rejected` lists the fields that are not numeric."""
    bad = [
        F.when(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull(), F.lit(c))
        for c in columns
    ]
    out = df.withColumn("rejected", F.filter(F.array(*bad), lambda x: x.isNotNull()))
    for c in columns:
        out = out.withColumn(c, F.col(c).try_cast("double"))
    return out


def head_of_stream(df: DataFrame, n: int) -> DataFrame:
    """The first n rows in time order; all of them for n <= 0."""
    return df if n <= 0 else df.orderBy("timestamp", "transaction_id").limit(n)


def random_pick(df: DataFrame, seed: int, key: str = "transaction_id") -> DataFrame:
    """One row, chosen by a seeded hash."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), key).cast("binary")), key).limit(1)


def class_weights(train: DataFrame, label: str = "is_fraud") -> DataFrame:
    """(label, weight): n / (classes * rows of the class), from the train rows only."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(
        F.sum("n").alias("n"), (F.max(label) + 1).alias("k")
    )
    rows, classes = whole.select("n").scalar(), whole.select("k").scalar()
    return counts.select(label, (rows / (classes * F.col("n"))).alias("weight"))
