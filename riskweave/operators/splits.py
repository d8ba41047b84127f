"""Time splits that keep every entity whole, and rolling-origin folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.ordered import scan
from riskweave.session import freeze


def entity_first_seen(df: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    """(entity_id, first_seen, rows, ...): partial sums before the shuffle, so a hot entity is
    one small row per task."""
    return df.groupBy("entity_id").agg(
        F.min("timestamp").alias("first_seen"), F.count(F.lit(1)).alias("rows"), *extra
    )


def entity_order(entities: DataFrame) -> DataFrame:
    """Entities with the number of rows ahead of them in first-seen order (ties by id)."""
    return scan(entities, ["first_seen", "entity_id"], ["rows"])


def join_entities(df: DataFrame, entities: DataFrame, how: str = "inner") -> DataFrame:
    """By `entity_id`, where a missing entity is one like any other."""
    right = entities.withColumnRenamed("entity_id", "_entity")
    return df.join(right, F.col("entity_id").eqNullSafe(F.col("_entity")), how).drop("_entity")


def with_first_seen(df: DataFrame) -> DataFrame:
    """Each row's entity minimum timestamp, by a join: a window on a hot entity is one task,
    a skewed join is split by AQE."""
    return join_entities(df, entity_first_seen(df).drop("rows"))


def entity_sides(df: DataFrame, test_size: float) -> DataFrame:
    """(entity_id, side): train while the rows ahead are below the train budget."""
    budget = F.col("rows_total") * F.lit(1 - test_size)
    side = F.when(F.col("rows_before") < budget, "train").otherwise("test")
    return entity_order(entity_first_seen(df)).select("entity_id", side.alias("side"))


def temporal_grouped_split(
    df: DataFrame, test_size: float = 0.2
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; whole entities, in first-seen order."""
    sides = entity_sides(df, test_size)
    test_entities = sides.where(F.col("side") == "test").select("entity_id")
    return (
        join_entities(df, test_entities, "left_anti"),
        join_entities(df, test_entities, "left_semi"),
    )


def nested_sides(df: DataFrame, test_size: float, inner_size: float) -> DataFrame:
    """(entity_id, side) with the train side split again: fit, calibration, test."""
    outer = entity_sides(df, test_size)
    train = join_entities(df, outer.where("side = 'train'").select("entity_id"), "left_semi")
    inner = entity_sides(train, inner_size).select(
        "entity_id",
        F.when(F.col("side") == "train", "fit").otherwise("calibration").alias("inner_side"),
    )
    return join_entities(outer, inner, "left").select(
        "entity_id", F.coalesce("inner_side", "side").alias("side")
    )


def cut_timestamps(df: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """(fraction, cut): first-seen time of the first entity left out of each budget."""
    return cuts_of(entity_first_seen(df), fractions)


def cuts_of(entities: DataFrame, fractions: Sequence[float]) -> DataFrame:
    bad = [f for f in fractions if not 0.0 < f < 1.0]
    if bad:
        raise ValueError(f"train fractions must lie strictly between 0 and 1: {bad}")
    cuts = entity_order(entities).agg(
        *[
            F.min(
                F.when(
                    F.col("rows_before") >= F.col("rows_total") * F.lit(float(f)),
                    F.col("first_seen"),
                )
            ).alias(f"c{i}")
            for i, f in enumerate(fractions)
        ]
    )
    return cuts.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(float(f)).alias("fraction"), F.col(f"c{i}").alias("cut"))
                    for i, f in enumerate(fractions)
                ]
            )
        ).alias("e")
    ).select("e.*")


def cut_timestamp(df: DataFrame, fraction: float) -> datetime:
    cut = cut_timestamps(df, [fraction]).first()["cut"]
    if cut is None:
        raise ValueError(f"train fraction {fraction} leaves no test rows")
    return cut


def distinct_cuts(df: DataFrame, fractions: Sequence[float]) -> DataFrame:
    return cut_timestamps(df, fractions).select("cut").distinct().orderBy("cut")


def split_before(df: DataFrame, cut: datetime) -> tuple[DataFrame, DataFrame]:
    """Rows whose entity is first seen before `cut`, and the rest; ties go right."""
    seen = with_first_seen(df)
    return (
        seen.where(F.col("first_seen") < F.lit(cut)).drop("first_seen"),
        seen.where(F.col("first_seen") >= F.lit(cut)).drop("first_seen"),
    )


@dataclass(frozen=True)
class Fold:
    index: int
    cut: datetime
    end: datetime | None
    merged_windows: int


def merge_short_windows(
    windows: Sequence[tuple[datetime, datetime | None, int]], minimum: int
) -> list[Fold]:
    """Joins a window with fewer than `minimum` frauds to its right neighbour (the last one to
    its left), leftmost first. `windows` holds (start, end, frauds), one entry per cut."""
    state = [(start, end, frauds, 1) for start, end, frauds in windows]

    def first_short() -> int | None:
        return next((i for i, w in enumerate(state) if w[2] < minimum), None)

    while len(state) > 1 and (short := first_short()) is not None:
        left = min(short, len(state) - 2)
        a, b = state[left], state[left + 1]
        state[left : left + 2] = [(a[0], b[1], a[2] + b[2], a[3] + b[3])]
    if first_short() is not None:
        raise ValueError(f"fewer than {minimum} frauds after the first cut")
    return [
        Fold(i, start, end, merged)
        for i, (start, end, _, merged) in enumerate(state, start=1)
    ]


def fold_windows(entities: DataFrame, cuts: Sequence[datetime]) -> DataFrame:
    """Rows and frauds per window between consecutive cuts. `entities` carries first_seen,
    rows and frauds."""
    window = F.lit(0)
    for cut in cuts:
        window = window + (F.col("first_seen") >= F.lit(cut)).cast("int")
    return (
        entities.withColumn("window", window)
        .groupBy("window")
        .agg(F.sum("rows").alias("rows"), F.sum("frauds").alias("frauds"))
    )


def build_folds(
    df: DataFrame, fractions: Sequence[float], min_test_fraud: int
) -> list[Fold]:
    """Expanding-window folds. Only cuts and per-window counts reach the driver: at most one
    row per fraction."""
    if list(fractions) != sorted(set(fractions)):
        raise ValueError("train fractions must strictly increase")
    entities = freeze(entity_first_seen(df, [F.sum("is_fraud").alias("frauds")]))
    cuts = [r["cut"] for r in cuts_of(entities, fractions).collect()]
    if None in cuts:
        raise ValueError(f"one of {list(fractions)} leaves no test rows")
    cuts = sorted(set(cuts))
    counts = {r["window"]: int(r["frauds"]) for r in fold_windows(entities, cuts).collect()}
    ends = [*cuts[1:], None]
    return merge_short_windows(
        [(c, e, counts.get(i, 0)) for i, (c, e) in enumerate(zip(cuts, ends), start=1)],
        min_test_fraud,
    )


def fold_of(first_seen: Column, folds: Sequence[Fold]) -> Column:
    """The fold whose test window holds a first-seen time; null before the first cut."""
    out = F.lit(None).cast("int")
    for fold in folds:
        out = F.when(first_seen >= F.lit(fold.cut), F.lit(fold.index)).otherwise(out)
    return out


def assign_folds(df: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    return with_first_seen(df).withColumn("fold", fold_of(F.col("first_seen"), folds))


def leakage_audit(df: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """Per fold: test rows whose entity also has train rows, and whether any train entity is
    first seen at or after the cut. Both must be zero or false.

    The sides are read from the rows' own times, so an entity that straddles shows up."""
    rows = assign_folds(df, folds)
    tagged = rows.select(
        "entity_id",
        "first_seen",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(f.index).alias("fold"),
                        F.lit(f.cut).alias("cut"),
                        (F.col("first_seen") < F.lit(f.cut)).alias("train"),
                        (F.col("fold") == f.index).alias("test"),
                    )
                    for f in folds
                ]
            )
        ).alias("e"),
    ).select("entity_id", "first_seen", "e.*")
    per_entity = tagged.groupBy("fold", "cut", "entity_id").agg(
        F.count_if("train").alias("train_rows"),
        F.count_if("test").alias("test_rows"),
        F.max(F.when(F.col("train"), F.col("first_seen"))).alias("train_seen"),
    )
    return per_entity.groupBy("fold").agg(
        F.sum(F.when(F.col("train_rows") > 0, F.col("test_rows")).otherwise(0)).alias(
            "straddling_rows"
        ),
        F.coalesce(F.max(F.col("train_seen") >= F.col("cut")), F.lit(False)).alias(
            "train_seen_after_cut"
        ),
        F.sum("train_rows").alias("train_rows"),
        F.sum("test_rows").alias("test_rows"),
    )


def split_boundary(train: DataFrame, test: DataFrame) -> DataFrame:
    """What the split guarantees at its boundary, measured in one pass over both sides."""
    first_test = test.agg(F.min("timestamp").alias("t")).scalar()
    both = train.select("timestamp", F.lit(True).alias("train")).unionByName(
        test.select("timestamp", F.lit(False).alias("train"))
    )
    at = F.col("timestamp")
    return both.agg(
        F.max(F.when(F.col("train"), at)).alias("train_last_timestamp"),
        F.min(F.when(~F.col("train"), at)).alias("test_first_timestamp"),
        F.count_if(F.col("train") & (at > first_test)).alias("train_rows_later"),
        F.count_if(F.col("train") & (at == first_test)).alias("train_rows_at_boundary"),
        F.count_if(~F.col("train") & (at == first_test)).alias("test_rows_at_boundary"),
    ).withColumn(
        "ordered", F.col("train_last_timestamp") <= F.col("test_first_timestamp")
    )


def rows_moved(base: DataFrame, other: DataFrame) -> DataFrame:
    """Rows that lie on different sides in two splits of the same table; must be empty. Both
    frames hold (transaction_id, side)."""
    return base.exceptAll(other).unionAll(other.exceptAll(base))


def window_span(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    first, past = F.min("timestamp"), F.max("timestamp")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("is_fraud").alias("frauds"),
        first.alias("from_timestamp"),
        past.alias("to_timestamp"),
        ((F.unix_micros(past) - F.unix_micros(first)) / F.lit(3.6e9)).alias("hours"),
    )


def split_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows, positives and base rate of every slice."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("is_fraud").alias("frauds"),
        F.avg("is_fraud").alias("fraud_rate"),
    )
