"""Mixing of sources to target weights by entropy balancing.

Each document has a rate, how often the mix takes it on average. Of all rates that give every
source its target of words, those are wanted that differ least from one, in relative entropy,
under a cap. They are min(cap, exp(dual * size)), with one dual variable per source, and the
dual variables solve a convex problem: its gradient is the words that a source's rates give less
its target, and no source enters another's. Newton steps run on Spark over the table of (source,
size) counts, inside a bracket that every step narrows. Rates are then rounded into copies.

The rounding walks a source's sizes from the largest down and carries the words that it owes or
has in excess, so a source ends within about its smallest document of its target. Documents of
one source and size are alike; a seeded hash picks those with the extra copy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from riskweave.session import store

WEIGHTS = (3, 1, 2)  # of the sources by name, repeating
SHARE = 1.5  # words of the mix, as a part of all
CAP = 2  # copies of a document, and words of a source, as a multiple of its size
SEED = 42
TOLERANCE = 1e-7  # gap to a target, as a part of it, at which the steps end
MOST_STEPS = 200  # halving alone needs fewer
PARTS = 64  # parts of documents alike in source and size
PART_ROWS = 1 << 20

_WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Runs of characters other than blanks and tabs to carriage returns; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def weighted_sources(cells: DataFrame, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, docs, weight) from the (source, size, n) counts: weights go round
    the sources in order of their names, by code point, the missing name last."""
    totals = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    # the bytes of UTF-8 sort as code points do; a source's place is the number of those before
    named = totals.withColumn("_no", F.col("source").isNull())
    ranged = store(
        named.repartitionByRange("_no", "source").withColumn("_bucket", F.spark_partition_id()), "sources"
    )
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # a row per range partition
    carry = ranged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_in")).select(
        "_bucket", F.coalesce(F.sum("_in").over(ahead), F.lit(0)).alias("_carry")
    )
    inside = Window.partitionBy("_bucket").orderBy("_no", "source")
    place = F.row_number().over(inside) - 1 + F.col("_carry")
    table = F.array(*[F.lit(int(w)) for w in weights])
    return (
        ranged.join(F.broadcast(carry), "_bucket")
        .withColumn("weight", table[F.pmod(place, F.lit(len(weights))).cast("int")])
        .select("source", "source_size", "docs", "weight")
    )


def capped_targets(sources: DataFrame, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """`sources` with `target`: words shared by weight; a source stops at `cap` times its size
    and the excess is shared again among the others until none is above. Only the open sources'
    weight and the words left to share reach the driver, once per round."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    state, before = sources.withColumn("capped", F.lit(False)), -1
    while True:
        open_weight, taken, capped = state.agg(
            F.sum(F.when(~F.col("capped"), F.col("weight"))),
            F.sum(F.when(F.col("capped"), cap * F.col("source_size"))),
            F.count_if("capped"),
        ).first()
        left = share * total - (taken or 0)
        part = F.col("weight") * F.lit(float(left)) / F.lit(float(open_weight or 1))
        most = cap * F.col("source_size")
        if not open_weight or capped == before:
            target = F.when(F.col("capped"), most).otherwise(part).cast("double")
            return state.withColumn("target", target).drop("capped")
        before = capped
        state = store(state.withColumn("capped", F.col("capped") | (part > most)), "targets")


def rate(dual: Column, x: Column, cap: int = CAP) -> Column:
    """The tilted rate of a document, x its size in units of its source's mean size."""
    return F.least(F.lit(float(cap)), F.exp(dual * x))


def solve_duals(cells: DataFrame, sources: DataFrame, cap: int = CAP, tolerance: float = TOLERANCE) -> DataFrame:
    """`sources` with `mean` and `dual`, by Newton steps kept inside a shrinking bracket.

    A step outside its bracket is replaced by the middle. A table with a row per source is all
    that a step writes; whether any source is still open is all that reaches the driver.
    """
    size, target, total = F.col("size"), F.col("target"), F.col("source_size")
    least = cells.where("size > 0").groupBy("source").agg(F.min("size").alias("_least"))
    mean = total / F.col("docs")
    smallest = F.try_divide(F.col("_least"), F.col("mean"))
    begun = (
        sources.join(least.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
        .withColumn("mean", mean)
        .withColumns(
            {
                # every rate is at the cap from `high` on; at `low` even the smallest is below
                # target / size
                "low": F.least(F.lit(0.0), F.log(F.try_divide(target, total)) / smallest),
                "high": F.lit(float(np.log(cap))) / smallest,
                # the start is right where all sizes are alike
                "dual": F.when(target >= cap * total, F.lit(float(np.log(cap))) / smallest).otherwise(
                    F.log(F.try_divide(target, total))
                ),
            }
        )
        .withColumn("open", (total > 0) & (target < cap * total))
        .drop("_s", "_least")
    )
    def kept(df: DataFrame) -> tuple[DataFrame, int]:
        """Written, and the sources still open, counted while writing."""
        seen = Observation()
        table = store(df.observe(seen, F.count_if("open").alias("open")), "duals")
        return table, int(seen.get["open"])

    state, left = kept(begun)
    wide = cells.where("size > 0")
    for _ in range(MOST_STEPS):
        if not left:
            break
        now = state.where("open").select(F.col("source").alias("_s"), "dual", "mean")
        x = size / F.col("mean")
        r = rate(F.col("dual"), x, cap)
        sums = (
            wide.join(now, F.col("source").eqNullSafe(F.col("_s")))
            .groupBy("_s")
            .agg(
                F.sum(F.col("n") * size * r).alias("_given"),
                F.sum(F.when(r < cap, F.col("n") * size * x * r)).alias("_slope"),
            )
        )
        gap = F.col("_given") - target
        newton = F.col("dual") - F.try_divide(gap, F.col("_slope"))
        low = F.when(gap < 0, F.col("dual")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("dual")).otherwise(F.col("high"))
        stepped = (
            state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left")
            .withColumns({"_gap": gap, "_newton": newton})
            .withColumns({"low": F.when(F.col("open"), low).otherwise(F.col("low")), "high": F.when(F.col("open"), high).otherwise(F.col("high"))})
            .withColumn("_done", F.abs("_gap") <= tolerance * target)
            .withColumn(
                "dual",
                F.when(~F.col("open") | F.col("_done"), F.col("dual"))
                .when((F.col("_newton") > F.col("low")) & (F.col("_newton") < F.col("high")), F.col("_newton"))
                .otherwise((F.col("low") + F.col("high")) / 2),
            )
            .withColumn("open", F.col("open") & ~F.col("_done"))
        )
        state, left = kept(stepped.select(*state.columns))
    return state.drop("low", "high", "open")


def round_copies(size: np.ndarray, n: np.ndarray, expected: np.ndarray, cap: int) -> np.ndarray:
    """Copies of all documents of each size, at most `cap` times `n`.

    From the largest size down, each count is what is expected rounded down or up, whichever
    leaves less owed together with what the sizes before left over, in words. What is owed in
    the end goes to single documents, each the one nearest in size. Sizes of 0 get a copy each:
    they weigh nothing.
    """
    out = n.astype(np.int64).copy()
    owed = 0.0
    for k in np.argsort(-size, kind="stable").tolist():
        s = int(size[k])
        if s == 0:
            continue
        want = expected[k] * s + owed
        down, up = math.floor(expected[k] + 1e-9), math.ceil(expected[k] - 1e-9)
        out[k] = min(max(math.floor(want / s + 0.5), down), up, cap * int(n[k]))
        owed = want - float(out[k]) * s
    while abs(owed) > 0.5:
        room = (size > 0) & ((out < cap * n) if owed > 0 else (out > 0)) & (size < 2 * abs(owed))
        if not room.any():
            break
        k = int(np.argmin(np.where(room, np.abs(size - abs(owed)), np.inf)))
        out[k] += 1 if owed > 0 else -1
        owed -= math.copysign(float(size[k]), owed)
    return out


def copies_of_cells(cells: DataFrame, duals: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, size, n, copies, source_size, target): a source of W words has at most sqrt(2 W)
    different sizes, which is what one task holds at a time."""
    joined = cells.join(duals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        "source", "size", "n", "source_size", "target",
        F.when(F.col("size") > 0, F.col("n") * rate(F.col("dual"), F.col("size") / F.col("mean"), cap)).otherwise(0.0).alias("expected"),
    )

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ignore_index=True)
        found = round_copies(
            rows["size"].to_numpy(), rows["n"].to_numpy(), rows["expected"].to_numpy(), cap
        )
        return rows.drop(columns="expected").assign(copies=found)

    kind = cells.schema["source"].dataType.simpleString()
    return joined.groupBy("source").applyInPandas(
        settle, f"source {kind}, size long, n long, source_size long, target double, copies long"
    )


def mixed(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    seed: int = SEED,
) -> DataFrame:
    """(id, size, source, source_size, target, copies, taken), a row for each row of `docs`.

    `copies` is how often the mix takes the document, at most `cap`, and `taken` the words that
    makes. Documents without words are taken once. Rows without a source are a source of their
    own, the last one; null texts have no words. Which of the documents alike in source and size
    get the extra copy depends on a seeded hash of the id, so equal input gives equal copies;
    rows alike in id, source and size are interchangeable. An empty table gives an empty result.
    """
    slim = store(
        docs.select(
            F.col(id_column).alias("_id"),
            F.col(source_column).cast("string").alias("source"),
            words(F.col(text_column)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_column).cast("string")).alias("_hash"),
            # ids may repeat; rows of one id spread over the parts by their text
            F.xxhash64(F.lit(seed), F.col(id_column).cast("string"), F.col(text_column)).alias("_tie"),
        ),
        "sizes",
    )
    rows = slim.count()
    parts = max(PARTS, -(-rows // PART_ROWS))
    slim = slim.withColumn("_part", F.pmod(F.col("_hash"), F.lit(parts)).cast("int"))
    split = store(slim.groupBy("source", "size", "_part").agg(F.count(F.lit(1)).alias("n")), "parts")
    cells = store(split.groupBy("source", "size").agg(F.sum("n").alias("n")), "cells")
    targets = capped_targets(weighted_sources(cells, weights), share, cap)
    settled = copies_of_cells(cells, solve_duals(cells, targets, cap), cap)
    # every document of a cell gets the whole copies, the first `_extra` by (part, hash) one more
    cell = settled.select(
        F.col("source").alias("_cs"), F.col("size").alias("_cz"), "source_size", "target",
        F.floor(F.col("copies") / F.col("n")).alias("_each"), (F.col("copies") % F.col("n")).alias("_extra"),
    )
    ahead = Window.partitionBy("source", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(ahead), F.lit(0))
    shares = (
        split.join(cell, F.col("source").eqNullSafe(F.col("_cs")) & (F.col("size") == F.col("_cz")))
        .withColumn("_more", F.greatest(F.lit(0), F.col("_extra") - before))
        .select(
            F.col("source").alias("_ps"), F.col("size").alias("_pz"), F.col("_part").alias("_pp"),
            "source_size", "target", "_each", "_more",
        )
    )
    order = Window.partitionBy("source", "size", "_part").orderBy("_hash", "_id", "_tie")
    same = F.col("source").eqNullSafe(F.col("_ps")) & (F.col("size") == F.col("_pz")) & (F.col("_part") == F.col("_pp"))
    return (
        slim.join(shares, same)
        .withColumn("copies", (F.col("_each") + (F.row_number().over(order) <= F.col("_more")).cast("int")).cast("long"))
        .select(
            F.col("_id").alias(id_column), "size", "source", "source_size", "target", "copies",
            (F.col("size") * F.col("copies")).alias("taken"),
        )
    )


def written_out(docs: DataFrame, mix: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """`docs` with each row as often as the mix takes it. `mix` holds the copies per id, which
    must be unique here."""
    copies = mix.select(F.col(id_column).alias("_mix_id"), F.col("copies").alias("_mix_copies"))
    joined = docs.join(copies, F.col(id_column).eqNullSafe(F.col("_mix_id")))
    repeated = F.explode(F.array_repeat(F.lit(0), F.col("_mix_copies").cast("int")))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], repeated.alias("_copy")).drop("_copy")
