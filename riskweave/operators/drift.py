"""Feature drift between a reference table and a window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.scores import ratio
from riskweave.operators.ordered import range_order, ranked_quantiles, scan, scan_ranged
from riskweave.session import store

FLOOR = 1e-4


def known_double(column: str) -> Column:
    """The column as a number; NaN counts as missing."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None))


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, value, n) over all columns, summed per distinct value before the shuffle.
    NaN counts as missing."""
    entries = [
        F.struct(F.lit(c).alias("feature"), known_double(c).alias("value")) for c in columns
    ]
    return (
        df.select(*by, F.explode(F.array(*entries)).alias("e"))
        .select(*by, "e.*")
        .groupBy(*by, "feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def bin_of(value: Column, edges: Column) -> Column:
    """Open outer bins; a value equal to an edge goes right."""
    return F.size(F.filter(edges, lambda e: e <= value))


def bin_proportions(counts: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of known values per bin as one array per feature, empty bins included. `edges` has
    one row per feature, so its size is the number of columns."""
    binned = (
        counts.where(F.col("value").isNotNull())
        .join(F.broadcast(edges.select("feature", "inner_edges")), "feature")
        .groupBy(
            *by,
            "feature",
            "inner_edges",
            bin_of(F.col("value"), F.col("inner_edges")).alias("bin"),
        )
        .agg(F.sum("n").alias("n"))
    )
    by_bin = F.map_from_entries(F.collect_list(F.struct("bin", "n")))
    lists = binned.groupBy(*by, "feature", "inner_edges").agg(
        by_bin.alias("m"), F.sum("n").alias("known")
    )
    shares = F.transform(
        F.sequence(F.lit(0), F.size("inner_edges")),
        lambda b: ratio(F.coalesce(F.col("m")[b], F.lit(0)), F.col("known")),
    )
    return lists.select(*by, "feature", shares.alias("proportions"), "known")


def reference_stats(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """(feature, inner_edges, proportions, null_fraction, n_reference); a column without a
    known value has no row."""
    known = F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)
    # one ordered copy serves the quantiles, the bins and the missing shares
    counts = range_order(
        value_counts(df, columns).withColumn("_n", known), ["feature", "value"]
    )
    ranked = scan_ranged(counts, ["value"], ["_n"], within=["feature"])
    levels = [i / bins for i in range(1, bins)]
    edges = (
        ranked_quantiles(ranked.where("_n > 0"), "value", levels, ["feature"])
        .groupBy("feature")
        .agg(F.array_sort(F.collect_set("quantile")).alias("inner_edges"))
    )
    missing = F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0))
    nulls = counts.groupBy("feature").agg((missing / F.sum("n")).alias("null_fraction"))
    shares = bin_proportions(counts, edges)
    return (
        edges.join(shares, "feature")
        .join(nulls, "feature")
        .select(
            "feature",
            "inner_edges",
            "proportions",
            "null_fraction",
            F.col("known").alias("n_reference"),
        )
    )


def _share(x: Column, total: Column) -> Column:
    return F.greatest(x, F.lit(FLOOR)) / total


def psi(reference: Column, window: Column) -> Column:
    """Population stability index of two share arrays, floored and renormalised."""

    def floored_sum(shares: Column) -> Column:
        return F.aggregate(
            shares, F.lit(0.0), lambda acc, x: acc + F.greatest(x, F.lit(FLOOR))
        )

    r_sum, w_sum = floored_sum(reference), floored_sum(window)
    terms = F.zip_with(
        reference,
        window,
        lambda r, w: (_share(w, w_sum) - _share(r, r_sum))
        * F.log(_share(w, w_sum) / _share(r, r_sum)),
    )
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def drift_features(
    reference: DataFrame,
    window: DataFrame,
    watch: float,
    alert: float,
    columns: Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per (by and) reference feature: psi, status and missing shares. `columns` are the
    reference features; those absent from the window are reported, not skipped."""
    present = [c for c in columns if c in window.columns]
    absent = [c for c in columns if c not in window.columns]
    counts = value_counts(window, present, by)
    shares = bin_proportions(counts, reference, by).withColumnRenamed("proportions", "seen")
    missing = F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0))
    # a row for each (window and) column, read several times
    nulls = store(counts.groupBy(*by, "feature").agg((missing / F.sum("n")).alias("null_fraction")), "nulls")
    known = reference.select(
        "feature", "proportions", F.col("null_fraction").alias("null_fraction_reference")
    )
    value = psi(F.col("proportions"), F.col("seen"))
    status = (
        F.when(F.col("seen").isNull(), "all_null_in_window")
        .when(F.col("psi") >= alert, "alert")
        .when(F.col("psi") >= watch, "watch")
        .otherwise("stable")
    )
    rows = (
        nulls.join(F.broadcast(known), "feature")
        .join(shares, [*by, "feature"], "left")
        .withColumn("psi", F.when(F.col("seen").isNotNull(), value))
        .select(
            *by, "feature", "psi", status.alias("status"), "null_fraction",
            "null_fraction_reference",
        )
    )
    if not by:
        # an empty window has no value of any feature
        rows = rows.unionByName(
            known.where(F.col("feature").isin(present))
            .join(nulls.select("feature"), "feature", "left_anti")
            .select(
                "feature",
                F.lit(None).cast("double").alias("psi"),
                F.lit("all_null_in_window").alias("status"),
                F.lit(None).cast("double").alias("null_fraction"),
                "null_fraction_reference",
            )
        )
    if not absent:
        return rows
    lost = known.where(F.col("feature").isin(absent))
    if by:
        # a row for each window and column
        names = F.array(*[F.lit(c) for c in absent])
        lost = window.select(*by).distinct().withColumn("feature", F.explode(names)).join(F.broadcast(lost), "feature")
    gone = lost.select(
        *by,
        "feature",
        F.lit(None).cast("double").alias("psi"),
        F.lit("missing_from_window").alias("status"),
        F.lit(None).cast("double").alias("null_fraction"),
        "null_fraction_reference",
    )
    return rows.unionByName(gone)


def drift_summary(features: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Worst feature (first name among equals), its psi, and the number of alerts."""
    scored = F.when(F.col("psi").isNotNull(), F.struct(-F.col("psi"), F.col("feature")))
    worst = F.min(scored)
    return features.groupBy(*by).agg(
        worst.getField("feature").alias("worst_feature"),
        F.max("psi").alias("worst_psi"),
        F.count_if(F.col("status") == "alert").alias("n_alerts"),
        F.count_if(F.col("status") == "watch").alias("n_watch"),
        F.count(F.lit(1)).alias("n_features"),
    )


def paired_counts(reference: DataFrame, window: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, n_ref, n_cur) over known values of both tables."""
    ref = value_counts(reference, columns).select(
        "feature", "value", F.col("n").alias("n_ref"), F.lit(0).cast("long").alias("n_cur")
    )
    cur = value_counts(window, columns).select(
        "feature", "value", F.lit(0).cast("long").alias("n_ref"), F.col("n").alias("n_cur")
    )
    return (
        ref.unionByName(cur)
        .where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    )


def wasserstein(
    reference: DataFrame, window: DataFrame, columns: Sequence[str], floor: float = 0.001,
    counts: DataFrame | None = None,
) -> DataFrame:
    """First Wasserstein distance per column over the reference's standard deviation. `counts` are
    the paired counts of these columns, where they are known already."""
    counts = paired_counts(reference, window, columns) if counts is None else counts
    counts = counts.withColumn("at", F.col("value"))
    ranked = scan(counts, ["value"], sums=["n_ref", "n_cur"], last=["at"], within=["feature"])
    gap = F.col("value") - F.col("at_prev")
    apart = F.abs(
        ratio(F.col("n_ref_before"), F.col("n_ref_total"))
        - ratio(F.col("n_cur_before"), F.col("n_cur_total"))
    )
    spreads = reference.agg(
        *[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in columns]
    ).select(
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("feature"), F.col(c).alias("spread")) for c in columns]
            )
        ).alias("e")
    ).select("e.*")
    return (
        ranked.groupBy("feature")
        .agg(
            F.when(
                (F.max("n_ref_total") > 0) & (F.max("n_cur_total") > 0),
                F.coalesce(F.sum(apart * gap), F.lit(0.0)),
            ).alias("distance")
        )
        .join(spreads, "feature")
        .select(
            "feature",
            (F.col("distance") / F.greatest(F.col("spread"), F.lit(floor))).alias("score"),
        )
    )


def jensen_shannon(
    reference: DataFrame, window: DataFrame, columns: Sequence[str], counts: DataFrame | None = None
) -> DataFrame:
    """Jensen-Shannon distance (natural log) between the value shares of each column. `counts` are
    the paired counts of these columns, where they are known already."""
    counts = paired_counts(reference, window, columns) if counts is None else counts
    totals = counts.groupBy("feature").agg(
        F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur")
    )
    r, c = ratio(F.col("n_ref"), F.col("t_ref")), ratio(F.col("n_cur"), F.col("t_cur"))
    m = (r + c) / 2

    def half(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x / m)).otherwise(0.0)

    return (
        counts.join(F.broadcast(totals), "feature")
        .groupBy("feature")
        .agg(F.sqrt(F.greatest(F.sum(half(r) + half(c)) / 2, F.lit(0.0))).alias("score"))
    )


def distance_drift(
    reference: DataFrame,
    window: DataFrame,
    columns: Sequence[str],
    threshold: float = 0.1,
    max_categories: int = 5,
) -> DataFrame:
    """(feature, method, score, drifted): Jensen-Shannon for columns with few distinct reference
    values, normed Wasserstein for the others."""
    counts = store(paired_counts(reference, window, columns), "paired")  # each table counted once
    kinds = (
        counts.where("n_ref > 0")
        .groupBy("feature")
        .agg((F.count(F.lit(1)) <= max_categories).alias("few"))
    )
    few = sorted(r["feature"] for r in kinds.where("few").collect())
    many = [c for c in columns if c not in few]
    parts = []
    if few:
        parts.append(
            jensen_shannon(reference, window, few, counts.where(F.col("feature").isin(few))).withColumn("method", F.lit("jensen_shannon"))
        )
    if many:
        parts.append(
            wasserstein(reference, window, many, counts=counts.where(F.col("feature").isin(many))).withColumn("method", F.lit("wasserstein"))
        )
    table = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return table.select(
        "feature", "method", "score", (F.col("score") > threshold).alias("drifted")
    )


def dataset_drift(distances: DataFrame, share: float = 0.5) -> DataFrame:
    drifted = F.avg(F.col("drifted").cast("double"))
    return distances.agg(
        F.count(F.lit(1)).alias("columns"),
        F.count_if("drifted").alias("drifted_columns"),
        drifted.alias("drifted_share"),
        (drifted >= share).alias("dataset_drift"),
        F.count_if(F.col("method") == "wasserstein").alias("wasserstein_columns"),
        F.count_if(F.col("method") == "jensen_shannon").alias("jensen_shannon_columns"),
    )


def window_performance(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Change between two bootstrap tables (metric, point, ci_lower, ci_upper), and whether each
    point lies inside the other interval."""
    r, c = reference.alias("r"), current.alias("c")
    return r.join(c, "metric").select(
        "metric",
        F.col("r.point").alias("reference_point"),
        F.col("c.point").alias("current_point"),
        (F.col("c.point") - F.col("r.point")).alias("change"),
        F.col("r.point")
        .between(F.col("c.ci_lower"), F.col("c.ci_upper"))
        .alias("reference_inside_current"),
        F.col("c.point")
        .between(F.col("r.ci_lower"), F.col("r.ci_upper"))
        .alias("current_inside_reference"),
    )
