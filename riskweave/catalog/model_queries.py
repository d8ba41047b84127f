"""Fits and scores.

SQL can't fit a model. It counts the rows and states what must hold of every score: `within`
says that it is a probability, other flags compare scores with what SQL or a second path makes
of them. Fits and intervals have the full budgets of `Options`."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave.catalog.common import (
    EVENTS_SQL,
    ORDERS_SQL,
    SCORE,
    SIDES_SQL,
    events_tx,
    orders_tx,
    query,
    rounded,
    scored,
    with_sql,
)
from riskweave.catalog.feature_queries import window_sql
from riskweave.catalog.metric_queries import FOLD_ROWS_SQL
from riskweave.catalog.policy_queries import COST_SCENARIOS
from riskweave.catalog.split_queries import INNER_SQL
from riskweave.functions.features import add_time_features, with_absent_inputs
from riskweave.models import attribution, calibrate, detector, grid, registry
from riskweave.models.forest import probabilities, unpacked
from riskweave.operators import velocity
from riskweave.operators.drift import reference_stats
from riskweave.operators.resample import paired_delta_bootstrap
from riskweave.operators.splits import temporal_grouped_split
from riskweave.options import VELOCITY_WINDOWS, Options
from riskweave.plans import rolling_report as rolling_plan
from riskweave.plans.comparison import compare_variants, sliced, without_dead_columns
from riskweave.plans.cost import priced_points
from riskweave.plans.rolling_report import check_headline, headline, rolling_report
from riskweave.plans.training import calibration_report, train_and_evaluate
from riskweave.schema import numeric_columns
from riskweave.session import freeze, scratch_path, store

FULL = Options()


TEST_ROWS_SQL = with_sql(EVENTS_SQL, SIDES_SQL) + """SELECT transaction_id, {} FROM tx
  JOIN side ON tx.entity_id = side.entity_id WHERE side = 'test'"""
WITHIN_SQL = TEST_ROWS_SQL.format("true AS within")


def within(column: str = "p"):
    """A probability, neither missing nor certain."""
    p = F.col(column)
    return F.coalesce((p > 0) & (p < 1), F.lit(False)).alias("within")


def sides(spark, folder):
    train, test = temporal_grouped_split(add_time_features(events_tx(spark, folder)))
    return freeze(train), freeze(test)


@query(
    "f4_one_hot_features",
    with_sql(EVENTS_SQL, SIDES_SQL)
    + """, cats AS (SELECT DISTINCT category FROM tx JOIN side ON tx.entity_id = side.entity_id
  WHERE side = 'train')
SELECT transaction_id, CASE WHEN category <> 'c0' THEN (SELECT count(*) FROM cats k
  WHERE k.category < tx.category) ELSE -1 END AS hot_slot, (SELECT count(*) FROM cats) AS n_slots,
  amount
FROM tx JOIN side ON tx.entity_id = side.entity_id WHERE side = 'test'""",
)
def one_hot(spark, folder):
    """Fit on train. Category c0 is renamed on the test side, so it is unseen: all zeros."""
    train, test = sides(spark, folder)
    stages = detector.preprocessor(["amount"], ["category"])
    fitted = Pipeline(stages=stages).fit(train)
    unseen = F.when(F.col("category") == "c0", "never").otherwise(F.col("category"))
    rows = fitted.transform(test.withColumn("category", unseen))
    hot = vector_to_array("category_hot")
    return rows.select(
        "transaction_id",
        (F.array_position(hot, 1.0) - 1).alias("hot_slot"),
        F.size(hot).cast("long").alias("n_slots"),
        F.element_at(vector_to_array("features"), -2).alias("amount"),
    )


@query("f5_transform_with_absent_inputs", WITHIN_SQL)
def absent_inputs(spark, folder):
    """A frame without two of the model's inputs still scores."""
    train, test = sides(spark, folder)
    model = detector.fit(train, "logreg")
    out = detector.score(model, test.drop("f_k", "category"))
    return out.select("transaction_id", within())


DAY = {"24h": 86_400_000_000}
KINDS = ("count_24h", "amt_sum_24h", "amt_mean_24h", "amt_ratio_24h", "seconds_since_prev")


@query(
    "f9_velocity_columns",
    f"""WITH {ORDERS_SQL},
a AS (WITH {window_sql("f_vel_", "", DAY)}),
b AS (WITH {window_sql("f_ent_", "PARTITION BY entity_id ", DAY)})
"""
    + " UNION ALL ".join(
        f"""SELECT '{prefix}{kind}' AS "column", max({prefix}{kind}) AS largest FROM {source}"""
        for prefix, source in (("f_vel_", "a"), ("f_ent_", "b"))
        for kind in KINDS
    ),
)
def velocity_inputs(spark, folder):
    """Velocity columns by prefix, with their ranges over the table."""
    wide = velocity.add_velocity(orders_tx(spark, folder), DAY)
    names = velocity.velocity_columns(wide)
    table = wide.agg(*[F.max(c).alias(c) for c in names])
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).alias("largest")) for c in names]
    return table.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def _fit_and_score(model: str):
    def run(spark, folder):
        train, test = sides(spark, folder)
        fitted = detector.fit(train, model, FULL.seed, FULL.rounds, FULL.learning_rate)
        return detector.scored_table(fitted, test).select("transaction_id", "y", within())

    return run


for _id, _model in (
    ("m1_boosted_trees", "gbt"),
    ("m2_boosted_trees_shallow", "gbt_shallow"),
    ("m2_boosted_trees_deep", "gbt_deep"),
    ("m3_linear_baseline", "logreg"),
    ("m4_alternative_ensemble", "forest"),
):
    query(_id, TEST_ROWS_SQL.format("is_fraud AS y, true AS within"))(_fit_and_score(_model))


@query(
    "m5_model_registry",
    with_sql(EVENTS_SQL, SIDES_SQL)
    + """SELECT unnest(['forest', 'gbt', 'gbt_deep', 'gbt_shallow', 'logreg']) AS model,
  count(*) AS train_rows, true AS named_once
FROM tx JOIN side ON tx.entity_id = side.entity_id WHERE side = 'train'""",
)
def model_registry(spark, folder):
    """Every registered model by name, with the rows it would train on; a taken name is refused."""
    train, _ = temporal_grouped_split(events_tx(spark, folder))

    def refused(name: str) -> bool:
        try:
            registry.register(name)(lambda *a, **k: None)
        except ValueError:
            return True
        return False

    entries = [
        F.struct(F.lit(n).alias("model"), F.lit(refused(n)).alias("named_once"))
        for n in registry.available()
    ]
    return train.agg(F.count(F.lit(1)).alias("train_rows")).select(
        F.explode(F.array(*entries)).alias("e"), "train_rows"
    ).select("e.model", "train_rows", "e.named_once")


@query("m6_probability", WITHIN_SQL)
def probability(spark, folder):
    train, test = sides(spark, folder)
    out = detector.score(detector.fit(train, "logreg"), test)
    return out.select("transaction_id", within())


@query("m7_score_and_decide", TEST_ROWS_SQL.format("true AS within, true AS decided"))
def score_and_decide(spark, folder):
    train, test = sides(spark, folder)
    out = detector.score_and_decide(detector.fit(train, "logreg"), test, 0.55)
    # the decision worked out anew from the score: flagged or cleared where sure, else reviewed
    sure = F.greatest(F.col("p"), 1 - F.col("p"))
    wanted = F.when(sure < 0.55, "review").when(F.col("p") >= 0.5, "fraud").otherwise("legit")
    same = (F.col("decision") == wanted) & (F.col("confidence") == sure)
    return out.select("transaction_id", within(), same.alias("decided"))


def _platt_sql(steps: int = 12) -> str:
    """Newton steps from (0, 0), one after the other, on the train side's log-odds."""
    clipped = "greatest(least(p, 1 - 1e-12), 1e-12)"
    out = f"""z AS MATERIALIZED (SELECT ln({clipped} / (1 - {clipped})) AS z, is_fraud AS y FROM tx
  JOIN side ON tx.entity_id = side.entity_id, LATERAL (SELECT {SCORE} AS p) WHERE side = 'train'),
s0 AS MATERIALIZED (SELECT 0e0 AS a, 0e0 AS b)"""
    for k in range(steps):
        out += f""",
g{k} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum((q - y) * z) + 1e-9 * count(*) * any_value(a) AS ga,
  sum(q - y) + 1e-9 * count(*) * any_value(b) AS gb, sum(q * (1 - q) * z * z) + 1e-9 * count(*) AS haa,
  sum(q * (1 - q) * z) AS hab, sum(q * (1 - q)) + 1e-9 * count(*) AS hbb
  FROM (SELECT z, y, a, b, 1 / (1 + exp(-(a * z + b))) AS q FROM z, s{k})),
s{k + 1} AS MATERIALIZED (SELECT a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a,
  b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM g{k})"""
    return out + f""", scored AS (SELECT transaction_id, {SCORE} AS p FROM tx
  JOIN side ON tx.entity_id = side.entity_id WHERE side = 'test')
SELECT transaction_id, round(a, 6) AS a, round(b, 6) AS b,
  round(1 / (1 + exp(-(a * ln({clipped} / (1 - {clipped})) + b))), 6) AS p_platt
FROM scored, s{steps}"""


@query("m8_platt_map", with_sql(EVENTS_SQL, SIDES_SQL, _platt_sql()))
def platt_map(spark, folder):
    """The fitted map and its value for every row."""
    train, test = temporal_grouped_split(events_tx(spark, folder))
    platt = calibrate.fit_platt(scored(train))
    return scored(test).select(
        "transaction_id",
        F.round(F.lit(platt.a), 6).alias("a"),
        F.round(F.lit(platt.b), 6).alias("b"),
        F.round(platt.apply(F.col("p")), 6).alias("p_platt"),
    )


# two digits: SQL compares all pairs of distinct scores
COARSE = "floor(1e2 * amount / (amount + 20e0)) / 1e2"


@query(
    "m9_isotonic_map",
    with_sql(
        EVENTS_SQL,
        SIDES_SQL,
        f"""d AS (SELECT p, sum(is_fraud) AS y, count(*) AS n FROM (SELECT {COARSE} AS p, is_fraud FROM tx
  JOIN side ON tx.entity_id = side.entity_id WHERE side = 'train') GROUP BY p)""",
        """c AS (SELECT p, y, n, row_number() OVER (ORDER BY p) AS i, sum(y) OVER (ORDER BY p) AS cy,
  sum(n) OVER (ORDER BY p) AS cn FROM d)""",
        # of all stretches from j on that reach i or beyond, the least mean; of those the largest
        """m AS (SELECT j.i AS j, k.i AS k, (k.cy - j.cy + j.y) / CAST(k.cn - j.cn + j.n AS DOUBLE) AS mean
  FROM c j JOIN c k ON j.i <= k.i)""",
        """least AS (SELECT j, k AS i, min(mean) OVER (PARTITION BY j ORDER BY k DESC) AS low FROM m)""",
        """iso AS (SELECT c.p, max(low) AS rate FROM least JOIN c ON c.i = least.i GROUP BY 1)""",
        f"""t AS (SELECT transaction_id, {COARSE} AS p FROM tx
  JOIN side ON tx.entity_id = side.entity_id WHERE side = 'test')""",
        """u AS (SELECT t.transaction_id, t.p, max(x.p) FILTER (x.p <= t.p) AS lo, min(x.p) FILTER (x.p >= t.p) AS hi
  FROM t, iso x GROUP BY 1, 2)""",
    )
    + """SELECT transaction_id, round(CASE WHEN a.rate IS NULL THEN b.rate WHEN b.rate IS NULL OR lo = hi THEN a.rate
  ELSE a.rate + (b.rate - a.rate) * (u.p - lo) / (hi - lo) END, 9) AS p_isotonic
FROM u LEFT JOIN iso a ON a.p = lo LEFT JOIN iso b ON b.p = hi""",
)
def isotonic_map(spark, folder):
    """By pooling in small blocks, against the largest of the least means."""
    train, test = temporal_grouped_split(events_tx(spark, folder))
    coarse = F.floor(F.lit(1e2) * F.col("amount") / (F.col("amount") + F.lit(20.0))) / F.lit(1e2)
    model = calibrate.fit_isotonic(train.select(F.col("is_fraud").alias("y"), coarse.alias("p")), block_rows=16)
    found = model.transform(test.select("transaction_id", coarse.alias("p")))
    return rounded(found.select("transaction_id", "p_isotonic"), ["p_isotonic"])


@query(
    "m10_calibration_report",
    with_sql(EVENTS_SQL, INNER_SQL)
    + """SELECT side AS slice, unnest(['raw', 'platt', 'isotonic']) AS scale, count(*) AS n,
  CAST(sum(is_fraud) AS BIGINT) AS positives, true AS sound, true AS same_order
FROM tx JOIN sides ON tx.entity_id = sides.entity_id WHERE side <> 'fit' GROUP BY side""",
)
def calibration(spark, folder):
    """Sizes of the slices; a rising Platt map keeps average precision, a falling one need not."""
    run = calibration_report(events_tx(spark, folder), FULL)
    rows = freeze(run.summary)
    raw = rows.where("scale = 'raw'").select("slice", F.col("average_precision").alias("raw_ap"))
    sound = F.col("brier").between(0, 1) & (F.col("score_min") >= 0) & (F.col("score_max") <= 1)
    same = (F.col("scale") != "platt") | F.lit(run.platt.a <= 0) | (F.abs(F.col("average_precision") - F.col("raw_ap")) < 1e-9)
    return rows.join(raw, "slice").select(
        "slice", "scale", "n", "positives", sound.alias("sound"), same.alias("same_order")
    )


# The published variants, the first of them the incumbent. The slow and the shallow
# one take twice the rounds at half the step.
FOUR = (
    grid.Variant("gbt_default", "gbt", FULL.rounds, FULL.learning_rate),
    grid.Variant("gbt_slow", "gbt", 2 * FULL.rounds, FULL.learning_rate / 2),
    grid.Variant("gbt_shallow", "gbt_shallow", 2 * FULL.rounds, FULL.learning_rate / 2),
    grid.Variant("gbt_deep", "gbt_deep", FULL.rounds, FULL.learning_rate),
)
GRID_SQL = f"""(SELECT unnest(['base', 'base+velocity']) AS feature_set)
CROSS JOIN (SELECT unnest({[v.name for v in FOUR]!r}) AS variant)"""


@query(
    "m11_model_grid",
    f"SELECT feature_set, variant, true AS within FROM {GRID_SQL} WHERE (SELECT count(*) FROM events) > 0",
)
def model_grid(spark, folder):
    """Four variants, with and without the velocity columns of stream and entities."""
    tx = store(add_time_features(events_tx(spark, folder)))
    wide, _ = without_dead_columns(sliced(velocity.add_velocity(tx, VELOCITY_WINDOWS), FULL))
    sets = {"base": sliced(tx, FULL), "base+velocity": wide}
    results = store(grid.grid_results(grid.grid_scores(sets, FOUR, FULL.seed)))
    chosen = grid.selection(results, FOUR, list(sets)).first()
    key = F.concat_ws("|", "feature_set", "variant")
    best = results.agg(F.max(F.round("validation_ap", 4))).scalar()
    selected = key == chosen["selected_by_validation"]
    sound = F.col("validation_ap").between(0, 1) & F.col("test_ap").between(0, 1)
    sound = sound & (~selected | (F.round("validation_ap", 4) == best))
    return results.select("feature_set", "variant", sound.alias("within"))


@query(
    "m11_comparison_plan",
    f"""SELECT feature_set || '|' || variant AS challenger, true AS holds, true AS bounded
FROM {GRID_SQL}
WHERE feature_set || '|' || variant <> 'base|gbt_default' AND (SELECT count(*) FROM events) > 0""",
)
def comparison_plan(spark, folder):
    """Four variants on both feature sets, each against the incumbent on the same resamples."""
    tx = events_tx(spark, folder)
    out = compare_variants(tx, FOUR, VELOCITY_WINDOWS, FULL).deltas
    d, lo, hi = F.col("delta"), F.col("ci_lower"), F.col("ci_upper")
    return out.select(
        "challenger",
        ((lo <= d) & (d <= hi)).alias("holds"),
        ((lo >= -1) & (hi <= 1)).alias("bounded"),
    )


@query(
    "a5_priced_calibrated_scores",
    f"""SELECT unnest({[s[0] for s in COST_SCENARIOS]!r}) AS scenario, true AS cheapest, true AS saves
WHERE (SELECT count(*) FROM events) > 0""",
)
def priced_calibrated_scores(spark, folder):
    """The cheapest point of each scenario, against every other point of its curve."""
    found = priced_points(events_tx(spark, folder), COST_SCENARIOS, FULL)
    low = found.curve.groupBy("scenario").agg(F.min("expected_cost").alias("low"))
    return found.cheapest.join(low, "scenario").select(
        "scenario",
        (F.col("min_expected_cost") == F.col("low")).alias("cheapest"),
        (F.col("savings_vs_full_automation") >= 0).alias("saves"),
    )


@query(
    "m12_booster_comparison",
    "SELECT true AS holds, true AS bounded WHERE (SELECT count(*) FROM events) > 0",
)
def booster_comparison(spark, folder):
    """Incumbent trees against the alternative ensemble, with the paired interval."""
    variants = [grid.Variant(m, m, FULL.rounds, FULL.learning_rate) for m in ("gbt", "forest")]
    sets = {"base": sliced(add_time_features(events_tx(spark, folder)), FULL)}
    scores = grid.grid_scores(sets, variants, FULL.seed)
    pairs = grid.paired_scores(scores, "base|gbt", "base|forest")
    out = paired_delta_bootstrap(pairs, FULL.resamples, FULL.seed)
    d, lo, hi = F.col("delta"), F.col("ci_lower"), F.col("ci_upper")
    return out.select(
        ((lo <= d) & (d <= hi)).alias("holds"), ((lo >= -1) & (hi <= 1)).alias("bounded")
    )


def _explained(spark, folder):
    train, test = sides(spark, folder)
    model = detector.fit(train, "gbt", FULL.seed, FULL.rounds, FULL.learning_rate)
    return model, attribution.contributions(model, test)


@query(
    "m13_attribution_ranking",
    """SELECT unnest(['all', 'fraud']) AS scope, true AS falling, true AS signed
WHERE (SELECT count(*) FROM events) > 0""",
)
def attribution_ranking(spark, folder):
    train, test = sides(spark, folder)
    model = detector.fit(train, "gbt", FULL.seed, FULL.rounds, FULL.learning_rate)
    names = attribution.feature_labels(model.transform(test))
    top = attribution.attribution_ranking(attribution.contributions(model, test), names)
    ahead = F.lag("mean_abs").over(Window.partitionBy("scope").orderBy("rank"))
    rows = top.withColumn("falling", F.coalesce(ahead >= F.col("mean_abs"), F.lit(True)))
    return rows.groupBy("scope").agg(
        F.bool_and("falling").alias("falling"),
        F.bool_and(F.abs("mean_signed") <= F.col("mean_abs")).alias("signed"),
    )


@query(
    "m14_attribution_additivity",
    "SELECT true AS adds_up WHERE (SELECT count(*) FROM events) > 0",
)
def attribution_additivity(spark, folder):
    """Base value and contributions add up to the margin."""
    error = attribution.additivity_error(_explained(spark, folder)[1])
    return error.select((F.col("max_abs_error") < 1e-9).alias("adds_up"))


@query("m15_saved_bundle", TEST_ROWS_SQL.format("true AS within, true AS same"))
def saved_bundle(spark, folder):
    """Model and drift reference written together and read back."""
    train, test = sides(spark, folder)
    out = scratch_path(spark, "bundle")
    unsaved = detector.fit(train, "logreg")
    detector.save_bundle(unsaved, reference_stats(train, numeric_columns(train)), out)
    model, reference = detector.load_bundle(spark, out)
    columns = numeric_columns(train)
    held = reference.select(F.collect_set("feature")).scalar()
    first = detector.score(unsaved, test).select("transaction_id", F.col("p").alias("q"))
    same = (F.col("p") == F.col("q")) & (F.size(held) == len(columns))
    again = detector.score(model, test)
    return again.join(first, "transaction_id").select("transaction_id", within(), same.alias("same"))


@query(
    "m16_round_trip",
    "SELECT CAST(0 AS BIGINT) AS rows_scored_differently WHERE (SELECT count(*) FROM events) > 0",
)
def round_trip(spark, folder):
    train, test = sides(spark, folder)
    out = scratch_path(spark, "bundle")
    model = detector.fit(train, "gbt_shallow", FULL.seed, FULL.rounds, FULL.learning_rate)
    detector.save_bundle(model, reference_stats(train, ["amount"]), out)
    again, _ = detector.load_bundle(spark, out)
    moved = detector.rescored_rows(model, again, test)
    return moved.agg(F.count(F.lit(1)).alias("rows_scored_differently"))


@query(
    "e1_train_and_evaluate",
    with_sql(EVENTS_SQL, SIDES_SQL)
    + """, c AS (SELECT count(*) FILTER (side = 'test') AS n_test,
  CAST(sum(is_fraud) FILTER (side = 'test') AS BIGINT) AS n_test_fraud,
  count(*) FILTER (side = 'train') AS n_train,
  CAST(sum(is_fraud) FILTER (side = 'train') AS BIGINT) AS n_train_fraud
  FROM tx JOIN side ON tx.entity_id = side.entity_id)
SELECT *, round(n_test_fraud / CAST(n_test AS DOUBLE), 9) AS base_rate,
  round(1 - n_test_fraud / CAST(n_test AS DOUBLE), 9) AS always_negative_accuracy, true AS sound
FROM c""",
)
def training(spark, folder):
    """Sizes and rates of the split, and whether the metrics of the fit are shares."""
    out = train_and_evaluate(events_tx(spark, folder), FULL).headline
    sound = F.lit(True)
    for name in ("accuracy", "recall", "average_precision", "roc_auc"):
        sound = sound & F.col(name).between(0, 1)
    sizes = ["n_test", "n_test_fraud", "n_train", "n_train_fraud"]
    rates = ["base_rate", "always_negative_accuracy"]
    return rounded(out.select(*sizes, *rates, sound.alias("sound")), rates)


@query(
    "e3_rolling_origin_report",
    FOLD_ROWS_SQL
    + """ SELECT fold, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS frauds,
  round(avg(y), 9) AS base_rate, true AS sound FROM both_ GROUP BY 1""",
)
def rolling_origin(spark, folder):
    """Sizes of the folds and the pool; every metric is a share, every fold has its interval."""
    report = rolling_report(events_tx(spark, folder), FULL)
    ap = report.intervals.where("metric = 'average_precision'").select("fold", "ci_lower", "ci_upper")
    rows = report.metrics.join(report.calibration, "fold").join(ap, "fold")
    sound = F.col("average_precision").between(F.col("ci_lower"), F.col("ci_upper"))
    for name in ("ece", "brier_raw", "brier_platt", "brier_constant"):
        sound = sound & F.col(name).between(0, 1)
    sizes = rows.select("fold", "n_rows", "frauds", "base_rate", sound.alias("sound"))
    return rounded(sizes, ["base_rate"])


@query(
    "j12_same_headline",
    with_sql(EVENTS_SQL, SIDES_SQL)
    + """SELECT count(*) FILTER (side = 'train') AS n_train, count(*) FILTER (side = 'test') AS n_test,
  CAST(sum(is_fraud) FILTER (side = 'test') AS BIGINT) AS n_test_fraud,
  CAST(0 AS BIGINT) AS differing, CAST(1 AS BIGINT) AS differing_after_a_change
FROM tx JOIN side ON tx.entity_id = side.entity_id""",
)
def same_headline(spark, folder):
    """The last fold against its stored headline, and against one with another metric."""
    report = rolling_report(events_tx(spark, folder), replace(FULL, train_fractions=(0.8,)))
    last = report.folds[-1].index
    stored = store(headline(report, last), "headline")
    check_headline(report, last, stored)
    other = stored.withColumn("average_precision", F.col("average_precision") + 0.001)

    def differing(table):
        return rolling_plan.same_headline(report, last, table).agg(F.count(F.lit(1)).alias("n")).scalar()

    return stored.select(
        "n_train", "n_test", "n_test_fraud",
        differing(stored).alias("differing"), differing(other).alias("differing_after_a_change"),
    )


@query(
    "u1_interchangeable_scorers",
    """SELECT unnest(['gbt', 'logreg']) AS model, CAST(0 AS BIGINT) AS rows_scored_differently
WHERE (SELECT count(*) FROM events) > 0""",
)
def interchangeable_scorers(spark, folder):
    """The fitted pipelines against the same models as plain Python functions: a linear model by
    its weights, trees walked node by node."""
    train, test = sides(spark, folder)
    settings = [("gbt", FULL.rounds, FULL.learning_rate), ("logreg", FULL.rounds, FULL.learning_rate)]
    trees, line = detector.fit_all(train, settings, FULL.seed)
    linear = line.stages[-1]
    weights, intercept = linear.coefficients.toArray(), float(linear.intercept)
    packed = trees.stages[-1].getOrDefault("forest")

    @F.pandas_udf("double")
    def by_hand(x: pd.Series) -> pd.Series:
        import numpy as np

        margin = np.stack(x.to_numpy()) @ weights + intercept
        return pd.Series(1 / (1 + np.exp(-margin)))

    @F.pandas_udf("double")
    def by_walking(x: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series(probabilities(unpacked(packed).walked(np.stack(x.to_numpy()).astype(float))))

    def differing(model, name, own, other):
        ready = with_absent_inputs(test, detector.expected_inputs(model))
        both = model.transform(ready).select(
            own.alias("p"), other(vector_to_array("features")).alias("q")
        )
        far = F.coalesce(F.abs(F.col("p") - F.col("q")) > 1e-12, F.lit(True))
        return both.agg(F.count_if(far).alias("rows_scored_differently")).select(
            F.lit(name).alias("model"), "rows_scored_differently"
        )

    return differing(trees, "gbt", F.col("p"), by_walking).unionByName(
        differing(line, "logreg", vector_to_array("probability")[1], by_hand)
    )
