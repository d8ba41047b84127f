"""The event table as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.catalog.common import (
    EVENTS_SQL,
    SIDES_SQL,
    TEST_SQL,
    canonical_events,
    events_tx,
    query,
    rounded,
    stand_in,
    table,
    with_sql,
)
from riskweave.catalog.drift_queries import PROBS
from riskweave.catalog.feature_queries import window_sql
from riskweave.catalog.metric_queries import decide_sql
from riskweave.functions.features import add_time_features, missing_inputs
from riskweave.models import detector
from riskweave.operators import drift
from riskweave.operators.ordered import row_positions
from riskweave.operators.splits import entity_sides, temporal_grouped_split
from riskweave.options import VELOCITY_WINDOWS
from riskweave.session import freeze, scratch_path, store
from riskweave.streaming import drift_windows, online_velocity, replay

T = 0.75


def event_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    raw = replay.open_stream(spark, folder, schema, glob="events.parquet")
    k = F.get_json_object("props", "$.k").cast("double")
    return canonical_events(raw).withColumn("f_k", k).drop("props")


def held_out(spark, folder):
    """The stream's rows of held-out entities; the entity table is static."""
    sides = freeze(entity_sides(events_tx(spark, folder), 0.2))
    test = sides.where("side = 'test'").select("entity_id")
    return event_stream(spark, folder).join(test, "entity_id", "left_semi")


def score_stand_in(df):
    return df.withColumn("p", stand_in(F.col("amount")))


def instalments(spark, folder, out, parts=3):
    """The events' held-out rows, written in time order in `parts` steps; a stream of what is
    there after each of them. Every step is a restart of the same stream."""
    _, test = temporal_grouped_split(events_tx(spark, folder))
    test = store(test, "held-out")
    at = F.unix_micros("timestamp")
    first, past = test.agg(F.min(at), F.max(at)).first()
    step = F.least(F.floor((at - first) * parts / F.lit(max(past - first, 1))), F.lit(parts - 1))
    for i in range(parts):
        test.where(step == i).write.mode("append").parquet(f"{out}/source")
        yield replay.open_stream(spark, f"{out}/source", test.schema)


def alerts_of(spark, folder, scorer):
    out = scratch_path(spark, "alerts")
    for stream in instalments(spark, folder, out):
        run = replay.replay_alerts(stream, scorer, T, f"{out}/rows", f"{out}/checkpoint")
        run.awaitTermination()
    rows = replay.written_alerts(spark, f"{out}/rows")
    return rows.withColumn("timestamp_us", F.unix_micros("timestamp")).drop("timestamp")


@query(
    "r1_replay_alerts",
    with_sql(EVENTS_SQL, TEST_SQL)
    + f""", d AS (SELECT scored.*, {decide_sql("p", "0.75e0")} AS decision,
  row_number() OVER (ORDER BY scored.timestamp, scored.transaction_id) - 1 AS row_index FROM scored)
SELECT epoch_us(d.timestamp) AS timestamp_us, row_index, d.transaction_id, d.entity_id, d.amount,
  category, decision, round(p, 4) AS p_fraud, round(greatest(p, 1 - p), 4) AS confidence,
  y AS true_is_fraud
FROM d JOIN tx ON d.transaction_id = tx.transaction_id WHERE decision IN ('fraud', 'review')""",
)
def replay_alerts(spark, folder):
    """Ten fields, over three instalments, with a score that both engines compute alike."""
    return alerts_of(spark, folder, score_stand_in)


@query(
    "r1_model_alerts",
    with_sql(EVENTS_SQL, SIDES_SQL)
    + """SELECT count(*) AS rows_scored, CAST(0 AS BIGINT) AS alerts_that_differ
FROM tx JOIN side ON tx.entity_id = side.entity_id WHERE side = 'test'""",
)
def model_alerts(spark, folder):
    """Scored by a saved bundle, against the same model over the whole table at once."""
    train, test = temporal_grouped_split(add_time_features(events_tx(spark, folder)))
    out = scratch_path(spark, "bundle")
    fitted = detector.fit(store(train, "train"), "gbt_shallow")
    detector.save_bundle(fitted, drift.reference_stats(train, COLUMNS), out)
    model, _ = detector.load_bundle(spark, out)
    streamed = alerts_of(spark, folder, lambda df: detector.score(model, add_time_features(df)))
    scored = detector.score(model, test)
    placed = row_positions(scored.withColumn("_at", F.col("timestamp")), ["_at", "transaction_id"], "row_index")
    whole = replay.alerts(placed, T).withColumn("timestamp_us", F.unix_micros("timestamp")).drop("timestamp")
    odd = streamed.select(whole.columns).exceptAll(whole).unionAll(whole.exceptAll(streamed.select(whole.columns)))
    return scored.agg(F.count(F.lit(1)).alias("rows_scored")).withColumn(
        "alerts_that_differ", odd.agg(F.count(F.lit(1)).alias("n")).scalar()
    )


@query(
    "r5_event_log",
    with_sql(EVENTS_SQL, TEST_SQL)
    + f""", d AS (SELECT {decide_sql("p", "0.75e0")} AS decision,
  CASE WHEN tx.f_k % 2 = 0 THEN 1 ELSE 0 END AS missing FROM scored JOIN tx USING (transaction_id))
SELECT decision, count(*) AS n, CAST(sum(missing) AS BIGINT) AS missing_inputs,
  CAST(0 AS BIGINT) AS without_latency FROM d GROUP BY 1""",
)
def event_log(spark, folder):
    out = scratch_path(spark, "log")
    sparse = held_out(spark, folder).withColumn(
        "f_k", F.when(F.col("f_k") % 2 != 0, F.col("f_k"))
    )
    run = replay.replay_log(
        sparse, score_stand_in, T, f"{out}/rows", f"{out}/checkpoint",
        missing_inputs(sparse, ["amount", "f_k"]),
    )
    run.awaitTermination()
    log = spark.read.parquet(f"{out}/rows")
    late = F.unix_millis(F.current_timestamp()) - F.unix_millis("timestamp")
    sound = F.col("latency_ms").between(0, late)
    return log.groupBy("decision").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("missing_count").alias("missing_inputs"),
        F.count_if(~F.coalesce(sound, F.lit(False))).alias("without_latency"),
    )


COLUMNS = ["amount", "f_k"]


@query(
    "r3_drift_by_day",
    with_sql(
        EVENTS_SQL,
        SIDES_SQL,
        """long AS (SELECT side, date_trunc('day', timestamp) AS d, 'amount' AS feature,
  amount AS value FROM tx JOIN side ON tx.entity_id = side.entity_id
  UNION ALL SELECT side, date_trunc('day', timestamp), 'f_k', f_k
  FROM tx JOIN side ON tx.entity_id = side.entity_id)""",
        f"""edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, {PROBS}))) AS edges
  FROM long WHERE side = 'train' GROUP BY 1)""",
        """b AS (SELECT side, CASE WHEN side = 'test' THEN d END AS d, feature,
  len(list_filter(edges, lambda e: e <= value)) AS bin, count(*) AS n
  FROM long JOIN edges USING (feature) GROUP BY ALL)""",
        """g AS (SELECT s.side, s.d, feature, unnest(range(len(edges) + 1)) AS bin
  FROM edges CROSS JOIN (SELECT DISTINCT side, d FROM b) s)""",
        """s AS (SELECT g.side, g.d, g.feature, g.bin, greatest(coalesce(n, 0)
  / CAST(sum(n) OVER w AS DOUBLE), 1e-4) AS s FROM g LEFT JOIN b ON g.side = b.side
  AND g.feature = b.feature AND g.bin = b.bin AND g.d IS NOT DISTINCT FROM b.d
  WINDOW w AS (PARTITION BY g.side, g.d, g.feature))""",
        """z AS (SELECT *, s / sum(s) OVER (PARTITION BY side, d, feature) AS q FROM s)""",
    )
    + """SELECT epoch_us(w.d) AS window_us, w.feature, round(sum((w.q - r.q) * ln(w.q / r.q)), 9) AS psi
FROM z w JOIN z r ON r.side = 'train' AND w.side = 'test' AND w.feature = r.feature
  AND w.bin = r.bin GROUP BY 1, 2""",
)
def drift_by_day(spark, folder):
    train, _ = temporal_grouped_split(events_tx(spark, folder))
    reference = freeze(drift.reference_stats(train, COLUMNS))
    out = scratch_path(spark, "drift")
    run = drift_windows.run_window_drift(
        held_out(spark, folder), reference, COLUMNS, "1 day", "2 days", 0.1, 0.25,
        f"{out}/rows", f"{out}/checkpoint",
    )
    run.awaitTermination()
    rows = drift_windows.latest_windows(spark.read.parquet(f"{out}/rows"))
    return rounded(
        rows.select(F.unix_micros("window_start").alias("window_us"), "feature", "psi"), ["psi"]
    )


@query(
    "r4_online_entity_velocity",
    with_sql(EVENTS_SQL, window_sql("f_ent_", "PARTITION BY entity_id ")),
)
def online_entity_velocity(spark, folder):
    """The events arrive in three instalments, each one a restart of the same stream; the
    features equal the batch operator's."""
    out = scratch_path(spark, "velocity")
    tx = events_tx(spark, folder)
    bounds = tx.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    first, past = (bounds.select(F.unix_micros(c).alias(c)).scalar() for c in ("a", "b"))
    third = F.least(F.floor((F.unix_micros("timestamp") - first) * 3 / (past - first)), F.lit(2))
    for i in range(3):
        tx.where(third == i).write.mode("append").parquet(f"{out}/source")
        stream = replay.open_stream(spark, f"{out}/source", tx.schema)
        run = online_velocity.run_online_velocity(
            stream, f"{out}/rows", f"{out}/state", f"{out}/checkpoint", VELOCITY_WINDOWS
        )
        run.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.select("transaction_id", *sorted(c for c in rows.columns if c.startswith("f_ent_")))
