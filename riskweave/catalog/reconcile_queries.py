"""Comparison of metric tables, documents and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.catalog.common import (
    EVENTS_SQL,
    SCORED_SQL,
    query,
    scored_events,
    table,
    with_sql,
)
from riskweave.catalog.policy_queries import curve_sql
from riskweave.operators import reconcile
from riskweave.operators.curves import review_curve
from riskweave.options import REVIEW_THRESHOLDS


@query(
    "j6_metric_mismatches",
    """WITH l AS (SELECT user_id, count(*) / 4e0 AS v FROM events WHERE user_id % 11 <> 0 GROUP BY 1),
r AS (SELECT user_id, count(*) / 4e0 + CASE WHEN user_id % 5 = 0 THEN 0.5e0
  WHEN user_id % 7 = 0 THEN 0.0078125e0 ELSE 0e0 END AS v FROM events WHERE user_id % 13 <> 0 GROUP BY 1)
SELECT coalesce(l.user_id, r.user_id) AS user_id, l.v AS left_value, r.v AS right_value,
  CASE WHEN r.user_id IS NULL THEN 'left_only' WHEN l.user_id IS NULL THEN 'right_only'
    ELSE 'differs' END AS state
FROM l FULL JOIN r ON l.user_id = r.user_id
WHERE l.user_id IS NULL OR r.user_id IS NULL OR abs(l.v - r.v) > 0.01e0""",
)
def metric_mismatches(spark, folder):
    """Two metric stores: small differences pass, large ones and missing keys do not."""
    user = F.col("user_id")
    base = (
        table(spark, folder, "events")
        .groupBy("user_id")
        .agg((F.count(F.lit(1)) / 4.0).alias("value"))
    )
    moved = F.when(user % 5 == 0, 0.5).when(user % 7 == 0, 0.0078125).otherwise(0.0)
    left = base.where(user % 11 != 0)
    right = base.where(user % 13 != 0).withColumn("value", F.col("value") + moved)
    return reconcile.metric_mismatches(left, right, ["user_id"], tolerance=0.01)


def documents(spark, folder):
    """Each event as a JSON document, and a regenerated version of it."""
    k = F.get_json_object("props", "$.k")
    event = F.col("event_id")

    def body(key, extra):
        return F.concat(
            F.lit('{"k": '), key, F.lit(', "at": {"measured_at": "'), extra,
            F.lit('", "list": [1, {"user": '), F.col("user_id").cast("string"), F.lit("}]}"),
        )

    events = table(spark, folder, "events")
    closing = F.when(event % 150 == 0, F.lit(', "x": 1}')).otherwise("}")
    changed = F.when(event % 100 == 0, (k.cast("int") + 1).cast("string")).otherwise(k)
    return (
        events.select("event_id", F.concat(body(k, F.lit("a")), F.lit("}")).alias("doc")),
        events.select("event_id", F.concat(body(changed, F.lit("b")), closing).alias("doc")),
    )


@query(
    "j7_json_differences",
    """SELECT event_id, '/k' AS path, json_extract_string(props, '$.k') AS left_value,
  CAST(CAST(json_extract_string(props, '$.k') AS INT) + 1 AS VARCHAR) AS right_value,
  'differs' AS state FROM events WHERE event_id % 100 = 0
UNION ALL SELECT event_id, '/x', NULL, '1', 'right_only' FROM events WHERE event_id % 150 = 0""",
)
def json_differences(spark, folder):
    left, right = documents(spark, folder)
    return reconcile.json_differences(left, right, "event_id", "doc", ignored_keys=["measured_at"])


@query(
    "j8_contract_differences",
    """SELECT event_id, '/cpu' AS path, '"1"' AS left_value, '"2"' AS right_value,
  'differs' AS state FROM events WHERE event_id % 90 = 0
UNION ALL SELECT event_id, '/extra', NULL, '"set"', 'right_only' FROM events
  WHERE event_id % 120 = 0""",
)
def contract_differences(spark, folder):
    """A wanted and a deployed object: default-like extras and unset fields are fine."""
    event = F.col("event_id")
    cpu = F.when(event % 90 == 0, F.lit('"2"')).otherwise('"1"')
    extra = F.when(event % 120 == 0, F.lit('"set"')).otherwise("[]")
    events = table(spark, folder, "events")
    wanted = events.select("event_id", F.lit('{"cpu": "1", "port": null, "probe": null}').alias("doc"))
    found = events.select(
        "event_id",
        F.concat(
            F.lit('{"cpu": '), cpu, F.lit(', "port": 0, "extra": '), extra, F.lit("}")
        ).alias("doc"),
    )
    return reconcile.contract_differences(wanted, found, "event_id", "doc")


@query(
    "j10_union_companions",
    """SELECT event_type, count(*) AS n, count(CASE WHEN event_id % 4 = 0 THEN value END) AS with_value
FROM events GROUP BY 1""",
)
def union_companions(spark, folder):
    events = table(spark, folder, "events")
    first = events.where("event_id % 4 <> 0").select("event_id", "event_type")
    second = events.where("event_id % 4 = 0").select("event_type", "event_id", "value")
    both = first.unionByName(second, allowMissingColumns=True)
    return both.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("with_value")
    )


@query(
    "j12_consistency_guard",
    with_sql(EVENTS_SQL, SCORED_SQL, curve_sql(REVIEW_THRESHOLDS))
    + """SELECT review_threshold, fraud_missed AS rebuilt_fraud_missed,
  fraud_missed + 1 AS stored_fraud_missed, n_flagged_fraud AS rebuilt_n_flagged_fraud,
  n_flagged_fraud AS stored_n_flagged_fraud FROM curve WHERE review_threshold = 0.7e0""",
)
def consistency_guard(spark, folder):
    """Counts rebuilt from rows against stored ones with one wrong entry."""
    columns = ["fraud_missed", "n_flagged_fraud"]
    rebuilt = review_curve(scored_events(spark, folder))
    wrong = (F.col("review_threshold") == 0.7).cast("int")
    stored = rebuilt.withColumn("fraud_missed", F.col("fraud_missed") + wrong)
    return reconcile.count_mismatches(rebuilt, stored, "review_threshold", columns)


@query(
    "j7_keys_with_slashes",
    "SELECT event_id, unnest(['/a/b', '/a~1b']) AS path FROM events WHERE event_type = 'error'",
)
def keys_with_slashes(spark, folder):
    """A key that holds a slash is not two keys."""
    rows = table(spark, folder, "events").where("event_type = 'error'")
    flat = F.concat(F.lit('{"a/b": '), F.col("event_id"), F.lit("}"))
    deep = F.concat(F.lit('{"a": {"b": '), F.col("event_id"), F.lit("}}"))
    left, right = (rows.select("event_id", d.alias("doc")) for d in (flat, deep))
    return reconcile.json_differences(left, right, "event_id", "doc").select("event_id", "path")
