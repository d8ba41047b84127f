"""SRC1 to SRC6, SNK1 to SNK5: the tables are written in each dataset's own layout, read back
and compared with what they came from."""

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
from riskweave.catalog.metric_queries import ALL_SQL
from riskweave.catalog.policy_queries import curve_sql
from riskweave.operators.curves import review_curve
from riskweave.options import REVIEW_THRESHOLDS
from riskweave.session import scratch_path
from riskweave.sources import sinks, transactions


def write_csv(df, path: str) -> None:
    df.write.option("header", True).csv(path)


def as_creditcard(spark, folder: str, out: str) -> None:
    """Rows in event order over several files: the row number is the event's rank."""
    events = table(spark, folder, "events")
    rows = events.select(
        "event_id",
        (F.col("event_id") * 1.5).alias("Time"),
        F.col("value").alias("V1"),
        F.when(F.col("user_id") % 9 != 0, F.col("user_id") / 4).alias("V2"),
        F.col("value").alias("Amount"),
        (F.col("event_type") == "error").cast("int").alias("Class"),
    )
    ordered = rows.repartitionByRange(4, "event_id").sortWithinPartitions("event_id")
    write_csv(ordered.drop("event_id"), f"{out}/creditcard.csv")


def as_sparkov(spark, folder: str, out: str) -> None:
    events = table(spark, folder, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("trans_date_trans_time"),
        F.col("user_id").alias("cc_num"),
        F.when(F.col("event_id") % 6 != 0, F.col("event_type")).alias("category"),
        F.col("value").alias("amt"),
        (F.col("user_id") * 10).alias("city_pop"),
        F.concat(F.lit("t"), "event_id").alias("trans_num"),
        (F.col("event_type") == "error").cast("int").alias("is_fraud"),
    )
    write_csv(events.where("event_id % 4 <> 0").drop("event_id"), f"{out}/fraudTrain.csv")
    write_csv(events.where("event_id % 4 = 0").drop("event_id"), f"{out}/fraudTest.csv")


def canonical_out(df, *extra):
    return df.select(
        "transaction_id",
        F.unix_micros("timestamp").alias("ts_us"),
        "entity_id",
        "amount",
        "category",
        "is_fraud",
        *extra,
        "data_source",
    )


@query(
    "src1_creditcard_csv",
    """WITH r AS (SELECT *, CAST(row_number() OVER (ORDER BY event_id) - 1 AS VARCHAR) AS id FROM events)
SELECT id AS transaction_id, 1356998400000000 + CAST(event_id * 1500000 AS BIGINT) AS ts_us,
  id AS entity_id, value AS amount, CAST(NULL AS VARCHAR) AS category,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_fraud, value AS "f_V1",
  CASE WHEN user_id % 9 <> 0 THEN user_id / 4e0 END AS "f_V2", 'ulb_creditcard' AS data_source
FROM r""",
)
def creditcard(spark, folder):
    out = scratch_path(spark, "creditcard")
    as_creditcard(spark, folder, out)
    return canonical_out(transactions.load(spark, out), "f_V1", "f_V2")


SPARKOV_SQL = """SELECT 't' || CAST(event_id AS VARCHAR) AS transaction_id,
  epoch_us(date_trunc('second', ts)) AS ts_us, CAST(user_id AS VARCHAR) AS entity_id,
  value AS amount, CASE WHEN event_id % 6 <> 0 THEN event_type ELSE 'unknown' END AS category,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_fraud,
  user_id * 10e0 AS f_city_pop, 'sparkov' AS data_source FROM events"""


@query("src2_sparkov_csv", SPARKOV_SQL)
def sparkov(spark, folder):
    out = scratch_path(spark, "sparkov")
    as_sparkov(spark, folder, out)
    return canonical_out(transactions.load(spark, out), "f_city_pop")


@query(
    "src3_commerce_csv",
    """SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id,
  1509494400000000 + o_orderkey * 7000000 AS ts_us, CAST(o_custkey AS VARCHAR) AS entity_id,
  o_totalprice AS amount, o_orderpriority AS category,
  CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS is_fraud,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 17 AS DOUBLE) END AS "f_C1",
  CAST(o_custkey % 3 AS DOUBLE) AS "f_C14", 'ieee_cis' AS data_source FROM orders""",
)
def commerce(spark, folder):
    out = scratch_path(spark, "commerce")
    orders = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    write_csv(
        orders.select(
            key.alias("TransactionID"),
            (F.col("o_orderstatus") == "P").cast("int").alias("isFraud"),
            (key * 7).alias("TransactionDT"),
            F.col("o_totalprice").alias("TransactionAmt"),
            F.col("o_orderpriority").alias("ProductCD"),
            F.col("o_custkey").alias("card1"),
            F.when(key % 5 != 0, key % 17).alias("C1"),
            (F.col("o_custkey") % 3).alias("C14"),
        ),
        f"{out}/train_transaction.csv",
    )
    write_csv(
        orders.where(key % 3 == 0).select(key.alias("TransactionID"), F.lit(1).alias("id_01")),
        f"{out}/train_identity.csv",
    )
    return canonical_out(transactions.load(spark, out), "f_C1", "f_C14")


@query(
    "src4_benchmark_export_csv",
    """SELECT 'ev' || CAST(event_id AS VARCHAR) AS transaction_id,
  epoch_us(date_trunc('second', ts)) AS ts_us, CAST(user_id AS VARCHAR) AS entity_id,
  value AS amount, CAST(NULL AS VARCHAR) AS category,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_fraud,
  user_id * 10e0 AS f_city_pop, 'amazon_fdb' AS data_source FROM events""",
)
def benchmark_export(spark, folder):
    out = scratch_path(spark, "export")
    events = table(spark, folder, "events").select(
        F.concat(F.lit("ev"), "event_id").alias("EVENT_ID"),
        F.lit("customer").alias("ENTITY_TYPE"),
        F.col("user_id").alias("ENTITY_ID"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("EVENT_TIMESTAMP"),
        (F.col("event_type") == "error").cast("int").alias("EVENT_LABEL"),
        F.col("value").alias("AMT"),
        (F.col("user_id") * 10).alias("city_pop"),
        F.col("event_type").alias("title"),
    )
    write_csv(events.where(F.col("ENTITY_ID") % 4 != 0), f"{out}/fdb_train.csv")
    write_csv(events.where(F.col("ENTITY_ID") % 4 == 0), f"{out}/fdb_test.csv")
    return canonical_out(transactions.load(spark, out), "f_city_pop")


@query(
    "src5_source_detection",
    """SELECT 'sparkov' AS data_source, count(*) AS n,
  count(*) FILTER (event_type = 'error') AS frauds FROM events""",
)
def detection(spark, folder):
    """Two datasets in one folder: the first in the fixed order wins."""
    out = scratch_path(spark, "two")
    as_creditcard(spark, folder, out)
    as_sparkov(spark, folder, out)
    found = transactions.load(spark, out)
    return found.groupBy("data_source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_fraud") == 1).alias("frauds")
    )


@query("src6_load_entry_point", SPARKOV_SQL.replace("'sparkov' AS data_source", "1 AS one"))
def load_entry_point(spark, folder):
    """The one entry point, on a folder whose dataset it has to find."""
    out = scratch_path(spark, "found")
    as_sparkov(spark, folder, out)
    return canonical_out(transactions.load(spark, out), "f_city_pop", F.lit(1).alias("one")).drop(
        "data_source"
    )


CURVE_SQL = with_sql(EVENTS_SQL, SCORED_SQL, curve_sql(REVIEW_THRESHOLDS))


@query(
    "snk1_report_sink",
    CURVE_SQL
    + """SELECT review_threshold, n_flagged_fraud, fraud_missed, 'events' AS data_source, copy
FROM curve CROSS JOIN (VALUES ('latest'), ('snapshot')) c(copy)""",
)
def report_sink(spark, folder):
    out = scratch_path(spark, "reports")
    sinks.write_report(review_curve(scored_events(spark, folder)), out, "metrics", "events")
    names = ["review_threshold", "n_flagged_fraud", "fraud_missed", "data_source"]
    snapshot = spark.read.json(f"{out}/metrics_events").select(*names, F.lit("snapshot").alias("copy"))
    return snapshot.unionByName(
        spark.read.json(f"{out}/metrics").select(*names, F.lit("latest").alias("copy"))
    )


@query(
    "snk2_score_export",
    ALL_SQL
    + """SELECT row_number() OVER (ORDER BY timestamp, transaction_id) - 1 AS position, p, amount
FROM scored""",
)
def score_export(spark, folder):
    out = scratch_path(spark, "export")
    sinks.write_score_export(scored_events(spark, folder), out)
    return spark.read.parquet(f"{out}/rows")


@query(
    "snk3_rebuilt_scores",
    ALL_SQL
    + """SELECT row_number() OVER (ORDER BY timestamp, transaction_id) - 1 AS position, p, y, amount
FROM scored""",
)
def rebuilt_scores(spark, folder):
    out = scratch_path(spark, "export")
    sinks.write_score_export(scored_events(spark, folder), out)
    return sinks.read_score_export(spark, out)


METRICS = ("coverage", "recall_auto", "n_sent_to_review", "fraud_missed")


def _metric_rows(spark, folder):
    curve = review_curve(scored_events(spark, folder)).withColumn("variant", F.lit("base"))
    return sinks.metric_rows(curve, "run1", "variant", METRICS, "review_threshold", "curve.")


METRIC_SQL = CURVE_SQL + " UNION ALL ".join(
    f"""SELECT 'run1' AS run, 'base' AS variant, 'curve.{m}' AS metric,
  CAST(round(review_threshold * 100) AS INT) AS step, CAST({m} AS DOUBLE) AS value FROM curve
  WHERE {m} IS NOT NULL"""
    for m in METRICS
)


@query("a26_metric_flattening", METRIC_SQL)
def metric_flattening(spark, folder):
    """Curve rows as metric steps."""
    return _metric_rows(spark, folder)


@query("snk4_metric_store", METRIC_SQL)
def metric_store(spark, folder):
    out = scratch_path(spark, "metrics")
    sinks.append_metrics(
        _metric_rows(spark, folder), out, {"rounds": "200"}, {"comparison": "events"}
    )
    return sinks.read_metrics(spark, out, "run1").select(
        "run", "variant", "metric", "step", "value"
    )


@query(
    "snk5_metric_read_back",
    CURVE_SQL
    + """SELECT 'base' AS variant, 'curve.coverage' AS metric, 70 AS step,
  coverage AS left_value, coverage + 1 AS right_value, 'differs' AS state
FROM curve WHERE review_threshold = 0.7e0""",
)
def metric_read_back(spark, folder):
    """A store with one wrong value."""
    out = scratch_path(spark, "metrics")
    rows = _metric_rows(spark, folder)
    wrong = (F.col("metric") == "curve.coverage") & (F.col("step") == 70)
    sinks.append_metrics(
        rows.withColumn("value", F.when(wrong, F.col("value") + 1).otherwise(F.col("value"))), out
    )
    return sinks.metric_store_differences(sinks.read_metrics(spark, out, "run1"), rows)


@query(
    "snk1_report_with_an_empty_column",
    "SELECT event_type, count(*) AS n, CAST(NULL AS VARCHAR) AS note FROM events GROUP BY 1",
)
def report_with_an_empty_column(spark, folder):
    """A column of nulls is still there when a report is read back."""
    out = scratch_path(spark, "report")
    counts = table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    sinks.write_report(counts.withColumn("note", F.lit(None).cast("string")), out, "types", "events")
    return spark.read.json(f"{out}/types").select("event_type", "n", "note")
