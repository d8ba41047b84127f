"""F1 to F13, W1 to W5, O13, J1, T3, A27, X1 to X6, L9, SRC7, SRC8."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.catalog.common import (
    EVENTS_SQL,
    ORDERS_SQL,
    SIDES_SQL,
    events_tx,
    orders_tx,
    query,
    rounded,
    scored_events,
    SCORED_SQL,
    table,
    with_sql,
)
from riskweave.catalog.split_queries import NULL_ENTITIES_SQL, null_entities
from riskweave.functions import features
from riskweave.functions.scores import display_name, logit, percent_text, ratio
from riskweave.functions.text import binary_label, duration_seconds, memory_mebibytes
from riskweave.operators import velocity
from riskweave.operators.splits import temporal_grouped_split
from riskweave.options import VELOCITY_WINDOWS
from riskweave.schema import numeric_columns
from riskweave.sources.transactions import canonical


@query(
    "f1_time_features",
    with_sql(EVENTS_SQL)
    + """SELECT transaction_id, CAST(hour(timestamp) AS INT) AS hour_of_day,
  CAST(isodow(timestamp) - 1 AS INT) AS day_of_week FROM tx""",
)
def time_features(spark, folder):
    return features.add_time_features(events_tx(spark, folder)).select(
        "transaction_id", "hour_of_day", "day_of_week"
    )


@query(
    "f2_request_time_features",
    with_sql(EVENTS_SQL)
    + """SELECT transaction_id,
  CASE WHEN f_k < 30 THEN CAST(f_k AS INT) ELSE CAST(hour(timestamp) AS INT) END AS hour_of_day,
  CAST(isodow(timestamp) - 1 AS INT) AS day_of_week FROM tx""",
)
def request_time_features(spark, folder):
    """Requests that bring their own hour keep it."""
    given = F.when(F.col("f_k") < 30, F.col("f_k").cast("int"))
    requests = events_tx(spark, folder).withColumn("hour_of_day", given)
    return features.fill_time_features(requests).select(
        "transaction_id", "hour_of_day", "day_of_week"
    )


@query(
    "f3_model_inputs",
    """SELECT column_name, n FROM (
  SELECT 'amount' AS column_name, count(value) AS n FROM events
  UNION ALL SELECT 'hour_of_day', count(ts) FROM events
  UNION ALL SELECT 'day_of_week', count(ts) FROM events
  UNION ALL SELECT 'f_k', count(json_extract_string(props, '$.k')) FROM events)""",
)
def model_inputs(spark, folder):
    """The numeric inputs and how many rows know them."""
    tx = features.add_time_features(events_tx(spark, folder))
    names = numeric_columns(tx)
    counts = tx.agg(*[F.count(c).alias(c) for c in names])
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in names]
    return counts.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


@query(
    "f6_missing_inputs",
    with_sql(EVENTS_SQL)
    + """SELECT transaction_id,
  CASE WHEN f_k % 3 = 0 THEN 'amount,f_device' ELSE 'f_device' END AS missing FROM tx""",
)
def missing_inputs(spark, folder):
    tx = events_tx(spark, folder).withColumn(
        "amount", F.when(F.col("f_k") % 3 != 0, F.col("amount"))
    )
    names = features.missing_inputs(tx, ["amount", "f_k", "f_device", "category"])
    return tx.select("transaction_id", F.array_join(names, ",").alias("missing"))


@query(
    "f7_class_weights",
    with_sql(EVENTS_SQL, SIDES_SQL)
    + """, train AS (SELECT is_fraud FROM tx JOIN side ON tx.entity_id = side.entity_id
  WHERE side = 'train')
SELECT is_fraud, (SELECT count(*) FROM train)
  / CAST((SELECT max(is_fraud) + 1 FROM train) * count(*) AS DOUBLE) AS weight
FROM train GROUP BY 1""",
)
def class_weights(spark, folder):
    return features.class_weights(temporal_grouped_split(events_tx(spark, folder))[0])


@query(
    "f8_degenerate_columns",
    """SELECT c AS "column" FROM (VALUES ('f_constant'), ('f_missing')) t(c)
WHERE (SELECT count(*) FROM events) > 0""",
)
def degenerate(spark, folder):
    tx = events_tx(spark, folder).withColumns(
        {"f_constant": F.lit(1.0), "f_missing": F.lit(None).cast("double")}
    )
    train, _ = temporal_grouped_split(tx)
    inner, _ = temporal_grouped_split(train)
    return velocity.degenerate_columns(
        [train, inner], ["amount", "f_k", "f_constant", "f_missing"]
    )


@query(
    "f10_logit",
    with_sql(EVENTS_SQL, SCORED_SQL)
    + """, c AS (SELECT transaction_id, least(greatest(p, 1e-12), 1 - 1e-12) AS q FROM scored)
SELECT transaction_id, round(ln(q / (1 - q)), 9) AS logit FROM c""",
)
def logits(spark, folder):
    out = scored_events(spark, folder).select("transaction_id", logit(F.col("p")).alias("logit"))
    return rounded(out, ["logit"])


@query(
    "f11_display_names",
    """SELECT event_type, event_type || '__x' AS name, count(*) AS n FROM events GROUP BY 1""",
)
def display_names(spark, folder):
    raw = F.concat(F.lit("num__"), F.col("event_type"), F.lit("__x"))
    return (
        table(spark, folder, "events")
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("name", display_name(raw))
    )


@query(
    "f12_head_of_stream",
    with_sql(ORDERS_SQL)
    + "SELECT transaction_id FROM tx ORDER BY timestamp, transaction_id LIMIT 500",
)
def head_of_stream(spark, folder):
    return features.head_of_stream(orders_tx(spark, folder), 500).select("transaction_id")


@query(
    "f13_numeric_validation",
    """SELECT CAST(event_id AS VARCHAR) AS transaction_id,
  CASE WHEN event_type = 'error' THEN 'value' ELSE '' END AS rejected,
  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value
FROM events""",
)
def numeric_validation(spark, folder):
    """Error events carry a text where a number belongs."""
    raw = table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.when(F.col("event_type") == "error", F.lit("n/a"))
        .otherwise(F.col("value").cast("string"))
        .alias("value"),
    )
    out = features.numeric_or_rejected(raw, ["value"])
    return out.withColumn("rejected", F.array_join("rejected", ","))


def window_sql(prefix: str, partition: str, windows=VELOCITY_WINDOWS) -> str:
    cols = []
    for label, width in windows.items():
        over = (
            f"OVER ({partition}ORDER BY us RANGE BETWEEN {width} PRECEDING AND 1 PRECEDING)"
        )
        cols.append(
            f"count(amount) {over} AS n_{label}, "
            f"CAST(coalesce(sum(CAST(amount AS DECIMAL(20,6))) {over}, 0) AS DOUBLE) AS s_{label}"
        )
    inner = ", ".join(cols)
    outs = []
    for label in windows:
        n, s = f"n_{label}", f"s_{label}"
        mean = f"CASE WHEN {n} > 0 THEN {s} / {n} END"
        outs.append(
            f"CAST({n} AS DOUBLE) AS {prefix}count_{label}, {s} AS {prefix}amt_sum_{label}, "
            f"{mean} AS {prefix}amt_mean_{label}, "
            f"CASE WHEN ({mean}) > 0 THEN amount / ({mean}) END AS {prefix}amt_ratio_{label}"
        )
    gap = f"(us - lag(us) OVER ({partition}ORDER BY us, transaction_id)) / 1e6"
    if not partition:
        gap = f"floor({gap})"
    return f"""w AS (SELECT *, epoch_us(timestamp) AS us FROM tx),
v AS (SELECT *, {inner}, {gap} AS gap FROM w)
SELECT transaction_id, {", ".join(outs)}, gap AS {prefix}seconds_since_prev FROM v"""


def _velocity_only(df):
    return df.select("transaction_id", *velocity.velocity_columns(df))


@query("w1_stream_velocity", with_sql(EVENTS_SQL, window_sql("f_vel_", "")))
def stream_velocity(spark, folder):
    """Trailing stream windows, and the gap of W3."""
    return _velocity_only(velocity.stream_velocity(events_tx(spark, folder)))


@query("w1_stream_velocity_ties", with_sql(ORDERS_SQL, window_sql("f_vel_", "")))
def stream_velocity_ties(spark, folder):
    return _velocity_only(velocity.stream_velocity(orders_tx(spark, folder)))


@query(
    "w2_entity_velocity", with_sql(EVENTS_SQL, window_sql("f_ent_", "PARTITION BY entity_id "))
)
def entity_velocity(spark, folder):
    """Trailing entity windows, and the gap of W4."""
    return _velocity_only(velocity.entity_velocity(events_tx(spark, folder)))


@query(
    "w2_velocity_with_missing_entities",
    with_sql(NULL_ENTITIES_SQL, window_sql("f_ent_", "PARTITION BY entity_id ")),
)
def velocity_with_missing_entities(spark, folder):
    """Rows without an entity are one entity."""
    return _velocity_only(velocity.entity_velocity(null_entities(spark, folder)))


@query(
    "w3_stream_gap",
    with_sql(ORDERS_SQL)
    + """SELECT transaction_id, floor((epoch_us(timestamp)
  - lag(epoch_us(timestamp)) OVER (ORDER BY timestamp, transaction_id)) / 1e6)
  AS f_vel_seconds_since_prev FROM tx""",
)
def stream_gap(spark, folder):
    out = velocity.stream_velocity(orders_tx(spark, folder), {})
    return out.select("transaction_id", "f_vel_seconds_since_prev")


@query(
    "w4_entity_gap",
    with_sql(ORDERS_SQL)
    + """SELECT transaction_id, (epoch_us(timestamp) - lag(epoch_us(timestamp))
  OVER (PARTITION BY entity_id ORDER BY timestamp, transaction_id)) / 1e6
  AS f_ent_seconds_since_prev FROM tx""",
)
def entity_gap(spark, folder):
    out = velocity.entity_velocity(orders_tx(spark, folder), {})
    return out.select("transaction_id", "f_ent_seconds_since_prev")


@query(
    "w5_daily_running_count",
    with_sql(EVENTS_SQL)
    + """SELECT transaction_id, row_number() OVER (PARTITION BY entity_id,
  CAST(timestamp AS DATE) ORDER BY timestamp, transaction_id) - 1 AS entity_daily_tx_count
FROM tx""",
)
def daily_running_count(spark, folder):
    return velocity.daily_running_count(events_tx(spark, folder)).select(
        "transaction_id", "entity_daily_tx_count"
    )


@query(
    "a27_entities_repeat",
    """SELECT count(DISTINCT user_id) AS entities, count(*) AS n_rows,
  count(DISTINCT user_id) < count(*) AS repeats FROM events""",
)
def entities_repeat(spark, folder):
    return velocity.entities_repeat(events_tx(spark, folder)).withColumnRenamed("rows", "n_rows")


@query(
    "j1_left_join_dimension",
    """SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, o_orderpriority
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
)
def left_join(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority"
    )
    return lines.join(orders, "l_orderkey", "left")


@query(
    "t3_random_pick",
    with_sql(EVENTS_SQL)
    + """SELECT * FROM (SELECT 'any' AS pick, transaction_id FROM tx
  ORDER BY md5('7:' || transaction_id), transaction_id LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'fraud', transaction_id FROM tx WHERE is_fraud = 1
  ORDER BY md5('7:' || transaction_id), transaction_id LIMIT 1)""",
)
def random_pick(spark, folder):
    tx = events_tx(spark, folder)
    one = features.random_pick(tx, 7).select(F.lit("any").alias("pick"), "transaction_id")
    hit = features.random_pick(tx.where("is_fraud = 1"), 7).select(
        F.lit("fraud").alias("pick"), "transaction_id"
    )
    return one.unionByName(hit)


@query(
    "src7_canonical_table",
    """WITH t AS (SELECT CAST(event_id AS VARCHAR) AS transaction_id, epoch_us(ts) AS ts_us,
  CAST(user_id AS VARCHAR) AS entity_id, value AS amount,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 5 <> 0 THEN event_type END AS category,
  CASE WHEN event_type IN ('error') THEN 1 ELSE 0 END AS is_fraud FROM events)
SELECT transaction_id, ts_us, entity_id, amount,
  CASE WHEN (SELECT count(category) FROM t) > 0 THEN coalesce(category, 'unknown') END AS category,
  is_fraud FROM t""",
)
def canonical_table(spark, folder):
    k = F.get_json_object("props", "$.k").cast("int")
    raw = table(spark, folder, "events").select(
        F.col("event_id").alias("transaction_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("user_id").alias("entity_id"),
        F.col("value").alias("amount"),
        F.when(k % 5 != 0, F.col("event_type")).alias("category"),
        F.when(F.col("event_type") == "error", F.lit(" Fraud ")).otherwise("legit").alias("is_fraud"),
    )
    out = canonical(raw, "events").withColumn("ts_us", F.unix_micros("timestamp"))
    return out.drop("timestamp", "data_source")


@query(
    "src8_label_normaliser",
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n,
  CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS from_text,
  CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS from_boolean,
  CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE 1 END AS from_number
FROM orders GROUP BY 1, 2""",
)
def label_normaliser(spark, folder):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    text = F.when(status == "P", F.lit(" YES ")).otherwise("no")
    number = F.substring(priority, 1, 1).cast("int") - 1
    return (
        table(spark, folder, "orders")
        .select(
            "o_orderstatus",
            "o_orderpriority",
            binary_label(text, "string").alias("from_text"),
            binary_label(status == "P", "boolean").alias("from_boolean"),
            binary_label(number, "int").alias("from_number"),
        )
        .groupBy("o_orderstatus", "o_orderpriority", "from_text", "from_boolean", "from_number")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "x2_date_functions",
    with_sql(EVENTS_SQL)
    + """SELECT transaction_id, epoch_us(date_trunc('day', timestamp)) AS day_us,
  epoch_us(timestamp) - epoch_us(date_trunc('day', timestamp)) AS into_day_us FROM tx""",
)
def date_functions(spark, folder):
    at, day = F.col("timestamp"), F.date_trunc("day", "timestamp")
    return events_tx(spark, folder).select(
        "transaction_id",
        F.unix_micros(day).alias("day_us"),
        (F.unix_micros(at) - F.unix_micros(day)).alias("into_day_us"),
    )


@query(
    "x6_percent_text",
    with_sql(EVENTS_SQL)
    + """, s AS (SELECT category, avg(is_fraud) AS rate FROM tx GROUP BY 1)
SELECT category, CASE
    WHEN NOT (printf('%.1f%%', 100 * rate) IN ('0.0%', '100.0%') AND rate > 0 AND rate < 1)
      THEN printf('%.1f%%', 100 * rate)
    ELSE printf('%.2f%%', 100 * rate) END AS text FROM s""",
)
def percent_texts(spark, folder):
    rates = events_tx(spark, folder).groupBy("category").agg(F.avg("is_fraud").alias("rate"))
    return rates.select("category", percent_text(F.col("rate")).alias("text"))


@query(
    "l9_unit_parsing",
    """SELECT event_type, CAST(sum(m * 60 + s) AS BIGINT) AS seconds,
  sum(m * 1024.0e0 + s + m / 1024e0) AS mebibytes
FROM (SELECT event_type, event_id % 7 AS m, user_id % 60 AS s FROM events) GROUP BY 1""",
)
def unit_parsing(spark, folder):
    m, s = F.col("event_id") % 7, F.col("user_id") % 60
    texts = table(spark, folder, "events").select(
        "event_type",
        F.format_string("%dm%ds", m, s).alias("duration"),
        F.format_string("%dGi", m).alias("gi"),
        F.format_string("%dMi", s).alias("mi"),
        F.format_string("%dKi", m).alias("ki"),
    )
    size = sum(memory_mebibytes(F.col(c)) for c in ("gi", "mi", "ki"))
    return texts.groupBy("event_type").agg(
        F.sum(duration_seconds(F.col("duration"))).alias("seconds"), F.sum(size).alias("mebibytes")
    )


def line_tx(spark, folder):
    """Line items as one stream of transactions at day grain."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, folder, "lineitem").select(
        key.alias("transaction_id"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.col("l_extendedprice").alias("amount"),
    )


@query(
    "o13_trailing_totals",
    """WITH d AS (SELECT epoch_us(l_shipdate) AS us, count(*) AS n,
  sum(CAST(l_extendedprice AS DECIMAL(20,6))) AS s FROM lineitem GROUP BY 1),
w AS (SELECT us, n, coalesce(sum(n) OVER v, 0) AS n7, coalesce(sum(s) OVER v, 0) AS s7 FROM d
  WINDOW v AS (ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING))
SELECT us, n, CAST(n7 AS DOUBLE) AS n7, CAST(s7 AS DOUBLE) AS s7 FROM w""",
)
def trailing_totals(spark, folder):
    """The week before each shipping day, over all line items."""
    wide = velocity.stream_velocity(line_tx(spark, folder), {"7d": 604_800_000_000})
    return wide.groupBy(F.unix_micros("timestamp").alias("us")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("f_vel_count_7d").alias("n7"),
        F.max("f_vel_amt_sum_7d").alias("s7"),
    )


@query(
    "x1_string_functions",
    """SELECT o_orderkey, lower(trim(o_orderpriority)) AS cleaned,
  o_orderpriority LIKE '1%' AS urgent, lower(o_orderpriority) IN ('1-urgent', '2-high') AS pressing,
  'p_' || o_orderstatus AS prefixed, regexp_matches(o_orderpriority, '[0-9]-[MN]') AS matched,
  substr(o_orderpriority, instr(o_orderpriority, '-') + 1) AS rest FROM orders""",
)
def string_functions(spark, folder):
    text = F.col("o_orderpriority")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.lower(F.trim(text)).alias("cleaned"),
        text.startswith("1").alias("urgent"),
        F.lower(text).isin("1-urgent", "2-high").alias("pressing"),
        F.concat(F.lit("p_"), "o_orderstatus").alias("prefixed"),
        text.rlike("[0-9]-[MN]").alias("matched"),
        F.split(text, "-", 2)[1].alias("rest"),
    )


@query(
    "x3_math_functions",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  least(greatest(l_quantity, 5), 40) AS clipped, abs(l_discount - 0.05e0) AS gap,
  round(ln(l_quantity), 9) AS log_quantity, sqrt(l_quantity) AS root,
  l_extendedprice / nullif(l_quantity - 10, 0) AS guarded FROM lineitem""",
)
def math_functions(spark, folder):
    q = F.col("l_quantity")
    out = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.least(F.greatest(q, F.lit(5.0)), F.lit(40.0)).alias("clipped"),
        F.abs(F.col("l_discount") - 0.05).alias("gap"),
        F.log(q).alias("log_quantity"),
        F.sqrt(q).alias("root"),
        ratio(F.col("l_extendedprice"), q - 10).alias("guarded"),
    )
    return rounded(out, ["log_quantity"])


@query(
    "x4_array_functions",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  array_to_string(list_sort(list_distinct([l_linenumber, 3, CAST(l_quantity AS INT) % 5])), ',')
    AS distinct_sorted, len(list_filter([1, 2, 3, 4], lambda x: x <= l_linenumber)) AS edges_below
FROM lineitem""",
)
def array_functions(spark, folder):
    line = F.col("l_linenumber")
    items = F.array(line, F.lit(3), F.col("l_quantity").cast("int") % 5)
    text = F.transform(F.array_sort(F.array_distinct(items)), lambda x: x.cast("string"))
    below = F.size(F.filter(F.array(*[F.lit(i) for i in (1, 2, 3, 4)]), lambda x: x <= line))
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.array_join(text, ",").alias("distinct_sorted"),
        below.cast("long").alias("edges_below"),
    )


@query(
    "x5_json_functions",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k,
  '{"k":' || json_extract_string(props, '$.k') || ',"t":"' || event_type || '"}' AS doc
FROM events""",
)
def json_functions(spark, folder):
    parsed = F.from_json("props", "k int")
    return table(spark, folder, "events").select(
        "event_id",
        parsed["k"].alias("k"),
        F.to_json(F.struct(parsed["k"].alias("k"), F.col("event_type").alias("t"))).alias("doc"),
    )
