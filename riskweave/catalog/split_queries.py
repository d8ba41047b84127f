"""P1 to P10, J2, J4, J11, A28, O11, O12."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.catalog.common import (
    EVENTS_SQL,
    ORDERS_SQL,
    SIDES_SQL,
    events_tx,
    order_sql,
    orders_tx,
    query,
    rounded,
    with_sql,
)
from riskweave.operators import splits
from riskweave.operators.ordered import row_positions, scan
from riskweave.options import Options

OPTIONS = Options()
SPLIT_ROWS = """SELECT transaction_id, tx.entity_id, side
FROM tx JOIN side ON tx.entity_id = side.entity_id"""


@query("p1_temporal_grouped_split", with_sql(ORDERS_SQL, SIDES_SQL) + SPLIT_ROWS)
def temporal_split(spark, folder):
    train, test = splits.temporal_grouped_split(orders_tx(spark, folder))
    keep = ["transaction_id", "entity_id"]
    return train.select(*keep, F.lit("train").alias("side")).unionByName(
        test.select(*keep, F.lit("test").alias("side"))
    )


NULL_ENTITIES_SQL = EVENTS_SQL.replace(
    "CAST(user_id AS VARCHAR) AS entity_id",
    "CASE WHEN event_id % 10 > 0 THEN CAST(user_id AS VARCHAR) END AS entity_id",
)


def null_entities(spark, folder):
    """Every tenth event has no entity."""
    tenth = F.col("transaction_id").cast("long") % 10 == 0
    return events_tx(spark, folder).withColumn(
        "entity_id", F.when(~tenth, F.col("entity_id"))
    )


@query(
    "p1_split_with_missing_entities",
    with_sql(NULL_ENTITIES_SQL, SIDES_SQL)
    + """SELECT transaction_id, tx.entity_id, side FROM tx
  JOIN side ON tx.entity_id IS NOT DISTINCT FROM side.entity_id""",
)
def split_with_missing_entities(spark, folder):
    train, test = splits.temporal_grouped_split(null_entities(spark, folder))
    keep = ["transaction_id", "entity_id"]
    return train.select(*keep, F.lit("train").alias("side")).unionByName(
        test.select(*keep, F.lit("test").alias("side"))
    )


@query(
    "p3_first_seen_with_missing_entities",
    with_sql(NULL_ENTITIES_SQL)
    + """SELECT transaction_id, epoch_us(min(timestamp) OVER (PARTITION BY entity_id)) AS first_us
FROM tx""",
)
def first_seen_with_missing_entities(spark, folder):
    rows = splits.with_first_seen(null_entities(spark, folder))
    return rows.select("transaction_id", F.unix_micros("first_seen").alias("first_us"))


INNER_SQL = f"""{SIDES_SQL},
train AS (SELECT tx.* FROM tx JOIN side ON tx.entity_id = side.entity_id WHERE side = 'train'),
{order_sql("train", "inner_")},
sides AS (
  SELECT side.entity_id, CASE WHEN side = 'test' THEN 'test'
    WHEN inner_ord.rb < inner_ord.total * 0.8e0 THEN 'fit' ELSE 'calibration' END AS side
  FROM side LEFT JOIN inner_ord ON side.entity_id = inner_ord.entity_id)"""


@query(
    "p2_nested_split",
    with_sql(EVENTS_SQL, INNER_SQL)
    + """SELECT sides.side, count(*) AS n_rows, CAST(sum(is_fraud) AS BIGINT) AS frauds,
  avg(is_fraud) AS fraud_rate
FROM tx JOIN sides ON tx.entity_id = sides.entity_id GROUP BY 1""",
)
def nested_split(spark, folder):
    tx = events_tx(spark, folder)
    sides = splits.nested_sides(tx, OPTIONS.test_size, OPTIONS.calibration_size)
    return splits.split_counts(tx.join(sides, "entity_id"), ["side"]).withColumnRenamed(
        "rows", "n_rows"
    )


@query(
    "p3_first_seen",
    with_sql(ORDERS_SQL)
    + """SELECT transaction_id,
  epoch_us(min(timestamp) OVER (PARTITION BY entity_id)) AS first_seen_us FROM tx""",
)
def first_seen(spark, folder):
    seen = splits.with_first_seen(orders_tx(spark, folder))
    return seen.select("transaction_id", F.unix_micros("first_seen").alias("first_seen_us"))


def cuts_sql(fractions=OPTIONS.train_fractions) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {f}e0 AS fraction, min(first_seen) AS cut FROM ord WHERE rb >= total * {f}e0"
        for f in fractions
    )
    return f"cuts AS ({parts})"


@query(
    "p4_cut_timestamps",
    with_sql(ORDERS_SQL, order_sql(), cuts_sql())
    + "SELECT fraction, epoch_us(cut) AS cut_us FROM cuts",
)
def cut_timestamps(spark, folder):
    cuts = splits.cut_timestamps(orders_tx(spark, folder), OPTIONS.train_fractions)
    return cuts.select("fraction", F.unix_micros("cut").alias("cut_us"))


@query(
    "p5_split_before_cut",
    with_sql(ORDERS_SQL, order_sql(), cuts_sql((0.5,)))
    + """SELECT transaction_id, ord.first_seen < (SELECT cut FROM cuts) AS before_cut
FROM tx JOIN ord ON tx.entity_id = ord.entity_id""",
)
def split_before(spark, folder):
    tx = orders_tx(spark, folder)
    left, right = splits.split_before(tx, splits.cut_timestamp(tx, 0.5))
    return left.select("transaction_id", F.lit(True).alias("before_cut")).unionByName(
        right.select("transaction_id", F.lit(False).alias("before_cut"))
    )


FOLDS_SQL = """dcut AS (SELECT DISTINCT cut FROM cuts),
folds AS (SELECT row_number() OVER (ORDER BY cut) AS fold, cut,
                 lead(cut) OVER (ORDER BY cut) AS fold_end FROM dcut)"""


@query(
    "p6_rolling_folds",
    with_sql(EVENTS_SQL, order_sql(), cuts_sql(), FOLDS_SQL)
    + """SELECT fold, epoch_us(cut) AS cut_us, epoch_us(fold_end) AS end_us,
  CAST(sum(n) AS BIGINT) AS test_rows, CAST(sum(frauds) AS BIGINT) AS test_frauds,
  1 AS merged_windows
FROM folds JOIN ent ON first_seen >= cut AND (fold_end IS NULL OR first_seen < fold_end)
GROUP BY 1, 2, 3""",
)
def rolling_folds(spark, folder):
    tx = events_tx(spark, folder)
    folds = splits.build_folds(tx, OPTIONS.train_fractions, OPTIONS.min_test_fraud)
    rows = splits.assign_folds(tx, folds).where(F.col("fold").isNotNull())
    counts = rows.groupBy("fold").agg(
        F.count(F.lit(1)).alias("test_rows"), F.sum("is_fraud").alias("test_frauds")
    )
    out = fold_table(spark, folds).join(counts, "fold")
    return out.select(
        F.col("fold").cast("long").alias("fold"),
        F.unix_micros("cut").alias("cut_us"),
        F.unix_micros("end").alias("end_us"),
        "test_rows",
        "test_frauds",
        "merged_windows",
    )


def fold_table(spark, folds: list[splits.Fold]) -> DataFrame:
    rows = [(f.index, f.cut, f.end, f.merged_windows) for f in folds]
    return spark.createDataFrame(
        rows, "fold int, cut timestamp, end timestamp, merged_windows int"
    )


@query(
    "p7_leakage_audit",
    with_sql(EVENTS_SQL, order_sql(), cuts_sql(), FOLDS_SQL)
    + """SELECT fold, 0 AS straddling_rows, FALSE AS train_seen_after_cut,
  CAST(sum(CASE WHEN first_seen < cut THEN n ELSE 0 END) AS BIGINT) AS train_rows,
  CAST(sum(CASE WHEN first_seen >= cut AND (fold_end IS NULL OR first_seen < fold_end)
                THEN n ELSE 0 END) AS BIGINT) AS test_rows
FROM folds CROSS JOIN ent GROUP BY 1""",
)
def leakage_audit(spark, folder):
    tx = events_tx(spark, folder)
    folds = splits.build_folds(tx, OPTIONS.train_fractions, OPTIONS.min_test_fraud)
    return splits.leakage_audit(tx, folds)


@query(
    "p8_split_boundary",
    with_sql(ORDERS_SQL, SIDES_SQL)
    + """, d AS (SELECT tx.timestamp AS t, side = 'train' AS train
  FROM tx JOIN side ON tx.entity_id = side.entity_id),
b AS (SELECT max(t) FILTER (train) AS last_train, min(t) FILTER (NOT train) AS first_test FROM d)
SELECT epoch_us(last_train) AS train_last_us, epoch_us(first_test) AS test_first_us,
  count(*) FILTER (train AND t > first_test) AS train_rows_later,
  count(*) FILTER (train AND t = first_test) AS train_rows_at_boundary,
  count(*) FILTER (NOT train AND t = first_test) AS test_rows_at_boundary,
  last_train <= first_test AS ordered
FROM d CROSS JOIN b GROUP BY last_train, first_test""",
)
def split_boundary(spark, folder):
    train, test = splits.temporal_grouped_split(orders_tx(spark, folder))
    out = splits.split_boundary(train, test)
    return out.select(
        F.unix_micros("train_last_timestamp").alias("train_last_us"),
        F.unix_micros("test_first_timestamp").alias("test_first_us"),
        "train_rows_later",
        "train_rows_at_boundary",
        "test_rows_at_boundary",
        "ordered",
    )


@query(
    "p9_split_unmoved_by_features",
    "SELECT CAST(0 AS BIGINT) AS rows_moved, count(*) AS n_rows FROM events",
)
def split_unmoved(spark, folder):
    """The split depends on entity and time only: adding feature columns moves no row."""
    tx = events_tx(spark, folder)
    wide = tx.withColumn("f_extra", F.col("amount") * 2)

    def sides(df):
        train, test = splits.temporal_grouped_split(df)
        return train.select("transaction_id", F.lit("train").alias("side")).unionByName(
            test.select("transaction_id", F.lit("test").alias("side"))
        )

    moved = splits.rows_moved(sides(tx), sides(wide)).agg(F.count(F.lit(1)).alias("rows_moved"))
    return moved.withColumn("n_rows", tx.agg(F.count(F.lit(1)).alias("n")).scalar())


SPAN_SQL = """SELECT side, count(*) AS n_rows, CAST(sum(is_fraud) AS BIGINT) AS frauds,
  epoch_us(min(timestamp)) AS from_us, epoch_us(max(timestamp)) AS to_us,
  round((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 3.6e9, 9) AS hours
FROM tx JOIN side ON tx.entity_id = side.entity_id GROUP BY 1"""


@query("p10_window_span", with_sql(EVENTS_SQL, SIDES_SQL) + SPAN_SQL)
def window_span(spark, folder):
    tx = events_tx(spark, folder)
    spans = splits.window_span(tx.join(splits.entity_sides(tx, 0.2), "entity_id"), ["side"])
    return rounded(
        spans.select(
            "side",
            F.col("rows").alias("n_rows"),
            "frauds",
            F.unix_micros("from_timestamp").alias("from_us"),
            F.unix_micros("to_timestamp").alias("to_us"),
            "hours",
        ),
        ["hours"],
    )


@query(
    "j2_entity_membership",
    with_sql(EVENTS_SQL, SIDES_SQL)
    + """SELECT tx.entity_id, count(*) AS n FROM tx
WHERE tx.entity_id NOT IN (SELECT entity_id FROM side WHERE side = 'test') GROUP BY 1""",
)
def entity_membership(spark, folder):
    train, _ = splits.temporal_grouped_split(events_tx(spark, folder))
    return train.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j4_rows_to_fold_windows",
    with_sql(ORDERS_SQL, order_sql(), cuts_sql(), FOLDS_SQL)
    + """SELECT transaction_id, fold FROM tx JOIN ent ON tx.entity_id = ent.entity_id
JOIN folds ON first_seen >= cut AND (fold_end IS NULL OR first_seen < fold_end)""",
)
def rows_to_folds(spark, folder):
    tx = orders_tx(spark, folder)
    folds = splits.build_folds(tx, OPTIONS.train_fractions, 0)
    rows = splits.assign_folds(tx, folds).where(F.col("fold").isNotNull())
    return rows.select("transaction_id", F.col("fold").cast("long").alias("fold"))


@query(
    "j11_distinct_cuts",
    with_sql(ORDERS_SQL, order_sql(), cuts_sql()) + "SELECT DISTINCT epoch_us(cut) AS cut_us FROM cuts",
)
def distinct_cuts(spark, folder):
    cuts = splits.distinct_cuts(orders_tx(spark, folder), OPTIONS.train_fractions)
    return cuts.select(F.unix_micros("cut").alias("cut_us"))


@query(
    "a28_split_class_counts",
    with_sql(ORDERS_SQL, SIDES_SQL)
    + """SELECT side, is_fraud, count(*) AS n FROM tx JOIN side ON tx.entity_id = side.entity_id
GROUP BY 1, 2""",
)
def split_class_counts(spark, folder):
    tx = orders_tx(spark, folder)
    rows = tx.join(splits.entity_sides(tx, 0.2), "entity_id")
    return rows.groupBy("side", "is_fraud").agg(F.count(F.lit(1)).alias("n"))


@query(
    "o11_running_sums",
    """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS quantity,
  CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (ORDER BY l_orderkey, l_linenumber,
    l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
    AS quantity_before,
  CAST(sum(CAST(l_quantity AS BIGINT)) OVER () AS BIGINT) AS quantity_total
FROM lineitem""",
)
def running_sums(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").cast("long").alias("quantity"),
    )
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return scan(lines, order, ["quantity"]).drop("l_partkey", "l_suppkey")


@query(
    "o12_row_positions",
    with_sql(ORDERS_SQL)
    + """SELECT transaction_id,
  row_number() OVER (ORDER BY timestamp, transaction_id) - 1 AS position,
  count(*) OVER () AS position_count FROM tx""",
)
def positions(spark, folder):
    tx = orders_tx(spark, folder).select("timestamp", "transaction_id")
    return row_positions(tx, ["timestamp", "transaction_id"]).drop("timestamp")

