"""Input tables of the registered queries and the SQL they share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.splits import temporal_grouped_split

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            # the tables hold zone-less times, read as UTC
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, folder)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events_tx(spark: SparkSession, folder: str) -> DataFrame:
    """Events as transactions: error events are the positives."""
    k = F.get_json_object("props", "$.k")
    return canonical_events(table(spark, folder, "events")).withColumn("f_k", k.cast("double")).drop(
        "props"
    )


def canonical_events(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("user_id").cast("string").alias("entity_id"),
        F.col("value").alias("amount"),
        F.concat(F.lit("c"), (k % 8).cast("string")).alias("category"),
        (F.col("event_type") == "error").cast("int").alias("is_fraud"),
        "props",
    )


def orders_tx(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as transactions: day-grain times, so many ties."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("transaction_id"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("o_custkey").cast("string").alias("entity_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("category"),
        (F.col("o_orderstatus") == "P").cast("int").alias("is_fraud"),
    )


def stand_in(amount: Column, scale: float = 20.0) -> Column:
    """A score that both engines compute exactly alike."""
    return F.floor(F.lit(1e4) * amount / (amount + F.lit(scale))) / F.lit(1e4)


def scored(tx: DataFrame, scale: float = 20.0) -> DataFrame:
    return tx.select(
        "transaction_id",
        "timestamp",
        "entity_id",
        "amount",
        F.col("is_fraud").alias("y"),
        stand_in(F.col("amount"), scale).alias("p"),
    )


def scored_events(spark: SparkSession, folder: str) -> DataFrame:
    return scored(events_tx(spark, folder))


def scored_test(spark: SparkSession, folder: str) -> DataFrame:
    """The held-out side of the events, scored."""
    return scored(temporal_grouped_split(events_tx(spark, folder))[1])


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 9) -> DataFrame:
    """Sums of doubles differ in the last bits between engines; results are compared rounded."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- SQL -------------------------------------------------------------------------------------

EVENTS_SQL = """tx AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id, ts AS timestamp,
         CAST(user_id AS VARCHAR) AS entity_id, value AS amount,
         'c' || CAST(CAST(json_extract_string(props, '$.k') AS INT) % 8 AS VARCHAR) AS category,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_fraud,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS f_k
  FROM events)"""

ORDERS_SQL = """tx AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id, o_orderdate AS timestamp,
         CAST(o_custkey AS VARCHAR) AS entity_id, o_totalprice AS amount,
         o_orderpriority AS category,
         CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS is_fraud
  FROM orders)"""


def order_sql(source: str = "tx", prefix: str = "") -> str:
    """Entities of `source` with the rows ahead of them in first-seen order."""
    return f"""{prefix}ent AS (
  SELECT entity_id, min(timestamp) AS first_seen, count(*) AS n, sum(is_fraud) AS frauds
  FROM {source} GROUP BY 1),
{prefix}ord AS (
  SELECT *, coalesce(sum(n) OVER (ORDER BY first_seen, entity_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rb,
         sum(n) OVER () AS total FROM {prefix}ent)"""


SIDES_SQL = f"""{order_sql()},
side AS (SELECT entity_id, first_seen,
                CASE WHEN rb < total * 0.8e0 THEN 'train' ELSE 'test' END AS side FROM ord)"""

SCORE = "floor(1e4 * amount / (amount + 20e0)) / 1e4"
SCORED_SQL = f"""scored AS (
  SELECT transaction_id, timestamp, entity_id, amount, is_fraud AS y, {SCORE} AS p FROM tx)"""
TEST_SQL = f"""{SIDES_SQL},
scored AS (
  SELECT transaction_id, timestamp, tx.entity_id, amount, is_fraud AS y, {SCORE} AS p
  FROM tx JOIN side ON tx.entity_id = side.entity_id WHERE side = 'test')"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def values_sql(name: str, columns: Sequence[str], rows: Sequence[tuple]) -> str:
    def literal(v) -> str:
        if isinstance(v, str):
            return f"'{v}'"
        return f"{v!r}e0" if isinstance(v, float) and "e" not in repr(v) else repr(v)

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"
