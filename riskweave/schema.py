"""The canonical transaction table.

One row per transaction: transaction_id STRING, timestamp TIMESTAMP, entity_id STRING,
amount DOUBLE, category STRING, is_fraud INT and any number of f_* DOUBLE features. Missing
numbers are NULL, never 0 or NaN. Rows have no inherent order; whatever depends on order sorts
by (timestamp, transaction_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

CORE = ("transaction_id", "timestamp", "entity_id", "amount", "category", "is_fraud")
# Fixed value: the text that stands for a missing entity.
NO_ENTITY = "nan"
FEATURE_PREFIX = "f_"
TIME_FEATURES = ("hour_of_day", "day_of_week")


def feature_names(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if c.startswith(FEATURE_PREFIX))


def numeric_columns(df: DataFrame) -> list[str]:
    """Model inputs: amount, the time features, then every f_* column in name order. entity_id
    is the split's group key and never a feature."""
    return ["amount", *[c for c in TIME_FEATURES if c in df.columns], *feature_names(df)]
