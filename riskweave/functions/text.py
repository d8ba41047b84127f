"""Parsing of labels, units and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label texts that count as positive.
POSITIVE_LABELS = ("1", "true", "fraud", "yes")


def binary_label(column: Column, data_type: str) -> Column:
    """0/1 from a boolean, a number (non-zero) or a label text; missing texts are 0."""
    if data_type == "boolean":
        return column.cast("int")
    if data_type in ("string", "varchar"):
        hit = F.lower(F.trim(column)).isin(*POSITIVE_LABELS)
        return F.when(hit, 1).otherwise(0)
    # a missing number differs from zero
    return F.when(column == 0, 0).otherwise(1)


def duration_seconds(text: Column) -> Column:
    """`2m30s`, `45s` or `3m` in seconds; null for anything else."""
    minutes = F.regexp_extract(text, r"^(\d+)m", 1)
    seconds = F.regexp_extract(text, r"(\d+)s$", 1)
    value = F.coalesce(F.try_to_number(minutes, F.lit("999999999")), F.lit(0)) * 60
    value = value + F.coalesce(F.try_to_number(seconds, F.lit("999999999")), F.lit(0))
    valid = text.rlike(r"^(\d+m)?(\d+s)?$") & (F.length(text) > 0)
    return F.when(valid, value.cast("long"))


def memory_mebibytes(text: Column) -> Column:
    """`512Mi`, `2Gi` or `4096Ki` in MiB; null for anything else."""
    size = F.regexp_extract(text, r"^(\d+)(?:Ki|Mi|Gi)$", 1)
    unit = F.regexp_extract(text, r"^\d+(Ki|Mi|Gi)$", 1)
    n = F.when(size != "", size).cast("double")
    return F.when(unit == "Ki", n / 1024).when(unit == "Mi", n).when(unit == "Gi", n * 1024)


def metric_name(name: Column) -> Column:
    """Metric names keep letters, digits, `_ - . /` and blanks."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}_\-./ ]", "_")
