"""Comparison of tables and documents: metric tables, JSON documents, flag sets, counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MismatchError(ValueError):
    """A consistency guard found differing rows."""


def metric_mismatches(
    left: DataFrame, right: DataFrame, keys: Sequence[str], value: str = "value",
    tolerance: float = 0.0,
) -> DataFrame:
    """Keys whose values differ by more than the tolerance, or that only one side has."""
    a = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    both = a.join(b, list(keys), "full_outer")
    lv, rv = F.col("left_value"), F.col("right_value")
    same = lv.eqNullSafe(rv)
    if tolerance > 0:
        same = same | F.coalesce(F.abs(lv - rv) <= tolerance, F.lit(False))
    state = (
        F.when(F.col("_r").isNull(), "left_only")
        .when(F.col("_l").isNull(), "right_only")
        .when(~same, "differs")
    )
    return both.withColumn("state", state).where(F.col("state").isNotNull()).drop("_l", "_r")


def flag_agreement(
    left: DataFrame, right: DataFrame, key: str, by: Sequence[str] = ()
) -> DataFrame:
    """How many keys both sides flag, and how many only one does."""
    a = left.select(*by, key).distinct().withColumn("_l", F.lit(True))
    b = right.select(*by, key).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, [*by, key], "full_outer")
    return both.groupBy(*by).agg(
        F.count_if(F.col("_l") & F.col("_r")).alias("both"),
        F.count_if(F.col("_r").isNull()).alias("left_only"),
        F.count_if(F.col("_l").isNull()).alias("right_only"),
    )


def agreement_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, class) with class both, left_only or right_only."""
    a = left.select(key).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).distinct().withColumn("_r", F.lit(True))
    side = (
        F.when(F.col("_r").isNull(), "left_only")
        .when(F.col("_l").isNull(), "right_only")
        .otherwise("both")
    )
    return a.join(b, key, "full_outer").select(key, side.alias("class"))


def count_mismatches(
    rebuilt: DataFrame, stored: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """Rows at shared keys where any column differs (nulls are equal)."""
    a, b = rebuilt.alias("a"), stored.alias("b")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return (
        a.join(b, key)
        .where(~same)
        .select(
            key,
            *[F.col(f"a.{c}").alias(f"rebuilt_{c}") for c in columns],
            *[F.col(f"b.{c}").alias(f"stored_{c}") for c in columns],
        )
    )


def require_equal(mismatches: DataFrame, what: str) -> None:
    """Raises if a comparison left any row; only the first few reach the driver."""
    found = mismatches.limit(5).collect()
    if found:
        raise MismatchError(f"{what}: {[r.asDict() for r in found]}")


def escaped(name: str) -> str:
    """A key as a part of a path: as in JSON pointers, and brackets, which mark list places."""
    for plain, code in (("~", "~0"), ("/", "~1"), ("[", "~2")):
        name = name.replace(plain, code)
    return name


def json_leaves(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value): every leaf of a JSON document, array items by position. Documents
    spread over the tasks; each one is flattened on its own."""

    def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for batch in batches:
            out: list[tuple] = []
            for doc_key, body in zip(batch[key], batch[text]):
                pending = [("", json.loads(body))]
                while pending:
                    path, node = pending.pop()
                    if isinstance(node, dict) and node:
                        pending += [(f"{path}/{escaped(name)}", child) for name, child in node.items()]
                    elif isinstance(node, list) and node:
                        pending += [(f"{path}[{i}]", child) for i, child in enumerate(node)]
                    else:
                        # 1 and 1.0 are the same number
                        whole = isinstance(node, float) and node.is_integer()
                        out.append((doc_key, path, json.dumps(int(node) if whole else node)))
            yield pd.DataFrame(out, columns=[key, "path", "value"])

    key_type = docs.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, path string, value string"
    return docs.select(key, text).mapInPandas(flatten, schema)


def json_differences(
    left: DataFrame, right: DataFrame, key: str, text: str,
    ignored_keys: Sequence[str] = (), ignored_paths: Sequence[str] = (),
) -> DataFrame:
    """Leaves that differ between two versions of each document. Objects under an ignored key,
    and whole ignored paths, are left out."""
    def kept(df: DataFrame) -> DataFrame:
        leaves = json_leaves(df, key, text)
        for name in ignored_keys:
            at, part = F.concat(F.col("path"), F.lit("/")), f"/{escaped(name)}"
            leaves = leaves.where(~at.contains(f"{part}/") & ~at.contains(f"{part}["))
        for path in ignored_paths:
            inside = (
                (F.col("path") == path)
                | F.startswith("path", F.lit(path + "/"))
                | F.startswith("path", F.lit(path + "["))
            )
            leaves = leaves.where(~inside)
        return leaves

    return metric_mismatches(kept(left), kept(right), [key, "path"])


# JSON texts of what an omitted field means.
DEFAULT_LIKE = ("false", "0", '""', "null", "[]", "{}")


def contract_differences(wanted: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """Differences that break a contract: a field only the found side has may hold a
    default-like value, and a wanted null equals a default-like value."""
    rows = json_differences(wanted, found, key, text)
    filler = F.col("right_value").isin(*DEFAULT_LIKE)
    unset = F.col("left_value") == "null"
    absent = F.col("right_value").isNull()
    tolerated = ((F.col("state") == "right_only") & filler) | (
        unset & (filler | absent)
    )
    return rows.where(~F.coalesce(tolerated, F.lit(False)))
