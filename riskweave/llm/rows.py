"""Rows of a caller's table carried through an operator as one struct, so that no column of
theirs can clash with the operator's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOC = "doc"


def wrapped(docs: DataFrame, **own: Column) -> DataFrame:
    """One column with the whole row, and the operator's columns, made from the row's."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias(DOC), *[v.alias(k) for k, v in own.items()])


def unwrapped(df: DataFrame, like: DataFrame, **changed: Column) -> DataFrame:
    """The columns of `like`, some of them changed or added."""
    kept = [
        (changed[c] if c in changed else F.col(DOC).getField(c)).alias(c) for c in like.columns
    ]
    return df.select(*kept, *[v.alias(k) for k, v in changed.items() if k not in like.columns])
