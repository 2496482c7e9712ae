"""Whole rows carried as one column, so that no name of theirs meets one of ours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def fields(columns: list[str], row: str = "_row") -> list[Column]:
    return [F.col(row).getField(c).alias(c) for c in columns]
