"""Columns that are computed once a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are generated: filters on them stay above, and later expressions read them.

    A plain column is put into every expression that names it. That repeats its work, and beyond 8,000 bytes the method that
    Spark generates for a step is no longer compiled by the JVM but interpreted, row by row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))
