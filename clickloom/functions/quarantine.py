"""Row-level error handling: good rows on one side, (row, error) on the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def quarantine(df: DataFrame, checks: dict[str, Column], error_col: str = "error") -> DataFrame:
    """Add ``error_col``: the first failed check's name, or null for a good row.

    ``checks`` maps an error name to a condition that is true for a bad row.
    """
    error = F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items()])
    return df.withColumn(error_col, error)


def good_rows(df: DataFrame, error_col: str = "error") -> DataFrame:
    return df.filter(F.col(error_col).isNull()).drop(error_col)


def bad_rows(df: DataFrame, error_col: str = "error") -> DataFrame:
    return df.filter(F.col(error_col).isNotNull())
