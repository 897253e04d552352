"""Labelled rows: which ones may be learnt from, and samples of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))


def held_out(key: str, folds: int, which: int) -> Column:
    return F.coalesce(fold(key, folds) == which, F.lit(False))


def train_labels(labels: DataFrame, key: str, label: str, folds: int, which: int) -> DataFrame:
    """One 0/1 label per key outside the held-out fold: the more frequent one, 1 in a tie; nulls are no labels."""
    rows = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key, folds, which))
    return rows.groupBy(F.col(key).alias("_key")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("_label"))


def thinned(df: DataFrame, key: str, bound: int, salt: str, rows: int | None = None) -> DataFrame:
    """A hash sample of about ``bound`` rows (all of them, if there are no more); the same on every retry."""
    rows = df.count() if rows is None else rows
    if rows <= bound:
        return df
    part = F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1 << 30))
    return df.filter(part < int(bound / rows * (1 << 30)))
