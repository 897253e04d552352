"""Cosine similarity of all column pairs from sampled products of entries.

An entry of column ``c`` is kept with probability ``p_c = min(1, sqrt(gamma) / |c|)`` and counts ``1 / p_c`` times, so each kept pair of a row
stands for ``1 / (p_i p_j)`` pairs and the estimate has no bias. Columns with much weight are thinned most, which bounds the pairs of a
column by ``gamma`` and not by its rows; the error falls as ``1 / sqrt(gamma)`` for all pairs of columns. Coins are md5 of row and
column: the same on every retry and in SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from clickloom.functions.hashing import hash_unit
from clickloom.session import broadcast_if_small, cut_lineage


def vector_entries(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Non-zero entries ``(row, col, value)`` of dense vectors; nulls count as zero."""
    cells = vectors.select(F.col(id_col).alias("row"), F.posexplode(vector_col).alias("col", "value"))
    return cells.select("row", F.col("col").cast("bigint").alias("col"), F.col("value").cast("double").alias("value")).filter("value <> 0")


def oversampling(columns: int, threshold: float) -> float:
    """``gamma`` with which similarities of at least ``threshold`` are found with small relative error; infinite (exact) for 0."""
    return 10.0 * math.log(max(2, columns)) / threshold if threshold > 0 else math.inf


def column_similarities(entries: DataFrame, threshold: float = 0.0, gamma: float | None = None) -> DataFrame:
    """``(col_a, col_b, sim)`` for the column pairs ``a < b`` that share a kept row; exact without sampling.

    ``entries(row, col, value)`` has one row per entry. ``gamma`` overrides the number that follows from ``threshold``.
    """
    norms = cut_lineage(entries.groupBy("col").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")).filter("norm > 0"))
    bound = oversampling(norms.count(), threshold) if gamma is None else gamma
    kept = entries.join(broadcast_if_small(norms), "col")
    if math.isinf(bound):
        p = F.lit(1.0)
    else:
        p = F.least(F.lit(1.0), F.lit(math.sqrt(bound)) / F.col("norm"))
        kept = kept.filter((p >= 1.0) | (hash_unit(F.col("row"), F.col("col")) < p))
    kept = kept.select("row", "col", (F.col("value") / F.col("norm") / p).alias("x"))
    a, b = (kept.select("row", F.col("col").alias(f"col_{n}"), F.col("x").alias(f"x_{n}")) for n in "ab")
    pairs = a.join(b, "row").filter("col_a < col_b")
    return pairs.groupBy("col_a", "col_b").agg(F.sum(F.col("x_a") * F.col("x_b")).alias("sim"))


def estimate_error(exact: DataFrame, estimate: DataFrame, threshold: float) -> DataFrame:
    """Mean and largest absolute error over all exact pairs (a missing one counts as 0), and how many pairs of at least ``threshold`` were found."""
    guess = estimate.select("col_a", "col_b", F.col("sim").alias("guess"))
    joined = exact.join(guess, ["col_a", "col_b"], "left")
    off = F.abs(F.col("sim") - F.coalesce("guess", F.lit(0.0)))
    high = F.abs("sim") >= threshold
    return joined.agg(
        F.avg(off).alias("mae"), F.max(off).alias("largest"), F.count("*").alias("pairs"), F.count_if(high).alias("similar"), F.count_if(high & F.col("guess").isNotNull()).alias("found")
    )
