"""Distributed matrices as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def to_coordinates(rows: DataFrame, row_col: str, values_col: str) -> DataFrame:
    """Dense rows to ``(i, j, v)``."""
    return rows.select(
        F.col(row_col).cast("bigint").alias("i"), F.posexplode(values_col).alias("j", "v")
    ).select("i", F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))


def transpose_coordinates(coo: DataFrame) -> DataFrame:
    """Swap the axes: a projection, no shuffle."""
    return coo.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def to_row_blocks(coo: DataFrame, block: int = 4096) -> DataFrame:
    """Group coordinates into rows, cut into blocks of ``block`` columns.

    ``(i, block, first_j, values)``: a transposed row is as long as the table it came from, so it is
    stored in pieces of bounded size and no task holds a whole one.
    """
    cells = F.sort_array(F.collect_list(F.struct("j", "v")))
    return (
        coo.groupBy("i", F.expr(f"j div {block}").alias("block"))
        .agg(cells.alias("cells"))
        .select(
            "i",
            "block",
            F.col("cells")[0]["j"].alias("first_j"),
            F.transform("cells", lambda c: c["v"]).alias("values"),
        )
    )


def transpose_rows(rows: DataFrame, row_col: str, values_col: str, block: int = 4096) -> DataFrame:
    """Transposed dense rows in blocks."""
    return to_row_blocks(transpose_coordinates(to_coordinates(rows, row_col, values_col)), block)
