"""Global numbering and running sums without a single-task window.

The rows are range-partitioned on the order, numbered inside each partition, and shifted by the
totals of the partitions before; the only table in one task has one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.session import cut_lineage

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _range_layout(df: DataFrame, order: list[str], partitions: int | None) -> DataFrame:
    cols = [F.col(c) for c in order]
    ranged = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    mid = F.monotonically_increasing_id()
    # Checkpointed: range bounds are sampled per run, and two readers must see the same layout.
    return cut_lineage(ranged.sortWithinPartitions(*cols).withColumn("_mid", mid)).withColumn(
        "_pid", F.shiftrightunsigned("_mid", _LOCAL_BITS)
    )


def _offsets(layout: DataFrame, sums: dict[str, Column]) -> DataFrame:
    totals = layout.groupBy("_pid").agg(*[c.alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shifted = [F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums]
    return F.broadcast(totals.select("_pid", *shifted))  # one row per partition


def dense_index(df: DataFrame, order: list[str], name: str = "idx", start: int = 0, partitions: int | None = None) -> DataFrame:
    """Consecutive numbers in the given order (which must be unique for a stable result)."""
    layout = _range_layout(df, order, partitions)
    offsets = _offsets(layout, {"n": F.count("*")})
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    numbered = layout.join(offsets, "_pid")
    return numbered.select(*df.columns, (local + F.col("_off_n") + F.lit(start)).alias(name))


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Add, for each ``name: column``, the sum of ``column`` over all rows before this one."""
    layout = _range_layout(df, order, partitions)
    offsets = _offsets(layout, {n: F.sum(c) for n, c in sums.items()})
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = [
        (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_off_{n}")).alias(n) for n, c in sums.items()
    ]
    return layout.join(offsets, "_pid").select(*df.columns, *out)
