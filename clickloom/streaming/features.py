"""Streaming forms of the frequency, ranking and log-join operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from clickloom.operators import features, rank
from clickloom.session import table_exists
from clickloom.sources.store import RecordStore, as_records


def running_frequency(events: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Counts so far per (keys, item); use the update output mode."""
    return features.frequency(events, keys, item)


def daily_frequency(events: DataFrame, time_col: str, keys: list[str], item: str, lateness: str = "1 day") -> DataFrame:
    """Counts per day with a watermark, so that the state of past days is dropped."""
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, lateness)
    counts = timed.groupBy(F.window(time_col, "1 day"), *keys, item).agg(F.count("*").alias("count"))
    return counts.select(F.col("window.start").alias("day"), *keys, item, "count")


def frequency_sink(store: RecordStore, keys: list[str], item: str, prefix: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: changed counts become keyed records of that batch."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        key = F.concat(F.lit(f"{prefix}:"), features.composite_key(*keys))
        records = as_records(batch, key, F.col(item), F.col("count"), F.lit(batch_id))
        store.upsert(records, f"{batch_id:012d}")

    return apply


def ranking_sink(users: DataFrame, weights: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: ranks the requests of a batch against the static tables."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        target = f"{path}/batch={batch_id}"
        if not table_exists(batch.sparkSession, target):
            rank.rank_candidates(batch, users, weights).write.mode("overwrite").parquet(target)

    return apply


def join_impressions_clicks(
    impressions: DataFrame, clicks: DataFrame, keys: list[str], within: str = "1 hour", lateness: str = "1 day"
) -> DataFrame:
    """Inner stream-stream join: a click belongs to the impressions up to ``within`` before it.

    Both sides need ``keys``; their times are ``shown_at`` and ``clicked_at``. Repeated impressions
    of one list at one time count once, so a click is not multiplied by them. The watermarks and
    the time bound let Spark drop the state of old rows.
    """
    shown = impressions.withWatermark("shown_at", lateness).dropDuplicates([*keys, "shown_at"]).alias("i")
    clicked = clicks.withWatermark("clicked_at", lateness).alias("c")
    same = [F.col(f"i.{k}") == F.col(f"c.{k}") for k in keys]
    inside = (F.col("clicked_at") >= F.col("shown_at")) & (F.col("clicked_at") <= F.col("shown_at") + F.expr(f"INTERVAL {within}"))
    condition = inside
    for part in same:
        condition = condition & part
    joined = shown.join(clicked, condition, "inner")
    for k in keys:
        joined = joined.drop(F.col(f"c.{k}"))
    return joined


def training_rows(
    impressions: DataFrame, clicks: DataFrame, keys: list[str], click_id: str, within: str = "1 hour", lateness: str = "1 day"
) -> DataFrame:
    """Labeled rows from two logs that may deliver a row more than once: label 1 for each click on a list, 0 for a list without one.

    Repeated deliveries are dropped as long as they come within ``lateness`` of each other. A list without a click is
    released once the watermark says that no click within ``within`` can come any more. Needs ``keys``, ``shown_at``, ``clicked_at`` as
    :func:`join_impressions_clicks`.
    """
    shown = impressions.withWatermark("shown_at", lateness).dropDuplicatesWithinWatermark([*keys, "shown_at"]).alias("i")
    clicked = clicks.withWatermark("clicked_at", lateness).dropDuplicatesWithinWatermark([click_id]).alias("c")
    condition = (F.col("clicked_at") >= F.col("shown_at")) & (F.col("clicked_at") <= F.col("shown_at") + F.expr(f"INTERVAL {within}"))
    for k in keys:
        condition = condition & (F.col(f"i.{k}") == F.col(f"c.{k}"))
    joined = shown.join(clicked, condition, "left_outer")
    label = F.when(F.col(click_id).isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))
    return joined.select(*[F.col(f"i.{k}") for k in keys], "shown_at", click_id, label.alias("label"))
