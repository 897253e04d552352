"""Loss per iteration, observed by the job that computes the iteration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def observed(df: DataFrame, loss: Column, history: list | None) -> tuple[DataFrame, Observation | None]:
    """``df`` with an observed ``loss``, if a history is wanted: no job of its own, the next one on ``df`` brings it."""
    if history is None:
        return df, None
    seen = Observation()
    return df.observe(seen, loss.alias("loss")), seen


def note(history: list | None, iteration: int, seen: Observation | None) -> None:
    """Append (iteration, loss) after the job has run."""
    if seen is not None:
        history.append((iteration, seen.get["loss"]))


def history_table(spark: SparkSession, histories: dict[str, list[tuple[int, float]]]) -> DataFrame:
    """(trainer, iteration, loss) of the histories of several trainers: one row per iteration."""
    rows = [(name, int(t), float(v)) for name, found in histories.items() for t, v in found]
    return spark.createDataFrame(rows, "trainer string, iteration bigint, loss double")
