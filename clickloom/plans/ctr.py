"""Click log to boosted trees: split, index coding, clean-up, training, scoring, report."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from clickloom.operators import features, metrics, trees
from clickloom.session import broadcast_if_small, cut_lineage


def prepare(log: DataFrame, index: DataFrame, categories: list[str], numerics: list[str]) -> DataFrame:
    """Coded categories and cleaned numbers as double columns; unseen categories keep their own code."""
    coded = features.code_categories(log, categories, index)
    numbers = [F.coalesce(features.clean_number(F.col(c)), F.lit(0.0)).alias(f"{c}_num") for c in numerics]
    return coded.select("*", *numbers)


def input_names(categories: list[str], numerics: list[str]) -> list[str]:
    return [f"{c}_idx" for c in categories] + [f"{c}_num" for c in numerics]


def fit_ctr(log: DataFrame, label: str, categories: list[str], numerics: list[str], iterations: int = 60, depth: int = 6):
    """Train on a log with an ``id`` column; returns the category index and the fitted model."""
    index = broadcast_if_small(cut_lineage(features.category_index(log, categories)))  # joined once per column and pass
    rows = prepare(log, index, categories, numerics).withColumn(label, F.col(label).cast("double"))
    return index, trees.fit_gbt(rows, input_names(categories, numerics), label, iterations, depth)


def ctr_report(
    log: DataFrame,
    label: str,
    categories: list[str],
    numerics: list[str],
    iterations: int = 60,
    depth: int = 6,
    train: float = 0.8,
    model_path: str | None = None,
) -> DataFrame:
    """Confusion counts, accuracy, precision and recall on the held-out part of the log."""
    from pyspark.ml import PipelineModel

    split = features.hash_split(log, [F.col("id")], train).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        index, model = fit_ctr(split.filter("split = 'train'").drop("split"), label, categories, numerics, iterations, depth)
        if model_path:
            model.write().overwrite().save(model_path)
            model = PipelineModel.load(model_path)
        held_out = prepare(split.filter("split = 'validate'"), index, categories, numerics)
        scored = model.transform(held_out)
        report = metrics.confusion(scored, F.col("prediction") > 0.5, F.col(label) > 0)
        return report
    finally:
        split.unpersist()
