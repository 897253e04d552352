"""Evaluation of scored rows ``(label, score)``; everything is one-row aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.functions.expr import cross_entropy, logistic_loss, pointwise_loss
from clickloom.operators.ordering import running_sums


def auc(scored: DataFrame, label: str = "label", score: str = "score", partitions: int | None = None) -> DataFrame:
    """Exact ROC-AUC with averaged ties; null when a class is missing.

    Rows are first counted per distinct score (map-side), then the negatives below each score come
    from a range-partitioned running sum.
    """
    positive = F.col(label) > 0
    per_score = scored.groupBy(F.col(score).alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    ranked = running_sums(per_score, ["score"], {"neg_below": "neg"}, partitions)
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / F.lit(2.0)))
    total = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(
        F.try_divide(wins, total).alias("auc"),
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
    )


def mean_loss(scored: DataFrame, loss: str, label: str = "label", score: str = "score") -> DataFrame:
    """Mean log-loss: of raw scores with -1/+1 labels ("exp"), of probabilities with 0/1 ("log")."""
    if loss == "exp":
        each = logistic_loss(F.col(label), F.col(score))
    elif loss == "log":
        each = cross_entropy(F.col(label), F.col(score))
    else:
        raise ValueError(f"unknown loss {loss!r}")
    return scored.agg(F.avg(each).alias("loss"), F.count("*").alias("rows"))


def predicted_positive(score: Column, loss: str) -> Column:
    """Class of a score: > 0 for raw scores ("exp"), > 0.5 for probabilities ("log")."""
    return score > F.lit(0.0 if loss == "exp" else 0.5)


def accuracy(scored: DataFrame, loss: str, label: str = "label", score: str = "score") -> DataFrame:
    hit = predicted_positive(F.col(score), loss) == (F.col(label) > 0)
    return scored.agg(F.avg(hit.cast("double")).alias("accuracy"), F.count("*").alias("rows"))


def confusion(scored: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """Counts, accuracy, precision and recall in one pass; an empty denominator gives null."""
    counts = scored.agg(
        F.count_if(predicted & actual).alias("tp"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
        F.count_if(~predicted & ~actual).alias("tn"),
    )
    right, total = F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.select(
        "tp",
        "fp",
        "fn",
        "tn",
        F.try_divide(right, total).alias("accuracy"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
    )


def evaluate(scored: DataFrame, loss: str) -> DataFrame:
    """One row ``(accuracy, loss, auc)`` for rows ``(label, score)`` with raw scores.

    In "log" mode the logistic function is applied before the threshold.
    """
    hit = (F.col("score") > 0) == (F.col("label") > 0)
    summary = scored.agg(
        F.avg(hit.cast("double")).alias("accuracy"), F.avg(pointwise_loss(F.col("label"), F.col("score"), loss)).alias("loss")
    )
    return summary.withColumn("auc", auc(scored).select("auc").scalar())


def prequential(scored: DataFrame, loss: str, batch: str = "batch_id") -> DataFrame:
    """Per-batch and running accuracy and loss of rows scored before the model saw them."""
    hit = ((F.col("score") > 0) == (F.col("label") > 0)).cast("bigint")
    per_batch = scored.groupBy(batch).agg(
        F.count("*").alias("rows"),
        F.sum(hit).alias("hits"),
        F.sum(pointwise_loss(F.col("label"), F.col("score"), loss)).alias("loss_sum"),
    )
    so_far = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)  # one row per batch
    return per_batch.select(
        batch,
        "rows",
        (F.col("hits") / F.col("rows")).alias("accuracy"),
        (F.col("loss_sum") / F.col("rows")).alias("loss"),
        (F.sum("hits").over(so_far) / F.sum("rows").over(so_far)).alias("running_accuracy"),
        (F.sum("loss_sum").over(so_far) / F.sum("rows").over(so_far)).alias("running_loss"),
    )
