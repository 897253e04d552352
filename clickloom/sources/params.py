"""Model parameters on disk: parquet tables and ``index:value`` text directories.

One format is shared by offline and online training, so what one writes the other reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BIAS = "__bias__"


def save_params(weights: DataFrame, factors: DataFrame | None, path: str) -> None:
    weights.write.mode("overwrite").parquet(f"{path}/weights")
    if factors is not None:
        factors.write.mode("overwrite").parquet(f"{path}/factors")


def load_params(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/weights"), spark.read.parquet(f"{path}/factors")


def save_params_text(weights: DataFrame, factors: DataFrame, feature_index: DataFrame, path: str, n_factors: int) -> None:
    """Text directories ``w0`` (bias), ``w1`` (linear) and ``w2`` (factors, row-major)."""

    def lines(df: DataFrame, index, value: str) -> DataFrame:
        return df.select(F.concat_ws(":", index.cast("string"), F.col(value).cast("string")).alias("line"))

    linear = weights.filter(F.col("feature") != BIAS).join(feature_index, "feature")
    factor = factors.join(feature_index, "feature")
    lines(weights.filter(F.col("feature") == BIAS), F.lit(0), "w").write.mode("overwrite").text(f"{path}/w0")
    lines(linear, F.col("idx"), "w").write.mode("overwrite").text(f"{path}/w1")
    position = F.col("idx") * F.lit(n_factors) + F.col("k")
    lines(factor, position, "v").write.mode("overwrite").text(f"{path}/w2")


def load_params_text(
    spark: SparkSession, path: str, n_factors: int, feature_index: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Inverse of :func:`save_params_text`; without an index the feature is its number as text."""

    def pairs(part: str) -> DataFrame:
        cell = F.split(F.col("value"), ":", 2)
        raw = spark.read.text(f"{path}/{part}", pathGlobFilter="part*")
        return raw.select(
            F.get(cell, F.lit(0)).try_cast("bigint").alias("pos"), F.get(cell, F.lit(1)).try_cast("double").alias("v")
        ).filter(F.col("pos").isNotNull() & F.col("v").isNotNull())

    bias = pairs("w0").select(F.lit(BIAS).alias("feature"), F.col("v").alias("w"))
    linear = pairs("w1").select(F.col("pos").alias("idx"), F.col("v").alias("w"))
    factor = pairs("w2").select(
        F.expr(f"pos div {n_factors}").alias("idx"), (F.col("pos") % n_factors).cast("int").alias("k"), "v"
    )
    if feature_index is None:
        linear = linear.withColumn("feature", F.col("idx").cast("string"))
        factor = factor.withColumn("feature", F.col("idx").cast("string"))
    else:
        linear = linear.join(feature_index, "idx")
        factor = factor.join(feature_index, "idx")
    return bias.unionByName(linear.select("feature", "w")), factor.select("feature", "k", "v")
