"""Tables, JSON logs and delimited click logs, always read by column name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

IMPRESSION_SCHEMA = T.StructType(
    [
        T.StructField("list_session_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("feat_id_list", T.StringType()),
    ]
)
CLICK_SCHEMA = T.StructType(
    [
        T.StructField("list_session_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("feat_id", T.StringType()),
        T.StructField("position", T.LongType()),
    ]
)
USER_INFO_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("age_group", T.LongType()),
        T.StructField("fans_count_level", T.LongType()),
        T.StructField("gender", T.LongType()),
        T.StructField("network_type", T.LongType()),
        T.StructField("os", T.LongType()),
    ]
)
PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("age_group", T.ByteType()),
        T.StructField("gender", T.IntegerType()),
        T.StructField("fans_count_level", T.ByteType()),
        T.StructField("os", T.ByteType()),
        T.StructField("network_type", T.ByteType()),
        T.StructField("enable_times", T.LongType()),
        T.StructField("post_times", T.LongType()),
        T.StructField("enable_rate", T.FloatType()),
    ]
)
REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("list_session_id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("feat_list", T.StringType()),
    ]
)


def click_log_schema(categoricals: int = 9, numerics: int = 8) -> T.StructType:
    """id, click, three unused columns, then the categorical and the numeric columns."""
    fields = [T.StructField("id", T.StringType()), T.StructField("click", T.IntegerType())]
    fields += [T.StructField(f"unused_{i}", T.StringType()) for i in range(3)]
    fields += [T.StructField(f"cat_{i}", T.StringType()) for i in range(categoricals)]
    fields += [T.StructField(f"num_{i}", T.StringType()) for i in range(numerics)]
    return T.StructType(fields)


def read_click_csv(spark: SparkSession, path: str, categoricals: int = 9, numerics: int = 8) -> DataFrame:
    schema = click_log_schema(categoricals, numerics)
    df = spark.read.schema(schema).option("header", "false").option("mode", "PERMISSIVE").csv(path)
    return df.drop("unused_0", "unused_1", "unused_2")


def read_json_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines under an explicit schema: no inference pass over the data."""
    return spark.read.schema(schema).json(path)


def read_logs(spark: SparkSession, impressions: str, clicks: str, users: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        read_json_log(spark, impressions, IMPRESSION_SCHEMA),
        read_json_log(spark, clicks, CLICK_SCHEMA),
        read_json_log(spark, users, USER_INFO_SCHEMA),
    )


def read_table(spark: SparkSession, name: str, database: str | None = None) -> DataFrame:
    """Catalog table by name; ``name`` may also be a parquet path."""
    if "/" in name:
        return spark.read.parquet(name)
    return spark.table(f"{database}.{name}" if database else name)
