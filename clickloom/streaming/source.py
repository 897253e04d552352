"""File streams and the common way to drive them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from clickloom.session import is_directory


def file_stream(spark: SparkSession, folder: str, glob: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, under the schema of the files already there."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The table ``folder/name`` as a stream, whether it is one parquet file or a folder of them."""
    if is_directory(spark, f"{folder}/{name}"):
        return file_stream(spark, f"{folder}/{name}", "*.parquet", files_per_batch)
    return file_stream(spark, folder, name, files_per_batch)


def run_available(writer, checkpoint: str) -> StreamingQuery:
    """Process everything that is there, in as many batches as the source makes, then stop."""
    running = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return running
