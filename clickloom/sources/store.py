"""Keyed hash records and versioned models as tables.

A record is long: ``(key, field, value, version)``. Writers append; readers keep the value of the
newest version of each field, so an upsert costs only the rows it carries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickloom.functions.hashing import hash_int
from clickloom.session import list_dirs, table_exists

RECORD_COLUMNS = ["key", "field", "value", "version"]


def as_records(df: DataFrame, key, field, value, version) -> DataFrame:
    """Shape any table into records; values are kept as text."""
    return df.select(
        key.cast("string").alias("key"),
        field.cast("string").alias("field"),
        value.cast("string").alias("value"),
        version.cast("bigint").alias("version"),
    )


def latest_records(records: DataFrame) -> DataFrame:
    """Newest value per (key, field); of one version the greatest value wins."""
    order = F.struct("version", "value")
    return records.groupBy("key", "field").agg(
        F.max_by("value", order).alias("value"), F.max("version").alias("version")
    )


def upsert_records(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fields of ``new`` overwrite equal fields of ``old``; all other fields stay."""
    return latest_records(old.select(*RECORD_COLUMNS).unionByName(new.select(*RECORD_COLUMNS)))


def lookup_records(keys: DataFrame, records: DataFrame) -> DataFrame:
    """All fields of each key; a missing key gives one row with ``found = false``."""
    found = records.select("key", "field", "value", F.lit(True).alias("found"))
    return keys.join(found, "key", "left").fillna(False, ["found"])


def records_to_maps(records: DataFrame, chunks: int = 1) -> DataFrame:
    """``(key, chunk, fields MAP)``: every key's fields are dealt to ``chunks`` maps by a hash of the field; empty ones have no row.

    The number is fixed for all keys, so the shape of a record does not depend on its size; choose it for the largest key,
    whose maps are then as many tasks'.
    """
    chunk = F.pmod(hash_int(F.col("field")), F.lit(chunks)).cast("bigint")
    entries = F.sort_array(F.collect_list(F.struct("field", "value")))
    return records.groupBy("key", chunk.alias("chunk")).agg(F.map_from_entries(entries).alias("fields"))


class RecordStore:
    """Append-only record table at a shared path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def upsert(self, records: DataFrame, batch: str) -> bool:
        """Write one batch; a batch that is already committed is skipped (safe under replay)."""
        target = f"{self.path}/batch={batch}"
        if table_exists(self.spark, target):
            return False
        records.select(*RECORD_COLUMNS).write.mode("overwrite").parquet(target)
        return True

    def batches(self) -> list[str]:
        return [d for d in list_dirs(self.spark, self.path) if table_exists(self.spark, f"{self.path}/{d}")]

    def read(self) -> DataFrame:
        paths = [f"{self.path}/{d}" for d in self.batches()]
        if not paths:
            raise ValueError(f"no committed batch under {self.path}")
        return latest_records(self.spark.read.parquet(*paths))

    def lookup(self, keys: DataFrame) -> DataFrame:
        return lookup_records(keys, self.read())

    def compact_to(self, path: str) -> "RecordStore":
        """Newest values only, written as the first batch of a new store."""
        target = RecordStore(self.spark, path)
        target.upsert(self.read(), "0")
        return target


def latest_model(weights: DataFrame) -> DataFrame:
    """Newest version of each model key (global model: key '')."""
    registry = model_registry(weights)
    return weights.join(registry, ["model_key", "version"], "left_semi")


def model_registry(weights: DataFrame) -> DataFrame:
    """``(model_key, version)`` of the newest version; map-side combined."""
    return weights.groupBy("model_key").agg(F.max("version").alias("version"))


class ModelStore:
    """Versioned ``weights(model_key, feature, w)``; readers see committed versions only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def publish(self, weights: DataFrame, version: int) -> bool:
        target = f"{self.path}/version={int(version)}"
        if table_exists(self.spark, target):
            return False
        weights.select("model_key", "feature", "w").write.mode("overwrite").parquet(target)
        return True

    def versions(self) -> list[int]:
        dirs = [d for d in list_dirs(self.spark, self.path) if d.startswith("version=")]
        return sorted(int(d.split("=")[1]) for d in dirs if table_exists(self.spark, f"{self.path}/{d}"))

    def read_all(self) -> DataFrame:
        paths = [f"{self.path}/version={v}" for v in self.versions()]
        if not paths:
            raise ValueError(f"no published version under {self.path}")
        return self.spark.read.option("basePath", self.path).parquet(*paths).withColumn(
            "version", F.col("version").cast("bigint")
        )

    def latest(self) -> DataFrame:
        return latest_model(self.read_all())


def write_partitions(df: DataFrame, writer) -> None:
    """Hook for an external keyed store: ``writer(rows)`` runs once per partition."""
    df.foreachPartition(writer)
