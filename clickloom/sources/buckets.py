"""Keyed records in buckets: batches are appended as runs, runs are merged as they become many.

A run is a Parquet table partitioned by ``bucket`` (a hash of the key), with Bloom filters on the key. A manifest, committed by its
``_SUCCESS`` file, names the runs that make up the store and the batches they hold; readers take the newest one, so a run
or a merge that was not finished is never seen. ``fan`` runs of one level become one run of the next, so the number of runs grows with the logarithm of
the number of batches. A look-up reads the buckets of its keys only. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickloom.session import broadcast_if_small, cut_lineage, is_directory, list_dirs, table_exists
from clickloom.sources.store import RECORD_COLUMNS, latest_records, lookup_records

POINT_KEYS = 1_000  # up to so many keys are named in the filter, where Bloom filters can rule out files
_MANIFEST = "run string, level int, batches array<string>"


class BucketStore:
    """Records ``(key, field, value, version)`` at a shared path.

    ``buckets``, ``splits`` (files of a bucket and batch, so that one key's fields are several tasks') and ``fan`` are
    fixed when the store is made: the first two are part of its layout.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, splits: int = 1, fan: int = 4):
        if min(buckets, splits) < 1 or fan < 2:
            raise ValueError("buckets and splits must be at least 1, fan at least 2")
        self.spark, self.path, self.buckets, self.splits, self.fan = spark, path.rstrip("/"), buckets, splits, fan

    def _newest(self) -> int:
        """Number of the newest committed manifest; 0 for none."""
        found = (int(d.split("=")[1]) for d in list_dirs(self.spark, f"{self.path}/manifests") if d.startswith("number="))
        return max((n for n in found if table_exists(self.spark, f"{self.path}/manifests/number={n}")), default=0)

    def runs(self) -> list[tuple[str, int, list[str]]]:
        """(run, level, batches) of the runs in use, oldest batch first: as many as levels times ``fan`` at most."""
        newest = self._newest()
        if not newest:
            return []
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifests/number={newest}").collect()
        return sorted(((r["run"], r["level"], list(r["batches"])) for r in rows), key=lambda r: (-r[1], r[0]))

    def _commit(self, runs: list[tuple[str, int, list[str]]]) -> None:
        target = f"{self.path}/manifests/number={self._newest() + 1}"
        self.spark.createDataFrame(runs, _MANIFEST).coalesce(1).write.mode("overwrite").json(target)

    def _bucket(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def _write(self, records: DataFrame) -> str:
        run = uuid.uuid4().hex
        split = F.pmod(F.xxhash64("field"), F.lit(self.splits))
        placed = records.withColumn("bucket", self._bucket()).repartition("bucket", split).sortWithinPartitions("bucket", "key", "field")
        writer = placed.write.partitionBy("bucket").option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(f"{self.path}/runs/{run}")
        return run

    def upsert(self, records: DataFrame, batch: str) -> bool:
        """Add one batch; a batch that the store has is skipped (safe under replay). Merges runs where ``fan`` of a level have come together."""
        runs = self.runs()
        if any(batch in held for _, _, held in runs):
            return False
        runs.append((self._write(latest_records(records.select(*RECORD_COLUMNS))), 0, [batch]))
        level = 0
        while len(full := [r for r in runs if r[1] == level]) >= self.fan:
            merged = self._write(self._latest([r[0] for r in full]))
            runs = [r for r in runs if r[1] != level] + [(merged, level + 1, sorted(b for r in full for b in r[2]))]
            level += 1
        self._commit(runs)
        return True

    def _open(self, runs: list[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], "key string, field string, value string, version bigint, bucket int")
        schema = "key string, field string, value string, version bigint, bucket int"
        paths = [f"{self.path}/runs/{r}" for r in runs if is_directory(self.spark, f"{self.path}/runs/{r}")]
        tables = [self.spark.read.schema(schema).parquet(p) for p in paths]
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def _latest(self, runs: list[str]) -> DataFrame:
        return latest_records(self._open(runs))

    def read(self) -> DataFrame:
        """Newest value of every field."""
        return self._latest([r[0] for r in self.runs()])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """All fields of each of ``keys(key)``; a missing key gives one row with ``found = false``."""
        asked = cut_lineage(keys.select("key").distinct())
        buckets = [r[0] for r in asked.filter("key IS NOT NULL").select(self._bucket()).distinct().collect()]  # at most one per bucket
        records = self._open([r[0] for r in self.runs()]).filter(F.col("bucket").isin(buckets))
        few = asked.limit(POINT_KEYS + 1).collect()
        if len(few) <= POINT_KEYS:
            records = records.filter(F.col("key").isin([r["key"] for r in few if r["key"] is not None]))
        else:
            records = records.join(broadcast_if_small(asked), "key", "left_semi")
        return lookup_records(keys, latest_records(records))

    def vacuum(self) -> int:
        """Delete runs and manifests that the newest manifest doesn't need; call it when no older reader is left. Returns their number."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        live, newest = {r[0] for r in self.runs()}, f"number={self._newest()}"
        old = [f"{self.path}/runs/{d}" for d in list_dirs(self.spark, f"{self.path}/runs") if d not in live]
        old += [f"{self.path}/manifests/{d}" for d in list_dirs(self.spark, f"{self.path}/manifests") if d != newest]
        for name in old:
            target = jvm.org.apache.hadoop.fs.Path(name)
            target.getFileSystem(conf).delete(target, True)
        return len(old)
