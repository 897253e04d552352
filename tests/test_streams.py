"""Per-key learners and training rows on streams of several micro-batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clickloom.operators import online
from clickloom.operators.online import Rates
from clickloom.session import scratch_path
from clickloom.sources.buckets import BucketStore
from clickloom.streaming import features, keyed
from clickloom.streaming.source import run_available

RATES = Rates(alpha=0.5, beta=1.0, l1=0.1, l2=0.1)


def folder_of(spark, parts, schema):
    """One file per micro-batch, in order."""
    path = scratch_path(spark, "stream")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/source/part={i}")
    return path


def one_by_one(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/source")


def test_models_per_key_equal_the_batch_passes(spark):
    rnd = random.Random(1)
    schema = "row_id bigint, label double, who string, features array<string>, values array<double>"
    rows = [(i, rnd.choice([-1.0, 1.0]), rnd.choice(["a", "b", "c:d", None]), rnd.sample(["p", "q", "r", "s"], 2), [1.0, rnd.choice([0.5, 2.0])]) for i in range(90)]
    path = folder_of(spark, [rows[:40], rows[40:70], rows[70:]], schema)
    kv = BucketStore(spark, f"{path}/models", buckets=2, fan=2)
    changes = keyed.ftrl_by_key(one_by_one(spark, path, schema), "who", "row_id", RATES)
    run_available(changes.writeStream.outputMode("update").foreachBatch(keyed.model_sink(kv)), f"{path}/checkpoint")
    got = {(r["model_key"], r["feature"]): (r["z"], r["n"], r["w"], r["rows"]) for r in keyed.models(kv).filter("model_key <> 'null'").collect()}
    long = spark.createDataFrame(rows, schema).filter("who IS NOT NULL").select("row_id", "label", "who", F.inline(F.arrays_zip("features", "values"))).toDF("row_id", "label", "who", "feature", "value")
    want = {(r["model_key"], r["feature"]): (r["z"], r["n"], r["w"], r["rows"]) for r in online.ftrl_per_key(long, "who", "row_id", RATES).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v)
    assert len(kv.runs()) <= 2


def test_shards_of_a_key_are_averaged(spark):
    schema = "row_id bigint, label double, who string, features array<string>, values array<double>"
    rows = [(i, 1.0 if i % 3 else -1.0, "hot", ["p", "q"], [1.0, 1.0]) for i in range(60)]
    path = folder_of(spark, [rows[:30], rows[30:]], schema)
    kv = BucketStore(spark, f"{path}/models", buckets=2)
    changes = keyed.ftrl_by_key(one_by_one(spark, path, schema), "who", "row_id", RATES, shards=3)
    run_available(changes.writeStream.outputMode("update").foreachBatch(keyed.model_sink(kv)), f"{path}/checkpoint")
    models = keyed.models(kv)
    assert {r["shard"] for r in models.collect()} == {0, 1, 2}
    assert models.select("shard", "rows").distinct().agg(F.sum("rows")).first()[0] == 60
    assert online.average_keys(models).count() == 2


def test_idle_keys_are_forgotten(spark):
    schema = "row_id bigint, label double, who string, features array<string>, values array<double>, at timestamp"
    day = datetime(2024, 1, 1)
    rows = [(i, 1.0, who, ["p"], [1.0], day + timedelta(days=d)) for i, (who, d) in enumerate([("a", 0), ("b", 100), ("c", 100), ("a", 101)])]  # a is gone when c comes
    path = folder_of(spark, [[r] for r in rows], schema)
    kv = BucketStore(spark, f"{path}/models", buckets=2)
    timed = one_by_one(spark, path, schema).withWatermark("at", "1 day")
    changes = keyed.ftrl_by_key(timed, "who", "row_id", RATES, idle="30 days", time_col="at")
    run_available(changes.writeStream.outputMode("update").foreachBatch(keyed.model_sink(kv)), f"{path}/checkpoint")
    assert {(r["model_key"], r["rows"]) for r in keyed.models(kv).collect()} == {("a", 1), ("b", 1), ("c", 1)}
    with pytest.raises(ValueError):
        keyed.ftrl_by_key(timed, "who", "row_id", RATES, idle="1 day")


def test_training_rows_drop_repeats_and_release_negatives(spark):
    day = datetime(2024, 1, 1)
    at = lambda h: day + timedelta(hours=h)
    schema = "kind string, list string, id bigint, at timestamp"
    first = [("view", "l1", None, at(0)), ("view", "l1", None, at(0)), ("view", "l2", None, at(1)), ("click", "l1", 7, at(2)), ("click", "l1", 7, at(2))]
    second = [("click", "l1", 7, at(2)), ("view", "l2", None, at(1)), ("click", "l1", 8, at(3)), ("click", "l2", 9, at(30))]
    last = [("view", "l3", None, at(200)), ("click", "l3", 10, at(201)), ("view", "l4", None, at(202))]
    path = folder_of(spark, [first, second, last], schema)
    events = one_by_one(spark, path, schema)
    views = events.filter("kind = 'view'").select("list", F.col("at").alias("shown_at"))
    clicks = events.filter("kind = 'click'").select("list", F.col("id").alias("click_id"), F.col("at").alias("clicked_at"))
    rows = features.training_rows(views, clicks, ["list"], "click_id", within="24 hours", lateness="2 days")
    run_available(rows.writeStream.format("parquet").option("path", f"{path}/rows").outputMode("append"), f"{path}/checkpoint")
    got = sorted((r["list"], r["click_id"] or 0, r["label"]) for r in spark.read.parquet(f"{path}/rows").collect())
    # the click on l2 came too late; l4 may still be clicked
    assert got == [("l1", 7, 1.0), ("l1", 8, 1.0), ("l2", 0, 0.0), ("l3", 10, 1.0)]
