import pytest
from pyspark.sql import functions as F

from clickloom.session import scratch_path
from clickloom.sources.buckets import BucketStore
from clickloom.sources import logs, params, store, text

LINES = [
    (0, "-1 3:1 11:1 14:1"),
    (1, "+1  5:1 7:0 14:1 "),
    (2, "junk 1:1"),
    (3, "+1 200:1 :1"),
]


def lines(spark):
    return spark.createDataFrame(LINES, "row_id long, line string")


def test_labeled_lines(spark, rows):
    parsed = text.parse_labeled_lines(lines(spark), max_index=123)
    assert rows(parsed, "row_id", "label", "feature", "value") == sorted(
        [(0, -1.0, f, 1.0) for f in ("3", "11", "14")] + [(1, 1.0, f, 1.0) for f in ("5", "7", "14")], key=str
    )
    assert {r["label"] for r in text.parse_labeled_lines(lines(spark), mode="log").collect()} == {0.0, 1.0}
    assert rows(text.line_errors(lines(spark)), "row_id", "error") == [(2, "label"), (3, "token")]
    with pytest.raises(ValueError):
        text.parse_labeled_lines(lines(spark), mode="other")


def test_entity_token_and_feature_list(spark, rows):
    df = spark.createDataFrame([(0, "+1 feat_id:9 pos_1:1 age_2:1"), (1, "-1 pos_0:1")], "row_id long, line string")
    known = spark.createDataFrame([("pos_1",), ("pos_0",)], "feature string")
    got = text.parse_labeled_lines(df, entity_token="feat_id", feature_index=known)
    assert rows(got, "row_id", "entity_id", "feature") == [(0, "9", "pos_1"), (1, "0", "pos_0")]


def test_text_files_round_trip(spark, rows):
    path = scratch_path(spark, "lines")
    examples = text.parse_labeled_lines(lines(spark))
    text.write_lines(examples, path)
    back = text.read_examples(spark, path)
    assert rows(back, "label", "feature") == rows(examples, "label", "feature")
    assert back.select("row_id").distinct().count() == 3


def test_click_csv(spark):
    path = scratch_path(spark, "clicks")
    cats = ",".join(f"c{k}" for k in range(9))
    spark.createDataFrame([(f"77,1,a,b,c,{cats},0,1,2,3,4,5,6,-1",)], "value string").write.text(path)
    row = logs.read_click_csv(spark, path).first()
    assert (row["id"], row["click"], row["cat_0"], row["cat_8"]) == ("77", 1, "c0", "c8")
    assert (row["num_0"], row["num_7"]) == ("0", "-1")


def test_json_logs_are_read_by_name(spark):
    path = scratch_path(spark, "json")
    spark.createDataFrame([('{"os": 2, "user_id": "u", "gender": 1}',)], "value string").write.text(path)
    row = logs.read_json_log(spark, path, logs.USER_INFO_SCHEMA).first()
    assert (row["user_id"], row["gender"], row["os"], row["age_group"]) == ("u", 1, 2, None)


def test_parameters_round_trip(spark, rows):
    weights = spark.createDataFrame([("__bias__", 0.5), ("a", 1.0), ("b", -2.0)], "feature string, w double")
    factors = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.2), ("b", 0, 0.3), ("b", 1, 0.4)], "feature string, k int, v double")
    index = spark.createDataFrame([("a", 0), ("b", 1)], "feature string, idx long")
    path = scratch_path(spark, "params")
    params.save_params(weights, factors, path)
    w, f = params.load_params(spark, path)
    assert rows(w) == rows(weights) and rows(f) == rows(factors)
    params.save_params_text(weights, factors, index, f"{path}/text", 2)
    w, f = params.load_params_text(spark, f"{path}/text", 2, index)
    assert rows(w) == rows(weights) and rows(f) == rows(factors)
    w2 = {r["value"] for r in spark.read.text(f"{path}/text/w2").collect()}
    assert w2 == {"0:0.1", "1:0.2", "2:0.3", "3:0.4"}


RECORD = "key string, field string, value string, version long"


def test_upsert_keeps_other_fields(spark, rows):
    old = spark.createDataFrame([("k", "a", "1", 1), ("k", "b", "2", 1)], RECORD)
    new = spark.createDataFrame([("k", "b", "9", 2), ("m", "a", "3", 2)], RECORD)
    assert rows(store.upsert_records(old, new), "key", "field", "value") == [("k", "a", "1"), ("k", "b", "9"), ("m", "a", "3")]


def test_record_store_replay_and_missing_key(spark, rows):
    kv = store.RecordStore(spark, scratch_path(spark, "kv"))
    with pytest.raises(ValueError):
        kv.read()
    batch = spark.createDataFrame([("k", "a", "1", 1)], RECORD)
    assert kv.upsert(batch, "1") and not kv.upsert(batch.withColumn("value", F.lit("other")), "1")
    assert kv.upsert(spark.createDataFrame([("k", "a", "5", 2)], RECORD), "2")
    keys = spark.createDataFrame([("k",), ("none",)], "key string")
    assert rows(kv.lookup(keys), "key", "value", "found") == [("k", "5", True), ("none", None, False)]
    assert rows(kv.compact_to(scratch_path(spark, "kv")).read(), "key", "value") == [("k", "5")]


def test_keys_are_split_into_chunks(spark):
    data = [("hot", f"f{i}", str(i), 1) for i in range(100)] + [("cold", "f", "1", 1)]
    maps = store.records_to_maps(spark.createDataFrame(data, RECORD), chunks=4).collect()
    hot = [m for m in maps if m["key"] == "hot"]
    assert sorted(m["chunk"] for m in hot) == [0, 1, 2, 3] and sum(len(m["fields"]) for m in hot) == 100
    assert len([m for m in maps if m["key"] == "cold"]) == 1


def test_bucket_store_merges_runs(spark, rows):
    kv = BucketStore(spark, scratch_path(spark, "buckets"), buckets=4, fan=2)
    keys = spark.createDataFrame([("k1",), ("none",), (None,), ("k1",)], "key string")
    assert kv.read().count() == 0 and rows(kv.lookup(keys), "key", "found") == [("k1", False), ("k1", False), ("none", False), (None, False)]
    for batch in range(9):
        data = [(f"k{i}", f"f{batch % 3}", f"{batch}", batch) for i in range(6)]
        assert kv.upsert(spark.createDataFrame(data, RECORD), str(batch))
        assert not kv.upsert(spark.createDataFrame(data[:1], RECORD), str(batch))
    assert [level for _, level, _ in kv.runs()] == [3, 0]  # 8 + 1 batches
    assert sorted(b for _, _, held in kv.runs() for b in held) == [str(b) for b in range(9)]
    want = [(f"k{i}", f"f{f}", f"{6 + f}") for i in range(6) for f in range(3)]
    assert rows(kv.read(), "key", "field", "value") == sorted(want)
    found = kv.lookup(keys)
    assert rows(found, "key", "field", "value", "found")[:3] == sorted([("k1", f"f{f}", f"{6 + f}", True) for f in range(3)] * 2)[:3]
    assert found.count() == 8
    assert kv.vacuum() > 0 and kv.vacuum() == 0 and kv.read().count() == 18


def test_bucket_lookup_reads_one_bucket_and_few_runs(spark):
    kv = BucketStore(spark, scratch_path(spark, "buckets"), buckets=8, fan=3)
    for batch in range(14):
        kv.upsert(spark.createDataFrame([(f"k{i}", "f", str(batch), batch) for i in range(40)], RECORD), str(batch))
    assert len(kv.runs()) <= 2 * 3  # fewer than fan runs on each of log(14) levels
    found = kv.lookup(spark.createDataFrame([("k7",)], "key string"))
    assert [(r["field"], r["value"]) for r in found.collect()] == [("f", "13")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "In(key" in plan.replace("EqualTo(key", "In(key")
    read = kv._open([r[0] for r in kv.runs()]).filter("key = 'k7'").select(F.input_file_name().alias("f"), "bucket").distinct()
    assert read.select("bucket").distinct().count() == 1


def test_bucket_store_ignores_what_was_not_committed(spark):
    kv = BucketStore(spark, scratch_path(spark, "buckets"), buckets=2)
    kv.upsert(spark.createDataFrame([("k", "f", "1", 1)], RECORD), "1")
    kv._write(spark.createDataFrame([("k", "f", "2", 2)], RECORD))  # a writer that died before its manifest
    assert [r["value"] for r in kv.read().collect()] == ["1"]
    assert kv.upsert(spark.createDataFrame([], RECORD), "2") and [r["value"] for r in kv.read().collect()] == ["1"]
    assert kv.upsert(spark.createDataFrame([("k", "f", "3", 3)], RECORD), "3")
    assert [r["value"] for r in kv.read().collect()] == ["3"] and kv.vacuum() == 3
    with pytest.raises(ValueError):
        BucketStore(spark, "x", fan=1)


def test_latest_model_is_per_entity(spark, rows):
    versions = store.ModelStore(spark, scratch_path(spark, "models"))
    schema = "model_key string, feature string, w double"
    versions.publish(spark.createDataFrame([("e", "x", 0.1)], schema), 1)
    versions.publish(spark.createDataFrame([("f", "x", 0.2)], schema), 2)
    assert versions.publish(spark.createDataFrame([("e", "x", 0.3)], schema), 3)
    assert not versions.publish(spark.createDataFrame([("e", "x", 9.9)], schema), 3)
    assert rows(versions.latest(), "model_key", "w", "version") == [("e", 0.3, 3), ("f", 0.2, 2)]
    assert versions.versions() == [1, 2, 3]


def test_row_ids_do_not_depend_on_splits(spark, monkeypatch):
    path = scratch_path(spark, "lines")
    lines = ["+1 a:1"] * 700 + [f"-1 b{i}:1" for i in range(300)] + [""] * 3
    spark.createDataFrame([(x,) for x in lines], "value string").repartition(5).write.text(path)
    monkeypatch.setattr(text, "_EACH", 64)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    read = lambda: sorted(map(tuple, text.read_lines(spark, path).collect()))
    one = read()
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
        many = read()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert one == many and len({i for i, _ in one}) == len(lines) and sorted(x for _, x in one) == sorted(lines)
