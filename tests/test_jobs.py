import json

import pytest
from pyspark.sql import functions as F

from clickloom.operators import fm, similarity
from clickloom.operators.online import Rates
from clickloom.plans import jobs
from clickloom.session import scratch_path
from clickloom.sources import params
from clickloom.sources.store import ModelStore, RecordStore
from tests.test_features import PROFILE
from tests.test_models import examples, make


def test_frequency_job(spark, rows):
    shows = spark.createDataFrame([("a", "b", "x"), ("a", "b", "x"), ("a", "b", "y")], "app_id string, broadcaster_id string, advertisement_id string")
    store = RecordStore(spark, scratch_path(spark, "job"))
    assert jobs.enable_frequency_job(shows, store, 1)
    key = "BROADCASTER_ENABLE_FREQUENCY:a_b"
    assert rows(store.read(), "key", "field", "value") == [(key, "x", "2"), (key, "y", "1")]


def test_similarity_jobs(spark, rows):
    people = [(1, 1, 0, 2, 1, 1, 50, 50, 5.0), (2, 1, 0, 2, 1, 1, 50, 50, 15.0), (3, 1, 0, 2, 1, 2, 150, 50, 5.0)]
    profiles = spark.createDataFrame(people, PROFILE)
    pairs, members = jobs.similarity_job(profiles, scratch_path(spark, "pairs"), min_shared=6)
    everyone = profiles.select("user_id")
    got = rows(similarity.similar_users(everyone, members, pairs))
    assert got == [(1, 2, 0.875), (1, 3, 0.75), (2, 1, 0.875), (3, 1, 0.75)]
    store = RecordStore(spark, scratch_path(spark, "near"))
    jobs.neighbours_job(profiles, store, 1, k=1)
    assert rows(store.read(), "key", "field", "value") == [
        ("USER_SIMILARITY:1", "2", "7"),
        ("USER_SIMILARITY:2", "1", "7"),
        ("USER_SIMILARITY:3", "1", "6"),
    ]


def write_json(spark, name, records):
    path = scratch_path(spark, name)
    spark.createDataFrame([(json.dumps(r),) for r in records], "value string").write.text(path)
    return path


def test_logs_to_published_model_to_ranking(spark):
    n = 60
    impressions = [{"list_session_id": f"s{i}", "user_id": f"u{i % 6}", "timestamp": i, "feat_id_list": "a,b,c"} for i in range(n)]
    # even users click a, odd users click c
    clicks = [
        {"list_session_id": f"s{i}", "user_id": f"u{i % 6}", "timestamp": i, "feat_id": "a" if i % 2 == 0 else "c", "position": 0 if i % 2 == 0 else 2}
        for i in range(n)
    ]
    users = [{"user_id": f"u{i}", "age_group": 1, "fans_count_level": 1, "gender": i % 2, "network_type": 1, "os": 1} for i in range(6)]
    paths = [write_json(spark, name, rows) for name, rows in (("imp", impressions), ("clk", clicks), ("usr", users))]
    store = ModelStore(spark, scratch_path(spark, "models"))
    history = jobs.training_job(spark, *paths, store, 1, iterations=2, lam=(0.01, 0.1), inner=4)
    assert len(history) == 2 and history[-1]["auc"] > 0.7
    requests = spark.createDataFrame(
        [("u0", "r0", 1, "b,c,a"), ("u1", "r1", 1, "a,b,c"), ("nobody", "r2", 1, "b,a")],
        "user_id string, list_session_id string, timestamp long, feat_list string",
    )
    from clickloom.sources.logs import USER_INFO_SCHEMA, read_json_log

    ranked = jobs.ranking_job(requests, read_json_log(spark, paths[2], USER_INFO_SCHEMA), store)
    got = {r["list_session_id"]: r["ranked_list"] for r in ranked.collect()}
    assert got["r0"].index("a") < got["r0"].index("c") and got["r1"].index("c") < got["r1"].index("a")
    assert got["r2"] == "b,a"


def test_linear_and_fm_jobs(spark):
    df = examples(spark, make(n=120))
    weights, report = jobs.linear_job(df, df, "lbfgs", lam=0.01)
    assert weights.count() == 5 and report.first()["auc"] > 0.6
    _, report = jobs.linear_job(df, df, "sgd", iterations=2)
    assert report.first()["accuracy"] > 0.5
    model, report = jobs.fm_job(df, df, "gradient", n_factors=2, iterations=2)
    assert model.count() == 6 and report.first()["loss"] < 0.8


@pytest.mark.parametrize("algorithm", ["ftrl", "tdap"])
def test_offline_to_online_and_back(spark, algorithm):
    df = examples(spark, make(n=40))
    source, target = scratch_path(spark, "offline"), scratch_path(spark, "online")
    params.save_params(*fm.split_parts(fm.initial_model(df, 2)), source)
    rates = {p: Rates(alpha=0.1, l1=0.001) for p in ("bias", "linear", "factor")}
    batched = df.withColumn("batch", (F.col("row_id") / 20).cast("int"))
    report = jobs.continue_online(spark, source, target, batched, "batch", rates, 2, algorithm)
    assert report.count() == 2
    weights, factors = params.load_params(spark, target)
    assert weights.count() == 6 and factors.count() == 10
    assert weights.filter("w is null or isnan(w)").isEmpty()
