import re

import pytest
from pyspark.sql import functions as F

from clickloom.operators import graph, online, rank, trees
from clickloom.operators.online import Rates
from clickloom.plans.ctr import ctr_report
from clickloom.session import scratch_path
from clickloom.sources.store import RecordStore
from clickloom.streaming import features as stream_features
from clickloom.streaming.learner import StateTable, learner
from clickloom.streaming.source import file_stream, run_available

REQUEST = "user_id string, list_session_id string, timestamp long, feat_list string"
WEIGHTS = "model_key string, feature string, w double"


def users(spark):
    return spark.createDataFrame([("u", "age_1"), ("u", "os_2")], "user_id string, feature string")


def ranked(spark, lists, weights):
    requests = spark.createDataFrame([(u, f"s{i}", 1, c) for i, (u, c) in enumerate(lists)], REQUEST)
    model = spark.createDataFrame(weights, WEIGHTS)
    out = rank.rank_candidates(requests, users(spark), model).orderBy("list_session_id").collect()
    return [(r["ranked_list"], r["ranked"]) for r in out]


def test_rank_rules(spark):
    weights = [("", "age_1", 0.1), ("a", "age_1", 1.0), ("b", "age_1", 1.5), ("b", "os_2", 0.5), ("c", "age_1", 2.0)]
    lists = [("u", "a,b,c"), ("u", "x,a"), ("u", "a,b,a"), ("stranger", "a,b")]
    assert ranked(spark, lists, weights) == [("b,c,a", True), ("a,x", True), ("b,a", True), ("a,b", False)]


def test_without_a_fixed_model_lists_stay(spark):
    assert ranked(spark, [("u", "a,b")], [("b", "age_1", 1.0)]) == [("a,b", False)]


def test_requests_of_one_key_stay_apart(spark, rows):
    weights = [("", "age_1", 0.0), ("1", "age_1", 1.0), ("2", "age_1", 2.0), ("3", "age_1", 3.0)]
    lists = [("u", "s", 1, "1,2"), ("u", "s", 1, "2,3"), ("u", "s", 1, "1,2"), ("u", None, 1, "1,3"), ("u", "s", None, "1,3"), ("u", "s", 1, None), (None, "s", 1, "1,2")]
    requests, model = spark.createDataFrame(lists, REQUEST), spark.createDataFrame(weights, WEIGHTS)
    got = rows(rank.rank_candidates(requests, users(spark), model), "user_id", "list_session_id", "timestamp", "ranked_list", "ranked")
    want = [("u", "s", 1, "2,1", True), ("u", "s", 1, "3,2", True), ("u", "s", 1, "2,1", True), ("u", None, 1, "3,1", True), ("u", "s", None, "3,1", True), ("u", "s", 1, None, False), (None, "s", 1, "1,2", False)]
    assert got == sorted(want, key=str)
    scored = rank.candidate_scores(requests, users(spark), model).filter("timestamp = 1 AND list_session_id = 's'")
    sigmoid = lambda x: pytest.approx(1 / (1 + 2.718281828459045**-x))
    assert rows(scored, "candidate", "probability") == [("1", sigmoid(1)), ("2", sigmoid(2)), ("2", sigmoid(2)), ("3", sigmoid(3))]


def test_pagerank_fixture(spark):
    links = {"0": "123", "1": "24", "2": "35", "3": "28", "4": "356", "5": "0", "6": "23", "7": "8", "8": "32", "9": "3467"}
    edges = spark.createDataFrame([(s, d) for s, ds in links.items() for d in ds], "src string, dst string")
    got = {r["node"]: r["rank"] for r in graph.pagerank(edges, 4).collect()}
    ranks = {n: 1.0 for n in links}
    for _ in range(4):
        nxt = {n: 0.15 for n in links}
        for s, ds in links.items():
            for d in ds:
                nxt[d] += 0.85 * ranks[s] / len(ds)
        ranks = nxt
    assert got == {n: pytest.approx(v) for n, v in ranks.items()}
    assert got["9"] == pytest.approx(0.15)
    salted = {r["node"]: r["rank"] for r in graph.pagerank(edges, 4, broadcast_rows=2, hub_links=2).collect()}
    assert salted == {n: pytest.approx(v) for n, v in ranks.items()}


def test_pagerank_steps_without_hubs_move_ranks_only(spark, monkeypatch):
    """Ranks beyond the broadcast bound meet edges that stay where they are; only edges of hubs are salted."""
    plans, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: (plans.append(df._jdf.queryExecution().toString()), cut(df))[1])
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("d", "c")], "src string, dst string")
    got = {r["node"]: r["rank"] for r in graph.pagerank(edges, 1, broadcast_rows=2).collect()}
    assert got == {"a": pytest.approx(0.15), "b": pytest.approx(0.575), "c": pytest.approx(2.275), "d": pytest.approx(0.15)}
    assert not any("_salt" in p for p in plans)
    plans.clear()
    assert {r["node"]: r["rank"] for r in graph.pagerank(edges, 1, broadcast_rows=2, hub_links=1).collect()} == {k: pytest.approx(v) for k, v in got.items()}
    assert any("_salt" in p for p in plans)


def example_files(spark, batches):
    folder = scratch_path(spark, "examples")
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "row_id long, label double, feature string, value double")
        df.coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_streamed_learning_is_replay_safe(spark):
    rates = {"linear": Rates(alpha=0.1, l1=0.01)}
    folder = example_files(spark, [[(0, 1.0, "a", 1.0), (0, 1.0, "b", 1.0)], [(1, -1.0, "b", 1.0)], [(2, 1.0, "a", 1.0)]])
    path = scratch_path(spark, "online")
    table = StateTable(spark, f"{path}/state", snapshot_every=2)
    table.initialise(spark.createDataFrame([], "part string, feature string, k int, w double, z double, n double, s double, step long"))
    stream = file_stream(spark, folder, "*.parquet", files_per_batch=1)
    step = learner(table, rates, metrics_path=f"{path}/metrics")
    run_available(stream.writeStream.foreachBatch(step), f"{path}/checkpoint")
    state = {r["feature"]: (r["z"], r["n"], r["step"]) for r in table.latest().collect()}
    assert set(state) == {"a", "b"} and table._committed("snapshot", 99)[-1] == 1
    assert spark.read.parquet(f"{path}/metrics").count() == 3
    # the same batch again changes nothing, and neither does an empty one
    again = spark.createDataFrame([(2, 1.0, "a", 1.0)], "row_id long, label double, feature string, value double")
    step(again, 2)
    step(again.limit(0), 3)
    assert {r["feature"]: (r["z"], r["n"], r["step"]) for r in table.latest().collect()} == state
    # batches run in file order of the source; whatever it was, the state equals the batch trainer's
    order = spark.read.parquet(folder).select("*", F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("p"))
    files = [r["p"] for r in order.select("t", "p").distinct().orderBy("t", "p").collect()]
    numbered = order.withColumn("half", F.array_position(F.array(*[F.lit(f) for f in files]), F.col("p")))
    empty = spark.createDataFrame([], table.latest().schema)
    final, _ = online.train_batches(empty, numbered.drop("t", "p"), "half", rates)
    assert {r["feature"]: (r["z"], r["n"], r["step"]) for r in final.collect()} == {k: pytest.approx(v) for k, v in state.items()}


def test_streamed_frequency_over_several_batches(spark, rows):
    folder = scratch_path(spark, "shows")
    for batch in ([("u", "a"), ("u", "b")], [("u", "a"), ("v", "a")]):
        spark.createDataFrame(batch, "user string, ad string").coalesce(1).write.mode("append").parquet(folder)
    path = scratch_path(spark, "freq")
    records = RecordStore(spark, f"{path}/records")
    counts = stream_features.running_frequency(file_stream(spark, folder, "*.parquet", 1), ["user"], "ad")
    sink = stream_features.frequency_sink(records, ["user"], "ad", "F")
    run_available(counts.writeStream.outputMode("update").foreachBatch(sink), f"{path}/checkpoint")
    assert rows(records.read(), "key", "field", "value") == [("F:u", "a", "2"), ("F:u", "b", "1"), ("F:v", "a", "1")]


def test_gbt_report_with_a_saved_model(spark):
    rows = [(i, int(i % 3 == 0), "x" if i % 3 == 0 else "y", str(i % 5 - 1)) for i in range(200)]
    log = spark.createDataFrame(rows, "id long, click int, kind string, n string")
    path = scratch_path(spark, "gbt")
    report = ctr_report(log, "click", ["kind"], ["n"], iterations=2, depth=2, model_path=path).first()
    assert report["accuracy"] == 1.0 and report["tp"] + report["tn"] > 20


def test_gbt_does_not_depend_on_the_layout(spark):
    x = F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double")
    label = (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_003)) * F.lit(0.7) > x).cast("double")
    rows = spark.range(30_000).select("id", x.alias("x"), (F.col("id") % 7).cast("double").alias("k"), label.alias("click"))
    fits = []
    for dealt in (rows.coalesce(1), rows.repartition(5, "x"), rows.unionByName(rows)):  # the last: every row twice is the same model
        model = trees.fit_gbt(dealt, ["x", "k"], "click", iterations=2, depth=2)
        fits.append([re.findall(r"feature \d+ [<>]=? [\d.]+", t.toDebugString) for t in model.stages[-1].trees])
        hits = model.transform(rows).filter("prediction = click").count()
        assert hits > 20_000
    assert fits[0] == fits[1] == fits[2] and any(fits[0])
    counts = model.stages[0].transform(rows).groupBy("x_bucket").count().collect()
    assert len(counts) == 32 and all(930 < r["count"] < 945 for r in counts)


def test_ranking_joins_candidates_not_their_features(spark):
    requests = spark.createDataFrame(
        [("u", f"s{i}", i, "a,b,c" if i % 2 else "c,a,b") for i in range(20)] + [(None, "s", 1, "b,a"), ("u", "t", 1, None)],
        "user_id string, list_session_id string, timestamp long, feat_list string",
    )
    features = spark.createDataFrame([("u", f"f{i}") for i in range(30)], "user_id string, feature string")
    model = spark.createDataFrame(
        [("", "f0", 0.5), *[("b", f"f{i}", 0.1) for i in range(0, 40, 2)], ("a", "f1", 0.2), ("a", "other", 9.0)], "model_key string, feature string, w double"
    )
    ranked = rank.rank_candidates(requests, features, model)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "posexplode(" in plan and "Generate explode(" not in plan
    got = {(r["user_id"], r["list_session_id"]): (r["ranked_list"], r["ranked"]) for r in ranked.collect()}
    assert len(got) == 22 and all(got["u", f"s{i}"] == ("b,a,c", True) for i in range(20))
    assert got[None, "s"] == ("b,a", False) and got["u", "t"] == (None, False)
