from pyspark.sql import functions as F

from clickloom.operators import features, profile, sequence
from clickloom.operators.ordering import dense_index, running_sums
from clickloom.sources.store import records_to_maps


def test_frequency_map_keeps_every_item(spark):
    shows = spark.createDataFrame([("u", "a"), ("u", "a"), ("u", "b"), ("v", "a")], "user string, ad string")
    maps = records_to_maps(features.frequency_records(shows, ["user"], "ad", "F", 1)).collect()
    assert {m["key"]: m["fields"] for m in maps} == {"F:u": {"a": "2", "b": "1"}, "F:v": {"a": "1"}}


def test_keys_that_join_to_one_text_stay_apart(spark):
    shows = spark.createDataFrame([("a_b", "c", "x"), ("a", "b_c", "x")], "app string, who string, ad string")
    counts = features.frequency(shows, ["app", "who"], "ad")
    assert [r["count"] for r in counts.collect()] == [1, 1]


def test_dense_index_and_running_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), F.lit(2).alias("n"))
    indexed = dense_index(df, ["k"], partitions=7).orderBy("k").collect()
    assert [r["idx"] for r in indexed] == list(range(1000))
    sums = running_sums(df, ["k"], {"before": "n"}, partitions=7).orderBy("k").collect()
    assert [r["before"] for r in sums] == [2 * i for i in range(1000)]


def test_unseen_categories_have_their_own_code(spark, rows):
    train = spark.createDataFrame([("a", "x"), ("b", "x")], "c1 string, c2 string")
    new = spark.createDataFrame([("a", "x"), ("z", None)], "c1 string, c2 string")
    index = features.category_index(train, ["c1", "c2"])
    assert rows(index, "position", "value", "idx") == [(0, "a", 0), (0, "b", 1), (1, "x", 2)]
    assert rows(features.code_categories(new, ["c1", "c2"], index), "c1_idx", "c2_idx") == [(-1, -1), (0, 2)]


def test_clean_number(spark):
    df = spark.createDataFrame([("35",), ("-1",), ("x",)], "t string").select(features.clean_number(F.col("t")))
    assert [r[0] for r in df.collect()][:2] == [35.0, 0.0]


def logs(spark):
    impressions = spark.createDataFrame(
        [("s1", "u", 1, "a,b,c"), ("s2", "u", 1, "a"), ("s3", "u", 1, "b,b,b"), ("s4", "nobody", 1, "a,b")],
        "list_session_id string, user_id string, timestamp long, feat_id_list string",
    )
    clicks = spark.createDataFrame(
        [
            ("s1", "u", 5, "b", 1),
            ("s1", "u", 6, "c", 0),
            ("s1", "u", 7, "zzz", 0),
            ("s2", "u", 5, "a", 0),
            ("s3", "u", 5, "b", 0),
            ("s4", "nobody", 5, "a", 0),
        ],
        "list_session_id string, user_id string, timestamp long, feat_id string, position long",
    )
    users = spark.createDataFrame(
        [("u", 2, 1, 0, 3, 1)],
        "user_id string, age_group long, fans_count_level long, gender long, network_type long, os long",
    )
    return impressions, clicks, users


def test_training_set_rules(spark):
    impressions, clicks, users = logs(spark)
    joined = features.with_user_info(features.impression_clicks(impressions, clicks), users)
    labeled = features.labeled_clicks(features.clicked_in_list(joined)).collect()
    positives = {(r["list_session_id"], r["entity_id"], r["position"]) for r in labeled if r["label"] > 0}
    # not in the list: dropped; wrong position: corrected; no profile: dropped by the inner join
    assert positives == {("s1", "b", 1), ("s1", "c", 2), ("s2", "a", 0), ("s3", "b", 0)}
    negatives = [r for r in labeled if r["label"] < 0]
    # one-element lists and lists of copies have no negative
    assert len(negatives) == 2 and all(r["list_session_id"] == "s1" for r in negatives)
    chosen = {r["click_key"]: r["entity_id"] for r in labeled if r["label"] > 0}
    assert all(r["entity_id"] != chosen[r["click_key"]] for r in negatives)

    rows = features.training_set(impressions, clicks, users)
    per_row = rows.groupBy("row_id").agg(F.count("*").alias("n"), F.count_distinct("split").alias("s")).collect()
    assert all((r["n"], r["s"]) == (6, 1) for r in per_row)
    assert {r["feature"] for r in rows.collect()} >= {"age_2", "fans_1", "gender_0", "networkType_3", "os_1", "pos_1"}


def test_split_share(spark):
    split = features.hash_split(spark.range(5000), [F.col("id")], 0.8)
    share = split.filter("split = 'train'").count() / 5000
    assert abs(share - 0.8) < 0.03


def test_densest_feature(spark):
    df = spark.createDataFrame([("b",), ("b",), ("a",), ("a",), ("c",)], "feature string")
    assert tuple(features.densest_feature(df).first()) == ("a", 2, "c")


PROFILE = "user_id long, age_group int, gender int, fans_count_level int, os int, network_type int, enable_times long, post_times long, enable_rate double"


def test_profile_buckets_at_their_bounds(spark):
    cases = {
        "enable_times": [(0, 0), (1, 1), (99, 1), (100, 2), (199, 2), (200, 3), (499, 3), (500, 4), (999, 4), (1000, 5)],
        "post_times": [(0, 0), (199, 1), (200, 2), (499, 2), (500, 3), (999, 3), (1000, 4), (1999, 4), (2000, 5)],
        "enable_rate": [(0.0, 0), (9.9, 1), (10.0, 2), (19.9, 2), (20.0, 3), (49.9, 3), (50.0, 4), (99.9, 4), (100.0, 5)],
    }
    for name, pairs in cases.items():
        df = spark.createDataFrame([(p[0],) for p in pairs], f"{name} {'double' if name == 'enable_rate' else 'long'}")
        got = [r[0] for r in df.select(profile.bucket_level(F.col(name), profile.BOUNDS[name])).collect()]
        assert got == [p[1] for p in pairs]


def test_profile_slots_are_disjoint(spark):
    rows = [(1, 0, 0, 6, 0, 0, 0, 0, 0.0), (2, 9, 7, None, 2, 1, 5, 5, 5.0)]
    df = spark.createDataFrame(rows, PROFILE)
    slots = profile.profile_slots(df).groupBy("user_id").agg(F.count_distinct("slot").alias("n")).collect()
    assert [r["n"] for r in slots] == [8, 8]
    assert profile.profile_slots(df).agg(F.max("slot")).first()[0] < sum(profile.cardinalities())
    # the old layout puts "no enable times" and fans level 6 on one slot
    legacy = profile.profile_slots(df.filter("user_id = 1"), legacy_slots=True)
    assert sorted(r["slot"] for r in legacy.collect()) == [1, 4, 10, 13, 21, 27, 33]


def events(spark):
    data = [("u", 1, "a", 1.0), ("u", 2, "b", 2.0), ("u", 3, "c", 3.0), ("v", 1, "b", 5.0), ("v", 2, "c", 5.0), ("w", 1, "a", 1.0)]
    return spark.createDataFrame(data, "user string, ts long, step string, value double")


def test_sequence_questions(spark, rows):
    placed = sequence.positions(events(spark), "user", ["ts"])
    assert rows(sequence.path_contains(placed, "user", "step", ["b", "c"])) == [("u", True), ("v", True), ("w", False)]
    # a run may not cross from one user to the next
    assert rows(sequence.path_contains(placed, "user", "step", ["c", "b"])) == [("u", False), ("v", False), ("w", False)]
    assert rows(sequence.path_contains(placed, "user", "step", [])) == [("u", True), ("v", True), ("w", True)]
    assert rows(sequence.first_match(placed, "user", F.col("value") > 1.5)) == [("u", 1), ("v", 0), ("w", -1)]
    assert rows(sequence.is_increasing(placed, "user", "value")) == [("u", True), ("v", False), ("w", True)]
    assert rows(sequence.is_increasing(placed, "user", "value", strict=False)) == [("u", True), ("v", True), ("w", True)]


def test_sequence_fixtures(spark, rows):
    numbers = [(v,) for v in (20.0, 30.0, 40.0, 50.0, 70.0, 80.0)]
    df = spark.createDataFrame([("u", i, v[0]) for i, v in enumerate(numbers)], "user string, ts long, value double")
    placed = sequence.positions(df, "user", ["ts"])
    assert rows(sequence.first_match(placed, "user", F.col("value") == 10)) == [("u", -1)]
    assert rows(sequence.is_increasing(placed, "user", "value")) == [("u", True)]
    path = spark.createDataFrame([("u", i, str(i)) for i in range(1, 6)], "user string, ts long, step string")
    assert rows(sequence.path_contains(sequence.positions(path, "user", ["ts"]), "user", "step", ["5", "6"])) == [("u", False)]


def test_text_keys_of_different_parts_stay_apart(spark):
    df = spark.createDataFrame([("a_b", "c"), ("a", "b_c"), ("a", None), ("a", ""), ("a\\", "b"), ("a", "\\b")], "x string, y string")
    assert df.select(features.composite_key("x", "y").alias("k")).distinct().count() == 6


def test_row_ids_of_odd_clicks_differ(spark):
    rows = [("s", "u|1", 5, "a", 0), ("s|u", "1", 5, "a", 0), ("s", "u", None, "a", 0), ("s", None, 5, "a", 0), ("s", "u\\", 5, "a", 0), (None, "s", 5, "a", 0)]
    clicked = spark.createDataFrame(rows, "list_session_id string, user_id string, timestamp bigint, feat_id string, position bigint")
    clicked = clicked.selectExpr("*", "array('a', 'b|1', 'b') AS candidates", *[f"1 AS {c}" for c in features.USER_FEATURES.values()])
    out = features.labeled_clicks(clicked, negatives=2).collect()
    assert len({r["row_id"] for r in out}) == len(out) == 18 and len({r["click_key"] for r in out}) == 6
