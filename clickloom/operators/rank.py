"""Ranking of candidate lists with the published mixed model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clickloom.functions.expr import sigmoid
from clickloom.operators.features import USER_FEATURES, name_value
from clickloom.operators.mixed import FIXED

REQUEST = ["user_id", "list_session_id", "timestamp"]
#: What tells requests apart: one user, session and time can have several lists. The digest keeps long lists out of shuffles.
DISTINCT = [*REQUEST, "list_key"]
LIST = ["user_id", "list_key"]


def user_features(users: DataFrame) -> DataFrame:
    """Profile columns as ``(user_id, feature)`` with the names used in training."""
    return name_value(users, ["user_id"], {n: F.col(c) for n, c in USER_FEATURES.items()})


def keyed(requests: DataFrame) -> DataFrame:
    return requests.select(*REQUEST, F.sha2("feat_list", 256).alias("list_key"), "feat_list")


def candidate_scores(requests: DataFrame, features: DataFrame, weights: DataFrame) -> DataFrame:
    """``(request..., list_key, pos, candidate, probability)``; one row per distinct candidate of a list.

    A request that is repeated with the same list is scored once; its fields may be null. Users without a profile have no rows. The fixed part is summed once per user; a candidate
    without a model of its own gets the fixed part only.
    """
    return _scored(keyed(requests).dropDuplicates(DISTINCT), DISTINCT, features, weights)


def _scored(lists: DataFrame, key: list[str], features: DataFrame, weights: DataFrame) -> DataFrame:
    """``(key..., pos, candidate, probability)`` of different lists ``(key..., feat_list)``, where ``user_id`` is in the key.

    The model of a candidate is one row, so a candidate of a list is one row in the join, however many features its user has.
    """
    fixed = weights.filter(F.col("model_key") == FIXED).select("feature", F.col("w").alias("wf"))
    per_user = (
        features.join(fixed, "feature", "left")
        .groupBy("user_id")
        .agg(F.sum(F.coalesce("wf", F.lit(0.0))).alias("fixed"), F.collect_set("feature").alias("features"))
    )
    listed = lists.join(per_user, "user_id").select(
        *key, "fixed", "features", F.posexplode(F.array_distinct(F.split("feat_list", ","))).alias("pos", "candidate")
    )
    used = features.select("feature").distinct()
    own = (
        weights.filter(F.col("model_key") != FIXED)
        .join(used, "feature", "left_semi")
        .groupBy(F.col("model_key").alias("candidate"))
        .agg(F.collect_list(F.struct("feature", "w")).alias("own"))
    )
    part = lambda total, c: total + F.when(F.array_contains("features", c["feature"]), F.coalesce(c["w"], F.lit(0.0))).otherwise(F.lit(0.0))
    total = F.col("fixed") + F.coalesce(F.aggregate("own", F.lit(0.0), part), F.lit(0.0))
    return listed.join(own, "candidate", "left").select(*key, "pos", "candidate", sigmoid(total).alias("probability"))


def rank_candidates(requests: DataFrame, features: DataFrame, weights: DataFrame) -> DataFrame:
    """``(request..., ranked_list, ranked)``: probability descending, then list position; one row per row of ``requests``.

    Without a fixed model, or for a user without a profile, the list comes back unchanged.
    """
    # Scores depend on the user and the list alone: a list is ranked once, however many sessions and times ask for it.
    asked = requests.select(*REQUEST, F.unhex(F.sha2("feat_list", 256)).alias("list_key"), "feat_list")
    lists = asked.select(*LIST, "feat_list").dropDuplicates(LIST)
    best = F.sort_array(F.collect_list(F.struct((-F.round("probability", 9)).alias("p"), "pos", "candidate")))
    ranked = (
        _scored(lists, LIST, features, weights)
        .groupBy(*LIST)
        .agg(F.concat_ws(",", F.transform(best, lambda c: c["candidate"])).alias("by_score"))
    )
    has_model = weights.filter(F.col("model_key") == FIXED).limit(1).agg(F.count("*") > 0).scalar()
    joined = asked.join(ranked, LIST, "left")
    joined = joined.withColumn("ranked", has_model & F.col("by_score").isNotNull())
    return joined.select(
        *REQUEST, F.when(F.col("ranked"), F.col("by_score")).otherwise(F.col("feat_list")).alias("ranked_list"), "ranked"
    )
