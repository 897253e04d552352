"""End-to-end jobs: read tables or logs, compute, and write records or model versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickloom.operators import features, fm, linear, metrics, mixed, online, profile, rank, similarity
from clickloom.session import cut_lineage
from clickloom.sources import logs, params
from clickloom.sources.store import ModelStore, RecordStore, as_records


def enable_frequency_job(shows: DataFrame, store: RecordStore, version: int) -> bool:
    """Ad shows ``(app_id, broadcaster_id, advertisement_id)`` to one record per user with all its counts."""
    records = features.frequency_records(
        shows, ["app_id", "broadcaster_id"], "advertisement_id", "BROADCASTER_ENABLE_FREQUENCY", version
    )
    return store.upsert(records, str(version))


def similarity_job(profiles: DataFrame, path: str, min_shared: int) -> tuple[DataFrame, DataFrame]:
    """All profiles that share ``min_shared`` attributes (1: any), both directions, and the users of each profile, as two tables.

    Returns ``(pairs, members)``; :func:`similarity.similar_users` joins them for given users.
    """
    spark = profiles.sparkSession
    members = profile.profile_patterns(profiles)
    members.write.mode("overwrite").parquet(f"{path}/members")
    members = spark.read.parquet(f"{path}/members")
    table = cut_lineage(similarity.pattern_table(members))
    pairs = similarity.both_directions(similarity.similar_profiles(table, min_shared=min_shared))
    pairs.write.mode("overwrite").parquet(f"{path}/pairs")
    return spark.read.parquet(f"{path}/pairs"), members


def neighbours_job(profiles: DataFrame, store: RecordStore, version: int, k: int = 20) -> bool:
    """The ``k`` most similar users of every user as records ``user -> {neighbour: shared attributes}``."""
    near = similarity.top_neighbours(profile.profile_patterns(profiles), k)
    key = F.concat(F.lit("USER_SIMILARITY:"), F.col("user_id").cast("string"))
    return store.upsert(as_records(near, key, F.col("neighbour"), F.col("shared"), F.lit(version)), str(version))


def training_job(
    spark: SparkSession, impressions: str, clicks: str, users: str, store: ModelStore, version: int, train: float = 0.8, **options
) -> list[dict]:
    """Three JSON logs to a published mixed model; returns the validation metrics per iteration."""
    rows = features.training_set(*logs.read_logs(spark, impressions, clicks, users), train=train)
    rows = cut_lineage(rows)
    history: list[dict] = []
    model = mixed.fit_mixed(
        rows.filter("split = 'train'").drop("split"),
        validate=rows.filter("split = 'validate'").drop("split"),
        history=history,
        **options,
    )
    store.publish(model, version)
    return history


def ranking_job(requests: DataFrame, users: DataFrame, store: ModelStore) -> DataFrame:
    """Requests ranked with the newest published model of each candidate."""
    return rank.rank_candidates(requests, rank.user_features(users), store.latest())


def linear_job(train: DataFrame, validate: DataFrame, method: str = "lbfgs", loss: str = "exp", **options) -> tuple[DataFrame, DataFrame]:
    """Train a linear model; returns the weights and one row ``(accuracy, loss, auc)`` on ``validate``."""
    weights = linear.fit_linear(train, method, loss=loss, **options)
    return weights, metrics.evaluate(linear.score(validate, weights), loss)


def fm_job(train: DataFrame, validate: DataFrame, method: str = "sgd", n_factors: int = 4, loss: str = "exp", **options) -> tuple[DataFrame, DataFrame]:
    """Train a factorization machine; returns the model and one metrics row on ``validate``."""
    model = fm.fit_fm(train, method, n_factors=n_factors, loss=loss, **options)
    return model, metrics.evaluate(fm.predict(validate, model, n_factors), loss)


def continue_online(
    spark: SparkSession,
    source: str,
    target: str,
    examples: DataFrame,
    batch_col: str,
    rates: dict[str, online.Rates],
    n_factors: int,
    algorithm: str = "ftrl",
    loss: str = "exp",
) -> DataFrame:
    """Load an offline factorization machine, update it batch by batch, save it in the same format.

    Returns the prequential metrics.
    """
    model = fm.join_parts(*params.load_params(spark, source), n_factors)
    state, scored = online.train_batches(
        online.state_from_fm(model, rates), examples, batch_col, rates, algorithm, loss, n_factors
    )
    params.save_params(*fm.split_parts(online.fm_of(state, n_factors)), target)
    return metrics.prequential(scored, loss)
