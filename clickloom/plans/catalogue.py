"""The query catalogue: every operator on the benchmark tables, whole tables throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickloom.functions.expr import pointwise_loss, sigmoid, tidy
from clickloom.functions.hashing import hash_weight
from clickloom.functions.quarantine import quarantine
from clickloom.operators import (
    dimsum,
    features,
    fm,
    graph,
    history,
    histtrees,
    linear,
    matrix,
    metrics,
    mixed,
    neighbours,
    online,
    profile,
    rank,
    sequence,
    similarity,
    trees,
)
from clickloom.operators.online import Rates
from clickloom.plans import standins as tables
from clickloom.session import cut_lineage, scratch_path
from clickloom.sources import store, text
from clickloom.sources.buckets import BucketStore
from clickloom.streaming import features as stream_features, keyed
from clickloom.streaming.learner import StateTable, learner
from clickloom.streaming.source import run_available, table_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

N_FACTORS = 2
LINEAR_RATES = {"linear": Rates(alpha=0.5, beta=1.0, l1=0.5, l2=0.1)}
TDAP_RATES = {"linear": Rates(alpha=0.5, beta=1.0, l1=0.5, l2=0.1, tau=1.5)}
FM_RATES = {
    "bias": Rates(alpha=0.3, beta=1.0, l1=0.0, l2=0.1),
    "linear": Rates(alpha=0.5, beta=1.0, l1=0.5, l2=0.1),
    "factor": Rates(alpha=0.2, beta=1.0, l1=0.1, l2=0.1),
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def start_weights(examples: DataFrame) -> DataFrame:
    return linear.initial_weights(examples)


# frequencies and log joins


@query
def enable_frequency(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events")
    counts = features.frequency(events, ["event_type", "user_id"], "props")
    return counts.select(
        features.composite_key("event_type", "user_id").alias("user_key"), F.col("props").alias("item"), "count"
    )


@query
def enable_frequency_map(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events")
    records = features.frequency_records(events, ["user_id"], "event_type", "ENABLE_FREQUENCY", 1)
    maps = store.records_to_maps(records)
    shown = F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return maps.select("key", "chunk", F.concat_ws(",", shown).alias("fields"))


@query
def frequency_map_chunked(spark, sf_dir):
    lines = tables.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey")
    maps = store.records_to_maps(features.frequency_records(lines, ["l_returnflag"], "l_suppkey", "SUPPLIERS", 1), chunks=16)
    shown = F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return maps.select("key", "chunk", F.concat_ws(",", shown).alias("fields"))


@query
def category_frequency_customers(spark, sf_dir):
    orders = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    customers = tables.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    shows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        customers, F.col("o_custkey") == F.col("c_custkey")
    )
    counts = features.frequency(shows, ["c_nationkey", "o_custkey"], "l_partkey")
    return counts.select(
        features.composite_key("c_nationkey", "o_custkey").alias("user_key"), F.col("l_partkey").alias("item"), "count"
    )


@query
def impression_click_join(spark, sf_dir):
    joined = features.impression_clicks(tables.impressions(spark, sf_dir), tables.clicks(spark, sf_dir))
    return joined.select("list_session_id", "user_id", "timestamp", "feat_id_list", "feat_id", "position")


@query
def user_dimension_join(spark, sf_dir):
    joined = features.impression_clicks(tables.impressions(spark, sf_dir), tables.clicks(spark, sf_dir))
    return features.with_user_info(joined.drop("list_session_id", "feat_id_list"), tables.user_info(spark, sf_dir))


def _clicked(spark, sf_dir):
    joined = features.impression_clicks(tables.impressions(spark, sf_dir), tables.clicks(spark, sf_dir))
    return features.clicked_in_list(features.with_user_info(joined, tables.user_info(spark, sf_dir)))


@query
def clicked_candidates(spark, sf_dir):
    return _clicked(spark, sf_dir).select("list_session_id", "user_id", "timestamp", "feat_id", "position", "feat_id_list")


@query
def negative_samples(spark, sf_dir):
    rows = features.labeled_clicks(_clicked(spark, sf_dir))
    return rows.select("row_id", "click_key", "label", "entity_id", "position")


@query
def hash_split(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events").select("event_id", "user_id")
    return features.hash_split(events, [F.col("user_id"), F.col("event_id")])


@query
def training_set(spark, sf_dir):
    return features.training_set(
        tables.impressions(spark, sf_dir), tables.clicks(spark, sf_dir), tables.user_info(spark, sf_dir)
    )


@query
def seen_entities(spark, sf_dir):
    return features.seen_entities(tables.impressions(spark, sf_dir))


# feature spaces and clean-up


@query
def feature_space(spark, sf_dir):
    return features.feature_index(tables.event_examples(spark, sf_dir))


@query
def category_index(spark, sf_dir):
    index = features.category_index(tables.click_log(spark, sf_dir), tables.CLICK_CATEGORIES)
    return index.select(F.col("position").cast("bigint").alias("position"), "value", "idx")


@query
def coded_categories(spark, sf_dir):
    log = tables.click_log(spark, sf_dir)
    index = features.category_index(log, tables.CLICK_CATEGORIES)
    coded = features.code_categories(log, tables.CLICK_CATEGORIES, index)
    return coded.select("id", *[f"{c}_idx" for c in tables.CLICK_CATEGORIES])


@query
def densest_feature(spark, sf_dir):
    return features.densest_feature(tables.event_examples(spark, sf_dir))


@query
def entity_sizes(spark, sf_dir):
    return features.entity_sizes(tables.event_examples(spark, sf_dir))


@query
def numeric_cleanup(spark, sf_dir):
    log = tables.click_log(spark, sf_dir)
    return log.select(
        "id", features.clean_number(F.col("price_text")).alias("price"), features.clean_number(F.col("balance_text")).alias("balance")
    )


@query
def parse_quarantine(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events")
    number = F.regexp_extract("props", "([0-9]+)", 1).try_cast("bigint")
    ratio = F.try_divide(F.col("value"), number.cast("double"))
    checked = quarantine(
        events.select("event_id", number.alias("k"), ratio.alias("ratio")),
        {"number": F.col("k").isNull(), "division": F.col("ratio").isNull()},
    )
    return checked.select("event_id", "k", tidy(F.col("ratio"), 9).alias("ratio"), "error")


@query
def libsvm_roundtrip(spark, sf_dir):
    examples = tables.event_examples(spark, sf_dir)
    lines = text.to_labeled_lines(examples, entity_token="feat_id")
    return text.parse_labeled_lines(lines, mode="log", entity_token="feat_id")


@query
def text_source(spark, sf_dir):
    """Lines written as text, read with ids that depend on their content, and parsed."""
    path = scratch_path(spark, "lines")
    number = F.expr("cast(regexp_extract(props, '([0-9]+)', 1) as bigint) div 10").cast("string")
    label = F.when(F.col("value") > tables.LABEL_CUT, "+1").otherwise("-1")
    line = F.concat(label, F.lit(" type_"), F.col("event_type"), F.lit(":1 k_"), number, F.lit(":1"))
    tables.table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return text.parse_labeled_lines(text.read_lines(spark, path), mode="exp")


# profiles and similarity


@query
def profile_slots(spark, sf_dir):
    return profile.profile_slots(tables.profiles(spark, sf_dir))


@query
def profile_slots_legacy(spark, sf_dir):
    return profile.profile_slots(tables.profiles(spark, sf_dir), legacy_slots=True)


@query
def profile_levels(spark, sf_dir):
    packed = profile.profile_patterns(tables.profiles(spark, sf_dir))
    return packed.select("user_id", profile.pattern_text(F.col("pattern")).alias("pattern"))


def _patterns(spark, sf_dir):
    """Pattern table, written once because every similarity query joins it with itself."""
    return cut_lineage(similarity.pattern_table(profile.profile_patterns(tables.profiles(spark, sf_dir))))


@query
def profile_cosine_pairs(spark, sf_dir):
    pairs = similarity.similar_profiles(_patterns(spark, sf_dir), min_shared=6)
    names = [profile.pattern_text(F.col(c)).alias(c) for c in ("profile_a", "profile_b")]
    return pairs.select(*names, "shared", "sim", "users_a", "users_b")


@query
def profile_cosine_all(spark, sf_dir):
    """All pairs of profiles that share an attribute, counted and summed up per profile."""
    pairs = similarity.both_directions(similarity.similar_profiles(_patterns(spark, sf_dir), min_shared=1))
    sums = pairs.groupBy("profile_a").agg(F.count("*").alias("pairs"), F.sum("shared").alias("shared"), F.sum("users_b").alias("users"))
    return sums.withColumn("profile_a", profile.pattern_text(F.col("profile_a")))


@query
def profile_neighbours_directed(spark, sf_dir):
    pairs = similarity.both_directions(similarity.similar_profiles(_patterns(spark, sf_dir), min_shared=7))
    near = pairs.groupBy("profile_a").agg(F.sum("users_b").alias("near_users"), F.max("sim").alias("best_sim"))
    return near.withColumn("profile_a", profile.pattern_text(F.col("profile_a")))


@query
def profile_dot_topk(spark, sf_dir):
    return similarity.top_neighbours(profile.profile_patterns(tables.profiles(spark, sf_dir)), k=20)


@query
def approx_cosine_mae(spark, sf_dir):
    patterns = _patterns(spark, sf_dir)
    exact = similarity.similar_profiles(patterns, min_shared=6)
    approx = similarity.approx_similar_profiles(patterns, min_shared=6)
    error = similarity.similarity_error(exact, approx)
    return error.select(tidy(F.col("mae")).alias("mae"), "pairs", "found")


@query
def embedding_transpose(spark, sf_dir):
    vectors = tables.table(spark, sf_dir, "embeddings")
    blocks = matrix.transpose_rows(vectors, "vec_id", "embedding", block=256)
    shown = F.transform("values", lambda v: F.round(v * 1e6).cast("bigint").cast("string"))
    return blocks.select("i", "block", "first_j", F.concat_ws(",", shown).alias("micro_values"))


@query
def embedding_cosine_topk(spark, sf_dir):
    vectors = tables.table(spark, sf_dir, "embeddings")
    near = neighbours.cosine_topk(vectors, "vec_id", "embedding", k=5)
    return near.select("vec_id", "neighbour", tidy(F.col("sim")).alias("sim"), "rank")


@query
def embedding_dimsum(spark, sf_dir):
    entries = dimsum.vector_entries(tables.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    out = dimsum.column_similarities(entries, gamma=4.0)
    return out.select("col_a", "col_b", tidy(F.col("sim")).alias("sim"))


@query
def embedding_dimsum_error(spark, sf_dir):
    entries = dimsum.vector_entries(tables.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    exact, estimate = dimsum.column_similarities(entries), dimsum.column_similarities(entries, gamma=4.0)
    out = dimsum.estimate_error(exact, estimate, threshold=0.05)
    return out.select(tidy(F.col("mae")).alias("mae"), tidy(F.col("largest")).alias("largest"), "pairs", "similar", "found")


# evaluation


@query
def auc(spark, sf_dir):
    out = metrics.auc(tables.line_scores(spark, sf_dir))
    return out.select(tidy(F.col("auc")).alias("auc"), "positives", "negatives")


@query
def auc_documents(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = tables.table(spark, sf_dir, "labels").select("doc_id", "quality")
    scored = docs.join(labels, "doc_id").select(F.col("quality").alias("label"), F.col("n_chars").alias("score"))
    out = metrics.auc(scored)
    return out.select(tidy(F.col("auc")).alias("auc"), "positives", "negatives")


@query
def log_loss_exp(spark, sf_dir):
    out = metrics.mean_loss(tables.line_scores(spark, sf_dir), "exp")
    return out.select(tidy(F.col("loss")).alias("loss"), "rows")


@query
def log_loss_log(spark, sf_dir):
    scored = tables.line_scores(spark, sf_dir).select(
        F.when(F.col("label") > 0, 1.0).otherwise(0.0).alias("label"), sigmoid(F.col("score")).alias("score")
    )
    out = metrics.mean_loss(scored, "log")
    return out.select(tidy(F.col("loss")).alias("loss"), "rows")


@query
def accuracy(spark, sf_dir):
    out = metrics.accuracy(tables.line_scores(spark, sf_dir), "exp")
    return out.select(tidy(F.col("accuracy")).alias("accuracy"), "rows")


@query
def confusion(spark, sf_dir):
    out = metrics.confusion(tables.line_scores(spark, sf_dir), F.col("score") > 0, F.col("label") > 0)
    rates = [tidy(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall")]
    return out.select("tp", "fp", "fn", "tn", *rates)


@query
def evaluate_model(spark, sf_dir):
    examples = tables.event_examples(spark, sf_dir)
    out = metrics.evaluate(linear.score(examples, start_weights(examples)), "exp")
    return out.select(*[tidy(F.col(c)).alias(c) for c in ("accuracy", "loss", "auc")])


# linear models


@query
def lr_score(spark, sf_dir):
    examples = tables.event_examples(spark, sf_dir)
    out = linear.score(examples, start_weights(examples), "logistic")
    return out.select("row_id", "label", tidy(F.col("score")).alias("score"))


@query
def lr_gradient(spark, sf_dir):
    examples = tables.event_examples(spark, sf_dir)
    out = linear.gradient(examples, start_weights(examples))
    return out.select("feature", tidy(F.col("grad")).alias("grad"), "rows")


def _mean_gradient(examples, weights):
    grads = linear.gradient(examples, weights)
    rows = examples.agg(F.count_distinct("row_id")).scalar()
    return grads.select("feature", (F.col("grad") / rows).alias("grad"))


@query
def lr_gd_step_l2(spark, sf_dir):
    examples = tables.event_examples(spark, sf_dir)
    weights = start_weights(examples)
    out = linear.update(weights, _mean_gradient(examples, weights), step=0.5, lam=0.1, reg="l2")
    return out.select("feature", tidy(F.col("w")).alias("w"))


@query
def lr_prox_step_l1(spark, sf_dir):
    examples = tables.event_examples(spark, sf_dir)
    weights = start_weights(examples)
    out = linear.update(weights, _mean_gradient(examples, weights), step=0.5, lam=0.05, reg="l1")
    return out.select("feature", tidy(F.col("w")).alias("w"))


@query
def lr_gd(spark, sf_dir):
    out = linear.fit_gradient(tables.event_examples(spark, sf_dir), iterations=2, alpha=0.5, lam=0.1)
    return out.select("feature", tidy(F.col("w")).alias("w"))


@query
def lr_majorized(spark, sf_dir):
    out = linear.fit_majorized(tables.event_examples(spark, sf_dir), iterations=2, lam=0.01, tol=0.0)
    return out.select("feature", tidy(F.col("w")).alias("w"))


@query
def lr_sgd_avg(spark, sf_dir):
    out = linear.fit_sgd_averaged(tables.event_examples(spark, sf_dir), iterations=1, alpha=0.1, lam=0.001)
    return out.select("feature", tidy(F.col("w")).alias("w"))


@query
def loss_history(spark, sf_dir):
    """Mean loss before each of two iterations of four trainers."""
    examples = tables.event_examples(spark, sf_dir)
    found = {name: [] for name in ("gradient", "majorized", "fm", "boosted")}
    linear.fit_gradient(examples, iterations=2, alpha=0.5, lam=0.1, history=found["gradient"])
    linear.fit_majorized(examples, iterations=2, lam=0.01, tol=0.0, history=found["majorized"])
    fm.fit_gradient(examples, n_factors=N_FACTORS, iterations=2, alpha=0.5, history=found["fm"])
    trees.fit_boosted(examples, iterations=2, depth=2, history=found["boosted"])
    out = history.history_table(spark, found)
    return out.select("trainer", "iteration", tidy(F.col("loss")).alias("loss"))


@query
def lr_lbfgs(spark, sf_dir):
    out = linear.fit_lbfgs(tables.event_examples(spark, sf_dir), lam=0.01, tol=1e-8)
    return out.select("feature", tidy(F.col("w"), 3).alias("w"))


@query
def lr_lbfgs_values(spark, sf_dir):
    out = linear.fit_lbfgs(tables.valued_examples(spark, sf_dir), lam=0.01, loss="log", tol=1e-8)
    return out.select("feature", tidy(F.col("w"), 3).alias("w"))


@query
def lr_owlqn_values(spark, sf_dir):
    out = linear.fit_lbfgs(tables.valued_examples(spark, sf_dir), lam=0.002, reg="l1", loss="log", tol=1e-8)
    return out.select("feature", tidy(F.col("w"), 3).alias("w"))


# factorization machines


def start_fm(examples):
    return fm.initial_model(examples, N_FACTORS)


@query
def fm_predict(spark, sf_dir):
    examples = tables.event_examples(spark, sf_dir)
    out = fm.predict(examples, start_fm(examples), N_FACTORS)
    return out.select("row_id", "label", tidy(F.col("score"), 8).alias("score"))


@query
def fm_gradient(spark, sf_dir):
    examples = tables.event_examples(spark, sf_dir)
    out = fm.gradient(examples, start_fm(examples), N_FACTORS, bias=0.0)
    factors = [tidy(F.get("gv", F.lit(k))).alias(f"gv{k}") for k in range(N_FACTORS)]
    return out.select("feature", tidy(F.col("gw")).alias("gw"), *factors, "rows")


@query
def fm_gd_step(spark, sf_dir):
    examples = tables.event_examples(spark, sf_dir)
    model = fm.fit_gradient(examples, n_factors=N_FACTORS, iterations=1, alpha=0.5, lams=(0.01, 0.02, 0.03))
    factors = [tidy(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(N_FACTORS)]
    return model.select("feature", tidy(F.col("w")).alias("w"), *factors)


@query
def fm_loss_reg(spark, sf_dir):
    examples = tables.event_examples(spark, sf_dir)
    out = fm.regularized_loss(examples, start_fm(examples), N_FACTORS, (0.01, 0.02, 0.03))
    return out.select(*[tidy(F.col(c)).alias(c) for c in ("loss", "penalty", "objective")])


def _fm_rows(model):
    factors = [tidy(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(N_FACTORS)]
    return model.select("feature", tidy(F.col("w")).alias("w"), *factors)


@query
def fm_gd(spark, sf_dir):
    examples = tables.event_examples(spark, sf_dir)
    return _fm_rows(fm.fit_gradient(examples, n_factors=N_FACTORS, iterations=3, alpha=0.5))


@query
def fm_sgd_avg(spark, sf_dir):
    examples = tables.event_examples(spark, sf_dir)
    return _fm_rows(fm.fit_sgd_averaged(examples, n_factors=N_FACTORS, iterations=1, lams=(0.0, 0.001, 0.001)))


# online learners


def _linear_state(examples):
    return online.state_from_weights(start_weights(examples), LINEAR_RATES["linear"])


def _state_rows(state, *extra):
    values = [tidy(F.col(c)).alias(c) for c in ("w", "z", "n", *extra)]
    return state.select("part", "feature", F.col("k").cast("bigint").alias("k"), *values, "step")


@query
def ftrl_batch_step(spark, sf_dir):
    examples = tables.dated_examples(spark, sf_dir)
    state, _ = online.train_batches(_linear_state(examples), examples, "half", LINEAR_RATES)
    return _state_rows(state)


@query
def tdap_batch_step(spark, sf_dir):
    examples = tables.dated_examples(spark, sf_dir)
    state, _ = online.train_batches(_linear_state(examples), examples, "half", TDAP_RATES, "tdap")
    return _state_rows(state, "s")


@query
def fm_ftrl_step(spark, sf_dir):
    examples = tables.event_examples(spark, sf_dir)
    state = online.state_from_fm(start_fm(examples), FM_RATES)
    changed = online.batch_update(state, examples, 1, FM_RATES, n_factors=N_FACTORS)
    return _state_rows(changed)


@query
def fm_ftrl_cold(spark, sf_dir):
    examples = tables.dated_examples(spark, sf_dir)
    state = online.cold_fm_state(examples, N_FACTORS, FM_RATES)
    state, _ = online.train_batches(state, examples, "half", FM_RATES, n_factors=N_FACTORS)
    return _state_rows(state)


@query
def fm_tdap_step(spark, sf_dir):
    examples = tables.event_examples(spark, sf_dir)
    state = online.state_from_fm(start_fm(examples), FM_RATES)
    changed = online.batch_update(state, examples, 1, FM_RATES, "tdap", n_factors=N_FACTORS)
    return _state_rows(changed, "s")


@query
def ftrl_per_user(spark, sf_dir):
    examples = tables.event_examples(spark, sf_dir)
    models = online.ftrl_per_key(examples, "entity_id", "row_id", LINEAR_RATES["linear"])
    return online.average_keys(models).select("model_key", "feature", tidy(F.col("w")).alias("w"))


@query
def prequential_metrics(spark, sf_dir):
    examples = tables.dated_examples(spark, sf_dir)
    _, scored = online.train_batches(_linear_state(examples), examples, "half", LINEAR_RATES)
    out = metrics.prequential(scored, "exp")
    rates = [tidy(F.col(c)).alias(c) for c in ("accuracy", "loss", "running_accuracy", "running_loss")]
    return out.select(F.col("batch_id").cast("bigint").alias("batch_id"), "rows", *rates)


# mixed model


@query
def mixed_score(spark, sf_dir):
    examples = tables.event_examples(spark, sf_dir)
    out = mixed.block_scores(examples, mixed.initial_model(examples))
    return out.select(
        "row_id",
        "entity_id",
        tidy(F.col("fixed")).alias("fixed"),
        tidy(F.col("random")).alias("random"),
        tidy(sigmoid(F.col("fixed") + F.col("random"))).alias("probability"),
    )


@query
def mixed_rescore(spark, sf_dir):
    examples = tables.event_examples(spark, sf_dir)
    model = mixed.initial_model(examples)
    old = mixed.fixed_of(model)
    new = old.withColumn("w", F.col("w") * F.lit(0.5))
    out = mixed.rescore(mixed.score(examples, model), examples, old, new)
    return out.select("row_id", tidy(F.col("score")).alias("score"))


@query
def mixed_fixed_step(spark, sf_dir):
    examples = tables.event_examples(spark, sf_dir)
    out = mixed.fixed_step(examples, mixed.initial_model(examples), step=0.5, lam=0.1)
    return out.select("feature", tidy(F.col("w")).alias("w"))


@query
def mixed_random_step(spark, sf_dir):
    examples = tables.event_examples(spark, sf_dir)
    out = mixed.random_step(examples, mixed.initial_model(examples), step=0.5, lam=0.1)
    return out.select("entity_id", "feature", tidy(F.col("w")).alias("w"))


@query
def mixed_fit(spark, sf_dir):
    model = mixed.fit_mixed(tables.event_examples(spark, sf_dir), iterations=2, lam=(0.001, 0.1), inner=3)
    return model.select("model_key", "feature", tidy(F.col("w")).alias("w"))


@query
def mixed_fit_sgd(spark, sf_dir):
    examples = tables.event_examples(spark, sf_dir)
    model = mixed.fit_mixed(examples, iterations=1, method=("sgd", "sgd"), lam=(0.001, 0.01))
    return model.select("model_key", "feature", tidy(F.col("w")).alias("w"))


@query
def mixed_fit_lbfgs(spark, sf_dir):
    examples = tables.event_examples(spark, sf_dir)
    model = mixed.fit_mixed(examples, iterations=2, method=("lbfgs", "lbfgs"), lam=(0.1, 1.0), inner=50)
    return model.select("model_key", "feature", tidy(F.col("w"), 3).alias("w"))


# trees


def _packed(spark, sf_dir):
    return tables.event_rows(tables.table(spark, sf_dir, "events")).select("row_id", "label", "features")


@query
def boost_prior_residual(spark, sf_dir):
    rows = _packed(spark, sf_dir)
    biased = rows.withColumn("bias", trees.prior(rows).select("bias").scalar())
    each = trees.residual(F.col("label"), F.col("bias"))
    return biased.select("row_id", tidy(F.col("bias")).alias("bias"), tidy(each).alias("residual"))


def _with_residuals(spark, sf_dir):
    rows = _packed(spark, sf_dir)
    biased = rows.withColumn("bias", trees.prior(rows).select("bias").scalar())
    return biased.select("features", trees.residual(F.col("label"), F.col("bias")).alias("residual"))


@query
def best_split(spark, sf_dir):
    rows = _with_residuals(spark, sf_dir).withColumn("node", F.lit(trees.ROOT).cast("bigint"))
    gains = trees.split_gains(rows)
    return gains.select("node", "feature", "n", "n_left", tidy(F.col("gain")).alias("gain"))


@query
def boost_tree_step(spark, sf_dir):
    rows = _with_residuals(spark, sf_dir)
    tree = trees.grow_tree(rows, depth=1)
    return rows.groupBy(tidy(tree.value()).alias("leaf_value")).agg(
        F.count("*").alias("rows"), tidy(F.sum("residual"), 4).alias("residual_sum")
    )


@query
def boosted_fit(spark, sf_dir):
    examples = tables.event_examples(spark, sf_dir)
    bias, grown = trees.fit_boosted(examples, iterations=3, depth=2)
    scored = trees.predict_boosted(examples, bias, grown)
    return scored.select("row_id", "label", tidy(F.col("score")).alias("score"))


@query
def hist_best_split(spark, sf_dir):
    """Best split of every numeric column at the root, with the side of missing values."""
    log = tables.numeric_log(spark, sf_dir)
    rows = histtrees.binned(log, tables.NUMBERS, histtrees.cut_points(log, tables.NUMBERS, bins=16))
    rows = rows.withColumn("bias", trees.prior(rows).select("bias").scalar())
    placed = rows.select(F.lit(trees.ROOT).alias("node"), trees.residual(F.col("label"), F.col("bias")).alias("residual"), "bins")
    best = histtrees.best_splits(histtrees.split_gains(histtrees.histogram(placed)), ["node", "col"])
    whole = [F.col(c).cast("bigint").alias(c) for c in ("col", "bin")]
    return best.select(*whole, "missing_left", "n", "n_left", tidy(F.col("gain")).alias("gain"))


@query
def ctr_boosted(spark, sf_dir):
    log = tables.numeric_log(spark, sf_dir)
    model = histtrees.fit(log, tables.NUMBERS, iterations=2, depth=3, rate=0.5, bins=16)
    return histtrees.predict(log, model).select("row_id", "label", tidy(F.col("score")).alias("score"))


@query
def gbt_ctr(spark, sf_dir):
    from clickloom.plans.ctr import ctr_report

    return ctr_report(tables.click_log(spark, sf_dir), "click", tables.CLICK_CATEGORIES, ["price_text", "balance_text"])


# keyed records, versions and ranking


def _record_batches(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events")
    early = events.filter(F.dayofmonth("ts") < 16)
    late = events.filter(F.dayofmonth("ts") >= 16)
    return (
        features.frequency_records(early, ["user_id"], "event_type", "FREQ", 1),
        features.frequency_records(late, ["user_id"], "event_type", "FREQ", 2),
    )


@query
def kv_upsert(spark, sf_dir):
    return store.upsert_records(*_record_batches(spark, sf_dir))


@query
def kv_lookup(spark, sf_dir):
    customers = tables.table(spark, sf_dir, "customer")
    keys = customers.select(F.concat(F.lit("FREQ:"), F.col("c_custkey").cast("string")).alias("key"))
    return store.lookup_records(keys, store.upsert_records(*_record_batches(spark, sf_dir)))


@query
def kv_compacted_lookup(spark, sf_dir):
    """Eight batches, merged on the way, then the records of every customer."""
    kv = BucketStore(spark, scratch_path(spark, "kv_compacted"), buckets=8, fan=3)
    events = tables.table(spark, sf_dir, "events")
    for part in range(8):
        some = events.filter(F.dayofmonth("ts") % 8 == part)
        kv.upsert(features.frequency_records(some, ["user_id"], "event_type", "FREQ", part), str(part))
    customers = tables.table(spark, sf_dir, "customer")
    return kv.lookup(customers.select(F.concat(F.lit("FREQ:"), F.col("c_custkey").cast("string")).alias("key")))


def model_versions(examples: DataFrame) -> DataFrame:
    """Two published versions: all models first, then the fixed effect and the entities whose key hash
    is in the lower half again, with their weights halved."""
    first = mixed.initial_model(examples).withColumn("version", F.lit(1).cast("bigint"))
    lower = (F.col("model_key") == mixed.FIXED) | (hash_weight(F.col("model_key"), "again") < 0)
    second = first.filter(lower).select(
        "model_key", "feature", (F.col("w") * 0.5).alias("w"), F.lit(2).cast("bigint").alias("version")
    )
    return first.unionByName(second)


@query
def kv_latest_model(spark, sf_dir):
    latest = store.latest_model(model_versions(tables.event_examples(spark, sf_dir)))
    return latest.select("model_key", "feature", tidy(F.col("w")).alias("w"), "version")


def published_model(spark, sf_dir):
    """Latest mixed model over the training set of the three logs."""
    seen = cut_lineage(training_set(spark, sf_dir).select("entity_id", "feature").distinct())
    return store.latest_model(model_versions(seen))


@query
def rank_candidates(spark, sf_dir):
    users = rank.user_features(tables.user_info(spark, sf_dir))
    return rank.rank_candidates(tables.requests(spark, sf_dir), users, published_model(spark, sf_dir))


@query
def rank_repeated_requests(spark, sf_dir):
    users = rank.user_features(tables.user_info(spark, sf_dir))
    ranked = rank.rank_candidates(tables.repeated_requests(spark, sf_dir), users, published_model(spark, sf_dir))
    return ranked.withColumn("timestamp", F.col("timestamp").cast("string"))


@query
def candidate_scores(spark, sf_dir):
    users = rank.user_features(tables.user_info(spark, sf_dir))
    scored = rank.candidate_scores(tables.requests(spark, sf_dir), users, published_model(spark, sf_dir))
    return scored.select(
        "list_session_id", F.col("pos").cast("bigint").alias("pos"), "candidate", tidy(F.col("probability")).alias("probability")
    )


# graph and sequences


@query
def pagerank4(spark, sf_dir):
    ranks = graph.pagerank(tables.purchase_edges(spark, sf_dir), iterations=4)
    return ranks.select("node", tidy(F.col("rank")).alias("rank"))


def _placed(spark, sf_dir):
    return sequence.positions(tables.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])


@query
def path_contains(spark, sf_dir):
    return sequence.path_contains(_placed(spark, sf_dir), "user_id", "event_type", ["view", "click", "purchase"])


@query
def first_match(spark, sf_dir):
    found = sequence.first_match(_placed(spark, sf_dir), "user_id", F.col("value") > 200.0)
    return found.select("user_id", F.col("first").cast("bigint").alias("first"))


@query
def is_increasing(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    placed = sequence.positions(rows, "o_custkey", ["o_orderdate", "o_orderkey"])
    return sequence.is_increasing(placed, "o_custkey", "o_totalprice")


# streams over the files of a folder


def _event_stream(spark, sf_dir):
    return table_stream(spark, sf_dir.rstrip("/"), "events.parquet")


def _folder(spark, name):
    return scratch_path(spark, name)


@query
def stream_ftrl(spark, sf_dir):
    path = _folder(spark, "stream_ftrl")
    state = StateTable(spark, f"{path}/state")
    state.initialise(_linear_state(tables.event_examples(spark, sf_dir)))
    stream = tables.event_rows(_event_stream(spark, sf_dir)).select(
        "row_id", "label", F.explode("features").alias("feature"), F.lit(1.0).alias("value")
    )
    run_available(stream.writeStream.foreachBatch(learner(state, LINEAR_RATES)), f"{path}/checkpoint")
    return _state_rows(state.latest())


@query
def stream_ftrl_per_key(spark, sf_dir):
    path = _folder(spark, "stream_per_key")
    kv = BucketStore(spark, f"{path}/models", buckets=8)
    rows = tables.event_rows(_event_stream(spark, sf_dir)).withColumn("values", F.transform("features", lambda f: F.lit(1.0)))
    changes = keyed.ftrl_by_key(rows, "entity_id", "row_id", LINEAR_RATES["linear"])
    run_available(changes.writeStream.outputMode("update").foreachBatch(keyed.model_sink(kv)), f"{path}/checkpoint")
    return online.average_keys(keyed.models(kv)).select("model_key", "feature", tidy(F.col("w")).alias("w"))


@query
def stream_training_rows(spark, sf_dir):
    """Both logs delivered twice; lists that may still be clicked are not released."""
    path = _folder(spark, "stream_training")
    events = tables.with_session(_event_stream(spark, sf_dir)).withColumn("at", F.col("ts").cast("timestamp"))
    twice = events.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2))))
    keys = ["list_session_id", "user_id"]
    views = twice.filter("event_type = 'view'").select(*keys, F.date_trunc("day", "at").alias("shown_at"))
    hits = twice.filter("event_type = 'click'").select(*keys, F.col("event_id").alias("click_id"), F.col("at").alias("clicked_at"))
    rows = stream_features.training_rows(views, hits, keys, "click_id", within="24 hours")
    writer = rows.select(*keys, "click_id", "label").writeStream.format("parquet").option("path", f"{path}/rows")
    run_available(writer.outputMode("append"), f"{path}/checkpoint")
    out = spark.read.schema("list_session_id string, user_id long, click_id long, label double").parquet(f"{path}/rows")
    return out.withColumn("click_id", F.coalesce(F.col("click_id").cast("string"), F.lit("")))


@query
def stream_frequency(spark, sf_dir):
    path = _folder(spark, "stream_frequency")
    records = store.RecordStore(spark, f"{path}/records")
    counts = stream_features.running_frequency(_event_stream(spark, sf_dir), ["user_id"], "event_type")
    sink = stream_features.frequency_sink(records, ["user_id"], "event_type", "FREQ")
    run_available(counts.writeStream.outputMode("update").foreachBatch(sink), f"{path}/checkpoint")
    return records.read().select("key", "field", "value")


@query
def stream_rank(spark, sf_dir):
    path = _folder(spark, "stream_rank")
    users = rank.user_features(tables.user_info(spark, sf_dir))
    views = _event_stream(spark, sf_dir).filter(F.col("event_type") == "view")
    requests = tables.request_rows(views.withColumn("parts", F.lit(tables.table(spark, sf_dir, "part").count())))
    sink = stream_features.ranking_sink(users, published_model(spark, sf_dir), f"{path}/ranked")
    run_available(requests.writeStream.foreachBatch(sink), f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/ranked").drop("batch")


@query
def stream_imp_click(spark, sf_dir):
    path = _folder(spark, "stream_imp_click")
    events = tables.with_session(_event_stream(spark, sf_dir)).withColumn("at", F.col("ts").cast("timestamp"))
    keys = ["list_session_id", "user_id"]
    # a list is shown to a user for one day
    views = events.filter("event_type = 'view'").select(*keys, F.date_trunc("day", "at").alias("shown_at"))
    hits = events.filter("event_type = 'click'").select(*keys, F.col("event_id").alias("click_id"), F.col("at").alias("clicked_at"))
    joined = stream_features.join_impressions_clicks(views, hits, keys, within="24 hours")
    writer = joined.select(*keys, "click_id").writeStream.format("parquet").option("path", f"{path}/joined")
    run_available(writer.outputMode("append"), f"{path}/checkpoint")
    return spark.read.schema("list_session_id string, user_id long, click_id long").parquet(f"{path}/joined")


@query
def stream_daily_frequency(spark, sf_dir):
    path = _folder(spark, "stream_daily")
    counts = stream_features.daily_frequency(_event_stream(spark, sf_dir), "ts", ["user_id"], "event_type")
    writer = counts.writeStream.outputMode("update").foreachBatch(
        lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/days/batch={batch_id}")
    )
    run_available(writer, f"{path}/checkpoint")
    newest = F.max_by("count", "batch").alias("count")
    days = spark.read.parquet(f"{path}/days").groupBy("day", "user_id", "event_type").agg(newest)
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "user_id", "event_type", "count")
