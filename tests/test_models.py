import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.functions.hashing import hash_int
from clickloom.operators import fm, linear, mixed, online, passes, trees
from clickloom.operators.layout import lookup
from clickloom.operators.online import Rates
from clickloom.sources.params import BIAS

FEATURES = ["a", "b", "c", "d", "e"]


def make(n=60, seed=5, entities=3):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        active = rnd.sample(FEATURES, rnd.randint(1, 3))
        y = 1.0 if rnd.random() < (0.8 if "a" in active else 0.3) else -1.0
        data.append((i, y, f"e{rnd.randrange(entities)}", active))
    return data


def examples(spark, data):
    rows = [(i, y, e, f, 1.0) for i, y, e, active in data for f in active]
    return spark.createDataFrame(rows, "row_id long, label double, entity_id string, feature string, value double")


def dense(data):
    x = np.zeros((len(data), len(FEATURES)))
    for r, (_, _, _, active) in enumerate(data):
        for f in active:
            x[r, FEATURES.index(f)] = 1.0
    return x, np.array([d[1] for d in data])


def weights(spark, w, names=FEATURES):
    return spark.createDataFrame([(f, float(v)) for f, v in zip(names, w)], "feature string, w double")


def vector(df):
    got = {r["feature"]: r["w"] for r in df.collect()}
    return np.array([got.get(f, 0.0) for f in FEATURES])


W = np.array([0.3, -0.2, 0.1, 0.05, -0.4])


def test_gradient_is_the_derivative(spark):
    data = make()
    x, y = dense(data)

    def loss(w):
        return np.log1p(np.exp(-y * (x @ w))).sum()

    got = {r["feature"]: r["grad"] for r in linear.gradient(examples(spark, data), weights(spark, W)).collect()}
    for j, f in enumerate(FEATURES):
        h = np.zeros(5)
        h[j] = 1e-6
        assert got[f] == pytest.approx((loss(W + h) - loss(W - h)) / 2e-6, abs=1e-5)


def dense_sgd(x, y, w, alpha, lam, reg):
    w = w.copy()
    for t in range(1, len(x) + 1):
        rate = alpha / math.sqrt(t)
        g = -y[t - 1] / (1 + math.exp(y[t - 1] * (x[t - 1] @ w))) * x[t - 1]
        if reg == "l2":
            w = w - rate * (g + lam * w)
        else:
            v = w - rate * g
            w = np.sign(v) * np.maximum(0, np.abs(v) - rate * lam)
    return w


@pytest.mark.parametrize("reg", ["l1", "l2"])
def test_one_shard_equals_the_sequential_pass(spark, reg):
    data = make()
    x, y = dense(data)
    got = linear.fit_sgd_averaged(examples(spark, data), weights(spark, W), alpha=0.3, lam=0.05, reg=reg, shards=1)
    assert vector(got) == pytest.approx(dense_sgd(x, y, W, 0.3, 0.05, reg), abs=1e-9)


@pytest.mark.parametrize("reg", ["l1", "l2"])
def test_shards_are_averaged_by_rows(spark, reg):
    data = make()
    df = examples(spark, data)
    shard_of = {r[0]: r[1] for r in df.select("row_id", hash_int(F.col("row_id")) % 3).distinct().collect()}
    x, y = dense(data)
    total = np.zeros(5)
    for s in range(3):
        pick = [i for i in range(len(data)) if shard_of[data[i][0]] == s]
        total += len(pick) * dense_sgd(x[pick], y[pick], W, 0.3, 0.05, reg)
    got = linear.fit_sgd_averaged(df, weights(spark, W), alpha=0.3, lam=0.05, reg=reg, shards=3)
    assert vector(got) == pytest.approx(total / len(data), abs=1e-9)


def test_more_shards_than_rows(spark):
    data = make(n=3)
    got = linear.fit_sgd_averaged(examples(spark, data), weights(spark, W), alpha=0.3, shards=8)
    assert np.isfinite(vector(got)).all()


def test_sgd_per_entity_equals_separate_passes(spark):
    data = make()
    df = examples(spark, data)
    start = spark.createDataFrame(
        [(f"e{e}", f, float(w)) for e in range(4) for f, w in zip(FEATURES, W)], "entity_id string, feature string, w double"
    )
    got = {}
    for r in linear.fit_sgd_by_key(df, start, alpha=0.3, lam=0.05).collect():
        got.setdefault(r["entity_id"], {})[r["feature"]] = r["w"]
    for e in range(3):
        part = [d for d in data if d[2] == f"e{e}"]
        x, y = dense(part)
        expected = dense_sgd(x, y, W, 0.3, 0.05, "l2")
        assert [got[f"e{e}"][f] for f in FEATURES] == pytest.approx(list(expected), abs=1e-9)
    assert [got["e3"][f] for f in FEATURES] == pytest.approx(list(W))  # no rows: unchanged
    split = linear.fit_sgd_by_key(df, start, alpha=0.3, lam=0.05, shards=3)
    assert split.count() == 20 and split.filter("w is null or isnan(w)").isEmpty()


def objective(x, y, w, lam, reg):
    penalty = lam / 2 * (w**2).sum() if reg == "l2" else lam * np.abs(w).sum()
    return np.log1p(np.exp(-y * (x @ w))).mean() + penalty


@pytest.mark.parametrize("reg,lam", [("l2", 0.05), ("l1", 0.02)])
def test_majorized_reaches_the_lbfgs_objective(spark, reg, lam):
    data = make(n=200)
    x, y = dense(data)
    df = examples(spark, data)
    a = vector(linear.fit_lbfgs(df, lam=lam, reg=reg, tol=1e-9))
    b = vector(linear.fit_majorized(df, lam=lam, reg=reg, iterations=60, tol=1e-7))
    assert objective(x, y, b, lam, reg) == pytest.approx(objective(x, y, a, lam, reg), abs=1e-5)


def test_gradient_descent_history_falls(spark):
    history = []
    linear.fit_gradient(examples(spark, make()), weights(spark, W), iterations=4, alpha=1.0, history=history)
    losses = [v for _, v in history]
    assert losses == sorted(losses, reverse=True) and len(losses) == 4


def test_big_model_path_gives_the_same_step(spark):
    df = examples(spark, make())
    small = linear.fit_gradient(df, weights(spark, W), iterations=2)
    shuffled = linear.fit_gradient(df, weights(spark, W), iterations=2, broadcast_rows=1)
    assert vector(shuffled) == pytest.approx(vector(small))
    hot = spark.createDataFrame([("a",)], "feature string")
    salted = lookup(df, weights(spark, W), ["feature"], hot, salts=4)
    assert salted.filter("w is null").isEmpty() and salted.count() == df.count()


def test_bad_options_are_errors(spark):
    df = examples(spark, make(n=4))
    with pytest.raises(ValueError):
        linear.fit_linear(df, method="newton")
    with pytest.raises(ValueError):
        linear.fit_gradient(df, reg="l3")
    with pytest.raises(ValueError):
        fm.fit_fm(df, method="other")


# factorization machines


def fm_model(spark, w0, w, v, names=FEATURES):
    rows = [(f, float(a), [float(x) for x in b]) for f, a, b in zip(names, w, v)] + [(BIAS, float(w0), [0.0] * len(v[0]))]
    return spark.createDataFrame(rows, "feature string, w double, v array<double>")


def fm_score(x, w0, w, v):
    s = x @ v
    return w0 + x @ w + 0.5 * ((s**2).sum(1) - (x**2) @ (v**2).sum(1))


V = np.array([[0.1, -0.2], [0.3, 0.1], [-0.1, 0.2], [0.2, 0.2], [0.05, -0.3]])


def test_fm_hand_example(spark):
    df = spark.createDataFrame([(0, 1.0, "a", 1.0), (0, 1.0, "b", 1.0)], "row_id long, label double, feature string, value double")
    model = fm_model(spark, 1.0, [1.0, 2.0], [[1.0], [3.0]], ["a", "b"])
    assert fm.predict(df, model, 1).first()["score"] == pytest.approx(7.0)
    grads = {r["feature"]: r for r in fm.gradient(df, model, 1).collect()}
    m = -1 / (1 + math.exp(7.0))
    assert grads["a"]["gv"][0] == pytest.approx(3 * m) and grads["b"]["gv"][0] == pytest.approx(m)


def test_fm_gradient_is_the_derivative(spark):
    data = make()
    x, y = dense(data)
    grads = {r["feature"]: r for r in fm.gradient(examples(spark, data), fm_model(spark, 0.2, W, V), 2).collect()}

    def loss(w0, w, v):
        return np.log1p(np.exp(-y * fm_score(x, w0, w, v))).sum()

    h = 1e-6
    assert sum(r["gb"] for r in grads.values()) == pytest.approx((loss(0.2 + h, W, V) - loss(0.2 - h, W, V)) / (2 * h), abs=1e-4)
    for j, f in enumerate(FEATURES):
        e = np.zeros(5)
        e[j] = h
        assert grads[f]["gw"] == pytest.approx((loss(0.2, W + e, V) - loss(0.2, W - e, V)) / (2 * h), abs=1e-4)
        for k in range(2):
            d = np.zeros((5, 2))
            d[j, k] = h
            assert grads[f]["gv"][k] == pytest.approx((loss(0.2, W, V + d) - loss(0.2, W, V - d)) / (2 * h), abs=1e-4)


def test_fm_one_shard_equals_the_sequential_pass(spark):
    data = make()
    x, y = dense(data)
    lams, alpha = (0.01, 0.05, 0.03), 0.2
    w0, w, v = 0.2, W.copy(), V.copy()
    for t in range(1, len(x) + 1):
        xi, rate = x[t - 1], alpha / math.sqrt(t)
        m = -y[t - 1] / (1 + math.exp(y[t - 1] * fm_score(xi[None], w0, w, v)[0]))
        gv = m * (np.outer(xi, xi @ v) - v * (xi**2)[:, None])
        w0, w, v = w0 - rate * (m + lams[0] * w0), w - rate * (m * xi + lams[1] * w), v - rate * (gv + lams[2] * v)
    got = fm.fit_sgd_averaged(examples(spark, data), fm_model(spark, 0.2, W, V), 2, 1, alpha, lams, shards=1)
    rows = {r["feature"]: r for r in got.collect()}
    assert rows[BIAS]["w"] == pytest.approx(w0, abs=1e-9)
    for j, f in enumerate(FEATURES):
        assert rows[f]["w"] == pytest.approx(w[j], abs=1e-9)
        assert rows[f]["v"] == pytest.approx(list(v[j]), abs=1e-9)
    three = fm.fit_sgd_averaged(examples(spark, data), fm_model(spark, 0.2, W, V), 2, 1, alpha, lams, shards=3)
    assert three.count() == 6


def test_fm_descends_and_parts_round_trip(spark):
    df = examples(spark, make())
    model = fm_model(spark, 0.0, W, V)
    before = fm.regularized_loss(df, model, 2, (0.0, 0.0, 0.0)).first()["loss"]
    after = fm.fit_gradient(df, model, 2, iterations=4, alpha=1.0)
    assert fm.regularized_loss(df, after, 2, (0.0, 0.0, 0.0)).first()["loss"] < before
    back = fm.join_parts(*fm.split_parts(model), 2)
    assert {r["feature"]: (r["w"], r["v"]) for r in back.collect()} == {r["feature"]: (r["w"], r["v"]) for r in model.collect()}


# online learners

RATES = Rates(alpha=0.1, beta=1.0, l1=0.01, l2=0.0)


def test_warm_start_reproduces_the_weights(spark):
    w = [0.5, -0.3, 0.2, 0.1]
    state = online.state_from_weights(weights(spark, w, FEATURES[:4]), RATES)
    back = state.select("feature", online.ftrl_weight(F.col("z"), F.col("n"), RATES).alias("w"))
    assert vector(back)[:4] == pytest.approx(w)


def dense_ftrl(x, y, r, z, n):
    def weight():
        inner = np.sign(z) * np.maximum(0, np.abs(z) - r.l1)
        return -inner / (r.l2 + (r.beta + np.sqrt(n)) / r.alpha)

    for xi, yi in zip(x, y):
        w = weight()
        g = -yi / (1 + math.exp(yi * (xi @ w))) * xi
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / r.alpha
        z, n = z + g - sigma * w, n + g * g
    return weight()


def test_batches_of_one_row_equal_the_sequential_algorithm(spark):
    data = make(n=6)
    x, y = dense(data)
    state = online.state_from_weights(weights(spark, np.zeros(5)), RATES)
    final, scored = online.train_batches(state, examples(spark, data), "row_id", {"linear": RATES})
    assert vector(online.weights_of(final)) == pytest.approx(dense_ftrl(x, y, RATES, np.zeros(5), np.zeros(5)), abs=1e-9)
    assert scored.count() == 6


def test_per_key_pass_equals_the_sequential_algorithm(spark):
    data = make()
    models = online.ftrl_per_key(examples(spark, data), "entity_id", "row_id", RATES)
    got = {}
    for r in online.average_keys(models).collect():
        got.setdefault(r["model_key"], {})[r["feature"]] = r["w"]
    for e in ("e0", "e1", "e2"):
        x, y = dense([d for d in data if d[2] == e])
        expected = dense_ftrl(x, y, RATES, np.zeros(5), np.zeros(5))
        assert [got[e].get(f, 0.0) for f in FEATURES] == pytest.approx(list(expected), abs=1e-9)


def test_tdap_leaves_untouched_coordinates_alone(spark):
    data = [(0, 1.0, "e", ["a"])]
    state = online.state_from_weights(weights(spark, W), RATES)
    changed = online.batch_update(state, examples(spark, data), 1, {"linear": RATES}, "tdap")
    assert [r["feature"] for r in changed.collect()] == ["a"]
    merged = online.merge_state(state, changed)
    assert vector(online.weights_of(merged))[1:] == pytest.approx(W[1:])
    assert merged.count() == 5 and merged.filter("isnan(w)").isEmpty()


def test_tdap_forgets_with_time(spark):
    state = spark.createDataFrame(
        [("linear", "a", 0, 0.5, 4.0, 1.0, 2.0, 1)],
        "part string, feature string, k int, w double, z double, n double, s double, step long",
    )
    grads = spark.createDataFrame([("linear", "a", 0, 1.0)], "part string, feature string, k int, g double")
    got = online.tdap_update(state, grads, {"linear": Rates(alpha=1.0, tau=1.0)}, 5).first()
    d, sigma = math.exp(-2.0), math.sqrt(2) - 1
    assert got["s"] == pytest.approx(2 * d + sigma)
    assert got["z"] == pytest.approx(4 * d + sigma * 0.5 - 1)
    assert got["w"] == pytest.approx(got["z"] / got["s"])


def test_fm_state_round_trips(spark):
    rates = {p: RATES for p in ("bias", "linear", "factor")}
    model = fm_model(spark, 0.25, W, V)
    back = online.fm_of(online.state_from_fm(model, rates), 2)
    assert {r["feature"]: (r["w"], r["v"]) for r in back.collect()} == {r["feature"]: (r["w"], r["v"]) for r in model.collect()}
    cold = online.cold_fm_state(examples(spark, make()), 2, rates)
    assert cold.count() == 5 + 10 + 1


# mixed model


def test_rescoring_equals_scoring_again(spark):
    df = examples(spark, make())
    old = mixed.initial_model(df)
    new_fixed = mixed.fixed_of(old).withColumn("w", F.col("w") + 0.3)
    moved = mixed.rescore(mixed.score(df, old), df, mixed.fixed_of(old), new_fixed)
    again = mixed.score(df, mixed.combine(new_fixed, mixed.random_of(old)))
    a = {r["row_id"]: r["score"] for r in moved.collect()}
    b = {r["row_id"]: r["score"] for r in again.collect()}
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i]) for i in a)


def test_unseen_entities_and_features_count_nothing(spark):
    df = examples(spark, [(0, 1.0, "new", ["zzz"])])
    assert mixed.score(df, mixed.initial_model(examples(spark, make()))).first()["score"] == 0.0


@pytest.mark.parametrize("method", ["majorized", "sgd"])
def test_mixed_training_improves(spark, method):
    df = examples(spark, make(n=150))
    history = []
    model = mixed.fit_mixed(df, iterations=2, method=(method, method), inner=4, lam=(0.01, 0.1), history=history)
    start = linear_loss(mixed.score(df, mixed.initial_model(df)))
    assert linear_loss(mixed.score(df, model)) < start and len(history) == 2
    assert model.filter("model_key = ''").count() == 5


@pytest.mark.parametrize("reg", ["l1", "l2"])
def test_mixed_passes_leave_packed_rows_with_their_entity(spark, monkeypatch, reg):
    df = examples(spark, make(n=60)).withColumn("entity_id", F.when(F.col("row_id") % 7 > 0, F.col("entity_id")))
    plans, run = {}, passes.run_pass

    def seen(packed, group, *args, **named):
        out = run(packed, group, *args, **named)
        plans[group[0]] = out._jdf.queryExecution().executedPlan().toString()
        return out

    monkeypatch.setattr(passes, "run_pass", seen)
    fit = lambda: {tuple(r)[:2]: r["w"] for r in mixed.fit_mixed(df, 2, ("sgd", "sgd"), lam=(0.01, 0.02), reg=(reg, reg)).collect()}
    placed = fit()
    assert not re.search(r"Exchange hashpartitioning\(entity_id#\d+, shard#", plans["entity_id"])
    monkeypatch.setattr(mixed, "ENTITY_FEATURES", 0)
    assert placed == {k: pytest.approx(w, abs=1e-12) for k, w in fit().items()}


def linear_loss(scored):
    return scored.agg(F.avg(F.log1p(F.exp(-F.col("label") * F.col("score"))))).first()[0]


# trees


def test_split_gain_fixture(spark):
    rows = spark.createDataFrame(
        [(1, 1.0, ["f"]), (1, 1.0, ["f"]), (1, -1.0, ["g"]), (1, -1.0, ["g"])], "node int, residual double, features array<string>"
    )
    gains = {r["feature"]: r["gain"] for r in trees.split_gains(rows).collect()}
    assert gains == {"f": pytest.approx(4.0), "g": pytest.approx(4.0)}
    assert trees.best_splits(trees.split_gains(rows)).first()["feature"] == "f"
    tree = trees.grow_tree(rows.drop("node"), depth=2)
    assert sorted(tree.leaves.values()) == [-1.0, 1.0]


def test_boosting_lowers_the_loss(spark):
    df = examples(spark, make(n=200))
    bias, grown = trees.fit_boosted(df, iterations=4, depth=2)
    losses = [linear_loss(trees.predict_boosted(df, bias, grown[:n])) for n in (0, 2, 4)]
    assert losses == sorted(losses, reverse=True)
    with pytest.raises(ValueError):
        trees.fit_boosted(df.withColumn("label", F.lit(1.0)), 1)


def test_pass_learner_shrinks_lazily():
    assert passes.shrink(0.5, math.log(0.9), "l2") == pytest.approx(0.45)
    assert passes.shrink(-0.5, 0.2, "l1") == pytest.approx(-0.3)
    assert passes.shrink(0.1, 0.2, "l1") == 0.0


def _pass_models(spark):
    """Weights of the three sequential trainers on one data set."""
    data = make(n=120)
    df = examples(spark, data).withColumn("entity_id", F.concat(F.lit("e"), F.pmod(F.hash("row_id"), F.lit(3)).cast("string")))
    start = df.select("entity_id", "feature").distinct().withColumn("w", F.lit(0.1))
    return [
        {r["feature"]: r["w"] for r in linear.fit_sgd_averaged(df, iterations=2, alpha=0.3, lam=0.05, shards=4).collect()},
        {r["feature"]: (r["w"], *r["v"]) for r in fm.fit_sgd_averaged(df, n_factors=2, iterations=2, alpha=0.1, shards=4).collect()},
        {(r["entity_id"], r["feature"]): r["w"] for r in linear.fit_sgd_by_key(df, start, alpha=0.3, lam=0.05).collect()},
    ]


def test_passes_do_not_depend_on_the_join(spark, monkeypatch):
    want = _pass_models(spark)
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "5"}
    before = {k: spark.conf.get(k, None) for k in off}
    monkeypatch.setattr("clickloom.operators.layout.broadcast_if_small", lambda df, n: df)
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        got = _pass_models(spark)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for a, b in zip(got, want):
        assert a.keys() == b.keys()
        assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in b)


def test_majorized_keeps_features_without_curvature_or_rows(spark):
    df = spark.createDataFrame([(1, 1.0, "a", 1.0), (2, -1.0, "a", 1.0), (1, 1.0, "zero", 0.0)], "row_id bigint, label double, feature string, value double")
    start = spark.createDataFrame([("zero", 0.7), ("absent", 0.4)], "feature string, w double")
    for reg, lam, absent in (("l2", 0.0, 0.4), ("l1", 0.1, 0.0), ("l2", 0.1, 0.0)):
        got = {r["feature"]: r["w"] for r in linear.fit_majorized(df, start, iterations=3, lam=lam, reg=reg).collect()}
        assert set(got) == {"a", "zero", "absent"} and got["absent"] == absent
        assert got["zero"] == pytest.approx(0.0 if (reg, lam) == ("l2", 0.1) else 0.7)


def vector_of(weights):
    return {r["feature"]: r["w"] for r in weights.collect()}


def test_lbfgs_uses_values(spark):
    rows = [(i, 1.0 if i % 3 else -1.0, *(("ten", 10.0) if i % 4 else ("one", 1.0))) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id bigint, label double, feature string, value double")
    a, b = (vector_of(m) for m in (linear.fit_lbfgs(df, lam=0.1, tol=1e-10), linear.fit_majorized(df, lam=0.1, iterations=60, tol=1e-9)))
    assert a["ten"] == pytest.approx(b["ten"], abs=1e-4) and a["one"] == pytest.approx(b["one"], abs=1e-4)


def slope(w, x, y, offset, lam):
    """Gradient of the mean loss with L2 penalty."""
    return -(x * (y / (1 + np.exp(y * (x @ w + offset))))[:, None]).mean(axis=0) + lam * w


@pytest.mark.parametrize("reg,loss", [("l2", "log"), ("l1", "exp")])
def test_lbfgs_with_offsets_is_optimal(spark, reg, loss):
    data = make(n=150)
    x, y = dense(data)
    offset = np.sin(np.arange(150))
    df = examples(spark, data).withColumn("offset", F.sin(F.col("row_id").cast("double")))
    if loss == "log":
        df = df.withColumn("label", (F.col("label") + 1) / 2)
    assert [r["row_id"] for r in df.select("row_id").distinct().orderBy("row_id").collect()] == list(range(150))
    history = []
    w = vector(linear.fit_lbfgs(df, lam=0.03, reg=reg, tol=1e-8, loss=loss, history=history))
    g = slope(w, x, y, offset, 0.03 if reg == "l2" else 0.0)
    if reg == "l2":
        assert np.abs(g).max() < 1e-7
    else:  # zero coefficients have slopes within the penalty, the others meet it
        assert (np.abs(g[w == 0]) <= 0.03 + 1e-7).all() and np.allclose(g[w != 0], -0.03 * np.sign(w[w != 0]), atol=1e-7)
    values = [v for _, v in history]
    assert values == sorted(values, reverse=True) and len(values) < 40


def test_lbfgs_products_equal_dense_two_loops():
    from clickloom.operators.lbfgs import Products

    rnd = np.random.default_rng(4)
    products, s, y = Products(3), [], []
    for _ in range(6):
        ds, g = rnd.normal(size=7), rnd.normal(size=7)
        dy = ds * rnd.uniform(0.5, 2, 7)
        basis = [*s, *y]
        products.push([ds @ b for b in basis], [dy @ b for b in basis], ds @ ds, ds @ dy, dy @ dy, [g @ b for b in basis], g @ ds, g @ dy, g @ g)
        s, y = [*s, ds][-3:], [*y, dy][-3:]
        q = -g
        alphas = []
        for a, b in zip(s[::-1], y[::-1]):
            alphas.append((a @ q) / (a @ b))
            q = q - alphas[-1] * b
        q = q * (s[-1] @ y[-1]) / (y[-1] @ y[-1])
        for a, b, alpha in zip(s, y, alphas[::-1]):
            q = q + (alpha - (b @ q) / (a @ b)) * a
        assert np.allclose(products.direction() @ np.array([*s, *y, g]), q)


def test_lbfgs_per_entity_and_warm_start(spark):
    data = make(n=90)
    df = examples(spark, data)
    rows = mixed.entity_rows(df)
    both = linear.fit_lbfgs(df, lam=0.2, keys=("entity_id", "feature"), normalizer=rows, tol=1e-8, broadcast_rows=1)
    got = {(r["entity_id"], r["feature"]): r["w"] for r in both.collect()}
    for e in range(3):
        part = [d for d in data if d[2] == f"e{e}"]
        x, y = dense(part)
        w = np.array([got.get((f"e{e}", f), 0.0) for f in FEATURES])
        assert np.abs(slope(w, x, y, 0.0, 0.2)).max() < 1e-6
    start = both.filter("entity_id = 'e0'").unionByName(spark.createDataFrame([("e9", "a", 2.0)], "entity_id string, feature string, w double"))
    again = linear.fit_lbfgs(df, start, lam=0.2, keys=("entity_id", "feature"), normalizer=rows, tol=1e-8)
    warm = {(r["entity_id"], r["feature"]): r["w"] for r in again.collect()}
    assert warm.pop(("e9", "a")) == 0.0 and warm == pytest.approx(got, abs=1e-5)


def test_deep_trees_are_planned_quickly(spark):
    import time

    levels = [{n: f"f{d}" for n in range(2**d, 2 ** (d + 1))} for d in range(6)]
    tree = trees.Tree(levels, {n: float(n) for n in range(64, 128)})
    df = spark.createDataFrame([(["f0", "f2", "f5"],), ([],)], "features array<string>")
    begin = time.perf_counter()
    got = [r["v"] for r in df.select(tree.value().alias("v")).collect()]
    assert time.perf_counter() - begin < 15
    node = 1
    for d in range(6):
        node = 2 * node if f"f{d}" in ("f0", "f2", "f5") else 2 * node + 1
    assert got == [float(node), 127.0]


def test_entity_rows_match_joins_by_feature(spark):
    from clickloom.operators.layout import EntityRows, by_row, narrow_models

    rows = [(i, 1.0 if i % 3 else -1.0, f"e{i * i % 4}", f, 1.0 + i % 2, 0.1 * (i % 5)) for i in range(60) for f in ("a", f"b{i % 7}", "a")]
    examples = spark.createDataFrame(rows, "row_id long, label double, entity_id string, feature string, value double, offset double")
    weights = examples.select("entity_id", "feature").distinct().filter("feature <> 'b3'").withColumn("w", F.rand(1))
    with by_row(examples) as arranged:
        want = linear._gradient_of(arranged.join(weights, ["entity_id", "feature"], "left"), "exp", ("entity_id", "feature"), True)
        expected = {(r["entity_id"], r["feature"]): (r["grad"], r["rows"], r["part"]) for r in want.collect()}
        for bound in (1_000_000, 7):  # the second deals entities to pieces
            entities = EntityRows(arranged, bound)
            found = entities.gradient(weights, "exp")
            got = {(r["entity_id"], r["feature"]): (r["grad"], r["rows"], r["part"]) for r in found.collect()}
            entities.close()
            assert got.keys() == expected.keys()
            assert all(got[k] == pytest.approx(expected[k]) for k in got)
    assert narrow_models(weights, 8) and not narrow_models(weights, 3)


def test_fm_pass_holds_plain_floats():
    """Small arrays cost several times the arithmetic; a parameter keeps the shrinkage from before its first row."""
    learner = passes.FmSgdPass(0.1, (0.0, 0.5, 0.25), 0.0, "exp")
    learner.step(1.0, ["a"], [1.0], [0.0], np.array([[0.0, 0.0]]))
    learner.step(-1.0, ["b"], [0.0], [1.0], np.array([[1.0, -1.0]]))
    w, v = {r[0]: r[1:3] for r in learner.finish(())}["b"]
    rates = (0.1, 0.1 / math.sqrt(2))
    assert w == pytest.approx(math.prod(1 - 0.5 * r for r in rates))
    assert v == pytest.approx([math.prod(1 - 0.25 * r for r in rates), -math.prod(1 - 0.25 * r for r in rates)])
    assert all(type(x) is float for p in learner.params.values() for x in p)


def test_averaged_passes_pack_their_rows_in_all_tasks(spark, monkeypatch):
    seen, pack = [], passes.pack

    def spy(joined, *args):
        seen.append(joined.select(F.spark_partition_id()).distinct().count())
        return pack(joined, *args)

    monkeypatch.setattr(passes, "pack", spy)
    rows = [(i, 1.0 if i % 3 else -1.0, f"f{i % 5}", 1.0) for i in range(80)]
    examples = spark.createDataFrame(rows, "row_id long, label double, feature string, value double")
    linear.fit_sgd_averaged(examples, shards=1)
    fm.fit_sgd_averaged(examples, n_factors=2, shards=1)
    assert seen == [4, 4]  # the shuffle partitions of the tests: long rows of a shard are not one task's
