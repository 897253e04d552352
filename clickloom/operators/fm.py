"""Factorization machines on long examples.

A model is ``(feature, w, v ARRAY<DOUBLE>)``; the row ``__bias__`` holds w0. The pairwise term uses
``(sum_i v_ik x_i)^2 - sum_i v_ik^2 x_i^2``, so one pass over a row's features is enough. Factor
sums are one aggregate column per factor, which stays in generated code.
"""

from __future__ import annotations

from functools import partial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions.expr import multiplier, pointwise_loss, sigmoid
from clickloom.functions.hashing import hash_int, hash_weight
from clickloom.operators import passes
from clickloom.operators.history import note, observed
from clickloom.operators.layout import ModelLookup, by_row, lookup, per_row
from clickloom.operators.linear import count_rows
from clickloom.session import BROADCAST_ROWS, cut_lineage
from clickloom.sources.params import BIAS


def initial_model(examples: DataFrame, n_factors: int, scale: float = 0.1) -> DataFrame:
    """Reproducible start model for every feature in the data, bias 0."""
    vector = F.array(*[hash_weight(F.col("feature"), F.lit(k), scale=scale) for k in range(n_factors)])
    features = examples.select("feature").distinct()
    model = features.select("feature", hash_weight(F.col("feature"), scale=scale).alias("w"), vector.alias("v"))
    spark = examples.sparkSession
    bias = spark.range(1).select(
        F.lit(BIAS).alias("feature"), F.lit(0.0).alias("w"), F.array(*[F.lit(0.0)] * n_factors).alias("v")
    )
    return model.unionByName(bias)


def join_parts(weights: DataFrame, factors: DataFrame, n_factors: int) -> DataFrame:
    """``weights`` and long ``factors(feature, k, v)`` to one model table."""
    at = [F.coalesce(F.max(F.when(F.col("k") == k, F.col("v"))), F.lit(0.0)) for k in range(n_factors)]
    packed = factors.groupBy("feature").agg(F.array(*at).alias("v"))
    zero = F.array(*[F.lit(0.0)] * n_factors)
    return weights.select("feature", "w").join(packed, "feature", "full_outer").select(
        "feature", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("v", zero).alias("v")
    )


def split_parts(model: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A model table to ``weights(feature, w)`` and ``factors(feature, k, v)``."""
    factors = model.filter(F.col("feature") != BIAS).select("feature", F.posexplode("v").alias("k", "v"))
    return model.select("feature", "w"), factors


def _bias(model: DataFrame) -> float:
    row = model.filter(F.col("feature") == BIAS).select("w").first()
    return float(row["w"]) if row else 0.0


def _linear() -> Column:
    return F.col("value") * F.coalesce("w", F.lit(0.0))


def _vx(k: int) -> Column:
    return F.coalesce(F.get("v", F.lit(k)), F.lit(0.0)) * F.col("value")


def _total(linear: Column, sums: list[Column], squares: list[Column], bias: Column) -> Column:
    pairs = sum((s * s - q for s, q in zip(sums, squares)), F.lit(0.0))
    return bias + linear + F.lit(0.5) * pairs


def predict(examples: DataFrame, model: DataFrame, n_factors: int, link: str = "raw") -> DataFrame:
    """``(row_id, label, score)``; the bias is a scalar subquery of the model."""
    ks = range(n_factors)
    joined = lookup(examples, model.select("feature", "w", "v"), ["feature"])
    rows = joined.groupBy("row_id", "label").agg(
        F.sum(_linear()).alias("lin"),
        *[F.sum(_vx(k)).alias(f"s{k}") for k in ks],
        *[F.sum(_vx(k) * _vx(k)).alias(f"q{k}") for k in ks],
    )
    bias = model.agg(F.coalesce(F.max(F.when(F.col("feature") == BIAS, F.col("w"))), F.lit(0.0)))
    total = _total(F.col("lin"), [F.col(f"s{k}") for k in ks], [F.col(f"q{k}") for k in ks], bias.scalar())
    scored = rows.select("row_id", "label", total.alias("score"))
    return scored.withColumn("score", sigmoid(F.col("score"))) if link == "logistic" else scored


def _scored(joined: DataFrame, bias: Column, n_factors: int, loss: str) -> DataFrame:
    """Feature rows with their row's factor sums ``s0..`` and loss multiplier ``m``."""
    ks = range(n_factors)
    sums = joined.select(
        "*",
        per_row(_linear()).alias("lin"),
        *[per_row(_vx(k)).alias(f"s{k}") for k in ks],
        per_row(sum((_vx(k) * _vx(k) for k in ks), F.lit(0.0))).alias("sq"),
    )
    pairs = sum((F.col(f"s{k}") * F.col(f"s{k}") for k in ks), F.lit(0.0)) - F.col("sq")
    score = bias + F.col("lin") + F.lit(0.5) * pairs
    return sums.withColumn("score", score).withColumn("m", multiplier(F.col("label"), score, loss))


def _gradients(scored: DataFrame, n_factors: int, keep: tuple[str, ...] = (), loss: str | None = None) -> DataFrame:
    """``(feature, gw, gv, rows)`` summed over the data; the bias row sums the multipliers.

    A row's multiplier is spread over its features so that the bias needs no second pass; with ``loss`` its loss is, too (``part``).
    """
    part = [F.sum(pointwise_loss(F.col("label"), F.col("score"), loss) / F.col("nnz")).alias("part")] if loss else []
    x = F.col("value")
    per_factor = [F.sum(F.col("m") * x * (F.col(f"s{k}") - _vx(k))).alias(f"g{k}") for k in range(n_factors)]
    features = scored.groupBy(*keep, "feature").agg(
        F.sum(F.col("m") * x).alias("gw"), *per_factor, F.sum(F.col("m") / F.col("nnz")).alias("gb"), F.count("*").alias("rows"), *part
    )
    return features.select(
        *keep, "feature", "gw", F.array(*[F.col(f"g{k}") for k in range(n_factors)]).alias("gv"), "gb", "rows", *(["part"] if loss else [])
    )


def gradient(examples: DataFrame, model: DataFrame, n_factors: int, loss: str = "exp", bias: float | None = None) -> DataFrame:
    """``(feature, gw, gv, gb, rows)``; the sum of ``gb`` is the bias gradient."""
    w0 = _bias(model) if bias is None else bias
    joined = lookup(examples, model.select("feature", "w", "v"), ["feature"])
    joined = joined.withColumn("nnz", per_row(F.lit(1.0)))
    return _gradients(_scored(joined, F.lit(w0), n_factors, loss), n_factors)


def update(model: DataFrame, grads: DataFrame, step: float, lams: tuple[float, float, float], scale: float = 1.0) -> DataFrame:
    """Gradient step with separate L2 strengths for bias, linear and factor parts."""
    lam0, lam1, lam2 = (F.lit(float(v)) for v in lams)
    rate, s = F.lit(float(step)), F.lit(float(scale))
    bias_grad = grads.agg(F.sum("gb")).scalar()
    joined = model.select("feature", "w", "v").join(grads.select("feature", "gw", "gv"), "feature", "left")
    is_bias = F.col("feature") == BIAS
    grad = F.when(is_bias, bias_grad).otherwise(F.coalesce("gw", F.lit(0.0))) * s
    w = F.col("w") - rate * (grad + F.when(is_bias, lam0).otherwise(lam1) * F.col("w"))
    zero = F.transform("v", lambda _: F.lit(0.0))
    moved = F.zip_with("v", F.coalesce("gv", zero), lambda v, g: v - rate * (g * s + lam2 * v))
    return joined.select("feature", w.alias("w"), F.when(is_bias, F.col("v")).otherwise(moved).alias("v"))


def regularized_loss(examples: DataFrame, model: DataFrame, n_factors: int, lams: tuple[float, float, float], loss: str = "exp") -> DataFrame:
    """One row: mean loss, the L2 penalty of the three parts, and their sum."""
    fit = predict(examples, model, n_factors).agg(
        F.avg(pointwise_loss(F.col("label"), F.col("score"), loss)).alias("loss")
    )
    is_bias = F.col("feature") == BIAS
    square_v = F.aggregate("v", F.lit(0.0), lambda acc, v: acc + v * v)
    lam = F.when(is_bias, F.lit(float(lams[0]))).otherwise(F.lit(float(lams[1])))
    each = F.lit(0.5) * (lam * F.col("w") * F.col("w") + F.when(is_bias, 0.0).otherwise(F.lit(float(lams[2])) * square_v))
    penalty = model.agg(F.sum(each).alias("penalty"))
    both = fit.withColumn("penalty", penalty.scalar())
    return both.withColumn("objective", F.col("loss") + F.col("penalty"))


def fit_gradient(
    examples: DataFrame,
    model: DataFrame | None = None,
    n_factors: int = 4,
    iterations: int = 10,
    alpha: float = 1.0,
    lams: tuple[float, float, float] = (0.0, 0.0, 0.0),
    loss: str = "exp",
    broadcast_rows: int = BROADCAST_ROWS,
    history: list | None = None,
) -> DataFrame:
    """Full-batch gradient descent on the mean loss, step ``alpha / sqrt(t)``; ``history`` receives ``(iteration, mean loss before the step)``."""
    with by_row(examples.withColumn("nnz", per_row(F.lit(1.0)))) as arranged:
        current = cut_lineage(model if model is not None else initial_model(arranged, n_factors))
        rows = count_rows(arranged)
        join = ModelLookup(arranged, ["feature"], broadcast_rows // max(1, n_factors))
        for t in range(1, iterations + 1):
            scored = _scored(join.join(current), F.lit(_bias(current)), n_factors, loss)
            grads = _gradients(scored, n_factors, loss=loss if history is not None else None)
            grads, seen = observed(grads, F.sum("part") / F.lit(float(rows)), history)
            current = cut_lineage(update(current, grads, alpha / t**0.5, lams, 1.0 / rows))
            note(history, t, seen)
    return current


FM_SCHEMA = "shard int, feature string, w double, v array<double>, rows long, amount_w double, amount_v double"


def fit_sgd_averaged(
    examples: DataFrame,
    model: DataFrame | None = None,
    n_factors: int = 4,
    iterations: int = 1,
    alpha: float = 0.1,
    lams: tuple[float, float, float] = (0.0, 0.0, 0.0),
    loss: str = "exp",
    shards: int = passes.SHARDS,
) -> DataFrame:
    """Parallel SGD with model averaging; the state of a shard is bias, weights and factors."""
    if alpha * max(lams) >= 1:
        raise ValueError("alpha * lam must be below 1")
    current = cut_lineage(model if model is not None else initial_model(examples, n_factors))
    shard = (hash_int(F.col("row_id")) % shards).cast("int")
    sharded = examples.select("row_id", "label", "feature", "value", shard.alias("shard"))
    placed = passes.place_rows(sharded).persist(StorageLevel.MEMORY_AND_DISK)
    zero = F.array(*[F.lit(0.0)] * n_factors)
    inputs = ["label", "feature", "value", "w", "v"]
    try:
        placed.count()
        join = ModelLookup(placed, ["feature"], BROADCAST_ROWS // max(1, n_factors))
        for _ in range(iterations):
            packed = passes.pack(join.join(current), ["shard"], ["row_id", "label"], {"w": F.lit(0.0), "v": zero})
            learner = partial(passes.FmSgdPass, alpha, lams, _bias(current), loss)
            done = cut_lineage(passes.run_pass(packed, ["shard"], ["row_id"], inputs, learner, FM_SCHEMA))
            current = cut_lineage(_average(current, done))
    finally:
        placed.unpersist()
    return current


def _average(old: DataFrame, done: DataFrame) -> DataFrame:
    """Row-weighted mean; features a shard did not see enter with their shrunk old value."""
    stats = done.filter(F.col("feature").isNull()).select("w", "rows", "amount_w", "amount_v").collect()  # per shard
    total = float(sum(s["rows"] for s in stats))
    shares = [(s["rows"] / total, s) for s in stats]
    bias = sum(share * s["w"] for share, s in shares)
    keep_w = sum((F.lit(share) * F.exp(F.lit(s["amount_w"])) for share, s in shares), F.lit(0.0))
    keep_v = sum((F.lit(share) * F.exp(F.lit(s["amount_v"])) for share, s in shares), F.lit(0.0))
    share = F.col("rows") / F.lit(total)
    size = len(old.select("v").first()["v"])
    seen = done.filter(F.col("feature").isNotNull()).groupBy("feature").agg(
        F.sum(share * F.col("w")).alias("w_seen"),
        F.array(*[F.sum(share * F.get("v", F.lit(k))) for k in range(size)]).alias("v_seen"),
        F.sum(share * F.exp("amount_w")).alias("kw"),
        F.sum(share * F.exp("amount_v")).alias("kv"),
    )
    zero = F.array(*[F.lit(0.0)] * size)
    joined = old.join(seen, "feature", "full_outer")
    w0, v0 = F.coalesce("w", F.lit(0.0)), F.coalesce("v", zero)
    w = w0 * (keep_w - F.coalesce("kw", F.lit(0.0))) + F.coalesce("w_seen", F.lit(0.0))
    rest = keep_v - F.coalesce("kv", F.lit(0.0))
    v = F.zip_with(v0, F.coalesce("v_seen", zero), lambda a, b: a * rest + b)
    is_bias = F.col("feature") == BIAS
    return joined.select("feature", F.when(is_bias, F.lit(bias)).otherwise(w).alias("w"), F.when(is_bias, v0).otherwise(v).alias("v"))


def fit_fm(examples: DataFrame, method: str = "sgd", **options) -> DataFrame:
    """Train by ``sgd`` (averaged) or ``gradient`` (full batch)."""
    methods = {"sgd": fit_sgd_averaged, "gradient": fit_gradient}
    if method not in methods:
        raise ValueError(f"method must be one of {sorted(methods)}, got {method!r}")
    return methods[method](examples, **options)
