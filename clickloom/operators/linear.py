"""Logistic regression on long examples ``(row_id, label, feature, value[, offset])``."""

from __future__ import annotations

from functools import partial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions.expr import multiplier, pointwise_loss, sigmoid, soft_threshold
from clickloom.functions.hashing import hash_int, hash_weight
from clickloom.operators import passes
from clickloom.operators.history import note, observed
from clickloom.operators.layout import ModelLookup, by_entity, by_row, lookup, per_row
from clickloom.operators.lbfgs import fit_lbfgs
from clickloom.session import BROADCAST_ROWS, cut_lineage

REGULARIZERS = ("l1", "l2")


def _check_reg(reg: str) -> None:
    if reg not in REGULARIZERS:
        raise ValueError(f"regularizer must be one of {REGULARIZERS}, got {reg!r}")


def initial_weights(examples: DataFrame, scale: float = 0.1, keys: tuple[str, ...] = ("feature",)) -> DataFrame:
    """Reproducible start weights for every feature in the data."""
    return examples.select(*keys).distinct().withColumn("w", hash_weight(*[F.col(k) for k in keys], scale=scale))


def _offset(examples: DataFrame) -> Column:
    return F.col("offset") if "offset" in examples.columns else F.lit(0.0)


def _term() -> Column:
    return F.col("value") * F.coalesce(F.col("w"), F.lit(0.0))


def score(examples: DataFrame, weights: DataFrame, link: str = "raw") -> DataFrame:
    """``(row_id, label, score)``: raw sum or logistic; unknown features count 0."""
    total = lookup(examples, weights.select("feature", "w"), ["feature"])
    summed = F.sum(_term()) + (F.max("offset") if "offset" in examples.columns else F.lit(0.0))
    out = total.groupBy("row_id", "label").agg(summed.alias("score"))
    if link == "logistic":
        return out.withColumn("score", sigmoid(F.col("score")))
    return out


def _row_scores(joined: DataFrame) -> DataFrame:
    return joined.withColumn("score", per_row(_term()) + _offset(joined))


def gradient(examples: DataFrame, weights: DataFrame, loss: str = "exp") -> DataFrame:
    """``(feature, grad, rows)``: summed gradient of the data set and rows per feature."""
    return _gradient_of(lookup(examples, weights.select("feature", "w"), ["feature"]), loss)


def _gradient_of(joined: DataFrame, loss: str, keys: tuple[str, ...] = ("feature",), with_loss: bool = False) -> DataFrame:
    """Summed gradient per key; ``with_loss`` adds ``part``: a row's loss, shared by its features, so that all parts make up the loss."""
    scored = _row_scores(joined)
    m = multiplier(F.col("label"), F.col("score"), loss)
    sums = [F.sum(m * F.col("value")).alias("grad"), F.count("*").alias("rows")]
    if with_loss:
        scored = scored.withColumn("_share", per_row(F.lit(1.0)))
        sums.append(F.sum(pointwise_loss(F.col("label"), F.col("score"), loss) / F.col("_share")).alias("part"))
    return scored.groupBy(*keys).agg(*sums)


def proximal_step(w: Column, grad: Column, step: Column, lam: float, reg: str) -> Column:
    """L2: ``w - step (g + lam w)``; L1: soft-threshold of ``w - step g`` by ``step lam``."""
    _check_reg(reg)
    if reg == "l2":
        return w - step * (grad + F.lit(lam) * w)
    return soft_threshold(w - step * grad, step * F.lit(lam))


def update(weights: DataFrame, grads: DataFrame, step: float, lam: float, reg: str, scale: float = 1.0, keys=("feature",)) -> DataFrame:
    """One update of every coordinate; ``scale`` turns a summed gradient into a mean."""
    w, g = F.coalesce("w", F.lit(0.0)), F.coalesce("grad", F.lit(0.0)) * F.lit(scale)
    joined = weights.select(*keys, "w").join(grads, list(keys), "full_outer")
    return joined.select(*keys, proximal_step(w, g, F.lit(float(step)), lam, reg).alias("w"))


def count_rows(arranged: DataFrame) -> int:
    """Number of examples of a frame laid out by :func:`by_row` (no shuffle)."""
    return arranged.groupBy("row_id").agg(F.lit(1).alias("one")).count()


def fit_gradient(
    examples: DataFrame,
    weights: DataFrame | None = None,
    iterations: int = 10,
    alpha: float = 1.0,
    lam: float = 0.0,
    reg: str = "l2",
    loss: str = "exp",
    history: list | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Full-batch proximal gradient descent, step ``alpha / sqrt(t)`` on the mean gradient.

    ``history`` receives ``(iteration, mean loss before the step)``, observed while the step is computed.
    """
    _check_reg(reg)
    with by_row(examples) as arranged:
        w = cut_lineage(weights.select("feature", "w") if weights is not None else initial_weights(arranged))
        rows = count_rows(arranged)
        model = ModelLookup(arranged, ["feature"], broadcast_rows)
        for t in range(1, iterations + 1):
            grads = _gradient_of(model.join(w), loss, with_loss=history is not None)
            grads, seen = observed(grads, F.sum("part") / F.lit(float(rows)), history)
            w = cut_lineage(update(w, grads, alpha / t**0.5, lam, reg, scale=1.0 / rows))
            note(history, t, seen)
    return w


def curvature(arranged: DataFrame, keys: tuple[str, ...] = ("feature",)) -> DataFrame:
    """Separable upper bound of the logistic Hessian: ``sum_i |x_ij| sum_j' |x_ij'| / 4``."""
    mass = F.abs("value") * per_row(F.abs("value")) / F.lit(4.0)
    return arranged.withColumn("c", mass).groupBy(*keys).agg(F.sum("c").alias("curve"), F.count("*").alias("rows"))


def fit_majorized(
    examples: DataFrame,
    weights: DataFrame | None = None,
    iterations: int = 50,
    lam: float = 0.0,
    reg: str = "l2",
    loss: str = "exp",
    keys: tuple[str, ...] = ("feature",),
    normalizer: DataFrame | float | None = None,
    tol: float = 1e-6,
    broadcast_rows: int = BROADCAST_ROWS,
    placed: bool = False,
    history: list | None = None,
) -> DataFrame:
    """Minimise mean loss + lam/2 |w|^2 (or lam |w|_1) without a step size.

    Every iteration minimises a separable quadratic upper bound, so the objective never rises; L1 is
    exact through the soft-threshold. With ``keys=("entity_id", "feature")`` all entities' models are
    fitted at once, however many rows one entity has; ``normalizer(entity_id, rows)`` then gives
    each entity its own mean.
    """
    _check_reg(reg)
    on = list(keys)
    with by_row(examples, placed=placed) as arranged, by_entity(arranged, on, broadcast_rows) as entities:
        bound = cut_lineage(curvature(arranged, keys))
        if isinstance(normalizer, DataFrame):
            bound = cut_lineage(bound.drop("rows").join(normalizer, on[:-1]))
        else:
            bound = bound.withColumn("rows", F.lit(float(normalizer or count_rows(arranged))))
        start = bound.select(*on).withColumn("w", F.lit(0.0))
        if weights is not None:
            start = bound.select(*on).join(weights.select(*on, "w"), on, "left").fillna(0.0, ["w"])
        w = cut_lineage(start)
        model = ModelLookup(arranged, on, broadcast_rows)
        for t in range(1, iterations + 1):
            grads = (entities.gradient(w, loss) if entities else _gradient_of(model.join(w), loss, keys, history is not None)).drop("rows")
            d, g, old = F.col("curve") / F.col("rows"), F.col("grad") / F.col("rows"), F.col("w")
            if reg == "l2":
                new = (d * old - g) / (d + F.lit(lam))
            else:
                new = soft_threshold(old - g / d, F.lit(lam) / d)
            if reg == "l1" or lam == 0:  # a feature of zeros only has no curvature and stays where it is
                new = F.when(d > 0, new).otherwise(old)
            joined, seen = observed(w.join(bound, on).join(grads, on), F.sum(F.col("part") / F.col("rows")), history)
            moved = cut_lineage(joined.select(*on, new.alias("w"), F.abs(new - old).alias("move")))
            note(history, t, seen)
            w = moved.select(*on, "w")
            if moved.agg(F.max("move")).first()[0] <= tol:
                break
    if weights is not None:  # features without rows: at the optimum of the penalty, or where they were
        rest = weights.join(w.select(*on), on, "left_anti")
        w = w.unionByName(rest.select(*on, (F.lit(0.0) if lam > 0 else F.col("w")).alias("w")))
    return w


SGD_SCHEMA = "shard int, feature string, w double, w0 double, rows long, amount double"


def fit_sgd_averaged(
    examples: DataFrame,
    weights: DataFrame | None = None,
    iterations: int = 1,
    alpha: float = 0.1,
    lam: float = 0.0,
    reg: str = "l2",
    loss: str = "exp",
    shards: int = passes.SHARDS,
) -> DataFrame:
    """Parallel SGD: each shard makes one sequential pass, the models are averaged by row count.

    ``shards`` is part of the model, so it does not follow the size of the data; give more of them
    where a pass would take too long.
    """
    _check_reg(reg)
    if reg == "l2" and alpha * lam >= 1:
        raise ValueError("alpha * lam must be below 1")
    w = cut_lineage(weights.select("feature", "w") if weights is not None else initial_weights(examples))
    shard = (hash_int(F.col("row_id")) % shards).cast("int")
    sharded = examples.select("row_id", "label", "feature", "value", _offset(examples).alias("offset"), shard.alias("shard"))
    placed = passes.place_rows(sharded).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        placed.count()
        model = ModelLookup(placed, ["feature"], BROADCAST_ROWS)
        learner = partial(passes.SgdPass, alpha, lam, reg, loss)
        for _ in range(iterations):
            packed = passes.pack(model.join(w), ["shard"], ["row_id", "label", "offset"], {"w": F.lit(0.0)})
            inputs = ["label", "offset", "feature", "value", "w"]
            done = cut_lineage(passes.run_pass(packed, ["shard"], ["row_id"], inputs, learner, SGD_SCHEMA))
            w = cut_lineage(average_models(w, done, reg))
    finally:
        placed.unpersist()
    return w


def _shrunk(w: Column, amount: Column, reg: str) -> Column:
    return w * F.exp(amount) if reg == "l2" else soft_threshold(w, amount)


def average_models(old: DataFrame, done: DataFrame, reg: str) -> DataFrame:
    """Row-weighted mean of the shard models.

    A shard reports the features it saw; for the others it would only have shrunk the old weight, so
    the mean is taken over all shards' shrunk weights plus the differences of the seen ones. Shards
    without rows report nothing and have no weight.
    """
    stats = done.filter(F.col("feature").isNull()).select("rows", "amount").collect()  # one row per shard
    total = float(sum(s["rows"] for s in stats))
    base = sum((F.lit(s["rows"] / total) * _shrunk(F.col("w"), F.lit(s["amount"]), reg) for s in stats), F.lit(0.0))
    delta = F.col("rows") / F.lit(total) * (F.col("w") - _shrunk(F.col("w0"), F.col("amount"), reg))
    moved = done.filter(F.col("feature").isNotNull()).groupBy("feature").agg(F.sum(delta).alias("delta"))
    known = old.join(moved, "feature", "full_outer").withColumn("w", F.coalesce("w", F.lit(0.0)))
    return known.select("feature", (base + F.coalesce("delta", F.lit(0.0))).alias("w"))


KEYED_SCHEMA = "entity_id string, shard int, feature string, w double, w0 double, rows long, amount double"


def fit_sgd_by_key(
    examples: DataFrame,
    weights: DataFrame,
    alpha: float = 0.1,
    lam: float = 0.0,
    reg: str = "l2",
    loss: str = "exp",
    shards: int = 1,
) -> DataFrame:
    """One sequential SGD pass per entity from ``weights(entity_id, feature, w)``.

    With ``shards`` above 1 the rows of every entity are dealt to as many passes, whose models are
    averaged; one large entity is then not one task. Entities without rows keep their weights.
    """
    _check_reg(reg)
    n = int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = ["entity_id", "shard"]
    sharded = passes.split_groups(examples.withColumn("offset", _offset(examples)), shards)
    joined = lookup(passes.place(sharded, group, n), weights, ["entity_id", "feature"])
    packed = passes.pack(joined, group, ["row_id", "label", "offset"], {"w": F.lit(0.0)})
    learner = partial(passes.SgdPass, alpha, lam, reg, loss)
    inputs = ["label", "offset", "feature", "value", "w"]
    done = cut_lineage(passes.run_pass(packed, group, ["row_id"], inputs, learner, KEYED_SCHEMA))
    stats = done.filter(F.col("feature").isNull()).select("entity_id", "shard", "rows", "amount")
    totals = stats.groupBy("entity_id").agg(F.sum("rows").alias("total"))
    share = F.col("rows") / F.col("total")
    base = weights.join(stats.join(totals, "entity_id"), "entity_id", "left").select(
        "entity_id",
        "feature",
        (F.coalesce(share, F.lit(1.0)) * _shrunk(F.col("w"), F.coalesce("amount", F.lit(0.0)), reg)).alias("part"),
    )
    moved = done.filter(F.col("feature").isNotNull()).join(totals, "entity_id").select(
        "entity_id", "feature", (share * (F.col("w") - _shrunk(F.col("w0"), F.col("amount"), reg))).alias("part")
    )
    return base.unionByName(moved).groupBy("entity_id", "feature").agg(F.sum("part").alias("w"))


def fit_linear(examples: DataFrame, method: str = "lbfgs", **options) -> DataFrame:
    """Train by ``sgd`` (averaged), ``lbfgs``, ``gradient`` or ``majorized``."""
    methods = {"sgd": fit_sgd_averaged, "lbfgs": fit_lbfgs, "gradient": fit_gradient, "majorized": fit_majorized}
    if method not in methods:
        raise ValueError(f"method must be one of {sorted(methods)}, got {method!r}")
    return methods[method](examples, **options)
