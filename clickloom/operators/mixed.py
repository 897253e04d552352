"""Mixed model: one global weight vector plus one per entity.

Weights are ``(model_key, feature, w)`` with key ``''`` for the fixed effect. Each block is trained
with the other block's contribution as a per-row offset, so nothing is rescored incrementally and
entities or features without a weight simply contribute 0.
"""

from __future__ import annotations

from functools import partial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions.expr import sigmoid
from clickloom.functions.hashing import hash_int, hash_weight
from clickloom.operators import linear, passes
from clickloom.operators.layout import ENTITY_FEATURES, by_entity, by_row, lookup, per_row
from clickloom.operators.metrics import evaluate
from clickloom.session import cut_lineage

FIXED = ""


def fixed_of(weights: DataFrame) -> DataFrame:
    return weights.filter(F.col("model_key") == FIXED).select("feature", "w")


def random_of(weights: DataFrame) -> DataFrame:
    return weights.filter(F.col("model_key") != FIXED).select(F.col("model_key").alias("entity_id"), "feature", "w")


def combine(fixed: DataFrame, random: DataFrame) -> DataFrame:
    keyed = random.select(F.col("entity_id").alias("model_key"), "feature", "w")
    return fixed.select(F.lit(FIXED).alias("model_key"), "feature", "w").unionByName(keyed)


def initial_model(examples: DataFrame, scale: float = 0.1) -> DataFrame:
    """Reproducible start weights for every feature and every (entity, feature) in the data."""
    pairs = examples.select("entity_id", "feature").distinct()
    random = pairs.withColumn("w", hash_weight(F.col("entity_id"), F.col("feature"), scale=scale))
    return combine(linear.initial_weights(examples, scale), random)


def _with_both(examples: DataFrame, weights: DataFrame) -> DataFrame:
    fixed = fixed_of(weights).withColumnRenamed("w", "w_fixed")
    random = random_of(weights).withColumnRenamed("w", "w_random")
    return lookup(lookup(examples, fixed, ["feature"]), random, ["entity_id", "feature"])


def _part(name: str) -> Column:
    return F.col("value") * F.coalesce(name, F.lit(0.0))


def score(examples: DataFrame, weights: DataFrame, link: str = "raw") -> DataFrame:
    """``(row_id, label, entity_id, score)`` = fixed part + the entity's part."""
    total = F.sum(_part("w_fixed") + _part("w_random"))
    out = _with_both(examples, weights).groupBy("row_id", "label", "entity_id").agg(total.alias("score"))
    return out.withColumn("score", sigmoid(F.col("score"))) if link == "logistic" else out


def block_scores(examples: DataFrame, weights: DataFrame) -> DataFrame:
    """Both contributions of every row: ``(row_id, label, entity_id, fixed, random)``."""
    return (
        _with_both(examples, weights)
        .groupBy("row_id", "label", "entity_id")
        .agg(F.sum(_part("w_fixed")).alias("fixed"), F.sum(_part("w_random")).alias("random"))
    )


def rescore(scores: DataFrame, examples: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """New score of each row when one block changes: ``old score - x.old + x.new``.

    ``old`` and ``new`` are ``(feature, w)`` of the fixed effect or ``(entity_id, feature, w)``.
    """
    on = [c for c in ("entity_id", "feature") if c in new.columns]
    change = old.select(*on, F.col("w").alias("w_old")).join(new.select(*on, F.col("w").alias("w_new")), on, "full_outer")
    delta = change.select(*on, (F.coalesce("w_new", F.lit(0.0)) - F.coalesce("w_old", F.lit(0.0))).alias("w"))
    moved = lookup(examples, delta, on).groupBy("row_id").agg(F.sum(_part("w")).alias("delta"))
    return scores.join(moved, "row_id", "left").withColumn(
        "score", F.col("score") + F.coalesce("delta", F.lit(0.0))
    ).drop("delta")


def _with_offset(examples: DataFrame, weights: DataFrame, on: list[str]) -> DataFrame:
    """Add the contribution of one block as ``offset`` on every feature row (no join back)."""
    joined = lookup(examples, weights, on)
    return joined.withColumn("offset", per_row(_part("w"))).drop("w")


def _with_random_offset(arranged: DataFrame, random: DataFrame) -> DataFrame:
    """The entities' part as ``offset`` on rows laid out by :func:`by_row`; one number per row goes back to its place."""
    arranged = arranged.drop("offset")
    with by_entity(arranged, ["entity_id", "feature"]) as entities:
        if not entities:
            return _with_offset(arranged, random, ["entity_id", "feature"])
        parts = cut_lineage(entities.scored(random).select("row_id", F.col("score").alias("offset")))
    return arranged.join(parts, "row_id", "left").fillna(0.0, ["offset"])


def fixed_step(examples: DataFrame, weights: DataFrame, step: float, lam: float, reg: str = "l2", loss: str = "exp") -> DataFrame:
    """One gradient step of the fixed effect; the entities' part is the offset."""
    data = _with_offset(examples, random_of(weights), ["entity_id", "feature"])
    grads = linear.gradient(data, fixed_of(weights), loss).drop("rows")
    rows = data.agg(F.count_distinct("row_id").alias("n")).first()["n"]
    return linear.update(fixed_of(weights), grads, step, lam, reg, scale=1.0 / rows)


def random_step(examples: DataFrame, weights: DataFrame, step: float, lam: float, reg: str = "l2", loss: str = "exp") -> DataFrame:
    """One gradient step of every entity's model on its own mean loss; the fixed part is the offset.

    All entities are one aggregation on (entity, feature); no entity's rows are collected.
    """
    data = _with_offset(examples, fixed_of(weights), ["feature"])
    joined = lookup(data, random_of(weights), ["entity_id", "feature"])
    grads = linear._gradient_of(joined, loss, ("entity_id", "feature")).drop("rows")
    mean = grads.join(entity_rows(examples), "entity_id").select(
        "entity_id", "feature", (F.col("grad") / F.col("rows")).alias("grad")
    )
    return linear.update(random_of(weights), mean, step, lam, reg, keys=("entity_id", "feature"))


def entity_rows(examples: DataFrame) -> DataFrame:
    """Examples per entity."""
    return examples.select("entity_id", "row_id").distinct().groupBy("entity_id").agg(F.count("*").alias("rows"))


def _own() -> Column:
    """Aggregate: the weights of a model of few features as one map."""
    return F.map_from_entries(F.collect_list(F.struct("feature", F.coalesce("w", F.lit(0.0)))))


def _weight(own: str, cell: Column) -> Column:
    return F.coalesce(F.try_element_at(own, cell["feature"]), F.lit(0.0))


def _with_scores(rows: DataFrame, own: str, name: str) -> DataFrame:
    part = F.aggregate("cells", F.lit(0.0), lambda total, c: total + c["value"] * _weight(own, c))
    return rows.withColumn(name, part)


def _inputs(own: str, offset: str, *keys: Column) -> list:
    """Columns of :class:`passes.SgdPass` from packed rows."""
    start = F.transform("cells", lambda c: _weight(own, c)).alias("w")
    return [*keys, "row_id", "label", F.col(offset).alias("offset"), F.col("cells.feature").alias("feature"), F.col("cells.value").alias("value"), start]


def _fit_sgd(examples, iterations, alpha, lam, reg, loss, shards, validate, history) -> DataFrame:
    """:func:`fit_mixed` by passes for both blocks, for models of few features.

    Rows are packed and placed by entity in one exchange and stay there. A model of an entity meets them as one row, the fixed one as a
    value; only the packed rows of the fixed effect's pass move again. All rows of an entity are one pass, and so one task's.
    """
    for r, step, strength in zip(reg, alpha, lam):
        linear._check_reg(r)
        if r == "l2" and step * strength >= 1:
            raise ValueError("alpha * lam must be below 1")
    n = int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = examples.select("entity_id", "row_id", "label", F.struct("feature", "value").alias("cell")).repartition(n, "entity_id")
    packed = cells.groupBy("entity_id", "row_id", "label").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    rows = packed.sortWithinPartitions("entity_id", "row_id").persist(StorageLevel.MEMORY_AND_DISK)
    inputs = ["label", "offset", "feature", "value", "w"]
    try:
        weights = cut_lineage(initial_model(rows.select("entity_id", F.inline("cells"))))
        for i in range(iterations):
            fixed, random = fixed_of(weights), random_of(weights)
            own = random.filter(F.col("feature").isNotNull()).groupBy("entity_id").agg(_own().alias("own"))
            whole = lambda model: model.filter(F.col("feature").isNotNull()).agg(_own()).scalar()
            both = rows.join(own, "entity_id", "left").withColumn("every", whole(fixed))
            shard = (hash_int(F.col("row_id")) % shards).cast("int").alias("shard")
            data = _with_scores(both, "own", "random").select(*_inputs("every", "random", shard))
            learner = partial(passes.SgdPass, alpha[0], lam[0], reg[0], loss)
            done = cut_lineage(passes.run_pass(data, ["shard"], ["row_id"], inputs, learner, linear.SGD_SCHEMA))
            fixed = cut_lineage(linear.average_models(fixed, done, reg[0]))
            both = rows.join(own, "entity_id", "left").withColumn("every", whole(fixed)).filter("entity_id <> ''")
            data = _with_scores(both, "every", "fixed").select(*_inputs("own", "fixed", F.col("entity_id"), F.lit(0).alias("shard")))
            learner = partial(passes.SgdPass, alpha[1], lam[1], reg[1], loss)
            done = passes.run_pass(data, ["entity_id", "shard"], ["row_id"], inputs, learner, linear.KEYED_SCHEMA, placed=True)
            # every weight of an entity is of a feature of its rows, so its pass reports all of them
            touched = done.filter(F.col("feature").isNotNull())
            weights = cut_lineage(combine(fixed, touched))
            if history is not None:
                history.append({"iteration": i + 1, **evaluate(score(validate if validate is not None else examples, weights), loss).first().asDict()})
    finally:
        rows.unpersist()
    return weights


def fit_mixed(
    examples: DataFrame,
    iterations: int = 3,
    method: tuple[str, str] = ("majorized", "majorized"),
    alpha: tuple[float, float] = (0.1, 0.1),
    lam: tuple[float, float] = (0.0, 0.1),
    reg: tuple[str, str] = ("l2", "l2"),
    loss: str = "exp",
    inner: int = 10,
    shards: int = passes.SHARDS,
    validate: DataFrame | None = None,
    history: list | None = None,
    tol: float = 1e-6,
) -> DataFrame:
    """Block coordinate descent: fixed effect, then all random effects, ``iterations`` times.

    ``method`` per block: ``sgd`` (sequential passes, averaged), ``majorized`` (``inner`` exact
    majorisation steps) or ``lbfgs`` (up to ``inner`` quasi-Newton steps on the same objective, down to ``tol``). ``history`` receives one metrics
    row per iteration on ``validate``.
    """
    if method == ("sgd", "sgd") and linear.initial_weights(examples).limit(ENTITY_FEATURES + 1).count() <= ENTITY_FEATURES:
        return _fit_sgd(examples, iterations, alpha, lam, reg, loss, shards, validate, history)
    rows_of = cut_lineage(entity_rows(examples))
    with by_row(examples) as arranged:
        weights = cut_lineage(initial_model(arranged))
        for i in range(iterations):
            fixed, random = fixed_of(weights), random_of(weights)
            data = _with_random_offset(arranged, random)
            if method[0] == "sgd":
                fixed = linear.fit_sgd_averaged(data, fixed, 1, alpha[0], lam[0], reg[0], loss, shards)
            elif method[0] == "lbfgs":
                fixed = linear.fit_lbfgs(data, fixed, inner, lam[0], reg[0], tol, loss, placed=True)
            else:
                fixed = linear.fit_majorized(data, fixed, inner, lam[0], reg[0], loss, placed=True)
            data = _with_offset(arranged, fixed, ["feature"])
            if method[1] == "sgd":
                random = linear.fit_sgd_by_key(data, random, alpha[1], lam[1], reg[1], loss)
            elif method[1] == "lbfgs":
                random = linear.fit_lbfgs(data, random, inner, lam[1], reg[1], tol, loss, ("entity_id", "feature"), rows_of, placed=True)
            else:
                random = linear.fit_majorized(
                    data, random, inner, lam[1], reg[1], loss, ("entity_id", "feature"), rows_of, placed=True
                )
            weights = cut_lineage(combine(fixed, random))
            if history is not None:
                scored = score(validate if validate is not None else arranged, weights)
                history.append({"iteration": i + 1, **evaluate(scored, loss).first().asDict()})
    return weights
