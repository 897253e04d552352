"""Online learners as relational updates of a state table.

State: ``(part, feature, k, w, z, n, s, step)`` with one row per coordinate. ``part`` is bias /
linear / factor and ``k`` the factor number (0 elsewhere). A mini-batch is scored, its gradient is
summed per coordinate, and one expression moves the state; with batches of one row this is the
per-row algorithm. Only coordinates a batch touches change, so an update writes only those.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions.expr import soft_threshold, time_decay
from clickloom.functions.hashing import hash_weight
from clickloom.operators import fm, linear, passes
from clickloom.operators.layout import lookup, per_row
from clickloom.session import cut_lineage
from clickloom.sources.params import BIAS

STATE = ["part", "feature", "k", "w", "z", "n", "s", "step"]
COORDINATE = ["part", "feature", "k"]


class Rates:
    """Learning rates and penalties of one part."""

    def __init__(self, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0, tau: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2, self.tau = alpha, beta, l1, l2, tau


def ftrl_weight(z: Column, n: Column, r: Rates) -> Column:
    """Closed form: 0 inside the L1 band, else ``-(z - sgn(z) l1) / (l2 + (beta + sqrt n) / alpha)``."""
    scale = F.lit(r.l2) + (F.lit(r.beta) + F.sqrt(n)) / F.lit(r.alpha)
    return -soft_threshold(z, r.l1) / scale + F.lit(0.0)


def warm_z(w: Column, n: Column, r: Rates) -> Column:
    """The z whose closed form is exactly ``w``: offline models survive the first update."""
    scale = F.lit(r.l2) + (F.lit(r.beta) + F.sqrt(n)) / F.lit(r.alpha)
    return -(F.signum(w) * F.lit(r.l1) + w * scale) + F.lit(0.0)


def state_from_weights(weights: DataFrame, rates: Rates) -> DataFrame:
    """Linear state of an offline model."""
    return _new_state(weights.select(F.lit("linear").alias("part"), "feature", F.lit(0).alias("k"), "w"), {"linear": rates})


def state_from_fm(model: DataFrame, rates: dict[str, Rates]) -> DataFrame:
    """State of an offline factorization machine, all three parts."""
    part = F.when(F.col("feature") == BIAS, F.lit("bias")).otherwise(F.lit("linear"))
    flat = model.select(part.alias("part"), "feature", F.lit(0).alias("k"), "w")
    factors = model.filter(F.col("feature") != BIAS).select(
        F.lit("factor").alias("part"), "feature", F.posexplode("v").alias("k", "w")
    )
    return _new_state(flat.unionByName(factors.select("part", "feature", "k", "w")), rates)


def cold_fm_state(features: DataFrame, n_factors: int, rates: dict[str, Rates], scale: float = 0.1) -> DataFrame:
    """State with hashed ``z`` and no history; the weights follow from ``z``."""
    keys = features.select("feature").distinct()
    linear_part = keys.select(F.lit("linear").alias("part"), "feature", F.lit(0).alias("k"))
    factor_part = keys.select(
        F.lit("factor").alias("part"), "feature", F.explode(F.sequence(F.lit(0), F.lit(n_factors - 1))).alias("k")
    )
    bias = features.sparkSession.range(1).select(F.lit("bias").alias("part"), F.lit(BIAS).alias("feature"), F.lit(0).alias("k"))
    z = hash_weight(F.col("part"), F.col("feature"), F.col("k"), scale=scale)
    cells = linear_part.unionByName(factor_part).unionByName(bias).withColumn("z", z)
    w = _by_part(rates, lambda r: ftrl_weight(F.col("z"), F.lit(0.0), r))
    return cells.select(*COORDINATE, w.alias("w"), "z", *_blank("n", "s", "step"))


def _blank(*names: str) -> list[Column]:
    types = {"n": F.lit(0.0), "s": F.lit(0.0), "step": F.lit(0).cast("bigint"), "z": F.lit(0.0)}
    return [types[name].alias(name) for name in names]


def _by_part(rates: dict[str, Rates], make) -> Column:
    options = [F.when(F.col("part") == part, make(r)) for part, r in rates.items()]
    return F.coalesce(*options)


def _new_state(cells: DataFrame, rates: dict[str, Rates]) -> DataFrame:
    z = _by_part(rates, lambda r: warm_z(F.col("w"), F.lit(0.0), r))
    return cells.select(*COORDINATE, "w", z.alias("z"), *_blank("n", "s", "step"))


def weights_of(state: DataFrame) -> DataFrame:
    """Linear weights of a state."""
    return state.filter(F.col("part") == "linear").select("feature", "w")


def fm_of(state: DataFrame, n_factors: int) -> DataFrame:
    """Model table of a factorization-machine state."""
    flat = state.filter(F.col("part") != "factor").select("feature", "w")
    factors = state.filter(F.col("part") == "factor").select("feature", "k", F.col("w").alias("v"))
    return fm.join_parts(flat, factors, n_factors)


def linear_gradients(batch: DataFrame, weights: DataFrame, loss: str) -> DataFrame:
    """Summed gradient of a batch per linear coordinate."""
    grads = linear.gradient(batch, weights, loss)
    return grads.select(F.lit("linear").alias("part"), "feature", F.lit(0).alias("k"), F.col("grad").alias("g"))


def fm_gradients(batch: DataFrame, model: DataFrame, n_factors: int, loss: str) -> DataFrame:
    """Summed gradient of a batch per coordinate of all three parts."""
    grads = fm.gradient(batch, model, n_factors, loss)
    cells = F.concat(
        F.array(
            F.struct(F.lit("linear").alias("part"), F.col("feature").alias("feature"), F.lit(0).alias("k"), F.col("gw").alias("g")),
            F.struct(F.lit("bias").alias("part"), F.lit(BIAS).alias("feature"), F.lit(0).alias("k"), F.col("gb").alias("g")),
        ),
        F.transform(
            "gv", lambda g, k: F.struct(F.lit("factor").alias("part"), F.col("feature").alias("feature"), k.alias("k"), g.alias("g"))
        ),
    )
    return grads.select(F.explode(cells).alias("c")).groupBy(*[F.col(f"c.{c}").alias(c) for c in COORDINATE]).agg(
        F.sum("c.g").alias("g")
    )


def ftrl_update(state: DataFrame, grads: DataFrame, rates: dict[str, Rates], step: int) -> DataFrame:
    """New state rows of the touched coordinates (FTRL-Proximal); unknown ones start at 0."""
    joined = grads.join(state, COORDINATE, "left").fillna(0.0, ["w", "z", "n", "s"])
    n = F.col("n") + F.col("g") * F.col("g")

    def moved_z(r: Rates) -> Column:
        sigma = (F.sqrt(n) - F.sqrt("n")) / F.lit(r.alpha)
        return F.col("z") + F.col("g") - sigma * F.col("w")

    moved = joined.select(*COORDINATE, _by_part(rates, moved_z).alias("z"), n.alias("n"), "s")
    w = _by_part(rates, lambda r: ftrl_weight(F.col("z"), F.col("n"), r))
    return moved.select(*COORDINATE, w.alias("w"), "z", "n", "s", F.lit(step).cast("bigint").alias("step"))


def tdap_update(state: DataFrame, grads: DataFrame, rates: dict[str, Rates], step: int) -> DataFrame:
    """New state rows of the touched coordinates with time-decayed history.

    ``sigma = (sqrt(n + g^2) - sqrt(n)) / alpha``; with ``d`` the decay over the steps since the
    coordinate last moved, ``z = d z + sigma w - g``, ``s = d s + sigma`` and
    ``w = sgn(z) max(0, |z| - l1) / (s + l2)``. A coordinate without any step size keeps its weight.
    """
    joined = grads.join(state, COORDINATE, "left").fillna(0.0, ["w", "z", "n", "s"]).fillna(0, ["step"])
    # A fresh state row has no history to decay: its z only encodes the warm-start weight for FTRL.
    old_z = F.when(F.col("step") > 0, F.col("z")).otherwise(F.lit(0.0))
    n = F.col("n") + F.col("g") * F.col("g")

    def decay(r: Rates) -> Column:
        return time_decay((F.lit(step) - F.col("step")).cast("double"), r.tau)

    def sigma(r: Rates) -> Column:
        return (F.sqrt(n) - F.sqrt("n")) / F.lit(r.alpha)

    moved = joined.select(
        *COORDINATE,
        F.col("w").alias("old_w"),
        _by_part(rates, lambda r: decay(r) * old_z + sigma(r) * F.col("w") - F.col("g")).alias("z"),
        n.alias("n"),
        _by_part(rates, lambda r: decay(r) * F.col("s") + sigma(r)).alias("s"),
    )

    def weight(r: Rates) -> Column:
        scale = F.col("s") + F.lit(r.l2)
        return F.when(scale > 0, soft_threshold(F.col("z"), r.l1) / scale).otherwise(F.col("old_w"))

    return moved.select(
        *COORDINATE, _by_part(rates, weight).alias("w"), "z", "n", "s", F.lit(step).cast("bigint").alias("step")
    )


UPDATES = {"ftrl": ftrl_update, "tdap": tdap_update}


def merge_state(state: DataFrame, changed: DataFrame) -> DataFrame:
    """Full state after an update: changed rows replace old ones (newest step wins)."""
    both = state.select(*STATE).unionByName(changed.select(*STATE))
    newest = F.max_by(F.struct("w", "z", "n", "s", "step"), F.struct("step", "n"))
    return both.groupBy(*COORDINATE).agg(newest.alias("r")).select(*COORDINATE, "r.*")


def batch_update(
    state: DataFrame,
    batch: DataFrame,
    step: int,
    rates: dict[str, Rates],
    algorithm: str = "ftrl",
    loss: str = "exp",
    n_factors: int | None = None,
) -> DataFrame:
    """Changed state rows of one mini-batch; ``n_factors`` switches from LR to an FM."""
    if n_factors is None:
        grads = linear_gradients(batch, weights_of(state), loss)
    else:
        grads = fm_gradients(batch, fm_of(state, n_factors), n_factors, loss)
    return UPDATES[algorithm](state, grads, rates, step)


def score_batch(state: DataFrame, batch: DataFrame, n_factors: int | None = None) -> DataFrame:
    """Raw scores of a batch under the current state."""
    if n_factors is None:
        return linear.score(batch, weights_of(state))
    return fm.predict(batch, fm_of(state, n_factors), n_factors)


def train_batches(
    state: DataFrame,
    examples: DataFrame,
    batch_col: str,
    rates: dict[str, Rates],
    algorithm: str = "ftrl",
    loss: str = "exp",
    n_factors: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Run the batches in order; returns the final state and the scores before each update.

    ``batch_col`` is a small set of batch numbers (days, say), listed on the driver.
    """
    batches = sorted(r[0] for r in examples.select(batch_col).distinct().collect())
    state, scored = cut_lineage(state), None
    for step, batch_id in enumerate(batches, start=1):
        batch = examples.filter(F.col(batch_col) == F.lit(batch_id))
        before = cut_lineage(score_batch(state, batch, n_factors).withColumn("batch_id", F.lit(batch_id)))
        scored = before if scored is None else scored.unionByName(before)
        changed = batch_update(state, batch, step, rates, algorithm, loss, n_factors)
        state = cut_lineage(merge_state(state, changed))
    return state, scored


FTRL_SCHEMA = "model_key string, shard int, feature string, z double, n double, w double, rows long, hits long, loss_sum double"


def ftrl_per_key(
    examples: DataFrame,
    key: str,
    seq: str,
    rates: Rates,
    loss: str = "exp",
    shards: int = 1,
    partitions: int | None = None,
) -> DataFrame:
    """An independent FTRL model per key, one sequential pass in ``seq`` order.

    Rows of a key are streamed, not collected. With ``shards`` above 1 the rows of every key are dealt
    to as many passes whose models are averaged by rows (see :func:`average_keys`), so one key
    holding a large part of the data is not one task.
    """
    n = partitions or int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = examples.withColumn("model_key", F.col(key).cast("string"))
    placed = passes.place(passes.split_groups(keyed, shards), ["model_key", "shard"], n)
    packed = passes.pack(placed, ["model_key", "shard"], ["row_id", seq, "label"], {})
    learner = partial(passes.FtrlPass, rates.alpha, rates.beta, rates.l1, rates.l2, loss)
    return passes.run_pass(
        packed, ["model_key", "shard"], [seq, "row_id"], ["label", "feature", "value"], learner, FTRL_SCHEMA
    )


def average_keys(models: DataFrame) -> DataFrame:
    """``weights(model_key, feature, w)``: row-weighted mean over the shards of each key.

    A shard that never saw a feature holds weight 0 for it.
    """
    totals = models.select("model_key", "shard", "rows").distinct().groupBy("model_key").agg(F.sum("rows").alias("total"))
    summed = models.groupBy("model_key", "feature").agg(F.sum(F.col("w") * F.col("rows")).alias("wr"))
    return summed.join(totals, "model_key").select("model_key", "feature", (F.col("wr") / F.col("total")).alias("w"))
