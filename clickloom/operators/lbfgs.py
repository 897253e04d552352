"""Limited-memory quasi-Newton fits whose vectors are tables.

Coefficients, gradients and the last steps are columns of one table on the feature (or on entity and feature). Only
products of whole vectors reach the driver: at most ``6 * memory + 8`` sums per pass, whatever the number of features. The two
loops of the recursion run on the coefficients of those vectors, and the new direction is one column expression.
L1 uses the orthant-wise variant: the pseudo-gradient of least size, and steps that stop where a coefficient would change its sign.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions.expr import multiplier, pointwise_loss
from clickloom.operators.layout import EntityRows, ModelLookup, by_entity, by_row, per_row
from clickloom.session import BROADCAST_ROWS, cut_lineage

MEMORY = 8
_ENOUGH = 1e-4  # share of the promised decrease that a step must bring
_HALVINGS = 30


class Products:
    """Products of the basis vectors: the kept steps, the kept changes of the gradient, and the (pseudo-)gradient last."""

    def __init__(self, memory: int):
        self.memory, self.steps, self.table = memory, 0, np.zeros((1, 1))

    def push(self, row_s: list[float], row_y: list[float], ss: float, sy: float, yy: float, row_g: list[float], gs: float, gy: float, gg: float) -> None:
        """Add a step and its gradient change; the rows are products with the vectors kept so far."""
        k = self.steps
        old = self.table[: 2 * k, : 2 * k]
        full = np.zeros((2 * k + 3, 2 * k + 3))
        place = [*range(k), *range(k + 1, 2 * k + 1)]
        s, y, g = k, 2 * k + 1, 2 * k + 2
        full[np.ix_(place, place)] = old
        for at, row in ((s, row_s), (y, row_y), (g, row_g)):
            full[at, place] = full[place, at] = row
        full[s, s], full[y, y], full[g, g] = ss, yy, gg
        full[s, y] = full[y, s] = sy
        full[s, g] = full[g, s] = gs
        full[y, g] = full[g, y] = gy
        self.steps = k + 1
        if self.steps > self.memory:  # forget the oldest
            keep = [i for i in range(len(full)) if i not in (0, self.steps)]
            full, self.steps = full[np.ix_(keep, keep)], self.memory
        self.table = full

    def gradient(self, row_g: list[float], gg: float) -> None:
        """Replace the products of the gradient only (the step was of no use for the curvature)."""
        n = 2 * self.steps
        self.table[n, :n] = self.table[:n, n] = row_g
        self.table[n, n] = gg

    def direction(self) -> np.ndarray:
        """Coefficients of the next direction in the basis (two loops)."""
        k, d = self.steps, self.table
        q = np.zeros(2 * k + 1)
        q[2 * k] = -1.0
        if not k:
            return q
        alpha = np.zeros(k)
        for i in reversed(range(k)):
            alpha[i] = (d[i] @ q) / d[i, k + i]
            q[k + i] -= alpha[i]
        q *= d[k - 1, 2 * k - 1] / d[2 * k - 1, 2 * k - 1]
        for i in range(k):
            q[i] += alpha[i] - (d[k + i] @ q) / d[i, k + i]
        return q


def pseudo_gradient(w: Column, g: Column, lam: float, reg: str) -> Column:
    """Slope of the objective: ``g`` includes the penalty for L2; for L1 the least of the possible slopes."""
    if reg == "l2":
        return g
    at_zero = F.when(g < -lam, g + lam).when(g > lam, g - lam).otherwise(F.lit(0.0))
    return F.when(w > 0, g + lam).when(w < 0, g - lam).otherwise(at_zero)


def _combined(q: np.ndarray, k: int, pg: Column) -> Column:
    """The direction on one row of the table."""
    out = F.lit(float(q[2 * k])) * pg
    for i in range(k):
        out = out + F.lit(float(q[i])) * F.get("hs", F.lit(i)) + F.lit(float(q[k + i])) * F.get("hy", F.lit(i))
    return out


class _Objective:
    """Loss and gradient of candidate weights over the examples, per key of the model."""

    def __init__(self, arranged: DataFrame, on: list[str], loss: str, broadcast_rows: int, entities: EntityRows | None = None):
        self.on, self.loss, self.entities = on, loss, entities
        self.model = ModelLookup(arranged, on, broadcast_rows)
        self.offset = F.col("offset") if "offset" in arranged.columns else F.lit(0.0)

    def of(self, weights: DataFrame) -> DataFrame:
        """(key, grad, part): summed gradient, and the key's part of the summed loss (a row's loss is shared by its features)."""
        candidate = weights.select(*self.on, F.col("new").alias("w"))
        if self.entities:
            return self.entities.gradient(candidate, self.loss).drop("rows")
        joined = self.model.join(candidate)
        score = per_row(F.col("value") * F.coalesce("w", F.lit(0.0))) + self.offset
        scored = joined.withColumn("score", score).withColumn("_share", per_row(F.lit(1.0)))
        label, s = F.col("label"), F.col("score")
        grad = multiplier(label, s, self.loss) * F.col("value")
        part = pointwise_loss(label, s, self.loss) / F.col("_share")
        return scored.groupBy(*self.on).agg(F.sum(grad).alias("grad"), F.sum(part).alias("part"))


def fit_lbfgs(
    examples: DataFrame,
    weights: DataFrame | None = None,
    iterations: int = 100,
    lam: float = 0.0,
    reg: str = "l2",
    tol: float = 1e-6,
    loss: str = "exp",
    keys: tuple[str, ...] = ("feature",),
    normalizer: DataFrame | None = None,
    memory: int = MEMORY,
    history: list | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    placed: bool = False,
) -> DataFrame:
    """Minimise mean loss + lam/2 |w|^2 (or lam |w|_1) by L-BFGS (or OWL-QN); rows may have an ``offset``.

    Stops when no entry of the (pseudo-)gradient is above ``tol``, or no step lowers the objective. With
    ``keys=("entity_id", "feature")`` and ``normalizer(entity_id, rows)`` the sum of all entities' objectives is minimised, which is
    the same as fitting each of them. ``history`` receives ``(iteration, objective)`` before each step.
    """
    if reg not in ("l1", "l2"):
        raise ValueError(f"regularizer must be 'l1' or 'l2', got {reg!r}")
    on = list(keys)
    lam1, lam2 = (lam, 0.0) if reg == "l1" else (0.0, lam)
    with by_row(examples, placed=placed) as arranged, by_entity(arranged, on, broadcast_rows) as entities:
        names = arranged.select(*on).distinct()
        if normalizer is not None:
            names = names.join(normalizer, on[:-1])
        else:
            names = names.withColumn("rows", F.lit(float(arranged.groupBy("row_id").agg(F.lit(1)).count())))
        if weights is not None:
            names = names.join(weights.select(*on, F.col("w").alias("new")), on, "left").fillna(0.0, ["new"])
        else:
            names = names.withColumn("new", F.lit(0.0))
        objective, products = _Objective(arranged, on, loss, broadcast_rows, entities), Products(memory)
        if entities:  # the table stays where it is; gradients come to it
            names = names.repartition(int(arranged.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)
        none = F.array().cast("array<double>")

        def measured(table: DataFrame) -> DataFrame:
            """Evaluate ``new``: one pass over the examples, kept with the table's columns."""
            found = table.join(objective.of(table), on)
            mean = F.col("grad") / F.col("rows") + F.lit(lam2) * F.col("new")
            return cut_lineage(found.withColumn("g_new", mean).withColumn("part", F.col("part") / F.col("rows")).drop("grad"))

        new, pg_new = F.col("new"), pseudo_gradient(F.col("new"), F.col("g_new"), lam1, reg)
        value = F.sum(F.col("part") + F.lit(lam2 / 2) * new * new + F.lit(lam1) * F.abs(new)).alias("value")
        steepest = F.max(F.abs(pg_new)).alias("steepest")
        now = measured(names.withColumns({"hs": none, "hy": none}))
        got = now.agg(value, steepest, F.sum(pg_new * pg_new).alias("gg")).first()
        products.table[0, 0] = got["gg"] or 0.0
        for t in range(1, iterations + 1):
            if history is not None:
                history.append((t, got["value"]))
            if got["steepest"] is None or got["steepest"] <= tol:
                break
            table = now.select(*on, "rows", F.col("new").alias("w"), F.col("g_new").alias("g"), "hs", "hy")
            step = _search(table, measured, products, got, value, steepest, lam1, reg, memory)
            if step is None:
                break
            now, got = step
        out = now.select(*on, F.col("new").alias("w"))
    if weights is not None:  # features without rows: at the optimum of the penalty, or where they were
        rest = weights.join(out.select(*on), on, "left_anti")
        out = out.unionByName(rest.select(*on, (F.lit(0.0) if lam > 0 else F.col("w")).alias("w")))
    return out


def _search(table, measured, products: Products, got, value: Column, steepest: Column, lam1: float, reg: str, memory: int):
    """Halve the step along the direction until the objective falls enough; None where it never does.

    Returns the table at the new point, with the step and the gradient's change added to the kept ones, and its sums.
    """
    k, q = products.steps, products.direction()
    w, pg = F.col("w"), pseudo_gradient(F.col("w"), F.col("g"), lam1, reg)
    p = _combined(q, k, pg)
    if reg == "l1":  # no part of the direction may go uphill
        p = F.when(p * pg < 0, p).otherwise(F.lit(0.0))
    size = 1.0 if k else min(1.0, 1.0 / max(products.table[0, 0], 1e-300) ** 0.5)
    s, y = F.col("new") - w, F.col("g_new") - F.col("g")
    pg_new = pseudo_gradient(F.col("new"), F.col("g_new"), lam1, reg)
    kept = [F.get(c, F.lit(i)) for c in ("hs", "hy") for i in range(memory)]  # null beyond those kept: one plan for all steps
    sums = {"ss": s * s, "sy": s * y, "yy": y * y, "gs": pg_new * s, "gy": pg_new * y, "gg": pg_new * pg_new, "promised": pg * s}
    for name, vector in (("s", s), ("y", y), ("g", pg_new)):
        sums |= {f"{name}{i}": vector * b for i, b in enumerate(kept)}
    for _ in range(_HALVINGS):
        to = w + F.lit(float(size)) * p
        if reg == "l1":  # stay in the orthant of the point, or of the way down from zero
            side = F.when(w != 0, F.signum(w)).otherwise(-F.signum(pg))
            to = F.when(to * side > 0, to).otherwise(F.lit(0.0))
        tried = measured(table.withColumn("new", to))
        r = tried.agg(value, steepest, *[F.sum(c).alias(n) for n, c in sums.items()]).first()
        if r["ss"] == 0.0:
            return None
        if r["value"] <= got["value"] + _ENOUGH * r["promised"]:
            break
        size /= 2
    else:
        return None
    rows = [[r[f"{name}{i}"] for i in (*range(k), *range(memory, memory + k))] for name in "syg"]
    if r["sy"] > 1e-12 * r["yy"]:
        products.push(rows[0], rows[1], r["ss"], r["sy"], r["yy"], rows[2], r["gs"], r["gy"], r["gg"])
        last = lambda kept, new: F.slice(F.concat(kept, F.array(new)), F.lit(max(1, k + 2 - memory)), F.lit(memory))
        tried = tried.withColumns({"hs": last(F.col("hs"), s), "hy": last(F.col("hy"), y)})
    else:
        products.gradient(rows[2], r["gg"])
    return tried, r
