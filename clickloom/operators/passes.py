"""Sequential passes over sorted rows, streamed per group inside one Spark partition.

Spark partitions, shuffles and sorts the packed rows; a learner object sees the rows of one group
in order. Only the parameters a group touches are held in memory, never its rows. Each row brings
the current model values of its own features, so the model is not shipped through the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def place(examples: DataFrame, group: list[str], partitions: int) -> DataFrame:
    """Hash-partition examples on the group; an explicit number keeps later stages in place."""
    return examples.repartition(partitions, *group)


def place_rows(examples: DataFrame) -> DataFrame:
    """Hash-partition examples on the row: they are packed by all tasks, and only packed rows go to the few that pass through them."""
    return place(examples, ["row_id"], int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def split_groups(examples: DataFrame, shards: int) -> DataFrame:
    """Add ``shard``: every group is cut into as many hashed shards, whatever its size.

    The number is part of the model: one shard is a single sequential pass, more are averaged.
    """
    return examples.withColumn("shard", F.pmod(F.xxhash64("row_id"), F.lit(shards)).cast("int"))


def pack(joined: DataFrame, group: list[str], keys: list[str], values: dict[str, Column]) -> DataFrame:
    """One row per example: sorted parallel arrays of features, inputs and model values.

    ``joined`` already carries the model columns; ``values`` maps each of them to its default for
    features the model does not know. The rows may come from any layout: :func:`run_pass` brings
    the packed rows of a group together.
    """
    cells = [F.coalesce(F.col(c), default).alias(c) for c, default in values.items()]
    packed = joined.groupBy(*group, *keys).agg(
        F.sort_array(F.collect_list(F.struct("feature", "value", *cells))).alias("cells")
    )
    names = ["feature", "value", *values]
    return packed.select(*group, *keys, *[F.col(f"cells.{n}").alias(n) for n in names])


def _values(column: pa.Array) -> list:
    """As ``to_pylist``, several times faster for numbers and texts."""
    plain = pa.types.is_integer(column.type) or pa.types.is_floating(column.type)
    if pa.types.is_string(column.type) or plain and not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _rows(column: pa.Array):
    """Arrow column to one Python value per row; lists of lists become float matrices."""
    if not pa.types.is_list(column.type):
        return _values(column)
    ends = column.offsets.to_numpy()
    flat, bounds = column.flatten(), ends - ends[0]
    if pa.types.is_list(flat.type):
        cells = flat.flatten().to_numpy(zero_copy_only=False)
        flat = cells.reshape(len(flat), -1) if len(flat) else cells
    elif pa.types.is_floating(flat.type):
        flat = flat.to_numpy(zero_copy_only=False).tolist()
    else:
        flat = _values(flat)
    at = bounds.tolist()
    return [flat[i:j] for i, j in zip(at, at[1:])]


def run_pass(packed: DataFrame, group: list[str], order: list[str], inputs: list[str], learner, schema: str, placed: bool = False) -> DataFrame:
    """Feed each group's rows, in order, to ``learner()``; ``finish(key)`` yields output tuples.

    The join with the model may have moved the rows, so the packed rows are exchanged on the group
    first; a group is then one task's, whatever join Spark chose. Arrow batches stream through the
    task; a batch is turned into Python values column by column. ``placed`` rows have all rows of a group in one partition already.
    """
    width = len(group)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches):
        current, state = None, None
        for batch in batches:
            out = []
            for row in zip(*(_rows(c) for c in batch.columns)):
                key = row[:width]
                if key != current:
                    if state is not None:
                        out.extend(state.finish(current))
                    current, state = key, learner()
                state.step(*row[width:])
            if out:
                yield batch_of(out)
        if state is not None:
            yield batch_of(list(state.finish(current)))

    ordered = (packed if placed else packed.repartition(*group)).sortWithinPartitions(*group, *order)
    return ordered.select(*group, *inputs).mapInArrow(run, schema)


#: Shards of a pass with model averaging. A fixed number, since it is part of the model.
SHARDS = 4


def _multiplier(label: float, score: float, loss: str) -> float:
    if loss == "exp":
        m = label * score
        return -label * math.exp(-m) / (1.0 + math.exp(-m)) if m > 0 else -label / (1.0 + math.exp(m))
    p = 1.0 / (1.0 + math.exp(-score)) if score > 0 else math.exp(score) / (1.0 + math.exp(score))
    return p - label


def shrink(w, amount: float, reg: str):
    """What regularisation alone does to a parameter over steps of total ``amount``.

    L2: ``amount`` is the sum of ln(1 - step * lambda). L1: the sum of step * lambda.
    """
    if reg == "l2":
        return w * math.exp(amount)
    return math.copysign(max(0.0, abs(w) - amount), w) if w else 0.0


class SgdPass:
    """Logistic regression, one sequential pass with step alpha / sqrt(t).

    Regularisation of features absent from a row is applied when they are next touched, which
    gives the same numbers as updating every coordinate at every step.
    """

    def __init__(self, alpha: float, lam: float, reg: str, loss: str):
        self.alpha, self.lam, self.reg, self.loss = alpha, lam, reg, loss
        self.rows, self.amount, self.params = 0, 0.0, {}

    def step(self, label, offset, features, values, start):
        self.rows += 1
        rate, lam, amount, params = self.alpha / math.sqrt(self.rows), self.lam, self.amount, self.params
        l2, exp = self.reg == "l2", math.exp
        touched, score = [], 0.0
        for f, x, w0 in zip(features, values, start):
            p = params.get(f)
            if p is None:
                p = params[f] = [w0, 0.0, w0]
            w = p[0] * exp(amount - p[1]) if l2 else shrink(p[0], amount - p[1], "l1")
            score += w * x
            touched.append((p, x, w))
        m = _multiplier(label, offset + score, self.loss)
        if l2:
            self.amount = amount = amount + math.log1p(-rate * lam)
            for p, x, w in touched:
                p[0], p[1] = w - rate * (m * x + lam * w), amount
        else:
            cut = rate * lam
            self.amount = amount = amount + cut
            for p, x, w in touched:
                p[0], p[1] = shrink(w - rate * m * x, cut, "l1"), amount

    def finish(self, key):
        for f, (w, seen, w0) in self.params.items():
            yield (*key, f, shrink(w, self.amount - seen, self.reg), w0, self.rows, self.amount)
        yield (*key, None, 0.0, 0.0, self.rows, self.amount)


class FmSgdPass:
    """Factorization machine, one sequential pass; L2 strength per part, lazily applied.

    A parameter row is a list ``[seen1, seen2, w, v1, v2, ...]``; ``seen`` remembers up to which total shrinkage it is current.
    Rows have few features and factors, where plain floats are several times faster than small arrays.
    """

    def __init__(self, alpha: float, lams: tuple, bias: float, loss: str):
        self.alpha, self.lams, self.w0, self.loss = alpha, lams, bias, loss
        self.rows, self.a1, self.a2, self.params = 0, 0.0, 0.0, {}

    def step(self, label, features, values, start_w, start_v):
        self.rows += 1
        rate = self.alpha / math.sqrt(self.rows)
        lam0, lam1, lam2 = self.lams
        params, a1, a2 = self.params, self.a1, self.a2
        rows, score = [], self.w0
        for i, f in enumerate(features):
            p = params.get(f)
            if p is None:
                p = params[f] = [0.0, 0.0, start_w[i], *map(float, start_v[i])]
            rows.append(p)
        d1 = [math.exp(a1 - p[0]) for p in rows] if lam1 or lam2 else [1.0] * len(rows)
        d2 = [math.exp(a2 - p[1]) for p in rows] if lam1 or lam2 else d1
        weights = [p[2] * d for p, d in zip(rows, d1)]
        vectors = [[v * d for v in p[3:]] for p, d in zip(rows, d2)]
        products = [[v * x for v in vector] for vector, x in zip(vectors, values)]
        sums = [sum(c) for c in zip(*products)]
        score += sum(w * x for w, x in zip(weights, values))
        score += 0.5 * (sum(s * s for s in sums) - sum(c * c for vx in products for c in vx))
        m = _multiplier(label, score, self.loss)
        self.w0 -= rate * (m + lam0 * self.w0)
        self.a1 = a1 = a1 + math.log1p(-rate * lam1)
        self.a2 = a2 = a2 + math.log1p(-rate * lam2)
        for p, x, w, vector, vx in zip(rows, values, weights, vectors, products):
            mx = m * x
            p[:] = [a1, a2, w - rate * (mx + lam1 * w), *[v - rate * (mx * (s - c) + lam2 * v) for v, s, c in zip(vector, sums, vx)]]

    def finish(self, key):
        for f, (s1, s2, w, *v) in self.params.items():
            d2 = math.exp(self.a2 - s2)
            yield (*key, f, w * math.exp(self.a1 - s1), [c * d2 for c in v], self.rows, self.a1, self.a2)
        yield (*key, None, self.w0, None, self.rows, self.a1, self.a2)


class FtrlPass:
    """Logistic regression with FTRL-Proximal, one row at a time; also scores before each update."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float, loss: str):
        self.alpha, self.beta, self.l1, self.l2, self.loss = alpha, beta, l1, l2, loss
        self.rows, self.hits, self.loss_sum, self.state = 0, 0, 0.0, {}

    def _weight(self, z: float, n: float) -> float:
        if abs(z) <= self.l1:
            return 0.0
        return -(z - math.copysign(self.l1, z)) / (self.l2 + (self.beta + math.sqrt(n)) / self.alpha)

    def step(self, label, features, values):
        known = [self.state.get(f, (0.0, 0.0)) for f in features]
        w = [self._weight(z, n) for z, n in known]
        score = sum(a * b for a, b in zip(w, values))
        self.rows += 1
        self.hits += int((score > 0) == (label > 0))
        margin = (label if self.loss == "exp" else 2.0 * label - 1.0) * score
        self.loss_sum += math.log1p(math.exp(-abs(margin))) + max(-margin, 0.0)
        m = _multiplier(label, score, self.loss)
        for f, x, wi, (z, n) in zip(features, values, w, known):
            g = m * x
            sigma = (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha
            self.state[f] = (z + g - sigma * wi, n + g * g)

    def finish(self, key):
        for f, (z, n) in self.state.items():
            yield (*key, f, z, n, self._weight(z, n), self.rows, self.hits, self.loss_sum)
