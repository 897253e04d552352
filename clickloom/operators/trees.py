"""Boosted trees over one-hot features.

Rows are packed: ``(row_id, label, features ARRAY<STRING>, f)``. Routing a row through a tree is a
row-local expression over the few split nodes; a level needs one aggregation by (node, feature).
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.functions.expr import log_odds, logistic_loss
from clickloom.operators.history import note, observed
from clickloom.session import cut_lineage

ROOT = 1


def prior(rows: DataFrame) -> DataFrame:
    """One row: share of positives and its log-odds (null when a class is missing)."""
    share = F.avg((F.col("label") > 0).cast("double"))
    counted = rows.agg(share.alias("p"), F.count("*").alias("rows"))
    bias = F.when((F.col("p") > 0) & (F.col("p") < 1), log_odds(F.col("p")))
    return counted.withColumn("bias", bias)


def residual(label: Column, f: Column) -> Column:
    """``y / (1 + e^(y f))`` for labels -1/+1."""
    return label / (F.lit(1.0) + F.exp(label * f))


def pack_features(examples: DataFrame) -> DataFrame:
    """Long one-hot examples to one row each."""
    return examples.groupBy("row_id", "label").agg(F.sort_array(F.collect_set("feature")).alias("features"))


def split_gains(rows: DataFrame) -> DataFrame:
    """Gain of splitting each node by each feature, for rows ``(node, residual, features)``.

    ``L^2/n_L + (S-L)^2/(n-n_L) - S^2/n``; features all or none of a node's rows have are dropped.
    """
    # One pass: the empty name stands for "every row" and yields the node totals.
    names = F.explode(F.concat(F.array(F.lit("")), "features")).alias("feature")
    sums = rows.select("node", "residual", names).groupBy("node", "feature").agg(
        F.sum("residual").alias("left"), F.count("*").alias("n_left")
    )
    every = F.col("feature") == ""
    over_node = Window.partitionBy("node")  # one row per feature of the node, after aggregation
    left = sums.select(
        "node",
        "feature",
        "left",
        "n_left",
        F.max(F.when(every, F.col("left"))).over(over_node).alias("total"),
        F.max(F.when(every, F.col("n_left"))).over(over_node).alias("n"),
    ).filter(~every)
    s, n, l, m = F.col("total"), F.col("n"), F.col("left"), F.col("n_left")
    gain = l * l / m + (s - l) * (s - l) / (n - m) - s * s / n
    return left.filter(m < n).select("node", "feature", "n", "n_left", gain.alias("gain"))


def best_splits(gains: DataFrame) -> DataFrame:
    """Best feature per node; equal gains (to 9 digits) go to the smallest name."""
    order = F.struct(-F.round("gain", 9), "feature")
    return gains.groupBy("node").agg(
        F.min_by("feature", order).alias("feature"), F.max("gain").alias("gain"), F.first("n").alias("n")
    )


def _route(node: Column, splits: dict[int, str]) -> Column:
    """Next node: 2n when the row has the split feature, 2n+1 otherwise; unsplit nodes stay."""
    if not splits:
        return node
    table = F.create_map(*[F.lit(v) for pair in splits.items() for v in pair])
    feature = F.try_element_at(table, node)
    step = F.when(F.array_contains("features", feature), node * 2).otherwise(node * 2 + 1)
    return F.when(feature.isNull(), node).otherwise(step)


def _step(node: Column, table: Column) -> Column:
    """One level of a fold: as :func:`_route`, with the splits as a map column."""
    feature = F.try_element_at(table, node)
    return F.when(feature.isNull(), node).when(F.array_contains("features", feature), node * 2).otherwise(node * 2 + 1)


class Tree:
    """Split feature per inner node, value per leaf: at most 2^depth entries."""

    def __init__(self, levels: list[dict[int, str]], leaves: dict[int, float]):
        self.levels, self.leaves = levels, leaves

    def value(self) -> Column:
        node = F.lit(ROOT)
        if self.levels:
            # a fold over the levels: the expression grows with the depth, not with its power
            tables = F.array(*[F.create_map(*[F.lit(v) for pair in level.items() for v in pair]) for level in self.levels])
            node = F.aggregate(tables, node, _step)
        table = F.create_map(*[F.lit(v) for pair in self.leaves.items() for v in pair])
        return F.coalesce(F.try_element_at(table, node), F.lit(0.0))


def grow_tree(rows: DataFrame, depth: int, min_gain: float = 1e-9) -> Tree:
    """Depth-limited tree on ``(residual, features)``; leaf value = mean residual."""
    levels: list[dict[int, str]] = []
    placed = rows.withColumn("node", F.lit(ROOT))
    for _ in range(depth):
        best = best_splits(split_gains(placed)).filter(F.col("gain") > min_gain)
        splits = {r["node"]: r["feature"] for r in best.collect()}  # at most 2^depth rows
        if not splits:
            break
        levels.append(splits)
        placed = placed.withColumn("node", _route(F.col("node"), splits))
    leaves = placed.groupBy("node").agg(F.avg("residual").alias("value")).collect()  # at most 2^depth rows
    return Tree(levels, {r["node"]: r["value"] for r in leaves})


def fit_boosted(examples: DataFrame, iterations: int = 10, depth: int = 3, rate: float = 1.0, history: list | None = None) -> tuple[float, list[Tree]]:
    """Boosting on log-loss residuals: ``f += rate * tree`` from the prior log-odds; ``history`` receives ``(iteration, mean loss before the tree)``."""
    packed = cut_lineage(pack_features(examples))
    bias = prior(packed).first()["bias"]
    if bias is None:
        raise ValueError("both classes are needed")
    state, trees = packed.withColumn("f", F.lit(bias)), []
    for t in range(1, iterations + 1):
        current, seen = observed(state.withColumn("residual", residual(F.col("label"), F.col("f"))), F.avg(logistic_loss(F.col("label"), F.col("f"))), history)
        current = cut_lineage(current)
        note(history, t, seen)
        tree = grow_tree(current, depth)
        trees.append(tree)
        state = current.drop("residual").withColumn("f", F.col("f") + F.lit(rate) * tree.value())
    return bias, trees


def predict_boosted(examples: DataFrame, bias: float, trees: list[Tree], rate: float = 1.0, every: int = 10) -> DataFrame:
    """``(row_id, label, score)``; the plan is cut every few trees to keep expressions small."""
    rows = pack_features(examples).withColumn("score", F.lit(bias))
    for i, tree in enumerate(trees, start=1):
        rows = rows.withColumn("score", F.col("score") + F.lit(rate) * tree.value())
        if i % every == 0:
            rows = cut_lineage(rows)
    return rows.select("row_id", "label", "score")


#: Values of a column that MLlib may split between; a column with more of them is cut at so many quantiles.
GBT_BINS = 32
#: Different rows of a task while MLlib trains.
GBT_ROWS = 1_000_000


def _buckets(rows: DataFrame, inputs: list[str]):
    """``Bucketizer`` of the columns with more than ``GBT_BINS`` values, at exact quantiles of all rows; None where there is no such column."""
    from pyspark.ml.feature import Bucketizer

    from clickloom.operators.histtrees import cut_points

    rough = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in inputs]).first()
    few = [c for c in inputs if rough[c] <= 4 * GBT_BINS]  # far beyond the error of the estimate
    exact = rows.agg(F.lit(0).alias("_"), *[F.count_distinct(c).alias(c) for c in few]).first()
    wide = [c for c in inputs if c not in few or exact[c] > GBT_BINS]
    if not wide:
        return None
    # a bucket begins at its cut, and a quantile belongs to the values below it
    cuts = [[math.nextafter(x, math.inf) for x in at if x < math.inf] for at in cut_points(rows, wide, GBT_BINS)]
    splits = [[-math.inf, *(at or [0.0]), math.inf] for at in cuts]
    return Bucketizer(splitsArray=splits, inputCols=wide, outputCols=[f"{c}_bucket" for c in wide], handleInvalid="keep")


def fit_gbt(rows: DataFrame, inputs: list[str], label: str, iterations: int = 60, depth: int = 6, seed: int = 37):
    """MLlib gradient-boosted trees on numeric columns; returns a ``PipelineModel``.

    Columns are cut at quantiles of all rows, not of MLlib's sample, so the model doesn't depend on how the rows are dealt out. Rows
    that are equal then are trained as one whose weight is their number: every pass of every tree goes over the different ones only.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    kept = rows.select(*inputs, label).persist(StorageLevel.MEMORY_AND_DISK)
    counted = dealt = None
    try:
        buckets = _buckets(kept, inputs)
        coded = buckets.transform(kept) if buckets else kept
        names = [f"{c}_bucket" if buckets and c in buckets.getInputCols() else c for c in inputs]
        plain = [(F.col(c) + F.lit(0.0)).alias(c) for c in names]  # without the buckets' metadata, as MLlib would take them for unordered categories
        counted = coded.groupBy(*plain, label).agg(F.count("*").cast("double").alias("weight")).persist(StorageLevel.MEMORY_AND_DISK)
        tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(counted.count() / GBT_ROWS))
        dealt = counted.repartition(tasks, *names).persist(StorageLevel.MEMORY_AND_DISK)
        dealt.count()
        kept.unpersist()
        counted.unpersist()
        assemble = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
        gbt = GBTClassifier(labelCol=label, weightCol="weight", maxIter=iterations, maxDepth=depth, maxBins=GBT_BINS + 1, seed=seed)  # + 1: missing
        model = Pipeline(stages=[assemble, gbt]).fit(dealt)
    finally:
        for frame in (kept, counted, dealt):
            if frame is not None:
                frame.unpersist()
    return PipelineModel([buckets, *model.stages]) if buckets else model
