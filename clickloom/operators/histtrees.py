"""Boosted trees over numeric columns, split by histograms.

Columns are cut at exact quantiles once; rows then carry small bin numbers (-1: missing or NaN). A level of a
tree is one aggregation by (node, column, bin), whose result is bounded by the layout and not by the rows. Only the
smaller child of each split is counted; its sibling is the parent's histogram less the child's. A missing value
goes to the side that gains more, which is part of the split. Routing is an expression on the row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.operators.ordering import running_sums
from clickloom.operators.trees import ROOT, prior, residual
from clickloom.session import cut_lineage

BINS = 32
MISSING = -1


def cut_points(rows: DataFrame, inputs: list[str], bins: int = BINS) -> list[list[float]]:
    """Different inner quantiles of every column: at most ``bins - 1`` numbers each.

    A quantile is the least value that the share of the known values doesn't exceed, exact for any number of rows: values are counted,
    and the counts summed up in order over range partitions. Only the cut points reach the driver.
    """
    each = F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast("double").alias("x")) for i, c in enumerate(inputs)])
    counted = rows.select(F.inline(each)).filter(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("col", "x").agg(F.count("*").alias("n"))
    ranked = running_sums(counted, ["col", "x"], {"before": "n"})
    sizes = ranked.groupBy("col").agg(F.min("before").alias("first"), F.sum("n").alias("total"))
    placed = ranked.join(F.broadcast(sizes), "col").withColumn("below", F.col("before") - F.col("first"))  # sizes: one row per column
    reached = F.expr(f"least(((below + n) * {bins}) div total, {bins - 1}) > (below * {bins}) div total")
    cuts: list[list[float]] = [[] for _ in inputs]
    for r in placed.filter(reached).select("col", "x").collect():
        cuts[r["col"]].append(r["x"])
    return [sorted(at) for at in cuts]


def binned(rows: DataFrame, inputs: list[str], cuts: list[list[float]]) -> DataFrame:
    """Add ``bins``: per column the number of cut points below the value, -1 for none."""

    def one(name: str, at: list[float]) -> Column:
        x = F.col(name).cast("double")
        below = sum(((x > F.lit(float(c))).cast("int") for c in at), F.lit(0))
        return F.when(x.isNull() | F.isnan(x), F.lit(MISSING)).otherwise(below)

    return rows.withColumn("bins", F.array(*[one(c, at) for c, at in zip(inputs, cuts)]))


def histogram(rows: DataFrame) -> DataFrame:
    """(node, col, bin, s, n): summed residual and number of the rows (node, residual, bins)."""
    cells = rows.select("node", "residual", F.posexplode("bins").alias("col", "bin"))
    return cells.groupBy("node", "col", "bin").agg(F.sum("residual").alias("s"), F.count("*").alias("n"))


def sibling(parents: DataFrame, counted: DataFrame) -> DataFrame:
    """Histograms of the siblings of the counted nodes: the parents' less theirs."""
    own = counted.select(F.shiftright("node", 1).alias("node"), "col", "bin", F.col("s").alias("_s"), F.col("n").alias("_n"), F.col("node").alias("_child"))
    child = counted.select(F.shiftright("node", 1).alias("node"), F.col("node").alias("_of")).distinct()
    left = parents.join(child, "node").join(own, ["node", "col", "bin"], "left")
    rest = left.select(
        F.col("_of").bitwiseXOR(F.lit(1)).alias("node"), "col", "bin", (F.col("s") - F.coalesce("_s", F.lit(0.0))).alias("s"), (F.col("n") - F.coalesce("_n", F.lit(0))).alias("n")
    )
    return rest.filter("n > 0")


def split_gains(hist: DataFrame) -> DataFrame:
    """(node, col, bin, missing_left, n, n_left, gain) of every split: left are bins up to ``bin``, and missing values if so said.

    ``L^2 / n_L + (S - L)^2 / (n - n_L) - S^2 / n``; splits with an empty side are left out.
    """
    whole = Window.partitionBy("node", "col")  # at most one row per bin
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    there = F.col("bin") >= 0
    pick = lambda c, ok, over: F.sum(F.when(ok, F.col(c)).otherwise(F.lit(0).cast(dict(hist.dtypes)[c]))).over(over)
    sums = hist.select(
        "node", "col", "bin",
        *[pick(c, there, upto).alias(f"l{c}") for c in ("s", "n")],
        *[pick(c, ~there, whole).alias(f"m{c}") for c in ("s", "n")],
        *[F.sum(c).over(whole).alias(f"t{c}") for c in ("s", "n")],
    ).filter(there)
    both = sums.withColumn("missing_left", F.explode(F.array(F.lit(True), F.lit(False))))
    side = lambda c: F.col(f"l{c}") + F.when(F.col("missing_left"), F.col(f"m{c}")).otherwise(F.lit(0))
    l, m, s, n = side("s"), side("n"), F.col("ts"), F.col("tn")
    gain = l * l / m + (s - l) * (s - l) / (n - m) - s * s / n
    return both.withColumn("n_left", m).filter((F.col("n_left") > 0) & (F.col("n_left") < n)).select("node", "col", "bin", "missing_left", n.alias("n"), "n_left", gain.alias("gain"))


def _order() -> Column:
    """Best gain (to 9 digits), then the first column and the lowest bin, missing values to the left."""
    return F.struct(-F.round("gain", 9), "col", "bin", ~F.col("missing_left"))


def best_splits(gains: DataFrame, by: list[str] = ("node",)) -> DataFrame:
    kept = F.struct("col", "bin", "missing_left", "n", "n_left", "gain")
    others = [c for c in ("col", "bin", "missing_left", "n", "n_left", "gain") if c not in by]
    return gains.groupBy(*by).agg(F.min_by(kept, _order()).alias("b")).select(*by, *[F.col(f"b.{c}").alias(c) for c in others])


def _step(node: Column, table: Column) -> Column:
    split = F.try_element_at(table, node)
    at = F.get("bins", F.get(split, F.lit(0)))
    left = F.when(at == MISSING, F.get(split, F.lit(2)) == 1).otherwise(at <= F.get(split, F.lit(1)))
    return F.when(split.isNull(), node).when(left, node * 2).otherwise(node * 2 + 1)


def _table(splits: dict[int, tuple[int, int, bool]]) -> Column:
    return F.create_map(*[x for node, (col, at, left) in splits.items() for x in (F.lit(node), F.array(F.lit(col), F.lit(at), F.lit(int(left))))])


@dataclass
class HistTree:
    """Split (column number, last bin to the left, missing to the left) per inner node and level, value per leaf."""

    levels: list[dict[int, tuple[int, int, bool]]] = field(default_factory=list)
    leaves: dict[int, float] = field(default_factory=dict)

    def value(self) -> Column:
        """Value of the leaf of a row with ``bins``: a fold over the levels."""
        node = F.lit(ROOT)
        if self.levels:
            node = F.aggregate(F.array(*[_table(level) for level in self.levels]), node, _step)
        leaves = F.create_map(*[F.lit(x) for pair in self.leaves.items() for x in pair])
        return F.coalesce(F.try_element_at(leaves, node), F.lit(0.0))


def grow_tree(rows: DataFrame, depth: int, min_gain: float = 1e-9) -> HistTree:
    """Depth-limited tree on (residual, bins); leaf value = mean residual. At most 2^depth splits reach the driver."""
    tree, placed = HistTree(), rows.withColumn("node", F.lit(ROOT))
    hist = cut_lineage(histogram(placed))
    for level in range(depth):
        best = best_splits(split_gains(hist)).filter(F.col("gain") > min_gain).collect()
        if not best:
            break
        splits = {r["node"]: (r["col"], r["bin"], r["missing_left"]) for r in best}
        tree.levels.append(splits)
        placed = placed.withColumn("node", _step(F.col("node"), _table(splits)))
        if level + 1 < depth:
            small = [2 * r["node"] + int(2 * r["n_left"] > r["n"]) for r in best]  # the smaller child of each
            counted = cut_lineage(histogram(placed.filter(F.col("node").isin(small))))
            hist = cut_lineage(counted.unionByName(sibling(hist.filter(F.col("node").isin(list(splits))), counted)))
    leaves = placed.groupBy("node").agg(F.avg("residual").alias("value")).collect()
    tree.leaves = {r["node"]: r["value"] for r in leaves}
    return tree


@dataclass
class HistModel:
    inputs: list[str]
    cuts: list[list[float]]
    bias: float
    rate: float
    trees: list[HistTree]


def fit(rows: DataFrame, inputs: list[str], iterations: int = 10, depth: int = 3, rate: float = 1.0, bins: int = BINS) -> HistModel:
    """Boosting on log-loss residuals of labels -1/+1 from the prior log-odds; only ``label`` and the inputs are read."""
    table = rows.select(F.col("label").cast("double").alias("label"), *inputs)
    cuts = cut_points(table, inputs, bins)
    state = cut_lineage(binned(table, inputs, cuts).select("label", "bins"))
    bias = prior(state).first()["bias"]
    if bias is None:
        raise ValueError("both classes are needed")
    model, state = HistModel(inputs, cuts, bias, rate, []), state.withColumn("f", F.lit(bias))
    for _ in range(iterations):
        current = cut_lineage(state.withColumn("residual", residual(F.col("label"), F.col("f"))))
        model.trees.append(grow_tree(current.select("residual", "bins"), depth))
        state = current.select("label", "bins", (F.col("f") + F.lit(rate) * model.trees[-1].value()).alias("f"))
    return model


def predict(rows: DataFrame, model: HistModel) -> DataFrame:
    """Rows with ``score``, the raw sum of the trees."""
    out = binned(rows, model.inputs, model.cuts)
    total = sum((F.lit(model.rate) * t.value() for t in model.trees), F.lit(model.bias))
    return out.withColumn("score", total).drop("bins")
