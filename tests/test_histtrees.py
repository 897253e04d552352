"""Histogram trees: splits by brute force, sibling subtraction, missing values, prediction."""

import math
import random

import pytest
from pyspark.sql import functions as F

from clickloom.operators import histtrees as ht


def rows_of(n=300, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a = rnd.choice([None, math.nan, *[rnd.gauss(0, 1) for _ in range(6)]])
        b, c = float(rnd.randrange(4)), rnd.expovariate(1.0)
        known = a is not None and not math.isnan(a)
        y = (0.3 * (b - 1.5) + (a if known else 1.0) + rnd.gauss(0, 0.5)) > 0
        out.append((i, 1.0 if y else -1.0, a, b, c, 7.0, None))
    return out


INPUTS = ["a", "b", "c", "same", "none"]
SCHEMA = "row_id bigint, label double, a double, b double, c double, same double, none double"


@pytest.fixture(scope="module")
def table(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA)
    cuts = ht.cut_points(df, INPUTS, bins=8)
    return rows, df, cuts


def bin_of(x, cuts):
    return -1 if x is None or math.isnan(x) else sum(x > c for c in cuts)


def test_bins_are_quantile_cuts(table):
    rows, df, cuts = table
    assert cuts[3] == [7.0] and cuts[4] == [] and cuts[1] == [0.0, 1.0, 2.0, 3.0]
    known = sorted(r[4] for r in rows)
    assert cuts[2] == [known[math.ceil(len(known) * i / 8) - 1] for i in range(1, 8)]
    got = {r["row_id"]: r["bins"] for r in ht.binned(df, INPUTS, cuts).collect()}
    assert got == {r[0]: [bin_of(x, c) for x, c in zip(r[2:], cuts)] for r in rows}


def brute_gains(rows, cuts, nodes):
    out = {}
    for node in set(nodes.values()):
        own = [r for r in rows if nodes[r[0]] == node]
        s = sum(r[1] for r in own)
        for col, at in enumerate(cuts):
            for b in range(len(at) + 1):
                for missing_left in (True, False):
                    bins = [bin_of(r[2 + col], at) for r in own]
                    if b not in bins:
                        continue
                    left = [r[1] for r, k in zip(own, bins) if (missing_left if k < 0 else k <= b)]
                    if 0 < len(left) < len(own):
                        ls = sum(left)
                        gain = ls**2 / len(left) + (s - ls) ** 2 / (len(own) - len(left)) - s**2 / len(own)
                        out[node, col, b, missing_left] = (len(own), len(left), gain)
    return out


def test_gains_by_brute_force(table):
    rows, df, cuts = table
    placed = ht.binned(df, INPUTS, cuts).select((F.col("row_id") % 2 + 2).cast("int").alias("node"), F.col("label").alias("residual"), "bins")
    got = {(r["node"], r["col"], r["bin"], r["missing_left"]): (r["n"], r["n_left"], r["gain"]) for r in ht.split_gains(ht.histogram(placed)).collect()}
    want = brute_gains(rows, cuts, {r[0]: r[0] % 2 + 2 for r in rows})
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_sibling_is_the_rest_of_the_parent(table):
    _, df, cuts = table
    rows = ht.binned(df, INPUTS, cuts).select(F.lit(1).alias("node"), F.col("label").alias("residual"), "bins", "row_id")
    children = rows.withColumn("node", F.when(F.col("row_id") % 3 == 0, 2).otherwise(3))
    read = lambda h: {(r["node"], r["col"], r["bin"]): (r["s"], r["n"]) for r in h.collect()}
    counted = ht.histogram(children.filter("node = 2"))
    assert read(ht.sibling(ht.histogram(rows), counted)) == read(ht.histogram(children.filter("node = 3")))


def test_boosting_learns_and_predicts_missing_values(table, spark):
    rows, df, _ = table
    model = ht.fit(df.selectExpr("*", "1 AS bins", "2 AS f"), INPUTS, iterations=5, depth=3, rate=0.5, bins=16)
    scored = ht.predict(df, model).collect()
    hits = sum((r["score"] > 0) == (r["label"] > 0) for r in scored)
    assert hits / len(rows) > 0.85 and len(scored) == len(rows)
    missing = ht.predict(spark.createDataFrame([(1, None, None), (2, math.nan, None), (3, -3.0, 1.0)], "row_id int, a double, b double").withColumns({c: F.lit(None).cast("double") for c in ("c", "same", "none")}), model)
    s = {r["row_id"]: r["score"] for r in missing.collect()}
    assert s[1] == s[2] > s[3]  # labels of rows without a are mostly positive
    assert all(col not in (3, 4) for t in model.trees for level in t.levels for col, *_ in level.values())


def test_each_split_is_the_best_one(table):
    rows, df, cuts = table
    placed = ht.binned(df, INPUTS, cuts).select(F.col("label").alias("residual"), "bins")
    tree = ht.grow_tree(placed, depth=2)
    nodes = {r[0]: 1 for r in rows}
    for level in tree.levels:
        gains = brute_gains(rows, cuts, nodes)
        for node, split in level.items():
            of_node = {k[1:]: v[2] for k, v in gains.items() if k[0] == node}
            assert of_node[split] == pytest.approx(max(of_node.values()))
        for r in rows:
            if nodes[r[0]] in level:
                col, at, missing_left = level[nodes[r[0]]]
                k = bin_of(r[2 + col], cuts[col])
                nodes[r[0]] = 2 * nodes[r[0]] + (0 if (missing_left if k < 0 else k <= at) else 1)
    assert {n: sum(r[1] for r in rows if nodes[r[0]] == n) / sum(nodes[r[0]] == n for r in rows) for n in set(nodes.values())} == pytest.approx(tree.leaves)


def test_one_class_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "label double, x double")
    with pytest.raises(ValueError):
        ht.fit(df, ["x"])
    flat = spark.createDataFrame([(1.0, 2.0), (-1.0, 2.0), (1.0, 2.0)], "label double, x double")
    model = ht.fit(flat, ["x"], iterations=2)
    assert ht.predict(flat, model).select("score").distinct().count() == 1 and model.trees[0].levels == []


def test_cut_points_are_exact_beyond_any_sketch(spark):
    df = spark.range(300_000).select(
        ((F.col("id") * 7919) % 300_000).cast("double").alias("a"), F.when(F.col("id") % 3 > 0, (F.col("id") % 10).cast("double")).alias("b")
    )
    a, b = ht.cut_points(df, ["a", "b"], bins=16)
    assert a == [300_000 * i // 16 - 1.0 for i in range(1, 16)]
    assert b == [float(i) for i in range(10)]
