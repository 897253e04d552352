import numpy as np
import pytest

from clickloom.operators.neighbours import cosine_topk


def brute(table, k):
    ids = sorted(table)
    units = {i: np.array(table[i]) / np.linalg.norm(table[i]) for i in ids}
    out = {}
    for i in ids:
        scored = sorted((-round(float(units[i] @ units[j]), 9), j) for j in ids if j != i)
        out[i] = [(j, pytest.approx(-s, abs=1e-8)) for s, j in scored[:k]]
    return out


@pytest.mark.parametrize("block,pivots", [(2048, None), (16, None), (16, 12), (500, 30)])
def test_neighbours_match_brute_force(spark, block, pivots):
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(6, 5))
    rows = [list(map(float, centres[i % 6] + 0.05 * rnd.normal(size=5))) for i in range(90)]
    rows += [rows[0]] * 40  # many copies of one vector
    table = {i: v for i, v in enumerate(rows)}
    df = spark.createDataFrame(list(table.items()) + [(999, [0.0] * 5)], "vec_id long, embedding array<double>")
    got = {}
    for r in cosine_topk(df, "vec_id", "embedding", 4, block, pivots).collect():
        got.setdefault(r["vec_id"], {})[r["rank"]] = (r["neighbour"], r["sim"])
    expected = brute(table, 4)
    assert {i: [g[n] for n in sorted(g)] for i, g in got.items()} == expected


def test_small_inputs(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert cosine_topk(df, "vec_id", "embedding", 3).count() == 0
    assert cosine_topk(df.limit(0), "vec_id", "embedding", 3).count() == 0


def test_unstructured_vectors_are_paired_without_a_shuffle(spark):
    rnd = np.random.default_rng(5)
    table = {i: list(map(float, rnd.normal(size=12))) for i in range(150)}
    near = cosine_topk(spark.createDataFrame(list(table.items()), "vec_id long, embedding array<double>"), "vec_id", "embedding", 3, 8)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan  # every piece meets every piece here
    expected = brute(table, 3)
    got = {}
    for r in near.orderBy("vec_id", "rank").collect():
        got.setdefault(r["vec_id"], []).append((r["neighbour"], r["sim"]))
    assert got == expected
