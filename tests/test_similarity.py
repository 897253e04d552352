import random

import pytest

from clickloom.operators import matrix, profile, similarity


def users(spark, n=120, seed=3, hot=40):
    rnd = random.Random(seed)
    sizes = profile.cardinalities()
    table = [[1] * 8 for _ in range(hot)] + [[rnd.randrange(min(3, s)) for s in sizes] for _ in range(n - hot)]
    rows = [(i, sum(v << (4 * j) for j, v in enumerate(levels))) for i, levels in enumerate(table)]
    return spark.createDataFrame(rows, "user_id long, pattern long"), table


def shared(a, b):
    return sum(x == y for x, y in zip(a, b))


@pytest.mark.parametrize("k", [3, 20])
def test_top_neighbours_match_brute_force(spark, k):
    df, table = users(spark)
    got = {}
    for r in similarity.top_neighbours(df, k).collect():
        got.setdefault(r["user_id"], []).append((r["rank"], r["neighbour"], r["shared"]))
    for u, levels in enumerate(table):
        scored = [(-shared(levels, other), v) for v, other in enumerate(table) if v != u]
        expected = [(i + 1, v, -s) for i, (s, v) in enumerate(sorted(x for x in scored if x[0] < 0)[:k])]
        assert sorted(got[u]) == expected


def test_identical_users_list_each_other(spark):
    df = spark.createDataFrame([(i, 7) for i in range(3)], "user_id long, pattern long")
    got = {(r["user_id"], r["neighbour"]) for r in similarity.top_neighbours(df, 2).collect()}
    assert got == {(a, b) for a in range(3) for b in range(3) if a != b}


@pytest.mark.parametrize("least", [4, 6, 7])
def test_similar_profiles_match_brute_force(spark, least):
    df, table = users(spark)
    pairs = similarity.similar_profiles(similarity.pattern_table(df), min_shared=least).collect()
    codes = {tuple(v): sum(x << (4 * j) for j, x in enumerate(v)) for v in table}
    expected = {
        (codes[a], codes[b], shared(a, b)) for a in codes for b in codes if codes[a] < codes[b] and shared(a, b) >= least
    }
    assert {(r["profile_a"], r["profile_b"], r["shared"]) for r in pairs} == expected and len(pairs) == len(expected)
    assert all(r["sim"] == r["shared"] / 8 for r in pairs)


def test_user_level_entries_and_error(spark):
    df, table = users(spark, n=60, hot=10)
    base = similarity.pattern_table(df)
    exact = similarity.similar_profiles(base, min_shared=6)
    asked = spark.createDataFrame([(0,), (30,)], "user_id long")
    got = {(r[0], r[1], r[2]) for r in similarity.similar_users(asked, df, similarity.both_directions(exact)).collect()}
    want = {
        (u, v, shared(table[u], table[v]) / 8)
        for u in (0, 30)
        for v in range(60)
        if v != u and shared(table[u], table[v]) >= 6
    }
    assert got == want
    approx = similarity.approx_similar_profiles(base, min_shared=6)
    found = {(r[0], r[1], r[2]) for r in approx.collect()}
    full = {(r["profile_a"], r["profile_b"], r["sim"]) for r in exact.collect()}
    assert found <= full and len(found) == approx.count()
    error = similarity.similarity_error(exact, approx).first()
    assert error["pairs"] == len(full) and error["found"] == len(found)
    assert error["mae"] == pytest.approx(sum(s for *_, s in full - found) / len(full))


def test_transpose(spark, rows):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])], "i long, x array<double>")
    out = matrix.transpose_rows(df, "i", "x", block=2)
    assert rows(out) == [(0, 0, 0, [1.0, 3.0]), (0, 1, 2, [5.0]), (1, 0, 0, [2.0, 4.0]), (1, 1, 2, [6.0])]
    coo = matrix.to_coordinates(df, "i", "x")
    assert rows(matrix.transpose_coordinates(matrix.transpose_coordinates(coo))) == rows(coo)


def test_sampled_column_products(spark):
    import numpy as np

    from clickloom.operators import dimsum

    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(400, 6)) + rnd.normal(size=(400, 1))
    x[:, 5] = 0.0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>")
    entries = dimsum.vector_entries(df, "id", "v")
    exact = {(r["col_a"], r["col_b"]): r["sim"] for r in dimsum.column_similarities(entries).collect()}
    n = np.linalg.norm(x[:, :5], axis=0)
    want = (x[:, :5].T @ x[:, :5]) / np.outer(n, n)
    assert exact == pytest.approx({(i, j): want[i, j] for i in range(5) for j in range(i + 1, 5)})
    guess = dimsum.column_similarities(entries, gamma=200.0)
    report = dimsum.estimate_error(dimsum.column_similarities(entries), guess, 0.3).first()
    assert 0 < report["mae"] < 0.1 and report["pairs"] == 10 == report["similar"] == report["found"]
    sure = {(r["col_a"], r["col_b"]): r["sim"] for r in dimsum.column_similarities(entries, threshold=0.001).collect()}
    assert sure == pytest.approx(exact)  # so much oversampling keeps every entry
    assert dimsum.column_similarities(entries.limit(0)).count() == 0
