"""Parity-sketch join against brute force: sets, guarantees of the lanes, components."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from clickloom.llm import components as cc, parity_join as pj
from clickloom.llm.cells import Texts
from tests.conftest import SMALL

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def plain_components(rows, percent=85, k=4):
    """Least key reachable for each row, by comparing all rows."""
    sets = [plain_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return [len(s) for s in sets], [least.get(root(i)) for i in range(len(rows))]


def test_sets():
    texts = [None, "", " \n", "a", "A  a", "a b c", "a b c d", "x y z w x y z w x y z", "É a b c d"]
    grams, ptr = pj.shingle_sets(Texts(pa.array(texts)))
    assert np.diff(ptr).tolist() == [len(plain_set(t)) for t in texts]


def _sets(rnd, n):
    return np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_two_lanes(percent):
    """The guarantee behind both the join and the cut of large groups."""
    rnd = np.random.default_rng(percent)
    bands = pj.Bands(percent)
    for _ in range(400):
        a = _sets(rnd, int(rnd.integers(7, 400)))
        # as different as the threshold allows
        lost = int(rnd.integers(0, (100 - percent) * len(a) // 100 + 1))
        room = (100 * (len(a) - lost) // percent) - len(a)
        b = np.unique(np.concatenate([a[lost:], _sets(rnd, max(0, room))]))
        same = len(np.intersect1d(a, b))
        if 100 * same < percent * (len(a) + len(b) - same) or np.array_equal(a, b):
            continue
        keys, ptr = pj.lanes(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), bands)
        shared = np.intersect1d(keys[: ptr[1]], keys[ptr[1] :])
        assert len(shared) >= 2, (len(a), len(b), same)


def test_few_elements_in_many_lanes(monkeypatch):
    """Sets that leave most lanes empty fall back to other seeds and still meet."""
    monkeypatch.setattr(pj, "_SEEDS", 2)
    bands = pj.Bands(85)
    bands.m = np.where(bands.m > 0, bands.m * 40, 0)
    a = _sets(np.random.default_rng(0), 40)
    b = a[2:]
    keys, ptr = pj.lanes(np.concatenate([a, b]), np.array([0, 40, 78]), bands)
    assert len(np.intersect1d(keys[: ptr[1]], keys[ptr[1] :])) >= 2


def _rows():
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randint(0, 5000)}"
    base = [[word() for _ in range(rnd.randint(5, 150))] for _ in range(25)]
    shared = [word() for _ in range(40)]
    rows = []
    for i in range(260):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = word()
        if i % 5 == 0:
            w = w[: rnd.randint(1, len(w))] + shared
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else " \n ".join(w)))
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A b"), (904, "a"), (None, rows[0][1]), (None, "all alone here now"), (7, rows[9][1]), (12, rows[12][1])]
    return rows


def _got(df):
    return sorted(map(str, (tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())))


def _want(rows, **how):
    sizes, comps = plain_components(rows, **how)
    return sorted(map(str, ((k, n, c) for (k, _), n, c in zip(rows, sizes, comps))))


@pytest.mark.parametrize("how", [{}, {"percent": 80, "k": 5}])
def test_components_match_brute_force(table, how):
    rows = _rows()
    docs = table(rows).selectExpr("*", "1 AS n", "2 AS lanes", "3 AS node", "4 AS component_id")
    assert _got(pj.link(docs, **how)) == _want(rows, **how)


def test_many_copies_just_below_the_threshold(table):
    """Copies that link to few of the others: edits decide, and the few links between them are found."""
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        w = list(base)
        for p in rnd.sample(range(0, 120, 4), 5):
            w[p] = f"x{i}_{p}"
        rows.append((i, " ".join(w)))
        if i % 20 == 0:  # a copy of a copy
            w[1] = f"y{i}"
            rows.append((1000 + i, " ".join(w)))
    got = _got(pj.link(table(rows)))
    assert got == _want(rows)
    assert len({x.split(",")[-1] for x in got}) > 100


def test_common_passages(table):
    """Documents that share lanes with a hub they have little else in common with."""
    rnd = random.Random(9)
    shared = [f"s{i}" for i in range(60)]
    rows, own = [], []
    for i in range(160):
        if i % 4 == 0 or not own:
            own = [f"o{i}_{j}" for j in range(rnd.randint(30, 50))]
        w = list(own)
        if i % 4:
            w[rnd.randrange(len(w))] = f"z{i}"
        rows.append((i, " ".join(shared + w)))
    assert _got(pj.link(table(rows))) == _want(rows)


def test_large_shuffles_are_cut_into_parts(table, monkeypatch):
    """Lanes, whole sets and edits are written in several parts of like size, so the disk never holds all their shuffle files."""
    rnd = random.Random(10)
    shared = [[f"s{j}_{i}" for i in range(60)] for j in range(6)]
    rows, own = [], []
    for i in range(160):
        if i % 4 == 0:
            own = [f"o{i}_{j}" for j in range(rnd.randint(30, 50))]
        w = list(own)
        w[rnd.randrange(len(w))] = f"z{i}"
        rows.append((i, " ".join(shared[rnd.randrange(6)] + w)))
    stored, written = pj._stored, {}

    def noted(df, name):
        out = stored(df, name)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(pj, "_stored", noted)
    assert _got(pj.link(table(rows))) == _want(rows)
    for name in ("lane-groups", "compared"):
        assert len(written[name]) > 1 and max(written[name]) < 0.8 * sum(written[name]), written


def test_chain_of_copies(table):
    words = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(60):  # each differs a little from the one before, far ones do not link
        words[i * 3] = f"new{i}"
        rows.append((100 - i, " ".join(words)))
    assert _got(pj.link(table(rows))) == _want(rows)


def test_one_document_of_each_component(table):
    rows = _rows()
    docs = table(rows).selectExpr("*", "1 AS _id", "2 AS _n")
    kept = pj.first_of_each(docs)
    assert kept.columns == docs.columns
    _, comps = plain_components(rows)
    named = {c for (k, _), c in zip(rows, comps) if c is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert named <= set(ids)
    # one row per group; texts without words are groups of their own
    _, groups = plain_components([(i, t) for i, (_, t) in enumerate(rows)])
    assert len(ids) == len(set(groups))


def test_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert _got(pj.link(docs)) == _want(rows)


def test_empty_table(table):
    assert pj.link(table([(1, "x")]).limit(0)).count() == 0
    assert pj.link(table([(1, None)])).collect()[0]["component_id"] == 1


def test_connected_components(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(300, 380)] + [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)] + [(5, 5)] + [(1000, 1000 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in cc.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for n in near[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        assert got[node] == min(seen)
    assert set(got) == set(near)
    assert cc.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def _dealt(spark):
    """Settings under which every shuffle has 64 tasks, and those that they replace."""
    new = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    return old


def test_few_links_take_few_tasks(spark):
    """Rounds over a few links are not dealt to as many tasks as the shuffles of whole tables."""
    old, group = _dealt(spark), "few-links"
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = {tuple(r) for r in cc.components(links).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    assert got == {(i, 0) for i in range(41)}
    assert sum(tracker.getStageInfo(s).numTasks for s in stages) < 150


@pytest.mark.parametrize("more", [[], [(4, 1)], [(7, 2), (9, 8), (5, 9), (5, 7)], [(1, 2), (3, 0), (20, 21)]])
def test_links_between_components(spark, more):
    """Further links join what the first ones have found, as all links at once do."""
    first = [(1, 0), (3, 2), (5, 3), (8, 7)]
    frame = lambda rows: spark.createDataFrame(rows, "a bigint, b bigint").checkpoint()
    got = cc.joined(cc.components(frame(first)).checkpoint(), frame(more))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, cc.components(frame(first + more)).collect()))
