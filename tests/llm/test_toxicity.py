"""Toxic spans: messages against brute force, spans, held-out accuracy and odd inputs."""

import itertools
import zlib

import numpy as np
import pytest

from clickloom.llm import crf_toxicity as crf
from tests.conftest import SMALL

MIDDLE = SMALL.replace("0.001", "0.01")


def brute(potential, trans, start):
    n = len(potential)
    total, one = 0.0, np.zeros(n)
    for tags in itertools.product((0, 1), repeat=n):
        z = start[tags[0]] + sum(potential[i] for i in range(n) if tags[i]) + sum(trans[a, b] for a, b in zip(tags, tags[1:]))
        total += np.exp(z)
        one += np.exp(z) * np.array(tags)
    return one / total


def test_marginals_of_short_chains():
    rnd = np.random.default_rng(1)
    sizes = [3, 0, 1, 7, 5, 0]
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    potential, trans, start = rnd.normal(0, 2, ptr[-1]), rnd.normal(0, 1, (2, 2)), rnd.normal(0, 1, 2)
    got = crf.marginals(potential, ptr, trans, start)
    want = np.concatenate([brute(potential[a:b], trans, start) for a, b in zip(ptr[:-1], ptr[1:]) if b > a])
    assert np.allclose(got, want)


def test_blocks_do_not_matter(monkeypatch):
    rnd = np.random.default_rng(2)
    ptr = np.array([0, 900, 1000, 5000])
    args = rnd.normal(0, 3, 5000), ptr, rnd.normal(0, 1, (2, 2)), rnd.normal(0, 1, 2)
    want = crf.marginals(*args)
    monkeypatch.setattr(crf, "_BLOCK", 7)
    assert np.allclose(crf.marginals(*args), want)
    alone = [crf.marginals(args[0][a:b], np.array([0, b - a]), *args[2:]) for a, b in zip(ptr[:-1], ptr[1:])]
    assert np.allclose(np.concatenate(alone), want)


def test_lexicon_lookup():
    rnd = np.random.default_rng(3)
    keys = rnd.integers(0, 1 << 63, 500).astype(np.uint64)
    found = crf.Lexicon(keys)
    probe = np.concatenate([keys[:50], rnd.integers(0, 1 << 63, 1000).astype(np.uint64)]).reshape(2, -1)
    want = [np.flatnonzero(found.keys == p)[0] if p in found.keys else 500 for p in probe.ravel()]
    assert found.find(probe).ravel().tolist() == want


def test_held_out_accuracy_and_spans(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    out = crf.score_documents(docs, labels).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    both = out.merge(labels.toPandas(), on="doc_id").merge(docs.toPandas()[["doc_id", "text"]], on="doc_id")
    test = both[both.held_out]
    assert (test.predicted == test.toxic).mean() > 0.93
    english = both[(both.toxic == 1) & both.text.str.contains("idiot")].iloc[0]
    words = {english.text.encode()[s["start"] : s["end"]].decode() for s in english.spans}
    assert "idiot" in words


@pytest.fixture
def tiny(table):
    bad = [(i, f"this is a vile{'#' * (i % 3)} thing {i} with nasty words") for i in range(40)]
    good = [(i, f"this is a fine thing {i} with good words") for i in range(40, 120)]
    return table([*bad, *good, (200, None), (201, ""), (None, "a vile one"), (202, "vile " + "x " * 60_000), (0, "again vile")])


def test_odd_tables(spark, tiny):
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(120)] + [(3, 1), (None, 1), (200, None)], "doc_id bigint, toxic int")
    out = {(r["doc_id"], r["score"]): r for r in crf.score_documents(tiny.selectExpr("*", "0 AS score", "1 AS spans"), labels).collect()}
    assert len(out) >= 120
    by = {}
    for r in out.values():
        by.setdefault(r["doc_id"], []).append(r)
    assert all(r["predicted"] == 1 for i in range(1, 40) for r in by[i])
    assert all(r["predicted"] == 0 for i in range(40, 120) for r in by[i])
    assert by[200][0]["score"] == by[201][0]["score"] < 0.5 and by[200][0]["spans"] == []
    assert by[None][0]["spans"][0]["start"] == 2
    assert crf.score_documents(tiny, labels.filter("toxic = 0")).select("score").distinct().collect()[0][0] == 0
    assert crf.score_documents(tiny.limit(0), labels).count() == 0


def test_clean_slices_and_few_labels(spark, table, tiny):
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(120)], "doc_id bigint, toxic int")
    model = crf.fit(tiny, crf.train_labels(labels, "doc_id", "toxic", crf.FOLDS, crf.HELD_OUT))
    clean = table([(i, "nothing to see here") for i in range(80)]).coalesce(1)
    rows = crf.tag(clean, model).collect()
    assert len(rows) == 80 and all(r["spans"] == [] and r["score"] < 0.5 for r in rows)
    one = spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")
    assert crf.score_documents(tiny, one).agg({"score": "max"}).first()[0] == 0


def test_small_steps_use_all_windows(monkeypatch):
    rnd = np.random.default_rng(5)
    lexicon = crf.Lexicon(np.arange(1, 4))
    ids = rnd.integers(0, 4, (600, 6, crf.KINDS)).astype(np.int32)
    tags = (ids == 0).any(axis=2).astype(float)
    mask = np.ones((600, 6), bool)
    full = crf.fit_field(lexicon, ids, tags, mask)
    monkeypatch.setattr(crf, "BATCH", 100)
    parts = crf.fit_field(lexicon, ids, tags, mask)
    assert np.corrcoef(full.weights, parts.weights)[0, 1] > 0.99 and parts.weights.argmax() == 0
