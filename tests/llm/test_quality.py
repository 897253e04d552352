"""Positive-unlabelled classifier: risk, prior, held-out accuracy and odd inputs."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from clickloom.llm import pu_quality as pu
from clickloom.llm.cells import Texts
from tests.conftest import SMALL

MIDDLE = SMALL.replace("0.001", "0.01")


def test_features_of_odd_texts():
    x = pu.form_features(Texts(pa.array([None, "", " \n", "a", "A!" * 50_000, "ab ab ab\nab ab ab"])))
    assert x.shape == (6, len(pu.FEATURES)) and np.isfinite(x).all()
    assert (x[0] == x[1]).all()
    at = pu.FEATURES.index
    assert x[4, at("upper")] == 0.5 and x[4, at("bangs")] == 0.5
    assert x[5, at("dup_lines")] == 0.5 and x[5, at("distinct")] == pytest.approx(1 / 6)


def test_prior_and_fit_on_a_known_mixture():
    rnd = np.random.default_rng(0)
    pos, neg = rnd.normal(2, 1, (6000, 2)), rnd.normal(-2, 1, (1800, 2))
    unl = np.concatenate([pos[:4200], neg])  # 70 % positive
    p = np.concatenate([pos[4200:], np.ones((1800, 1))], axis=1)
    u = np.concatenate([unl, np.ones((6000, 1))], axis=1)
    first = pu.non_negative_fit(p[:900], u, 0.5)
    prior = pu.estimate_prior(p[900:] @ first, u @ first)
    assert abs(prior - 0.7) < 0.05
    w = pu.non_negative_fit(p, u, prior)
    test = np.concatenate([rnd.normal(2, 1, (500, 2)), rnd.normal(-2, 1, (500, 2))])
    right = (np.concatenate([test, np.ones((1000, 1))], axis=1) @ w > 0) == (np.arange(1000) < 500)
    assert right.mean() > 0.98


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    out = pu.classify(docs, labels).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    assert (out.predicted == (out.score >= 0.7)).all()
    both = out.merge(labels.toPandas(), on="doc_id")
    test = both[both.held_out]
    assert (test.predicted == test.quality).mean() > 0.9


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 4) = 2 THEN 1 - quality ELSE quality END AS quality")
    a, b = (pu.classify(docs, x).orderBy("doc_id").toPandas() for x in (labels, flipped))
    assert (a.score == b.score).all()


def test_odd_tables(spark, table):
    docs = table([(1, "a b c " * 30), (1, None), (None, "x"), (2, ""), (3, "#" * 100)])
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (3, 0), (None, 1), (2, None), (77, 1)], "doc_id bigint, quality int")
    out = pu.classify(docs.selectExpr("*", "1 AS score", "2 AS x"), labels)
    assert out.count() == 5 and out.filter("score IS NULL OR held_out IS NULL").count() == 0
    none = pu.classify(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r[0] for r in none] == [0.5]
    assert pu.classify(docs.limit(0), labels).count() == 0
    kept = pu.keep(docs.selectExpr("*", "1 AS score", "2 AS x"), labels)
    assert kept.columns[-2:] == ["score", "x"]
