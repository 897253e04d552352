import math
import random

import pytest
from pyspark.sql import functions as F

from clickloom.operators import metrics


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "label double, score double")


@pytest.mark.parametrize(
    "pairs,expected",
    [
        ([(1.0, 1.0), (1.0, 1.0), (-1.0, 1.0), (-1.0, 1.0)], 0.5),
        ([(1.0, 2.0), (-1.0, 1.0)], 1.0),
        ([(1.0, 1.0), (-1.0, 2.0)], 0.0),
        ([(1.0, 1.0), (1.0, 2.0)], None),
        ([(0.0, 0.2), (1.0, 0.9), (0.0, 0.9)], 0.75),
    ],
)
def test_auc_cases(spark, pairs, expected):
    assert metrics.auc(scored(spark, pairs)).first()["auc"] == expected


def test_auc_is_rank_based(spark):
    rnd = random.Random(1)
    pairs = [(rnd.choice([1.0, -1.0]), round(rnd.gauss(0, 1), 1)) for _ in range(400)]
    pos = [s for y, s in pairs if y > 0]
    neg = [s for y, s in pairs if y < 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    for f in (lambda s: s, lambda s: math.exp(3 * s)):
        rnd.shuffle(pairs)
        got = metrics.auc(scored(spark, [(y, f(s)) for y, s in pairs]), partitions=5).first()["auc"]
        assert got == pytest.approx(brute)


def test_losses_and_accuracy(spark):
    df = scored(spark, [(1.0, 0.0), (-1.0, 0.0)])
    assert metrics.mean_loss(df, "exp").first()["loss"] == pytest.approx(math.log(2))
    assert metrics.mean_loss(scored(spark, [(1.0, 0.5), (0.0, 0.5)]), "log").first()["loss"] == pytest.approx(math.log(2))
    # a score of 0 is the negative class
    assert metrics.accuracy(df, "exp").first()["accuracy"] == 0.5
    assert metrics.accuracy(scored(spark, [(1.0, 0.5), (0.0, 0.4)]), "log").first()["accuracy"] == 0.5
    with pytest.raises(ValueError):
        metrics.mean_loss(df, "hinge")


def test_confusion_without_predictions(spark):
    out = metrics.confusion(scored(spark, [(1.0, -1.0), (-1.0, -2.0)]), F.col("score") > 0, F.col("label") > 0).first()
    assert (out["tp"], out["fp"], out["fn"], out["tn"]) == (0, 0, 1, 1)
    assert out["precision"] is None and out["recall"] == 0.0 and out["accuracy"] == 0.5


def test_prequential(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, -1.0, 1.0), (1, 1.0, 1.0)], "batch_id int, label double, score double")
    out = metrics.prequential(df, "exp").orderBy("batch_id").collect()
    assert [r["accuracy"] for r in out] == [0.5, 1.0]
    assert out[1]["running_accuracy"] == pytest.approx(2 / 3)
