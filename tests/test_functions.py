import math

import pytest
from pyspark.sql import functions as F

from clickloom.functions import expr
from clickloom.functions.hashing import hash_unit
from clickloom.functions.quarantine import bad_rows, good_rows, quarantine


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("v,expected", [(0.3, 0.2), (-0.3, -0.2), (0.05, 0.0), (-0.05, 0.0)])
def test_soft_threshold(spark, v, expected):
    got = one(spark, expr.soft_threshold(F.lit(v), 0.1))
    assert got == pytest.approx(expected)
    assert math.copysign(1.0, got) == (math.copysign(1.0, expected))


def test_logistic_loss_is_stable(spark):
    assert one(spark, expr.logistic_loss(F.lit(1.0), F.lit(0.0))) == pytest.approx(math.log(2))
    assert one(spark, expr.logistic_loss(F.lit(-1.0), F.lit(1000.0))) == 1000.0
    assert one(spark, expr.logistic_loss(F.lit(1.0), F.lit(1000.0))) == 0.0


@pytest.mark.parametrize("s", [-900.0, -1.0, 0.0, 2.5, 900.0])
def test_both_label_conventions_agree(spark, s):
    for y in (1.0, -1.0):
        exp = one(spark, expr.multiplier(F.lit(y), F.lit(s), "exp"))
        log = one(spark, expr.multiplier(F.lit((y + 1) / 2), F.lit(s), "log"))
        assert exp == pytest.approx(log, abs=1e-12)
        assert one(spark, expr.pointwise_loss(F.lit(y), F.lit(s), "exp")) == pytest.approx(
            one(spark, expr.pointwise_loss(F.lit((y + 1) / 2), F.lit(s), "log"))
        )


def test_unknown_loss_is_an_error(spark):
    with pytest.raises(ValueError):
        expr.multiplier(F.lit(1.0), F.lit(0.0), "hinge")


def test_small_expressions(spark):
    assert one(spark, expr.cross_entropy(F.lit(1.0), F.lit(0.0))) == pytest.approx(-math.log(1e-15))
    assert one(spark, expr.log_odds(F.lit(0.75))) == pytest.approx(math.log(3))
    assert one(spark, expr.time_decay(F.lit(2.0), 1.0)) == pytest.approx(math.exp(-1))
    assert one(spark, expr.step_size(0.3, F.lit(9.0))) == pytest.approx(0.1)
    assert one(spark, expr.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 11.0
    assert one(spark, expr.split_tokens(F.lit(" a  b "))) == ["a", "b"]
    assert one(spark, expr.parse_number(F.lit("x"))) is None
    assert one(spark, expr.safe_divide(F.lit(1.0), F.lit(0.0))) is None


def test_hash_is_uniform_and_repeatable(spark):
    df = spark.range(4000).select(hash_unit(F.col("id"), 7).alias("u"))
    stats = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= stats[0] and stats[1] < 1 and abs(stats[2] - 0.5) < 0.03
    assert df.collect() == df.collect()


def test_quarantine_splits_rows(spark, rows):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "t string")
    checked = quarantine(df, {"number": expr.parse_number(F.col("t")).isNull()})
    assert rows(good_rows(checked)) == [("1",)]
    assert bad_rows(checked).count() == 2
