"""Questions about ordered event sequences per user.

Events get one global position in (user, time, id) order from a range partitioning, which also
splits a user with very many events. Everything after that is an aggregation on positions; no
window over a whole user is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.operators.ordering import dense_index


def positions(events: DataFrame, user: str, order: list[str]) -> DataFrame:
    """Add ``pos``: consecutive over all events, in user order and then in event order."""
    return dense_index(events, [user, *order], "pos")


def path_contains(placed: DataFrame, user: str, step: str, pattern: list[str]) -> DataFrame:
    """``(user, contains)``: does the user's path have the pattern as a contiguous run?

    An event that fits pattern place ``j`` votes for a run that starts ``j`` positions earlier; a
    start with as many votes as the pattern has places is a match.
    """
    starts = [F.when(F.col(step) == p, F.col("pos") - F.lit(j)) for j, p in enumerate(pattern)]
    votes = placed.select(user, F.explode(F.array_compact(F.array(*starts))).alias("start"))
    matches = votes.groupBy(user, "start").agg(F.count("*").alias("n")).filter(F.col("n") == len(pattern))
    users = placed.select(user).distinct()
    found = matches.select(user).distinct().withColumn("contains", F.lit(True))
    if not pattern:
        return users.withColumn("contains", F.lit(True))
    return users.join(found, user, "left").fillna(False, ["contains"])


def first_match(placed: DataFrame, user: str, predicate: Column) -> DataFrame:
    """``(user, first)``: 0-based place of the first event that satisfies the predicate, or -1."""
    found = placed.groupBy(user).agg(F.min("pos").alias("begin"), F.min(F.when(predicate, F.col("pos"))).alias("hit"))
    return found.select(user, F.coalesce(F.col("hit") - F.col("begin"), F.lit(-1)).alias("first"))


def is_increasing(placed: DataFrame, user: str, measure: str, strict: bool = True) -> DataFrame:
    """``(user, increasing)``: is each value above the one before it?

    Every event takes part in two neighbour pairs, as the left and as the right value.
    """
    sides = F.array(
        F.struct(F.col("pos").alias("pair"), F.col(measure).alias("left"), F.lit(None).cast("double").alias("right")),
        F.struct((F.col("pos") - 1).alias("pair"), F.lit(None).cast("double").alias("left"), F.col(measure).alias("right")),
    )
    pairs = (
        placed.select(user, F.explode(sides).alias("s"))
        .groupBy(user, "s.pair")
        .agg(F.max("s.left").alias("left"), F.max("s.right").alias("right"))
    )
    ok = F.col("left") < F.col("right") if strict else F.col("left") <= F.col("right")
    return pairs.groupBy(user).agg(F.bool_and(F.coalesce(ok, F.lit(True))).alias("increasing"))
