"""Independent learners per key on a stream: the state of a key lives in Spark's state store."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clickloom.operators import passes
from clickloom.operators.online import Rates
from clickloom.sources.buckets import BucketStore
from clickloom.sources.store import as_records

_STATE = "features array<string>, z array<double>, n array<double>, rows long, hits long, loss_sum double"
CHANGES = "model_key string, shard int, feature string, z double, n double, w double, rows long, hits long, loss_sum double"


def ftrl_by_key(examples: DataFrame, key: str, seq: str, rates: Rates, loss: str = "exp", shards: int = 1, idle: str | None = None, time_col: str | None = None) -> DataFrame:
    """Stream of the coordinates that each micro-batch changed (see ``CHANGES``); use the update output mode.

    ``examples`` has one row per example: the key, ``seq``, ``row_id``, ``label``, ``features`` and ``values`` (arrays). The rows of a
    key are learnt in ``seq`` order within a micro-batch, and batch after batch; ``shards`` deals them to as many models, so that a
    key with a large share of the stream is several tasks'. A task holds one key's rows of one micro-batch, whose size the source bounds.
    Keys without rows for ``idle`` (``"30 days"``, say) of event time are forgotten; that needs ``time_col``, with a watermark.
    """
    if bool(idle) != bool(time_col):
        raise ValueError("idle and time_col belong together")
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def learn(group: tuple, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        learner = passes.FtrlPass(rates.alpha, rates.beta, rates.l1, rates.l2, loss)
        if state.exists:
            features, z, n, learner.rows, learner.hits, learner.loss_sum = state.get
            learner.state = dict(zip(features, zip(z, n)))
        touched = set()
        rows = pd.concat(list(frames)).sort_values([seq, "row_id"] if seq != "row_id" else seq)
        for row in rows.itertuples(index=False):
            learner.step(float(row.label), [str(f) for f in row.features], [float(v) for v in row.values_])
            touched.update(row.features)
        z, n = zip(*learner.state.values())
        state.update((list(learner.state), list(z), list(n), learner.rows, learner.hits, learner.loss_sum))
        if wait:
            seen = int(rows["seen_at"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(seen + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([r for r in learner.finish(group) if r[2] in touched], columns=[c.split()[0] for c in CHANGES.split(", ")])

    shard = F.pmod(F.xxhash64("row_id"), F.lit(shards)).cast("int")
    rows = examples.select(
        F.col(key).cast("string").alias("model_key"), shard.alias("shard"), F.col(seq), *([] if seq == "row_id" else ["row_id"]), F.col("label").cast("double").alias("label"), "features", F.col("values").alias("values_"), *([F.col(time_col).alias("seen_at")] if time_col else [])
    )
    timeout = GroupStateTimeout.EventTimeTimeout if wait else GroupStateTimeout.NoTimeout
    return rows.groupBy("model_key", "shard").applyInPandasWithState(learn, CHANGES, _STATE, "update", timeout)


def model_sink(store: BucketStore) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: changed coordinates become records ``key/shard -> feature``; a batch written before is skipped."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        value = F.concat_ws(",", "z", "n", "w", "rows")
        key = F.concat(F.col("shard").cast("string"), F.lit(":"), F.col("model_key"))
        store.upsert(as_records(batch, key, F.col("feature"), value, F.lit(batch_id)), f"{batch_id:012d}")

    return apply


def models(store: BucketStore) -> DataFrame:
    """(model_key, shard, feature, z, n, w, rows) of all keys; ``rows`` are those of the whole shard so far."""
    parts = F.split("value", ",")
    rows = store.read().select(
        F.expr("substring(key, locate(':', key) + 1)").alias("model_key"),
        F.expr("cast(substring(key, 1, locate(':', key) - 1) as int)").alias("shard"),
        F.col("field").alias("feature"),
        *[F.get(parts, F.lit(i)).cast("double").alias(c) for i, c in enumerate(("z", "n", "w"))],
        F.get(parts, F.lit(3)).cast("bigint").alias("seen"),
    )
    sizes = rows.groupBy("model_key", "shard").agg(F.max("seen").alias("rows"))
    return rows.drop("seen").join(sizes, ["model_key", "shard"])
