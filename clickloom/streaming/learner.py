"""Online learning on a stream with a versioned, replay-safe state table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickloom.operators import metrics, online
from clickloom.session import list_dirs, table_exists


class StateTable:
    """State rows per micro-batch at a shared path.

    A batch writes only the coordinates it changed. Every ``snapshot_every`` batches the full
    state is written as well, so a reader needs one snapshot and the few batches after it.
    """

    def __init__(self, spark: SparkSession, path: str, snapshot_every: int = 20):
        self.spark, self.path, self.every = spark, path.rstrip("/"), snapshot_every

    def _committed(self, kind: str, below: int) -> list[int]:
        names = [d for d in list_dirs(self.spark, self.path) if d.startswith(f"{kind}=")]
        numbers = sorted(int(d.split("=")[1]) for d in names)
        return [n for n in numbers if n < below and table_exists(self.spark, f"{self.path}/{kind}={n}")]

    def initialise(self, state: DataFrame) -> None:
        """Offline model as snapshot -1, unless there is one."""
        target = f"{self.path}/snapshot=-1"
        if not table_exists(self.spark, target):
            state.select(*online.STATE).write.mode("overwrite").parquet(target)

    def before(self, batch_id: int) -> DataFrame:
        """State as it was when ``batch_id`` began."""
        base = max(self._committed("snapshot", batch_id))
        deltas = [n for n in self._committed("batch", batch_id) if n > base]
        state = self.spark.read.parquet(f"{self.path}/snapshot={base}")
        if not deltas:
            return state
        changed = self.spark.read.parquet(*[f"{self.path}/batch={n}" for n in deltas])
        return online.merge_state(state, changed)

    def latest(self) -> DataFrame:
        return self.before(1 << 62)

    def commit(self, batch_id: int, update: Callable[[DataFrame], DataFrame]) -> bool:
        """Apply one batch; false when it was committed before (a replay)."""
        target = f"{self.path}/batch={batch_id}"
        if table_exists(self.spark, target):
            return False
        update(self.before(batch_id)).select(*online.STATE).write.mode("overwrite").parquet(target)
        if (batch_id + 1) % self.every == 0:
            self.before(batch_id + 1).write.mode("overwrite").parquet(f"{self.path}/snapshot={batch_id}")
        return True


def learner(
    table: StateTable,
    rates: dict[str, online.Rates],
    algorithm: str = "ftrl",
    loss: str = "exp",
    n_factors: int | None = None,
    metrics_path: str | None = None,
    evaluate_every: int = 1,
    validate: DataFrame | None = None,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over long examples.

    With ``metrics_path``, every ``evaluate_every`` batches are scored before the update: on the
    batch itself (prequential) or on a fixed ``validate`` set.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():  # a file source may end with an empty batch
            return
        kept = batch.persist()
        try:
            if metrics_path and batch_id % evaluate_every == 0:
                target = f"{metrics_path}/batch={batch_id}"
                if not table_exists(table.spark, target):
                    scored = online.score_batch(table.before(batch_id), validate if validate is not None else kept, n_factors)
                    report = metrics.prequential(scored.withColumn("batch_id", F.lit(batch_id)), loss)
                    report.select("rows", "accuracy", "loss").write.mode("overwrite").parquet(target)
            table.commit(
                batch_id,
                lambda state: online.batch_update(state, kept, batch_id + 1, rates, algorithm, loss, n_factors),
            )
        finally:
            kept.unpersist()

    return apply
