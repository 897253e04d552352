"""Physical layout of training examples and skew-safe model lookups.

Models of entities meet their rows by entity: a row carries its features as one array, rows of an entity stay where they are for all
iterations, and what moves is one row of weights per entity and one partial gradient per weight.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.functions.expr import multiplier, pointwise_loss
from clickloom.session import BROADCAST_ROWS, broadcast_if_small, cut_lineage


@contextmanager
def by_row(examples: DataFrame, partitions: int | None = None, placed: bool = False):
    """Examples hash-partitioned and sorted on ``row_id``, kept for the iterations inside.

    The explicit partition number stops later stages from re-shuffling: the per-row sums of every
    iteration then run inside the partitions. ``placed`` examples already have this layout.
    """
    spark = examples.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not placed:
        examples = examples.repartition(n, "row_id").sortWithinPartitions("row_id")
    kept = examples.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        kept.count()
        yield kept
    finally:
        kept.unpersist()


def per_row(value: Column) -> Column:
    """Sum over the features of one row, on every feature row (no join back)."""
    return F.sum(value).over(Window.partitionBy("row_id"))


def hot_keys(df: DataFrame, on: list[str], rows: int) -> DataFrame:
    """Keys with more than ``rows`` rows: at most count / rows of them."""
    return df.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows).drop("_n")


def lookup(
    examples: DataFrame,
    model: DataFrame,
    on: list[str],
    hot: DataFrame | None = None,
    salts: int = 32,
    salt_on: str = "row_id",
) -> DataFrame:
    """Left join of examples with a model table on ``on``.

    Without ``hot`` Spark chooses: broadcast by measured size, or a shuffled join with AQE skew
    splitting. With ``hot`` (see :func:`hot_keys`) the rows of those keys are spread over ``salts``
    groups and only their model rows are copied, so a key with a third of all rows is never one task.
    """
    if hot is None:
        return examples.join(model, on, "left")
    marked = hot.withColumn("_hot", F.lit(True))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(salt_on), F.lit(salts))).otherwise(F.lit(0))
    big = examples.join(F.broadcast(marked), on, "left").withColumn("_salt", salt).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    small = model.join(F.broadcast(marked), on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    small = small.withColumn("_salt", F.col("_salt").cast("bigint"))
    return big.join(small, [*on, "_salt"], "left").drop("_salt")


class ModelLookup:
    """Chooses the join for one training run: broadcast within the bound, else salted hot keys."""

    def __init__(self, examples: DataFrame, on: list[str], max_rows: int, hot_rows: int = 5_000_000, salt_on: str = "row_id"):
        self.on, self.max_rows, self.hot_rows, self.salt_on = on, max_rows, hot_rows, salt_on
        self.examples, self.hot = examples, None

    def join(self, model: DataFrame) -> DataFrame:
        hinted = broadcast_if_small(model, self.max_rows)
        if hinted is not model:
            return self.examples.join(hinted, self.on, "left")
        if self.hot is None:  # the hot keys depend on the examples only, so one count serves all iterations
            self.hot = cut_lineage(hot_keys(self.examples, self.on, self.hot_rows))
        return lookup(self.examples, model, self.on, self.hot, salt_on=self.salt_on)


#: An entity with more rows is dealt to several tasks, and a model of an entity with more features meets its rows feature by feature.
ENTITY_ROWS = 1_000_000
ENTITY_FEATURES = 1_000


def narrow_models(weights: DataFrame, bound: int = ENTITY_FEATURES) -> bool:
    """True when no entity has more than ``bound`` weights."""
    wide = weights.groupBy("entity_id").agg(F.count("*").alias("n")).filter(F.col("n") > bound)
    return wide.isEmpty()


class EntityRows:
    """Packed examples ``(row_id, label, entity_id, offset, cells)``, hash-partitioned and sorted on the entity.

    ``arranged`` comes from :func:`by_row`, so packing needs no shuffle. The rows of an entity beyond ``ENTITY_ROWS`` are dealt to
    pieces, each with a copy of the entity's weights.
    """

    def __init__(self, arranged: DataFrame, entity_rows: int = ENTITY_ROWS):
        offset = F.col("offset") if "offset" in arranged.columns else F.lit(0.0)
        cells = arranged.select("row_id", "label", "entity_id", offset.alias("offset"), F.struct("feature", "value").alias("cell"))
        packed = cells.groupBy("row_id", "label", "entity_id", "offset").agg(F.collect_list("cell").alias("cells"))
        self.hot = cut_lineage(  # at most rows / entity_rows
            packed.groupBy("entity_id").agg(F.ceil(F.count("*") / F.lit(entity_rows)).alias("pieces")).filter("pieces > 1")
        )
        n = int(arranged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = packed.join(F.broadcast(self.hot), "entity_id", "left").withColumn(
            "piece", F.pmod(F.xxhash64("row_id"), F.coalesce("pieces", F.lit(1).cast("bigint"))).cast("int")
        )
        placed = dealt.drop("pieces").repartition(n, "entity_id", "piece").sortWithinPartitions("entity_id", "piece")
        self.rows = placed.persist(StorageLevel.MEMORY_AND_DISK)

    def scored(self, weights: DataFrame, score: str = "score") -> DataFrame:
        """Add the score under ``weights(entity_id, feature, w)``, the offset included."""
        last = F.coalesce(F.col("pieces"), F.lit(1)).cast("int") - 1
        copied = weights.filter(F.col("feature").isNotNull()).join(F.broadcast(self.hot), "entity_id", "left").select(
            "entity_id", F.explode(F.sequence(F.lit(0), last)).alias("piece"), F.struct("feature", F.coalesce("w", F.lit(0.0))).alias("own")
        )
        own = copied.groupBy("entity_id", "piece").agg(F.map_from_entries(F.collect_list("own")).alias("own"))
        part = lambda total, c: total + c["value"] * F.coalesce(F.try_element_at("own", c["feature"]), F.lit(0.0))
        joined = self.rows.join(own, ["entity_id", "piece"], "left")
        return joined.withColumn(score, F.col("offset") + F.aggregate("cells", F.lit(0.0), part)).drop("own")

    def gradient(self, weights: DataFrame, loss: str) -> DataFrame:
        """(entity_id, feature, grad, rows, part): summed gradient and rows, and the weight's part of the loss."""
        label, s = F.col("label"), F.col("score")
        share = pointwise_loss(label, s, loss) / F.size("cells")
        cells = self.scored(weights).select("entity_id", multiplier(label, s, loss).alias("m"), share.alias("share"), F.inline("cells"))
        return cells.groupBy("entity_id", "feature").agg(
            F.sum(F.col("m") * F.col("value")).alias("grad"), F.count("*").alias("rows"), F.sum("share").alias("part")
        )

    def close(self) -> None:
        self.rows.unpersist()


@contextmanager
def by_entity(arranged: DataFrame, on: list[str], broadcast_rows: int = BROADCAST_ROWS):
    """:class:`EntityRows` for models of entities; None for other keys, for models that can be broadcast, and where one has very many features."""
    pairs = arranged.select(*on).distinct()
    if on != ["entity_id", "feature"] or pairs.count() <= broadcast_rows or not narrow_models(pairs):
        yield None
        return
    rows = EntityRows(arranged)
    try:
        yield rows
    finally:
        rows.close()
