"""Training-set features: frequencies, index coding, splits, samples and log joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions.hashing import hash_unit
from clickloom.operators.ordering import dense_index
from clickloom.sources.store import as_records


def composite_key(*cols: str, sep: str = "_") -> Column:
    """Text key of several columns, different for different rows.

    A separator or backslash inside a part is escaped with a backslash, and a null part is ``\\N``.
    """

    def part(c: str) -> Column:
        text = F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\"))
        return F.coalesce(F.replace(text, F.lit(sep), F.lit(f"\\{sep}")), F.lit("\\N"))

    return F.concat_ws(sep, *[part(c) for c in cols])


def frequency(df: DataFrame, key_cols: list[str], item_col: str) -> DataFrame:
    """``(keys..., item, count)`` with map-side partial counts."""
    return df.groupBy(*key_cols, item_col).agg(F.count("*").alias("count"))


def frequency_records(df: DataFrame, key_cols: list[str], item_col: str, prefix: str, version: int) -> DataFrame:
    """Frequencies as keyed records ``prefix:key -> {item: count}``, one row per field."""
    counts = frequency(df, key_cols, item_col)
    key = F.concat(F.lit(f"{prefix}:"), composite_key(*key_cols))
    return as_records(counts, key, F.col(item_col), F.col("count"), F.lit(version))


def name_value(df: DataFrame, keys: list[str], named: dict[str, Column]) -> DataFrame:
    """One row per named attribute: ``feature = name_value``; a null becomes ``name_unknown``."""
    parts = [
        F.concat(F.lit(f"{name}_"), F.coalesce(col.cast("string"), F.lit("unknown"))) for name, col in named.items()
    ]
    return df.select(*keys, F.explode(F.array(*parts)).alias("feature"))


def feature_index(examples: DataFrame) -> DataFrame:
    """Distinct features in name order with consecutive numbers from 0."""
    return dense_index(examples.select("feature").distinct(), ["feature"])


def category_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct ``(column position, value)`` of the categorical columns."""
    cells = F.posexplode(F.array(*[F.col(c).cast("string") for c in cols])).alias("position", "value")
    return df.select(cells).filter(F.col("value").isNotNull()).distinct()


def category_index(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(position, value, idx)``: one running number over all columns, from 0."""
    return dense_index(category_values(df, cols), ["position", "value"])


def code_categories(df: DataFrame, cols: list[str], index: DataFrame, unseen: int = -1) -> DataFrame:
    """Replace each category by its number; an unseen or null one by ``unseen``.

    One lookup join per column, so the table keeps its row layout. Spark broadcasts the index when
    it is small enough and splits skewed values otherwise.
    """
    for position, col in enumerate(cols):
        lookup = index.filter(F.col("position") == position).select(
            F.col("value").alias(f"_v_{position}"), F.col("idx").alias(f"{col}_idx")
        )
        df = df.join(lookup, F.col(col).cast("string") == F.col(f"_v_{position}"), "left").drop(f"_v_{position}")
        df = df.withColumn(f"{col}_idx", F.coalesce(F.col(f"{col}_idx"), F.lit(unseen)))
    return df


def clean_number(col: Column) -> Column:
    """Text or number to double; negative (missing) to 0; unreadable stays null."""
    return F.greatest(col.try_cast("double"), F.lit(0.0))


def densest_feature(examples: DataFrame) -> DataFrame:
    """One row: most frequent feature (ties: smallest name), its count and the largest name."""
    counts = examples.groupBy("feature").agg(F.count("*").alias("n"))
    return counts.agg(
        F.min_by("feature", F.struct(-F.col("n"), "feature")).alias("feature"),
        F.max("n").alias("n"),
        F.max("feature").alias("largest_feature"),
    )


def entity_sizes(examples: DataFrame, entity_col: str = "entity_id") -> DataFrame:
    """Rows per entity (skew report)."""
    return examples.groupBy(entity_col).agg(F.count("*").alias("rows"))


def partition_sizes(df: DataFrame) -> DataFrame:
    """Rows per physical partition."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("rows"))


def hash_split(df: DataFrame, key: list[Column], train: float = 0.8, seed: int = 37) -> DataFrame:
    """Add ``split`` = train / validate by a hash of the key: stable under retries and re-reads."""
    return df.withColumn(
        "split", F.when(hash_unit(*key, seed) < F.lit(train), F.lit("train")).otherwise(F.lit("validate"))
    )


def random_split(df: DataFrame, train: float = 0.8, seed: int = 37) -> list[DataFrame]:
    return df.randomSplit([train, 1.0 - train], seed)


def negative_positions(candidates: Column, clicked: Column, key: list[Column], n: int = 1, seed: int = 5) -> Column:
    """Up to ``n`` positions of the list whose id is not the clicked one, in hash order.

    Works inside the row, so it needs no shuffle; a list without another id gives an empty array.
    """
    drawn = F.transform(
        candidates, lambda c, i: F.struct(hash_unit(*key, i, seed).alias("h"), i.alias("pos"), c.alias("id"))
    )
    others = F.sort_array(F.filter(drawn, lambda d: d["id"] != clicked))
    return F.slice(others, 1, n)


def impression_clicks(impressions: DataFrame, clicks: DataFrame) -> DataFrame:
    """Inner join on (list_session_id, user_id); the impression time is dropped."""
    return impressions.drop("timestamp").join(clicks, ["list_session_id", "user_id"])


def with_user_info(joined: DataFrame, users: DataFrame) -> DataFrame:
    return joined.join(users, "user_id")


def clicked_in_list(joined: DataFrame) -> DataFrame:
    """Keep clicks whose id is in the list; a position that does not hold it is corrected."""
    ids = F.split("feat_id_list", ",")
    held = F.get(ids, F.col("position").cast("int")) == F.col("feat_id")
    first = (F.array_position(ids, F.col("feat_id")) - 1).cast("bigint")
    return (
        joined.withColumn("candidates", ids)
        .filter(F.array_contains("candidates", F.col("feat_id")))
        .withColumn("position", F.when(F.coalesce(held, F.lit(False)), F.col("position")).otherwise(first))
    )


USER_FEATURES = {
    "age": "age_group",
    "fans": "fans_count_level",
    "gender": "gender",
    "networkType": "network_type",
    "os": "os",
}


def labeled_clicks(clicked: DataFrame, negatives: int = 1, seed: int = 5) -> DataFrame:
    """Each click as one positive and up to ``negatives`` negative rows of the same list.

    Expects the output of :func:`clicked_in_list`; click rows must be distinct. Keys are escaped, so different clicks and
    rows have different ones, whatever characters or nulls their parts have.
    """
    names = ("list_session_id", "user_id", "timestamp", "feat_id", "position")
    key = [F.col(c) for c in names]
    negative = F.transform(
        negative_positions(F.col("candidates"), F.col("feat_id"), key, negatives, seed),
        lambda d: F.struct(F.lit(-1.0).alias("label"), d["id"].alias("id"), d["pos"].cast("bigint").alias("pos")),
    )
    positive = F.array(F.struct(F.lit(1.0).alias("label"), F.col("feat_id").alias("id"), F.col("position").alias("pos")))
    rows = clicked.withColumn("click_key", composite_key(*names, sep="|")).withColumn("s", F.explode(F.concat(positive, negative)))
    return rows.select(
        composite_key(*names, "s.id", "s.pos", sep="|").alias("row_id"),
        "click_key",
        "list_session_id",
        "user_id",
        F.col("s.label").alias("label"),
        F.col("s.id").alias("entity_id"),
        F.col("s.pos").alias("position"),
        *USER_FEATURES.values(),
    )


def training_set(
    impressions: DataFrame,
    clicks: DataFrame,
    users: DataFrame,
    negatives: int = 1,
    train: float = 0.8,
    seed: int = 5,
) -> DataFrame:
    """Three logs to ``(row_id, split, label, entity_id, feature, value)`` in one plan.

    The positive and the negatives of one click always fall into the same split. Log lines that were
    delivered twice count once; an impression's time is not looked at.
    """
    impressions = impressions.dropDuplicates([c for c in impressions.columns if c != "timestamp"])
    joined = with_user_info(impression_clicks(impressions, clicks.distinct()), users)
    rows = labeled_clicks(clicked_in_list(joined), negatives, seed)
    rows = hash_split(rows, [F.col("click_key")], train, seed)
    named = {"pos": F.col("position"), **{n: F.col(c) for n, c in USER_FEATURES.items()}}
    long = name_value(rows, ["row_id", "split", "label", "entity_id"], named)
    return long.withColumn("value", F.lit(1.0))


def seen_entities(impressions: DataFrame) -> DataFrame:
    """Distinct candidate ids over all lists."""
    return impressions.select(F.explode(F.split("feat_id_list", ",")).alias("entity_id")).distinct()
