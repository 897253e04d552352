"""Labeled text lines: ``label name:value name:value ...``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickloom.functions.expr import parse_number, split_tokens


_EACH = 65_536  # copies of a line that one task numbers at a time


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines as ``(row_id, line)``; the id is the line's md5 and its number among equal lines.

    Ids depend on the content alone: not on files, input splits or the order of the lines. Equal lines are counted before they
    are numbered, in pieces, so that a line with a large share of all rows is no single task.
    """
    counted = spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))
    pieces = counted.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {_EACH}"))))
    spread = pieces.repartition(F.xxhash64("line", "piece"))
    last = F.least(F.col("n"), (F.col("piece") + 1) * _EACH) - 1
    each = spread.select("line", F.explode(F.sequence(F.col("piece") * _EACH, last)).alias("copy"))
    return each.select(F.concat_ws("-", F.md5("line"), "copy").alias("row_id"), "line")


def _label(raw, mode: str):
    if mode == "exp":
        return raw
    if mode == "log":
        return F.when(raw > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    raise ValueError(f"mode must be 'exp' or 'log', got {mode!r}")


def parse_labeled_lines(
    lines: DataFrame,
    mode: str = "exp",
    entity_token: str | None = None,
    default_entity: str = "0",
    feature_index: DataFrame | None = None,
    max_index: int | None = None,
) -> DataFrame:
    """``(row_id, line)`` to long examples ``(row_id, label, feature, value[, entity_id])``.

    A listed feature is present, whatever its value, so ``value`` is always 1.0. Empty tokens are
    dropped; lines without a numeric label and tokens without a name are left to
    :func:`line_errors`. ``entity_token`` names the token whose value becomes ``entity_id``.
    ``max_index`` keeps numeric feature names in ``1..max_index``; ``feature_index`` keeps the
    features of a given table (left-semi join).
    """
    tokens = split_tokens(F.col("line"))
    parsed = lines.select(
        "row_id",
        parse_number(F.get(tokens, F.lit(0))).alias("raw_label"),
        F.slice(tokens, 2, 1 << 30).alias("tokens"),
    ).filter(F.col("raw_label").isNotNull())
    entity = []
    names = F.transform(F.col("tokens"), lambda t: F.split(t, ":", 2))
    if entity_token is not None:
        hits = F.filter(names, lambda p: F.get(p, F.lit(0)) == entity_token)
        found = F.get(F.get(hits, F.lit(0)), F.lit(1))
        entity = [F.coalesce(found, F.lit(default_entity)).alias("entity_id")]
        names = F.filter(names, lambda p: F.get(p, F.lit(0)) != entity_token)
    present = F.array_distinct(F.transform(names, lambda p: F.get(p, F.lit(0))))
    examples = parsed.select(
        "row_id", _label(F.col("raw_label"), mode).alias("label"), *entity, F.explode(present).alias("feature")
    ).filter(F.col("feature") != "")
    if max_index is not None:
        index = parse_number(F.col("feature"), "bigint")
        examples = examples.filter(index.between(1, max_index))
    if feature_index is not None:
        examples = examples.join(feature_index.select("feature").distinct(), "feature", "left_semi")
    ordered = ["row_id", "label", "feature"] + (["entity_id"] if entity else [])
    return examples.select(*ordered, F.lit(1.0).alias("value"))


def read_examples(spark: SparkSession, path: str, mode: str = "exp", **options) -> DataFrame:
    """Labeled text files to long examples; see :func:`parse_labeled_lines`."""
    return parse_labeled_lines(read_lines(spark, path), mode=mode, **options)


def line_errors(lines: DataFrame) -> DataFrame:
    """Lines that cannot be used in full: ``(row_id, line, error)``."""
    tokens = split_tokens(F.col("line"))
    label = parse_number(F.get(tokens, F.lit(0)))
    nameless = F.exists(F.slice(tokens, 2, 1 << 30), lambda t: F.get(F.split(t, ":", 2), F.lit(0)) == "")
    error = F.when(label.isNull(), F.lit("label")).when(nameless, F.lit("token"))
    return lines.withColumn("error", error).filter(F.col("error").isNotNull())


def to_labeled_lines(examples: DataFrame, entity_token: str | None = None) -> DataFrame:
    """Long examples back to ``(row_id, line)``; features in name order."""
    keys = ["row_id", "label"] + (["entity_id"] if entity_token else [])
    features = F.sort_array(F.collect_set("feature"))
    head = [F.when(F.col("label") > 0, F.lit("+1")).otherwise(F.col("label").cast("int").cast("string"))]
    if entity_token:
        head.append(F.concat(F.lit(f"{entity_token}:"), F.col("entity_id")))
    body = F.transform(F.col("features"), lambda f: F.concat(f, F.lit(":1")))
    rows = examples.groupBy(*keys).agg(features.alias("features"))
    return rows.select("row_id", F.concat_ws(" ", *head, body).alias("line"))


def write_lines(examples: DataFrame, path: str, entity_token: str | None = None) -> None:
    to_labeled_lines(examples, entity_token).select("line").write.mode("overwrite").text(path)
