"""Inputs of the catalogue, derived from the benchmark tables with whole-table plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clickloom.functions.hashing import hash_int
from clickloom.sources.logs import read_table

LABEL_CUT = 35.0
LIST_LENGTH = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k() -> Column:
    """The number inside ``props`` (``{"k": 87}``)."""
    return F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")


def event_rows(events: DataFrame, features: Column | None = None) -> DataFrame:
    """One labeled row per event with its attributes."""
    return events.select(
        F.col("event_id").alias("row_id"),
        F.when(F.col("value") > LABEL_CUT, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("label"),
        F.col("user_id").cast("string").alias("entity_id"),
        "ts",
        (_attributes() if features is None else features).alias("features"),
    )


def _attributes() -> Column:
    return F.array(
        F.concat(F.lit("type_"), F.col("event_type")),
        F.concat(F.lit("hour_"), F.hour("ts").cast("string")),
        F.concat(F.lit("k_"), F.expr("cast(regexp_extract(props, '([0-9]+)', 1) as bigint) div 10").cast("string")),
    )


def event_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long examples ``(row_id, label, entity_id, feature, value)`` from events."""
    return event_rows(table(spark, sf_dir, "events")).select(
        "row_id", "label", "entity_id", F.explode("features").alias("feature"), F.lit(1.0).alias("value")
    )


def valued_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event examples with 0/1 labels, real values and an offset: the hour, and the number in ``props`` as a share of 100."""
    rows = event_rows(table(spark, sf_dir, "events").withColumn("k", _k()), _hour_and_number())
    return rows.select(
        "row_id",
        F.when(F.col("label") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("label"),
        "entity_id",
        ((F.col("row_id") % 5 - 2) * F.lit(0.1)).alias("offset"),
        F.inline("features"),
    )


def _hour_and_number() -> Column:
    hour = F.struct(F.concat(F.lit("hour_"), F.hour("ts").cast("string")).alias("feature"), F.lit(1.0).alias("value"))
    return F.array(hour, F.struct(F.lit("number").alias("feature"), (F.col("k") / F.lit(100.0)).alias("value")))


def dated_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event examples with ``half``: 0 before the 16th of the month, 1 after, for two batches."""
    return event_rows(table(spark, sf_dir, "events")).select(
        "row_id",
        "label",
        "entity_id",
        F.when(F.dayofmonth("ts") < 16, F.lit(0)).otherwise(F.lit(1)).alias("half"),
        F.explode("features").alias("feature"),
        F.lit(1.0).alias("value"),
    )


def _session() -> Column:
    return F.concat(F.col("user_id").cast("string"), F.lit("_"), F.date_format("ts", "yyyyMMdd"))


def with_session(events: DataFrame) -> DataFrame:
    return events.withColumn("list_session_id", _session())


def _candidate(place) -> Column:
    return (hash_int(F.col("list_session_id"), place) % F.col("parts")).cast("string")


def _with_parts(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    return df.withColumn("parts", table(spark, sf_dir, "part").agg(F.count("*")).scalar())


def impressions_of(views: DataFrame) -> DataFrame:
    """View events (with ``parts``) to one candidate list per user and day."""
    sessions = views.groupBy(
        _session().alias("list_session_id"), F.col("user_id").cast("string").alias("user_id"), "parts"
    ).agg(F.min(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("timestamp"))
    return sessions.select(
        "list_session_id",
        "user_id",
        "timestamp",
        F.concat_ws(",", *[_candidate(i) for i in range(LIST_LENGTH)]).alias("feat_id_list"),
    )


def clicks_of(clicks: DataFrame) -> DataFrame:
    """Click events (with ``parts``) to clicks on the list of that user and day."""
    rows = with_session(clicks).withColumn("k", _k())
    place = F.col("k") % LIST_LENGTH
    stray = F.when(F.col("k") >= 90, F.lit("x")).otherwise(place.cast("string"))
    return rows.select(
        "list_session_id",
        F.col("user_id").cast("string").alias("user_id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
        _candidate(stray).alias("feat_id"),
        place.alias("position"),
    )


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    return impressions_of(_with_parts(spark, sf_dir, views))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter(F.col("event_type") == "click")
    return clicks_of(_with_parts(spark, sf_dir, rows))


SEGMENT_LEVELS = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4, "MACHINERY": 5}


def _segment_level() -> Column:
    level = F.lit(None).cast("int")
    for name, number in SEGMENT_LEVELS.items():
        level = F.when(F.col("c_mktsegment") == name, F.lit(number)).otherwise(level)
    return level


def _codes() -> list[Column]:
    return [
        (F.col("c_custkey") % 7).cast("int").alias("age_group"),
        (F.col("c_nationkey") % 3).cast("int").alias("gender"),
        _segment_level().alias("fans_count_level"),
        (F.col("c_nationkey") % 4).cast("int").alias("os"),
        (F.col("c_custkey") % 4).cast("int").alias("network_type"),
    ]


def user_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return customers.select(F.col("c_custkey").cast("string").alias("user_id"), *_codes())


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User profiles from customers and their orders."""
    totals = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"),
        F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
    )
    joined = table(spark, sf_dir, "customer").join(totals, "c_custkey", "left").fillna(0, ["n", "cents", "finished"])
    rate = F.coalesce(F.try_divide(F.lit(100.0) * F.col("finished"), F.col("n")), F.lit(0.0))
    return joined.select(
        F.col("c_custkey").alias("user_id"),
        *_codes(),
        (F.lit(20) * F.col("n")).alias("enable_times"),
        F.expr("cents div 100000").alias("post_times"),
        rate.alias("enable_rate"),
    )


CLICK_CATEGORIES = ["priority", "segment", "nation", "month"]


def click_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click log from orders: click, four categorical and two numeric columns."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey", "c_acctbal"
    )
    return table(spark, sf_dir, "orders").join(customers, "o_custkey").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("click"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").cast("string").alias("nation"),
        F.month("o_orderdate").cast("string").alias("month"),
        F.col("o_totalprice").cast("string").alias("price_text"),
        F.col("c_acctbal").cast("string").alias("balance_text"),
    )


NUMBERS = ["price", "balance", "month"]


def numeric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click log with numeric columns: labels -1/+1, and no balance where it is negative."""
    balance = F.col("balance_text").cast("double")
    return click_log(spark, sf_dir).select(
        F.col("id").alias("row_id"),
        F.when(F.col("click") == 1, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("label"),
        F.col("price_text").cast("double").alias("price"),
        F.when(balance >= 0, balance).alias("balance"),
        F.col("month").cast("double").alias("month"),
    )


def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows from lineitem: returned or not, scored by the net price."""
    net = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", F.lit(1.0)).otherwise(F.lit(-1.0)).alias("label"),
        F.round(net / F.lit(50000.0) - F.lit(1.0), 4).alias("score"),
    )


def purchase_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to part edges, one per order line."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_partkey")
    return orders.join(lines, "key").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking requests: the candidate lists, asked for again."""
    return impressions(spark, sf_dir).withColumnRenamed("feat_id_list", "feat_list")


def repeated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request twice, with its list turned round under the same key, and without session and time."""
    rows = requests(spark, sf_dir).select("user_id", "list_session_id", "timestamp", "feat_list")
    turned = F.concat_ws(",", F.reverse(F.split("feat_list", ",")))
    nulls = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("list_session_id", "timestamp")}
    return rows.union(rows).union(rows.withColumn("feat_list", turned)).union(rows.withColumns(nulls))


def request_rows(views: DataFrame) -> DataFrame:
    """One ranking request per view event (with ``parts``); works on a stream, too."""
    rows = with_session(views)
    return rows.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.concat_ws("_", "list_session_id", F.col("event_id").cast("string")).alias("list_session_id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.concat_ws(",", *[_candidate(i) for i in range(LIST_LENGTH)]).alias("feat_list"),
    )
