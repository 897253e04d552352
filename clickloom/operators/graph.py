"""PageRank over an edge table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from clickloom.operators.layout import lookup
from clickloom.session import BROADCAST_ROWS, broadcast_if_small, cut_lineage


def pagerank(
    edges: DataFrame,
    iterations: int = 4,
    damping: float = 0.85,
    broadcast_rows: int = BROADCAST_ROWS,
    hub_links: int = 5_000_000,
) -> DataFrame:
    """``(node, rank)``: ``(1 - damping) + damping * sum(rank / out degree)``, start rank 1.

    Ranks are not normalised and nodes without outgoing edges pass nothing on. Parallel edges are
    merged into one weighted edge first. Edges are placed by source once; a step moves ranks and one partial
    sum per destination and task. A source with more than ``hub_links`` edges is salted by
    destination, in the degree join and, once the ranks are too many to broadcast, in every step.
    """
    merged = edges.groupBy("src", "dst").agg(F.count("*").alias("mult"))
    degree = cut_lineage(merged.groupBy("src").agg(F.sum("mult").alias("degree"), F.count("*").alias("links")))
    hubs = degree.filter(F.col("links") > hub_links).select("src")  # at most edges / hub_links rows
    hot = None if hubs.isEmpty() else hubs
    weighted = lookup(merged, degree.drop("links"), ["src"], hot, salt_on="dst").select(
        F.col("src").alias("node"), "dst", (F.col("mult") / F.col("degree")).alias("share")
    )
    if hot is None:
        weighted = weighted.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")
    kept = weighted.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        nodes = cut_lineage(kept.select("node").unionByName(kept.select(F.col("dst").alias("node"))).distinct())
        ranks = nodes.withColumn("rank", F.lit(1.0))
        for _ in range(iterations):
            known = broadcast_if_small(ranks, broadcast_rows)
            salted = hot.withColumnRenamed("src", "node") if hot is not None and known is ranks else None
            sources = lookup(kept, known, ["node"], salted, salt_on="dst").groupBy(F.col("dst").alias("node"))
            received = sources.agg(F.sum(F.col("share") * F.col("rank")).alias("received"))
            rank = F.lit(1.0 - damping) + F.lit(damping) * F.coalesce("received", F.lit(0.0))
            ranks = cut_lineage(nodes.join(received, "node", "left").select("node", rank.alias("rank")))
    finally:
        kept.unpersist()
    return ranks
