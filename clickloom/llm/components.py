"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clickloom.session import broadcast_if_small, cut_lineage

_LINKS = 100_000


def _tasks(links: int) -> int:
    """Tasks of a round: their number follows the links, so that a few thousand are not dealt to hundreds of tasks, again and again."""
    return 1 + links // _LINKS


def _stars(links: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Point the neighbours of each node at the least of them (large: the greater ones, small: the smaller ones)."""
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).coalesce(tasks)
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        least = F.broadcast(least) if tasks == 1 else least
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        turned = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = turned.groupBy("u").agg(F.min("v").alias("m"))
        joined = turned.join(F.broadcast(least) if tasks == 1 else least, "u")
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).coalesce(tasks)
    return out.filter("a <> b").distinct()


def _mark(links: DataFrame):
    r = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the undirected links (a, b).

    Minima are aggregated before they are joined back, so a node with very many links is no single
    group. Each round is checkpointed; their number grows with the logarithm of the longest path.
    Links to oneself and repeated links change nothing; no links give no rows.
    """
    now = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    seen = _mark(now)
    while seen[0]:
        tasks = _tasks(seen[0])
        now = cut_lineage(_stars(_stars(now.coalesce(tasks), True, tasks), False, tasks))
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    now = now.coalesce(_tasks(seen[0]))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def joined(linked: DataFrame, more: DataFrame) -> DataFrame:
    """The components of ``linked`` (node, component) after further links (a, b): only links between components are followed.

    Both are stored or checkpointed tables: they are read several times.
    """
    named = broadcast_if_small(linked)
    for end in ("a", "b"):
        own = named.select(F.col("node").alias(end), F.col("component").alias("_c"))
        more = more.join(own, end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    top = cut_lineage(components(more))
    merged = broadcast_if_small(top)
    moved = linked.join(merged.select(F.col("node").alias("component"), F.col("component").alias("_top")), "component", "left")
    known = moved.select("node", F.coalesce("_top", "component").alias("component"))
    return known.unionByName(top.join(named.select("node"), "node", "left_anti"))
