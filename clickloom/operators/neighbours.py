"""Exact cosine neighbours of dense vectors.

Vectors are cut into cells around pivots. A vector first gets an upper bound on the distance of its
k-th neighbour from a piece of its own cell; by the triangle inequality it then needs to meet only
the cells that come closer than this bound. A piece, of bounded size, is one row of bytes; the pieces are paired by a
product that reads both sides from the shared folder, and a task returns at most ``k`` rows per vector and part of the other side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from clickloom.functions.expr import dot
from clickloom.session import cut_lineage

MAX_PIVOTS = 2048
SLACK = 1e-6  # covers rounding in the distance bounds
DIGITS = 9  # similarities equal to this many digits are ties, broken by id
TIE = 2e-9  # more than similarities that are ties can differ
RUN_BYTES = 64 << 20  # of the vectors that a task holds of the side it goes through again and again


def _partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _raw(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def merge_copies(vectors: DataFrame, id_col: str, vector_col: str, keep: int) -> DataFrame:
    """``(v, vid, ids, unit)``: equal vectors are one row with the ``keep`` smallest ids.

    The limit works on the map side, so very many copies of a vector are never in one task.
    """
    rows = _raw(vectors, id_col, vector_col)
    order = Window.partitionBy("v").orderBy("id")
    firsts = rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= keep)
    merged = firsts.groupBy("v").agg(F.min("id").alias("vid"), F.sort_array(F.collect_list("id")).alias("ids"))
    norm = F.sqrt(dot(F.col("v"), F.col("v")))
    return merged.withColumn("norm", norm).filter("norm > 0").select(
        "v", "vid", "ids", F.transform("v", lambda x: x / F.col("norm")).alias("unit")
    )


def _distances(units: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * units @ others.T))


def _assign(pivots: np.ndarray):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                d = _distances(np.stack(pdf["unit"].to_numpy()), pivots)
                cell = d.argmin(axis=1)
                yield pdf.assign(cell=cell, dist=d[np.arange(len(pdf)), cell])

    return run


def _pack(k: int, pivots: np.ndarray, radius: np.ndarray):
    """A piece of a cell as one row: ids, units and least similarities of interest in bytes, and the cells it must meet."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        units = np.stack(pdf["unit"].to_numpy())
        theta = np.full(len(pdf), 2.0)  # no two unit vectors are further apart
        if len(pdf) > k:
            for begin in range(0, len(pdf), 1024):
                d = _distances(units[begin : begin + 1024], units)
                d[np.arange(len(d)), begin + np.arange(len(d))] = np.inf
                theta[begin : begin + 1024] = np.partition(d, k - 1, axis=1)[:, k - 1]
        theta = np.sqrt(theta * theta + 4 * TIE)  # ties of the k-th, too
        reach = (_distances(units, pivots) - radius <= theta[:, None] + SLACK).any(axis=0)
        ids = pdf["vid"].to_numpy(np.int64)
        packed = [key[0], ids.tobytes(), units.tobytes(), (1.0 - theta * theta / 2).tobytes(), np.flatnonzero(reach)]
        return pd.DataFrame([packed], columns=["cell", "ids", "units", "floor", "reach"])

    return run


def _best(place: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int):
    """The ``k`` highest similarities of every place, the smaller id first among ties."""
    order = np.lexsort((ids, -sims, place))
    place, ids, sims = place[order], ids[order], sims[order]
    keep = np.arange(len(place)) - np.searchsorted(place, place) < k
    return place[keep], ids[keep], sims[keep]


def _tile(k: int, width: int):
    """Pairs of pieces to the ``k`` best of every visitor; the pairs of one piece follow each other inside a task."""

    def run(batches):
        name, ids, found = None, None, None

        def ended():
            place, others, sims = found
            return pa.RecordBatch.from_arrays([pa.array(ids[place]), pa.array(others), pa.array(sims)], ["vid", "other", "sim"])

        for batch in batches:
            for own, units, floor, others, members in zip(*(c.to_pylist() for c in batch.columns)):
                if own != name:
                    if name is not None:
                        yield ended()
                    name, ids = own, np.frombuffer(own, np.int64)
                    mine, least = np.frombuffer(units).reshape(-1, width), np.frombuffer(floor).copy()
                    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                others, members = np.frombuffer(others, np.int64), np.frombuffer(members).reshape(-1, width)
                parts = [found]
                for begin in range(0, len(ids), 256):
                    sims = mine[begin : begin + 256] @ members.T
                    at, other = np.nonzero(sims >= least[begin : begin + 256, None])
                    keep = ids[begin + at] != others[other]
                    at, other = at[keep], other[keep]
                    parts.append(_best(begin + at, others[other], np.round(sims[at, other], DIGITS), k))
                found = _best(*(np.concatenate(x) for x in zip(*parts)), k)
                last = np.flatnonzero(np.bincount(found[0], minlength=len(ids)) == k)
                least[last] = np.maximum(least[last], found[2][np.searchsorted(found[0], last, "right") - 1] - TIE)
        if name is not None:
            yield ended()

    return run


def cosine_topk(vectors: DataFrame, id_col: str, vector_col: str, k: int = 10, block: int = 2048, pivots: int | None = None) -> DataFrame:
    """``(id, neighbour, sim, rank)``: the ``k`` vectors with the highest cosine, ties by id.

    Zero vectors have no direction and take no part. Only the pivots (at most ``MAX_PIVOTS``) and
    one summary row per cell pass through the driver.
    """
    base = cut_lineage(merge_copies(vectors, id_col, vector_col, k + 1))
    total = base.count()
    wanted = max(1, min(MAX_PIVOTS, pivots or -(-total // block)))
    chosen = base.orderBy(F.xxhash64("vid"), "vid").limit(wanted).select("unit").collect()
    if not chosen:
        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"{id_col} {kind}, neighbour {kind}, sim double, rank long")
    centres = np.array([r["unit"] for r in chosen])
    placed = cut_lineage(
        base.select("vid", "unit").mapInPandas(_assign(centres), "vid long, unit array<double>, cell int, dist double")
    )
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius"))
    cells = cut_lineage(cells.withColumn("pieces", F.ceil(F.col("n") / block).cast("int")))
    radius = np.full(len(centres), -np.inf)
    for r in cells.select("cell", "radius").collect():  # one row per pivot
        radius[r["cell"]] = r["radius"]
    radius = np.where(np.isfinite(radius), radius, -4.0)  # an empty cell is out of reach
    piece = F.pmod(F.xxhash64("vid"), F.col("pieces")).cast("int").alias("piece")
    members = placed.join(F.broadcast(cells), "cell").select("vid", "unit", "cell", piece)  # cells: one row per pivot
    packed = cut_lineage(
        members.groupBy("cell", "piece").applyInPandas(_pack(k, centres, radius), "cell int, ids binary, units binary, floor binary, reach array<int>")
    )
    width = centres.shape[1]
    runs = -(-total * width * 8 // RUN_BYTES)
    own = cut_lineage(packed.repartition(max(1, min(packed.count(), _partitions(vectors.sparkSession)))))
    other = cut_lineage(packed.repartition(runs)).select(F.col("cell").alias("at"), F.col("ids").alias("others"), F.col("units").alias("members"))
    # A product without shuffle: every task reads one part of either side, so that no vector is copied for the cells it visits.
    pairs = own.hint("shuffle_replicate_nl").join(other, F.array_contains("reach", F.col("at")))
    near = pairs.select("ids", "units", "floor", "others", "members").mapInArrow(_tile(k, width), "vid long, other long, sim double")
    best = Window.partitionBy("vid").orderBy(F.desc("sim"), "other")
    distinct = near.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k).select("vid", "other", "sim")
    return _for_all_ids(_raw(vectors, id_col, vector_col), base, distinct, k).withColumnRenamed("id", id_col)


def _for_all_ids(raw: DataFrame, base: DataFrame, distinct: DataFrame, k: int) -> DataFrame:
    """Neighbours of distinct vectors to neighbours of every id, copies of a vector included."""
    listed = base.select(F.col("vid").alias("other"), "ids")
    own = base.select("vid", F.lit(1.0).alias("sim"), F.explode("ids").alias("neighbour"))
    other = distinct.join(listed, "other").select("vid", "sim", F.explode("ids").alias("neighbour"))
    best = Window.partitionBy("vid").orderBy(F.desc("sim"), "neighbour")
    top = (
        own.unionByName(other)
        .withColumn("rn", F.row_number().over(best))
        .filter(F.col("rn") <= k + 1)
        .groupBy("vid")
        .agg(F.sort_array(F.collect_list(F.struct("rn", "sim", "neighbour"))).alias("top"))
    )
    by_vector = base.select("v", "vid").join(top, "vid").select("v", "top")
    mine = F.slice(F.filter("top", lambda t: t["neighbour"] != F.col("id")), 1, k)
    return (
        raw.join(by_vector, "v")
        .select("id", F.posexplode(mine).alias("pos", "t"))
        .select("id", F.col("t.neighbour").alias("neighbour"), F.col("t.sim").alias("sim"), (F.col("pos") + 1).cast("bigint").alias("rank"))
    )
