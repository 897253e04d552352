"""Near copies by n-gram Jaccard similarity: a join of parity sketches, verified on the whole sets.

A document's set holds the hashes of its distinct shingles. Its parity sketch has one bit per possible
hash of a (lane, code): each shingle flips one bit, so the Hamming distance of two sketches is at most
the symmetric difference of the sets. Sets of sizes a and b that link (Jaccard >= threshold) differ in
at most d = (1 - t) / (1 + t) * (a + b) shingles, and hence in at most d of the m lanes into which the
sketch is cut: with m = d + 2 + g lanes, at least g + 2 are equal. A lane travels as the 64-bit XOR hash
of its set bits.

* Sizes fall into bands; a document also enters the next band if a partner may lie there. d and m are
  those of the band.
* Empty lanes are not joined. A document with more than g empty ones also brings lanes of another
  hash seed (and after four seeds its empty lanes), so that a linked pair still shares two lanes.
* Equal sets are one node from the start. In each group of equal lanes all members are compared with the
  least one, the hub; links are verified on the whole sets, and their components taken.
* Members of a group that are still in different components may be linked with one another. The symmetric
  difference is a metric, so both are near the hub or both are far from it. Near members are written as
  edits (their difference to the hub): as not both link to the hub, they can only link if their edits
  overlap by a known number, which a prefix join over the rarest edits finds. Thus thousands of
  copies that all differ too much from one another are not compared pair by pair. Far members share a
  group through common passages. Linked pairs share two lanes, all of them far where none has a near
  hub, so members with two such lanes meet in a prefix join over the rarest shingles of their sets.
  Both joins first link to the least member of each group and then compare what is still apart, so
  no link between components is lost.

Shuffles of whole sets, lanes or elements are cut by hash into parts that are written one after the other
(:func:`_in_parts`), so the disk holds the shuffle files of one part only.

Cases: null and empty texts have an empty set and are alone. Texts with fewer words than a shingle have
one shingle, the whole sequence. Repeated rows and keys are equal sets of their own rows; a null key
never names a component unless all keys of it are null. An empty table gives no rows. Only key and text are read.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clickloom.llm.cells import LOWER_CODES, SPACE, Texts, mix, owner, slices, windows
from clickloom.llm.components import components, joined
from clickloom.session import broadcast_if_small, scratch_path

SHINGLE, PERCENT = 4, 85
_SEEDS = 4
_RATIO = 1.5
_LANE_PARTS = 2
_SLICE = 1 << 20
_ROW = 4  # an element that travels in a row of its own takes about so many times its room in a set
_PART = 1 << 24  # elements that are not worth a cut
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shingle_sets(texts: Texts, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and pointers (n + 1) into them."""
    start, end, ptr = texts.runs(~SPACE)
    h = texts.hashes(start, end, LOWER_CODES)
    grams, first = windows(h, ptr, k)
    doc = owner(ptr)[first]
    words = np.diff(ptr)
    for short in range(1, k):
        own = np.flatnonzero(words == short)
        if len(own):
            acc = np.full(len(own), short, np.uint64)
            for j in range(short):
                acc = mix(acc + h[ptr[own] + j])
            grams, doc = np.concatenate([grams, acc]), np.concatenate([doc, own])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(texts.n + 1))


class Bands:
    """Size bands: lower bounds, differences d, lanes m and spare lanes g of each."""

    def __init__(self, percent: int):
        self.percent = percent
        low = [1]
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, int(np.ceil(low[-1] * _RATIO))))
        self.low = np.array(low)
        most = 2 * (self.low[1:] - 1)
        self.d = (100 - percent) * most // (100 + percent)
        # spare lanes: what the smallest sets of a band leave empty by chance, with a margin
        least, self.g = percent * self.low[:-1] / 100, np.ones(len(self.d), np.int64)
        for _ in range(60):
            m = self.d + 2 + self.g
            empty = m * np.exp(-least / m)
            self.g = np.maximum(self.g, np.ceil(empty + 2 * np.sqrt(empty)).astype(np.int64))
        self.m = np.where(self.d > 0, self.d + 2 + self.g, 0)  # without differences only equal sets link

    def of(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into n, band) of every entry: the own band, and the next one where a partner may be."""
        own = np.searchsorted(self.low, n, "right") - 1
        up = np.flatnonzero((n > 0) & (100 * n >= self.percent * self.low[np.minimum(own + 1, len(self.low) - 2)]))
        live = np.flatnonzero(n > 0)
        who, band = np.concatenate([live, up]), np.concatenate([own[live], own[up] + 1])
        keep = self.m[band] > 0
        return who[keep], band[keep]


def lanes(grams: np.ndarray, ptr: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Lane keys of all texts, and pointers per text."""
    who, band = bands.of(np.diff(ptr))
    owners, keys = [], []
    for seed in range(_SEEDS):
        if not len(who):
            break
        size = np.diff(ptr)[who]
        at = np.repeat(ptr[who] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        h = mix(grams[at] + np.uint64(0xA5A5 + 2 * seed))
        m = bands.m[band]
        base = np.concatenate([[0], np.cumsum(m)])
        lane = np.repeat(base[:-1], size) + (h % np.repeat(m, size).astype(np.uint64)).astype(np.int64)
        code = mix(h + np.uint64(0x51ED))
        order = np.argsort(lane, kind="stable")
        lane, code = lane[order], code[order]
        head = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
        filled = lane[head]
        value = np.zeros(base[-1], np.uint64)
        value[filled] = np.bitwise_xor.reduceat(code, head)
        entry = np.repeat(np.arange(len(who)), m)
        full = np.zeros(base[-1], bool)
        full[filled] = True
        empty = np.bincount(entry[~full], minlength=len(who))
        short = empty > bands.g[band]
        send = full | short[entry] if seed == _SEEDS - 1 else full
        number = np.arange(base[-1]) - base[:-1][entry]
        tag = mix((band[entry].astype(np.uint64) << np.uint64(40)) + (number.astype(np.uint64) << np.uint64(3)) + np.uint64(seed))
        owners.append(who[entry[send]])
        keys.append(mix(value[send] + tag[send]))
        who, band = who[short], band[short]
    if not owners:
        return np.empty(0, np.uint64), np.zeros(len(ptr), np.int64)
    own, key = np.concatenate(owners), np.concatenate(keys)
    order = np.argsort(own, kind="stable")
    return key[order], np.searchsorted(own[order], np.arange(len(ptr)))


def _prints(grams: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit fingerprint of each set, as two 64-bit sums."""
    out = []
    for salt in (0x1234567, 0x89ABCDE):
        total = np.zeros(len(grams) + 1, np.uint64)
        np.cumsum(mix(grams + np.uint64(salt)), out=total[1:])
        out.append((total[ptr[1:]] - total[ptr[:-1]]).view(np.int64))
    return out[0], out[1]


def sketches(docs: DataFrame, key: str, text: str, percent: int, k: int) -> DataFrame:
    """(_key, n, hi, lo, lanes) of every text, in one pass."""
    bands = Bands(percent)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, _SLICE):
                grams, ptr = shingle_sets(Texts(part.column(text)), k)
                hi, lo = _prints(grams, ptr)
                keys, at = lanes(grams, ptr, bands)
                listed = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(np.diff(ptr)), pa.array(hi), pa.array(lo), listed], names=["_key", "n", "hi", "lo", "lanes"])

    kind = dict(docs.select(key).dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"_key {kind}, n bigint, hi bigint, lo bigint, lanes array<bigint>")


def _groups(rows: DataFrame) -> DataFrame:
    """(lane, hub, node) for the rows (lane, node) of each group of equal lanes; the hub is its least node.

    Rows are dealt and sorted by lane in Spark; a task streams over them and holds one batch.
    """

    def run(batches):
        lane, hub = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            lanes_, nodes = batch.column("lane").to_numpy(), batch.column("node").to_numpy()
            new = np.ones(len(lanes_), bool)
            new[1:] = lanes_[1:] != lanes_[:-1]
            new[0] = lanes_[0] != lane
            head = np.flatnonzero(new)
            hubs = np.empty(len(lanes_), np.int64)
            carried = head[0] if len(head) else len(lanes_)
            hubs[:carried] = hub if hub is not None else 0
            hubs[carried:] = np.repeat(nodes[head], np.diff(np.append(head, len(lanes_))))
            keep = ~new & (hubs != nodes)
            lane, hub = lanes_[-1], hubs[-1]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(lanes_[keep]), pa.array(hubs[keep]), pa.array(nodes[keep])], names=["lane", "hub", "node"])

    return rows.select("lane", "node").repartition("lane").sortWithinPartitions("lane", "node").mapInArrow(run, "lane bigint, hub bigint, node bigint")


def _together(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) beside their whole sets sa and sb."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "sa", "sb")


def _beside_hubs(sets: DataFrame, parts: int, i: int) -> DataFrame:
    """As :func:`_together` for the hubs (a) of one part and the members (b) that name them; a hub names itself."""
    hubs = F.filter("hubs", lambda h: (h != F.col("node")) & _of_part(h, parts, i))
    members = sets.select(F.explode(hubs).alias("a"), F.col("node").alias("b"), F.col("set").alias("sb"))
    heads = sets.filter(_of_part(F.col("node"), parts, i) & F.array_contains("hubs", F.col("node")))
    return members.join(heads.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").select("a", "b", "sa", "sb")


def _both(batch: pa.RecordBatch):
    """Sorted union with repeats of both sets of each pair, and their sizes."""
    for x, y in zip(batch.column("sa"), batch.column("sb")):
        s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
        yield np.sort(np.concatenate([s, t]), kind="stable"), len(s), len(t)


def _verified(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of the stored candidates whose whole sets reach the similarity."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "sb", _SLICE):
                keep = []
                for joint, a, b in _both(part):
                    same = int((joint[1:] == joint[:-1]).sum())
                    keep.append(100 * same >= percent * (a + b - same))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(mask), part.column("b").filter(mask)], names=["a", "b"])

    named = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    few = broadcast_if_small(named)
    if few is not named:
        sets = sets.join(few, "node", "left_semi")
    parts = _parts(near.agg(F.sum("nb")), sets.agg(F.sum("n")), _PART)

    def one(i):
        mine = near.filter(_of_part(F.col("a"), parts, i))
        return _together(mine, sets).mapInArrow(run, "a bigint, b bigint")

    return _in_parts(one, parts, "more-links")


def most_differences(n: int, percent: int) -> int:
    """Largest symmetric difference of a set of size n and any set that it links to."""
    return (100 - percent) * (n + 100 * n // percent) // (100 + percent)


def _compared(sets: DataFrame, percent: int) -> DataFrame:
    """(hub, node, nh, n, e, linked, far, edits): each member against its hub.

    ``e`` is the symmetric difference. A pair of members that links differs in e by at most d (see
    :func:`most_differences`), and in d by the threshold at most: if one of them has e <= far * d, the
    other has e <= near * d. Far ones have e > far * d (about half their size); those in between are both.
    """
    far = 0.5 * percent / (100 - percent)
    near = far * 100 / percent + 1.1

    def run(batches):
        for batch in batches:
            for part in slices(batch, "sb", _SLICE):
                rows = []
                for joint, a, b in _both(part):
                    twin = joint[1:] == joint[:-1]
                    same = int(twin.sum())
                    e, most = a + b - 2 * same, most_differences(b, percent)
                    edits = None
                    if e <= near * (most + 2) + 2:
                        alone = np.ones(len(joint), bool)
                        alone[1:] &= ~twin
                        alone[:-1] &= ~twin
                        edits = joint[alone].view(np.int64)
                    rows.append((a, b, e, 100 * same >= percent * (a + b - same), e > far * most, edits))
                cols = list(zip(*rows)) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["hub", "node", "nh", "n", "e", "linked", "far", "edits"])

    kind = "hub bigint, node bigint, nh bigint, n bigint, e bigint, linked boolean, far boolean, edits array<bigint>"
    parts = _parts(sets.agg(F.sum(F.col("n") * F.size("hubs"))), sets.agg(F.sum("n")))
    return _in_parts(lambda i: _beside_hubs(sets, parts, i).mapInArrow(run, kind), parts, "compared")


@contextmanager
def _tidy(spark: SparkSession):
    """Shuffle files of the writes inside go as soon as each write is done, not when the driver happens to clean up."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    with _tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _of_part(node: Column, parts: int, i: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(parts)) == i


def _parts(moved: DataFrame, held: DataFrame, least: int = 1) -> int:
    """Number of parts, so that one of them moves about as many elements as the table of sets holds (at least ``least``), or less."""
    return 1 + int((moved.first()[0] or 0) // max(least, held.first()[0] or 0))


def _in_parts(of: Callable[[int], DataFrame], parts: int, name: str) -> DataFrame:
    """The parts ``of(0)``, ``of(1)``, ... as one table, each written before the next is shuffled."""
    return reduce(DataFrame.unionByName, [_stored(of(i), name) for i in range(parts)])


def _drop(*frames: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """(key, n_shingles, component_id): the least key reachable over links of at least ``percent`` similarity."""
    table = _stored(sketches(docs, key, text, percent, k).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    narrow = _stored(table.select("rid", "_key", "n", "hi", "lo"), "prints")
    same = ["n", "hi", "lo"]
    nodes = _stored(
        narrow.filter("n > 0").groupBy(*same).agg(F.min("rid").alias("node"), F.min("_key").alias("least"), F.min_by("_key", "rid").alias("_of"), F.count("*").alias("copies")), "nodes"
    )
    # later rows of a set bring nothing new; they are few, or Spark joins them by shuffle
    copied = broadcast_if_small(nodes.filter("copies > 1").select(*same, "node"))
    later = broadcast_if_small(_stored(narrow.join(copied, same).filter("rid <> node").select("rid"), "copies"))
    first = table.filter("size(lanes) > 0").select("rid", "lanes").join(later, "rid", "left_anti")
    rows = first.select(F.explode("lanes").alias("lane"), F.col("rid").alias("node"))
    groups = _in_parts(lambda i: _groups(rows.filter(_of_part(F.col("lane"), _LANE_PARTS, i))), _LANE_PARTS, "lane-groups")
    _drop(table)
    pairs = _stored(groups.select("hub", "node").distinct(), "pairs")
    heads = pairs.select("hub", F.col("hub").alias("node")).distinct()
    met = pairs.unionByName(heads).groupBy("node").agg(F.collect_list("hub").alias("hubs"))
    repeats = not narrow.groupBy("_key", *same).agg(F.count("*").alias("c")).filter("c > 1").isEmpty()
    sets = _stored(_sets(docs, key, text, k, nodes.join(met, "node"), repeats), "sets")
    compared = _compared(sets, percent)
    linked = _stored(components(compared.filter("linked").select(F.col("hub").alias("a"), F.col("node").alias("b"))), "components")
    kept = _near(compared, linked, sets, percent).unionByName(_far(groups, compared, sets, percent))
    # first with the least member of each group only, which joins most copies; then what is still apart
    for star in (True, False):
        again = _stored(_meet(kept, linked, percent, star), "candidates")
        if not again.isEmpty():
            linked = _stored(joined(linked, _verified(again, sets, percent)), "components")
    _drop(sets, compared, groups)
    final = nodes.join(broadcast_if_small(linked), "node", "left").withColumn("component", F.coalesce("component", "node"))
    final = _stored(final.select(*same, "least", "component"), "classes")
    _drop(nodes, linked)
    named = final.groupBy("component").agg(F.min("least").alias("component_id"))
    known = final.join(named, "component").select(*same, "component_id")
    out = narrow.join(known, same, "left")
    return out.select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "_key").alias("component_id"))


def _sets(docs: DataFrame, key: str, text: str, k: int, wanted: DataFrame, repeats: bool) -> DataFrame:
    """(node, n, set, hubs) of the wanted nodes, from a second look at the texts of their first rows.

    A text comes with the nodes of its key; fingerprints tell which of them it is. ``repeats``: whether
    a key and set can stand in several rows.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text", _SLICE):
                grams, ptr = shingle_sets(Texts(part.column("_text")), k)
                hi, lo = _prints(grams, ptr)
                own = (hi == part.column("hi").to_numpy()) & (lo == part.column("lo").to_numpy())
                cells = pa.Array.from_buffers(pa.binary(), len(ptr) - 1, [None, pa.py_buffer((8 * ptr).astype(np.int32).tobytes()), pa.py_buffer(grams.tobytes())])
                found = pa.RecordBatch.from_arrays([part.column("node"), pa.array(np.diff(ptr)), cells, part.column("hubs")], names=["node", "n", "set", "hubs"])
                yield found.filter(pa.array(own))

    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    named = texts.join(wanted.select("_of", "node", "hi", "lo", "hubs"), F.col("_key").eqNullSafe(F.col("_of")))
    found = named.select("_text", "node", "hi", "lo", "hubs").mapInArrow(run, "node bigint, n bigint, set binary, hubs array<bigint>")
    return found.dropDuplicates(["node"]) if repeats else found


def _near(compared: DataFrame, linked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Prefixes (key, node, n, e, at) of the edits of near members of one hub that are in different components.

    A pair links only if its edits share c = (e_x + e_y - d) / 2 elements or more. Edits are put in order of
    rarity among the members of the hub; two sets that share c elements share one among the first e - c + 1.
    A member of the hub's component meets only members that do not link to the hub; that bounds its c from
    below, and for the others e - d does.
    """
    parts = _parts(compared.filter("edits IS NOT NULL").agg(_ROW * F.sum(F.size("edits"))), sets.agg(F.sum("n")), _PART)
    linked = broadcast_if_small(linked)
    return _in_parts(lambda i: _near_hubs(compared.filter(_of_part(F.col("hub"), parts, i)), linked, percent), parts, "near-prefixes")


def _near_hubs(compared: DataFrame, linked: DataFrame, percent: int) -> DataFrame:
    named = linked.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    rows = compared.filter("edits IS NOT NULL").join(named, F.col("node") == F.col("_n"), "left").withColumn("c", F.coalesce("_c", "node")).drop("_n", "_c")
    rows = rows.join(named, F.col("hub") == F.col("_n"), "left").withColumn("ch", F.coalesce("_c", "hub")).drop("_n", "_c")
    split = _stored(rows.groupBy("hub").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("hub"), "split-hubs")
    t, u = 100 - percent, 100 + percent
    most = F.expr(f"({t} * (n + (100 * n) div {percent})) div {u}")
    least = F.when(F.col("c") == F.col("ch"), F.expr(f"({u} * e + {t} * (nh - n)) div {2 * u}")).otherwise(F.col("e") - most)
    own = rows.join(broadcast_if_small(split), "hub").withColumn("size", F.col("e") - F.greatest(F.lit(1), least) + 1)
    each = own.select("hub", "node", "n", "e", "c", "size", F.explode("edits").alias("edit"))
    count = each.groupBy("hub", "edit").agg(F.count("*").alias("df")).filter("df > 1")
    own = Window.partitionBy("hub", "node")  # one document's edits
    # those of one member only come first, and meet nothing
    rank = F.row_number().over(own.orderBy("df", "edit")) + F.col("e") - F.count("*").over(own)
    ranked = each.join(count, ["hub", "edit"]).withColumn("at", rank).filter("at <= size")
    return ranked.select(F.xxhash64("hub", "edit").alias("key"), "node", "n", "e", "at")


def _far(groups: DataFrame, compared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Prefixes of the whole sets of members that have two lanes or more with far hubs.

    As for the edits, with the empty set as hub: e is the size, and c at least ``percent`` of it.
    """

    def picked(part, i):
        found = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("set")]
        return [x[x % parts == i] for x in found]

    def cut(i):
        def run(batches):
            for batch in batches:
                for part in slices(batch, "set", _SLICE):
                    cells = pa.array([x.tobytes() for x in picked(part, i)], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column("node"), part.column("n"), cells], names=["node", "n", "set"])

        return run

    def rows(i):
        def run(batches):
            for batch in batches:
                for part in slices(batch, "set", _SLICE):
                    found = picked(part, i)
                    sizes = np.array([len(x) for x in found], np.int64)
                    owned = [pa.array(np.repeat(part.column(c).to_numpy(), sizes)) for c in ("node", "n")]
                    yield pa.RecordBatch.from_arrays([*owned, pa.array(np.concatenate(found))], names=["node", "n", "edit"])

        return run

    away = groups.join(compared.filter("far").select("hub", "node"), ["hub", "node"])
    members = _stored(away.groupBy("node").agg(F.count("*").alias("lanes")).filter("lanes > 1").select("node"), "far-members")
    whole = sets.agg(F.sum("n"))
    parts = _parts(sets.select("node", "n").join(members, "node").agg(_ROW * F.sum("n")), whole, _PART)
    few = broadcast_if_small(members)

    def shared(i):
        mine = sets.select("node", "n", "set")
        if few is members:  # both are shuffled, and of a set only what belongs to the part
            mine = mine.mapInArrow(cut(i), "node bigint, n bigint, set binary")
        each = mine.join(few, "node").select("node", "n", "set").mapInArrow(rows(i), "node bigint, n bigint, edit bigint")
        count = each.groupBy("edit").agg(F.count("*").alias("df")).filter("df > 1")
        return each.join(count, "edit")

    elements = _in_parts(shared, parts, "shared-elements")
    pieces = _parts(elements.agg(_ROW * F.count("*")), whole, _PART)
    own = Window.partitionBy("node")
    rank = F.row_number().over(own.orderBy("df", "edit")) + F.col("n") - F.count("*").over(own)

    def prefixes(i):
        ranked = elements.filter(_of_part(F.col("node"), pieces, i)).withColumn("at", rank).filter(F.expr(f"at <= n - ({percent} * n + 99) div 100 + 1"))
        return ranked.select(F.xxhash64(F.lit("set"), "edit").alias("key"), "node", "n", F.col("n").alias("e"), "at")

    found = _in_parts(prefixes, pieces, "far-prefixes")
    _drop(elements, members)
    return found


def _meet(kept: DataFrame, linked: DataFrame, percent: int, star: bool) -> DataFrame:
    """Pairs (a, b) of different components that share a prefix element and can still overlap enough, and the size nb of b.

    ``star``: only with the least member of each group of equal elements.
    """
    t, u = 100 - percent, 100 + percent
    rows = kept.join(broadcast_if_small(linked), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    cells = ["node", "n", "e", "at", "c"]
    apart = rows.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min(F.struct(*cells)).alias("o")).filter("c0 < c1")
    if star:
        other = apart.select("key", *(F.col(f"o.{x}").alias(f"{x}2") for x in cells))
    else:
        rows = rows.join(apart.select("key"), "key")
        other = rows.select("key", *(F.col(x).alias(f"{x}2") for x in cells))
    # what is left after the common element must still hold the overlap
    left = F.least(F.col("e") - F.col("at"), F.col("e2") - F.col("at2")) + 1
    enough = 2 * u * left >= u * (F.col("e") + F.col("e2")) - t * (F.col("n") + F.col("n2"))
    sized = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent
    pairs = rows.join(other, "key").filter((F.col("node2") < F.col("node")) & (F.col("c") != F.col("c2")) & enough & sized)
    return pairs.select(F.col("node2").alias("a"), F.col("node").alias("b"), F.col("n").alias("nb")).distinct()


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """One document of each component (the least key, then the least text hash), with all its columns.

    Rows are named by key and text hash. Only rows that share both are compared once more.
    """
    named = docs.select(F.struct(F.col(key).isNull().alias("z"), F.col(key).alias("k"), F.xxhash64(text).alias("h")).alias("_id"), F.col(text).alias("_text"), F.struct(*docs.columns).alias("_row"))
    classes = _stored(link(named, "_id", "_text", percent, k), "named-classes")
    gone = classes.filter(F.col("_id") != F.col("component_id")).select("_id").distinct()
    left = named.join(gone, "_id", "left_anti")
    alike = classes.filter(F.col("_id") == F.col("component_id")).groupBy("_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("_id")
    if alike.isEmpty():
        return left.select("_row.*")
    once = left.join(alike, "_id", "left_anti").select("_row.*")
    return once.unionByName(left.join(alike, "_id", "left_semi").dropDuplicates(["_id"]).select("_row.*"))


def oracle(percent: int = PERCENT, k: int = SHINGLE) -> str:
    """DuckDB SQL for :func:`link` on the table ``documents`` with unique ids: an exact join over shared shingles."""
    gram = " || ' ' || ".join(f"ws[i + {j}]" for j in range(k))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - {k - 2}), lambda i: {gram}) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS same FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * same >= {percent} * (a.n + b.n - same)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (
  SELECT doc_id AS node, doc_id AS r FROM w UNION SELECT node, e.y FROM reach JOIN e ON e.x = reach.r)
SELECT node AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = node GROUP BY node
"""
