"""Language-model scores by context-tree weighting over bytes.

A text is read as its UTF-8 bytes with A-Z lower-cased, followed by the end symbol 0xFF, which is no byte of a text and also stands
for what lies before the text. Each byte is eight binary decisions. For each decision (the bits of the byte so far) the
last ``depth`` bytes form a tree of contexts; a node at every depth has the Krichevsky-Trofimov estimate of its counts, and half of
its weight goes to that, half to its children: P_w = (P_kt + product of the children's P_w) / 2, P_w = P_kt at full depth. After the counts of
the training texts, the next bit has the probability P_w(counts, bit) / P_w(counts): a mixture of the estimates
at all depths. The tree is not changed while texts are scored, so equal texts have equal scores.

How it runs: texts are taken in blocks of some megabytes. A block's different (context, byte) pairs, one 64-bit number each, go to the bucket of
their context with their counts, where those of all blocks are added up. A bucket holds whole subtrees from depth 3 on;
the nodes at depth 2 are summed over the buckets, those at depths 1 and 0 (65,280 and 255 at most) by the driver. Each bucket then has
the probability of every pair, sends them to the blocks that asked, and the blocks sum them up per text. What crosses
the network grows with the different pairs per block; nothing of the corpus is broadcast, sampled or left out.
Word counts of the base score take the same way, as 64-bit hashes of the words.

Cases: null and empty texts are an end symbol alone. Null keys belong to the training fold. Repeated rows count row by row. Without training
texts every bit has probability 1/2 and every base probability is 1. An empty table gives no rows. A block is one longer text at most, worked on in parts. Only
key and text are read.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from clickloom.llm.cells import LOWER, LOWER_CODES, SPACE, Texts, mix, slices, worker_state
from clickloom.llm.labelled import held_out
from clickloom.session import scratch_path

DEPTH = 5  # bytes of context, 3 to 6
BLOCK = 12 << 20  # bytes of text in a block, or one longer text
PART = 1 << 20  # positions of a block at a time
WORD_PART = 1 << 20  # bytes of text whose words are hashed at a time, or one longer text
FOLDS, HELD_OUT = 7, 2
END = 255
TOP = 2  # depth of the nodes that are summed over the buckets
_SPREAD = 16  # buckets that the contexts of one node at that depth may go to
GRAMS, WORDS = 0, 1
_TABLE = 1 << 16


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Numbers of eight bytes as compressed byte planes; of their differences, if they rise."""
    values = np.diff(values, prepend=values.dtype.type(0)) if rising else values
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes))


def unpack(data: bytes, kind=np.uint64, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=kind) if rising else values


class Symbols:
    """Lower-cased bytes of some texts, each after ``depth`` and before one end symbols."""

    def __init__(self, texts: Texts, depth: int):
        n, self.depth = texts.n, depth
        self.base = texts.offs + np.arange(n + 1) * (depth + 1)
        inner = np.ones(self.base[-1], bool)
        inner[(self.base[:-1, None] + np.arange(depth)).ravel()] = False
        inner[self.base[1:] - 1] = False
        self.data = np.full(len(inner), END, np.uint8)
        self.data[inner] = LOWER[texts.raw]
        self.scored = inner
        self.scored[self.base[1:] - 1] = True

    def parts(self):
        """(keys, their span for :meth:`texts`), some positions at a time. A key has the context's bytes, the last one first, then the byte."""
        turned = np.append(self.data[::-1], np.zeros(8, np.uint8))
        for at in range(self.depth, len(self.data), PART):
            to = min(at + PART, len(self.data))
            # eight bytes from each place on, most significant first: in the turned data a byte comes before its context
            words = np.ndarray((to - at,), ">u8", turned.data, len(self.data) - to + 1, (1,))
            keys = words.astype(np.uint64)
            keys >>= np.uint64(64 - 8 * self.depth)
            keys <<= np.uint64(8)
            keys |= turned[len(self.data) - to : len(self.data) - at]
            if self.scored[at:to].any():
                yield keys[::-1][self.scored[at:to]], (at, to)

    def texts(self, span: tuple[int, int]) -> np.ndarray:
        """Text of each key of a part."""
        at, to = span
        first, last = np.searchsorted(self.base, [at, to - 1], "right") - 1
        text = np.repeat(np.arange(first, last + 1, dtype=np.int32), np.diff(np.clip(self.base[first : last + 2], at, to)))
        return text[self.scored[at:to]]


def merged(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rising different keys with their summed counts."""
    keys, n = np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)


def counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising different keys (of 63 bits) with the number of those in training texts."""
    both = np.sort((keys << np.uint64(1)) | train.astype(np.uint64))
    first = np.flatnonzero(np.append(True, (both[1:] >> np.uint64(1)) != (both[:-1] >> np.uint64(1))))
    return both[first] >> np.uint64(1), np.add.reduceat((both & np.uint64(1)).astype(np.int64), first)


def gram_buckets(keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """Bucket of each key: by its last two context bytes, spread by the third."""
    nodes, third = keys >> np.uint64(8 * (depth - 1)), (keys >> np.uint64(8 * (depth - 2))) & np.uint64(_SPREAD - 1)
    return (mix(nodes * np.uint64(_SPREAD) + third) % np.uint64(buckets)).astype(np.int64)


def words(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hash of each word, and the texts' ranges of words; hashed a few megabytes of texts at a time."""
    hashes, counts, at = [], [], 0
    while at < texts.n:
        to = max(at + 1, int(np.searchsorted(texts.offs, texts.offs[at] + WORD_PART, "right")) - 1)
        some = object.__new__(Texts)
        some.n, some.offs, some.raw = to - at, texts.offs[at : to + 1] - texts.offs[at], texts.raw[texts.offs[at] : texts.offs[to]]
        start, end, ptr = some.runs(~SPACE)
        hashes.append(some.hashes(start, end, LOWER_CODES) >> np.uint64(1))
        counts.append(np.diff(ptr))
        at = to
    return np.concatenate(hashes), np.append(0, np.cumsum(np.concatenate(counts)))


def _dealt(keys: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rising keys by bucket, and the buckets in that order."""
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the block probability of ``a`` zeros and ``b`` ones."""
    state = worker_state("kt")
    if not hasattr(state, "half"):
        state.half = np.array([math.lgamma(i + 0.5) for i in range(_TABLE)])
        state.whole = np.array([math.lgamma(i + 1.0) for i in range(_TABLE)])

    def lgamma(n: np.ndarray, table: np.ndarray, plus: float) -> np.ndarray:
        x = np.maximum(n, _TABLE) + plus
        far = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
        return np.where(n < _TABLE, table[np.minimum(n, _TABLE - 1)], far)

    return lgamma(a, state.half, 0.5) + lgamma(b, state.half, 0.5) - lgamma(a + b, state.whole, 1.0) - math.log(math.pi)


class Level:
    """Nodes of one depth for one bit position: counts, log P_kt and log P_w, and the parent of each child."""

    def __init__(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray | None):
        order = np.argsort(ids, kind="stable")
        new = np.append(True, ids[order][1:] != ids[order][:-1])
        first = np.flatnonzero(new)
        self.ids, self.parent = ids[order][first], np.empty(len(ids), np.int64)
        self.parent[order] = np.cumsum(new) - 1
        self.a, self.b = np.add.reduceat(a[order], first), np.add.reduceat(b[order], first)
        self.below = None if below is None else np.add.reduceat(below[order], first)

    def weigh(self) -> None:
        kt = _log_kt(self.a, self.b)
        self.w = kt if self.below is None else np.logaddexp(kt, self.below) - math.log(2)
        self.own = np.exp(kt - math.log(2) - self.w)  # weight of its own estimate; the rest goes on to the child
        self.one = (self.b + 0.5) / (self.a + self.b + 1)


def grown(keys: np.ndarray, n: np.ndarray, depth: int, bit: int) -> tuple[list[Level], Level]:
    """Levels from full depth to depth 3 for one bit position, and the unfinished level of depth 2."""
    ones = ((keys >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64) * n
    level = Level(keys >> np.uint64(8 - bit), n - ones, ones, None)
    levels = []
    for _ in range(depth - TOP):
        level.weigh()
        levels.append(level)
        low = level.ids & np.uint64((1 << bit) - 1)
        level = Level(((level.ids >> np.uint64(bit + 8)) << np.uint64(bit)) | low, level.a, level.b, level.w)
    return levels, level


def _node(ids: np.ndarray, bit: int) -> np.ndarray:
    """Number of a node for all bit positions: context, then a one and the bits so far in eight bits."""
    low = ids & np.uint64((1 << bit) - 1)
    return (((ids >> np.uint64(bit)) << np.uint64(8)) | low | np.uint64(1 << bit)).astype(np.int64)


def log_probabilities(keys: np.ndarray, n: np.ndarray, depth: int, nodes: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """log10 probability of each key's byte in its context; at the rising ``nodes`` of depth 2 the mixture above is alpha + beta q."""
    total = np.zeros(len(keys))
    for bit in range(8):
        levels, top = grown(keys, n, depth, bit)
        place = np.arange(len(levels[0].ids))
        q = levels[0].one.copy()
        for child, parent in zip(levels, levels[1:]):
            place = parent.parent[place]
            q = parent.own[place] * parent.one[place] + (1 - parent.own[place]) * q
        place = np.searchsorted(nodes, _node(top.ids, bit))[top.parent[place]]
        q = alpha[place] + beta[place] * q
        p = q[levels[0].parent]  # of the leaf of each key
        total += np.log10(np.where((keys >> np.uint64(7 - bit)) & np.uint64(1) == 1, p, 1 - p))
    return total


PARTS = "kind int, bucket int, block bigint, keys binary, n binary, ends binary, body binary, train_docs bigint"


def gather(docs: DataFrame, depth: int, buckets: int) -> DataFrame:
    """Written parts of all blocks: pairs and words with training counts by bucket, and one row with the block's texts.

    ``docs`` has ``_k``, ``_held`` and ``_x``.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["_k"]

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "_x", BLOCK):
                texts = Texts(part.column("_x"))
                train = ~part.column("_held").to_numpy(zero_copy_only=False)
                keys, n = _pairs(texts, train, depth)
                out = list(_rows(GRAMS, block, keys, n, gram_buckets(keys, depth, buckets)))
                h, ptr = words(texts)
                if len(h):
                    keys, n = counted(h, np.repeat(train, np.diff(ptr)))
                    out += _rows(WORDS, block, keys, n, (keys % np.uint64(buckets)).astype(np.int64))
                body = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(texts.raw))
                out.append((None, None, block, None, None, pack(texts.offs), body, int(train.sum())))
                size = len(out)
                lists = lambda c: pa.ListArray.from_arrays(pa.array([0] * size + [part.num_rows], pa.int32()), part.column(c))
                types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays([*columns, lists("_k"), lists("_held")], names=[*PARTS_NAMES, "_k", "_held"])
                block += 1

    path = scratch_path(spark, "blocks")
    docs.mapInArrow(run, f"{PARTS}, _k array<{kind}>, _held array<boolean>").write.parquet(path)
    return spark.read.parquet(path)


PARTS_NAMES = [c.split()[0] for c in PARTS.split(", ")]


def _pairs(texts: Texts, train: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    symbols = Symbols(texts, depth)
    found = [counted(keys, train[symbols.texts(span)]) for keys, span in symbols.parts()]
    return merged(found) if len(found) > 1 else found[0]


def _rows(kind: int, block: int, keys: np.ndarray, n: np.ndarray, bucket: np.ndarray):
    order, bucket = _dealt(keys, bucket)
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for a, b in zip(cuts, np.append(cuts[1:], len(bucket))):
        yield kind, int(bucket[a]), block, pack(keys[order[a:b]], True), pack(n[order[a:b]]), None, None, None


def _stream(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield [c[i].as_py() for c in batch.columns]


MODEL = "kind int, bucket int, keys binary, n binary, total bigint, known bigint, node array<bigint>, a array<bigint>, b array<bigint>, below array<double>"


def totals(parts: DataFrame, depth: int) -> DataFrame:
    """Written model: per bucket its different keys with their counts, and what the nodes of depth 2 get from there."""
    spark = parts.sparkSession

    def run(batches):
        for (kind, bucket), group in groupby(_stream(batches), key=lambda r: (r[0], r[1])):
            held, room = [], 0
            for _, _, keys, n in group:
                held.append((unpack(keys, rising=True), unpack(n, np.int64)))
                room += len(held[-1][0])
                if len(held) > 1 and room > 2 * len(held[0][0]) + 2_000_000:
                    held = [merged(held)]
                    room = len(held[0][0])
            keys, n = merged(held)
            tops = [grown(keys, n, depth, bit)[1] for bit in range(8)] if kind == GRAMS else []
            up = [np.concatenate(x).tolist() if x else [] for x in ([_node(t.ids, bit) for bit, t in enumerate(tops)], [t.a for t in tops], [t.b for t in tops], [t.below for t in tops])]
            row = [kind, bucket, pack(keys, True), pack(n), int(n.sum()), int((n > 0).sum()), *up]
            types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=[c.split()[0] for c in MODEL.split(", ")])

    path = scratch_path(spark, "context-tree")
    asked = parts.filter("kind IS NOT NULL").select("kind", "bucket", "keys", "n")
    asked.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(run, MODEL).write.parquet(path)
    return spark.read.parquet(path)


def _summed(rows: DataFrame, node) -> DataFrame:
    return rows.groupBy(node.alias("node")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("below").alias("below"))


def mixtures(model: DataFrame) -> DataFrame:
    """(node, alpha, beta) of the nodes of depth 2: the probability of a one is alpha + beta q, where q is that of the child."""
    spark = model.sparkSession
    zipped = model.filter(F.col("kind") == GRAMS).select(F.inline(F.arrays_zip("node", "a", "b", "below")))

    def weigh(batches):
        for batch in batches:
            level = Level(*(batch.column(c).to_numpy() for c in ("node", "a", "b", "below")))
            level.weigh()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (level.ids, level.a, level.b, level.w, level.own, level.one)], names=["node", "a", "b", "below", "own", "one"])

    path = scratch_path(spark, "context-nodes")
    _summed(zipped, F.col("node")).mapInArrow(weigh, "node bigint, a bigint, b bigint, below double, own double, one double").write.parquet(path)
    second = spark.read.parquet(path)
    node = F.col("node")
    first = _summed(second, F.shiftright(node, 16) * 256 + node % 256).toArrow()  # 65,280 rows at most
    alpha, beta = np.zeros(1 << 16), np.ones(1 << 16)
    if first.num_rows:
        one = Level(*(first.column(c).to_numpy() for c in ("node", "a", "b", "below")))
        one.weigh()
        root = Level(one.ids % 256, one.a, one.b, one.w)
        root.weigh()
        own, p = root.own[root.parent], root.one[root.parent]
        alpha[one.ids] = own * p + (1 - own) * one.own * one.one
        beta[one.ids] = (1 - own) * (1 - one.own)
    sent = spark.sparkContext.broadcast((alpha, beta))  # two tables of 65,536 numbers

    def compose(batches):
        a, b = sent.value
        for batch in batches:
            ids, own, one = (batch.column(c).to_numpy() for c in ("node", "own", "one"))
            up = (ids >> 16) * 256 + ids % 256
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(a[up] + b[up] * own * one), pa.array(b[up] * (1 - own))], names=["node", "alpha", "beta"])

    return second.select("node", "own", "one").mapInArrow(compose, "node bigint, alpha double, beta double")


def answers(parts: DataFrame, model: DataFrame, mixed: DataFrame, depth: int) -> DataFrame:
    """(block, kind, bucket, values): log10 probabilities of a block's pairs and counts of its words, in the order of the block's keys."""
    none = lambda kind: F.lit(None).cast(kind)
    cells = "array<struct<node: bigint, alpha: double, beta: double>>"
    asks = model.filter(F.col("kind") == GRAMS).select("bucket", F.explode("node").alias("node")).join(mixed, "node")
    coefficients = asks.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("node", "alpha", "beta"))).alias("cells"))
    rows = (
        model.select("kind", "bucket", F.lit(0).alias("step"), none("bigint").alias("block"), "keys", "n", none(cells).alias("cells"))
        .unionByName(coefficients.select(F.lit(GRAMS).alias("kind"), "bucket", F.lit(1).alias("step"), none("bigint").alias("block"), none("binary").alias("keys"), none("binary").alias("n"), "cells"))
        .unionByName(parts.filter("kind IS NOT NULL").select("kind", "bucket", F.lit(2).alias("step"), "block", "keys", none("binary").alias("n"), none(cells).alias("cells")))
    )

    def run(batches):
        keys = values = None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                kind, bucket, step, block, packed, n = (batch.column(c)[i].as_py() for c in range(6))
                if step == 0:
                    keys, values = unpack(packed, rising=True), unpack(n, np.int64)
                elif step == 1:
                    c = batch.column(6).slice(i, 1).flatten()
                    nodes, alpha, beta = (c.field(f).to_numpy(zero_copy_only=False) for f in range(3))
                    values = log_probabilities(keys, values, depth, nodes, alpha, beta)
                else:
                    out.append((block, kind, bucket, pack(values[np.searchsorted(keys, unpack(packed, rising=True))])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["block", "kind", "bucket", "values"])

    placed = rows.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "step", "block")
    return placed.mapInArrow(run, "block bigint, kind int, bucket int, values binary")


def _spread(keys: np.ndarray, bucket: np.ndarray, values: list[np.ndarray], kind) -> np.ndarray:
    """Values of rising keys from those that came bucket by bucket."""
    out = np.empty(len(keys), kind)
    if len(keys):
        out[_dealt(keys, bucket)[0]] = np.concatenate(values)
    return out


def _coded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in the different keys, and these."""
    found = pa.array(keys).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_numpy()


def _pair_sums(texts: Texts, depth: int, buckets: int, values: list[np.ndarray]) -> np.ndarray:
    """Summed log10 probabilities of each text's pairs."""
    symbols, total = Symbols(texts, depth), np.zeros(texts.n)
    parts = [(span, *_coded(keys)) for keys, span in symbols.parts()]
    known = np.unique(np.concatenate([own for _, _, own in parts]))
    logs = _spread(known, gram_buckets(known, depth, buckets), values, np.float64)
    for span, place, own in parts:
        total += np.bincount(symbols.texts(span), weights=logs[np.searchsorted(known, own)][place], minlength=texts.n)
    return total


def _word_sums(texts: Texts, buckets: int, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text its words and the end, the words that training texts have, and the sum of log10(c + 1) over the words."""
    h, ptr = words(texts)
    place, own = _coded(h)
    known = np.sort(own)
    c = _spread(known, (known % np.uint64(buckets)).astype(np.int64), values, np.int64)
    c = c[np.searchsorted(known, own)][place]
    text = np.repeat(np.arange(texts.n), np.diff(ptr))
    return np.diff(ptr) + 1, np.bincount(text[c > 0], minlength=texts.n), np.bincount(text, weights=np.log10(c + 1.0), minlength=texts.n)


SCORES = "n_bytes bigint, n_tokens bigint, n_known bigint, logs double, score double"


def per_text(parts: DataFrame, answered: DataFrame, depth: int, buckets: int, end_count: int) -> DataFrame:
    """(_k, _held, n_bytes, n_tokens, n_known, logs, score) of every text; ``logs``: sum of log10(c + 1) over its tokens."""
    kinds = dict(parts.dtypes)
    none = lambda kind: F.lit(None).cast(kind)
    texts = parts.filter("kind IS NULL").select("block", F.lit(2).alias("kind"), none("int").alias("bucket"), none("binary").alias("values"), "ends", "body", "_k", "_held")
    empty = [none(kinds[c]).alias(c) for c in ("ends", "body", "_k", "_held")]
    rows = answered.select("block", "kind", "bucket", "values", *empty).unionByName(texts)

    def run(batches):
        held = {GRAMS: [], WORDS: []}
        for batch in batches:
            for i in range(batch.num_rows):
                kind, values = batch.column(1)[i].as_py(), batch.column(3)[i].as_py()
                if kind in held:
                    held[kind].append(unpack(values, np.float64 if kind == GRAMS else np.int64))
                    continue
                texts = object.__new__(Texts)
                texts.offs = unpack(batch.column(4)[i].as_py(), np.int64)
                texts.raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column(5)[i].as_py()), np.uint8)
                texts.n = len(texts.offs) - 1
                score = _pair_sums(texts, depth, buckets, held[GRAMS])
                tokens, seen, base = _word_sums(texts, buckets, held[WORDS])
                seen, base = seen + int(end_count > 0), base + math.log10(end_count + 1)
                lists = [batch.column(j).slice(i, 1).flatten() for j in (6, 7)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array(np.diff(texts.offs)), pa.array(tokens), pa.array(seen), pa.array(base), pa.array(score)], names=names)
                held = {GRAMS: [], WORDS: []}

    names = ["_k", "_held", *[c.split()[0] for c in SCORES.split(", ")]]
    placed = rows.repartition("block").sortWithinPartitions("block", "kind", "bucket")
    key = kinds["_k"].removeprefix("array<").removesuffix(">")
    return placed.mapInArrow(run, f"_k {key}, _held boolean, {SCORES}")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, buckets: int | None = None) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every text.

    ``score`` is log10 of the model's probability of the text and its end; ``bits_per_byte`` is the code length over bytes and
    end. Texts of the held-out fold are not counted. ``buckets`` is a matter of layout: it changes no result.
    """
    if not TOP < depth <= 6:
        raise ValueError("depth must be 3 to 6")
    spark = docs.sparkSession
    buckets = buckets or min(4_096, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).alias("_k"), held_out(key, FOLDS, HELD_OUT).alias("_held"), F.col(text).alias("_x"))
    parts = gather(rows, depth, buckets)
    model = totals(parts, depth)
    counts = model.filter(F.col("kind") == WORDS).agg(F.sum("total"), F.sum("known")).first()
    ends = parts.agg(F.sum("train_docs")).first()[0] or 0
    tokens, different = (counts[0] or 0) + ends, (counts[1] or 0) + int(ends > 0)
    out = per_text(parts, answers(parts, model, mixtures(model), depth), depth, buckets, ends)
    return out.select(
        F.col("_k").alias(key),
        F.col("_held").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(math.log10(tokens + different + 1))).alias("base_score"),
        "score",
        "n_bytes",
        (-F.col("score") / F.lit(math.log10(2.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
