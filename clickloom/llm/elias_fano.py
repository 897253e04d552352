"""Token-id files with Elias-Fano coded document boundaries.

Format: a Parquet table of segments, in document order. A segment holds the concatenated ids of its
documents (little-endian, 2 bytes while the vocabulary allows, else 4) and two Elias-Fano sequences:
the ends of the documents in the id array, and the document keys. A sequence of n values up to u keeps
the low l = floor(log2(u / n)) bits of each value packed, and the high parts as ones in a bit vector
(value i sets bit (v_i >> l) + i): about 2 + log2(u / n) bits a value instead of 64. The place of every
64th one is stored, so ``select`` reads a bounded stretch of bits. A small manifest, written from the
segment totals, gives the ids and documents before each segment.

Writing: texts are range-partitioned on the key, encoded in the task, and written by Spark's committer
to a folder that all executors see. Reading: segments join the manifest and are decoded one by one.

Cases: null and empty texts are documents with only the end id. Null keys come first. Repeated keys and
rows are documents of their own, ordered by text hash and text. A text larger than a segment is a segment of its
own. An empty table gives no segments. Keys are integers; only key and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clickloom.llm.cells import Texts, slices
from clickloom.llm.pieces import SLICE, piece_encoder
from clickloom.session import broadcast_if_small

SEGMENT_IDS = 1 << 20
SAMPLE = 64


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, ((top + 1) // n).bit_length() - 1) if n else 0
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        ones = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        ones[places] = 1
        high = np.packbits(ones, bitorder="little")
        return cls(n, bits, low.tobytes(), high.tobytes(), places[::SAMPLE].astype("<u4").tobytes())

    def parts(self) -> tuple:
        return self.n, self.low_bits, self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()

    def _low(self, i: int) -> int:
        begin, end = i * self.low_bits, (i + 1) * self.low_bits
        chunk = int.from_bytes(self.low[begin // 8 : (end + 7) // 8].tobytes(), "little")
        return (chunk >> (begin % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value number ``i``; scans from the nearest stored place."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8)
        base = at
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word, base = int(self.high[byte]), byte * 8
        for _ in range(left):
            word &= word - 1
        place = base + (word & -word).bit_length() - 1
        return ((place - i) << self.low_bits) | (self._low(i) if self.low_bits else 0)

    def all(self) -> np.ndarray:
        """Every value at once."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (places - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return out


_CODED = "struct<n: bigint, low_bits: int, low: binary, high: binary, samples: binary>"
_SEGMENT = f"part int, seg int, n_docs bigint, n_nulls bigint, n_ids bigint, first_key bigint, width int, ends {_CODED}, keys {_CODED}, ids binary"
_CODED_ARROW = pa.struct([("n", pa.int64()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())])


def _coded(values: np.ndarray) -> pa.Array:
    return pa.array([dict(zip(("n", "low_bits", "low", "high", "samples"), EliasFano.of(values).parts()))], _CODED_ARROW)


def _segment(part: int, seg: int, keys: list, ids: list[bytes], width: int) -> pa.RecordBatch:
    sizes = np.array([len(b) // width for b in ids], np.int64)
    known = [k for k in keys if k is not None]
    first = known[0] if known else 0
    numbers = [part, seg, len(keys), len(keys) - len(known), int(sizes.sum()), first, width]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    offsets = np.array([k - first for k in known], np.uint64)
    columns = [pa.array([v], t) for v, t in zip(numbers, kinds)] + [_coded(np.cumsum(sizes)), _coded(offsets), pa.array([b"".join(ids)], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "seg", "n_docs", "n_nulls", "n_ids", "first_key", "width", "ends", "keys", "ids"])


def write(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 0, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode all texts with a tokenizer file and write segments and manifest under ``path``."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def run(batches):
        made, part, seg = piece_encoder(sent.value), TaskContext.get().partitionId(), 0
        tail = np.array([end_id], made.kind).tobytes() if end_id is not None else b""
        keys, ids, held = [], [], 0
        for batch in batches:
            for piece in slices(batch, "_text", SLICE):
                flat, sizes = made.encode_slice(Texts(piece.column("_text")))
                ends = np.cumsum(sizes)
                for k, size, end in zip(piece.column("_key").to_pylist(), sizes.tolist(), ends.tolist()):
                    found = flat[end - size : end].tobytes()
                    if keys and held + size > segment_ids:
                        yield _segment(part, seg, keys, ids, made.kind.itemsize)
                        keys, ids, held, seg = [], [], 0, seg + 1
                    keys.append(k)
                    ids.append(found + tail)
                    held += size + 1
        if keys:
            yield _segment(part, seg, keys, ids, made.kind.itemsize)

    rows = docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    placed = rows.repartitionByRange("_key", "_h").sortWithinPartitions("_key", "_h", "_text")
    placed.select("_key", "_text").mapInArrow(run, _SEGMENT).write.parquet(f"{path}/segments")
    heads = spark.read.parquet(f"{path}/segments").select("part", "seg", "n_docs", "n_ids")
    totals = heads.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("n_ids").alias("t"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    base = totals.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("d", "t")))
    inside = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    sums = heads.select("part", "seg", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_{c}") for c in ("n_docs", "n_ids")))
    sums.join(base, "part").select("part", "seg", (F.col("_n_docs") + F.col("d")).alias("docs_before"), (F.col("_n_ids") + F.col("t")).alias("ids_before")).write.parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, row, start, n_ids, ids) of every document of the files; ``ids`` are little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            for seg in batch.to_pylist():
                coded = {c: EliasFano(*seg[c].values()) for c in ("ends", "keys")}
                ends = np.concatenate([[0], coded["ends"].all()])
                ids = np.frombuffer(seg["ids"], f"<u{seg['width']}").astype("<u4")
                keys = [None] * seg["n_nulls"] + (coded["keys"].all() + seg["first_key"]).tolist()
                cells = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer((4 * ends).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                columns = [pa.array(keys, pa.int64()), pa.array(seg["docs_before"] + np.arange(len(keys))), pa.array(seg["ids_before"] + ends[:-1]), pa.array(np.diff(ends)), cells]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "row", "start", "n_ids", "ids"])

    manifest = spark.read.parquet(f"{path}/manifest")
    segments = spark.read.parquet(f"{path}/segments").join(broadcast_if_small(manifest, 100_000), ["part", "seg"])
    return segments.mapInArrow(run, "key bigint, row bigint, start bigint, n_ids bigint, ids binary")
