"""Benchmark decontamination by greedy string tiling with Karp-Rabin seeds.

Every run of ``MIN_MATCH`` tokens of a benchmark item is a seed with a 64-bit fingerprint. Documents
look up the fingerprints of their own windows; where an item shares a seed, matches are extended along
their diagonal and the longest one whose tokens are unmarked on both sides is marked, again and
again, until none of ``MIN_MATCH`` tokens is left (ties: first in the document, then in the item).
The share of the item's tokens under tiles is its coverage; from ``threshold`` on the document leaks
the item. Tiles may lie in any order, so a passage with swapped sentences is found as well.

Tokens are runs of letters and digits; A-Z and the capitals of U+00C0..U+00DE are lower-cased, so
case and punctuation do not hide a copy.

Scale: only the benchmark is shipped, in slices of at most about ``slice_bytes`` of text, each slice in
one pass over the documents without a shuffle; a larger benchmark costs more passes, not more memory.

Cases: null and empty texts leak nothing; items with fewer than ``MIN_MATCH`` tokens (or null) cannot be
matched. Repeated documents give repeated rows, repeated items one row per item. Null keys are kept as
null. An empty benchmark or table gives no rows (``clean``: all documents). Other columns of the input do
not matter; ``clean`` keeps them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from clickloom.llm.cells import ALNUM, FEW_BYTES, LOWER_CODES, Texts, slices, windows

MIN_MATCH = 5
THRESHOLD = 0.5
SLICE = 8 << 20


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes and the pointers of each text."""
    raw = texts.raw
    if len(raw):
        high = np.zeros(len(raw), bool)  # second byte of U+00C0..U+00DE but U+00D7
        high[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        texts.raw = np.where(high, raw + np.uint8(0x20), raw)
    start, end, ptr = texts.runs(ALNUM)
    return texts.hashes(start, end, LOWER_CODES), ptr


def tiles_of(doc: np.ndarray, item: np.ndarray, at: np.ndarray, to: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in document, place in item, length) from seed pairs ``at``/``to`` of ``k`` tokens."""
    order = np.lexsort((at, at - to))
    at, to = at[order], to[order]
    cut = np.flatnonzero((np.diff(at - to) != 0) | (np.diff(at) != 1)) + 1
    heads, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
    heap = [(-int(e - h + k - 1), int(at[h]), int(to[h])) for h, e in zip(heads, ends)]
    heapq.heapify(heap)
    used_doc, used_item, out = set(), np.zeros(len(item), bool), []
    while heap:
        size, i, j = heapq.heappop(heap)
        size = -size
        free = [not used_item[j + t] and (i + t) not in used_doc for t in range(size)]
        if all(free):
            if np.array_equal(doc[i : i + size], item[j : j + size]):
                used_doc.update(range(i, i + size))
                used_item[j : j + size] = True
                out.append((i, j, size))
            continue
        t = 0
        while t < size:
            if free[t]:
                begin = t
                while t < size and free[t]:
                    t += 1
                if t - begin >= k:
                    heapq.heappush(heap, (-(t - begin), i + begin, j + begin))
            else:
                t += 1
    return out


class Index:
    """Seeds of one slice of the benchmark: fingerprint -> (item, place)."""

    def __init__(self, ids: list, texts: pa.Array, k: int):
        self.k, self.ids = k, ids
        h, self.ptr = tokens(Texts(texts))
        self.h = h
        seeds, first = windows(h, self.ptr, k)
        item = np.searchsorted(self.ptr, first, "right") - 1
        order = np.argsort(seeds, kind="stable")
        self.item, self.place = item[order], (first - self.ptr[item])[order]
        self.seeds, begin = np.unique(seeds[order], return_index=True)
        self.span = np.append(begin, len(seeds))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.seeds & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def leaks(self, texts: Texts, threshold: float):
        """(text number, item number, coverage, tiles) of every pair at or above the threshold."""
        h, ptr = tokens(texts)
        win, first = windows(h, ptr, self.k)
        near = np.flatnonzero(self.seen[(win & np.uint64(0xFFFFF)).astype(np.int64)])
        if not len(near) or not len(self.seeds):
            return
        slot = np.minimum(np.searchsorted(self.seeds, win[near]), len(self.seeds) - 1)
        real = self.seeds[slot] == win[near]
        slot, first = slot[real], first[near[real]]
        reps = self.span[slot + 1] - self.span[slot]
        step = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        post = np.repeat(self.span[slot], reps) + step
        at, item, place = np.repeat(first, reps), self.item[post], self.place[post]
        doc = np.searchsorted(ptr, at, "right") - 1
        order = np.lexsort((item, doc))
        doc, item, at, place = doc[order], item[order], at[order], place[order]
        edge = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1
        for a, b in zip(np.concatenate([[0], edge]).tolist(), np.concatenate([edge, [len(doc)]]).tolist()):
            if a == b:
                continue
            d, m = int(doc[a]), int(item[a])
            own = self.h[self.ptr[m] : self.ptr[m + 1]]
            # the tiles cannot cover more than the places that any seed covers
            covered = np.zeros(len(own) + 1, np.int64)
            np.add.at(covered, np.unique(place[a:b]), 1)
            reach = np.convolve(covered[: len(own)], np.ones(self.k, int))[: len(own)] > 0
            if reach.sum() < threshold * len(own):
                continue
            found = tiles_of(h[ptr[d] : ptr[d + 1]], own, at[a:b] - ptr[d], place[a:b], self.k)
            coverage = sum(t[2] for t in found) / len(own)
            if coverage >= threshold:
                yield d, m, coverage, found


def indexes(benchmark: DataFrame, item: str = "item_id", text: str = "text", k: int = MIN_MATCH, slice_bytes: int = SLICE):
    """Seed indexes of the benchmark, slice by slice; a slice is collected only within its bound."""
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).filter("t IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-total // slice_bytes))
    for part in range(parts):
        table = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).orderBy("i", "t").toArrow()
        if table.num_rows:
            yield Index(table.column("i").to_pylist(), table.column("t").combine_chunks(), k)


_TILES = "array<struct<doc_token: int, item_token: int, length: int>>"


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, k: int = MIN_MATCH, slice_bytes: int = SLICE) -> DataFrame:
    """(key, item, coverage, n_tiles, longest, tiles) of every document and item at or above the threshold."""
    kinds, items = dict(docs.select(key).dtypes), dict(benchmark.select(item).dtypes)
    names = ["_doc", "_item", "coverage", "n_tiles", "longest", "tiles"]
    schema = f"_doc {kinds[key]}, _item {items[item]}, coverage double, n_tiles int, longest int, tiles {_TILES}"
    out = docs.sparkSession.createDataFrame([], schema)
    arrow = to_arrow_schema(out.schema)

    def scan(index: Index):
        def run(batches):
            for batch in batches:
                for part in slices(batch, text, FEW_BYTES):
                    found = list(index.leaks(Texts(part.column(text)), threshold))
                    if found:
                        ids = part.column(key).to_pylist()
                        cells = [
                            [ids[d] for d, *_ in found],
                            [index.ids[m] for _, m, *_ in found],
                            [c for _, _, c, _ in found],
                            [len(t) for *_, t in found],
                            [max(x[2] for x in t) for *_, t in found],
                            [[dict(zip(("doc_token", "item_token", "length"), x)) for x in t] for *_, t in found],
                        ]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, arrow)], names=names)

        return run

    for index in indexes(benchmark, item, item_text, k, slice_bytes):
        out = out.unionByName(docs.select(key, text).mapInArrow(scan(index), schema))
    return out.withColumnsRenamed({"_doc": key, "_item": item})


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, k: int = MIN_MATCH, slice_bytes: int = SLICE) -> DataFrame:
    """The documents that leak no item, with all their columns."""

    def keep(index: Index):
        def run(batches):
            for batch in batches:
                for part in slices(batch, text, FEW_BYTES):
                    ok = np.ones(part.num_rows, bool)
                    for d, *_ in index.leaks(Texts(part.column(text)), threshold):
                        ok[d] = False
                    yield part.filter(pa.array(ok))

        return run

    out = docs
    for index in indexes(benchmark, item, item_text, k, slice_bytes):
        out = out.mapInArrow(keep(index), docs.schema)
    return out
