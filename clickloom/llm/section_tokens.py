"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole. The tokens of a byte-level vocabulary stand for consecutive
bytes, so their spans are running sums of the lengths of their ids. Sections are spans too (lines with
their line break, paragraphs that end at a blank line, or given ones); the join of both interval lists
is a binary search, since both are sorted.

Rule for a token that crosses a border: it belongs to the section that holds most of its bytes, and to
the first such section in a tie. Hence every token is counted exactly once.

Cases: null and empty texts have no tokens and one empty section. Repeated rows are counted row by row;
keys may be null. Characters split over tokens are counted by bytes. An empty table gives no rows. Only key
and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clickloom.llm.cells import Texts, slices
from clickloom.llm.pieces import SLICE, piece_encoder


def line_starts(raw: np.ndarray) -> np.ndarray:
    """First bytes of the lines; a break belongs to the line it ends."""
    return np.concatenate([[0], np.flatnonzero(raw[:-1] == 10) + 1])


def paragraph_starts(raw: np.ndarray) -> np.ndarray:
    """First bytes of the paragraphs: lines after an empty line."""
    lines = line_starts(raw)
    blank = np.flatnonzero(raw[lines] == 10) if len(raw) else np.empty(0, int)
    follow = blank[blank + 1 < len(lines)] + 1
    follow = follow[raw[lines[follow]] != 10]
    return np.unique(np.concatenate([[0], lines[follow]]))


SPLITS = {"line": line_starts, "paragraph": paragraph_starts}


def allocate(ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and which tokens cross a border. ``ends`` of tokens, ``starts`` of sections, in bytes."""
    begin = np.concatenate([[0], ends])[:-1]
    head = np.searchsorted(starts, begin, "right") - 1
    tail = np.searchsorted(starts, ends - 1, "right") - 1
    section, cross = head.copy(), tail > head
    for t in np.flatnonzero(cross).tolist():
        cuts = np.concatenate([[begin[t]], starts[head[t] + 1 : tail[t] + 1], [ends[t]]])
        section[t] = head[t] + int(np.argmax(np.diff(cuts)))
    return section, cross


def attribute(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", split: str = "line") -> DataFrame:
    """(key, n_tokens, n_sections, n_crossing, sections) with a struct (start, end, tokens) per section; byte offsets."""
    with open(tokenizer, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    cut = SPLITS[split]

    def run(batches):
        made = piece_encoder(sent.value)
        lengths = made.lengths()
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                texts = Texts(part.column("_text"))
                rows, flat = [], []
                flat_ids, sizes = made.encode_slice(texts)
                for i, (size, to) in enumerate(zip(sizes.tolist(), np.cumsum(sizes).tolist())):
                    raw = texts.raw[texts.offs[i] : texts.offs[i + 1]]
                    ends = np.cumsum(lengths[flat_ids[to - size : to]])
                    starts = cut(raw)
                    section, cross = allocate(ends, starts)
                    flat.append((starts, np.append(starts[1:], len(raw)), np.bincount(section, minlength=len(starts))))
                    rows.append((len(ends), len(starts), int(cross.sum())))
                counts = np.array(rows, np.int64).reshape(-1, 3)
                cells = pa.StructArray.from_arrays([pa.array(np.concatenate([f[c] for f in flat]).astype(np.int64)) for c in range(3)], names=["start", "end", "tokens"])
                offs = np.concatenate([[0], np.cumsum(counts[:, 1])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key"), *(pa.array(counts[:, c]) for c in range(3)), pa.ListArray.from_arrays(pa.array(offs), cells)],
                    names=["_key", "n_tokens", "n_sections", "n_crossing", "sections"],
                )

    kind = dict(docs.select(key).dtypes)[key]
    schema = f"_key {kind}, n_tokens bigint, n_sections bigint, n_crossing bigint, sections array<struct<start: bigint, end: bigint, tokens: bigint>>"
    return docs.select(docs[key].alias("_key"), docs[text].alias("_text")).mapInArrow(run, schema).withColumnRenamed("_key", key)
