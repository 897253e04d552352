"""Vectorised words and hashes over Arrow text columns.

An Arrow batch of texts is one byte buffer plus offsets. Everything here works on that buffer with
numpy, so a task holds one slice of a few megabytes (or one longer document) at a time.
Null texts count as empty. A word is a run of bytes other than space and 0x09-0x0D.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

SLICE_BYTES = 4 << 20
FEW_BYTES = 1 << 20  # a slice of texts that are looked at one by one
_POWERS = 1 << 20  # powers that a worker keeps from task to task
LONG = 64  # characters; longer texts are not kept in memos
_SLOT = 100  # bytes of an entry of a dict besides its key and value
_BYTES = np.arange(256)
SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
#: Bytes of letter runs: A-Z, a-z, 0-9 and every byte of a non-ASCII character.
ALNUM = np.isin(_BYTES, [*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]) | (_BYTES >= 128)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0x5851F42D4C957F2D  # odd, hence invertible modulo 2^64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other (published splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random code per byte value.
CODES = mix((np.arange(1, 257).astype(np.uint64)) * _ODD) | np.uint64(1)
LOWER_CODES = CODES[LOWER]


def worker_state(name: str) -> types.SimpleNamespace:
    """Memo that lives as long as the Python worker: tables and caches that any task can rebuild."""
    home = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))
    return home.__dict__.setdefault(name, types.SimpleNamespace())


def task_state(name: str) -> types.SimpleNamespace:
    """As :func:`worker_state`, for large tables: they go when a task of another operator begins in this worker (see :func:`slices`)."""
    home = worker_state("large")
    home.task = _task()
    if f"of_{name}" not in home.__dict__:
        _give_back()
    return home.__dict__.setdefault(f"of_{name}", types.SimpleNamespace())


def _give_back() -> None:
    """Return freed memory to the system, where the C library can (a hundred megabytes of a worker after small objects have gone)."""
    gc.collect()
    _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _task() -> int | None:
    here = TaskContext.get()
    return here.taskAttemptId() if here else None


def _release() -> None:
    """Drop the large tables of earlier tasks' operators, and give their memory back."""
    home = worker_state("large")
    held = [k for k in home.__dict__ if k.startswith("of_")]
    if held and _task() != home.task:
        for k in held:
            delattr(home, k)
        _give_back()


def _trim_once() -> None:
    """Give back what earlier tasks of this worker freed, once a task."""
    home = worker_state("trimmed")
    if getattr(home, "task", None) != _task():
        home.task = _task()
        kept = worker_state("powers")
        if len(getattr(kept, "up", ())) > _POWERS:
            kept.up, kept.down = kept.up[:_POWERS].copy(), kept.down[:_POWERS].copy()
        _trim()


@contextmanager
def no_cycles():
    """Pause the cycle collector while large memos of plain strings grow; it would scan them for nothing."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def settle(memos: list[dict], counted: int) -> int:
    """Drop long texts from what was put into memos of equal keys after their first ``counted`` entries; bytes of the rest."""
    new = list(islice(memos[0], counted, None))
    size, of = 0, sys.getsizeof
    for key in new:
        if isinstance(key, str) and len(key) > LONG:
            for m in memos:
                del m[key]
        else:
            size += of(key) + sum([_SLOT + of(m[key]) for m in memos])
    return size


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """step^i and step^-i modulo 2^64 for i < n."""
    state = worker_state("powers")
    if len(getattr(state, "up", ())) < n:
        size = max(_POWERS, 1 << (n - 1).bit_length())  # as the slices of this task need
        up, down = np.full(size, _STEP, np.uint64), np.full(size, pow(_STEP, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        state.up, state.down = np.cumprod(up), np.cumprod(down)
    return state.up[:n], state.down[:n]


class Texts:
    """Byte buffer of some texts; ``offs[i]:offs[i + 1]`` is text ``i``."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "") if column.null_count else column
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
        offs = offs[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        self.n, self.offs = len(column), offs - offs[0]
        self.raw = raw[offs[0] : offs[-1]]

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text range (n + 1 pointers) of the maximal runs of ``member`` bytes, never across texts."""
        size = len(self.raw)
        inside = member[self.raw]
        before, after = np.empty(size, bool), np.empty(size, bool)
        if size:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            edges = self.offs[(self.offs < size)]
            before[edges] = False
            after[self.offs[self.offs > 0] - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        return start, end, np.searchsorted(start, self.offs)

    def hashes(self, start: np.ndarray, end: np.ndarray, codes: np.ndarray = CODES) -> np.ndarray:
        """64-bit hash of the bytes of each run, whatever its place."""
        up, down = powers(len(self.raw) + 1)
        total = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum(codes[self.raw] * up[:-1], out=total[1:])
        h = (total[end] - total[start]) * down[start]
        return mix(h + (end - start).astype(np.uint64) * _ODD)

    def count(self, member: np.ndarray) -> np.ndarray:
        """Number of ``member`` bytes in each text."""
        return self.sums(member[self.raw])

    def sums(self, values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.offs[1:]] - total[self.offs[:-1]]


def owner(ptr: np.ndarray) -> np.ndarray:
    """Text index of each run."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def per_text(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over the runs of each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[ptr[1:]] - total[ptr[:-1]]


def windows(h: np.ndarray, ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``k`` runs inside one text, and the index of its first run."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = acc * np.uint64(_STEP) + h[j : j + n]
    last = np.repeat(ptr[1:], np.diff(ptr))  # end of the text of each run
    first = np.flatnonzero(np.arange(len(h))[:n] + k <= last[:n])
    return mix(acc[first]), first


def repeated(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more in their text, and which of those are not the first there."""
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) > 1:
        tagged = mix(keys + mix(doc.astype(np.uint64) * _ODD + np.uint64(1)))
        order = np.argsort(tagged, kind="stable")
        same = tagged[order][1:] == tagged[order][:-1]
        later[order[1:]] = same
        again[order[1:]] = same
        again[order[:-1]] |= same
    return again, later


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cut a batch so that the texts of each piece stay within ``limit`` bytes, or are one text."""
    _release()
    _trim_once()
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
