"""Values of the byte runs of texts, kept in numpy tables by hash.

A slice of texts is cut into runs on its byte buffer; equal runs have equal 64-bit hashes, so Python sees a run only when
it is new. The values of all runs (ids, shown text) are parts of one array, from which the results of a whole
slice are gathered at once. Runs of more than ``LONG`` bytes, and texts that have to be taken whole, get values for one slice only.
The hash of up to 64 bytes is a polynomial modulo 2^64 under a mixing step: unlike runs share one with probability 2^-64.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from clickloom.llm.cells import LONG, Texts, mix

_LEAD = np.uint64(0xD1B54A32D192ED03)  # odd: tells apart runs by what stands before them


def united(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Different values of two rising arrays."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return both[np.append(True, both[1:] != both[:-1])] if len(both) else both


def ragged(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The parts of ``pool`` one after the other."""
    total = int(size.sum())
    return pool[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(total)]


def listed(values: list[bytes], kind) -> tuple[np.ndarray, np.ndarray]:
    """The values one after the other, and the size of each."""
    kind = np.dtype(kind)
    return np.frombuffer(b"".join(values), kind), np.fromiter(map(len, values), np.int64, len(values)) // kind.itemsize


class RunMemo:
    """Hash-keyed memo of runs with one value per kind; emptied when it is above ``budget`` bytes."""

    def __init__(self, kinds: list, budget: int):
        self.kinds, self.budget = kinds, budget
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.pools = [np.empty(0, k) for k in self.kinds]
        self.parts = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in self.kinds]  # begin and size of each key's value

    @property
    def held(self) -> int:
        return sum(p.nbytes for p in self.pools) + len(self.keys) * 8 * (1 + 2 * len(self.kinds))

    def gather(self, texts: Texts, start: np.ndarray, end: np.ndarray, doc: np.ndarray, lead: np.ndarray, whole: np.ndarray, learn: Callable, learn_whole: Callable) -> list[tuple[np.ndarray, np.ndarray]]:
        """(values of all texts, number of each text's) per kind.

        ``start, end, doc`` are the runs in order, ``lead`` says what stands before them, and ``whole`` are the texts without runs that are taken as they
        are. ``learn(texts, start, end, lead)`` and ``learn_whole(list of str)`` give values and sizes per kind.
        """
        if self.held > self.budget:
            self._clear()
        rare = end - start > LONG
        short, long = np.flatnonzero(~rare), np.flatnonzero(rare)
        h = mix(texts.hashes(start[short], end[short]) + lead[short].astype(np.uint64) * _LEAD)
        coded = pa.array(h).dictionary_encode()
        code, own = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        at = np.searchsorted(self.keys, own)
        new = np.flatnonzero(np.append(self.keys, np.uint64(0))[at] != own) if len(self.keys) else np.arange(len(own))
        if len(self.keys):
            new = united(new, np.flatnonzero(at == len(self.keys)))
        if len(new):
            first = np.empty(len(own), np.int64)
            first[code[::-1]] = short[::-1]  # the first run of each code
            picked = np.sort(first[new])
            fresh = own[code[np.searchsorted(short, picked)]]
            keys = np.concatenate([self.keys, fresh])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            for k, (values, size) in enumerate(learn(texts, start[picked], end[picked], lead[picked])):
                begin = len(self.pools[k]) + np.cumsum(size) - size
                self.pools[k] = np.concatenate([self.pools[k], values])
                self.parts[k] = tuple(np.concatenate(x)[order] for x in zip(self.parts[k], (begin, size)))
            at = np.searchsorted(self.keys, own)
        extra = []
        if len(long):
            extra.append(learn(texts, start[long], end[long], lead[long]))
        if len(whole):
            extra.append(learn_whole([texts.raw[texts.offs[i] : texts.offs[i + 1]].tobytes().decode() for i in whole.tolist()]))
        place = np.empty(len(start) + len(whole), np.int64)
        if len(short):
            place[short] = at[code]
        place[np.append(long, len(start) + np.arange(len(whole)))] = len(self.keys) + np.arange(len(long) + len(whole))
        owner = np.append(doc, whole)
        if len(whole):
            order = np.argsort(owner, kind="stable")
            place, owner = place[order], owner[order]
        out = []
        for k, (pool, (begin, size)) in enumerate(zip(self.pools, self.parts)):
            for values, sizes in (e[k] for e in extra):
                begin, size = np.append(begin, len(pool) + np.cumsum(sizes) - sizes), np.append(size, sizes)
                pool = np.concatenate([pool, values])
            size = size[place]
            out.append((ragged(pool, begin[place], size), np.bincount(owner, weights=size, minlength=texts.n).astype(np.int64)))
        return out


def _classes() -> np.ndarray:
    out = np.zeros(256, np.int8)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"0123456789", b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"), start=1):
        out[list(chars)] = k
    return out


#: ASCII letters, digits and marks; 0: the apostrophe (of contractions), controls and bytes of other characters.
_CLASS = _classes()


def parted(texts: Texts, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut where ASCII letters, digits and marks meet, which pre-tokenizers always part; start, end and text of each."""
    kind = _CLASS[texts.raw]
    meet = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
    start, end = united(start, meet), united(end, meet)
    return start, end, np.searchsorted(texts.offs, start, "right") - 1


def holding(texts: Texts, marks: list[bytes]) -> np.ndarray:
    """Whether each text holds one of the marks."""
    out, data = np.zeros(texts.n, bool), texts.raw.tobytes() if marks else b""
    for mark in marks:
        at = data.find(mark)
        while at >= 0:
            i = int(np.searchsorted(texts.offs, at, "right")) - 1
            out[i] |= at + len(mark) <= texts.offs[i + 1]
            at = data.find(mark, at + 1)
    return out
