"""Encoding with a byte-level tokenizer file, with a memo of blank-separated pieces that is bounded in bytes.

The file's pre-tokenizer never joins a blank to what stands before it, so a text in which every blank
is followed by a visible character may be cut before each blank and the pieces encoded on their own.
Other texts, and those with a special token, are encoded whole by the library. New pieces are cut further
at single line breaks and between letters and marks, and their parts are encoded by the library in
long texts, whose tokens are dealt back by their byte lengths. Long pieces are kept for one slice of texts only.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

from clickloom.llm.cells import Texts, no_cycles, settle, task_state
from clickloom.llm.runs import RunMemo, holding, listed, parted, ragged

MEMO = 200_000
MEMO_BYTES = 48 << 20  # of one generation of one memo, keys and dict entries included
SLICE = 4 << 20  # bytes of text at a time
RUN_BYTES = 32 << 20  # of the memo of runs
_FEW = 4 << 20  # bytes of the memos below it, which only meet what is new there
_JOINED = 1 << 20  # bytes of runs that are encoded as one text
_NO_BLANK = np.arange(256) != 32
#: Bytes that begin no visible character after a blank (ASCII white space), and first bytes of those that may not.
_WHITE_NEXT = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_MAYBE_WHITE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
#: Marks that the pre-tokenizer always parts from letters before them (no apostrophe).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def groups(texts: list[str], count: int = 20_000, size: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in order, some at a time: at most ``count`` with up to ``size`` characters, or one."""
    at = room = 0
    for i, t in enumerate(texts):
        room += len(t)
        if i > at and (i - at == count or room > size):
            yield texts[at:i]
            at, room = i, len(t)
    if texts:
        yield texts[at:]


class PieceEncoder:
    def __init__(self, text: str, memo: int = MEMO, memo_bytes: int = MEMO_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.memo, self.memo_bytes = Tokenizer.from_str(text), memo, memo_bytes
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.unsafe, self.white = re.compile(r" (?:\s|$)"), re.compile(r"\s")
        self.memos, self.olds = {" ": {}, "": {}}, {" ": {}, "": {}}
        self.counted, self.held = {" ": 0, "": 0}, {" ": 0, "": 0}  # entries of the memos, and their bytes
        self.runs = RunMemo([self.kind], RUN_BYTES)
        self.sizes = self.lengths()
        self.line_break = self._whole(["\n"])[0]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for some in groups(texts) for e in self.library.encode_batch_fast(some, add_special_tokens=False)]

    def _joined(self, words: list[str], lead: str) -> list[bytes]:
        """Ids of words without white space, encoded as one text; ``lead`` (blank or line break) stands before each.

        A blank belongs to its word; a line break is a token of its own, which is left out.
        """
        out = []
        for some in groups(words):
            ids = np.array(self.library.encode_batch_fast([lead + lead.join(some)], add_special_tokens=False)[0].ids, self.kind)
            begins = np.concatenate([[0], np.cumsum([len(w.encode()) + 1 for w in some])])
            places = np.searchsorted(np.concatenate([[0], np.cumsum(self.sizes[ids])]), begins)
            skip = int(lead == "\n")
            raw, width = ids.tobytes(), self.kind.itemsize
            out += [raw[(a + skip) * width : b * width] for a, b in zip(places[:-1].tolist(), places[1:].tolist())]
        return out

    def _learn(self, met: set, lead: str) -> None:
        """Put pieces with a leading blank, or without, into their memo."""
        memo, old = self.memos[lead], self.olds[lead]
        fresh = met - memo.keys()
        again = fresh & old.keys()
        memo.update([(p, old[p]) for p in again])
        fresh -= again
        if not fresh:
            return
        lined, marked, cores = [], [], []
        for p in fresh:
            if "\n" in p:
                lined.append(p)
            else:
                core = p.rstrip(MARKS)
                if core != p and core and core[-1].isalpha():
                    marked.append((p, core, p[len(core) :]))
                else:
                    cores.append(p)
        if lined:
            self._learn_lines(lined, lead)
        cores = list({*cores, *(c for _, c, _ in marked)} - memo.keys())
        odd = [w for w in cores if self.white.search(w)] if self.white.search("".join(cores)) else []
        if odd:
            memo.update(zip(odd, self._whole([lead + w for w in odd])))
            cores = list(set(cores) - set(odd))
        memo.update(zip(cores, self._joined(cores, lead or "\n")))
        tails = {t for *_, t in marked}
        if lead or not tails <= memo.keys():
            self._learn_marks(tails)
        ends = self.memos[""]
        memo.update([(p, memo[c] + ends[t]) for p, c, t in marked])

    def _learn_marks(self, tails: set) -> None:
        memo = self.memos[""]
        new = list(tails - memo.keys())
        memo.update(zip(new, self._whole(new)))

    def _learn_lines(self, pieces: list[str], lead: str) -> None:
        """Pieces with line breaks: cut at single breaks, whole where white space meets."""
        cut, whole = [], []
        for p in pieces:
            lines = p.split("\n")
            (whole if any(not x or x[0].isspace() or x[-1].isspace() for x in lines) else cut).append((p, lines))
        memo = self.memos[lead]
        memo.update(zip([p for p, _ in whole], self._whole([lead + p for p, _ in whole])))
        self._learn({x[0] for _, x in cut}, lead)
        self._learn({y for _, x in cut for y in x[1:]}, "")
        rest, gap = self.memos[""], self.line_break
        memo.update([(p, memo[x[0]] + gap + gap.join([rest[y] for y in x[1:]])) for p, x in cut])

    def encode(self, texts: list) -> list[bytes]:
        """Ids of each text (null: none), as little-endian integers of ``self.kind``."""
        with no_cycles():
            return self._encode(texts)

    def _encode(self, texts: list) -> list[bytes]:
        out = [b""] * len(texts)
        whole, cut = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            if self.unsafe.search(t) or any(s in t for s in self.special):
                whole.append(i)
            else:
                cut.append((i, t.split(" ")))
        for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = ids
        pieces, heads = set(), set()
        for _, p in cut:
            pieces.update(p[1:])
            heads.add(p[0])
        heads.discard("")
        for lead, met in ((" ", pieces), ("", heads)):
            if len(self.memos[lead]) + len(met) > self.memo:
                self._turn(lead)
        for lead, met in ((" ", pieces), ("", heads)):
            self._learn(met, lead)
        find, first = self.memos[" "].__getitem__, self.memos[""]
        first[""] = b""
        for i, p in cut:
            out[i] = first[p[0]] + b"".join(map(find, p[1:]))
        for lead, memo in self.memos.items():
            self.held[lead] += settle([memo], self.counted[lead])
            self.counted[lead] = len(memo)
            if self.held[lead] > self.memo_bytes:
                self._turn(lead)
        return out

    def _whole_only(self, texts: Texts) -> np.ndarray:
        """Texts that can't be cut before each blank: a blank before white space or at the end, or a special token."""
        out = holding(texts, [s.encode() for s in self.special])
        blank = texts.raw == 32
        after = np.append(texts.raw[1:], np.uint8(32)) if len(texts.raw) else texts.raw.copy()
        after[texts.offs[1:][texts.offs[1:] > texts.offs[:-1]] - 1] = 32
        out |= texts.sums(blank & _WHITE_NEXT[after]) > 0
        for i in np.flatnonzero(~out & (texts.sums(blank & _MAYBE_WHITE[after]) > 0)).tolist():
            out[i] = self.unsafe.search(texts.raw[texts.offs[i] : texts.offs[i + 1]].tobytes().decode()) is not None
        return out

    def encode_slice(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and their number in each text."""
        whole = self._whole_only(texts)
        start, end, doc = parted(texts, *texts.runs(_NO_BLANK)[:2])
        cut = ~whole[doc]
        start, end, doc = start[cut], end[cut], doc[cut]
        lead = (start > texts.offs[doc]) & (texts.raw[start - 1] == 32)  # a blank stands before it
        whole_ids = lambda some: [listed(self._whole(some), self.kind)]
        return self.runs.gather(texts, start, end, doc, lead, np.flatnonzero(whole), self._learn_runs, whole_ids)[0]

    def _learn_runs(self, texts: Texts, start: np.ndarray, end: np.ndarray, lead: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of runs. Those after a blank are encoded together with their blanks: the pre-tokenizer cuts before each of them."""
        size = np.zeros(len(start), np.int64)
        led = np.flatnonzero(lead)
        begin, bytes_ = start[led] - 1, end[led] - start[led] + 1
        ids, at = [], np.concatenate([[0], np.cumsum(bytes_)])
        cuts = [*dict.fromkeys(np.searchsorted(at, np.arange(0, at[-1], _JOINED)).tolist()), len(led)] if len(led) else []
        for a, b in zip(cuts, cuts[1:]):
            text = ragged(texts.raw, begin[a:b], bytes_[a:b]).tobytes().decode()
            ids.append(np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind))
        flat = np.concatenate(ids) if ids else np.empty(0, self.kind)
        ends = np.searchsorted(np.cumsum(self.sizes[flat]), at[1:]) + 1
        size[led] = np.diff(ends, prepend=0)
        heads = np.flatnonzero(~lead)
        if not len(heads):
            return [(flat, size)]
        with no_cycles():
            own, size[heads] = listed(self.encode([texts.raw[a:b].tobytes().decode() for a, b in zip(start[heads].tolist(), end[heads].tolist())]), self.kind)
        out, where = np.empty(len(flat) + len(own), self.kind), np.repeat(lead, size)
        out[where], out[~where] = flat, own
        return [(out, size)]

    def _turn(self, lead: str) -> None:
        """Begin a new generation; the last one stays readable unless it is too large, and what is met again moves on."""
        self.olds[lead] = self.memos[lead] if self.held[lead] <= 2 * self.memo_bytes else {}
        self.memos[lead], self.counted[lead], self.held[lead] = {}, 0, 0

    def lengths(self) -> np.ndarray:
        """UTF-8 bytes that each id stands for."""
        sizes = np.zeros(self.size, np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            sizes[i] = len(token.encode()) if token in self.special else len(token)  # one character per byte
        return sizes


def piece_encoder(text: str) -> PieceEncoder:
    """The encoder of a tokenizer file, built once per Python worker."""
    state = task_state("pieces")
    mark = hash(text)
    if getattr(state, "mark", None) != mark:
        state.mark, state.made = mark, PieceEncoder(text, memo_bytes=_FEW)
    return state.made
