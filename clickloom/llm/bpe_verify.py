"""Byte-pair encoding by speculation and verification, and its decoding.

For a batch of new words, greedy longest match in the vocabulary proposes tokens. A sequence of tokens is
the byte-pair encoding of its word exactly if every token encodes to itself and every adjacent pair is
compatible, that is, if no merge across their border would have come first. All pairs of the batch are
tested together in numpy; only words with an incompatible pair are merged exactly.

A pair (a, b) is tested by undoing merges at its border, the latest first: while x is the last part of a
and y the first part of b, a merge (x, y) of rank r would have crossed the border if it comes before x is
taken into its parent and not after y is taken into its own (of equal ranks the left place comes first).

The vocabulary file (BPE with a word-end suffix, NFC, lower case, white space dropped) is read on the
driver and broadcast. Slices of texts are cut into runs without ASCII white space on their byte buffer; runs already seen are found by hash in a memo
per Python worker that is bounded in bytes. Long ones are kept for one slice of texts only.

Cases: null and empty texts have no ids and decode to an empty text. Special tokens that occur in a
text are matched first, as in the file. Repeated rows are encoded alike. Keys may be null. Very long words are
merged with a heap. An empty table gives no rows. Only key and text are read.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from clickloom.llm.cells import SPACE, Texts, no_cycles, settle, slices, task_state
from clickloom.llm.runs import RunMemo, holding, listed, parted

MEMO = 250_000
MEMO_BYTES = 96 << 20  # of one generation of runs, and of the words; keys and dict entries included
SLICE = 2 << 20  # bytes of text at a time
RUN_BYTES = 32 << 20  # of the memo of runs
_FEW = 4 << 20  # bytes of the memos below it, which only meet what is new there
_BIG = np.int64(1 << 40)
_WIDE = 32  # words of more symbols are merged one by one
#: The characters that count as white space (Unicode White_Space).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_chars() -> list[str]:
    """Printable stand-in of each byte: itself where printable in Latin-1, else the next code from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    codes = {b: b for b in kept}
    for b in range(256):
        codes.setdefault(b, 256 + len(codes) - len(kept))
    return [chr(codes[b]) for b in range(256)]


class Encoder:
    """Tables of one vocabulary file and the memo of words."""

    def __init__(self, text: str, memo: int = MEMO, memo_bytes: int = MEMO_BYTES):
        spec = json.loads(text)
        model = spec["model"]
        self.suffix, self.memo, self.memo_bytes = model["end_of_word_suffix"] or "", memo, memo_bytes
        self.ids = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.texts = [""] * size
        for t, i in [*self.ids.items(), *self.special.items()]:
            self.texts[i] = t
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.merges = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.merges[x, y] = (r, z)
            self.rank[z], self.left[z], self.right[z] = r, x, y
        keys = np.array([(x << 32) | y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.pair_made = np.array([z for _, z in self.merges.values()], np.int64)  # by rank, as merges are listed
        whole = self._whole()
        self.greedy = {t: i for t, i in self.ids.items() if whole[i]}
        self.longest = max(map(len, self.greedy), default=1)
        self.chars = byte_chars()
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.white = regex.compile(f"[{WHITE}]+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known, self.shown, self.old_known, self.old_shown = {}, {}, {}, {}
        self.runs = RunMemo([np.dtype("<u4"), np.dtype(np.uint8)], RUN_BYTES)
        self.word_ids, self.word_shown = {}, {}
        self.counted = self.held = self.words_counted = self.words_held = 0  # entries of the memos, and their bytes

    def _pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not len(self.pair_keys):
            return np.full(len(x), _BIG)
        key = (x << 32) | y
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _BIG)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether each pair of tokens stays apart, up to the merges before rank ``limit``."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        nx = np.full(len(a), _BIG) if limit is None else limit.astype(np.int64)
        ny = nx.copy()
        while len(live):
            r = self._pair_rank(x, y)
            bad = (r < nx) & (r <= ny)
            ok[live[bad]] = False
            go = ~bad & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            live, x, y, nx, ny = live[go], x[go], y[go], nx[go], ny[go]
            undo = self.rank[x] > self.rank[y]  # of equal ranks the right one was merged later
            nx, ny = np.where(undo, self.rank[x], nx), np.where(undo, ny, self.rank[y])
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return ok

    def _whole(self) -> np.ndarray:
        """Tokens that encode to themselves."""
        made = np.flatnonzero(self.rank >= 0)
        ok = np.ones(len(self.rank), bool)
        ok[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])].tolist():
            ok[t] &= ok[self.left[t]] and ok[self.right[t]]
        return ok

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; ``word`` is in stand-in characters."""
        out, i, n = [], 0, len(word)
        find, suffix, longest = self.greedy.get, self.suffix, self.longest
        while i < n:
            t = find(word[i:] + suffix) if n - i <= longest else None
            if t is not None:
                out.append(t)
                return out
            for j in range(min(n - 1, i + longest), i, -1):
                t = find(word[i:j])
                if t is not None:
                    break
            out.append(t)
            i = j
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merging: lowest rank first, then leftmost."""
        ids = [self.ids[c] for c in word[:-1]] + [self.ids[word[-1] + self.suffix]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.merges[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heapq.heapify(heap)
        heap_pop, heap_push = heapq.heappop, heapq.heappush
        while heap:
            _, z, i, a, b = heap_pop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = z, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := (z, ids[k])) in self.merges:
                    heap_push(heap, (*self.merges[p], i, *p))
            h = before[i]
            if h >= 0 and (p := (ids[h], z)) in self.merges:
                heap_push(heap, (*self.merges[p], h, *p))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[str]) -> tuple[list[list[int]], int]:
        """Ids of each word, and the number that had to be merged exactly."""
        if not words:
            return [], 0
        found = [self.propose(w) for w in words]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for f in found for t in f), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(found)), size)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, where = np.unique((flat[inner] << 32) | flat[inner + 1], return_inverse=True)
        wrong = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[where]
        failed = np.unique(owner[inner[wrong]])
        short = [w for w in failed.tolist() if len(words[w]) <= _WIDE]
        for w, ids in zip(short, self.merge_together([words[w] for w in short])):
            found[w] = ids
        for w in failed.tolist():
            if len(words[w]) > _WIDE:
                found[w] = self.merge(words[w])
        return found, len(failed)

    def merge_together(self, words: list[str]) -> list[list[int]]:
        """Exact merging of many short words at once: each step merges the first pair in order of every word."""
        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.full((len(words), int(size.max()) + 1), -1, np.int64)
        symbol, suffix = self.ids, self.suffix
        ids[np.repeat(np.arange(len(words)), size), np.concatenate([np.arange(n) for n in size])] = np.fromiter((symbol[c] for w in words for c in w), np.int64, int(size.sum()))
        ids[np.arange(len(words)), size - 1] = [symbol[w[-1] + suffix] for w in words]
        inside = (ids[:, :-1] >= 0) & (ids[:, 1:] >= 0)
        rank = np.full(inside.shape, _BIG)
        rank[inside] = self._pair_rank(ids[:, :-1][inside], ids[:, 1:][inside])
        out = [None] * len(words)
        name = np.arange(len(words))
        while True:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(at)), at]
            done = best >= _BIG
            if done.any():
                for k, row in zip(name[done].tolist(), ids[done].tolist()):
                    out[k] = row[: row.index(-1)]
                ids, rank, name, at, best = ids[~done], rank[~done], name[~done], at[~done], best[~done]
            if not len(name):
                return out
            rows, n = np.arange(len(name)), rank.shape[1]
            ids[rows, at] = self.pair_made[best]
            step = np.arange(n)
            ids = np.concatenate([np.where(step <= at[:, None], ids[:, :-1], ids[:, 1:]), np.full((len(name), 1), -1)], axis=1)
            rank = np.concatenate([np.where(step[:-1] < at[:, None], rank[:, :-1], rank[:, 1:]), np.full((len(name), 1), _BIG)], axis=1)
            for i in (at - 1, at):
                ok = np.flatnonzero(i >= 0)
                x, y = ids[ok, i[ok]], ids[ok, i[ok] + 1]
                rank[ok, i[ok]] = np.where(y >= 0, self._pair_rank(x, np.maximum(y, 0)), _BIG)

    def learn(self, chunks) -> None:
        """Put the chunks (runs without white space) into the memo."""
        chunks = list(chunks)
        split = [self.words.findall(c) for c in chunks]
        known, seen, table, texts = self.word_ids, self.word_shown, self.chars, self.texts
        new = [w for w in dict.fromkeys(w for s in split for w in s) if w not in known]
        shapes = [w if w.isascii() and w.isprintable() else "".join([table[b] for b in w.encode()]) for w in new]
        for w, ids in zip(new, self.encode_words(shapes)[0]):
            known[w], seen[w] = pack(f"<{len(ids)}I", *ids), " ".join([texts[t] for t in ids])
        for c, s in zip(chunks, split):
            if len(s) == 1:
                self.known[c], self.shown[c] = known[s[0]], seen[s[0]]
            else:
                self.known[c] = b"".join([known[w] for w in s])
                self.shown[c] = " ".join([seen[w] for w in s])
        self.words_held += settle([known, seen], self.words_counted)
        self.words_counted = len(known)
        if self.words_counted > self.memo or self.words_held > self.memo_bytes:
            self.word_ids, self.word_shown, self.words_counted, self.words_held = {}, {}, 0, 0

    def pieces(self, text: str) -> list:
        """Chunks of a text in order; a special token is an int."""
        parts = self.cut.split(text) if self.cut is not None and any(s in text for s in self.special) else [text]
        out = []
        for p in parts:
            if p in self.special:
                out.append(self.special[p])
                continue
            if not p.isascii():
                p = unicodedata.normalize("NFC", p).replace("Σ", "σ")  # no final form, as in the file's rule
            p = p.lower()
            # str.split also cuts at U+001C..U+001F, which are no white space here
            odd = not p.isprintable() and any(c in p for c in "\x1c\x1d\x1e\x1f")
            out.extend(filter(None, self.white.split(p)) if odd else p.split())
        return out

    def encode(self, texts: list) -> tuple[list[bytes], list[str]]:
        """Ids (little-endian unsigned 32 bit) and decoded text of each text."""
        with no_cycles():
            return self._encode(texts)

    def _encode(self, texts: list) -> tuple[list[bytes], list[str]]:
        cut = [self.pieces(t) if t else [] for t in texts]
        fresh = {c for p in cut for c in p} - self.known.keys()
        if len(self.known) + len(fresh) > self.memo:
            self._turn()
            fresh = {c for p in cut for c in p}
        for c in fresh & self.old_known.keys():
            self.known[c], self.shown[c] = self.old_known[c], self.old_shown[c]
            fresh.discard(c)
        for s in [c for c in fresh if isinstance(c, int)]:
            self.known[s], self.shown[s] = np.array([s], "<u4").tobytes(), self.texts[s]
            fresh.discard(s)
        self.learn(fresh)
        known, shown = self.known.__getitem__, self.shown.__getitem__
        out = [b"".join(map(known, p)) for p in cut], [" ".join(map(shown, p)) for p in cut]
        self.held += settle([self.known, self.shown], self.counted)
        self.counted = len(self.known)
        if self.held > self.memo_bytes:
            self._turn()
        return out

    def _valued(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and shown text of each run; a blank follows what is shown."""
        ids, shown = self._encode(texts)
        return [listed(ids, "<u4"), listed([f"{s} ".encode() if s else b"" for s in shown], np.uint8)]

    def _learn_runs(self, texts: Texts, start: np.ndarray, end: np.ndarray, lead: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """As :meth:`_valued`, for runs of which most are one word of ASCII letters."""
        raw = texts.raw.tobytes()
        runs = [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]
        plain = [r.isascii() and r.isalpha() for r in runs]
        words = [r.lower() for r, ok in zip(runs, plain) if ok]
        new = dict.fromkeys(words)
        shown = self.texts
        for w, ids in zip(new, self.encode_words(list(new))[0]):
            new[w] = pack(f"<{len(ids)}I", *ids), (" ".join([shown[t] for t in ids]) + " ").encode()
        found = iter([new[w] for w in words])
        rest = [r for r, ok in zip(runs, plain) if not ok]
        ids, texts_shown = self._encode(rest) if rest else ([], [])
        others = iter([(i, f"{s} ".encode() if s else b"") for i, s in zip(ids, texts_shown)])
        values = [next(found) if ok else next(others) for ok in plain]
        return [listed([v[0] for v in values], "<u4"), listed([v[1] for v in values], np.uint8)]

    def encode_slice(self, texts: Texts) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Ids, and bytes of the decoded text, of all texts one after the other, each with its number in every text."""
        whole = holding(texts, [s.encode() for s in self.special])
        start, end, doc = parted(texts, *texts.runs(~SPACE)[:2])
        cut = ~whole[doc]
        with no_cycles():
            ids, (shown, size) = self.runs.gather(texts, start[cut], end[cut], doc[cut], np.zeros(int(cut.sum()), bool), np.flatnonzero(whole), self._learn_runs, self._valued)
        keep = np.ones(len(shown), bool)
        keep[np.cumsum(size)[size > 0] - 1] = False  # no blank after the last one
        return ids, (shown[keep], size - (size > 0))

    def _turn(self) -> None:
        """Begin a new generation; the last one stays readable unless it is too large, and what is met again moves on."""
        small = self.held <= 2 * self.memo_bytes
        self.old_known, self.old_shown = (self.known, self.shown) if small else ({}, {})
        self.known, self.shown, self.counted, self.held = {}, {}, 0, 0

    def decode(self, ids) -> str:
        """Text of ids: tokens joined by blanks, as the file has no decoder."""
        return " ".join([self.texts[i] for i in ids])


def encoder(text: str) -> Encoder:
    """The encoder of a vocabulary file, built once per Python worker."""
    state = task_state("bpe_verify")
    mark = hash(text)
    if getattr(state, "mark", None) != mark:
        state.mark, state.made = mark, Encoder(text, memo_bytes=_FEW)
    return state.made


def cells_of(data: np.ndarray, size: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Array of texts or binaries whose bytes follow each other in ``data``."""
    return pa.Array.from_buffers(kind, len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", keep: list[str] = ()) -> DataFrame:
    """(key, kept columns, n_tokens, ids, decoded) of every text; ``ids`` are little-endian unsigned 32-bit integers.

    ``vocabulary`` is the path of the file on the driver. One pass, no shuffle.
    """
    with open(vocabulary, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    cols = list(dict.fromkeys([key, *keep]))

    def run(batches):
        made = encoder(sent.value)
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                (ids, count), (shown, size) = made.encode_slice(Texts(part.column("_text")))
                columns = [*(part.column(c) for c in cols), pa.array(count), cells_of(ids, 4 * count, pa.large_binary()).cast(pa.binary()), cells_of(shown, size, pa.large_string()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*cols, "n_tokens", "ids", "decoded"])

    kinds = dict(docs.select(*cols).dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in cols), "n_tokens bigint, ids binary, decoded string"])
    return docs.select(*cols, docs[text].alias("_text")).mapInArrow(run, schema)
