"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

1. A bounded sample of labelled documents (``bound`` rows) is written once. From it comes a lexicon of
   features (whole words and word beginnings) that are far more frequent in toxic than in clean
   documents: all that pass a test of significance.
2. Tokens of toxic sample documents that carry a telling feature are labelled toxic, all others clean.
   Windows of tokens around lexicon hits are the training sequences of the field: weights for lexicon
   features, a bias, transitions between the two tags and start weights, fitted by gradient steps on
   the log-likelihood, which take all windows in turn.
3. Every document is tagged: forward and backward messages give the probability of the toxic tag at
   each token, in blocks of the whole batch (products of 2 x 2 matrices per block, then one scan over
   the blocks), so the result is exact and no document is cut.
4. Document features (expected number of toxic tokens, the surest token, their rate) go through a
   logistic map fitted on the sample to a score; tokens of marginal 0.5 or more, joined where adjacent,
   are the spans.

A token is a run of letters and digits; A-Z are lower-cased. Labels, language, source and keys are
not inputs of a score.

Cases: null and empty texts have no tokens, no spans and the score of a document without toxic tokens.
Repeated rows are scored row by row; several labels of a key count by majority (1 in a tie). Null keys
are scored, never learnt from. Without labels of both classes, or where no feature passes the test (few labelled rows), every score
is 0 and there are no spans. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clickloom.llm.cells import ALNUM, LOWER_CODES, Texts, mix, owner, slices
from clickloom.llm.labelled import held_out, thinned, train_labels
from clickloom.session import scratch_path

FOLDS, HELD_OUT = 5, 0
BOUND = 20_000
BATCH = 12_000  # windows of a gradient step
EVIDENCE = 24.0
PREFIXES = (4, 5, 6, 7)  # bytes
KINDS = len(PREFIXES) + 1
NEAR, LENGTH = 3, 16
_BLOCK = 256


def token_features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text pointers of the tokens, and their features: the word, then its beginnings."""
    start, end, ptr = texts.runs(ALNUM)
    rows = [texts.hashes(start, end, LOWER_CODES)]
    for k, size in enumerate(PREFIXES, 1):
        rows.append(mix(texts.hashes(start, np.minimum(start + size, end), LOWER_CODES) + np.uint64(k)))
    return start, end, ptr, np.stack(rows)


class Lexicon:
    """Sorted feature hashes with a bitmap in front, so that most look-ups end in one byte."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.astype(np.uint64))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in the lexicon, its length where absent."""
        out = np.full(h.shape, len(self.keys), np.int32)
        hit = np.flatnonzero(self.seen[(h & np.uint64(0xFFFFF)).astype(np.int64)].ravel())
        if len(hit) and len(self.keys):
            value = h.ravel()[hit]
            at = np.minimum(np.searchsorted(self.keys, value), len(self.keys) - 1)
            out.ravel()[hit] = np.where(self.keys[at] == value, at, len(self.keys))
        return out


@dataclass
class Field:
    """Parameters: lexicon, its weights (last one 0, for absent), bias, 2 x 2 transitions, start weights; document map."""

    lexicon: Lexicon
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    start: np.ndarray
    doc: np.ndarray = field(default_factory=lambda: np.zeros(5))

    def potentials(self, feats: np.ndarray) -> np.ndarray:
        """Log-potential of the toxic tag at each token (the clean tag has 0)."""
        return self.weights[self.lexicon.find(feats)].sum(axis=0) + self.bias

    def score(self, summary: np.ndarray) -> np.ndarray:
        z = summary @ self.doc[:-1] + self.doc[-1]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _scan(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Normalised forward messages (n, 2): first[i] marks the first token of a document.

    ``emit`` (n, 2) are potentials; ``trans[a, b]`` the factor from tag a to tag b. A document start
    forgets what came before: its matrix has equal rows.
    """
    n = len(emit)
    if n == 0:
        return np.zeros((0, 2))
    blocks = -(-n // _BLOCK)
    pad = blocks * _BLOCK - n
    e = np.concatenate([emit, np.ones((pad, 2))]).reshape(blocks, _BLOCK, 2).transpose(1, 2, 0).copy()
    f = np.concatenate([first, np.zeros(pad, bool)]).reshape(blocks, _BLOCK).T.copy()
    # 1. product of each block's matrices, for both unit vectors at once
    u = np.zeros((2, 2, blocks))  # [unit vector, tag, block]
    u[0, 0] = u[1, 1] = 1.0
    for t in range(_BLOCK):
        begin = u[:, 0] + u[:, 1]
        for_0 = np.where(f[t], begin * start[0], u[:, 0] * trans[0, 0] + u[:, 1] * trans[1, 0]) * e[t, 0]
        for_1 = np.where(f[t], begin * start[1], u[:, 0] * trans[0, 1] + u[:, 1] * trans[1, 1]) * e[t, 1]
        scale = 1.0 / (for_0 + for_1).max(axis=0)  # one factor for both vectors keeps their ratio
        u[:, 0], u[:, 1] = for_0 * scale, for_1 * scale
    # 2. messages at the block edges
    edge = np.empty((2, blocks))
    a, b = 0.5, 0.5
    for k in range(blocks):
        edge[0, k], edge[1, k] = a, b
        a, b = a * u[0, 0, k] + b * u[1, 0, k], a * u[0, 1, k] + b * u[1, 1, k]
        total = a + b
        a, b = a / total, b / total
    # 3. messages inside the blocks
    out = np.empty((_BLOCK, 2, blocks))
    m0, m1 = edge[0], edge[1]
    for t in range(_BLOCK):
        n0 = np.where(f[t], (m0 + m1) * start[0], m0 * trans[0, 0] + m1 * trans[1, 0]) * e[t, 0]
        n1 = np.where(f[t], (m0 + m1) * start[1], m0 * trans[0, 1] + m1 * trans[1, 1]) * e[t, 1]
        total = n0 + n1
        m0, m1 = n0 / total, n1 / total
        out[t, 0], out[t, 1] = m0, m1
    return out.transpose(2, 0, 1).reshape(-1, 2)[:n]


def marginals(potential: np.ndarray, ptr: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Probability of the toxic tag at each token; ``ptr`` bounds the documents."""
    n = len(potential)
    emit = np.ones((n, 2))
    emit[:, 1] = np.exp(np.clip(potential, -30, 30))
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    filled = ptr[1:] > ptr[:-1]
    first[ptr[:-1][filled]] = True
    last[ptr[1:][filled] - 1] = True
    t, s = np.exp(trans), np.exp(start)
    forward = _scan(emit, first, t, s)
    # backwards: the same scan on the reversed tokens; its message holds the token's own factor once more
    backward = _scan(emit[::-1], last[::-1], t.T, np.ones(2))[::-1]
    both = forward * backward / emit
    return both[:, 1] / both.sum(axis=1)


def summaries(p: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Document features: log of expected toxic tokens, logit of the surest one, log odds of any, rate."""
    n = len(ptr) - 1
    doc = owner(ptr)
    expected = np.bincount(doc, weights=p, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, doc, p)
    none = np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n)
    some = np.log(-np.expm1(np.minimum(none, -1e-12))) - np.maximum(none, -30)
    rate = np.log1p(100 * expected / np.maximum(np.diff(ptr), 1))
    clip = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.log1p(expected), np.log(clip / (1 - clip)) / 5, np.clip(some, -15, 30) / 5, rate], axis=1)


def fit_field(lexicon: Lexicon, ids: np.ndarray, tags: np.ndarray, mask: np.ndarray, steps: int = 120, rate: float = 0.15, ridge: float = 1e-2) -> Field:
    """Fit on padded windows: ids (windows, length, kinds) into the lexicon, tags and mask (windows, length)."""
    size = len(lexicon.keys)
    theta = np.zeros(size + 1 + 1 + 4 + 2)
    theta[size + 1] = -2.0
    every, length = tags.shape
    turn = np.random.default_rng(8).permutation(every)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    all_ids, all_tags, all_mask = ids, tags, mask
    for t in range(1, max(steps, -(-every // BATCH)) + 1):
        if every > BATCH or t == 1:
            some = turn[np.arange((t - 1) * BATCH, (t - 1) * BATCH + min(BATCH, every)) % every]
            ids, tags, mask = all_ids[some], all_tags[some], all_mask[some]
            lens, n = mask.sum(axis=1), len(some)
        w = theta[: size + 1].copy()
        w[size] = 0.0
        trans, start = np.exp(theta[size + 2 : size + 6].reshape(2, 2)), np.exp(theta[size + 6 :])
        emit = np.ones((length, n, 2))
        emit[:, :, 1] = np.exp(np.clip(w[ids].sum(axis=2) + theta[size + 1], -30, 30)).T
        f, b = np.empty((length, n, 2)), np.empty((length, n, 2))
        cur = start * emit[0]
        f[0] = cur = cur / cur.sum(axis=1, keepdims=True)
        for i in range(1, length):
            cur = (cur @ trans) * emit[i]
            cur = cur / cur.sum(axis=1, keepdims=True)
            f[i] = cur
        cur = np.ones((n, 2))
        b[length - 1] = cur
        for i in range(length - 2, -1, -1):
            nxt = (cur * emit[i + 1]) @ trans.T
            cur = np.where((i + 1 < lens)[:, None], nxt / nxt.sum(axis=1, keepdims=True), 1.0)
            b[i] = cur
        post = f * b
        post /= post.sum(axis=2, keepdims=True)
        error = (post[:, :, 1].T - tags) * mask
        g = np.bincount(ids.ravel(), weights=np.repeat(error.ravel(), ids.shape[2]), minlength=len(theta))
        g[size] = 0.0
        g[size + 1] = error.sum()
        pair = f[:-1, :, :, None] * trans[None, None] * (emit[1:] * b[1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        live = mask[:, 1:].T
        expect = (pair * live[:, :, None, None]).sum(axis=(0, 1))
        code = (tags[:, :-1] * 2 + tags[:, 1:]).astype(int)
        g[size + 2 : size + 6] = expect.ravel() - np.bincount(code[mask[:, 1:]].ravel(), minlength=4)
        g[size + 6] = (post[0, :, 0] - (1 - tags[:, 0])).sum()
        g[size + 7] = (post[0, :, 1] - tags[:, 0]).sum()
        g = g / n + ridge * theta / 10
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w = theta[: size + 1].copy()
    w[size] = 0.0
    return Field(lexicon, w, float(theta[size + 1]), theta[size + 2 : size + 6].reshape(2, 2), theta[size + 6 :])


def _lexicon(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Telling features and their log odds, from document frequencies of the sample."""

    def count(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                _, _, ptr, feats = token_features(Texts(part.column("_text")))
                doc = owner(ptr)
                label = part.column("_label").to_numpy(zero_copy_only=False)
                pairs = np.unique(np.stack([np.tile(doc, KINDS).astype(np.uint64), feats.ravel()]), axis=1) if len(doc) else np.zeros((2, 0), np.uint64)
                keys, inverse = np.unique(pairs[1], return_inverse=True)
                toxic = np.bincount(inverse, weights=label[pairs[0].astype(int)], minlength=len(keys)).astype(np.int64)
                total = np.bincount(inverse, minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(toxic), pa.array(total - toxic)], names=["f", "t", "c"])

    sizes = {r["_label"]: r["n"] for r in sample.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    df = sample.select("_text", "_label").mapInArrow(count, "f bigint, t bigint, c bigint")
    odds = F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("c") + 0.5) / (good + 1))
    # log-likelihood ratio against equal shares: keeps out what is frequent by chance in small samples
    share = bad / max(bad + good, 1)
    part = lambda c, q: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("t") + F.col("c")) * F.lit(q)))).otherwise(0.0)
    ratio = 2 * (part("t", share) + part("c", 1 - share))
    chosen = (
        df.groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        .filter(F.col("t") >= 4).withColumn("odds", odds).filter("odds >= 1.2").filter(ratio >= EVIDENCE)
        .collect()
    )  # fmt: skip  # bounded by the words of the sample
    keys = np.array([r["f"] for r in chosen], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r["odds"] for r in chosen])[order]


def _windows(sample: DataFrame, lexicon: Lexicon, telling: np.ndarray):
    """Training sequences: windows around lexicon hits, tagged by telling features and the document's label."""
    size = len(lexicon.keys)
    strong = np.append(telling, False)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                _, _, ptr, feats = token_features(Texts(part.column("_text")))
                ids = lexicon.find(feats).T
                toxic = np.repeat(part.column("_label").to_numpy(zero_copy_only=False), np.diff(ptr))
                tag = (strong[ids].any(axis=1) & (toxic > 0)).astype(np.int8)
                hit = np.flatnonzero((ids < size).any(axis=1))
                first, last = np.repeat(ptr[:-1], np.diff(ptr)), np.repeat(ptr[1:], np.diff(ptr))
                done, rows = -1, []
                for h in hit.tolist():
                    if h <= done:
                        continue
                    a, b = max(int(first[h]), h - NEAR), min(int(last[h]), h - NEAR + LENGTH)
                    done = b - NEAR - 1 if b < last[h] else b - 1
                    rows.append((ids[a:b].astype("<i4").tobytes(), tag[a:b].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.binary()) for c in range(2)], names=["ids", "tags"])

    path = scratch_path(sample.sparkSession, "crf-windows")
    sample.select("_text", "_label").mapInArrow(run, "ids binary, tags binary").write.parquet(path)
    table = sample.sparkSession.read.parquet(path).toArrow()  # bounded by the sample
    tags, mask = np.zeros((table.num_rows, LENGTH), np.float32), np.zeros((table.num_rows, LENGTH), bool)
    ids = np.full((table.num_rows, LENGTH, KINDS), size, np.int32)
    for i, (a, b) in enumerate(zip(table.column("ids").to_pylist(), table.column("tags").to_pylist())):
        tags[i, : len(b)], mask[i, : len(b)] = np.frombuffer(b, np.int8), True
        ids[i, : len(b)] = np.frombuffer(a, "<i4").reshape(-1, KINDS)
    return ids, tags, mask


def _document_map(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights (and shift) of the document features; monotone, with a small ridge."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x1.shape[1])
    for _ in range(60):
        q = 1.0 / (1.0 + np.exp(-np.clip(x1 @ w, -40, 40)))
        ridge = np.append(np.full(x.shape[1], 0.5), 1e-3)
        hess = (x1 * np.maximum(q * (1 - q), 1e-9)[:, None]).T @ x1 + np.diag(ridge)
        step = np.linalg.solve(hess, x1.T @ (q - y) + ridge * w)
        w = w - step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return w


def _tag(texts: Texts, model: Field):
    start, end, ptr, feats = token_features(texts)
    p = marginals(model.potentials(feats), ptr, model.trans, model.start)
    return start, end, ptr, p


def fit(docs: DataFrame, train: DataFrame, key: str = "doc_id", text: str = "text", bound: int = BOUND) -> Field | None:
    """Fit lexicon, field and document map on about ``bound`` labelled documents.

    The ids of the sample are broadcast (their number is bounded), so texts are not shuffled.
    """
    spark = docs.sparkSession
    ids = F.broadcast(thinned(train, "_key", bound, "crf"))
    path = scratch_path(spark, "crf-sample")
    docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(ids, "_key").write.parquet(path)
    sample = spark.read.parquet(path)
    keys, odds = _lexicon(sample)
    if len(keys) == 0:
        return None
    found = Lexicon(keys)
    sequences = _windows(sample, found, odds >= 1.5)
    if not len(sequences[0]):
        return None
    model = fit_field(found, *sequences)

    def summarise(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                _, _, ptr, p = _tag(Texts(part.column("_text")), model)
                x = summaries(p, ptr)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("_label"), lists], names=["_label", "x"])

    table = sample.select("_label", "_text").mapInArrow(summarise, "_label int, x array<double>").toArrow()
    y = table.column("_label").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return None
    model.doc = _document_map(table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, 4), y)
    return model


def tag(docs: DataFrame, model: Field | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, n_tokens, expected_toxic, spans) of every document.

    A span has the byte offsets (UTF-8, end exclusive) of adjacent tokens of marginal >= 0.5 and the
    surest marginal.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                t = Texts(part.column(text))
                if model is None:
                    zero, empty = np.zeros(t.n), pa.array([[]] * t.n, spans)
                    yield pa.RecordBatch.from_arrays([part.column(key), pa.array(zero), pa.array(zero.astype(np.int64)), pa.array(zero), empty], names=names)
                    continue
                start, end, ptr, p = _tag(t, model)
                hit = np.flatnonzero(p >= 0.5)
                doc = owner(ptr)[hit]
                new = np.ones(len(hit), bool)
                new[1:] = (hit[1:] != hit[:-1] + 1) | (doc[1:] != doc[:-1])
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(hit))[: len(head)] - 1  # none where nothing is toxic
                base = t.offs[doc[head]]
                cells = pa.StructArray.from_arrays(
                    [pa.array(start[hit[head]] - base), pa.array(end[hit[tail]] - base), pa.array(np.maximum.reduceat(p[hit], head) if len(head) else np.zeros(0))], fields=list(spans.value_type)
                )
                offs = np.zeros(t.n + 1, np.int32)
                np.cumsum(np.bincount(doc[head], minlength=t.n), out=offs[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key),
                        pa.array(model.score(summaries(p, ptr))),
                        pa.array(np.diff(ptr).astype(np.int64)),
                        pa.array(np.bincount(owner(ptr), weights=p, minlength=t.n)),
                        pa.ListArray.from_arrays(pa.array(offs), cells),
                    ],
                    names=names,
                )

    names = [key, "score", "n_tokens", "expected_toxic", "spans"]
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
    kind = dict(docs.select(key).dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double, n_tokens bigint, expected_toxic double, spans array<struct<start: bigint, end: bigint, p: double>>")


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = BOUND, threshold: float = 0.5) -> DataFrame:
    """Fit on labelled documents outside the held-out fold, then tag and score every document."""
    model = fit(docs, train_labels(labels, key, label, FOLDS, HELD_OUT), key, text, bound)
    out = tag(docs, model, key, text)
    return out.select(
        key,
        held_out(key, FOLDS, HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "expected_toxic",
        "spans",
    )
