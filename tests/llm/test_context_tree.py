"""Context-tree scores: a plain recursive version, base scores, layout independence, held-out code length, odd tables."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from clickloom.llm import context_tree as ct
from clickloom.llm.cells import Texts
from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 7 == 2


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Plain:
    """One tree of counts for each run of bits, weighted from the leaves up for every question."""

    def __init__(self, depth):
        self.depth, self.trees = depth, collections.defaultdict(lambda: collections.defaultdict(lambda: [0, 0]))

    def steps(self, text):
        data = bytes([255] * self.depth) + lowered(text).encode() + b"\xff"
        for i in range(self.depth, len(data)):
            bits = f"{data[i]:08b}"
            for k in range(8):
                yield self.trees[bits[:k]], data[i - self.depth : i][::-1], int(bits[k])

    def learn(self, text):
        for tree, context, bit in self.steps(text):
            self.add(tree, context, bit, 1)

    def add(self, tree, context, bit, n):
        for d in range(self.depth + 1):
            tree[context[:d]][bit] += n

    def weight(self, tree, node):
        own = kt(*tree[node])
        if len(node) == self.depth:
            return own
        below = sum(self.weight(tree, c) for c in list(tree) if len(c) == len(node) + 1 and c[: len(node)] == node)
        return np.logaddexp(own, below) - math.log(2)

    def score(self, text):
        total = 0.0
        for tree, context, bit in self.steps(text):
            before = self.weight(tree, b"")
            self.add(tree, context, bit, 1)
            total += self.weight(tree, b"") - before
            self.add(tree, context, bit, -1)
        return total / math.log(10)


def base(rows):
    tokens = lambda x: [*WORD.findall(lowered(x)), None]
    counts = collections.Counter(t for k, x in rows if not held(k) for t in tokens(x))
    n = sum(counts.values())
    out = []
    for k, x in rows:
        own = tokens(x)
        out.append((len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10((counts[t] + 1) / (n + len(counts) + 1)) for t in own)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


ROWS = [(i, t) for i, t in enumerate(["Abba abc", "", None, "abc ab\tabé", "ABBA", "xyz a", "abba abc", "  ", "a"])] + [(None, "abc"), (3, "abc ab\tabé"), (1, "q")]


@pytest.mark.parametrize("depth", [3, 4])
def test_against_plain_trees(spark, depth):
    out = ct.score(frame(spark, ROWS).repartition(3).selectExpr("*", "1 AS score", "2 AS block", "'x' AS _k"), depth=depth).collect()
    plain = Plain(depth)
    for k, x in ROWS:
        if not held(k):
            plain.learn(x)
    want = sorted((str(k), held(k), *b, plain.score(x)) for (k, x), b in zip(ROWS, base(ROWS)))
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out)
    assert any(held(k) for k, _ in ROWS)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_layout_changes_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    read = lambda df: {r["doc_id"]: (r["score"], r["base_score"], r["n_known"]) for r in df.collect()}
    want = read(ct.score(docs))
    monkeypatch.setattr(ct, "BLOCK", 20_000)
    monkeypatch.setattr(ct, "PART", 7_001)
    monkeypatch.setattr(ct, "WORD_PART", 5_000)
    got = read(ct.score(docs.repartition(6), buckets=3))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_all_distributions_sum_to_one():
    rnd = random.Random(2)
    texts = Texts(pa.array(["".join(rnd.choice("ab c") for _ in range(200))]))
    keys, n = ct.counted(next(ct.Symbols(texts, 3).parts())[0], np.ones(201, bool))
    full = np.unique(np.concatenate([(keys >> np.uint64(8) << np.uint64(8)) | np.uint64(b) for b in range(256)]))
    counts = np.zeros(len(full), np.int64)
    counts[np.searchsorted(full, keys)] = n
    nodes = np.unique(np.concatenate([ct._node(ct.grown(full, counts, 3, bit)[1].ids, bit) for bit in range(8)]))
    logs = ct.log_probabilities(full, counts, 3, nodes, np.full(len(nodes), 0.2), np.full(len(nodes), 0.6))
    assert np.allclose(np.bincount(np.searchsorted(np.unique(full >> np.uint64(8)), full >> np.uint64(8)), weights=10**logs), 1)


def test_packing_and_merging():
    rnd = np.random.default_rng(1)
    keys = np.unique(rnd.integers(0, 1 << 62, 1000).astype(np.uint64))
    assert (ct.unpack(ct.pack(keys, True), rising=True) == keys).all()
    assert (ct.unpack(ct.pack(keys[::-1])) == keys[::-1]).all()
    assert len(ct.unpack(ct.pack(keys[:0], True), rising=True)) == 0
    k, n = ct.merged([(keys[:600], np.ones(600, np.int64)), (keys[400:], np.full(len(keys) - 400, 2))])
    assert (k == keys).all() and n.tolist() == [1] * 400 + [3] * 200 + [2] * (len(keys) - 600)
    big = np.array([0, 5, ct._TABLE - 1, ct._TABLE, 10**7])
    assert np.allclose(ct._log_kt(big, big[::-1]), [kt(a, b) for a, b in zip(big.tolist(), big[::-1].tolist())], rtol=1e-10)


def test_held_out_code_length(spark):
    out = ct.score(spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")).toPandas()
    test = out[out.held_out & (out.n_bytes > 500)]
    assert len(out) == 1000 and (out.score < 0).all() and (out.base_score < 0).all()
    assert np.average(test.bits_per_byte, weights=test.n_bytes) < 2.3
    assert out.score.sum() > out.base_score.sum() and test.score.sum() > 1.05 * test.base_score.sum()  # logarithms: the base knows the word borders


def test_no_training_texts_and_empty_tables(spark):
    key = next(k for k in range(100) if held(k))
    r = ct.score(frame(spark, [(key, "ab c")])).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)
    assert r["score"] == pytest.approx(-5 * 8 * math.log10(2)) and r["bits_per_byte"] == pytest.approx(8)
    assert ct.score(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        ct.score(frame(spark, []), depth=7)
