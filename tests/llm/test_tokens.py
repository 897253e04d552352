"""Encoders, id files and section counts against the tokenizers library."""

import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clickloom.llm import bpe_verify, elias_fano, section_tokens
from clickloom.llm.cells import Texts
from clickloom.llm.pieces import PieceEncoder
from clickloom.session import scratch_path
from tests.conftest import SMALL

WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
PARTS = [
    "a", "th", "the", "ing", "'s", "'LL", "don't", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "é", "É", "Σ", "AΣ",
    "İ", "ß", "1", "23", "½", "Ⅷ", "<|endoftext|>", "<|startoftext|>", "<|", "!", "...", "###", "中文", "\U0001f600", "‍",
    "ABC", "_", " ", "　", "\x00", "zzzz", "x" * 40,
]
TEXT = st.lists(st.sampled_from(PARTS), max_size=20).map("".join)


@pytest.fixture(scope="module")
def words():
    with open(WORD, encoding="utf-8") as f:
        return bpe_verify.Encoder(f.read(), memo=50)


@pytest.fixture(scope="module")
def pieces():
    with open(BYTE, encoding="utf-8") as f:
        return PieceEncoder(f.read(), memo=40)


WORD_LIB, BYTE_LIB = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)


@settings(max_examples=1500, deadline=None)
@given(TEXT)
def test_word_encoder(words, text):
    (ids,), (shown,) = words.encode([text])
    want = WORD_LIB.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert shown == WORD_LIB.decode(want, skip_special_tokens=False) == words.decode(want)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_slices_of_texts(words, pieces, some):
    texts = Texts(pa.array(some, pa.string()))
    (ids, count), (shown, size) = words.encode_slice(texts)
    flat, sizes = pieces.encode_slice(texts)
    at = lambda data, n, i: data[n[:i].sum() : n[: i + 1].sum()]
    for i, t in enumerate(some):
        want = WORD_LIB.encode(t or "", add_special_tokens=False).ids
        assert at(ids, count, i).tolist() == want
        assert at(shown, size, i).tobytes().decode() == WORD_LIB.decode(want, skip_special_tokens=False)
        assert at(flat, sizes, i).tolist() == BYTE_LIB.encode(t or "", add_special_tokens=False).ids


def test_run_memo_is_bounded_and_exact():
    with open(WORD, encoding="utf-8") as f, open(BYTE, encoding="utf-8") as g:
        words, pieces = bpe_verify.Encoder(f.read()), PieceEncoder(g.read())
    words.runs.budget = pieces.runs.budget = 30_000
    for seed in range(6):
        docs = [*(" ".join(unspaced(50, 20, 10 * seed + i)) for i in range(6)), *unspaced(4, 900, seed), "", "two  blanks"]
        texts = Texts(pa.array(docs))
        want = [e.ids for e in WORD_LIB.encode_batch(docs, add_special_tokens=False)]
        assert words.encode_slice(texts)[0][0].tolist() == sum(want, [])
        assert pieces.encode_slice(texts)[0].tolist() == sum([e.ids for e in BYTE_LIB.encode_batch(docs, add_special_tokens=False)], [])
        assert words.runs.held < 200_000 and pieces.runs.held < 200_000  # the budget and what one slice brings


def test_speculation_and_exact_merging_agree(words):
    rnd = random.Random(4)
    found = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    ids, failed = words.encode_words(found)
    assert 0 < failed < len(found)
    assert ids == [words.merge(w) for w in found]
    assert words.merge_together(found) == ids


def test_compatible_pairs_are_those_that_stay_apart(words):
    rnd = random.Random(6)
    whole = [t for t in words.greedy if t.endswith("</w>")]
    heads = [t for t in words.greedy if not t.endswith("</w>")]
    a, b = [rnd.choice(heads) for _ in range(3000)], [rnd.choice(whole) for _ in range(3000)]
    got = words.compatible(np.array([words.ids[x] for x in a]), np.array([words.ids[x] for x in b]))
    want = [words.merge(x + y[:-4]) == [words.ids[x], words.ids[y]] for x, y in zip(a, b)]
    assert got.tolist() == want


@settings(max_examples=1500, deadline=None)
@given(TEXT)
def test_piece_encoder(pieces, text):
    (ids,) = pieces.encode([text])
    assert np.frombuffer(ids, pieces.kind).tolist() == BYTE_LIB.encode(text, add_special_tokens=False).ids


def test_long_and_missing_texts(words, pieces):
    long = "word " * 40_000 + "y" * 20_000
    assert words.encode([None, ""]) == ([b"", b""], ["", ""])
    assert pieces.encode([None, ""]) == [b"", b""]
    assert np.frombuffer(words.encode([long])[0][0], "<u4").tolist() == WORD_LIB.encode(long, add_special_tokens=False).ids
    assert np.frombuffer(pieces.encode([long])[0], "<u2").tolist() == BYTE_LIB.encode(long, add_special_tokens=False).ids


def memo_size(*memos):
    return sum(sys.getsizeof(k) + (sys.getsizeof(v) if isinstance(v, (bytes, str)) else sum(map(sys.getsizeof, v))) for m in memos for k, v in m.items())


def unspaced(n, size, seed=0):
    """Long documents without white space: one sentence of distinct characters or one base64-like run each."""
    rnd = random.Random(seed)
    han, base = [chr(c) for c in range(0x4E00, 0x9000)], "abcdefghijklmnopqrstuvwxyz0123456789+/"
    return ["".join(rnd.choices(base if i % 2 else han, k=size)) for i in range(n)]


def test_memos_are_bounded_in_bytes_on_unspaced_texts():
    with open(WORD, encoding="utf-8") as f, open(BYTE, encoding="utf-8") as g:
        words, pieces = bpe_verify.Encoder(f.read()), PieceEncoder(g.read())
    for seed in range(4):
        docs = unspaced(100, 1000, seed)
        assert [np.frombuffer(b, "<u4").tolist() for b in words.encode(docs)[0]] == [e.ids for e in WORD_LIB.encode_batch(docs, add_special_tokens=False)]
        assert [np.frombuffer(b, pieces.kind).tolist() for b in pieces.encode(docs)] == [e.ids for e in BYTE_LIB.encode_batch(docs, add_special_tokens=False)]
    assert memo_size(pieces.memos[" "], pieces.memos[""], pieces.olds[" "], pieces.olds[""]) < 100_000
    assert memo_size(words.known, words.shown, words.old_known, words.old_shown) < 100_000
    assert max(map(len, [*words.word_ids, *words.known, *pieces.memos[""]]), default=0) <= 64


def test_generations_turn_by_bytes():
    budget = 100_000
    with open(WORD, encoding="utf-8") as f, open(BYTE, encoding="utf-8") as g:
        words, pieces = bpe_verify.Encoder(f.read(), memo_bytes=budget), PieceEncoder(g.read(), memo_bytes=budget)
    for seed in range(8):
        docs = [" ".join(unspaced(50, 20, 10 * seed + i)) for i in range(8)]
        assert [np.frombuffer(b, "<u4").tolist() for b in words.encode(docs)[0]] == [e.ids for e in WORD_LIB.encode_batch(docs, add_special_tokens=False)]
        assert [np.frombuffer(b, pieces.kind).tolist() for b in pieces.encode(docs)] == [e.ids for e in BYTE_LIB.encode_batch(docs, add_special_tokens=False)]
        assert memo_size(pieces.memos[" "], pieces.memos[""]) <= 2 * budget
        assert memo_size(words.known, words.shown) <= budget and memo_size(words.word_ids) <= budget
        assert memo_size(words.old_known, words.old_shown) <= 2 * budget


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 1 << 34), max_size=200))
def test_elias_fano(values):
    values = np.sort(np.array(values, np.uint64))
    coded = elias_fano.EliasFano(*elias_fano.EliasFano.of(values).parts())
    assert coded.all().tolist() == values.tolist()
    assert [coded.select(i) for i in range(len(values))] == values.tolist()
    with pytest.raises(IndexError):
        coded.select(len(values))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 10_000))
    n, bits, low, high, samples = elias_fano.EliasFano.of(ends).parts()
    assert 8 * (len(low) + len(high) + len(samples)) < n * (2 + np.log2(ends[-1] / n) + 1.5)


ROWS = [(5, "five words are in here"), (3, None), (None, "no key"), (3, "a"), (9, ""), (-4, "minus"), (5, "five words are in here"), (1 << 40, "far\nline two \n\n"), (None, "no key")]


@pytest.mark.parametrize("segment_ids", [4, 1 << 20])
def test_id_files(spark, table, segment_ids):
    path = scratch_path(spark, "ids")
    elias_fano.write(table(ROWS).selectExpr("*", "1 AS ids", "2 AS part"), path, BYTE, segment_ids=segment_ids)
    found = elias_fano.read(spark, path).orderBy("row").collect()
    assert [r["row"] for r in found] == list(range(len(ROWS)))
    keys = [r["key"] for r in found]
    assert keys == [None, None, -4, 3, 3, 5, 5, 9, 1 << 40]
    assert [r["start"] for r in found] == np.concatenate([[0], np.cumsum([r["n_ids"] for r in found])[:-1]]).tolist()
    got = sorted((str(r["key"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in found)
    assert got == sorted((str(k), BYTE_LIB.encode(t or "", add_special_tokens=False).ids + [0]) for k, t in ROWS)


def test_id_files_of_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    path = scratch_path(spark, "ids")
    elias_fano.write(docs, path, BYTE)
    got = elias_fano.read(spark, path).select("key", "start", F.crc32("ids").alias("c")).orderBy("key").collect()
    start = 0
    for row, doc in zip(got, docs.orderBy("doc_id").collect(), strict=True):
        ids = np.array([*BYTE_LIB.encode(doc["text"], add_special_tokens=False).ids, 0], "<u4")
        assert tuple(row) == (doc["doc_id"], start, zlib.crc32(ids.tobytes()))
        start += len(ids)
    empty = scratch_path(spark, "ids")
    elias_fano.write(docs.limit(0), empty, BYTE)
    assert elias_fano.read(spark, empty).count() == 0


def test_word_encoding_as_a_query(table):
    out = bpe_verify.encode(table(ROWS).selectExpr("*", "1 AS ids", "2 AS n_tokens"), WORD, keep=["lang"]).collect()
    got = sorted((str(r["doc_id"]), r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in out)
    want = []
    for k, t in ROWS:
        ids = WORD_LIB.encode(t or "", add_special_tokens=False).ids
        want.append((str(k), len(ids), ids, WORD_LIB.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_allocation_rule():
    ends = np.array([2, 7, 9, 12])  # tokens [0,2) [2,7) [7,9) [9,12)
    section, cross = section_tokens.allocate(ends, np.array([0, 3, 8, 9]))
    # [2,7) has 1 byte in section 0 and 4 in 1; [7,9) has one byte in 1 and one in 2: the first wins
    assert section.tolist() == [0, 1, 1, 3] and cross.tolist() == [False, True, True, False]
    section, _ = section_tokens.allocate(np.array([9]), np.array([0, 1, 2, 6]))
    assert section.tolist() == [2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=12), st.sets(st.integers(1, 40), max_size=6))
def test_allocation_against_bytes(sizes, cuts):
    ends = np.cumsum(sizes).astype(np.int64)
    total = int(ends[-1]) if sizes else 0
    starts = np.array([0, *sorted(c for c in cuts if c < total)])
    section, _ = section_tokens.allocate(ends, starts)
    begin = 0
    for end, got in zip(ends.tolist(), section.tolist()):
        held = [sum(1 for x in range(begin, end) if np.searchsorted(starts, x, "right") - 1 == s) for s in range(len(starts))]
        assert got == held.index(max(held))
        begin = end


@pytest.mark.parametrize("split", ["line", "paragraph"])
def test_sections(table, split):
    rows = [(1, "one\ntwo words\n\nthree é\n"), (2, None), (3, ""), (None, "\n\n\nx"), (4, "a <|endoftext|> b\nc"), (1, "one\ntwo words\n\nthree é\n")]
    for r in section_tokens.attribute(table(rows).selectExpr("*", "1 AS sections"), BYTE, split=split).collect():
        text = next(t for k, t in rows if k == r["doc_id"]) or ""
        raw, cells = text.encode(), r["sections"]
        assert r["n_tokens"] == len(BYTE_LIB.encode(text, add_special_tokens=False).ids) == sum(c["tokens"] for c in cells)
        assert [raw[c["start"] : c["end"]] for c in cells] == ([x for x in raw.splitlines(True)] or [b""] if split == "line" else [raw[c["start"] : c["end"]] for c in cells])
        assert b"".join(raw[c["start"] : c["end"]] for c in cells) == raw and r["n_sections"] == len(cells)


def test_paragraphs():
    raw = Texts(pa.array(["a\nb\n\n\nc\n\n"])).raw
    assert section_tokens.paragraph_starts(raw).tolist() == [0, 6]
