"""Greedy string tiling against the plain algorithm, and leaks of reordered passages."""

import random

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from clickloom.llm import string_tiling as gst


def plain_tiles(doc, item, k):
    """Longest unmarked common run first; ties by place in the document, then in the item."""
    used_d, used_i, out = set(), set(), []
    while True:
        best = None
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in used_d and j + n not in used_i:
                    n += 1
                if n >= k and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        i, j, n = best
        used_d.update(range(i, i + n))
        used_i.update(range(j, j + n))
        out.append(best)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=14), st.integers(2, 4))
def test_tiles(doc, item, k):
    d, t = np.array(doc, np.uint64), np.array(item, np.uint64)
    pairs = [(i, j) for i in range(len(doc) - k + 1) for j in range(len(item) - k + 1) if doc[i : i + k] == item[j : j + k]]
    want = plain_tiles(doc, item, k)
    if not pairs:
        assert want == []
        return
    at, to = (np.array(x) for x in zip(*pairs))
    assert gst.tiles_of(d, t, at, to, k) == want


WORDS = [f"word{i}" for i in range(300)]
ITEM = " ".join(WORDS[:30])


def _bench(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_leaks(spark, table):
    rnd = random.Random(1)
    fill = lambda n: " ".join(rnd.choice(WORDS[100:]) for _ in range(n))
    swapped = " ".join(WORDS[15:30]) + " filler " + " ".join(WORDS[:15])
    rows = [
        (1, f"{fill(50)} {ITEM} {fill(20)}"),
        (2, f"{fill(10)} {swapped}"),
        (3, ITEM.upper().replace(" ", ", ")),
        (4, fill(400)),
        (5, " ".join(WORDS[:8]) + " " + fill(30)),  # 8 of 30 tokens
        (6, None), (7, ""), (None, ITEM), (3, ITEM),
        (8, " ".join(x for pair in zip(WORDS[:30], ["x"] * 30) for x in pair)),  # every second word
    ]
    bench = _bench(spark, [(10, ITEM), (11, None), (12, "too short item"), (13, ""), (14, ITEM)])
    docs = table(rows).selectExpr("*", "1 AS item_id", "'x' AS tiles", "0 AS coverage")
    found = [r for r in gst.leaks(docs, bench).collect() if r["item_id"] == 10]
    assert sorted(map(str, (r["doc_id"] for r in found))) == sorted(map(str, [1, 2, 3, 3, None]))
    two = next(r for r in found if r["doc_id"] == 2)
    assert two["coverage"] == 1.0 and two["n_tiles"] == 2 and two["longest"] == 15
    assert gst.leaks(docs, bench).count() == 10  # item 14 is the same text
    clean = gst.clean(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [4, 5, 6, 7, 8]
    many = gst.leaks(docs, bench, slice_bytes=50).select("doc_id", "item_id").collect()
    assert sorted(map(str, many)) == sorted(map(str, gst.leaks(docs, bench).select("doc_id", "item_id").collect()))


def test_capitals_beyond_ascii(spark, table):
    item = "été öl ñandú àéî über straße çédille øre þing ýtre"
    bench = _bench(spark, [(1, item)])
    assert gst.leaks(table([(1, item.upper().replace("STRASSE", "straße"))]), bench).first()["coverage"] == 1.0


def test_repeated_words_and_empty_tables(spark, table):
    bench = _bench(spark, [(1, "la " * 20)])
    docs = table([(1, "la " * 3000), (2, "la la la")])
    assert [r["doc_id"] for r in gst.leaks(docs, bench).collect()] == [1]
    assert gst.leaks(docs, bench.limit(0)).count() == 0
    assert gst.clean(docs, bench.limit(0)).count() == 2
    assert gst.leaks(docs.limit(0), bench).count() == 0


def test_other_key_types(spark):
    docs = spark.createDataFrame([("d1", ITEM)], "name string, body string")
    bench = spark.createDataFrame([("i1", ITEM)], "item string, words string")
    row = gst.leaks(docs, bench, "name", "body", "item", "words").withColumn("c", F.lit(1)).first()
    assert (row["name"], row["item"]) == ("d1", "i1")
