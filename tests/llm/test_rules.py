"""Adaptive rules: counts and verdicts against plain Python."""

import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clickloom.llm import adaptive_rules as rules


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = list(zip(words, words[1:], words[2:]))
    covered = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
    }


CASES = [
    None, "", "   \n\t", "one", "a b a b a b", "x y z\nx y z\n\nx y z ", "é ü # ß|\r\nq <b>", "a\n\na\n \na", "w " * 500, "long" * 40_000,
]


def test_counts(table):
    found = rules.text_counts(table(list(enumerate(CASES))), ["doc_id"]).collect()
    for row in found:
        want = plain_counts(CASES[row["doc_id"]])
        assert {k: row[k] for k in want} == want


def test_buckets_are_exact_and_invertible(spark):
    values = [0, 1, 15, 16, 31, 32, 33, 63, 64, 1000, 123_456_789, (1 << 40) + 12345]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").withColumn("b", F.expr(rules.bucket("v"))).withColumn("f", F.expr(rules.bucket_floor("b")))
    for v, b, f in df.collect():
        shift = max(0, v.bit_length() - 5)
        assert f == (v >> shift) << shift
        assert v - f <= max(0, v // 16)
    order = [r["b"] for r in df.orderBy("v").collect()]
    assert order == sorted(order)


def plain_limits(rows):
    """Quartile fences of one group from its values, cut to the sketch's accuracy."""
    out = {}
    for rate, (spread, _) in rules.RATES.items():
        shifts = [max(0, v.bit_length() - 5) for v in (r[rate] for r in rows)]
        values = sorted((r[rate] >> s) << s for r, s in zip(rows, shifts))
        q = lambda k: values[math.ceil(k * len(values) / 4) - 1]
        width = rules.REACH * max(q(3) - q(1), spread)
        out[rate] = (q(1) - width, q(3) + width)
    return out


@pytest.fixture
def mixed(table):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(300):
        group = [("en", "a"), ("en", "b"), (None, "a"), ("de", None)][i % 4]
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(40, 120)))
        if i % 11 == 0:
            text = text.replace(" ", "### ")
        rows.append((i, text, *group))
    rows += [(1000, None, "en", "a"), (1001, "", "xx", "only"), (None, "w " * 60, "en", "a"), (5, rows[5][1], "en", "b")]
    return table(rows)


def test_verdicts(mixed):
    found = [r.asDict() for r in rules.judge(mixed, min_group=50).collect()]
    assert len(found) == mixed.count()
    ok = [r for r in found if not r["base_failed"]]
    for r in found:
        own = [x for x in ok if (x["lang"], x["source"]) == (r["lang"], r["source"])]
        if len(own) < 50:
            own = [x for x in ok if x["lang"] == r["lang"]]
        if len(own) < 50:
            own = ok
        fences = plain_limits(own)
        want = not r["base_failed"]
        for rate, (_, side) in rules.RATES.items():
            lo, hi = fences[rate]
            want = want and r[rate] <= hi and (side == "high" or r[rate] >= lo)
        assert r["kept"] == want, r
    assert not any(r["kept"] for r in found if r["symbols"] > 500)
    assert sum(r["kept"] for r in found) > 200


def test_keep_has_all_columns_and_the_same_verdicts(mixed):
    clash = mixed.withColumns({"n_words": F.lit("x"), "kept": F.lit(1), "_key": F.lit(2.0), "symbols": F.lit(None).cast("int")})
    kept = rules.keep(clash, min_group=50)
    assert kept.columns == clash.columns
    want = rules.judge(mixed, min_group=50).filter("kept").select("doc_id").collect()
    assert sorted(map(str, kept.select("doc_id").collect())) == sorted(map(str, want))


def test_skewed_join_gives_the_same(mixed, monkeypatch):
    want = sorted(map(str, rules.judge(mixed, min_group=50).select("doc_id", "kept").collect()))
    monkeypatch.setattr(rules, "broadcast_if_small", lambda df, n: df)
    assert sorted(map(str, rules.judge(mixed, min_group=50).select("doc_id", "kept").collect())) == want


def test_empty_table(table):
    empty = table([(1, "x")]).limit(0)
    assert rules.judge(empty).count() == 0
    assert rules.keep(empty).count() == 0


def test_texts_go_to_the_workers_once(spark, monkeypatch):
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, words + f" {i}", "en", "web") for i in range(30)] + [(99, None, None, "web")], "doc_id long, text string, lang string, source string")
    kept = rules.keep(docs)
    inputs = re.search(r"MapInArrow run\(([^)]*)\)", kept._jdf.queryExecution().executedPlan().toString()).group(1)
    assert "_row#" in inputs and "text" not in inputs
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(30)) and kept.columns == docs.columns
    sizes = []
    monkeypatch.setattr(rules, "counts_of", lambda t: sizes.append(len(t.raw)))
    big = pa.record_batch({"text": pa.array(["a" * 300_000] * 10)})
    for part in rules.slices(big, "text", rules.COUNT_BYTES):
        rules.counts_of(rules.Texts(part.column("text")))
    assert max(sizes) <= 1 << 20 and sum(sizes) == 3_000_000
