"""Byte-balanced contiguous shards against plain prefix sums."""

import random
import zlib

import pytest

from clickloom.llm import byte_shards


def plain(rows, shards):
    sizes = [(k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows]
    ordered = sorted(sizes, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    total, start, out, slots = sum(r[1] for r in sizes), 0, [], {}
    for k, size, crc in ordered:
        shard = (2 * start + size) * shards // (2 * total)
        out.append((k, size, crc, start, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        start += size
    return out


@pytest.mark.parametrize("shards", [1, 8, 50])
def test_shards(table, shards):
    rnd = random.Random(shards)
    rows = [(rnd.randint(0, 400), "é" * rnd.randint(0, 60)) for _ in range(300)] + [(None, "x"), (None, None), (3, ""), (7, "long " * 4000), (7, "long " * 4000)]
    docs = table(rows).selectExpr("*", "1 AS size", "2 AS shard", "3 AS _part")
    got = [tuple(r) for r in byte_shards.assign(docs, shards).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows, shards)))


def test_balance(table):
    rows = [(i, "w" * (i % 97)) for i in range(2000)]
    out = byte_shards.assign(table(rows)).groupBy("shard").sum("size").collect()
    sizes = [r["sum(size)"] for r in out]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2 * 98


def test_no_python_in_the_plan(table):
    plan = byte_shards.assign(table([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(table):
    assert byte_shards.assign(table([(1, "a")]).limit(0)).count() == 0
