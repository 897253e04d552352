"""Conversation repair: cheapest edits against an exhaustive search, chunks of any size, damage, odd rows."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from clickloom.llm import turn_repair as tr
from tests.conftest import SMALL

VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
COLS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        visible = VISIBLE.findall(text)
        out.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, turns) by trying every edit at every place; states are the letters so far that matter."""
    fault = faults(rows)

    def step(state, letter):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, letter))

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if inserted < 3:
            for role in ("user", "assistant"):
                if to := step(state, role[0]):
                    found.append(add(2, "I", ((role, ""),), best(i, to, inserted + 1)))
        if i < len(rows):
            role, text = rows[i]
            cut = int(fault[i] == "truncated")
            found.append(add(3, "D", (), best(i + 1, state, 0)))
            if fault[i] not in ("blank", "duplicate"):
                if to := step(state, role[:1]):
                    found.append(add(cut, "K", ((role, text),), best(i + 1, to, 0)))
                for new in ("user", "assistant"):
                    if to := step(state, new[0]):
                        found.append(add(2 + cut, "R", ((new, text),), best(i + 1, to, 0)))
        return min((f for f in found if f), default=None)

    def add(cost, letter, turns, rest):
        return rest and (cost + rest[0], letter + rest[1], turns + rest[2])

    return best(0, "", 0)


def expected(rows):
    """rows of one conversation: (turn, role, text) in order."""
    fault = faults([r[1:] for r in rows])
    cost, audit, turns = cheapest(tuple(r[1:] for r in rows))
    known = [t for t, *_ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    letters = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in turns).encode()).hexdigest()
    return (gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def ordered(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=key)


def by_conv(rows):
    out = {}
    for c, *rest in rows:
        out.setdefault(c, []).append(tuple(rest))
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def random_rows(seed, convs, most):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(convs), None]:
        for _ in range(rnd.randint(1, most)):
            turn = rnd.choice([None, *range(most)])
            text = rnd.choice(["Yes.", "no", "Why? ", " \t", "", None, "é!", f"long {rnd.random()}."])
            rows.append((c, turn, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
    return rows


@pytest.mark.parametrize("limit", [1, 3, tr.CHUNK])
def test_repair_against_search(spark, limit):
    rows = random_rows(limit, 30, 9)
    pieces = tr.repair(spark.createDataFrame(rows, SCHEMA).repartition(5), limit=limit)
    got = {r["conv_id"]: tuple(r)[1:] for r in tr.digest(pieces).select(COLS).collect()}
    assert got == {c: expected(ordered(group)) for c, group in by_conv(rows).items()}


def test_one_long_conversation_over_many_chunks(spark):
    rnd = random.Random(5)
    roles = [rnd.choice(["user", "assistant"]) if rnd.random() < 0.2 else ("user", "assistant")[i % 2] for i in range(120)]
    rows = [(1, i, r, f"text {i}" + rnd.choice(["", ".", "."])) for i, r in enumerate(roles)] + [(2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, SCHEMA)
    pieces = tr.repair(df, limit=7)
    want = expected(ordered([r[1:] for r in rows if r[0] == 1]))
    got = {r["conv_id"]: tuple(r)[1:] for r in tr.digest(pieces).select(COLS).collect()}
    assert got[1] == want and got[2][5:7] == (2, "KI")
    lines = [(r["role"], r["text"]) for r in tr.turns(pieces).filter("conv_id = 1").orderBy("piece", "place").collect()]
    assert hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest() == want[-1]
    assert re.fullmatch("s?(ua)+", "".join(r[0] for r, _ in lines))


def test_rerun_stops_with_the_right_vector():
    rnd = random.Random(6)
    for _ in range(300):
        codes = bytes(rnd.randrange(12) for _ in range(rnd.randrange(1, 12)))
        old, new = (tr.run_back(bytes(rnd.randrange(12) for _ in range(4)), tr.END)[0] for _ in range(2))
        assert tr.rerun(codes, old, new, tr.run_back(codes, old)[0]) == tr.run_back(codes, new)[0]


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if d == 1 else re.sub("[.!?]", "", x) if d == 2 else x
        out += [(c, t, "user" if d == 4 else r, x)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


@pytest.mark.parametrize("source", ["table", "random"])
def test_damage_and_repair(spark, source):
    if source == "table":
        df = spark.read.parquet(f"{SMALL}/conversations.parquet")
        rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    else:
        rows = random_rows(9, 40, 4) + [(c, 0, "user", "Gone.") for c in range(1000, 1200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
        df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS g", "2 AS _c", "'x' AS audit", "0 AS alone")
    got = {r["conv_id"]: tuple(r)[1:] for r in tr.repair_damaged(df, limit=4).select(COLS).collect()}
    left = by_conv(damaged(rows))
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: expected(ordered(left[c])) if c in left else none for c in by_conv(rows)}
    assert none in got.values() or source == "table"


def test_copies_and_empty_table(spark):
    rows = [(1, 0, "user", "Same.")] * 50 + [(1, 1, "user", "Same.")] * 20 + [(1, 2, "assistant", "Ok.")]
    df = spark.createDataFrame(rows, SCHEMA)
    r = tr.digest(tr.repair(df, limit=2)).first()
    assert (r["duplicate"], r["cost"], r["audit"]) == (69, 69 * 3, "K" + "D" * 69 + "K")
    assert tr.repair_damaged(df.limit(0)).count() == 0
