"""Repair of conversation structure by a parallel Viterbi search whose chunks converge in rank.

A conversation is well formed if the first letters of its roles read ``(s?(ua)+)?``. Edits in the order of turns make it so:
keep a row (cost 0), give it the role user or assistant (2), delete it (3; blank and repeated rows must go), insert an empty
user or assistant turn (2); a truncated row that stays adds 1. The cheapest edits are wanted, and of those
the sequence whose initials (K, R, D, I) come first in ASCII order.

Rows are sorted over all partitions and cut into chunks of at most ``CHUNK`` rows of one conversation, so one
conversation may have any share of all rows. Of each chunk a task computes backward costs: for each of four states the
least cost to finish. It starts from a speculative vector, that of the end of a conversation. Chunks whose successor
turns out to begin with another vector are run again, row by row next to their earlier run, until both differ only by a constant:
from there on nothing can change. Rounds go on until every chunk was fed what its successor gives; the products of the rows' (min, +)
matrices have rank one after a few rows, so these are few. The stitched vectors then drive the tracing: the state in which each chunk starts
follows from four-entry maps, and all chunks are traced side by side.

Cases: rows of one turn are taken by role, then by the SHA-256 of their text; null turns come first and leave gaps alone. Null roles and texts
count as one space. Equal rows are counted before they are sorted, so any number of copies is one row there. Null conversation
ids are one conversation. An empty table gives no rows; very long texts pass in batches of their own. Only the four columns are read.
:func:`digest` hashes a conversation's repaired turns in order, which no number of machines can share: one task reads the
pieces of one conversation as a stream, holding one piece at a time.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clickloom.session import broadcast_if_small, cut_lineage, scratch_path

CHUNK = 4_096  # rows of a chunk
BYTES = 4 << 20  # of text in a chunk, or one longer row
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs to end a conversation from each state: an accepted state, or turns to insert.
END = (0, 4, 2, 0)
KEEP, INSERT, REROLE, DELETE, TRUNCATED = 0, 2, 2, 3, 1
#: Faults of a row, in the order in which they count.
FINE, CUT, BLANK, REPEATED = range(4)
_BLANKS = " \t\n\x0b\x0c\r"
_LETTERS = "sua"


def _turned(state: int) -> tuple[str, int]:
    """The role that a new turn must have in ``state`` (system only by keeping a row), and the state after it."""
    return ("assistant", ASSISTANT) if state == USER else ("user", USER)


def _kept(state: int, letter: str) -> int | None:
    if letter == "s":
        return SYSTEM if state == START else None
    role, after = _turned(state)
    return after if letter == role[0] else None


def code(letter: str, fault: int) -> int:
    """Row in one byte: first letter of its role (s, u, a, other) and whether it is fine, truncated or must go."""
    return 3 * (_LETTERS.find(letter) % 4 if letter else 3) + min(fault, 2)


def _read(row: int) -> tuple[str, int, bool]:
    return (*_LETTERS, "")[row // 3], TRUNCATED * (row % 3 == CUT), row % 3 == 2


@lru_cache(maxsize=None)
def back(row: int, after: tuple) -> tuple[tuple, int]:
    """Backward costs before a row from those after it: least entry zero, and the constant taken away.

    Differences of entries are bounded by the costs of inserting, so there are only a few vectors.
    """
    letter, cut, gone = _read(row)
    costs = []
    for state in range(4):
        best = DELETE + after[state]
        if not gone:
            best = min(best, REROLE + cut + after[_turned(state)[1]])
            if (to := _kept(state, letter)) is not None:
                best = min(best, KEEP + cut + after[to])
        costs.append(best)
    for _ in range(2):
        costs = [min(c, INSERT + costs[_turned(s)[1]]) for s, c in enumerate(costs)]
    least = min(costs)
    return tuple(c - least for c in costs), least


@lru_cache(maxsize=None)
def edits(row: int | None, after: tuple, state: int) -> tuple[str, tuple, int, int]:
    """(initials, roles of inserted turns, cost, next state) of the least edits up to and with a row; None: the end of the conversation."""
    audit, roles, cost = "", [], 0
    now, const = (after, 0) if row is None else back(row, after)
    letter, cut, gone = (None, 0, True) if row is None else _read(row)
    while row is not None or state not in (START, ASSISTANT):
        left = now[state] + const
        role, to = _turned(state)
        if row is not None and DELETE + after[state] == left:
            return audit + "D", tuple(roles), cost + DELETE, state
        if INSERT + now[to] + const == left:
            audit, cost, state = audit + "I", cost + INSERT, to
            roles.append(role)
            continue
        kept = None if gone else _kept(state, letter)
        if kept is not None and KEEP + cut + after[kept] == left:
            return audit + "K", tuple(roles), cost + KEEP + cut, kept
        return audit + "R", (*roles, role), cost + REROLE + cut, to
    return audit, tuple(roles), cost, state


def run_back(codes: bytes, after: tuple) -> list[tuple]:
    """Vectors before each row and after the last one."""
    out = [after]
    for c in reversed(codes):
        out.append(back(c, out[-1])[0])
    return out[::-1]


def rerun(codes: bytes, old: tuple, new: tuple, first: tuple) -> tuple:
    """Vector before the chunk if it is fed ``new``: the earlier run from ``old`` gave ``first``, which holds once both runs agree."""
    for c in reversed(codes):
        if old == new:
            return first
        old, new = back(c, old)[0], back(c, new)[0]
    return new


def trace(codes: bytes, after: tuple, state: int, last: bool):
    """The edits of a chunk's rows, one by one, and those at the end of the conversation."""
    vectors = run_back(codes, after)
    for i, c in enumerate(codes):
        step = edits(c, vectors[i + 1], state)
        state = step[-1]
        yield step
    if last:
        yield edits(None, END, state)


def _clean(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    space = F.lit(" ")
    return df.select(F.col(conv).alias("_c"), F.col(turn).cast("bigint").alias("_t"), F.coalesce(F.col(role), space).alias("_r"), F.coalesce(F.col(text), space).alias("_x"))


def faulty_rows(rows: DataFrame) -> DataFrame:
    """Different rows (_c, _t, _r, _x) with their number and the fault of the first copy."""
    digest = F.unhex(F.sha2(F.col("_x"), 256)).alias("_h")
    seen = rows.select("_c", "_t", "_r", digest).distinct().groupBy("_c", "_r", "_h")
    early = F.min(F.struct(F.col("_t").isNotNull(), "_t")).alias("_first")  # null turns come first
    again = cut_lineage(seen.agg(F.count("*").alias("_n"), early).filter("_n > 1").select("_c", "_r", "_h", F.col("_first._t").alias("_first")))
    groups = rows.groupBy("_c", "_t", "_r", "_x").agg(F.count("*").alias("_n")).withColumn("_h", F.unhex(F.sha2(F.col("_x"), 256))).alias("x")
    a = broadcast_if_small(again).alias("a")
    same = F.col("x._c").eqNullSafe(F.col("a._c")) & (F.col("x._r") == F.col("a._r")) & (F.col("x._h") == F.col("a._h"))
    joined = groups.join(a, same, "left")
    end = F.rtrim(F.col("x._x"), F.lit(_BLANKS))
    fault = (
        F.when(end == "", BLANK)
        .when(F.col("a._h").isNotNull() & ~F.col("x._t").eqNullSafe(F.col("a._first")), REPEATED)
        .when(~F.right(end, F.lit(1)).isin(".", "!", "?"), CUT)
        .otherwise(FINE)
    )
    return joined.select("x.*", fault.alias("_f"))


CHUNKS = (
    "_part int, _seq bigint, alone boolean, codes binary, roles array<string>, texts array<string>, copies array<bigint>, vin array<int>, vout array<int>, "
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_letter string, last_letter string, first_turn bigint, last_turn bigint, least_turn bigint, n_turns bigint"
)


def _batches(rows, schema: pa.Schema, size):
    """Dictionaries to record batches of about ``BYTES``."""
    held, room = [], 0
    for row in rows:
        held.append(row)
        room += size(row)
        if room > BYTES or len(held) >= 4_096:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, room = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches):
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        yield from zip(*columns)


def _runs(rows, limit: int):
    """Lists of up to ``limit`` adjacent rows of one conversation with up to ``BYTES`` of text; whether it begins and ends there."""
    for conv, group in groupby(rows, key=lambda r: r[0]):
        held, room, first = [], 0, True
        for row in group:
            size = len(row[3])
            if held and (len(held) == limit or room + size > BYTES):
                yield conv, held, first, False
                held, room, first = [], 0, False
            held.append(row)
            room += size
        yield conv, held, first, True


def _summary(rows: list[tuple]) -> dict:
    """Counts of one chunk, and what is needed to add up those of adjacent chunks."""
    letters = [r[2][:1] for r in rows]
    fault, n = [r[5] for r in rows], [r[4] for r in rows]
    turns = [r[1] for r in rows if r[1] is not None]
    legal = sum(a + b in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
    blank = sum(k for f, k in zip(fault, n) if f == BLANK)
    return {
        "blank": blank,
        "duplicate": sum(k if f == REPEATED else k - 1 for f, k in zip(fault, n) if f != BLANK),
        "truncated": sum(f == CUT for f in fault),
        "illegal": sum(n) - 1 - legal,
        "first_letter": letters[0],
        "last_letter": letters[-1],
        "first_turn": rows[0][1],
        "last_turn": rows[-1][1],
        "least_turn": turns[0] if turns else None,
        "n_turns": len(set(turns)),
    }


def cut(rows: DataFrame, limit: int = CHUNK) -> DataFrame:
    """Written chunks of all conversations with their speculative vectors, numbered ``g`` in order."""
    spark = rows.sparkSession
    order = ["_c", "_t", "_r", "_h"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_c", "_t", "_r", "_x", "_n", "_f")
    schema = StructType([placed.schema["_c"], *StructType.fromDDL(CHUNKS)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        part = TaskContext.get().partitionId()

        def made():
            pending, seq, seen, conv = None, 0, 0, None
            for conv, held, first, last in _runs(_rows(batches), limit):
                seen += first
                codes = bytes(code(r[2][:1], r[5]) for r in held)
                row = {"_c": conv, "_part": part, "_seq": seq, "alone": first and last and seen > 1, "codes": codes, "roles": [r[2] for r in held], "texts": [r[3] for r in held]}
                row |= {"copies": [r[4] for r in held], "vin": END, "vout": run_back(codes, END)[0]} | _summary(held)
                if pending:
                    yield pending
                pending, seq = row, seq + 1
            if pending:
                yield pending | {"alone": False}  # the conversation may go on in the next partition

        yield from _batches(made(), arrow, lambda r: sum(map(len, r["texts"])))

    path = scratch_path(spark, "chunks")
    placed.mapInArrow(run, schema).write.parquet(path)
    chunks = spark.read.parquet(path)
    parts = chunks.groupBy("_part").agg(F.count("*").alias("_rows"))  # one row per partition
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return chunks.join(F.broadcast(starts), "_part").withColumn("g", F.col("_before") + F.col("_seq")).drop("_part", "_seq", "_before")


def stitched(chunks: DataFrame) -> DataFrame:
    """(g, vin, start, last) of the chunks that may have neighbours: their true vectors and the states they start in."""
    end = F.array(*[F.lit(e) for e in END])

    def fed(table: DataFrame) -> DataFrame:
        after = table.select((F.col("g") - 1).alias("g"), F.col("_c").alias("_c2"), F.col("vout").alias("_need"), F.lit(True).alias("_any"))
        follows = F.col("_any").isNotNull() & F.col("_c").eqNullSafe(F.col("_c2"))
        joined = table.drop("need", "last").join(after, "g", "left")
        return joined.withColumn("need", F.when(follows, F.col("_need")).otherwise(end)).withColumn("last", ~follows).drop("_c2", "_need", "_any")

    table = cut_lineage(fed(chunks.filter("NOT alone").select("g", "_c", "codes", "vin", "vout")))
    schema = table.select("g", "_c", "codes", "vin", "vout").schema
    arrow = to_arrow_schema(schema)

    def fix(batches):
        rows = ({"g": g, "_c": c, "codes": codes, "vin": new, "vout": rerun(codes, tuple(old), tuple(new), tuple(first))} for g, c, codes, old, first, new in _rows(batches))
        yield from _batches(rows, arrow, lambda r: len(r["codes"]))

    while not table.filter("need <> vin").isEmpty():
        again = table.filter("need <> vin").select("g", "_c", "codes", "vin", "vout", "need").mapInArrow(fix, schema)
        table = cut_lineage(fed(table.filter("need = vin").select(*schema.names).unionByName(again)))

    def ends(batches):
        for batch in batches:
            out = []
            for _, _, codes, vin, _ in _rows([batch]):
                out.append([([s] + [step[-1] for step in trace(codes, tuple(vin), s, False)])[-1] for s in range(4)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(out, pa.list_(pa.int32()))], names=["g", "_c", "last", "ends"])

    kind = dict(table.dtypes)["_c"]
    maps = table.select("g", "_c", "codes", "vin", "last").mapInArrow(ends, f"g bigint, _c {kind}, last boolean, ends array<int>")

    def follow(batches):
        state = START
        for batch in batches:
            out = []
            for _, last, to in _rows([batch.select(["g", "last", "ends"])]):
                out.append(state)
                state = START if last else to[state]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int32())], names=["g", "start"])

    starts = maps.repartition("_c").sortWithinPartitions("_c", "g").mapInArrow(follow, "g bigint, start int")
    return table.select("g", "vin", "last").join(starts, "g")


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", limit: int = CHUNK) -> DataFrame:
    """Pieces of repaired conversations: (conv, g, alone, audit, cost, turns array<struct<role, text>>) and the counts of faults.

    The pieces of a conversation follow each other by ``g``; ``alone`` ones are whole conversations.
    """
    chunks = cut(faulty_rows(_clean(df, conv, turn, role, text)), limit)
    cols = ["_c", "g", "alone", "codes", "roles", "texts", "copies", "blank", "duplicate", "truncated", "illegal", "first_letter", "last_letter", "first_turn", "last_turn", "least_turn", "n_turns"]
    found = broadcast_if_small(cut_lineage(stitched(chunks)))
    whole = chunks.filter("alone").select(*cols, "vin", F.lit(START).alias("start"), F.lit(True).alias("last"))
    parts = chunks.filter("NOT alone").drop("vin").join(found, "g").select(*cols, "vin", "start", "last")
    table = whole.unionByName(parts).select("vin", "start", "last", "codes", "roles", "texts", "copies", *[c for c in cols if c not in ("codes", "roles", "texts", "copies")])
    passed = table.columns[7:]
    out = StructType([*[table.schema[c] for c in passed], *StructType.fromDDL("audit string, cost bigint, turns array<struct<role: string, text: string>>")])
    arrow = to_arrow_schema(out)

    def run(batches):
        def made():
            for vin, start, last, codes, roles, texts, copies, *rest in _rows(batches):
                audit, cost, turns = [], 0, []
                steps = trace(codes, tuple(vin), start, last)
                for r, x, n, (initials, added, price, _) in zip(roles, texts, copies, steps):
                    audit.append(initials + "D" * (n - 1))
                    cost += price + DELETE * (n - 1)
                    new = added[:-1] if initials[-1] == "R" else added
                    turns += [{"role": a, "text": ""} for a in new]
                    if initials[-1] != "D":
                        turns.append({"role": added[-1] if initials[-1] == "R" else r, "text": x})
                for initials, added, price, _ in steps:  # what ends the conversation
                    audit.append(initials)
                    cost += price
                    turns += [{"role": a, "text": ""} for a in added]
                yield dict(zip(passed, rest)) | {"audit": "".join(audit), "cost": cost, "turns": turns}

        yield from _batches(made(), arrow, lambda r: sum(len(t["text"]) for t in r["turns"]))

    return table.mapInArrow(run, out).withColumnRenamed("_c", conv)


def turns(pieces: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, piece, place, role, text): the repaired turns, in order of piece and place."""
    return pieces.select(F.col(conv), F.col("g").alias("piece"), F.posexplode("turns").alias("place", "_turn")).select(conv, "piece", "place", "_turn.role", "_turn.text")


def digest(pieces: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation with rows: gaps, counts, cost, audit and the SHA-256 of its repaired ``role:text`` lines."""
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    cols = ["_c", *sums, "first_letter", "last_letter", "first_turn", "last_turn", "least_turn", "n_turns", "audit", "turns"]
    table = pieces.withColumnRenamed(conv, "_c").select("alone", "g", *cols)
    schema = StructType([table.schema["_c"], *StructType.fromDDL("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")])
    arrow = to_arrow_schema(schema)

    def run(batches):
        def made():
            for c, group in groupby(_rows(batches), key=lambda r: r[0]):
                total, audits, state = dict.fromkeys(sums, 0), [], hashlib.sha256()
                before, least, last_turn, n_turns, empty = None, None, None, 0, True
                for row in group:
                    r = dict(zip(cols, row))
                    for name in sums:
                        total[name] += r[name]
                    if before is not None:
                        total["illegal"] += before + r["first_letter"] not in ("su", "ua", "au")
                        n_turns -= r["first_turn"] is not None and r["first_turn"] == last_turn
                    before, least, last_turn = r["last_letter"], r["least_turn"] if least is None else least, r["last_turn"]
                    n_turns += r["n_turns"]
                    audits.append(r["audit"])
                    for t in r["turns"]:
                        state.update(("" if empty else "\n").encode() + f"{t['role']}:{t['text']}".encode())
                        empty = False
                gaps = 0 if least is None else last_turn - least + 1 - n_turns
                yield {"_c": c, "gaps": gaps, **total, "audit": "".join(audits), "repaired_sha256": state.hexdigest()}

        yield from _batches(made(), arrow, lambda r: len(r["audit"]))

    whole = table.filter("alone").select(*cols)
    parts = table.filter("NOT alone").repartition("_c").sortWithinPartitions("_c", "g").select(*cols)
    return whole.mapInArrow(run, schema).unionByName(parts.mapInArrow(run, schema)).withColumnRenamed("_c", conv)


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn") -> Column:
    """crc32 of ``conv:turn`` modulo 20; nulls are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return F.pmod(F.crc32(F.concat(part(conv), F.lit(":"), part(turn)).cast("binary")), F.lit(20))


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults: dropped, emptied, without marks, repeated, or with the role user."""
    space, d = F.lit(" "), F.col("_d")
    rows = df.select(F.col(conv), F.col(turn), F.coalesce(F.col(role), space).alias(role), F.coalesce(F.col(text), space).alias(text), damage(df, conv, turn).alias("_d")).filter(d != 0)
    rows = rows.withColumn(text, F.when(d == 1, "").when(d == 2, F.translate(F.col(text), ".!?", "")).otherwise(F.col(text))).withColumn(role, F.when(d == 4, "user").otherwise(F.col(role)))
    return rows.withColumn("_d", F.explode(F.when(d == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_d")


def repair_damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", limit: int = CHUNK) -> DataFrame:
    """Digests of the repaired conversations after planted damage; conversations without rows left count zero."""
    rows = digest(repair(damaged(df, conv, turn, role, text), conv, turn, role, text, limit), conv)
    bare = df.groupBy(F.col(conv)).agg(F.max(damage(df, conv, turn)).alias("_d")).filter("_d = 0")
    zeros = [F.lit(0).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.unionByName(bare.select(conv, *zeros, F.lit("").alias("audit"), F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256")))
