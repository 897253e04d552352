"""User profiles: eight attributes to levels, slots and a pattern key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Attribute order, number of codes and bucket bounds of the profile layout.
CODES = {"gender": 3, "age_group": 6, "os": 3, "network_type": 3, "fans_count_level": 6}
BOUNDS = {
    "enable_times": (100, 200, 500, 1000),
    "post_times": (200, 500, 1000, 2000),
    "enable_rate": (10, 20, 50, 100),
}
ATTRIBUTES = (*CODES, *BOUNDS)
LEGACY_STARTS = (1, 4, 10, 13, 16, 22, 28, 34)


def code_level(col: Column, n: int, from_zero: bool = False) -> Column:
    """Level of a small code: 0 for <= 0, 1..n for the codes, n+1 for null or out of range.

    ``from_zero`` codes start at 0, so they take 1..n and 0 is left for negative values.
    """
    code = col.cast("int") + F.lit(1 if from_zero else 0)
    return F.when(code <= 0, F.lit(0)).when(code <= n, code).otherwise(F.lit(n + 1))


def bucket_level(col: Column, bounds: tuple) -> Column:
    """0 for <= 0, then one level per half-open range [low, high); null has its own last level."""
    level = F.when(col <= 0, F.lit(0))
    for i, high in enumerate(bounds):
        level = level.when(col < high, F.lit(i + 1))
    return level.when(col >= bounds[-1], F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds) + 2))


def levels() -> list[Column]:
    """The eight levels of a profile row, in ``ATTRIBUTES`` order."""
    coded = [code_level(F.col(c), n, from_zero=c == "gender") for c, n in CODES.items()]
    bucketed = [bucket_level(F.col(c), b) for c, b in BOUNDS.items()]
    return coded + bucketed


def cardinalities() -> list[int]:
    """Number of levels of each attribute."""
    return [n + 2 for n in CODES.values()] + [len(b) + 3 for b in BOUNDS.values()]


def block_starts() -> list[int]:
    sizes, starts = cardinalities(), [0]
    for size in sizes[:-1]:
        starts.append(starts[-1] + size)
    return starts


LEVEL_BITS = 4  # every attribute has fewer than 16 levels


def profile_patterns(profiles: DataFrame) -> DataFrame:
    """``(user_id, pattern)``: the eight levels packed into one BIGINT, 4 bits each."""
    code = sum((F.shiftleft(c.cast("bigint"), LEVEL_BITS * i) for i, c in enumerate(levels())), F.lit(0))
    return profiles.select("user_id", code.cast("bigint").alias("pattern"))


def pattern_text(pattern: Column, attributes: int = 8) -> Column:
    """Readable form of a packed pattern: levels joined by ``-``."""
    parts = [F.shiftright(pattern, LEVEL_BITS * i).bitwiseAND(F.lit(15)).cast("string") for i in range(attributes)]
    return F.concat_ws("-", *parts)


def _legacy_slots() -> Column:
    starts = iter(LEGACY_STARTS)
    slots = []
    for name in CODES:
        value = F.coalesce(F.col(name).cast("int"), F.lit(0))
        slots.append(F.lit(next(starts)) + (value if name == "gender" else F.greatest(value - 1, F.lit(0))))
    for name, bounds in BOUNDS.items():
        known = F.coalesce(F.col(name), F.lit(0))
        slots.append(F.lit(next(starts)) + bucket_level(known, bounds) - 1)
    return F.array_distinct(F.array(*slots))


def profile_slots(profiles: DataFrame, legacy_slots: bool = False) -> DataFrame:
    """One-hot profile as ``(user_id, slot)`` rows.

    The default layout has disjoint blocks with an own slot for "<= 0" and "unknown".
    ``legacy_slots`` gives the 39 positions of the old layout, in which "no enable times" and fans
    level 6 share a slot.
    """
    if legacy_slots:
        slots = _legacy_slots()
    else:
        slots = F.array(*[level + F.lit(s) for level, s in zip(levels(), block_starts())])
    return profiles.select("user_id", F.explode(slots).alias("slot"))
