"""Profile similarity: all pairs above a threshold, exact top-k neighbours, an LSH approximation.

Two profiles with ``s`` equal attributes of ``A`` have cosine ``s / A``. Equal profiles are merged
into one pattern first, so a popular profile is one row whatever its number of users. Patterns are
joined on subsets ("masks") of the attributes: patterns that agree on a mask differ only in the
other attributes, so a join group has at most the product of those attributes' level counts,
a constant of the layout that does not grow with the data.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.operators.profile import LEVEL_BITS
from clickloom.session import cut_lineage

Mask = tuple[int, ...]


def pattern_table(patterns: DataFrame, keep: int = 1) -> DataFrame:
    """``(pattern, users, first_ids)``: user count and the ``keep`` smallest user ids.

    ``row_number <= keep`` is limited on the map side, so a hot pattern sends ``keep`` rows per task.
    """
    order = Window.partitionBy("pattern").orderBy("user_id")
    firsts = (
        patterns.select("pattern", "user_id")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= keep)
        .groupBy("pattern")
        .agg(F.sort_array(F.collect_list("user_id")).alias("first_ids"))
    )
    counts = patterns.groupBy("pattern").agg(F.count("*").alias("users"))
    return counts.join(firsts, "pattern")


def _flags(mask: Mask) -> int:
    """One bit per attribute of the mask, at the attribute's lowest bit."""
    return sum(1 << (LEVEL_BITS * i) for i in mask)


def _with_masks(table: DataFrame, masks: list[Mask]) -> DataFrame:
    """One row per (pattern, mask): ``mask`` flags and the pattern's bits under the mask."""
    explode = F.expr(f"explode(array({', '.join(f'{_flags(mask)}L' for mask in masks)}))")
    spread = table.withColumn("mask", explode)
    wide = F.col("mask") * F.lit(15)  # a flag times 15 covers its four bits
    return spread.withColumn("part", F.col("pattern").bitwiseAND(wide))


def _agreeing(a: str, b: str, attributes: int) -> Column:
    """Flags of the attributes at which two patterns have the same level."""
    every = _flags(tuple(range(attributes)))
    x = F.col(a).bitwiseXOR(F.col(b))
    differs = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3))
    return differs.bitwiseAND(F.lit(every)).bitwiseXOR(F.lit(every))


def _mask_pairs(left: DataFrame, right: DataFrame, masks: list[Mask], attributes: int) -> DataFrame:
    """Ordered pairs of different patterns that agree on a mask, once per common mask."""
    a = _with_masks(left, masks).select(
        "mask", "part", F.col("pattern").alias("pattern_a"), F.col("users").alias("users_a")
    )
    b = _with_masks(right, masks).select(
        "mask", "part", F.col("pattern").alias("pattern_b"), F.col("users").alias("users_b"), F.col("first_ids").alias("ids_b")
    )
    met = a.join(b, ["mask", "part"]).filter(F.col("pattern_a") != F.col("pattern_b"))
    met = met.withColumn("agree", _agreeing("pattern_a", "pattern_b", attributes))
    return met.withColumn("shared", F.bit_count("agree"))


def similar_profiles(table: DataFrame, min_shared: int, attributes: int = 8) -> DataFrame:
    """All pattern pairs ``a < b`` with cosine >= min_shared / attributes; 1 gives all pairs with a cosine above zero.

    ``(profile_a, profile_b, shared, sim, users_a, users_b)``. User pairs are this table joined with
    the users of each pattern; they are left factored because that product is quadratic in the
    users of a popular profile. Users of one pattern have similarity 1 and need no row here.
    """
    masks = list(combinations(range(attributes), min_shared))
    # A pair meets once per common mask; it is kept at its lowest agreeing attributes (no shuffle):
    # nothing agrees below the mask's highest flag except the mask itself.
    limit = _lookup(F.col("mask"), {_flags(m): (1 << (LEVEL_BITS * m[-1] + 1)) - 1 for m in masks})
    pairs = _mask_pairs(table, table, masks, attributes).filter(
        (F.col("pattern_a") < F.col("pattern_b")) & (F.col("agree").bitwiseAND(limit) == F.col("mask"))
    )
    return pairs.select(
        F.col("pattern_a").alias("profile_a"),
        F.col("pattern_b").alias("profile_b"),
        F.col("shared").cast("bigint").alias("shared"),
        (F.col("shared") / F.lit(float(attributes))).alias("sim"),
        "users_a",
        "users_b",
    )


def _lookup(key: Column, table: dict[int, int]) -> Column:
    """Small constant table grouped by value, as one CASE expression."""
    by_value: dict[int, list[int]] = {}
    for k, v in table.items():
        by_value.setdefault(v, []).append(k)
    return F.coalesce(*[F.when(key.isin(keys), F.lit(v).cast("bigint")) for v, keys in by_value.items()])


def both_directions(pairs: DataFrame) -> DataFrame:
    """Make a pair table symmetric: (a, b) and (b, a)."""
    back = pairs.select(
        F.col("profile_b").alias("profile_a"),
        F.col("profile_a").alias("profile_b"),
        "shared",
        "sim",
        F.col("users_b").alias("users_a"),
        F.col("users_a").alias("users_b"),
    )
    return pairs.unionByName(back)


def similar_users(users: DataFrame, patterns: DataFrame, pairs: DataFrame) -> DataFrame:
    """User-level entries ``(user_a, user_b, sim)`` for the users asked for.

    ``users(user_id)`` is the lookup set; ``pairs`` comes from :func:`both_directions`.
    """
    asked = patterns.join(users.select("user_id"), "user_id", "left_semi").select(
        F.col("user_id").alias("user_a"), F.col("pattern").alias("profile_a")
    )
    members = patterns.select(F.col("user_id").alias("user_b"), F.col("pattern").alias("profile_b"))
    own = asked.select("user_a", F.col("profile_a").alias("profile_b"), F.lit(1.0).alias("sim"))
    other = asked.join(pairs.select("profile_a", "profile_b", "sim"), "profile_a").select("user_a", "profile_b", "sim")
    return (
        own.unionByName(other)
        .join(members, "profile_b")
        .filter(F.col("user_a") != F.col("user_b"))
        .select("user_a", "user_b", "sim")
    )


def top_neighbours(patterns: DataFrame, k: int = 20, attributes: int = 8) -> DataFrame:
    """Exact ``k`` most similar users of every user: ``(user_id, neighbour, shared, rank)``.

    Works down from identical profiles to one common attribute. A pattern leaves the search as
    soon as the users found so far are at least ``k``, so only rare profiles reach the wider masks.
    Ties are broken by user id, hence the ``k + 1`` smallest ids of each matched pattern suffice.
    """
    table = cut_lineage(pattern_table(patterns, keep=k + 1))
    found = table.select("pattern", (F.col("users") - 1).alias("found"))
    candidates = [table.select("pattern", F.lit(attributes).alias("shared"), F.explode("first_ids").alias("neighbour"))]
    for shared in range(attributes - 1, 0, -1):
        hungry = cut_lineage(found.filter(F.col("found") < k))
        if hungry.isEmpty():
            break
        masks = list(combinations(range(attributes), shared))
        asking = table.join(hungry, "pattern", "left_semi")
        # With exactly this many agreements a pair meets at one mask only.
        exact = _mask_pairs(asking, table, masks, attributes).filter(F.col("shared") == shared)
        met = cut_lineage(exact.select("pattern_a", "users_b", "ids_b"))
        order = Window.partitionBy("pattern").orderBy("neighbour")
        candidates.append(
            met.select(F.col("pattern_a").alias("pattern"), F.explode("ids_b").alias("neighbour"))
            .withColumn("rn", F.row_number().over(order))
            .filter(F.col("rn") <= k)
            .select("pattern", F.lit(shared).alias("shared"), "neighbour")
        )
        gained = met.groupBy(F.col("pattern_a").alias("pattern")).agg(F.sum("users_b").alias("gained"))
        found = hungry.join(gained, "pattern", "left").select(
            "pattern", (F.col("found") + F.coalesce("gained", F.lit(0))).alias("found")
        )
    best = Window.partitionBy("pattern").orderBy(F.desc("shared"), "neighbour")
    top = (
        reduce(DataFrame.unionByName, candidates)
        .withColumn("rn", F.row_number().over(best))
        .filter(F.col("rn") <= k + 1)
        .groupBy("pattern")
        .agg(F.sort_array(F.collect_list(F.struct("rn", "shared", "neighbour"))).alias("top"))
    )
    mine = F.slice(F.filter("top", lambda t: t["neighbour"] != F.col("user_id")), 1, k)
    ranked = patterns.join(top, "pattern").select("user_id", F.posexplode(mine).alias("pos", "t"))
    return ranked.select(
        "user_id",
        F.col("t.neighbour").alias("neighbour"),
        F.col("t.shared").cast("bigint").alias("shared"),
        (F.col("pos") + 1).cast("bigint").alias("rank"),
    )


def sampled_masks(attributes: int, size: int, tables: int) -> list[Mask]:
    """Evenly spaced masks of the given size, so that all attributes take part."""
    masks = list(combinations(range(attributes), size))
    stride = max(1, len(masks) // tables)
    return masks[::stride][:tables]


def approx_similar_profiles(
    table: DataFrame, min_shared: int, attributes: int = 8, mask_size: int = 6, tables: int = 8
) -> DataFrame:
    """Bit-sampling LSH: only pairs that agree on one of a few sampled masks are compared.

    Found pairs carry their exact similarity; pairs that meet in no table are missed.
    """
    masks = sampled_masks(attributes, mask_size, tables)
    inside = [F.when(F.col("agree").bitwiseAND(F.lit(_flags(m))) == _flags(m), F.lit(_flags(m)).cast("bigint")) for m in masks]
    pairs = _mask_pairs(table, table, masks, attributes).filter(
        (F.col("pattern_a") < F.col("pattern_b")) & (F.col("shared") >= min_shared) & (F.col("mask") == F.coalesce(*inside))
    )
    return pairs.select(
        F.col("pattern_a").alias("profile_a"),
        F.col("pattern_b").alias("profile_b"),
        (F.col("shared") / F.lit(float(attributes))).alias("sim"),
    )


def similarity_error(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """Mean absolute error of the approximation over the exact pairs (a missed pair counts as 0)."""
    guess = approx.select("profile_a", "profile_b", F.col("sim").alias("guess"))
    joined = exact.join(guess, ["profile_a", "profile_b"], "left_outer")
    return joined.agg(
        F.avg(F.abs(F.col("sim") - F.coalesce("guess", F.lit(0.0)))).alias("mae"),
        F.count("*").alias("pairs"),
        F.count("guess").alias("found"),
    )
