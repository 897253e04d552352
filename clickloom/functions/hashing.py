"""Hash-based choices: the same on every retry and in every SQL engine that knows md5."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _joined(parts) -> Column:
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def hash_int(*parts) -> Column:
    """First 8 hex digits of md5(part|part|...) as a BIGINT in [0, 2^32)."""
    return F.conv(F.substring(F.md5(_joined(parts)), 1, 8), 16, 10).cast("bigint")


def hash_unit(*parts) -> Column:
    """Uniform number in [0, 1) derived from the parts."""
    return hash_int(*parts) / F.lit(4294967296.0)


def hash_weight(*parts, scale: float = 0.1) -> Column:
    """Reproducible initial parameter in [-scale, scale)."""
    return (hash_unit(*parts) - F.lit(0.5)) * F.lit(2.0 * scale)
