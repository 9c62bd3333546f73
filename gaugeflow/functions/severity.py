"""Severity tiers as column expressions.

Tiers are handled as ranks (1 low .. 4 critical, 0 anything else) and named last,
which keeps the generated expressions small.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tiers from mildest to gravest, and the lower bounds of the upper
# three for each detector (inclusive for the z-score, exclusive for EWMA).
TIERS = ("low", "medium", "high", "critical")
Z_BOUNDS = {4: 5.0, 3: 4.0, 2: 3.0}
EWMA_BOUNDS = {4: 7.0, 3: 5.0, 2: 4.0}


def _rank(score: Column, bounds: dict[int, float], inclusive: bool) -> Column:
    # Spark orders NaN above every number; a NaN score belongs to the lowest tier.
    rank = F.when(F.isnan(score), F.lit(1))
    for tier, bound in bounds.items():
        rank = rank.when(score >= bound if inclusive else score > bound, F.lit(tier))
    return rank.otherwise(F.lit(1))


def z_rank(z: Column) -> Column:
    return _rank(z, Z_BOUNDS, inclusive=True)


def ewma_rank(deviation: Column) -> Column:
    return _rank(deviation, EWMA_BOUNDS, inclusive=False)


def severity_at(rank: Column) -> Column:
    """Name of a rank; NULL for a rank that names no tier."""
    return F.get(F.array(F.lit(None).cast("string"), *map(F.lit, TIERS)), rank)


def severity_rank(severity: Column) -> Column:
    """1 (low) to 4 (critical); 0 for anything else, NULL included."""
    position = F.array_position(F.array(*map(F.lit, TIERS)), severity)
    return F.coalesce(position, F.lit(0)).cast("int")


def z_severity(z: Column) -> Column:
    return severity_at(z_rank(z))


def ewma_severity(deviation: Column) -> Column:
    return severity_at(ewma_rank(deviation))


def raised(rank: Column) -> Column:
    """One rank up, capped at the top."""
    return F.least(rank + 1, F.lit(len(TIERS)))


def escalate(severity: Column) -> Column:
    """Next tier up, capped at the top; unknown names stay as they are."""
    rank = F.nullif(severity_rank(severity), F.lit(0))
    return F.coalesce(severity_at(F.when(rank.isNotNull(), raised(rank))), severity)


def higher(first: Column, second: Column) -> Column:
    """The graver of two tiers; the first one on a tie."""
    return F.when(severity_rank(first) >= severity_rank(second), first).otherwise(second)
