"""Range numbers for rows by bounds that were taken from the data, in built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantile_bounds(df: DataFrame, col: str, n: int) -> list:
    """n - 1 values of a numeric column that split its non-null rows into about even ranges, ascending, with repeats."""
    if n < 2:
        return []
    got = df.agg(F.percentile_approx(col, [k / n for k in range(1, n)], 20 * n).alias("q")).first().q
    return sorted(got or [])


def range_number(c: Column, bounds: list, kind: str) -> Column:
    """How many of the ascending bounds (tuples: structs) are at or below c (0 for null): two short scans, about sqrt(bounds)
    each."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    one = lambda x: F.struct(*map(F.lit, x)) if isinstance(x, tuple) else F.lit(x)
    lit = lambda xs: F.array(*[one(x).cast(kind) for x in xs])
    coarse = F.size(F.filter(lit([g[0] for g in groups]), lambda b: b <= c))
    fine = F.size(F.filter(F.element_at(F.array(*[lit(g) for g in groups]), F.greatest(F.lit(1), coarse)), lambda b: b <= c))
    return F.coalesce(F.greatest(F.lit(0), coarse - 1) * step + fine, F.lit(0)).cast("int")
