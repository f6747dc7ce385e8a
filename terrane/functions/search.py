"""Search in sorted arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upto(array: Column, field: str, value: Column, longest: int) -> Column:
    """How many structs of an array, sorted by ``field``, have it at or below a value, by adding ever smaller powers of
    two; 0 for a NULL array or value. ``longest``: a bound of the arrays' lengths."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(max(1, int(longest).bit_length())))))
    reached = lambda n, s: F.coalesce(F.get(array, n + s - 1)[field] <= value, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(reached(n, s), n + s).otherwise(n))
