"""Counter-based random columns: a draw depends on seed, stream and row key only, never on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, stream: str, *keys: Column | str) -> Column:
    """In [0, 1), from 53 bits of a hash."""
    h = F.xxhash64(F.lit(seed).cast("long"), F.lit(stream), *keys)
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)


def normal(seed: int, stream: str, *keys: Column | str) -> Column:
    """Standard normal, by Box and Muller's transform of two draws."""
    u, v = uniform(seed, f"{stream}/u", *keys), uniform(seed, f"{stream}/v", *keys)
    return F.sqrt(-2.0 * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2.0 * math.pi) * v)


def index(n: int, seed: int, stream: str, *keys: Column | str) -> Column:
    """A whole number in [0, n)."""
    return F.least(F.floor(uniform(seed, stream, *keys) * n), F.lit(n - 1)).cast("long")


def order_key(seed: int, *keys: Column | str) -> Column:
    """Sorting by it shuffles rows."""
    return F.xxhash64(F.lit(seed).cast("long"), F.lit("order"), *keys)
