"""Draws by integer arithmetic alone, so that any engine makes the same ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647


def _seed(seed: int) -> int:
    return (seed * 2654435761 + 97) % PRIME


def mix(seed: int, n, *parts: Column) -> Column:
    """A number in 0..n-1 from whole numbers (below 2**40): n is a number or a column."""
    x = F.lit(_seed(seed)).cast("long")
    for p in parts:
        x = (x * 48271 + p.cast("long") % PRIME + 1) % PRIME
        x = (x * x + 1013904223) % PRIME
    x = (x * x + 12345) % PRIME
    return x % n


def mix_sql(seed: int, n, *parts: str) -> str:
    x = f"CAST({_seed(seed)} AS BIGINT)"
    for p in parts:
        x = f"((({x}) * 48271 + CAST({p} AS BIGINT) % {PRIME} + 1) % {PRIME})"
        x = f"(list_transform([{x}], lambda v: (v * v + 1013904223) % {PRIME})[1])"
    x = f"(list_transform([{x}], lambda v: (v * v + 12345) % {PRIME})[1])"
    return f"({x} % {n})"
