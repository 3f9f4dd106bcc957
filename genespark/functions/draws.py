"""Deterministic draws: a seeded hash of the row's own keys, so partitioning never changes a result."""

from pyspark.sql import functions as F


def draw(n, seed, *keys):
    """Uniform integer in [0, n)."""
    return F.pmod(F.xxhash64(*[F.col(k) if isinstance(k, str) else k for k in keys], F.lit(seed)), n)
