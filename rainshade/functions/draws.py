"""Seeded uniforms that depend only on the row, never on partitioning, so a lost task repeats its draw."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Uniform = Callable[..., Column]


def hash_uniform(seed: int, *keys: Column) -> Column:
    """Uniform in [0, 1) from xxhash64 of the seed and the row's keys."""
    h = F.xxhash64(F.lit(seed), *keys)
    return h.bitwiseAND(F.lit(2 ** 53 - 1)).cast("double") * F.lit(2.0 ** -53)


def md5_uniform(seed: int, *keys: Column) -> Column:
    """Uniform in [0, 1) from the first 52 bits of md5: slower, but any SQL engine can repeat it."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    number = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") * F.lit(16.0 ** -13)
    # never null, so joins on it add no null filter that would compute the hash twice
    return F.coalesce(number, F.lit(0.0))


def draw_index(u: Column, n: Column | int) -> Column:
    """Index 0..n-1 from a uniform."""
    size = n if isinstance(n, Column) else F.lit(n)
    return F.least(F.floor(u * size), size - 1).cast("long")
