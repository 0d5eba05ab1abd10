"""Deterministic choices: a hash of (seed, slot, index) instead of a generator.

The same row gets the same choice whatever the partitioning, also when a lost
task is run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_hash(seed: int, slot: str, index: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:{slot}:"), index.cast("string")))


def hex_modulo(digest: Column, start: int, length: int, n: int) -> Column:
    """A slice of hex digits as a number below n."""
    return F.pmod(F.conv(F.substring(digest, start, length), 16, 10).cast("bigint"), F.lit(n))


def pick(seed: int, slot: str, index: Column, n: int) -> Column:
    """A number in [0, n)."""
    return hex_modulo(row_hash(seed, slot, index), 1, 8, n)


def choose(options: Sequence[str], seed: int, slot: str, index: Column) -> Column:
    return F.get(F.array(*[F.lit(o) for o in options]), pick(seed, slot, index, len(options)).cast("int"))


def shuffle_key(seed: int, index: Column) -> Column:
    """Sort by this (and the index) for a reproducible shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), index.cast("string")))
