"""Hashes that give the same values in any engine, so that "random" choices can be checked and repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spread(x: Column) -> Column:
    """0 to 2**32 - 1: a multiplicative hash; the inner modulus keeps the product within 64 bits."""
    return (F.pmod(x.cast("bigint"), F.lit(2147483648)) * F.lit(2654435761)) % F.lit(4294967296)


def bucket(x: Column, k: int) -> Column:
    """0 to k - 1, from the high bits: the low ones repeat the parity of x."""
    return (F.floor(spread(x) / 65536) % k).cast("int")


def rank_key(*parts) -> Column:
    """A hexadecimal key whose order is a permutation fixed by the parts; literals are allowed."""
    return F.md5(F.concat_ws(",", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)))
