"""Stable hashes of keys: the same bucket, split or order on every run and machine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stable_key(key: Column, seed: str) -> Column:
    """SHA-256 (hex) of ``seed:key``, a sort key that looks random."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256)


def stable_bucket(key: Column, seed: str, n: int) -> Column:
    """The first eight bytes of the hash as an unsigned number, modulo ``n``."""
    return (F.conv(F.substring(stable_key(key, seed), 1, 16), 16, 10).cast("decimal(20,0)") % n).cast("int")


def stable_sample(key: Column, seed: str, fraction: float) -> Column:
    """True for about ``fraction`` of the keys."""
    return F.conv(F.substring(stable_key(key, seed), 1, 16), 16, 10).cast("double") / float(2**64) < fraction


def split_of(bucket: Column) -> Column:
    """80 / 10 / 10 by a bucket of 100."""
    return F.when(bucket < 80, "train").when(bucket < 90, "val").otherwise("test")
