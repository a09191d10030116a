"""Scalar expressions that graph construction needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between two places in degrees."""
    a, b = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(a), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(b), 2)
    return 2 * EARTH_METRES * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def clock_seconds(text: Column) -> Column:
    """Seconds of H:MM:SS, hours may pass 24; null for anything else."""
    p = F.split(F.trim(text), ":")
    value = p[0].cast("long") * 3600 + p[1].cast("long") * 60 + p[2].cast("long")
    return F.when(F.trim(text).rlike("^[0-9]+:[0-9]{1,2}:[0-9]{1,2}$"), value)


def geometric_bucket(distance: Column, alpha: float) -> Column:
    """The least k with alpha ^ k at least the distance; -1 for distances of 0 or less."""
    import math

    return F.when(distance <= 0, F.lit(-1).cast("long")).otherwise(F.ceil(F.log(distance) / math.log(alpha)))


def hash_priority(*keys: Column | str, seed: int | Column = 0) -> Column:
    """60 bits of a hash that any SQL engine can repeat: the first 15 hexadecimal digits of the MD5 of the keys and the seed, joined by bars."""
    return hash_digits(*keys, seed=seed)


def hash_digits(*keys: Column | str, seed: int | Column = 0, first: int = 1) -> Column:
    """The hexadecimal digits of hash_priority() from a place (1 to 15) on, as a number: the later it is, the less there is to convert."""
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", *(k.cast("string") for k in named), (F.lit(seed) if isinstance(seed, int) else seed).cast("string"))
    return F.conv(F.substring(F.md5(text), first, 16 - first), 16, 10).cast("long")


def bernoulli(p: float, *keys: Column | str, seed: int = 0) -> Column:
    """A repeatable coin of probability p for each key."""
    return hash_priority(*keys, seed=seed) % 1_000_000_007 < int(p * 1_000_000_007)


def uniform_weight(src: Column | str, dst: Column | str, most: int, seed: int = 0) -> Column:
    """A repeatable weight from 1 to most, the same in both directions."""
    return 1 + hash_priority(F.least(src, dst), F.greatest(src, dst), seed=seed) % most


def clusters_text(ids: Column | str) -> Column:
    return F.concat_ws(" ", F.transform(ids, lambda x: x.cast("string")))
