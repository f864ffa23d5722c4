"""Scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log1p_int(x: Column) -> Column:
    """ln(1 + x), cut to a whole number."""
    return F.log1p(x).cast("int")


def log_clean(x: Column, bad: float) -> Column:
    """ln(x + 1) where that is positive and finite, else `bad`."""
    y = F.log1p(x)
    return F.when((y > 0) & (y < float("inf")), y).otherwise(F.lit(bad))


def expm1_positive(x: Column) -> Column:
    """e**x - 1 where that is positive, else x."""
    return F.when(F.expm1(x) > 0, F.expm1(x)).otherwise(x)


def bins(length: Column, resolution: int) -> Column:
    """bins of a chromosome."""
    return F.floor(length / resolution) + 1


def unordered_key(a: Column, b: Column) -> Column:
    """one key for (a, b) and (b, a)."""
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def file_stem(prefix: str, vc: bool, log: bool, z: bool, kind: str, k: Column) -> Column:
    """name of a clustering by its settings."""
    return F.concat(F.lit("_".join([prefix, "vc" if vc else "weights", *(["log"] if log else []), *(["z"] if z else []), kind, "k"])), k.cast("string"))
