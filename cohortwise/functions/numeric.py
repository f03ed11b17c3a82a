"""Numeric column expressions. NULL is the only missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(col: Column) -> Column:
    """NaN and infinities become NULL."""
    c = col.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def to_number(col: Column) -> Column:
    """Parse text to a finite double, NULL when it is not one."""
    return finite(col.try_cast("double"))


def ratio(num: Column, den: Column) -> Column:
    """Guarded fraction: NULL when the denominator is zero or missing."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def rounded(col: Column, digits: int = 6) -> Column:
    """Round for reporting; values below the last digit print as plain zero."""
    c = col.cast("double")
    return F.when(F.abs(c) < 0.5 * 10.0**-digits, F.lit(0.0)).otherwise(F.round(c, digits))


def log2p1(col: Column) -> Column:
    return F.log2(col + F.lit(1.0))


def logit(prob: Column, eps: float = 1e-6) -> Column:
    """Log odds with the probability clipped away from 0 and 1."""
    p = F.least(F.greatest(prob.cast("double"), F.lit(eps)), F.lit(1.0 - eps))
    return F.log(p / (F.lit(1.0) - p))


def positive_part(col: Column) -> Column:
    return F.greatest(col, F.lit(0.0))


def negative_part(col: Column) -> Column:
    return F.greatest(-col, F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two equally long numeric arrays."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def hash_key(*parts: Column) -> Column:
    """Reproducible pseudo-random text key from a seed and identifiers."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


HASH_SPAN = 2**48


def hash_number(digest: Column) -> Column:
    """First 48 bits of a hex digest; keeps the digest's order."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")
