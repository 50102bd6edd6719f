"""Numeric column functions: coercion of anything to a finite number, clipping, rounding, VA-plane labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """A double, or null where the value is not a finite number."""
    x = as_column(c).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def number_or(c: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(finite(c), F.lit(float(default)))


def clip(c: Column | str, low: float, high: float) -> Column:
    """Between low and high; null stays null and NaN counts as null."""
    x = as_column(c)
    x = F.when(F.isnan(x), None).otherwise(x)
    return F.when(x.isNull(), None).otherwise(F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x)))


def clip01(c: Column | str) -> Column:
    return clip(F.coalesce(finite(c), F.lit(0.0)), 0, 1)


def decimals(c: Column | str, digits: int) -> Column:
    """Rounded as a double: its product with the power of ten goes to the nearest whole number, halves away from zero.

    F.round() rounds the shortest decimal text instead, so that 1 - 317 / 640 differs from C and DuckDB in the sixth place."""
    return F.round(as_column(c).cast("double") * float(10**digits)) / float(10**digits)


def r6(c: Column | str) -> Column:
    """Six decimals, without negative zero: the form in which doubles are compared across engines."""
    return decimals(c, 6) + F.lit(0.0)


def norm2(x: Column | str, y: Column | str) -> Column:
    x, y = as_column(x), as_column(y)
    return F.sqrt(x * x + y * y)


def quadrant(v: Column | str, a: Column | str, valid: Column | None = None, margin: float = 0.0, threshold: float = 0.5) -> Column:
    """0 to 3 for Q1 to Q4 (high is >= threshold), -1 where invalid or closer than margin to an axis."""
    v, a = as_column(v), as_column(a)
    high_v, high_a = v >= threshold, a >= threshold
    usable = v.isNotNull() & a.isNotNull()
    if valid is not None:
        usable &= valid
    if margin > 0:
        usable &= (F.abs(v - threshold) >= margin) & (F.abs(a - threshold) >= margin)
    label = F.when(high_v & high_a, 0).when(~high_v & high_a, 1).when(~high_v & ~high_a, 2).otherwise(3)
    return F.when(usable, label).otherwise(-1)


def hash_split(key: Column | str, seed: int, train: float = 0.70, val: float = 0.85) -> Column:
    """A stable split: the first 48 bits of SHA-256 of "key|seed" as a share of 1."""
    digest = F.sha2(F.concat(as_column(key).cast("string"), F.lit(f"|{seed}")).cast("binary"), 256)
    share = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)
    return F.when(share < train, "train").when(share < val, "val").otherwise("test")


def soft_weights(*distances: Column | str) -> list[Column]:
    """softmax of minus half the squared distances, stabilised; uniform where no distance is a number."""
    d = [finite(c) for c in distances]
    low = F.least(*d) if len(d) > 1 else d[0]
    e = [F.coalesce(F.exp(-0.5 * (x * x - low * low)), F.lit(0.0)) for x in d]
    total = sum(e[1:], e[0])
    return [F.when(total > 0, x / F.nullif(total, F.lit(0.0))).otherwise(1.0 / len(d)) for x in e]


def unit_rows(*columns: Column | str) -> list[Column]:
    """Columns over the row's length; a row of length 0 stays as it is."""
    x = [as_column(c) for c in columns]
    length = F.sqrt(sum((c * c for c in x[1:]), x[0] * x[0]))
    return [c / F.when(length > 0, length).otherwise(1.0) for c in x]
