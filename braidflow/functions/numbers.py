"""Column functions on numbers, durations and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds (nanoseconds) and names of the magnitude buckets.
MAGNITUDES = (
    (10**3, "<1us"), (10**4, "1us-10us"), (10**5, "10us-100us"), (10**6, "100us-1ms"), (10**7, "1ms-10ms"), (10**8, "10ms-100ms"), (10**9, "100ms-1s"),
    (5 * 10**9, "1s-5s"), (15 * 10**9, "5s-15s"), (30 * 10**9, "15s-30s"), (60 * 10**9, "30s-60s"), (120 * 10**9, "60s-120s"),
)
LARGEST = ">=120s"


def exact_sum(c: Column) -> Column:
    """Sum of whole numbers as a decimal of 30 digits, which 64 bits need not hold."""
    return F.sum(c.cast("decimal(20, 0)"))


def ladder(value: Column, bounds, last: str) -> Column:
    """Name of the first bound above ``value``."""
    out = F.lit(last)
    for bound, name in reversed(bounds):
        out = F.when(value < bound, name).otherwise(out)
    return out


def magnitude_bucket(ns: Column) -> Column:
    return ladder(ns, MAGNITUDES, LARGEST)


def signed_bucket(ns: Column) -> Column:
    return (
        F.when(ns < 0, F.concat(F.lit("negative:"), magnitude_bucket(-ns)))
        .when(ns == 0, "zero")
        .when(ns > 0, F.concat(F.lit("positive:"), magnitude_bucket(ns)))
    )


#: Upper bounds (exclusive) and names of payload lengths.
PAYLOADS = (
    (1, "0"), (16, "1-15"), (32, "16-31"), (64, "32-63"), (128, "64-127"), (256, "128-255"), (512, "256-511"), (1024, "512-1023"), (1500, "1024-1499"), (65536, "1500-65535"),
)
LONGEST = ">65535"


def payload_bucket(n: Column) -> Column:
    return ladder(n, PAYLOADS, LONGEST)


def candidate_bucket(n: Column) -> Column:
    return ladder(n, ((2, "1"), (3, "2"), (6, "3-5"), (11, "6-10"), (101, "11-100")), ">100")


def safe_divide(a: Column, b: Column) -> Column:
    """``a / b``, 0 where ``b`` is 0 or null."""
    return F.coalesce(F.when(b != 0, a / b), F.lit(0.0))


def rate(count: Column, age_us: Column, scale: float = 1e6) -> Column:
    """``count`` per second of a positive age; else 0."""
    return F.when(age_us > 0, count * scale / age_us).otherwise(0.0)


def finite_or_zero(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def float32(x: Column) -> Column:
    """``x`` as a float; null where it does not fit."""
    y = x.cast("float")
    return F.when(is_finite(y.cast("double")), y)


def strict_long(text: Column, most: int) -> Column:
    """Digits only and at most ``most``; else null."""
    value = text.try_cast("long")
    return F.when(F.rlike(text, F.lit("^[0-9]+$")) & (value <= most), value)


def time_block(ns: Column, width_ns: int) -> Column:
    return F.floor(ns / F.lit(width_ns)).cast("long")


def wilson_half_width(n: Column, z: float = 1.96) -> Column:
    """Worst-case half width of a share's interval."""
    return z / (2 * F.sqrt(n + z * z))
