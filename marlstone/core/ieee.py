"""Column arithmetic with IEEE-754 results, where Spark SQL would raise or give null.

null (missing) and NaN (undefined) stay apart throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def as_double(column: Column) -> Column:
    """A numeric input as double; a bare column name is refused."""
    if not isinstance(column, Column):
        raise TypeError(f"expected a Spark Column, got {type(column).__name__}; pass F.col(\"<column>\"), not a bare column name")
    return column.cast("double")


def nan() -> Column:
    return F.lit(NAN)


def missing() -> Column:
    return F.lit(None).cast("double")


def div(n: Column, d: Column) -> Column:
    """n / d: x/0 is a signed infinity, 0/0 NaN, null null."""
    return F.when(d == 0, n * F.pow(d, F.lit(-1.0))).otherwise(n / d)


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, nan())


def log1p(x: Column) -> Column:
    return F.when(x > -1, F.log1p(x)).when(x == -1, F.lit(float("-inf"))).when(x < -1, nan())


def clip_low(x: Column, low: float) -> Column:
    """max(x, low); null and NaN pass."""
    return F.when(x < low, F.lit(float(low))).otherwise(x)


def clip_high(x: Column, high: float) -> Column:
    """min(x, high); null and NaN pass (NaN compares above all numbers)."""
    return F.when((x > high) & ~F.isnan(x), F.lit(float(high))).otherwise(x)


def clip(x: Column, low: float, high: float) -> Column:
    return clip_high(clip_low(x, low), high)


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def any_nan(x: Column) -> Column:
    """Aggregate: whether a group holds a NaN."""
    return F.coalesce(F.max(F.isnan(x) & x.isNotNull()), F.lit(False))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function: a power series near 0, a continued fraction beyond 3."""
    size = F.abs(x)
    density = F.exp(-size * size / 2.0) / F.lit((2.0 * 3.141592653589793) ** 0.5)
    start = F.struct(size.alias("term"), size.alias("total"))
    near = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), start,
        lambda s, k: F.struct((s["term"] * size * size / (2 * k + 1)).alias("term"), (s["total"] + s["term"] * size * size / (2 * k + 1)).alias("total")),
    )["total"]
    far = density / F.aggregate(F.sequence(F.lit(150), F.lit(1), F.lit(-1)), size, lambda s, k: size + k / s)
    upper = F.when(size <= 3.0, 0.5 - density * near).otherwise(far)
    return F.when(F.isnan(x), nan()).when(x > 40.0, F.lit(1.0)).when(x < -40.0, F.lit(0.0)).when(x >= 0, 1.0 - upper).otherwise(upper)
