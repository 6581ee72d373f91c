"""The frame of evaluation: which rows are a series and how they are ordered.

Spark has no row order, so each order-dependent function takes ``over``: partition keys and a
unique order.  Windows count rows; a window that touches a null is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .ieee import nan


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


class Over:
    """Rows of equal ``keys`` (none: all rows, in one task) in the order of ``order``."""

    def __init__(self, keys: Sequence[str | Column], order: Sequence[str | Column]) -> None:
        if not order:
            raise ValueError("an order is needed: Spark has no row order")
        self.keys, self.order = list(keys), list(order)
        self.group = Window.partitionBy(*_columns(keys)) if keys else Window.partitionBy(F.lit(0))
        self.rows = self.group.orderBy(*_columns(order))
        self.run = self.rows.rowsBetween(Window.unboundedPreceding, 0)

    # Stages: a plain frame composes windows; a panel may put a column into a stage of its own.
    def stage(self, column: Column) -> Column:
        return column

    def kernel(self, kind: str, inputs: Sequence[Column], lanes: Sequence[str], **params) -> list[Column]:
        raise TypeError(f"{kind} is sequential: evaluate it in a Panel (Panel.with_studies), not over a plain frame")

    # Rows.
    def lag(self, x: Column, n: int = 1, default: float | None = None) -> Column:
        return F.lag(x, n, default).over(self.rows) if n else x

    def diff(self, x: Column) -> Column:
        return x - self.lag(x)

    def last(self, n: int):
        return self.rows.rowsBetween(-(n - 1), 0)

    def _full(self, x: Column, n: int, aggregate: Column) -> Column:
        return F.when(F.count(x).over(self.last(n)) == n, aggregate.over(self.last(n)))

    def mean(self, x: Column, n: int) -> Column:
        return self._full(x, n, F.avg(x))

    def sum(self, x: Column, n: int) -> Column:
        return self._full(x, n, F.sum(x))

    def max(self, x: Column, n: int) -> Column:
        return self._full(x, n, F.max(x))

    def min(self, x: Column, n: int) -> Column:
        """NaN wins, as in every other rolling value; Spark's own minimum passes over it."""
        return F.when(F.isnan(self.max(x, n)), nan()).otherwise(self._full(x, n, F.min(x)))

    def quantile(self, x: Column, n: int, p: float) -> Column:
        return self._full(x, n, F.percentile(x, F.lit(p)))

    def has_nan(self, x: Column, n: int) -> Column:
        return F.isnan(self.max(x, n)) & self.max(x, n).isNotNull()

    def is_constant(self, x: Column, n: int) -> Column:
        """Bit-equal values alone; ask :meth:`has_nan` first."""
        return self.max(x, n) == self.min(x, n)

    def mean_exact(self, x: Column, n: int) -> Column:
        low = self.min(x, n)
        return F.when(self.max(x, n) == low, low).otherwise(self.mean(x, n))

    def variance(self, x: Column, n: int, ddof: int) -> Column:
        plain = self._full(x, n, F.var_samp(x) if ddof == 1 else F.var_pop(x))
        if ddof > 1:
            plain = plain * F.lit(n / (n - ddof))
        return F.when(self.has_nan(x, n), nan()).when(self.is_constant(x, n), 0.0).otherwise(plain)

    # Running values: a null row is null, the total goes on.
    def running_sum(self, x: Column) -> Column:
        return F.when(x.isNotNull(), F.sum(x).over(self.run))

    def running_product(self, x: Column) -> Column:
        return F.when(x.isNotNull(), F.product(x).over(self.run))

    def running_max(self, x: Column) -> Column:
        """The greatest number so far; NaN is passed over."""
        return F.max(F.when(~F.isnan(x), x)).over(self.run)

    # Recursions.
    def recursive_mean(self, x: Column, alpha: float, n: int) -> Column:
        return self.kernel("recursive_mean", [x], ["y"], alpha=alpha, n=n)[0]
