"""Moving averages, price transforms and rolling statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...core import validate
from ...core.ieee import as_double, div, nan
from ...core.over import Over


def sma(expr: Column, window: int, *, over: Over) -> Column:
    """Mean of the last rows."""
    validate.window(window)
    return over.mean(as_double(expr), window)


def ema(expr: Column, window: int, *, adjust: bool = False, over: Over) -> Column:
    """Exponential mean, alpha = 2 / (n + 1): seeded with the mean of n observations or, with
    ``adjust``, corrected for the finite past."""
    x = as_double(expr)
    validate.window(window)
    if window == 1:
        return x
    alpha = 2.0 / (window + 1)
    if adjust:
        return over.kernel("weighted_mean", [x], ["y"], alpha=alpha, n=window)[0]
    return over.recursive_mean(x, alpha, window)


def rma(expr: Column, window: int, *, over: Over) -> Column:
    """Wilder's mean, alpha = 1 / n."""
    x = as_double(expr)
    validate.window(window)
    return x if window == 1 else over.recursive_mean(x, 1.0 / window, window)


def _cascade(x: Column, window: int, depth: int, adjust: bool, over: Over) -> list[Column]:
    """An exponential mean, the mean of that, and so on; one kernel pass in all."""
    out = []
    for _ in range(depth):
        alpha = 2.0 / (window + 1)
        if window > 1:
            kind = "weighted_mean" if adjust else "recursive_mean"
            x = over.kernel(kind, [x], ["y"], alpha=alpha, n=window)[0]
        out.append(x)
    return out


def dema(expr: Column, window: int, *, adjust: bool = False, over: Over) -> Column:
    x = as_double(expr)
    validate.window(window)
    one, two = _cascade(x, window, 2, adjust, over)
    return 2.0 * one - two


def tema(expr: Column, window: int, *, adjust: bool = False, over: Over) -> Column:
    x = as_double(expr)
    validate.window(window)
    one, two, three = _cascade(x, window, 3, adjust, over)
    return 3.0 * one - 3.0 * two + three


def t3(expr: Column, window: int, *, volume_factor: float = 0.7, adjust: bool = False, over: Over) -> Column:
    """Tillson's combination of six nested means."""
    x = as_double(expr)
    validate.window(window)
    validate.finite(volume_factor, "volume_factor")
    v = volume_factor
    means = _cascade(x, window, 6, adjust, over)
    weights = {6: -(v**3), 5: 3.0 * v**2 + 3.0 * v**3, 4: -6.0 * v**2 - 3.0 * v - 3.0 * v**3, 3: 1.0 + 3.0 * v + 3.0 * v**2 + v**3}
    total = None
    for depth, weight in weights.items():
        term = weight * means[depth - 1]
        total = term if total is None else total + term
    return total


def wma(expr: Column, window: int, *, over: Over) -> Column:
    """Linearly weighted mean, the latest row weighing most."""
    x = as_double(expr)
    validate.window(window)
    terms = x * float(window)
    for k in range(1, window):
        terms = terms + over.lag(x, k) * float(window - k)
    return terms / (window * (window + 1) / 2.0)


def hma(expr: Column, window: int, *, over: Over) -> Column:
    """Hull's average; half windows round half up."""
    x = as_double(expr)
    validate.window(window, least=2)
    half, root = (math.floor(v + 0.5) for v in (window / 2, math.sqrt(window)))
    return wma(2.0 * wma(x, half, over=over) - wma(x, window, over=over), root, over=over)


def trima(expr: Column, window: int, *, over: Over) -> Column:
    """Mean of means."""
    x = as_double(expr)
    validate.window(window)
    inner = (window + 1) // 2
    return over.mean(over.mean(x, inner), window - inner + 1)


def vwma(expr: Column, volume: Column, window: int, *, over: Over) -> Column:
    """Mean weighted by volume; a window without volume is NaN."""
    x, v = as_double(expr), as_double(volume)
    validate.window(window)
    weighted = over.sum(x * v, window)
    none = (over.max(F.abs(v), window) == 0) & weighted.isNotNull()
    return F.when(none, nan()).otherwise(div(weighted, over.sum(v, window)))


def kama(expr: Column, *, window: int, window_fast: int, window_slow: int, over: Over) -> Column:
    """Kaufman's adaptive mean: its speed follows the share of net in gross change."""
    x = as_double(expr)
    validate.window(window)
    validate.ordered(window_fast=window_fast, window_slow=window_slow)
    gross = over.sum(F.abs(over.diff(x)), window)
    share = F.when(gross == 0, 0.0).otherwise(div(F.abs(x - over.lag(x, window)), gross))
    fast, slow = 2.0 / (window_fast + 1), 2.0 / (window_slow + 1)
    speed = share * (fast - slow) + slow
    return over.kernel("adaptive_mean", [x, speed * speed], ["y"], n=window)[0]


def price_average(open: Column, high: Column, low: Column, close: Column, *, over: Over | None = None) -> Column:
    o, h, l, c = map(as_double, (open, high, low, close))
    return (o + h + l + c) / 4.0


def price_median(high: Column, low: Column, *, over: Over | None = None) -> Column:
    return (as_double(high) + as_double(low)) / 2.0


def price_typical(high: Column, low: Column, close: Column, *, over: Over | None = None) -> Column:
    return (as_double(high) + as_double(low) + as_double(close)) / 3.0


def price_weighted_close(high: Column, low: Column, close: Column, *, over: Over | None = None) -> Column:
    return (as_double(high) + as_double(low) + 2.0 * as_double(close)) / 4.0


def _slope(x: Column, window: int, over: Over) -> Column:
    """Least-squares slope by weights centred on the window, which don't cancel."""
    centre = (window - 1) / 2.0
    terms = centre * x
    for k in range(1, window):
        terms = terms + (centre - k) * over.lag(x, k)
    return terms / (window * (window * window - 1) / 12.0)


def linear_regression_slope(expr: Column, window: int, *, over: Over) -> Column:
    x = as_double(expr)
    validate.window(window, least=2)
    return _slope(x, window, over)


def linear_regression_angle(expr: Column, window: int, *, over: Over) -> Column:
    return F.degrees(F.atan(linear_regression_slope(expr, window, over=over)))


def _on_line(expr: Column, window: int, steps: float, over: Over) -> Column:
    """The regression line ``steps`` rows from the window's middle."""
    x = as_double(expr)
    validate.window(window, least=2)
    return over.mean(x, window) + _slope(x, window, over) * steps


def linear_regression(expr: Column, window: int, *, over: Over) -> Column:
    return _on_line(expr, window, (window - 1) / 2.0, over)


def linear_regression_intercept(expr: Column, window: int, *, over: Over) -> Column:
    return _on_line(expr, window, -(window - 1) / 2.0, over)


def time_series_forecast(expr: Column, window: int, *, over: Over) -> Column:
    return _on_line(expr, window, (window + 1) / 2.0, over)


def variance_rolling(expr: Column, window: int, *, ddof: int = 0, over: Over) -> Column:
    x = as_double(expr)
    validate.window(window)
    validate.ddof(ddof, window)
    return over.variance(x, window, ddof)


def standard_deviation_rolling(expr: Column, window: int, *, ddof: int = 0, over: Over) -> Column:
    return F.sqrt(variance_rolling(expr, window, ddof=ddof, over=over))


def _ewm_spread(expr: Column, window: int, adjust: bool, bias: bool, over: Over) -> list[Column]:
    x = as_double(expr)
    validate.window(window, least=2)
    return over.kernel("weighted_variance", [x], ["variance", "root"], alpha=2.0 / (window + 1), n=window, adjust=adjust, bias=bias)


def variance_ewma(expr: Column, window: int, *, adjust: bool = False, bias: bool = True, over: Over) -> Column:
    return _ewm_spread(expr, window, adjust, bias, over)[0]


def standard_deviation_ewma(expr: Column, window: int, *, adjust: bool = False, bias: bool = True, over: Over) -> Column:
    return _ewm_spread(expr, window, adjust, bias, over)[1]
