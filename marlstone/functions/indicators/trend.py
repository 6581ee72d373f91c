"""Volatility, direction, channels, trend states and cycles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...core import validate
from ...core.ieee import as_double, div, nan
from ...core.over import Over
from ...operators.kernels import CYCLE
from .averages import ema, price_median, rma, standard_deviation_rolling


def true_range(high: Column, low: Column, close: Column, *, over: Over) -> Column:
    """The largest of the range and the distances from the last close, as far as known."""
    h, l, c = map(as_double, (high, low, close))
    before = over.lag(c)
    return F.greatest(h - l, F.abs(h - before), F.abs(l - before))


def atr(high: Column, low: Column, close: Column, window: int, *, over: Over) -> Column:
    reach = true_range(high, low, close, over=over)
    validate.window(window)
    return rma(reach, window, over=over)


def atr_normalized(high: Column, low: Column, close: Column, window: int, *, over: Over) -> Column:
    return div(100.0 * atr(high, low, close, window, over=over), as_double(close))


def bollinger_bands(expr: Column, window: int, *, multiplier: float = 2.0, over: Over) -> Column:
    """struct(lower, middle, upper) by the population standard deviation."""
    x = as_double(expr)
    validate.window(window)
    validate.positive(multiplier, "multiplier")
    middle, width = over.mean(x, window), multiplier * standard_deviation_rolling(x, window, over=over)
    return F.struct((middle - width).alias("lower"), middle.alias("middle"), (middle + width).alias("upper"))


def _moves(high: Column, low: Column, over: Over) -> tuple[Column, Column]:
    """Raw directional movement; an unknown comparison is no movement."""
    h, l = as_double(high), as_double(low)
    up, down = h - over.lag(h), over.lag(l) - l
    return F.when((up > down) & (up > 0), up).otherwise(0.0), F.when((down > up) & (down > 0), down).otherwise(0.0)


def dm_plus(high: Column, low: Column, window: int, *, over: Over) -> Column:
    plus, _ = _moves(high, low, over)
    validate.window(window)
    return rma(plus, window, over=over)


def dm_minus(high: Column, low: Column, window: int, *, over: Over) -> Column:
    _, minus = _moves(high, low, over)
    validate.window(window)
    return rma(minus, window, over=over)


def di_plus(high: Column, low: Column, close: Column, window: int, *, over: Over) -> Column:
    return div(100.0 * dm_plus(high, low, window, over=over), atr(high, low, close, window, over=over))


def di_minus(high: Column, low: Column, close: Column, window: int, *, over: Over) -> Column:
    return div(100.0 * dm_minus(high, low, window, over=over), atr(high, low, close, window, over=over))


def dx(high: Column, low: Column, close: Column, window: int, *, over: Over) -> Column:
    """100 |DI+ - DI-| / (DI+ + DI-), within the kernel pass of its means."""
    lanes = dm_plus(high, low, window, over=over), dm_minus(high, low, window, over=over), atr(high, low, close, window, over=over)
    return over.kernel("directional_index", list(lanes), ["y"])[0]


def adx(high: Column, low: Column, close: Column, window: int, *, over: Over) -> Column:
    lane = dx(high, low, close, window, over=over)
    return lane if window == 1 else over.recursive_mean(lane, 1.0 / window, window)


def adxr(high: Column, low: Column, close: Column, window: int, *, over: Over) -> Column:
    """Mean of ADX and ADX ``window`` rows ago."""
    line = adx(high, low, close, window, over=over)
    return (line + over.lag(line, window)) / 2.0


def vortex(high: Column, low: Column, close: Column, window: int, *, over: Over) -> Column:
    """struct(plus, minus)."""
    h, l = as_double(high), as_double(low)
    validate.window(window)
    reach = true_range(high, low, close, over=over)

    def line(move: Column) -> Column:
        still = (over.max(reach, window) == 0) & (over.max(move, window) == 0)
        return F.when(still, nan()).otherwise(div(over.sum(move, window), over.sum(reach, window)))

    return F.struct(line(F.abs(h - over.lag(l))).alias("plus"), line(F.abs(l - over.lag(h))).alias("minus"))


def midpoint(expr: Column, window: int, *, over: Over) -> Column:
    x = as_double(expr)
    validate.window(window)
    return (over.max(x, window) + over.min(x, window)) / 2.0


def midprice(high: Column, low: Column, window: int, *, over: Over) -> Column:
    h, l = as_double(high), as_double(low)
    validate.window(window)
    return (over.max(h, window) + over.min(l, window)) / 2.0


def donchian_channels(high: Column, low: Column, window: int, *, over: Over) -> Column:
    """struct(lower, middle, upper)."""
    h, l = as_double(high), as_double(low)
    validate.window(window)
    top, bottom = over.max(h, window), over.min(l, window)
    return F.struct(bottom.alias("lower"), ((top + bottom) / 2.0).alias("middle"), top.alias("upper"))


def ichimoku(high: Column, low: Column, *, window_tenkan: int, window_kijun: int, window_senkou: int, over: Over) -> Column:
    """struct(tenkan, kijun, senkou_a, senkou_b), none displaced."""
    as_double(high), as_double(low)
    validate.ordered(window_tenkan=window_tenkan, window_kijun=window_kijun, window_senkou=window_senkou)
    tenkan, kijun, slow = (midprice(high, low, n, over=over) for n in (window_tenkan, window_kijun, window_senkou))
    return F.struct(tenkan.alias("tenkan"), kijun.alias("kijun"), ((tenkan + kijun) / 2.0).alias("senkou_a"), slow.alias("senkou_b"))


def keltner_channels(high: Column, low: Column, close: Column, *, window: int, window_atr: int, multiplier: float = 2.0, over: Over) -> Column:
    """struct(lower, middle, upper): an exponential mean and average true ranges about it."""
    for x in (high, low, close):
        as_double(x)
    validate.window(window)
    validate.window(window_atr, "window_atr")
    validate.positive(multiplier, "multiplier")
    middle, width = ema(close, window, over=over), multiplier * atr(high, low, close, window_atr, over=over)
    return F.struct((middle - width).alias("lower"), middle.alias("middle"), (middle + width).alias("upper"))


def parabolic_sar(high: Column, low: Column, *, acceleration: float = 0.02, maximum: float = 0.2, over: Over) -> Column:
    h, l = as_double(high), as_double(low)
    validate.fraction(acceleration, "acceleration")
    validate.fraction(maximum, "maximum")
    if acceleration > maximum:
        raise ValueError(f"acceleration must be <= maximum, got acceleration={acceleration}, maximum={maximum}")
    return over.kernel("stop_and_reverse", [h, l], ["y"], acceleration=acceleration, maximum=maximum)[0]


def supertrend(high: Column, low: Column, close: Column, window: int, *, multiplier: float = 3.0, over: Over) -> Column:
    """struct(line, direction)."""
    for x in (high, low, close):
        as_double(x)
    validate.window(window)
    validate.positive(multiplier, "multiplier")
    middle, width = price_median(high, low), multiplier * atr(high, low, close, window, over=over)
    line, direction = over.kernel("ratchet", [middle + width, middle - width, as_double(close)], ["line", "direction"])
    return F.struct(line.alias("line"), direction.alias("direction"))


def _cycle(expr: Column, over: Over, fast: float = 0.5, slow: float = 0.05) -> dict[str, Column]:
    """All lanes of the cycle kernel; it runs once for all studies of a series."""
    return dict(zip(CYCLE, over.kernel("cycle", [as_double(expr)], CYCLE, fast=fast, slow=slow), strict=True))


def dominant_cycle_period(expr: Column, *, over: Over) -> Column:
    return _cycle(expr, over)["period"]


def dominant_cycle_phase(expr: Column, *, over: Over) -> Column:
    return _cycle(expr, over)["phase"]


def hilbert_phasor(expr: Column, *, over: Over) -> Column:
    """struct(in_phase, quadrature)."""
    lanes = _cycle(expr, over)
    return F.struct(*(lanes[k].alias(k) for k in ("in_phase", "quadrature")))


def hilbert_trendline(expr: Column, *, over: Over) -> Column:
    return _cycle(expr, over)["trendline"]


def mama(expr: Column, *, limit_fast: float = 0.5, limit_slow: float = 0.05, over: Over) -> Column:
    """struct(mama, fama)."""
    as_double(expr)
    validate.fraction(limit_fast, "limit_fast")
    validate.fraction(limit_slow, "limit_slow")
    if limit_fast < limit_slow:
        raise ValueError(f"limit_fast must be >= limit_slow, got limit_fast={limit_fast}, limit_slow={limit_slow}")
    lanes = _cycle(expr, over, limit_fast, limit_slow)
    return F.struct(*(lanes[k].alias(k) for k in ("mama", "fama")))


def sine_wave(expr: Column, *, over: Over) -> Column:
    """struct(sine, lead_sine)."""
    lanes = _cycle(expr, over)
    return F.struct(*(lanes[k].alias(k) for k in ("sine", "lead_sine")))


def trend_mode(expr: Column, *, over: Over) -> Column:
    return _cycle(expr, over)["trend_mode"]
