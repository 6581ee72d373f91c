"""Momentum, stochastics and volume."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...core import validate
from ...core.ieee import as_double, clip, clip_low, div, is_finite, nan
from ...core.over import Over
from .averages import _cascade, ema, price_median, price_typical, rma


def mom(expr: Column, window: int, *, over: Over) -> Column:
    x = as_double(expr)
    validate.window(window)
    return x - over.lag(x, window)


def roc(expr: Column, window: int, *, over: Over) -> Column:
    x = as_double(expr)
    validate.window(window)
    past = over.lag(x, window)
    return div(100.0 * (x - past), past)


def absolute_price_oscillator(expr: Column, *, window_fast: int, window_slow: int, over: Over) -> Column:
    as_double(expr)
    validate.ordered(window_fast=window_fast, window_slow=window_slow)
    return ema(expr, window_fast, over=over) - ema(expr, window_slow, over=over)


def percentage_price_oscillator(expr: Column, *, window_fast: int, window_slow: int, over: Over) -> Column:
    as_double(expr)
    validate.ordered(window_fast=window_fast, window_slow=window_slow)
    slow = ema(expr, window_slow, over=over)
    return div(ema(expr, window_fast, over=over) - slow, slow) * 100.0


def macd(expr: Column, *, window_fast: int, window_slow: int, window_signal: int, over: Over) -> Column:
    """struct(macd, signal, histogram); all three recursions in one kernel pass."""
    as_double(expr)
    validate.window(window_signal, "window_signal")
    validate.ordered(window_fast=window_fast, window_slow=window_slow)
    fast, slow = (ema(expr, n, over=over) for n in (window_fast, window_slow))
    line = over.kernel("difference", [fast, slow], ["y"])[0]
    signal = ema_of_lane(line, window_signal, over)
    return F.struct(line.alias("macd"), signal.alias("signal"), (line - signal).alias("histogram"))


def ema_of_lane(lane: Column, window: int, over: Over) -> Column:
    """ema of a kernel's lane, left as it is so that the planner chains the two."""
    return lane if window == 1 else over.recursive_mean(lane, 2.0 / (window + 1), window)


def trix(expr: Column, window: int, *, over: Over) -> Column:
    """Change, in percent, of a triple exponential mean."""
    x = as_double(expr)
    validate.window(window)
    return roc(_cascade(x, window, 3, False, over)[2], 1, over=over)


def rsi(expr: Column, window: int, *, over: Over) -> Column:
    x = as_double(expr)
    validate.window(window)
    change = over.diff(x)
    gain, loss = (rma(clip_low(c, 0.0), window, over=over) for c in (change, -change))
    return 100.0 - div(F.lit(100.0), 1.0 + div(gain, loss))


def rsi_stochastic(expr: Column, *, window_rsi: int, window_k: int, window_d: int, over: Over) -> Column:
    """struct(k, d): where RSI stands in its range."""
    as_double(expr)
    for name, n in (("window_rsi", window_rsi), ("window_k", window_k), ("window_d", window_d)):
        validate.window(n, name)
    strength = rsi(expr, window_rsi, over=over)
    low = over.min(strength, window_k)
    k = div(100.0 * (strength - low), over.max(strength, window_k) - low)
    return F.struct(k.alias("k"), over.mean(k, window_d).alias("d"))


def aroon(high: Column, low: Column, window: int, *, over: Over) -> Column:
    """struct(up, down): how recent the extremes of n + 1 rows are; of equal ones the latest counts."""
    h, l = as_double(high), as_double(low)
    validate.window(window)
    place = F.row_number().over(over.rows).cast("double")
    frame = over.last(window + 1)
    full_h, full_l = over.max(h, window + 1), over.min(l, window + 1)
    at_high = F.max(F.struct(h.alias("v"), place.alias("p"))).over(frame)["p"]
    at_low = -F.min(F.struct(l.alias("v"), (-place).alias("p"))).over(frame)["p"]

    def score(full: Column, at: Column) -> Column:
        return F.when(full.isNull(), full).when(F.isnan(full), nan()).otherwise(100.0 * (window - (place - at)) / float(window))

    return F.struct(score(full_h, at_high).alias("up"), score(full_l, at_low).alias("down"))


def aroon_oscillator(high: Column, low: Column, window: int, *, over: Over) -> Column:
    both = aroon(high, low, window, over=over)
    return both["up"] - both["down"]


def awesome_oscillator(high: Column, low: Column, *, window_fast: int, window_slow: int, over: Over) -> Column:
    middle = price_median(high, low)
    validate.ordered(window_fast=window_fast, window_slow=window_slow)
    return over.mean(middle, window_fast) - over.mean(middle, window_slow)


def balance_of_power(open: Column, high: Column, low: Column, close: Column, *, over: Over | None = None) -> Column:
    o, h, l, c = map(as_double, (open, high, low, close))
    return F.when(h - l == 0, 0.0).otherwise(div(c - o, h - l))


def cci(high: Column, low: Column, close: Column, window: int, *, over: Over) -> Column:
    """Distance from the mean in mean absolute deviations about the window's own mean."""
    typical = price_typical(high, low, close)
    validate.window(window)
    mean = over.mean(typical, window)
    values = F.collect_list(typical).over(over.last(window))
    spread = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.abs(v - mean)) / float(window)
    flat = over.is_constant(typical, window)
    return F.when(mean.isNull(), mean).when(flat, nan()).otherwise(div(typical - mean, 0.015 * spread))


def chande_momentum_oscillator(expr: Column, window: int, *, over: Over) -> Column:
    x = as_double(expr)
    validate.window(window)
    change = over.diff(x)
    gain, loss = (over.sum(clip_low(c, 0.0), window) for c in (change, -change))
    flat = over.max(F.abs(change), window) == 0
    return F.when(flat, nan()).otherwise(clip(div(100.0 * (gain - loss), gain + loss), -100.0, 100.0))


def fisher_transform(high: Column, low: Column, window: int, *, over: Over) -> Column:
    """struct(fisher, signal); the signal is the row before's."""
    price = price_median(high, low)
    validate.window(window)
    bottom = over.min(price, window)
    place = 2.0 * div(price - bottom, over.max(price, window) - bottom) - 1.0
    line, signal = over.kernel("fisher", [place], ["fisher", "signal"])
    return F.struct(line.alias("fisher"), signal.alias("signal"))


def ultimate_oscillator(high: Column, low: Column, close: Column, *, window_short: int, window_medium: int, window_long: int, over: Over) -> Column:
    h, l, c = map(as_double, (high, low, close))
    validate.ordered(window_short=window_short, window_medium=window_medium, window_long=window_long)
    before = over.lag(c)
    bottom, top = F.least(l, before), F.greatest(h, before)
    pressure, reach = c - bottom, top - bottom

    def share(n: int) -> Column:
        nothing = (over.max(reach, n) == 0) & (over.max(F.abs(pressure), n) == 0)
        return F.when(nothing, nan()).otherwise(div(over.sum(pressure, n), over.sum(reach, n)))

    return 100.0 * (4.0 * share(window_short) + 2.0 * share(window_medium) + share(window_long)) / 7.0


def williams_r(high: Column, low: Column, close: Column, window: int, *, over: Over) -> Column:
    h, l, c = map(as_double, (high, low, close))
    validate.window(window)
    top = over.max(h, window)
    return div(-100.0 * (top - c), top - over.min(l, window))


def _raw_k(high: Column, low: Column, close: Column, n: int, over: Over) -> Column:
    h, l, c = map(as_double, (high, low, close))
    bottom = over.min(l, n)
    return div(100.0 * (c - bottom), over.max(h, n) - bottom)


def stochastic_fast(high: Column, low: Column, close: Column, *, window_k: int, window_d: int, over: Over) -> Column:
    """struct(k, d): where the close stands in the range, and its mean."""
    for x in (high, low, close):
        as_double(x)
    validate.window(window_k, "window_k")
    validate.window(window_d, "window_d")
    k = _raw_k(high, low, close, window_k, over)
    return F.struct(k.alias("k"), over.mean(k, window_d).alias("d"))


def stochastic_slow(high: Column, low: Column, close: Column, *, window_k: int, window_slowing: int, window_d: int, over: Over) -> Column:
    for x in (high, low, close):
        as_double(x)
    for name, n in (("window_k", window_k), ("window_slowing", window_slowing), ("window_d", window_d)):
        validate.window(n, name)
    k = over.mean(_raw_k(high, low, close, window_k, over), window_slowing)
    return F.struct(k.alias("k"), over.mean(k, window_d).alias("d"))


def _flow(high: Column, low: Column, close: Column, volume: Column) -> Column:
    h, l, c, v = map(as_double, (high, low, close, volume))
    return F.when(h - l == 0, 0.0).otherwise(div((c - l) - (h - c), h - l)) * v


def accumulation_distribution(high: Column, low: Column, close: Column, volume: Column, *, over: Over) -> Column:
    return over.running_sum(_flow(high, low, close, volume))


def accumulation_distribution_oscillator(high: Column, low: Column, close: Column, volume: Column, *, window_fast: int, window_slow: int, over: Over) -> Column:
    line = accumulation_distribution(high, low, close, volume, over=over)
    validate.ordered(window_fast=window_fast, window_slow=window_slow)
    return ema(line, window_fast, over=over) - ema(line, window_slow, over=over)


def chaikin_money_flow(high: Column, low: Column, close: Column, volume: Column, window: int, *, over: Over) -> Column:
    validate.window(window)
    v = as_double(volume)
    flow = over.sum(_flow(high, low, close, volume), window)
    none = (over.max(F.abs(v), window) == 0) & flow.isNotNull()
    return F.when(none, nan()).otherwise(clip(div(flow, over.sum(v, window)), -1.0, 1.0))


def money_flow_index(high: Column, low: Column, close: Column, volume: Column, window: int, *, over: Over) -> Column:
    """An RSI of typical price times volume, over windowed sums."""
    typical = price_typical(high, low, close)
    validate.window(window)
    change, flow = over.diff(typical), typical * as_double(volume)

    def side(up: bool) -> Column:
        with_it, against = (change > 0.0, change <= 0.0) if up else (change < 0.0, change >= 0.0)
        return over.sum(F.when(F.isnan(change), nan()).when(with_it, flow).when(against, 0.0), window)

    index = 100.0 - div(F.lit(100.0), 1.0 + div(side(True), side(False)))
    still = over.max(F.abs(change), window) == 0
    no_fall, no_rise = (over.max(clip_low(c, 0.0), window) == 0 for c in (-change, change))
    return F.when(still, nan()).when(no_fall & is_finite(index), 100.0).when(no_rise & is_finite(index), 0.0).otherwise(clip(index, 0.0, 100.0))


def obv(expr: Column, volume: Column, *, over: Over) -> Column:
    """Volume added with the sign of the change; no change is known for the first row: 0."""
    x, v = as_double(expr), as_double(volume)
    return over.running_sum(F.coalesce(F.signum(over.diff(x)), F.lit(0.0)) * v)


def vwap(high: Column, low: Column, close: Column, volume: Column, *, over: Over) -> Column:
    """Anchored at the series' start; put a session into the keys to anchor there."""
    v = as_double(volume)
    weighted = price_typical(high, low, close) * v
    return div(over.running_sum(weighted), over.running_sum(F.when(weighted.isNotNull(), v)))
