"""Performance and risk metrics.

Reducing metrics are aggregates: nulls are skipped and a NaN makes the result NaN.  Those that need
the order of rows (an equity's last value, drawdowns, ranks) take ``over``; within a panel they put
what they aggregate into a stage of window columns first (:meth:`Panel.metrics`).  Rolling metrics
are row by row.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..core import validate
from ..core.ieee import any_nan, as_double, clip, clip_high, clip_low, div, is_finite, log1p, missing, nan, normal_cdf
from ..core.over import Over, _columns

__all__ = [
    "adjusted_sharpe_ratio", "alpha", "alpha_rolling", "beta", "beta_rolling", "burke_ratio", "cagr", "cagr_rolling", "calmar_ratio",
    "capture_downside_ratio", "capture_ratio", "capture_upside_ratio", "common_sense_ratio", "conditional_drawdown_at_risk", "conditional_value_at_risk",
    "downside_deviation", "downside_deviation_rolling", "drawdown", "drawdown_rolling", "gain_to_pain_ratio", "information_ratio", "information_ratio_rolling",
    "kelly_criterion", "kurtosis", "kurtosis_rolling", "max_drawdown", "max_drawdown_duration", "modigliani_risk_adjusted_performance", "omega_ratio",
    "omega_ratio_rolling", "pain_index", "pain_ratio", "payoff_ratio", "probabilistic_sharpe_ratio", "profit_factor", "recovery_ratio", "risk_of_ruin",
    "sharpe_ratio", "sharpe_ratio_rolling", "skewness", "skewness_rolling", "sortino_ratio", "sortino_ratio_rolling", "stability", "sterling_ratio",
    "tail_ratio", "tail_ratio_rolling", "total_return", "total_return_rolling", "treynor_ratio", "treynor_ratio_rolling", "ulcer_index",
    "ulcer_performance_ratio", "value_at_risk", "value_at_risk_modified", "value_at_risk_parametric", "value_at_risk_rolling", "volatility",
    "volatility_rolling", "win_rate",
]


def _input(x: Column, over: Over | None) -> Column:
    """An aggregate's input; in a panel a column of its own, as it may hold windows."""
    x = as_double(x)
    return over.stage(x) if over is not None else x


def _poisoned(x: Column, value: Column) -> Column:
    return F.when(any_nan(x), nan()).otherwise(value)


def _spread(x: Column) -> Column:
    """Sample deviation; exactly 0 for equal values, null for one."""
    flat = (F.count(x) >= 2) & ~any_nan(x) & (F.min(x) == F.max(x))
    return F.when(flat, 0.0).otherwise(F.stddev_samp(x))


def _moment(x: Column, aggregate: Column) -> Column:
    """A standardised moment: NaN without spread, null without values."""
    undefined = any_nan(x) | (F.min(x) == F.max(x))
    return F.when(F.count(x) == 0, missing()).when(undefined, nan()).otherwise(aggregate)


def _standard(x: Column, over: Over | None) -> tuple[Column, Column]:
    """Population skewness and excess kurtosis.  In a panel they are taken of deviations from the mean
    in units of the largest, so that no power of a tiny spread vanishes; else Spark's own serve."""
    if over is None:
        return _moment(x, F.skewness(x)), _moment(x, F.kurtosis(x))
    off = over.stage(x - F.avg(x).over(over.group))
    z = over.stage(F.when(F.max(F.abs(off)).over(over.group) > 0, off / F.max(F.abs(off)).over(over.group)))
    second = F.avg(z * z)
    lost = F.pow(F.avg(off * off), F.lit(2.0)) == 0  # a spread below what doubles can square: undefined
    skew = F.when(lost, nan()).otherwise(F.avg(z * z * z) / F.pow(second, F.lit(1.5)))
    return _moment(x, skew), _moment(x, F.when(lost, nan()).otherwise(F.avg(z * z * z * z) / (second * second) - 3.0))


# Returns.


def volatility(returns: Column, *, periods_per_year: int, over: Over | None = None) -> Column:
    r = _input(returns, over)
    validate.periods(periods_per_year)
    return _spread(r) * math.sqrt(periods_per_year)


def downside_deviation(returns: Column, *, periods_per_year: int, threshold: float = 0.0, over: Over | None = None) -> Column:
    r = _input(returns, over)
    validate.periods(periods_per_year)
    validate.finite(threshold, "threshold")
    short = clip_high(r - threshold, 0.0)
    return F.sqrt(F.avg(short * short)) * math.sqrt(periods_per_year)


def skewness(returns: Column, *, over: Over | None = None) -> Column:
    return _standard(_input(returns, over), over)[0]


def kurtosis(returns: Column, *, over: Over | None = None) -> Column:
    """Excess, of the population."""
    return _standard(_input(returns, over), over)[1]


def win_rate(returns: Column, *, over: Over | None = None) -> Column:
    """Of the rows that won or lost."""
    r = _input(returns, over)
    wins, decisive = F.count(F.when(r > 0, 1)), F.count(F.when(r != 0, 1))
    return _poisoned(r, F.when(decisive == 0, missing()).otherwise(div(wins.cast("double"), decisive.cast("double"))))


def payoff_ratio(returns: Column, *, over: Over | None = None) -> Column:
    r = _input(returns, over)
    return _poisoned(r, div(F.avg(F.when(r > 0, r)), -F.avg(F.when(r < 0, r))))


def profit_factor(returns: Column, *, over: Over | None = None) -> Column:
    r = _input(returns, over)
    return div(F.avg(clip_low(r, 0.0)), F.avg(clip_low(-r, 0.0)))


def gain_to_pain_ratio(returns: Column, *, over: Over | None = None) -> Column:
    r = _input(returns, over)
    return div(F.avg(r), F.avg(clip_low(-r, 0.0)))


def omega_ratio(returns: Column, *, threshold: float = 0.0, over: Over | None = None) -> Column:
    r = _input(returns, over)
    validate.finite(threshold, "threshold")
    return div(F.avg(clip_low(r - threshold, 0.0)), F.avg(clip_low(-(r - threshold), 0.0)))


def kelly_criterion(returns: Column, *, over: Over | None = None) -> Column:
    p = win_rate(returns, over=over)
    return p - div(1.0 - p, payoff_ratio(returns, over=over))


def risk_of_ruin(returns: Column, *, over: Over | None = None) -> Column:
    r = _input(returns, over)
    p = win_rate(returns, over=over)
    return clip_high(F.pow(div(1.0 - p, p), F.count(r).cast("double")), 1.0)


def value_at_risk(returns: Column, *, confidence: float = 0.95, over: Over | None = None) -> Column:
    """The exact quantile, interpolated."""
    r = _input(returns, over)
    validate.confidence(confidence)
    return _poisoned(r, F.percentile(r, F.lit(1.0 - confidence)))


def value_at_risk_parametric(returns: Column, *, confidence: float = 0.95, over: Over | None = None) -> Column:
    r = _input(returns, over)
    validate.confidence(confidence)
    return F.avg(r) + NormalDist().inv_cdf(1.0 - confidence) * F.stddev_samp(r)


def value_at_risk_modified(returns: Column, *, confidence: float = 0.95, over: Over | None = None) -> Column:
    """Cornish-Fisher; NaN where the expansion is not monotone or changes sign."""
    r = _input(returns, over)
    validate.confidence(confidence)
    z = NormalDist().inv_cdf(1.0 - confidence)
    s, k = _standard(r, over)
    expanded = z + (z * z - 1.0) / 6.0 * s + (z**3 - 3.0 * z) / 24.0 * k - (2.0 * z**3 - 5.0 * z) / 36.0 * s * s
    slope = 1.0 + z / 3.0 * s + (z * z - 1.0) / 8.0 * k - (6.0 * z * z - 5.0) / 36.0 * s * s
    return F.when((slope <= 0.0) | (expanded * z < 0.0), nan()).otherwise(F.avg(r) + expanded * F.stddev_samp(r))


def _tail_mean(x: Column, confidence: float, over: Over) -> Column:
    """Mean of the worst (1 - confidence) of the values, the last one in part."""
    by_size = Window.partitionBy(*_columns(over.keys)) if over.keys else Window.partitionBy(F.lit(0))
    rank = over.stage(F.row_number().over(by_size.orderBy(x.asc_nulls_last())) - 1)
    size = over.stage(F.count(x).over(by_size))
    weight = F.when(x.isNotNull(), clip((1.0 - confidence) * size - rank, 0.0, 1.0))
    mean = div(F.sum(weight * x), F.sum(weight))
    return _poisoned(x, F.when(F.count(x) == 0, missing()).otherwise(mean))


def conditional_value_at_risk(returns: Column, *, confidence: float = 0.95, over: Over) -> Column:
    r = _input(returns, over)
    validate.confidence(confidence)
    return _tail_mean(r, confidence, over)


def tail_ratio(returns: Column, *, over: Over | None = None) -> Column:
    r = _input(returns, over)
    right, left = (F.percentile(r, F.lit(p)) for p in (0.95, 0.05))
    return _poisoned(r, F.abs(div(right, left)))


def common_sense_ratio(returns: Column, *, over: Over | None = None) -> Column:
    return profit_factor(returns, over=over) * tail_ratio(returns, over=over)


def sharpe_ratio(returns: Column, *, periods_per_year: int, risk_free_rate: float = 0.0, over: Over | None = None) -> Column:
    r = _input(returns, over)
    validate.periods(periods_per_year)
    excess = r - validate.period_rate(risk_free_rate, periods_per_year)
    return div(F.avg(excess) * periods_per_year, _spread(excess) * math.sqrt(periods_per_year))


def sortino_ratio(returns: Column, *, periods_per_year: int, risk_free_rate: float = 0.0, over: Over | None = None) -> Column:
    r = _input(returns, over)
    validate.periods(periods_per_year)
    free = validate.period_rate(risk_free_rate, periods_per_year)
    return div(F.avg(r - free) * periods_per_year, downside_deviation(r, periods_per_year=periods_per_year, threshold=free))


def adjusted_sharpe_ratio(returns: Column, *, periods_per_year: int, risk_free_rate: float = 0.0, over: Over | None = None) -> Column:
    """Sharpe with penalties for skew and heavy tails, applied a period and then annualised."""
    r = _input(returns, over)
    root = math.sqrt(periods_per_year) if periods_per_year >= 1 else 1.0
    s = sharpe_ratio(returns, periods_per_year=periods_per_year, risk_free_rate=risk_free_rate, over=over) / root
    skew, tails = _standard(r, over)
    return root * s * (1.0 + skew / 6.0 * s - tails / 24.0 * s * s)


def probabilistic_sharpe_ratio(returns: Column, *, periods_per_year: int, benchmark_sharpe: float = 0.0, risk_free_rate: float = 0.0, over: Over | None = None) -> Column:
    """Chance that the true Sharpe ratio (a period) exceeds the benchmark's."""
    r = _input(returns, over)
    validate.periods(periods_per_year)
    validate.finite(benchmark_sharpe, "benchmark_sharpe")
    excess = r - validate.period_rate(risk_free_rate, periods_per_year)
    s = div(F.avg(excess), _spread(excess))
    skew, tails = _standard(r, over)
    width = F.sqrt(1.0 - skew * s + (tails + 2.0) / 4.0 * s * s)
    return normal_cdf(div((s - benchmark_sharpe) * F.sqrt((F.count(r) - 1).cast("double")), width))


# Equity curves.


def drawdown(equity_curve: Column, *, over: Over) -> Column:
    """x / greatest so far - 1, row by row."""
    x = as_double(equity_curve)
    return div(x, over.running_max(x)) - 1.0


def drawdown_rolling(equity_curve: Column, window: int, *, over: Over) -> Column:
    x = as_double(equity_curve)
    validate.window(window)
    return div(x, over.max(x, window)) - 1.0


def _last(x: Column, over: Over) -> Column:
    return F.max_by(x, F.when(x.isNotNull(), F.struct(*_columns(over.order))))


def total_return(equity_curve: Column, *, over: Over) -> Column:
    x = _input(equity_curve, over)
    return _poisoned(x, _last(x, over) - 1.0)


def cagr(equity_curve: Column, *, periods_per_year: int, over: Over) -> Column:
    """Annual growth of a curve that starts from 1, over its known rows."""
    x = _input(equity_curve, over)
    validate.periods(periods_per_year)
    last = _last(x, over)
    growth = F.pow(last, div(F.lit(float(periods_per_year)), F.count(x).cast("double"))) - 1.0
    return F.when(any_nan(x) | (last <= 0), nan()).otherwise(growth)


def total_return_rolling(equity_curve: Column, window: int, *, over: Over) -> Column:
    x = as_double(equity_curve)
    validate.window(window, least=2)
    return div(x, over.lag(x, window - 1)) - 1.0


def cagr_rolling(equity_curve: Column, window: int, *, periods_per_year: int, over: Over) -> Column:
    x = as_double(equity_curve)
    validate.window(window, least=2)
    validate.periods(periods_per_year)
    ratio = div(x, over.lag(x, window - 1))
    return F.when(ratio <= 0, nan()).otherwise(F.pow(ratio, F.lit(periods_per_year / (window - 1))) - 1.0)


def _declines(x: Column, over: Over) -> Column:
    return over.stage(drawdown(x, over=over))


def max_drawdown(equity_curve: Column, *, over: Over) -> Column:
    x = _input(equity_curve, over)
    return _poisoned(x, F.min(_declines(x, over)))


def pain_index(equity_curve: Column, *, over: Over) -> Column:
    return F.avg(F.abs(_declines(_input(equity_curve, over), over)))


def ulcer_index(equity_curve: Column, *, over: Over) -> Column:
    d = _declines(_input(equity_curve, over), over)
    return F.sqrt(F.avg(d * d))


def max_drawdown_duration(equity_curve: Column, *, over: Over) -> Column:
    """Rows, among the known ones, of the longest run below the peak."""
    x = _input(equity_curve, over)
    d = _declines(x, over)
    under = over.stage(F.sum((d < 0).cast("long")).over(over.run))
    level = over.stage(F.max(F.when(d >= 0, under)).over(over.run))  # the count at the last peak
    return _poisoned(x, F.max(F.when(d.isNotNull(), under - F.coalesce(level, F.lit(0)))).cast("double"))


def conditional_drawdown_at_risk(equity_curve: Column, *, confidence: float = 0.95, over: Over) -> Column:
    x = _input(equity_curve, over)
    validate.confidence(confidence)
    return _poisoned(x, _tail_mean(_declines(x, over), confidence, over))


def stability(returns: Column, *, over: Over) -> Column:
    """R squared of the cumulative log return against time, over the known rows."""
    r = _input(returns, over)
    path = over.stage(over.running_sum(log1p(r)))
    place = over.stage(F.when(r.isNotNull(), (F.count(r).over(over.run) - 1).cast("double")))
    share = div(F.covar_pop(place, path), F.stddev_pop(place) * F.stddev_pop(path))
    flat = F.min(path) == F.max(path)
    return F.when(any_nan(r), nan()).when(F.count(r) < 2, missing()).when(flat, nan()).otherwise(clip_high(share * share, 1.0))


def burke_ratio(equity_curve: Column, *, periods_per_year: int, risk_free_rate: float = 0.0, over: Over) -> Column:
    """Over the root of the summed squares of each row's drawdown."""
    growth = cagr(equity_curve, periods_per_year=periods_per_year, over=over)
    validate.period_rate(risk_free_rate, periods_per_year)
    d = _declines(_input(equity_curve, over), over)
    return div(growth - risk_free_rate, F.sqrt(F.coalesce(F.sum(d * d), F.lit(0.0))))


def calmar_ratio(equity_curve: Column, *, periods_per_year: int, over: Over) -> Column:
    return div(cagr(equity_curve, periods_per_year=periods_per_year, over=over), F.abs(max_drawdown(equity_curve, over=over)))


def recovery_ratio(equity_curve: Column, *, over: Over) -> Column:
    return div(total_return(equity_curve, over=over), F.abs(max_drawdown(equity_curve, over=over)))


def _growth_over(equity_curve: Column, periods_per_year: int, risk_free_rate: float, over: Over) -> Column:
    growth = cagr(equity_curve, periods_per_year=periods_per_year, over=over)
    validate.period_rate(risk_free_rate, periods_per_year)
    return growth - risk_free_rate


def pain_ratio(equity_curve: Column, *, periods_per_year: int, risk_free_rate: float = 0.0, over: Over) -> Column:
    return div(_growth_over(equity_curve, periods_per_year, risk_free_rate, over), pain_index(equity_curve, over=over))


def sterling_ratio(equity_curve: Column, *, periods_per_year: int, risk_free_rate: float = 0.0, excess: float = 0.1, over: Over) -> Column:
    growth = _growth_over(equity_curve, periods_per_year, risk_free_rate, over)
    validate.positive(excess, "excess", zero=True)
    return div(growth, pain_index(equity_curve, over=over) + excess)


def ulcer_performance_ratio(equity_curve: Column, *, periods_per_year: int, risk_free_rate: float = 0.0, over: Over) -> Column:
    return div(_growth_over(equity_curve, periods_per_year, risk_free_rate, over), ulcer_index(equity_curve, over=over))


# Against a benchmark: a pair counts where both are known.


def _paired(returns: Column, benchmark: Column, over: Over | None) -> tuple[Column, Column]:
    """Both inputs, each null where the other is: aggregates of one then skip what those of the other skip."""
    r, b = _input(returns, over), _input(benchmark, over)
    return F.when(b.isNotNull(), r), F.when(r.isNotNull(), b)


def _two(pair: Column, value: Column) -> Column:
    return F.when(F.count(pair) < 2, missing()).otherwise(value)


def _slope(r: Column, b: Column) -> Column:
    flat = (F.min(b) == F.max(b)) & is_finite(F.max(b))
    return F.when(flat, nan()).otherwise(div(F.covar_pop(r, b), F.var_pop(b)))


def beta(returns: Column, benchmark: Column, *, over: Over | None = None) -> Column:
    r, b = _paired(returns, benchmark, over)
    return _two(r, _slope(r, b))


def alpha(returns: Column, benchmark: Column, *, periods_per_year: int, risk_free_rate: float = 0.0, over: Over | None = None) -> Column:
    """Jensen's, compounded to a year."""
    r, b = _paired(returns, benchmark, over)
    validate.periods(periods_per_year)
    free = validate.period_rate(risk_free_rate, periods_per_year)
    period = (F.avg(r) - free) - _slope(r, b) * (F.avg(b) - free)
    return _two(r, F.pow(1.0 + period, F.lit(float(periods_per_year))) - 1.0)


def treynor_ratio(returns: Column, benchmark: Column, *, periods_per_year: int, risk_free_rate: float = 0.0, over: Over | None = None) -> Column:
    r, b = _paired(returns, benchmark, over)
    validate.periods(periods_per_year)
    free = validate.period_rate(risk_free_rate, periods_per_year)
    return _two(r, div(F.avg(r - free) * periods_per_year, _slope(r, b)))


def information_ratio(returns: Column, benchmark: Column, *, periods_per_year: int, over: Over | None = None) -> Column:
    r, b = _paired(returns, benchmark, over)
    validate.periods(periods_per_year)
    active = r - b
    return _two(active, div(F.avg(active), _spread(active)) * math.sqrt(periods_per_year))


def modigliani_risk_adjusted_performance(returns: Column, benchmark: Column, *, periods_per_year: int, risk_free_rate: float = 0.0, over: Over | None = None) -> Column:
    """The Sharpe ratio at the benchmark's volatility, over the annual risk-free rate."""
    r, b = _paired(returns, benchmark, over)
    s = sharpe_ratio(r, periods_per_year=periods_per_year, risk_free_rate=risk_free_rate)
    return risk_free_rate + s * volatility(b, periods_per_year=periods_per_year)


def _capture(returns: Column, benchmark: Column, periods_per_year: int, up: bool, over: Over | None) -> Column:
    """Annual growth of the returns over the benchmark's, in periods that the benchmark rises (falls): a leg is
    one conditional mean of log growth.  No such period: null; one that loses all, or a NaN: NaN."""
    validate.periods(periods_per_year)
    pair = _paired(returns, benchmark, over)
    counted = pair[1] > 0 if up else pair[1] < 0
    lost = any_nan(pair[0]) | any_nan(pair[1])
    legs = []
    for x in pair:
        lost = lost | F.coalesce(F.max(counted & (x <= -1)), F.lit(False))
        legs.append(F.expm1(F.avg(F.when(counted & (x > -1), F.log1p(x))) * float(periods_per_year)))
    return F.when(lost, nan()).otherwise(div(*legs))


def capture_upside_ratio(returns: Column, benchmark: Column, *, periods_per_year: int, over: Over | None = None) -> Column:
    return _capture(returns, benchmark, periods_per_year, True, over)


def capture_downside_ratio(returns: Column, benchmark: Column, *, periods_per_year: int, over: Over | None = None) -> Column:
    return _capture(returns, benchmark, periods_per_year, False, over)


def capture_ratio(returns: Column, benchmark: Column, *, periods_per_year: int, over: Over | None = None) -> Column:
    return div(_capture(returns, benchmark, periods_per_year, True, over), _capture(returns, benchmark, periods_per_year, False, over))


# Rolling.


def volatility_rolling(returns: Column, window: int, *, periods_per_year: int, over: Over) -> Column:
    r = as_double(returns)
    validate.window(window, least=2)
    validate.periods(periods_per_year)
    return F.sqrt(over.variance(r, window, 1)) * math.sqrt(periods_per_year)


def downside_deviation_rolling(returns: Column, window: int, *, periods_per_year: int, threshold: float = 0.0, over: Over) -> Column:
    r = as_double(returns)
    validate.window(window)
    validate.periods(periods_per_year)
    validate.finite(threshold, "threshold")
    short = clip_high(r - threshold, 0.0)
    square = F.when(over.min(short, window) == 0, 0.0).otherwise(over.mean(short * short, window))
    return F.sqrt(square) * math.sqrt(periods_per_year)


def sharpe_ratio_rolling(returns: Column, window: int, *, periods_per_year: int, risk_free_rate: float = 0.0, over: Over) -> Column:
    r = as_double(returns)
    validate.window(window, least=2)
    validate.periods(periods_per_year)
    excess = r - validate.period_rate(risk_free_rate, periods_per_year)
    return div(over.mean_exact(excess, window) * periods_per_year, volatility_rolling(excess, window, periods_per_year=periods_per_year, over=over))


def sortino_ratio_rolling(returns: Column, window: int, *, periods_per_year: int, risk_free_rate: float = 0.0, over: Over) -> Column:
    r = as_double(returns)
    validate.window(window)
    validate.periods(periods_per_year)
    free = validate.period_rate(risk_free_rate, periods_per_year)
    down = downside_deviation_rolling(r, window, periods_per_year=periods_per_year, threshold=free, over=over)
    return div(over.mean_exact(r - free, window) * periods_per_year, down)


def omega_ratio_rolling(returns: Column, window: int, *, threshold: float = 0.0, over: Over) -> Column:
    r = as_double(returns)
    validate.window(window)
    validate.finite(threshold, "threshold")
    gain, loss = clip_low(r - threshold, 0.0), clip_low(-(r - threshold), 0.0)
    exact = lambda x: F.when(over.max(x, window) == 0, 0.0).otherwise(over.mean(x, window))
    return div(exact(gain), exact(loss))


def _rolling_moment(returns: Column, window: int, aggregate, over: Over) -> Column:
    r = as_double(returns)
    validate.window(window, least=2)
    flat = over.has_nan(r, window) | over.is_constant(r, window)
    return F.when(flat, nan()).when(over.max(r, window).isNotNull(), aggregate(r).over(over.last(window)))


def skewness_rolling(returns: Column, window: int, *, over: Over) -> Column:
    return _rolling_moment(returns, window, F.skewness, over)


def kurtosis_rolling(returns: Column, window: int, *, over: Over) -> Column:
    return _rolling_moment(returns, window, F.kurtosis, over)


def value_at_risk_rolling(returns: Column, window: int, *, confidence: float = 0.95, over: Over) -> Column:
    r = as_double(returns)
    validate.window(window)
    validate.confidence(confidence)
    return F.when(over.has_nan(r, window), nan()).otherwise(over.quantile(r, window, 1.0 - confidence))


def tail_ratio_rolling(returns: Column, window: int, *, over: Over) -> Column:
    r = as_double(returns)
    validate.window(window)
    return F.when(over.has_nan(r, window), nan()).otherwise(F.abs(div(over.quantile(r, window, 0.95), over.quantile(r, window, 0.05))))


def _slope_rolling(r: Column, b: Column, window: int, over: Over) -> Column:
    """Covariance over variance, both from centred sums: no digits cancel where means are large."""
    last = over.last(window)
    whole = F.count(r + b).over(last) == window
    top = over.max(b, window)
    flat = (top == over.min(b, window)) & is_finite(top)
    broken = over.has_nan(r, window) | over.has_nan(b, window)
    joint = F.when(broken, nan()).otherwise(F.covar_pop(r, b).over(last))
    return F.when(whole, F.when(flat, nan()).otherwise(div(joint, over.variance(b, window, 0))))


def beta_rolling(returns: Column, benchmark: Column, window: int, *, over: Over) -> Column:
    r, b = as_double(returns), as_double(benchmark)
    validate.window(window, least=2)
    return _slope_rolling(r, b, window, over)


def alpha_rolling(returns: Column, benchmark: Column, window: int, *, periods_per_year: int, risk_free_rate: float = 0.0, over: Over) -> Column:
    r, b = as_double(returns), as_double(benchmark)
    validate.window(window, least=2)
    validate.periods(periods_per_year)
    free = validate.period_rate(risk_free_rate, periods_per_year)
    period = (over.mean(r, window) - free) - _slope_rolling(r, b, window, over) * (over.mean(b, window) - free)
    return F.pow(1.0 + period, F.lit(float(periods_per_year))) - 1.0


def treynor_ratio_rolling(returns: Column, benchmark: Column, window: int, *, periods_per_year: int, risk_free_rate: float = 0.0, over: Over) -> Column:
    r, b = as_double(returns), as_double(benchmark)
    validate.window(window, least=2)
    validate.periods(periods_per_year)
    free = validate.period_rate(risk_free_rate, periods_per_year)
    return div(over.mean(r - free, window) * periods_per_year, _slope_rolling(r, b, window, over))


def information_ratio_rolling(returns: Column, benchmark: Column, window: int, *, periods_per_year: int, over: Over) -> Column:
    active = as_double(returns) - as_double(benchmark)
    validate.window(window, least=2)
    validate.periods(periods_per_year)
    return div(over.mean_exact(active, window) * periods_per_year, volatility_rolling(active, window, periods_per_year=periods_per_year, over=over))
