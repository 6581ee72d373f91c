"""One query for each of the 153 functions, at usual parameters, on the ``market`` panel; and the
flagship, a whole strategy report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indicators, metrics, pnl
from ..sources.bars import event_bars, market
from .panel import Panel

_O, _H, _L, _C, _V, _R, _B, _E, _Q = "open", "high", "low", "close", "volume", "returns", "benchmark", "equity_curve", "quantity"
_YEAR = {"periods_per_year": 252}

#: function -> (input columns, parameters)
INDICATORS: dict[str, tuple[tuple[str, ...], dict]] = {
    "absolute_price_oscillator": ((_C,), {"window_fast": 12, "window_slow": 26}),
    "accumulation_distribution": ((_H, _L, _C, _V), {}),
    "accumulation_distribution_oscillator": ((_H, _L, _C, _V), {"window_fast": 3, "window_slow": 10}),
    "adx": ((_H, _L, _C), {"window": 14}),
    "adxr": ((_H, _L, _C), {"window": 14}),
    "aroon": ((_H, _L), {"window": 25}),
    "aroon_oscillator": ((_H, _L), {"window": 25}),
    "atr": ((_H, _L, _C), {"window": 14}),
    "atr_normalized": ((_H, _L, _C), {"window": 14}),
    "awesome_oscillator": ((_H, _L), {"window_fast": 5, "window_slow": 34}),
    "balance_of_power": ((_O, _H, _L, _C), {}),
    "bollinger_bands": ((_C,), {"window": 20}),
    "cci": ((_H, _L, _C), {"window": 20}),
    "chaikin_money_flow": ((_H, _L, _C, _V), {"window": 20}),
    "chande_momentum_oscillator": ((_C,), {"window": 14}),
    "dema": ((_C,), {"window": 10}),
    "di_minus": ((_H, _L, _C), {"window": 14}),
    "di_plus": ((_H, _L, _C), {"window": 14}),
    "dm_minus": ((_H, _L), {"window": 14}),
    "dm_plus": ((_H, _L), {"window": 14}),
    "dominant_cycle_period": ((_C,), {}),
    "dominant_cycle_phase": ((_C,), {}),
    "donchian_channels": ((_H, _L), {"window": 20}),
    "dx": ((_H, _L, _C), {"window": 14}),
    "ema": ((_C,), {"window": 20}),
    "fisher_transform": ((_H, _L), {"window": 10}),
    "hilbert_phasor": ((_C,), {}),
    "hilbert_trendline": ((_C,), {}),
    "hma": ((_C,), {"window": 16}),
    "ichimoku": ((_H, _L), {"window_tenkan": 9, "window_kijun": 26, "window_senkou": 52}),
    "kama": ((_C,), {"window": 10, "window_fast": 2, "window_slow": 30}),
    "keltner_channels": ((_H, _L, _C), {"window": 20, "window_atr": 10}),
    "linear_regression": ((_C,), {"window": 14}),
    "linear_regression_angle": ((_C,), {"window": 14}),
    "linear_regression_intercept": ((_C,), {"window": 14}),
    "linear_regression_slope": ((_C,), {"window": 14}),
    "macd": ((_C,), {"window_fast": 12, "window_slow": 26, "window_signal": 9}),
    "mama": ((_C,), {}),
    "midpoint": ((_C,), {"window": 14}),
    "midprice": ((_H, _L), {"window": 14}),
    "mom": ((_C,), {"window": 10}),
    "money_flow_index": ((_H, _L, _C, _V), {"window": 14}),
    "obv": ((_C, _V), {}),
    "parabolic_sar": ((_H, _L), {}),
    "percentage_price_oscillator": ((_C,), {"window_fast": 12, "window_slow": 26}),
    "price_average": ((_O, _H, _L, _C), {}),
    "price_median": ((_H, _L), {}),
    "price_typical": ((_H, _L, _C), {}),
    "price_weighted_close": ((_H, _L, _C), {}),
    "rma": ((_C,), {"window": 14}),
    "roc": ((_C,), {"window": 10}),
    "rsi": ((_C,), {"window": 14}),
    "rsi_stochastic": ((_C,), {"window_rsi": 14, "window_k": 14, "window_d": 3}),
    "sine_wave": ((_C,), {}),
    "sma": ((_C,), {"window": 20}),
    "standard_deviation_ewma": ((_C,), {"window": 14}),
    "standard_deviation_rolling": ((_C,), {"window": 14}),
    "stochastic_fast": ((_H, _L, _C), {"window_k": 14, "window_d": 3}),
    "stochastic_slow": ((_H, _L, _C), {"window_k": 14, "window_slowing": 3, "window_d": 3}),
    "supertrend": ((_H, _L, _C), {"window": 10}),
    "t3": ((_C,), {"window": 5}),
    "tema": ((_C,), {"window": 10}),
    "time_series_forecast": ((_C,), {"window": 14}),
    "trend_mode": ((_C,), {}),
    "trima": ((_C,), {"window": 10}),
    "trix": ((_C,), {"window": 10}),
    "true_range": ((_H, _L, _C), {}),
    "ultimate_oscillator": ((_H, _L, _C), {"window_short": 7, "window_medium": 14, "window_long": 28}),
    "variance_ewma": ((_C,), {"window": 14}),
    "variance_rolling": ((_C,), {"window": 14, "ddof": 1}),
    "vortex": ((_H, _L, _C), {"window": 14}),
    "vwap": ((_H, _L, _C, _V), {}),
    "vwma": ((_C, _V), {"window": 20}),
    "williams_r": ((_H, _L, _C), {"window": 14}),
    "wma": ((_C,), {"window": 10}),
}

PNL: dict[str, tuple[tuple[str, ...], dict]] = {
    "cost_borrow": ((_Q, _C), {"rate": 0.0001}),
    "cost_fixed": ((_Q,), {"fee": 1.0}),
    "cost_funding": ((_Q, _C, "funding_rate"), {}),
    "cost_notional": ((_Q, _C), {"rate": 0.001}),
    "cost_per_share": ((_Q,), {"fee": 0.01}),
    "cost_proportional": (("weight",), {"rate": 0.001}),
    "cost_slippage": (("weight",), {"half_spread": 0.002}),
    "cumulative_pnl": ((_R,), {}),
    "dividend": ((_Q, "dividend_per_share"), {}),
    "equity_curve": ((_R,), {}),
    "pnl_gross": ((_Q, _C), {}),
    "pnl_gross_inverse": ((_Q, _C), {"multiplier": 1000.0}),
    "pnl_net": ((_Q, "cost"), {}),
    "returns_gross": (("weight", _R), {}),
    "returns_log": ((_C,), {}),
    "returns_net": ((_R, "cost"), {}),
    "returns_simple": ((_C,), {}),
    "turnover": (("weight",), {}),
}

METRICS: dict[str, tuple[tuple[str, ...], dict]] = {
    "adjusted_sharpe_ratio": ((_R,), _YEAR),
    "alpha": ((_R, _B), _YEAR),
    "alpha_rolling": ((_R, _B), {"window": 20, **_YEAR}),
    "beta": ((_R, _B), {}),
    "beta_rolling": ((_R, _B), {"window": 20}),
    "burke_ratio": ((_E,), _YEAR),
    "cagr": ((_E,), _YEAR),
    "cagr_rolling": ((_E,), {"window": 20, **_YEAR}),
    "calmar_ratio": ((_E,), _YEAR),
    "capture_downside_ratio": ((_R, _B), _YEAR),
    "capture_ratio": ((_R, _B), _YEAR),
    "capture_upside_ratio": ((_R, _B), _YEAR),
    "common_sense_ratio": ((_R,), {}),
    "conditional_drawdown_at_risk": ((_E,), {}),
    "conditional_value_at_risk": ((_R,), {}),
    "downside_deviation": ((_R,), _YEAR),
    "downside_deviation_rolling": ((_R,), {"window": 20, **_YEAR}),
    "drawdown": ((_E,), {}),
    "drawdown_rolling": ((_E,), {"window": 20}),
    "gain_to_pain_ratio": ((_R,), {}),
    "information_ratio": ((_R, _B), _YEAR),
    "information_ratio_rolling": ((_R, _B), {"window": 20, **_YEAR}),
    "kelly_criterion": ((_R,), {}),
    "kurtosis": ((_R,), {}),
    "kurtosis_rolling": ((_R,), {"window": 20}),
    "max_drawdown": ((_E,), {}),
    "max_drawdown_duration": ((_E,), {}),
    "modigliani_risk_adjusted_performance": ((_R, _B), {"risk_free_rate": 0.02, **_YEAR}),
    "omega_ratio": ((_R,), {}),
    "omega_ratio_rolling": ((_R,), {"window": 20}),
    "pain_index": ((_E,), {}),
    "pain_ratio": ((_E,), _YEAR),
    "payoff_ratio": ((_R,), {}),
    "probabilistic_sharpe_ratio": ((_R,), _YEAR),
    "profit_factor": ((_R,), {}),
    "recovery_ratio": ((_E,), {}),
    "risk_of_ruin": ((_R,), {}),
    "sharpe_ratio": ((_R,), {"risk_free_rate": 0.02, **_YEAR}),
    "sharpe_ratio_rolling": ((_R,), {"window": 20, **_YEAR}),
    "skewness": ((_R,), {}),
    "skewness_rolling": ((_R,), {"window": 20}),
    "sortino_ratio": ((_R,), _YEAR),
    "sortino_ratio_rolling": ((_R,), {"window": 20, **_YEAR}),
    "stability": ((_R,), {}),
    "sterling_ratio": ((_E,), _YEAR),
    "tail_ratio": ((_R,), {}),
    "tail_ratio_rolling": ((_R,), {"window": 20}),
    "total_return": ((_E,), {}),
    "total_return_rolling": ((_E,), {"window": 20}),
    "treynor_ratio": ((_R, _B), _YEAR),
    "treynor_ratio_rolling": ((_R, _B), {"window": 20, **_YEAR}),
    "ulcer_index": ((_E,), {}),
    "ulcer_performance_ratio": ((_E,), _YEAR),
    "value_at_risk": ((_R,), {}),
    "value_at_risk_modified": ((_R,), {}),
    "value_at_risk_parametric": ((_R,), {}),
    "value_at_risk_rolling": ((_R,), {"window": 20}),
    "volatility": ((_R,), _YEAR),
    "volatility_rolling": ((_R,), {"window": 20, **_YEAR}),
    "win_rate": ((_R,), {}),
}

FAMILIES = {"indicators": (indicators, INDICATORS), "pnl": (pnl, PNL), "metrics": (metrics, METRICS)}
DIGITS = 6
#: Added before rounding in both engines: prices have few decimals, so exact halves of the last digit
#: do occur, and there the engines' own last bits would decide.
NUDGE = 3.1e-8


def is_reducing(family: str, name: str) -> bool:
    return family == "metrics" and not name.endswith("_rolling") and name != "drawdown"


def _rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    """``value`` or, of a struct, its fields; rounded, so that two engines' last digits don't matter."""
    kind = df.schema["value"].dataType
    lanes = [(f"value.{f}", f) for f in kind.names] if kind.typeName() == "struct" else [("value", "value")]
    return df.select(*keys, *(F.round(F.col(c) + NUDGE, DIGITS).alias(n) for c, n in lanes))


def study(family: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    module, specs = FAMILIES[family]
    inputs, params = specs[name]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        panel = Panel(market(spark, folder), ["symbol"], ["t"])
        column = getattr(module, name)(*(F.col(c) for c in inputs), **params, over=panel)
        if is_reducing(family, name):
            return _rounded(panel.metrics(value=column), ["symbol"])
        return _rounded(panel.with_studies(value=column), ["symbol", "t"])

    return run


def strategy_report(spark: SparkSession, folder: str) -> DataFrame:
    """A trend strategy on hourly bars: signal, returns, costs, equity, and metrics of each symbol.

    Two exchanges in all: one builds the bars, one serves every window and the final aggregation.
    """
    df = event_bars(spark, folder).withColumnRenamed("bar", "t")
    panel = Panel(df, ["symbol"], ["t"])
    close = F.col("close")
    signal = (indicators.sma(close, 5, over=panel) > indicators.sma(close, 10, over=panel)).cast("double")
    df = panel.with_studies(asset=pnl.returns_simple(close, over=panel), weight=panel.lag(signal))
    panel = Panel(df, ["symbol"], ["t"])
    gross = pnl.returns_gross(F.col("weight"), F.col("asset"))
    df = panel.with_studies(net=pnl.returns_net(gross, pnl.cost_proportional(F.col("weight"), rate=0.001, over=panel)))
    panel = Panel(df, ["symbol"], ["t"])
    df = panel.with_studies(equity=pnl.equity_curve(F.col("net"), over=panel))
    panel = Panel(df, ["symbol"], ["t"])
    net, equity = F.col("net"), F.col("equity")
    out = panel.metrics(
        bars=F.count("*"), sharpe_ratio=metrics.sharpe_ratio(net, periods_per_year=252, over=panel),
        total_return=metrics.total_return(equity, over=panel), max_drawdown=metrics.max_drawdown(equity, over=panel),
    )
    return out.select("symbol", "bars", *(F.round(F.col(c) + NUDGE, DIGITS).alias(c) for c in ("sharpe_ratio", "total_return", "max_drawdown")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {"strategy_report": strategy_report}
    for family, (_, specs) in FAMILIES.items():
        out |= {f"{family}_{name}": study(family, name) for name in specs}
    return out
