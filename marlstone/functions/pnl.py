"""Profit-and-loss accounting: returns, positions, costs.  Row by row over Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core import validate
from ..core.ieee import as_double, clip_low, div, ln
from ..core.over import Over

__all__ = [
    "cost_borrow", "cost_fixed", "cost_funding", "cost_notional", "cost_per_share", "cost_proportional", "cost_slippage", "cumulative_pnl", "dividend",
    "equity_curve", "pnl_gross", "pnl_gross_inverse", "pnl_net", "returns_gross", "returns_log", "returns_net", "returns_simple", "turnover",
]


def returns_simple(expr: Column, *, over: Over) -> Column:
    """x / x[-1] - 1."""
    x = as_double(expr)
    return div(x, over.lag(x)) - 1.0


def returns_log(expr: Column, *, over: Over) -> Column:
    """ln(x / x[-1]); 0 gives -inf, a negative ratio NaN."""
    x = as_double(expr)
    return ln(div(x, over.lag(x)))


def cumulative_pnl(returns: Column, *, over: Over) -> Column:
    """Running sum; nulls are bridged, NaN stays."""
    return over.running_sum(as_double(returns))


def equity_curve(returns: Column, *, over: Over) -> Column:
    """Running product of 1 + r; nulls are bridged, NaN stays."""
    return over.running_product(1.0 + as_double(returns))


def dividend(quantity: Column, dividend_per_share: Column, *, over: Over | None = None) -> Column:
    return as_double(quantity) * as_double(dividend_per_share)


def pnl_gross(quantity: Column, price: Column, *, multiplier: float = 1.0, over: Over) -> Column:
    """Cash P&L of a linear contract held over the bar."""
    q, p = as_double(quantity), as_double(price)
    validate.positive(multiplier, "multiplier")
    return q * (p - over.lag(p)) * multiplier


def pnl_gross_inverse(quantity: Column, price: Column, *, multiplier: float = 1.0, over: Over) -> Column:
    """P&L of an inverse contract, in the base currency."""
    q, p = as_double(quantity), as_double(price)
    validate.positive(multiplier, "multiplier")
    one = F.lit(1.0)
    return q * multiplier * (div(one, over.lag(p)) - div(one, p))


def pnl_net(pnl_gross: Column, cost: Column, *, over: Over | None = None) -> Column:
    return as_double(pnl_gross) - as_double(cost)


def returns_gross(weight: Column, asset_returns: Column, *, over: Over | None = None) -> Column:
    return as_double(weight) * as_double(asset_returns)


def returns_net(returns_gross: Column, cost: Column, *, over: Over | None = None) -> Column:
    return as_double(returns_gross) - as_double(cost)


def turnover(weight: Column, *, over: Over) -> Column:
    """|w - w[-1]|; the first row is an entry from 0."""
    w = as_double(weight)
    return F.abs(w - over.lag(w, 1, 0.0))


def cost_borrow(quantity: Column, price: Column, *, rate: float, over: Over | None = None) -> Column:
    """Of short positions alone."""
    q, p = as_double(quantity), as_double(price)
    validate.positive(rate, "rate", zero=True)
    return clip_low(-q, 0.0) * p * rate


def cost_fixed(quantity: Column, *, fee: float, over: Over) -> Column:
    """A fee for each row that trades."""
    validate.positive(fee, "fee", zero=True)
    traded = turnover(quantity, over=over)
    return F.when(traded.isNull() | F.isnan(traded), traded).when(traded > 0.0, F.lit(float(fee))).otherwise(0.0)


def cost_funding(quantity: Column, price: Column, funding_rate: Column, *, over: Over | None = None) -> Column:
    return as_double(quantity) * as_double(price) * as_double(funding_rate)


def cost_notional(quantity: Column, price: Column, *, rate: float, over: Over) -> Column:
    validate.positive(rate, "rate", zero=True)
    return turnover(quantity, over=over) * as_double(price) * rate


def cost_per_share(quantity: Column, *, fee: float, over: Over) -> Column:
    validate.positive(fee, "fee", zero=True)
    return turnover(quantity, over=over) * fee


def cost_proportional(weight: Column, *, rate: float, over: Over) -> Column:
    validate.positive(rate, "rate", zero=True)
    return turnover(weight, over=over) * rate


def cost_slippage(weight: Column, *, half_spread: float, over: Over) -> Column:
    validate.positive(half_spread, "half_spread", zero=True)
    return turnover(weight, over=over) * half_spread
