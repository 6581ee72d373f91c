"""Bars of an unbounded stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(ticks: DataFrame, *, time: str, keys: list[str], price: str, width: str, lateness: str, order: list[str]) -> DataFrame:
    """Open, high, low, close and volume of each key and ``width`` of event time.

    Ticks later than ``lateness`` behind the latest time seen are dropped and a bar's state goes with
    them, so state is bounded by the keys and bars within the lateness.  Works on a batch as well.
    """
    at = F.struct(*order)
    out = ticks.withWatermark(time, lateness).groupBy(*keys, F.window(time, width).alias("bar"))
    out = out.agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").alias("volume"))
    return out.select(*keys, F.col("bar.start").alias("bar"), "open", "high", "low", "close", "volume")
