"""Sources: Parquet tables as market panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bars(ticks: DataFrame, keys: list[str], bar: str, price: str, order: list[str]) -> DataFrame:
    """Open, high, low, close and volume (rows) of each key and bar; one partial aggregation, no window."""
    at = F.struct(*order)
    return ticks.groupBy(*keys, bar).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").alias("volume")
    )


def event_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars of ``events`` by type, at 100 + value / 10."""
    ticks = table(spark, folder, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("bar"), (100.0 + F.col("value") / 10.0).alias("price"), "ts", "event_id")
    return bars(ticks, ["symbol"], "bar", "price", ["ts", "event_id"])


def market(spark: SparkSession, folder: str) -> DataFrame:
    """``event_bars`` numbered by ``t`` within a symbol, with the other lanes that studies take:
    returns, the mean return of all symbols in the bar as benchmark, equity, and positions."""
    rows = Window.partitionBy("symbol").orderBy("bar")
    df = event_bars(spark, folder).withColumn("t", F.row_number().over(rows).cast("bigint"))
    df = df.withColumn("returns", F.col("close") / F.lag("close").over(rows) - 1.0)
    mean = df.groupBy("bar").agg(F.avg("returns").alias("benchmark"))
    df = df.join(mean, "bar")
    run = Window.partitionBy("symbol").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("equity_curve", F.when(F.col("returns").isNotNull(), F.product(1.0 + F.col("returns")).over(run)))
    t = F.col("t")
    return df.select(
        "symbol", "t", "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"), "returns", "benchmark", "equity_curve",
        ((t % 7) / 3.0 - 1.0).alias("weight"), ((t % 5) * 10.0 - 20.0).alias("quantity"), ((t % 3) * 0.001).alias("cost"),
        F.lit(0.05).alias("dividend_per_share"), F.lit(0.0001).alias("funding_rate"),
    )
