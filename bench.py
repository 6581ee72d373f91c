"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``many_studies`` evaluates forty studies in one plan, as a user of many functions would: Spark's fixed cost a
job far exceeds that of a study at this size.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import indicators, metrics, pnl
from marlstone.plans import queries as plans
from marlstone.plans.panel import Panel
from marlstone.sources.bars import market

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def _ticks(spark: SparkSession, folder: str) -> Panel:
    df = spark.read.parquet(f"{folder}/events.parquet").select("event_type", "event_id", (100.0 + F.col("value") / 10.0).alias("close"))
    return Panel(df, ["event_type"], ["event_id"])


def rolling_ticks(spark: SparkSession, folder: str) -> DataFrame:
    panel = _ticks(spark, folder)
    return panel.with_studies(value=indicators.sma(F.col("close"), 20, over=panel))


def recursive_ticks(spark: SparkSession, folder: str) -> DataFrame:
    panel, close = _ticks(spark, folder), F.col("close")
    return panel.with_studies(ema=indicators.ema(close, 20, over=panel), rsi=indicators.rsi(close, 14, over=panel), t3=indicators.t3(close, 5, over=panel))


def many_studies(spark: SparkSession, folder: str) -> DataFrame:
    panel = Panel(market(spark, folder), ["symbol"], ["t"])
    specs = list(plans.INDICATORS.items())[:40]
    return panel.with_studies(**{n: getattr(indicators, n)(*map(F.col, c), **p, over=panel) for n, (c, p) in specs})


def all_reducers(spark: SparkSession, folder: str) -> DataFrame:
    panel = Panel(market(spark, folder), ["symbol"], ["t"])
    specs = [(n, s) for n, s in plans.METRICS.items() if plans.is_reducing("metrics", n)]
    return panel.metrics(**{n: getattr(metrics, n)(*map(F.col, c), **p, over=panel) for n, (c, p) in specs})


def all_pnl(spark: SparkSession, folder: str) -> DataFrame:
    panel = Panel(market(spark, folder), ["symbol"], ["t"])
    return panel.with_studies(**{f"{n}_": getattr(pnl, n)(*map(F.col, c), **p, over=panel) for n, (c, p) in plans.PNL.items()})


QUERIES = {
    "strategy_report": plans.strategy_report, "rolling_ticks": rolling_ticks, "recursive_ticks": recursive_ticks, "many_studies": many_studies,
    "all_reducers": all_reducers, "all_pnl": all_pnl,
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name, query in QUERIES.items():
        times = []
        for _ in range(2):  # the first run compiles
            start = time.perf_counter()
            query(spark, FOLDER).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(min(times), 3)
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(FOLDER).removeprefix("sf")}))


if __name__ == "__main__":
    main()
