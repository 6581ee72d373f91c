from datetime import datetime, timedelta

from marlstone.streaming.bars import streaming_bars


def test_streaming_bars_equal_batch_bars(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=7 * i), i, "ab"[i % 2], 100.0 + i % 11) for i in range(200)]
    ticks = spark.createDataFrame(rows, "ts timestamp, id long, symbol string, price double")
    ticks.repartition(3).write.parquet(str(tmp_path / "ticks"))
    make = lambda df: streaming_bars(df, time="ts", keys=["symbol"], price="price", width="1 hour", lateness="30 days", order=["ts", "id"])
    stream = make(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks")))
    query = stream.writeStream.format("memory").queryName("bars").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(spark.table("bars").collect()) == sorted(make(ticks).collect())
    assert make(ticks).count() == 48
