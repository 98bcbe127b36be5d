import datetime as dt

from furrow.streaming.panel import weekly_stream


def test_weeks_of_a_stream(spark, tmp_path):
    rows = [(dt.datetime(2025, 11, 3 + i, 12), "a", float(i)) for i in range(21)]
    spark.createDataFrame(rows, "ts timestamp, k string, v double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(f"{tmp_path}/in")
    q = weekly_stream(stream, "ts", "k", "v").writeStream.format("memory").queryName("weeks").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.week_start.date(), r.rows_week, r.v_sum_week) for r in spark.table("weeks").collect())
    assert got == [(dt.date(2025, 11, 3), 7, 21.0), (dt.date(2025, 11, 10), 7, 70.0), (dt.date(2025, 11, 17), 7, 119.0)]
