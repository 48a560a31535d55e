import datetime as dt

from trellisq.streaming.transitions import hourly_counts, stream_table

EVENTS = "ts timestamp, event_type string, value double"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(dt.datetime(2025, 1, 1, h, m), t, v) for h in range(5) for m, t, v in ((1, "a", 1.0), (30, "b", None), (59, "a", 3.0))]
    df = spark.createDataFrame(rows, EVENTS)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = hourly_counts(stream_table(spark, str(tmp_path / "in"), df.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hours").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(map(tuple, spark.table("hours").collect()))
    assert got == sorted(map(tuple, hourly_counts(df).collect())) and len(got) == 10
