"""A stream of arrivals gives the counts of the batch."""

from conftest import SF

from tessera.streaming.arrivals import windowed_arrivals


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_type", "value")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = windowed_arrivals(stream).writeStream.format("memory").queryName("arrivals").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r["start"], r["event_type"], r["n"], round(r["total"], 6)) for r in df.collect())
    assert key(spark.table("arrivals")) == key(windowed_arrivals(batch))
