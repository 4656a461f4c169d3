from semloom.streaming.validate import violation_counts


def test_counts_of_a_stream(spark, tmp_path):
    source, d = tmp_path / "in", "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{d}/events.parquet")
    events.write.parquet(str(source))
    stream = spark.readStream.schema(events.schema).parquet(str(source))
    out = violation_counts(stream, "event_id", "ts", {"event_type": "integer", "user_id": "integer"})
    q = out.writeStream.format("memory").queryName("violations").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("SELECT path, sum(n) AS n FROM violations GROUP BY path").collect()
    assert [tuple(r) for r in rows] == [("event_type", events.count())]
