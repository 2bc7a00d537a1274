"""Log ingest as a stream."""

from weftgraph.streaming import last_entries_stream, rates_stream, upsert_last

SCHEMA = "line_no long, output string, mtime long"


def test_last_entries(spark, tmp_path):
    source = tmp_path / "in"
    for k, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(3, "a", 2)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(source / f"p{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    q = last_entries_stream(stream).writeStream.format("memory").queryName("lasts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.output, r.line_no, r.mtime) for r in spark.table("lasts").collect()} == {("a", 3, 2), ("b", 2, 1)}
    to = str(tmp_path / "kept")
    q = stream.writeStream.foreachBatch(upsert_last(to)).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.output, r.line_no) for r in spark.read.parquet(f"{to}/v1").collect()} == {("a", 3), ("b", 2)}


def test_rates(spark, tmp_path):
    rows = spark.sql("select timestamp '2024-01-01 00:00:10' ts, 5L duration_ms union all select timestamp '2024-01-01 00:00:50', 7L union all select timestamp '2024-01-01 00:30:00', 1L")
    rows.write.parquet(str(tmp_path / "e"))
    q = rates_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.commands, r.duration_ms) for r in spark.table("rates").collect()) == [(1, 1), (2, 12)]
