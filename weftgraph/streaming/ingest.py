"""Build-log entries as a stream: the last entry of each output, and command rates over time.

An addition to what a build tool does with its log, with the same last-wins
rule; state is one row per output, partitioned by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_entries_stream(entries: DataFrame) -> DataFrame:
    """Of a stream (line_no, output, ...) the last entry per output; for output mode ``update`` or ``complete``."""
    others = [c for c in entries.columns if c not in ("output", "line_no")]
    last = entries.groupBy("output").agg(F.max("line_no").alias("line_no"), F.max_by(F.struct(*others), "line_no").alias("e"))
    return last.select("line_no", "output", *[F.col(f"e.{c}").alias(c) for c in others])


def rates_stream(finished: DataFrame, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Commands and their time per window of event time `ts`; entries later than `late` are left out."""
    return finished.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("commands"), F.sum("duration_ms").alias("duration_ms")).select(F.col("window.start").alias("start"), "commands", "duration_ms")


def upsert_last(path: str):
    """A ``foreachBatch`` sink that keeps the last entry of each output in Parquet below `path`; a batch that comes again changes nothing."""

    def run(batch: DataFrame, epoch: int) -> None:
        from ..sources.logs import last_entries

        spark = batch.sparkSession
        at = lambda k: f"{path}/v{k}"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
        before = epoch - 1
        while before >= 0 and not fs.exists(hadoop(f"{at(before)}/_SUCCESS")):
            before -= 1
        rows = batch if before < 0 else spark.read.schema(batch.schema).parquet(at(before)).unionByName(batch)
        last_entries(rows).write.mode("overwrite").parquet(at(epoch))
        old = before - 1
        if old >= 0:
            fs.delete(hadoop(at(old)), True)

    return run
