"""Logs as history: what outlives a change of the graph, durations, rates, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .._session import shuffled
from ..functions.status import predicted_share
from ..plans.graph import BuildGraph
from ..sources.logs import last_deps, last_entries


def durations(log: DataFrame) -> DataFrame:
    return log.withColumn("duration_ms", (F.col("end_ms") - F.col("start_ms")).cast("long"))


def dead_paths(g: BuildGraph, paths: DataFrame) -> DataFrame:
    """(path): those that nothing makes and that don't exist."""
    return paths.select("path").join(g.edge_outputs.select("path"), "path", "left_anti").join(g.files.where("mtime > 0").select("path"), "path", "left_anti")


def compact_build_log(g: BuildGraph, log: DataFrame) -> DataFrame:
    """The last entries of outputs that aren't dead."""
    kept = last_entries(log)
    return kept.join(dead_paths(g, kept.select(F.col("output").alias("path"))).select(F.col("path").alias("output")), "output", "left_anti").select(*log.columns)


def live_records(g: BuildGraph) -> DataFrame:
    """(path): outputs whose statement records dependencies."""
    return g.edge_outputs.join(g.edges.where("deps <> ''").select("edge_id"), "edge_id", "left_semi").select("path")


def compact_deps_log(g: BuildGraph, log: DataFrame) -> DataFrame:
    """The last records of live outputs, numbered anew in their old order."""
    kept = last_deps(log).join(live_records(g).select(F.col("path").alias("output")), "output", "left_semi")
    number = kept.select("rec_no").distinct().select("rec_no", (F.row_number().over(Window.orderBy("rec_no")) - 1).cast("long").alias("new"))
    return kept.join(number, "rec_no").withColumn("rec_no", F.col("new")).select(*log.columns)


def previous_elapsed(g: BuildGraph, log: DataFrame | None = None) -> DataFrame:
    """(edge_id, elapsed_ms): how long a statement took, by the first of its outputs that the log has; -1 if none."""
    log = durations(last_entries(log if log is not None else g.build_log)).select(F.col("output").alias("path"), "duration_ms")
    found = g.edge_outputs.join(shuffled(log), "path").groupBy("edge_id").agg(F.min_by("duration_ms", "pos").alias("elapsed_ms"))
    return g.edges.select("edge_id").join(shuffled(found), "edge_id", "left").select("edge_id", F.coalesce("elapsed_ms", F.lit(-1)).alias("elapsed_ms"))


def plan_totals(plan: DataFrame, edges: DataFrame, elapsed: DataFrame) -> DataFrame:
    """One row: commands of a plan with and without an earlier duration, and the sum of those."""
    rows = plan.join(shuffled(edges.where("not is_phony").select("edge_id")), "edge_id", "left_semi").join(shuffled(elapsed), "edge_id", "left")
    known = F.coalesce(F.col("elapsed_ms"), F.lit(-1)) >= 0
    return rows.agg(F.count("*").alias("total"), F.count_if(known).alias("predictable"), F.count_if(~known).alias("unpredictable"), F.coalesce(F.sum(F.when(known, F.col("elapsed_ms"))), F.lit(0)).alias("predictable_ms"))


def progress(finished: DataFrame, totals: DataFrame) -> DataFrame:
    """State after each finished command (seq, time_ms, duration_ms, elapsed_ms or -1): counts, sums and the predicted share.

    A running state is over all commands in order by definition; the input is
    one build's commands, not a corpus of builds (partition by build for those).
    """
    so_far = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return _progress(finished, totals, so_far)


def progress_by_build(finished: DataFrame, totals: DataFrame) -> DataFrame:
    """The same for many builds at once, told apart by `build`, in both tables."""
    so_far = Window.partitionBy("build").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return _progress(finished, totals, so_far, "build")


def _progress(finished: DataFrame, totals: DataFrame, so_far, key: str | None = None) -> DataFrame:
    known = F.col("elapsed_ms") >= 0
    rows = finished.withColumn("finished", F.count("*").over(so_far)).withColumn("cpu_ms", F.sum("duration_ms").over(so_far))
    rows = rows.withColumn("known_done", F.sum(known.cast("long")).over(so_far)).withColumn("known_done_ms", F.sum(F.when(known, F.col("elapsed_ms")).otherwise(0)).over(so_far))
    rows = rows.join(F.broadcast(totals), key) if key else rows.crossJoin(F.broadcast(totals))
    share = predicted_share(
        F.col("total"), F.col("finished"), F.col("time_ms"), F.col("cpu_ms"), F.col("predictable") - F.col("known_done"), F.col("predictable_ms") - F.col("known_done_ms"),
        F.col("predictable"), F.col("predictable_ms"), F.col("unpredictable") - (F.col("finished") - F.col("known_done")),
    )
    keys = [key] if key else []
    return rows.select(*keys, "seq", "time_ms", "finished", "total", "cpu_ms", share.alias("share"))


def current_rates(finished: DataFrame, n: int, key: str | None = None) -> DataFrame:
    """Commands per second over the last `n` that finished (seq, time_ms), -1 while unknown; where no time has passed the rate before stays."""
    w = (Window.partitionBy(key) if key else Window.partitionBy()).orderBy("seq")
    last = w.rowsBetween(-(n - 1), 0)
    span = F.max("time_ms").over(last) - F.min("time_ms").over(last)
    rate = F.when(span > 0, (F.count("*").over(last) - 1) / (span / 1e3))
    return finished.withColumn("now", rate).withColumn("rate", F.coalesce(F.last("now", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1.0))).drop("now")


def record_mtimes(results: DataFrame) -> DataFrame:
    """(edge_id, mtime): the time to log for a finished command, by rows (edge_id, start_ns, before, after, restat, generator) per output.

    The newest of the start and, for restat and generator rules or where the
    start is unknown (0), the outputs; the start alone if a restat command left
    an output as it was.
    """
    some = F.col("restat") | F.col("generator") | (F.col("start_ns") == 0)
    newest = F.max(F.when(some, F.greatest("start_ns", "after")).otherwise(F.col("start_ns")))
    same = F.bool_or(F.col("restat") & (F.col("before") == F.col("after")))
    return results.groupBy("edge_id").agg(F.when(same, F.max("start_ns")).otherwise(newest).alias("mtime"))


def build_summary(results: DataFrame) -> DataFrame:
    """One row: commands run and failed, their time, and the exit code of the last that failed (seq, code, duration_ms)."""
    return results.agg(
        F.count("*").alias("commands"), F.count_if(F.col("code") != 0).alias("failed"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("command_ms"),
        F.coalesce(F.max_by("code", F.when(F.col("code") != 0, F.col("seq"))), F.lit(0)).alias("exit_code"),
    )
