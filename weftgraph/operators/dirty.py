"""What is out of date, and why.

Three monotone passes instead of a walk over the graph: times seen through
phony statements (a small fixpoint), the verdict of each statement by itself
(joins and one aggregate), and the spread of verdicts downstream (closure).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._session import shuffled, stage, stage_counted
from ..plans.graph import BuildGraph, spliced
from .closure import _few, _like, _one_task, closure, newest_behind


@dataclass(frozen=True)
class Scan:
    """graph: with recorded dependencies spliced in; edges: edge_id, dirty, ready, deps_missing, reason; nodes: path, mtime, exists, dirty; links: src, dst between statements, written once."""

    graph: BuildGraph
    edges: DataFrame
    nodes: DataFrame
    local: DataFrame
    links: DataFrame


def recorded_inputs(g: BuildGraph) -> tuple[DataFrame, DataFrame]:
    """((edge_id, k, path) of valid recorded dependencies, (edge_id, reason) of statements whose record is missing or stale).

    A statement with a `deps` binding reads the deps log, by its first output;
    one with a depfile alone reads that.
    """
    first = g.edge_outputs.where("pos = 0").select("edge_id", F.col("path").alias("out"))
    mtime = g.files.select(F.col("path").alias("out"), F.col("mtime").alias("out_mtime"))
    by_log = g.edges.where("deps <> ''").select("edge_id").join(shuffled(first), "edge_id").join(shuffled(mtime), "out", "left").withColumn("out_mtime", F.coalesce("out_mtime", F.lit(0)))
    none = g.edges.select("edge_id", F.lit(0).alias("k"), F.lit("").alias("path")).limit(0)
    missing = F.concat(F.lit("deps for '"), "out", F.lit("' are missing"))
    if g.deps_log is None:
        extra, gone = none, by_log.select("edge_id", missing.alias("reason"))
    else:
        head = g.deps_log.groupBy(F.col("output").alias("out")).agg(F.max("mtime").alias("rec_mtime"))
        judged = by_log.join(shuffled(head), "out", "left")
        stale = F.concat(F.lit("stored deps info out of date for '"), "out", F.lit("' ("), "rec_mtime", F.lit(" vs "), "out_mtime", F.lit(")"))
        bad = F.when(F.col("rec_mtime").isNull(), missing).when(F.col("out_mtime") > F.col("rec_mtime"), stale)
        judged = judged.withColumn("reason", bad)
        good = judged.where("reason is null").select("edge_id", "out")
        extra = good.join(shuffled(g.deps_log.where("pos >= 0").select(F.col("output").alias("out"), F.col("pos").alias("k"), F.col("input").alias("path"))), "out").select("edge_id", "k", "path")
        gone = judged.where("reason is not null").select("edge_id", "reason")
    by_file = g.edges.where("deps = '' and depfile <> ''").select("edge_id", "depfile").join(shuffled(first), "edge_id")
    if g.depfiles is None:
        return extra, gone.unionByName(by_file.select("edge_id", F.concat(F.lit("depfile '"), "depfile", F.lit("' is missing")).alias("reason")))
    read = by_file.join(shuffled(g.depfiles.select(F.col("path").alias("depfile"), "outs", "ins")), "depfile", "left")
    absent = F.concat(F.lit("depfile '"), "depfile", F.lit("' is missing"))
    other = F.concat(F.lit("expected depfile '"), "depfile", F.lit("' to mention '"), "out", F.lit("', got '"), F.get("outs", F.lit(0)), F.lit("'"))
    read = read.withColumn("reason", F.when(F.col("outs").isNull() | (F.size("outs") == 0), absent).when(F.get("outs", F.lit(0)) != F.col("out"), other))
    extra = extra.unionByName(read.where("reason is null").select("edge_id", F.posexplode("ins").alias("k", "path")))
    return extra, gone.unionByName(read.where("reason is not null").select("edge_id", "reason"))


def depfile_errors(g: BuildGraph) -> DataFrame:
    """(edge_id, path): depfile targets beyond the first that the statement doesn't declare."""
    read = g.edges.where("deps = '' and depfile <> ''").select("edge_id", F.col("depfile").alias("path")).join(shuffled(g.depfiles), "path")
    return read.select("edge_id", F.explode(F.slice("outs", F.lit(2), F.greatest(F.size("outs") - 1, F.lit(0)))).alias("path")).join(shuffled(g.edge_outputs.select("edge_id", "path")), ["edge_id", "path"], "left_anti")


def seen_mtimes(g: BuildGraph) -> DataFrame:
    """(path, mtime): a missing output of a phony statement has the newest time among what stands behind it."""
    files = g.files.select("path", "mtime")
    phony = g.edges.where("is_phony").select("edge_id")
    hidden = g.edge_outputs.join(shuffled(phony), "edge_id").join(shuffled(files.select("path")), "path", "left_anti").select("edge_id", F.col("path").alias("out"))
    behind = hidden.join(shuffled(g.edge_inputs.where("kind <> 'order_only'").select("edge_id", "path")), "edge_id").select("out", "path").distinct()
    behind, n = stage_counted(behind, "phony")
    if not n:
        return files
    if _few(2 * n):
        links = behind.select(F.col("out").alias("src"), F.col("path").alias("dst"))
        own = files.join(shuffled(behind.select("path").distinct()), "path").select(F.col("path").alias("node"), F.col("mtime").alias("value"))
        return files.unionByName(stage(_one_task(links, own, _like("path", files, "path", "mtime"), newest_behind), "mtimes"))
    seen = stage(files, "mtimes")
    while True:  # times only grow, up to the newest there is
        now = behind.join(shuffled(seen), "path").groupBy(F.col("out").alias("path")).agg(F.max("mtime").alias("mtime")).where("mtime > 0")
        fresh, n = stage_counted(now.join(shuffled(seen), ["path", "mtime"], "left_anti"), "mtimes")
        if not n:
            return seen
        seen = stage(seen.join(shuffled(fresh.select("path")), "path", "left_anti").unionByName(fresh.select("path", "mtime")), "mtimes")


def newest_inputs(g: BuildGraph, seen: DataFrame) -> DataFrame:
    """(edge_id, newest, newest_path, n_inputs): the newest input that isn't order-only, the first of equals; n_inputs counts all."""
    real = F.col("kind") != "order_only"
    at = g.edge_inputs.join(shuffled(seen), "path", "left").withColumn("m", F.coalesce("mtime", F.lit(0)))
    best = F.max_by(F.struct("m", "path"), F.when(real, F.struct("m", -F.col("pos"))))
    return at.groupBy("edge_id").agg(best.alias("b"), F.count("*").alias("n_inputs"), F.count_if(real).alias("n_real")).select(
        "edge_id", "n_inputs", F.when(F.col("n_real") > 0, F.col("b.m")).alias("newest"), F.when(F.col("n_real") > 0, F.col("b.path")).alias("newest_path")
    )


def output_reason(has_log: bool) -> Column:
    """Why an output by itself is out of date, or null: the list of tests, the first that holds decides.

    Columns: is_phony, n_inputs, exists, path, restat, generator, mtime,
    newest, newest_path, command_hash; log_hash and log_mtime, null without an entry.
    """
    no_entry = F.col("log_mtime").isNull()
    old = F.col("newest").isNotNull() & (F.col("mtime") < F.col("newest"))
    tests = F.when(
        F.col("is_phony"),
        F.when((F.col("n_inputs") == 0) & ~F.col("exists"), F.concat(F.lit("output "), "path", F.lit(" of phony edge with no inputs doesn't exist"))),
    ).when(~F.col("exists"), F.concat(F.lit("output "), "path", F.lit(" doesn't exist")))
    tests = tests.when(
        ~(F.col("restat") & ~no_entry) & old,
        F.concat(F.lit("output "), "path", F.lit(" older than most recent input "), "newest_path", F.lit(" ("), "mtime", F.lit(" vs "), "newest", F.lit(")")),
    )
    if has_log:
        tests = tests.when(~no_entry & ~F.col("generator") & ~F.col("command_hash").eqNullSafe(F.col("log_hash")), F.concat(F.lit("command line changed for "), "path"))
        tests = tests.when(
            ~no_entry & F.col("newest").isNotNull() & (F.col("log_mtime") < F.col("newest")),
            F.concat(F.lit("recorded mtime of "), "path", F.lit(" older than most recent input "), "newest_path", F.lit(" ("), "log_mtime", F.lit(" vs "), "newest", F.lit(")")),
        )
        tests = tests.when(no_entry & ~F.col("generator"), F.concat(F.lit("command line not found in log for "), "path"))
    return tests


def local_reasons(g: BuildGraph, seen: DataFrame) -> DataFrame:
    """(edge_id, reason): statements out of date by their own files and log entries, by the first output that is."""
    edges = g.edges.join(shuffled(newest_inputs(g, seen)), "edge_id", "left").withColumn("n_inputs", F.coalesce("n_inputs", F.lit(0)))
    outs = g.edge_outputs.join(shuffled(g.files.select("path", "mtime")), "path", "left").withColumn("exists", F.col("mtime").isNotNull() & (F.col("mtime") > 0)).withColumn("mtime", F.coalesce("mtime", F.lit(0)))
    rows = outs.join(shuffled(edges), "edge_id")
    if g.build_log is None:
        rows = rows.withColumn("log_hash", F.lit(None).cast("string")).withColumn("log_mtime", F.lit(None).cast("long"))
    else:
        rows = rows.join(shuffled(g.build_log.select(F.col("output").alias("path"), F.col("hash").alias("log_hash"), F.col("mtime").alias("log_mtime"))), "path", "left")
    rows = rows.withColumn("reason", output_reason(g.build_log is not None))
    return rows.where("reason is not null").groupBy("edge_id").agg(F.min_by("reason", "pos").alias("reason"))


def scan(g: BuildGraph) -> Scan:
    """Judge every statement. `edges` of the graph needs command_hash when there is a build log."""
    g = g.staged()
    extra, gone = recorded_inputs(g)
    declared = g.edge_inputs
    g = g.with_(edge_inputs=stage(spliced(g.edge_inputs, extra), "inputs") if g.deps_log is not None or g.depfiles is not None else declared)
    seen = seen_mtimes(g)
    local = stage(local_reasons(g, seen).withColumn("missing", F.lit(False)).unionByName(gone.withColumn("missing", F.lit(True))), "local")
    here = local.groupBy("edge_id").agg(F.min_by("reason", ~F.col("missing")).alias("reason"), F.max("missing").alias("deps_missing"))
    # A leaf is dirty when it is missing.
    real = g.edge_inputs.where("kind <> 'order_only'")
    leaves = g.paths().join(shuffled(g.edge_outputs.select("path")), "path", "left_anti")
    absent = leaves.join(shuffled(g.files.where("mtime > 0").select("path")), "path", "left_anti")
    by_leaf = real.join(shuffled(absent), "path").select("edge_id")
    seeds = here.select(F.col("edge_id").alias("node")).unionByName(by_leaf.select(F.col("edge_id").alias("node")))
    # One table of links for both ways of spreading.
    makes, uses = g.edge_outputs.select("path", F.col("edge_id").alias("src")), g.edge_inputs.select("path", F.col("edge_id").alias("dst"), (F.col("kind") != "order_only").alias("real"))
    links = stage(makes.join(shuffled(uses), "path").groupBy("src", "dst").agg(F.bool_or("real").alias("real")), "links")
    dirty = stage(closure(seeds, links.where("real")), "dirty")
    counts = g.edge_inputs.groupBy("edge_id").agg(F.count("*").alias("n_inputs"))
    idle = g.edges.where("is_phony").join(shuffled(counts), "edge_id", "left_anti").select(F.col("edge_id").alias("node"))
    late = stage(closure(dirty.join(shuffled(idle), "node", "left_anti"), links), "late")
    edges = (
        g.edges.select("edge_id").join(shuffled(dirty.select(F.col("node").alias("edge_id"), F.lit(True).alias("dirty"))), "edge_id", "left")
        .join(shuffled(late.select(F.col("node").alias("edge_id"), F.lit(False).alias("ready"))), "edge_id", "left").join(shuffled(here), "edge_id", "left")
        .select("edge_id", F.coalesce("dirty", F.lit(False)).alias("dirty"), F.coalesce("ready", F.lit(True)).alias("ready"), F.coalesce("deps_missing", F.lit(False)).alias("deps_missing"), "reason")
    )
    edges = stage(edges, "scan")
    made = g.edge_outputs.join(shuffled(edges.where("dirty").select("edge_id")), "edge_id").select("path").unionByName(absent).withColumn("dirty", F.lit(True)).distinct()
    nodes = g.paths().join(shuffled(seen), "path", "left").join(shuffled(g.files.select("path", F.lit(True).alias("exists"))), "path", "left").join(shuffled(made), "path", "left")
    nodes = nodes.select("path", F.coalesce("mtime", F.lit(0)).alias("mtime"), F.coalesce("exists", F.lit(False)).alias("exists"), F.coalesce("dirty", F.lit(False)).alias("dirty"))
    return Scan(g, edges, nodes, local, links.select("src", "dst"))


def explanations(s: Scan) -> DataFrame:
    """(edge_id, seq, reason): recorded dependencies that fail first, then dirty inputs, then the statement's own reason if no input is dirty."""
    real = s.graph.edge_inputs.where("kind <> 'order_only'")
    by_input = real.join(shuffled(s.nodes.where("dirty").select("path")), "path").select("edge_id", (F.col("pos") + 1).alias("seq"), F.concat("path", F.lit(" is dirty")).alias("reason"))
    gone = s.local.where("missing").select("edge_id", F.lit(0).alias("seq"), "reason")
    own = s.local.where("not missing").join(shuffled(by_input.select("edge_id")), "edge_id", "left_anti").join(shuffled(gone.select("edge_id")), "edge_id", "left_anti").select("edge_id", F.lit(1).alias("seq"), "reason")
    return gone.unionByName(by_input).unionByName(own)


def dirty_with_validations(g: BuildGraph, targets: DataFrame) -> DataFrame:
    """(path): the targets and all validations that the statements behind them, and behind those, ask for."""
    needs = g.edge_outputs.select("edge_id", F.col("path").alias("src")).join(shuffled(g.edge_inputs.select("edge_id", F.col("path").alias("dst"))), "edge_id").select("src", "dst")
    checks = g.edge_outputs.select("edge_id", F.col("path").alias("src")).join(shuffled(g.edge_validations.select("edge_id", F.col("path").alias("dst"))), "edge_id").select("src", "dst")
    reach = closure(targets.select(F.col("path").alias("node")), needs.unionByName(checks))
    asked = reach.join(shuffled(checks.select(F.col("src").alias("node"), "dst")), "node").select(F.col("dst").alias("path"))
    return targets.select("path").unionByName(asked).distinct()
