"""What a clean-up removes. Results are lists of paths; `removable` says which of them are there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import BuildGraph
from .tools import producers


def _side_files(edges: DataFrame) -> DataFrame:
    """(path) of depfiles and response files."""
    return edges.select(F.explode(F.array("depfile", "rspfile")).alias("path")).where("path <> ''")


def clean_all(g: BuildGraph, generator: bool = False) -> DataFrame:
    """(path): outputs and side files of all commands; generated manifests stay unless `generator`."""
    edges = g.edges.where("not is_phony") if generator else g.edges.where("not is_phony and not generator")
    outs = g.edge_outputs.join(edges.select("edge_id"), "edge_id", "left_semi").select("path")
    return outs.unionByName(_side_files(edges)).distinct()


def clean_targets(g: BuildGraph, targets: DataFrame) -> DataFrame:
    """(path): what is built on the way to targets. Of a statement with several outputs only those that are used go."""
    behind = producers(g, targets)
    met = targets.select("path").unionByName(g.edge_inputs.join(behind, "edge_id", "left_semi").select("path")).distinct()
    real = g.edges.where("not is_phony").join(behind, "edge_id", "left_semi")
    outs = g.edge_outputs.join(real.select("edge_id"), "edge_id", "left_semi").join(met, "path", "left_semi").select("path")
    return outs.unionByName(_side_files(real)).distinct()


def clean_rules(g: BuildGraph, rules: DataFrame) -> DataFrame:
    """(path): outputs and side files of rules (name)."""
    edges = g.edges.join(rules.select(F.col("name").alias("rule")), "rule", "left_semi")
    outs = g.edge_outputs.join(edges.select("edge_id"), "edge_id", "left_semi").select("path")
    return outs.unionByName(_side_files(edges)).distinct()


def unknown_rules(g: BuildGraph, rules: DataFrame) -> DataFrame:
    """(message) for names that no rule has."""
    known = g.rules.where("scope_id = 0").select("name") if g.rules is not None else g.edges.select(F.col("rule").alias("name")).distinct()
    return rules.join(known, "name", "left_anti").select(F.concat(F.lit("unknown rule '"), "name", F.lit("'")).alias("message"))


def dead_outputs(g: BuildGraph, log: DataFrame | None = None) -> DataFrame:
    """(path): outputs that a log remembers and that the graph neither makes nor uses."""
    log = log if log is not None else g.build_log
    return log.select(F.col("output").alias("path")).distinct().join(g.edge_outputs.select("path"), "path", "left_anti").join(g.edge_inputs.select("path"), "path", "left_anti")


def removable(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(path) of those that exist, each once: what is counted as removed."""
    return paths.select("path").distinct().join(files.where("mtime > 0").select("path"), "path", "left_semi")


def leftovers(g: BuildGraph, running: DataFrame) -> DataFrame:
    """(action, path): what to remove after an interrupted build, by running statements (edge_id) with the times their outputs had (path, before).

    An output goes if its time has changed or its statement has a depfile; the depfile goes too.
    """
    edges = g.edges.join(running.select("edge_id").distinct(), "edge_id", "left_semi")
    outs = running.join(edges.select("edge_id", "depfile"), "edge_id").join(g.files.select("path", "mtime"), "path", "left")
    outs = outs.where("depfile <> '' or not (coalesce(mtime, 0) <=> before)").select("path")
    both = outs.unionByName(edges.where("depfile <> ''").select(F.col("depfile").alias("path"))).distinct()
    return removable(both, g.files).select(F.lit("remove").alias("action"), "path")
