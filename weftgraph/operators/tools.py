"""Questions about a graph: targets, inputs, commands, compilation database, consumers, missing dependencies.

Lists come as DataFrames with the columns that order them. Where a tool's text
follows a depth-first walk, the rows carry (level, edge_id), an order in which
producers come first; the set is the same.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import edit_distance, inline_response_file, shell_escape
from ..plans.graph import BuildGraph
from ..sources.manifest import canonical
from .closure import closure, levels, reverse, unfold


class TargetError(ValueError):
    """A target that the graph doesn't have."""


# Targets.


def targets_all(g: BuildGraph) -> DataFrame:
    """(edge_id, pos, path, rule) of every output."""
    return g.edge_outputs.join(g.edges.select("edge_id", "rule"), "edge_id").select("edge_id", "pos", "path", "rule")


def targets_by_rule(g: BuildGraph, rule: str) -> DataFrame:
    return targets_all(g).where(F.col("rule") == rule).select("path").distinct()


def source_inputs(g: BuildGraph) -> DataFrame:
    """(edge_id, pos, path) of inputs that nothing makes; one that is used twice is there twice."""
    return g.edge_inputs.select("edge_id", "pos", "path").join(g.edge_outputs.select("path"), "path", "left_anti").select("edge_id", "pos", "path")


def targets_by_depth(g: BuildGraph, roots: DataFrame, depth: int) -> DataFrame:
    """(root, place, level, path, rule): the tree below roots (path) to `depth` levels (none: to the leaves); a path comes once for every way to it."""
    needs = g.edge_outputs.select("edge_id", F.col("path").alias("src")).join(g.edge_inputs.select("edge_id", "pos", F.col("path").alias("dst")), "edge_id").select("src", "pos", "dst")
    tree = unfold(roots.select(F.col("path").alias("root"), F.col("path").alias("node")), needs, depth if depth > 0 else None)
    rule = targets_all(g).select(F.col("path").alias("node"), "rule")
    return tree.join(rule, "node", "left").select("root", "place", "level", F.col("node").alias("path"), F.coalesce("rule", F.lit("")).alias("rule"))


def rules(g: BuildGraph) -> DataFrame:
    """(name, description) of the rules of the outermost scope; the description as it is written."""
    text = g.rule_bindings.where("key = 'description'").select("rule_id", F.col("template").alias("description"))
    return g.rules.where("scope_id = 0").join(text, "rule_id", "left").select("name", "description")


def scope_values(g: BuildGraph) -> DataFrame:
    """(scope_id, key, value) as each scope sees its variables: its own, or the nearest outer scope's."""
    up = g.scopes.where("parent_id is not null").select(F.col("scope_id").alias("src"), F.col("parent_id").alias("dst"))
    far = unfold(g.scopes.select(F.col("scope_id").alias("root"), F.col("scope_id").alias("node")), up.select("src", F.lit(0).alias("pos"), "dst"), None)
    seen = far.join(g.scope_bindings, F.col("node") == F.col("scope_id")).groupBy(F.col("root").alias("scope_id"), "key").agg(F.min_by("value", "level").alias("value"))
    return seen


def global_binding(g: BuildGraph, key: str) -> DataFrame:
    return g.scope_bindings.where((F.col("scope_id") == 0) & (F.col("key") == key)).select("value")


# Names given by a user.


def nearest_path(paths: DataFrame, name: str, most: int = 3) -> DataFrame:
    """One row at most: the path nearest to `name` within `most` edits, the first mentioned of equals (node_id, path)."""
    near = paths.withColumn("d", edit_distance(F.lit(name), F.col("path"), most)).where(F.col("d") <= most)
    return near.orderBy("d", "node_id").limit(1).select("path")


def resolve(g: BuildGraph, names: Iterable[str]) -> DataFrame:
    """(seq, path) of target names, or the defaults if there are none; ``path^`` is the first output of the first user of path."""
    spark = g.edges.sparkSession
    names = list(names)
    if not names:
        roots = g.default_nodes()
        if g.edges.limit(1).count() and not roots.limit(1).count():
            raise TargetError("could not determine root nodes of build graph")
        return roots.select(F.lit(0).alias("seq"), "path")
    asked = []
    for k, name in enumerate(names):
        if not name:
            raise TargetError("empty path")
        path = canonical(name)
        asked.append((k, path.removesuffix("^"), path.endswith("^")))
    rows = spark.createDataFrame(asked, "seq int, path string, user boolean")
    known = g.paths() if g.nodes is None else g.nodes.select("path")
    found = rows.join(known.withColumn("known", F.lit(True)), "path", "left")
    first = g.edge_inputs.select("path", "edge_id").groupBy("path").agg(F.min("edge_id").alias("edge_id")).join(g.edge_outputs.where("pos = 0").select("edge_id", F.col("path").alias("out")), "edge_id").select("path", "out")
    found = found.join(first, "path", "left")
    if g.deps_log is not None:
        found = found.join(reverse_deps(g.deps_log), "path", "left")
    else:
        found = found.withColumn("recorded", F.lit(None).cast("string"))
    out = found.select("seq", "path", "known", "user", F.when(F.col("user"), F.coalesce("out", "recorded")).otherwise(F.col("path")).alias("target"))
    for r in out.collect():  # as many rows as names were given
        if not r.known:
            ids = g.nodes if g.nodes is not None else g.node_ids()
            near = nearest_path(ids, r.path).first()
            raise TargetError(f"unknown target '{r.path}'" + (f", did you mean '{near[0]}'?" if near else ""))
        if r.target is None:
            raise TargetError(f"'{r.path}' has no out edge")
    return out.select("seq", F.col("target").alias("path"))


def reverse_deps(deps_log: DataFrame) -> DataFrame:
    """(path, recorded): of each recorded input the output whose record came first."""
    return deps_log.where("input is not null").groupBy(F.col("input").alias("path")).agg(F.min_by("output", "rec_no").alias("recorded"))


# What targets need.


def _needs(g: BuildGraph) -> DataFrame:
    return reverse(g.links())


def producers(g: BuildGraph, targets: DataFrame) -> DataFrame:
    """(edge_id) of all statements behind targets (path)."""
    first = g.edge_outputs.join(targets.select("path"), "path").select(F.col("edge_id").alias("node"))
    return closure(first, _needs(g)).select(F.col("node").alias("edge_id"))


def ordered(g: BuildGraph, edges: DataFrame) -> DataFrame:
    """Statements with the level that puts producers first."""
    nodes = edges.select(F.col("edge_id").alias("node"))
    inside = g.links().join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    return edges.join(levels(nodes, inside).select(F.col("node").alias("edge_id"), "level"), "edge_id")


def commands(g: BuildGraph, targets: DataFrame, single: bool = False) -> DataFrame:
    """(level, edge_id, command) of what makes the targets (single: of the last steps only); phony statements have none."""
    if single:
        edges = g.edge_outputs.join(targets.select("path"), "path").select("edge_id").distinct().withColumn("level", F.lit(0).cast("long"))
    else:
        edges = ordered(g, producers(g, targets))
    return edges.join(g.edges.where("not is_phony").select("edge_id", "command"), "edge_id").where("command <> ''").select("level", "edge_id", "command")


def _visible_inputs(g: BuildGraph) -> DataFrame:
    """(edge_id, path) of inputs that a list shows: outputs of phony statements are passed through."""
    phony = g.edge_outputs.join(g.edges.where("is_phony").select("edge_id"), "edge_id", "left_semi").select("path")
    return g.edge_inputs.select("edge_id", "path").join(phony, "path", "left_anti").select("edge_id", "path")


def inputs(g: BuildGraph, targets: DataFrame, escape: bool = True) -> DataFrame:
    """(path): everything the targets are made from, quoted for a shell, to be sorted by what is shown."""
    shown = _visible_inputs(g).join(producers(g, targets), "edge_id", "left_semi").select("path").distinct()
    return shown.select(shell_escape(F.col("path")).alias("path") if escape else F.col("path")).distinct()


def multi_inputs(g: BuildGraph, targets: DataFrame) -> DataFrame:
    """(target, path): the same, for each target by itself."""
    first = g.edge_outputs.join(targets.select("path"), "path").select(F.col("path").alias("target"), F.col("edge_id").alias("node"))
    reach = closure(first, _needs(g), ["target"]).select("target", F.col("node").alias("edge_id"))
    return reach.join(_visible_inputs(g), "edge_id").select("target", "path").distinct()


def _compdb(g: BuildGraph, edges: DataFrame, directory: str, inline: bool) -> DataFrame:
    first_in = g.edge_inputs.where("pos = 0").select("edge_id", F.col("path").alias("file"))
    first_out = g.edge_outputs.where("pos = 0").select("edge_id", F.col("path").alias("output"))
    command = inline_response_file(F.col("command"), F.col("rspfile"), F.col("rspfile_content")) if inline else F.col("command")
    rows = edges.join(first_in, "edge_id").join(first_out, "edge_id")
    return rows.select("edge_id", F.lit(directory).alias("directory"), command.alias("command"), "file", "output")


def compdb(g: BuildGraph, rule_names: list[str] | None = None, directory: str = ".", inline: bool = False) -> DataFrame:
    """A row per statement with an input, phony ones too: what a compilation database lists, in the order of edge_id."""
    edges = g.edges if not rule_names else g.edges.where(F.col("rule").isin(rule_names))
    return _compdb(g, edges, directory, inline)


def compdb_targets(g: BuildGraph, targets: DataFrame, directory: str = ".", inline: bool = False) -> DataFrame:
    """The same for the commands behind targets."""
    edges = g.edges.where("not is_phony").join(producers(g, targets), "edge_id", "left_semi")
    return _compdb(g, edges, directory, inline)


def compdb_json(rows: DataFrame) -> DataFrame:
    """(edge_id, json) objects."""
    return rows.select("edge_id", F.to_json(F.struct("directory", "command", "file", "output")).alias("json"))


# What uses what.


def query(g: BuildGraph, targets: DataFrame) -> DataFrame:
    """(path, section, seq, pos, item): the rule and labelled inputs that make each target, its validations, what uses it and what it validates."""
    t = targets.select("path").distinct()
    made = t.join(g.edge_outputs.select("path", "edge_id"), "path")
    label = F.when(F.col("kind") == "implicit", "| ").when(F.col("kind") == "order_only", "|| ").otherwise("")
    ins = g.edge_inputs.select("edge_id", "pos", F.concat(label, F.col("path")).alias("item"))
    outs = g.edge_outputs.select("edge_id", "pos", F.col("path").alias("item"))
    part = lambda df, name, seq: df.select("path", F.lit(name).alias("section"), seq.cast("long").alias("seq"), F.col("pos").cast("int").alias("pos"), "item")
    rule = made.join(g.edges.select("edge_id", F.col("rule").alias("item")), "edge_id").withColumn("pos", F.lit(0))
    users = t.join(g.edge_inputs.select("path", "edge_id").distinct(), "path").join(outs, "edge_id")
    checked = t.join(g.edge_validations.select("path", "edge_id").distinct(), "path").join(outs, "edge_id")
    checks = made.join(g.edge_validations.select("edge_id", "pos", F.col("path").alias("item")), "edge_id")
    zero = F.lit(0)
    return (
        part(rule, "rule", zero).unionByName(part(made.join(ins, "edge_id"), "input", zero)).unionByName(part(checks, "validation", zero))
        .unionByName(part(users, "output", F.col("edge_id"))).unionByName(part(checked, "validation for", F.col("edge_id")))
    )


def deps(g: BuildGraph, targets: DataFrame | None = None) -> DataFrame:
    """(output, n_deps, mtime, state, inputs): recorded dependencies; without targets of all outputs whose statement records them."""
    records = g.deps_log.groupBy("output").agg(
        F.count_if(F.col("pos") >= 0).alias("n_deps"), F.max("mtime").alias("mtime"), F.min("rec_no").alias("rec_no"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("pos") >= 0, F.struct("pos", "input")))), lambda x: x["input"]).alias("inputs"),
    )
    if targets is None:
        live = g.edge_outputs.join(g.edges.where("deps <> ''").select("edge_id"), "edge_id", "left_semi").select(F.col("path").alias("output"))
        rows = records.join(live, "output", "left_semi")
    else:
        rows = targets.select(F.col("path").alias("output")).distinct().join(records, "output", "left")
    rows = rows.join(g.files.select(F.col("path").alias("output"), F.col("mtime").alias("now")), "output", "left")
    gone = F.col("now").isNull() | (F.col("now") == 0) | (F.col("now") > F.col("mtime"))
    state = F.when(F.col("n_deps").isNull(), "not found").when(gone, "STALE").otherwise("VALID")
    return rows.select("output", F.coalesce("n_deps", F.lit(0)).alias("n_deps"), "mtime", state.alias("state"), "rec_no", "inputs")


def graph_rows(g: BuildGraph, targets: DataFrame) -> DataFrame:
    """(section, edge_id, pos, line): the drawing of what is behind targets, in the language of Graphviz.

    A statement with one input and one output is an arrow, any other an ellipse.
    """
    edges = producers(g, targets)
    ids = g.node_ids() if g.nodes is None else g.nodes
    n_in = g.edge_inputs.groupBy("edge_id").agg(F.count("*").alias("n_in"))
    n_out = g.edge_outputs.groupBy("edge_id").agg(F.count("*").alias("n_out"))
    shape = edges.join(g.edges.select("edge_id", "rule"), "edge_id").join(n_in, "edge_id", "left").join(n_out, "edge_id").withColumn("arrow", (F.coalesce("n_in", F.lit(0)) == 1) & (F.col("n_out") == 1))
    nid = ids.select("path", F.concat(F.lit('"n'), F.col("node_id").cast("string"), F.lit('"')).alias("nid"))
    eid = F.concat(F.lit('"e'), F.col("edge_id").cast("string"), F.lit('"'))
    ins = g.edge_inputs.join(shape, "edge_id").join(nid, "path")
    outs = g.edge_outputs.join(shape, "edge_id").join(nid, "path")
    paths = ins.select("path").unionByName(outs.select("path")).unionByName(targets.select("path")).distinct().join(nid, "path")
    line = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("line")
    nothing = F.lit(0).cast("long").alias("edge_id")
    nodes = paths.select(F.lit("node").alias("section"), nothing, F.lit(0).alias("pos"), line(F.col("nid"), ' [label="', F.replace(F.col("path"), F.lit("\\"), F.lit("/")), '"]'))
    one = ins.where("arrow").select("edge_id", F.col("nid").alias("from"), "rule").join(outs.where("arrow").select("edge_id", F.col("nid").alias("to")), "edge_id")
    arrows = one.select(F.lit("arrow").alias("section"), "edge_id", F.lit(0).alias("pos"), line(F.col("from"), " -> ", F.col("to"), ' [label=" ', F.col("rule"), '"]'))
    ellipses = shape.where("not arrow").select(F.lit("statement").alias("section"), "edge_id", F.lit(0).alias("pos"), line(eid, ' [label="', F.col("rule"), '", shape=ellipse]'))
    out_lines = outs.where("not arrow").select(F.lit("to").alias("section"), "edge_id", "pos", line(eid, " -> ", F.col("nid")))
    dotted = F.when(F.col("kind") == "order_only", " style=dotted").otherwise("")
    in_lines = ins.where("not arrow").select(F.lit("from").alias("section"), "edge_id", "pos", line(F.col("nid"), " -> ", eid, " [arrowhead=none", dotted, "]"))
    return nodes.unionByName(arrows).unionByName(ellipses).unionByName(out_lines).unionByName(in_lines)


def graph_text(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(line) of a whole drawing, in order."""
    head = spark.createDataFrame([(k, x) for k, x in enumerate(["digraph ninja {", 'rankdir="LR"', "node [fontsize=10, shape=box, height=0.25]", "edge [fontsize=10]"])], "pos int, line string")
    body = rows.select(F.lit(1).alias("part"), "section", "edge_id", "pos", "line")
    zero = F.lit(0).cast("long")
    top = head.select(F.lit(0).alias("part"), F.lit("").alias("section"), zero.alias("edge_id"), "pos", "line")
    end = spark.createDataFrame([("}",)], "line string").select(F.lit(2).alias("part"), F.lit("").alias("section"), zero.alias("edge_id"), F.lit(0).alias("pos"), "line")
    return top.unionByName(body).unionByName(end).orderBy("part", "edge_id", "section", "pos", "line").select("line")


# Dependencies that a manifest doesn't declare.


def missing_deps(g: BuildGraph, targets: DataFrame) -> DataFrame:
    """(target, input, rule): recorded inputs that a statement makes to which the manifest shows no way from the target.

    A record that names the manifest itself only says "after a reconfiguration" and is left out.
    """
    behind = producers(g, targets)
    outs = g.edge_outputs.select("edge_id", F.col("path").alias("target"))
    # A target counts if a walk along inputs comes by it: it is named, or used by a statement that is.
    met = targets.select(F.col("path").alias("target")).unionByName(g.edge_inputs.join(behind, "edge_id", "left_semi").select(F.col("path").alias("target"))).distinct()
    by_log = outs.join(g.edges.where("deps <> ''").select("edge_id"), "edge_id").join(met, "target")
    log = g.deps_log.where("input is not null").select(F.col("output").alias("target"), "input")
    recorded = by_log.join(log, "target")
    if g.depfiles is not None:
        by_file = outs.join(g.edges.where("deps = '' and depfile <> ''").select("edge_id", F.col("depfile").alias("path")), "edge_id").join(met, "target")
        recorded = recorded.unionByName(by_file.join(g.depfiles.select("path", F.explode("ins").alias("input")), "path").select("target", "edge_id", "input"))
    recorded = recorded.distinct()
    reconfigures = recorded.where("input = 'build.ninja'").select("target")
    recorded = recorded.join(reconfigures, "target", "left_anti")
    made = recorded.join(g.edge_outputs.select(F.col("path").alias("input"), F.col("edge_id").alias("maker")), "input")
    pairs = made.select(F.col("edge_id").alias("user"), "maker").distinct()
    # Ways are followed only for the statements in question, each by itself.
    first = pairs.select("user").distinct().select("user", F.col("user").alias("src")).join(_needs(g), "src").select("user", F.col("dst").alias("node"))
    reach = closure(first, _needs(g), ["user"]).select("user", F.col("node").alias("maker"))
    loose = made.withColumnRenamed("edge_id", "user").join(reach, ["user", "maker"], "left_anti")
    return loose.join(g.edges.select(F.col("edge_id").alias("maker"), "rule"), "maker").select("target", "input", "rule").distinct()


def missing_deps_lines(found: DataFrame) -> DataFrame:
    return found.select(F.concat(F.lit("Missing dep: "), "target", F.lit(" uses "), "input", F.lit(" (generated by "), "rule", F.lit(")")).alias("line"))


def missing_deps_report(g: BuildGraph, targets: DataFrame, found: DataFrame) -> DataFrame:
    """One row: nodes_processed, missing_dep_paths, nodes_missing_deps, generated_nodes, generator_rules."""
    behind = producers(g, targets)
    met = targets.select("path").unionByName(g.edge_inputs.join(behind, "edge_id", "left_semi").select("path")).distinct().join(g.edge_outputs.select("path"), "path", "left_semi")
    counts = found.agg(F.countDistinct("target", "rule").alias("missing_dep_paths"), F.countDistinct("target").alias("nodes_missing_deps"), F.countDistinct("input").alias("generated_nodes"), F.countDistinct("rule").alias("generator_rules"))
    return met.agg(F.count("*").alias("nodes_processed")).crossJoin(counts)  # one row each


def missing_deps_summary(report: DataFrame) -> DataFrame:
    """(text): the report in words."""
    some = F.format_string(
        "Processed %d nodes.\nError: There are %d missing dependency paths.\n%d targets had depfile dependencies on %d distinct generated inputs (from %d rules) "
        " without a non-depfile dep path to the generator.\nThere might be build flakiness if any of the targets listed above are built alone, or not late enough, in a clean output directory.\n",
        "nodes_processed", "missing_dep_paths", "nodes_missing_deps", "generated_nodes", "generator_rules",
    )
    none = F.format_string("Processed %d nodes.\nNo missing dependencies on generated files found.\n", "nodes_processed")
    return report.select(F.when(F.col("missing_dep_paths") > 0, some).otherwise(none).alias("text"))


def format_edge(g: BuildGraph) -> DataFrame:
    """(edge_id, text) like ``[ in --rule-> out ]``."""
    rows = g.edges.select("edge_id", "rule").join(_joined(g.edge_inputs, "ins"), "edge_id", "left").join(_joined(g.edge_outputs, "outs"), "edge_id")
    return rows.select("edge_id", F.concat(F.lit("[ "), F.coalesce(F.concat("ins", F.lit(" ")), F.lit("")), F.lit("--"), "rule", F.lit("-> "), "outs", F.lit(" ]")).alias("text"))


def _joined(rows: DataFrame, name: str, sep: str = " ") -> DataFrame:
    """Paths of each statement in order, as one string."""
    return rows.groupBy("edge_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"]), sep).alias(name))


def path_lists(g: BuildGraph) -> DataFrame:
    """(edge_id, in, out): the lists that commands use, quoted; explicit paths only."""
    quoted = lambda df: df.withColumn("path", shell_escape(F.col("path")))
    ins = _joined(quoted(g.edge_inputs.where("kind = 'explicit'")), "in")
    outs = _joined(quoted(g.edge_outputs.where("not implicit")), "out")
    return g.edges.select("edge_id").join(ins, "edge_id", "left").join(outs, "edge_id", "left").select("edge_id", F.coalesce("in", F.lit("")).alias("in"), F.coalesce("out", F.lit("")).alias("out"))


def input_kinds(g: BuildGraph) -> DataFrame:
    """(edge_id, explicit, implicit, order_only): how many inputs of each kind a statement has."""
    kinds = ("explicit", "implicit", "order_only")
    counts = g.edge_inputs.groupBy("edge_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    return g.edges.select("edge_id").join(counts, "edge_id", "left").select("edge_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


def first_seen_ids(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(id, key): dense ids in the order in which keys were first met."""
    first = rows.groupBy(key).agg(F.min(order).alias("at"))
    return first.select((F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("id"), key)
