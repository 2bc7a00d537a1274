"""What to run, in which order, and what may run now."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .._session import shuffled
from ..plans.graph import BuildGraph
from .closure import closure, longest_paths, reverse
from .dirty import Scan
from .tools import format_edge


def wanted(s: Scan, targets: DataFrame) -> DataFrame:
    """(edge_id, want): the statements behind `targets` (path) that aren't ready; to_start if they are dirty, else nothing.

    A statement that is not ready makes all that use it not ready, so reaching
    and not being ready can be decided apart.
    """
    first = s.graph.edge_outputs.join(shuffled(targets.select("path")), "path").select(F.col("edge_id").alias("node")).distinct()
    reach = closure(first, reverse(s.links))
    late = s.edges.where("not ready").select(F.col("edge_id").alias("node"), "dirty")
    return reach.join(shuffled(late), "node").select(F.col("node").alias("edge_id"), F.when(F.col("dirty"), "to_start").otherwise("nothing").alias("want"))


def missing_leaves(s: Scan, plan: DataFrame, declared_inputs: DataFrame) -> DataFrame:
    """(path, needed_by): files that are missing, that nothing makes and that a planned statement declares; recorded dependencies are forgiven."""
    leaves = declared_inputs.join(shuffled(s.graph.edge_outputs.select("path")), "path", "left_anti").join(shuffled(s.graph.files.where("mtime > 0").select("path")), "path", "left_anti")
    first = s.graph.edge_outputs.where("pos = 0").select("edge_id", F.col("path").alias("needed_by"))
    return leaves.join(shuffled(plan.select("edge_id")), "edge_id", "left_semi").join(shuffled(first), "edge_id").select("path", "needed_by").distinct()


def counters(s: Scan, plan: DataFrame) -> DataFrame:
    """One row: wanted_edges, command_edges and whether there is anything to do."""
    rows = plan.where("want = 'to_start'").join(shuffled(s.graph.edges.select("edge_id", "is_phony")), "edge_id")
    out = rows.agg(F.count("*").alias("wanted_edges"), F.count_if(~F.col("is_phony")).alias("command_edges"))
    return out.withColumn("more_to_do", (F.col("wanted_edges") > 0) & (F.col("command_edges") > 0))


def critical_paths(plan: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """(edge_id, weight): commands on the longest way from a planned statement to a target, its own included; phony ones count 0."""
    own = plan.join(shuffled(edges.select("edge_id", "is_phony")), "edge_id").select(F.col("edge_id").alias("node"), F.when(F.col("is_phony"), 0).otherwise(1).alias("weight"))
    inside = links.join(shuffled(plan.select(F.col("edge_id").alias("src"))), "src", "left_semi").join(shuffled(plan.select(F.col("edge_id").alias("dst"))), "dst", "left_semi")
    return longest_paths(own, inside).select(F.col("node").alias("edge_id"), F.col("cost").alias("weight"))


def ready_edges(plan: DataFrame, links: DataFrame) -> DataFrame:
    """(edge_id): planned statements to start none of whose producers are still planned."""
    blocked = links.join(shuffled(plan.select(F.col("edge_id").alias("src"))), "src", "left_semi").select(F.col("dst").alias("edge_id"))
    return plan.where("want = 'to_start'").select("edge_id").join(shuffled(blocked), "edge_id", "left_anti")


def admitted(ready: DataFrame, pools: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """`ready` (edge_id, pool, weight) with whether each may start: a pool admits, in order of priority, as many as its depth leaves.

    The order within a pool needs its statements together; pools without a
    depth admit all and are not sorted.
    """
    left = pools.select(F.col("name").alias("pool"), "depth")
    if used is not None:
        left = left.join(used, "pool", "left").withColumn("depth", F.when(F.col("depth") > 0, F.greatest(F.col("depth") - F.coalesce("use", F.lit(0)), F.lit(0)) + F.lit(0.0)).otherwise(None))
    else:
        left = left.withColumn("depth", F.when(F.col("depth") > 0, F.col("depth") + F.lit(0.0)))
    rows = ready.join(F.broadcast(left), "pool", "left")  # a row per pool
    order = Window.partitionBy("pool").orderBy(F.desc("weight"), "edge_id")
    limited = rows.where("depth is not null").withColumn("admitted", F.row_number().over(order) <= F.col("depth"))
    free = rows.where("depth is null").withColumn("admitted", F.lit(True))
    return limited.unionByName(free).select("edge_id", "pool", "weight", "admitted")


def next_batch(ready: DataFrame, capacity: int) -> DataFrame:
    """The statements to run next: heaviest first, then in the order of the manifest."""
    return ready.orderBy(F.desc("weight"), "edge_id").limit(capacity)


def dump(g: BuildGraph, plan: DataFrame, ready: DataFrame) -> DataFrame:
    """(part, edge_id, line): how many statements are pending (part 0), each of them (1), how many are ready (2)."""
    none = F.lit(None).cast("long").alias("edge_id")
    total = lambda part, word, rows: rows.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), none, F.concat(F.lit(f"{word}: "), F.col("n").cast("string")).alias("line"))
    mark = F.when(F.col("want") == "nothing", "").otherwise("want ")
    each = plan.join(shuffled(format_edge(g)), "edge_id").select(F.lit(1).alias("part"), F.col("edge_id").cast("long").alias("edge_id"), F.concat(mark, "text").alias("line"))
    return total(0, "pending", plan).unionByName(each).unionByName(total(2, "ready", ready))


def all_inputs_ready(inputs: DataFrame, outputs: DataFrame, unfinished: DataFrame) -> DataFrame:
    """(edge_id, inputs_ready): whether every producer of a statement's inputs, order-only ones too, has finished."""
    made = outputs.join(shuffled(unfinished.select("edge_id")), "edge_id", "left_semi").select("path", F.lit(True).alias("open"))
    return inputs.join(shuffled(made), "path", "left").groupBy("edge_id").agg((~F.coalesce(F.bool_or("open"), F.lit(False))).alias("inputs_ready"))
