"""Reachability: semi-naive closure, closure per root, tree unfolding, path doubling, longest paths, cycles.

Each round joins only the newest rows with the links, drops what is known and
writes the rest to the shared folder, so plans don't grow and lost executors
cost one round. A small frontier is broadcast after it has been counted.
Rounds end when nothing is new, at any depth. Links that are counted to be few
(ONE_TASK) go through one task instead, which walks them in memory: then deep
graphs cost a job, not a job for each level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._session import ship, shuffled, stage, stage_counted

#: Frontier rows that may be broadcast.
SMALL = 50_000
#: Links, and other rows, that one task may hold: some 100 bytes each.
ONE_TASK = 1_000_000
#: Rounds after which what they found is put into one table.
MERGE_EVERY = 16


def _one_task(links: DataFrame, rows: DataFrame, schema: T.StructType, walk: Callable) -> DataFrame:
    """`walk` over all links (src, dst) and rows (node, value) of a counted, bounded number, in one task.

    walk gets the nodes as numbers: src, dst, node, value; it gives the numbers
    of nodes and, if the schema has a second column, a value for each.
    """
    ship(links.sparkSession)
    kind = schema[0].dataType
    a = links.select(F.col("src").cast(kind).alias("a"), F.col("dst").cast(kind).alias("b"), F.lit(None).cast("long").alias("v"))
    b = rows.select(F.col("node").cast(kind).alias("a"), F.lit(None).cast(kind).alias("b"), F.col("value").cast("long").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for x in batches if x.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        n = table.num_rows
        both = pa.concat_arrays([c for k in (0, 1) for c in table.column(k).chunks])
        coded = both.dictionary_encode()
        names = coded.dictionary
        codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        first, second = codes[:n], codes[n:]
        value = table.column(2).fill_null(0).to_numpy()
        link = second >= 0
        out = walk(len(names), first[link], second[link], first[~link], value[~link])
        columns = [names.take(pa.array(out[0]))] + [pa.array(np.asarray(x, np.int64)) for x in out[1:]]
        yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return a.unionByName(b).coalesce(1).mapInArrow(run, schema)


def _successors(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each node into the ends of its links."""
    by = np.argsort(src, kind="stable")
    return np.searchsorted(src[by], np.arange(n + 1)), dst[by]


def _expand(begin: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Places of all links of `nodes`."""
    count = begin[nodes + 1] - begin[nodes]
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[nodes], count)


def _reach(n: int, src: np.ndarray, dst: np.ndarray, node: np.ndarray, _value: np.ndarray) -> tuple[np.ndarray]:
    begin, ends = _successors(n, src, dst)
    seen = np.zeros(n, bool)
    front = np.unique(node)
    while len(front):
        seen[front] = True
        step = ends[_expand(begin, front)]
        front = np.unique(step[~seen[step]])
    return (np.flatnonzero(seen),)


def _longest(n: int, src: np.ndarray, dst: np.ndarray, node: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs from the ends of the ways backwards: a node's turn comes when all its successors have had theirs."""
    weight, known = np.zeros(n, np.int64), np.zeros(n, bool)
    weight[node], known[node] = value, True
    inside = known[src] & known[dst]
    src, dst = src[inside], dst[inside]
    begin, starts = _successors(n, dst, src)
    left = np.bincount(src, minlength=n)
    after = np.full(n, -(2**62), np.int64)
    cost = weight.copy()
    front, done = np.flatnonzero(known & (left == 0)), 0
    while len(front):
        done += len(front)
        cost[front] = weight[front] + np.maximum(after[front], 0)
        at = _expand(begin, front)
        up, gain = starts[at], np.repeat(cost[front], begin[front + 1] - begin[front])
        np.maximum.at(after, up, gain)
        np.subtract.at(left, up, 1)
        up = np.unique(up)
        front = up[left[up] == 0]
    if done < known.sum():
        raise RuntimeError("longest_paths: a circle")
    return np.flatnonzero(known), cost[known]


def _unpeeled(n: int, src: np.ndarray, dst: np.ndarray, node: np.ndarray, _value: np.ndarray) -> tuple[np.ndarray]:
    known = np.zeros(n, bool)
    known[node] = True
    inside = known[src] & known[dst]
    src, dst = src[inside], dst[inside]
    begin, ends = _successors(n, src, dst)
    left = np.bincount(dst, minlength=n)
    front = np.flatnonzero(known & (left == 0))
    while len(front):
        known[front] = False
        step = ends[_expand(begin, front)]
        np.subtract.at(left, step, 1)
        step = np.unique(step)
        front = step[left[step] == 0]
    return (np.flatnonzero(known),)


def newest_behind(n: int, src: np.ndarray, dst: np.ndarray, node: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each start of a link, the largest value that its ways lead to; a node with a value of its own is where ways end."""
    begin, starts = _successors(n, dst, src)
    out, own = np.zeros(n, np.int64), np.zeros(n, bool)
    own[node] = True
    seen = np.zeros(n, bool)
    order = np.argsort(-value, kind="stable")
    for k in range(0, len(order)):
        i = order[k]
        if value[i] <= 0:
            break
        front = node[i : i + 1]
        while len(front):  # every node is reached first from the largest value
            up = starts[_expand(begin, front)]
            up = np.unique(up[~seen[up] & ~own[up]])
            out[up], seen[up] = value[i], True
            front = up
    at = np.flatnonzero(seen)
    return at, out[at]


def _like(name: str, df: DataFrame, column: str, *more: str) -> T.StructType:
    return T.StructType([T.StructField(name, df.schema[column].dataType), *[T.StructField(x, T.LongType()) for x in more]])


def _few(*counts: int) -> bool:
    return sum(counts) <= ONE_TASK


def _side(rows: DataFrame, n: int) -> DataFrame:
    """`rows`, counted as n, as a side of a join."""
    return F.broadcast(rows) if n <= SMALL else shuffled(rows)


def closure(seeds: DataFrame, links: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All (`keys`..., node) that `seeds` reach over links (src, dst), the seeds included.

    With `keys` every root has a closure of its own. The result has each row once.
    """
    keys = keys or []
    links, n_links = stage_counted(links.select("src", "dst"), "links")  # a link that is there twice finds a node twice, which is dropped below
    frontier, n = stage_counted(seeds.select(*keys, "node").distinct(), "reach")
    if not keys and _few(n_links, n):
        return stage(_one_task(links, frontier.withColumn("value", F.lit(0)), _like("node", seeds, "node"), _reach), "reach")
    parts = [frontier]
    while n:
        step = links.join(_side(frontier, n), F.col("src") == F.col("node")).select(*keys, F.col("dst").alias("node")).distinct()
        known = reduce(DataFrame.unionByName, parts)
        frontier, n = stage_counted(step.join(shuffled(known), [*keys, "node"], "left_anti"), "reach")
        if len(parts) >= MERGE_EVERY:
            parts = [stage(known, "reach")]
        parts.append(frontier)
    return reduce(DataFrame.unionByName, parts)


def reverse(links: DataFrame) -> DataFrame:
    return links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def chain_roots(parent: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root, depth) of a forest (node, parent; roots have a null parent) by path doubling: rounds grow as the log of its depth."""
    jump = parent.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.coalesce("parent", "node").alias("root"))
    jump = stage(jump, "chain")
    for _ in range(max_rounds):
        if not jump.where("up is not null").limit(1).count():
            return jump.select("node", "root", "depth")
        far = jump.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("root").alias("root2"))
        jump = jump.join(shuffled(far), "up", "left").select(
            "node", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.coalesce("root2", "root").alias("root")
        )
        jump = stage(jump, "chain")
    raise RuntimeError("chain_roots: a circle, or deeper than 2**max_rounds")


def longest_paths(weights: DataFrame, links: DataFrame) -> DataFrame:
    """(node, cost): the largest sum of weights (node, weight) of a path from each node along links, its own included.

    Max-relaxation by rounds: only nodes whose successors have changed go on.
    """
    links, n_links = stage_counted(links.select("src", "dst").distinct(), "links")
    best = weights.select("node", F.col("weight").cast("long").alias("cost"), F.col("weight").cast("long").alias("weight"))
    best, n = stage_counted(best, "cost")
    if _few(n_links, n):
        rows = best.select("node", F.col("weight").alias("value"))
        return stage(_one_task(links, rows, _like("node", weights, "node", "cost"), _longest), "cost")
    changed, total, rounds = best.select("node", "cost"), n, 0
    # A node's cost only grows, and by no way longer than there are nodes.
    while True:
        reach = links.join(_side(changed, n), F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node")).agg(F.max("cost").alias("after"))
        better = best.join(shuffled(reach), "node").where("weight + after > cost").select("node", (F.col("weight") + F.col("after")).alias("new"))
        better, n = stage_counted(better, "better")
        if not n:
            return best.select("node", "cost")
        rounds += 1
        if rounds > total:
            raise RuntimeError("longest_paths: a circle")
        best = stage(best.join(_side(better, n), "node", "left").select("node", F.coalesce("new", "cost").alias("cost"), "weight"), "cost")
        changed = better.select("node", F.col("new").alias("cost"))


def levels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, level): the longest way to each node from one without predecessors; an order in which producers come first."""
    return longest_paths(nodes.select("node", F.lit(1).alias("weight")), reverse(links)).select("node", (F.col("cost") - 1).alias("level"))


def cyclic(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """What is left when nodes without predecessors are peeled off, again and again: the circles and what lies behind them."""
    left, n = stage_counted(nodes.select("node").distinct(), "peel")
    links, n_links = stage_counted(links.select("src", "dst").distinct(), "links")
    if _few(n, n_links):
        return stage(_one_task(links, left.withColumn("value", F.lit(0)), _like("node", nodes, "node"), _unpeeled), "peel")
    while True:
        live = links.join(shuffled(left.select(F.col("node").alias("src"))), "src", "left_semi").join(shuffled(left.select(F.col("node").alias("dst"))), "dst", "left_semi")
        left, now = stage_counted(left.join(shuffled(live.select(F.col("dst").alias("node"))), "node", "left_semi"), "peel")
        if now in (0, n):
            return left
        n = now


def cycle_path(edges: list[tuple]) -> list | None:
    """One circle among (src, dst) pairs, its first node again at the end; for the few rows that `cyclic` leaves."""
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    done: set = set()
    for start in after:
        path, on, stack = [], {}, [(start, iter(after.get(start, ())))]
        if start in done:
            continue
        on[start] = 0
        path.append(start)
        while stack:
            node, rest = stack[-1]
            step = next(rest, None)
            if step is None:
                stack.pop()
                path.pop()
                on.pop(node)
                done.add(node)
            elif step in on:
                return [*path[on[step] :], step]
            elif step not in done:
                on[step] = len(path)
                path.append(step)
                stack.append((step, iter(after.get(step, ()))))
    return None


def unfold(roots: DataFrame, links: DataFrame, depth: int | None) -> DataFrame:
    """(root, place, level, node): the tree below roots (root, node) down to `depth` links (None: to its leaves); a node comes once for every way to it.

    links: (src, pos, dst), from a node to what it is made of. place orders the rows as a depth-first walk would.
    """
    part = roots.select("root", F.array(F.lit(0)).alias("place"), F.lit(0).alias("level"), "node")
    parts, level, n = [part], 1, 1
    while n and (depth is None or level < depth):
        part = part.join(shuffled(links), F.col("node") == F.col("src")).select("root", F.array_append("place", F.col("pos")).alias("place"), F.lit(level).alias("level"), F.col("dst").alias("node"))
        part, n = stage_counted(part, "tree")
        parts.append(part)
        level += 1
    return reduce(DataFrame.unionByName, parts)
