"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._common import stage


#: So many edges (16 bytes each) are finished in one task.
ONE_TASK = 250_000


def _finish(e: DataFrame) -> DataFrame:
    """(node, root) of a bounded number of edges, in one task: least labels along edges, with jumps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        a, b = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        i, j = place[: len(a)], place[len(a) :]
        label = np.arange(len(nodes))
        while True:
            new = label.copy()
            # The labels of both ends meet, and so do the places that these name.
            low = np.minimum(label[i], label[j])
            for x in (i, j, label[i], label[j]):
                np.minimum.at(new, x, low)
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "root"])

    return e.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of an edge: alternating large and small stars.

    edges: (a, b), long, in any order and number. Every round is written to
    the shared folder. The root is the least node of its component. A node
    with very many edges is a hot key of joins only, which Spark splits. Once
    no more than ONE_TASK edges are left, by count, one task finishes them.
    """

    def staged(e: DataFrame) -> tuple[DataFrame, tuple]:
        """Written, with a count and a checksum taken on the way."""
        seen = Observation()
        h = F.xxhash64("a", "b").cast("decimal(38,0)")
        e = stage(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(h).alias("h")), "cc")
        return e, (seen.get["n"], seen.get["h"])

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, seen = staged(e)
    for _ in range(max_rounds):
        if seen[0] <= ONE_TASK:
            return stage(_finish(e), "cc")
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        e, now = staged(small)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
