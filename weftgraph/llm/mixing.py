"""Mixing sources to target weights by min-cost flow.

A document belongs to a set of sources: its own `source`, or any array of
sources. Documents are aggregated by membership pattern (that set). Words flow
from patterns to the quotas of their sources; a pattern's first `size` words
cost nothing, the next `size`, its repetition, cost one each: a convex cost,
so that the flow repeats as little as it can, and words that several sources
share go where they spare a repetition. The flow says how many words to take
of each pattern; which documents give them is decided by a seeded hash.

The graph on the driver has a node per pattern and source, never per document.
Within a pattern documents are dealt over at most `MAX_BUCKETS` ranges of the
hash; all ranges before the one in which the amount is reached are taken
whole. That one is dealt out again until it has about `ROWS_PER_BUCKET` rows,
and is then filled in seeded order, its last few documents chosen to come
nearest to the amount. So no task holds more than a range, however large the
corpus, and a source with a third of all rows is as spread out as the rest.

Defined results: a null text has size 0; a null source is a source of its own,
last in the order; a null or empty set of sources is a pattern that nothing
asks for; documents of size 0 are taken 0 words; a very long text is counted
whole; equal rows get equal hashes, share a range, and may differ in what is
taken, which does not matter as they are equal; an empty table gives an empty
result; further columns pass through `mixed` untouched and do not change the
result.
"""

from __future__ import annotations

import json
from collections import defaultdict, deque
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text as t
from ._common import ship, stage

ROWS_PER_BUCKET = 1000
MAX_BUCKETS = 4096
SEED = 17
#: Documents among which the last words of a pattern are chosen, and the shortfall that is near enough.
WINDOW = 48
NEAR = 0.002


def n_words(text: Column) -> Column:
    """Words of a text, counted natively."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "\u0001")
    return F.length(F.regexp_replace(marked, r"[\x20\x09-\x0D]+", "")).cast("long")


def _pattern(docs: DataFrame, sources: Column | None) -> Column:
    """A row's set of sources as one string."""
    own = F.array(F.col("source").cast("string")) if sources is None else F.coalesce(sources.cast("array<string>"), F.array().cast("array<string>"))
    return F.to_json(F.array_sort(F.array_distinct(own)))


def sizes(docs: DataFrame, sources: Column | None = None) -> DataFrame:
    """doc_id, pattern, tkey (hash of the text) and size of every row, counted on whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in t.slices(batches, "text"):
            _, _, at = t.word_spans(data, offsets)
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(np.diff(at).astype(np.int64))], ["doc_id", "pattern", "tkey", "size"])

    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _pattern(docs, sources).alias("pattern"), F.xxhash64(text).alias("tkey"), text.alias("text"))
    return slim.mapInArrow(run, "doc_id long, pattern string, tkey long, size long")


def targets(source_sizes: dict[str | None, int], weights: Sequence[int] = (5, 2, 1), share: Fraction = Fraction(3, 2), most: int = 2, total: int | None = None) -> dict[str | None, Fraction]:
    """Words wanted of each source: `share` of all by weight, at most `most` times its size, the excess shared again.

    total: words of all documents, where sources overlap; else the sum of the sources' sizes.
    """
    names = sorted((s for s in source_sizes if s is not None)) + [None] * (None in source_sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left = share * (sum(source_sizes.values()) if total is None else total)
    out: dict[str | None, Fraction] = {}
    active = list(names)
    while active:
        weights_ = sum(weight[s] for s in active)
        over = [s for s in active if left * weight[s] > most * source_sizes[s] * weights_]
        if not over:
            out |= {s: left * weight[s] / weights_ for s in active}
            break
        for s in over:
            out[s] = Fraction(most * source_sizes[s])
        left -= sum(out[s] for s in over)
        active = [s for s in active if s not in over]
    return out


def min_cost_flow(capacity: dict, members: dict, quota: dict, copies: int = 2) -> dict:
    """Words of each (pattern, source), by successive cheapest paths.

    capacity: words of a pattern; the k-th copy of them costs k a word.
    members: the sources of a pattern. quota: words wanted of a source.
    """
    graph: list[list] = []  # to, capacity, cost, of the edges; the reverse of edge i is i ^ 1
    out_edges: dict = defaultdict(list)

    def edge(a, b, cap, cost):
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            out_edges[x].append(len(graph))
            graph.append([y, c, w])

    begin, end = ("begin",), ("end",)
    for p, words in capacity.items():
        for k in range(copies):
            edge(begin, ("p", p), words, k)
        for s in members[p]:
            edge(("p", p), ("s", s), copies * words, 0)
    for s, words in quota.items():
        edge(("s", s), end, words, 0)
    while True:
        cost, via, queue, queued = {begin: 0}, {}, deque([begin]), {begin}
        while queue:
            x = queue.popleft()
            queued.discard(x)
            for i in out_edges[x]:
                y, cap, w = graph[i]
                if cap > 0 and cost[x] + w < cost.get(y, float("inf")):
                    cost[y], via[y] = cost[x] + w, i
                    if y not in queued:
                        queue.append(y)
                        queued.add(y)
        if end not in via:
            break
        path, x = [], end
        while x != begin:
            path.append(via[x])
            x = graph[via[x] ^ 1][0]
        push = min(graph[i][1] for i in path)
        for i in path:
            graph[i][1] -= push
            graph[i ^ 1][1] += push
    flow = {}
    for p in capacity:
        for i in out_edges[("p", p)]:
            y = graph[i][0]
            if y != begin and y[0] == "s" and i % 2 == 0:
                flow[p, y[1]] = graph[i ^ 1][1]
    return flow


def _nearest(items: list[int], gap: int) -> list[int]:
    """Places of the items whose sum comes nearest to `gap`, by the set of all reachable sums (a bit per sum)."""
    limit = (1 << (gap + max(items, default=0) + 1)) - 1
    reach = [1]
    for x in items:
        reach.append((reach[-1] | reach[-1] << x) & limit)
    last, off = reach[-1], 0
    while True:
        if off <= gap and last >> (gap - off) & 1:
            total = gap - off
            break
        if last >> (gap + off) & 1:
            total = gap + off
            break
        off += 1
    out = []
    for k in range(len(items), 0, -1):
        if not reach[k - 1] >> total & 1:
            out.append(k - 1)
            total -= items[k - 1]
    return out[::-1]


def fill(sizes_: np.ndarray, gap: int, most: int = 1) -> np.ndarray:
    """Copies of documents, in the given order, whose words come nearest to `gap`.

    Documents are taken one after the other until shortly before the gap is
    full; which of the next `WINDOW` fill it best is searched. If once each
    doesn't come within NEAR of it, those may be taken up to `most` times.
    """
    copies = np.zeros(len(sizes_), np.int64)
    total = np.cumsum(sizes_)
    full = int(np.searchsorted(total, gap, "right"))
    begin = max(0, full - WINDOW // 2)
    copies[:begin] = 1
    gap -= int(total[begin - 1]) if begin else 0
    window = np.arange(begin, min(len(sizes_), full + WINDOW // 2))
    items = sizes_[window].tolist()
    chosen = _nearest(items, gap)
    if most > 1 and abs(sum(items[k] for k in chosen) - gap) > NEAR * gap:
        chosen = [k % len(items) for k in _nearest(items * most, gap)]
    for k in chosen:
        copies[window[k]] += 1
    return copies


class Mix:
    """The plan of a mix: what to take of each pattern, from a staged table of sizes."""

    def __init__(self, measured: DataFrame, seed: int = SEED, weights: Sequence[int] = (5, 2, 1), share: Fraction = Fraction(3, 2), most: int = 2):
        self.seed, self.spark, self.most = seed, measured.sparkSession, most
        rows = measured.groupBy("pattern").agg(F.sum("size"), F.count("*")).collect()  # a row per set of sources
        self.members = {r[0]: json.loads(r[0]) for r in rows}
        self.size = {r[0]: int(r[1] or 0) for r in rows}
        self.source_size: dict[str | None, int] = defaultdict(int)
        for p, own in self.members.items():
            for x in own:
                self.source_size[x] += self.size[p]
        total = sum(self.size[p] for p, own in self.members.items() if own)
        self.target = targets(dict(self.source_size), weights, share, most, total)
        self.flow = min_cost_flow(self.size, self.members, {x: int(n) for x, n in self.target.items()}, most)
        self.amount = {p: sum(self.flow.get((p, x), 0) for x in own) for p, own in self.members.items()}
        # Of each pattern: rounds over all of it, then what is left to reach, the ranges on the way and those reached.
        self.whole = {p: min(most, self.amount[p] // n) if n else 0 for p, n in self.size.items()}
        self.gap = {p: self.amount[p] - self.whole[p] * n for p, n in self.size.items()}
        self.ranges: dict[str, list[int]] = {p: [] for p in self.size}
        self.reached: dict[str, list[int]] = {p: [] for p in self.size}
        left = {r[0]: r[2] for r in rows}
        while left:
            deeper = {p for p, n in left.items() if n > ROWS_PER_BUCKET} or (set(left) if not self.depth else set())
            if not deeper and self.depth:
                break
            for p in self.ranges:
                self.ranges[p].append(min(MAX_BUCKETS, max(1, -(-left[p] // ROWS_PER_BUCKET))) if p in deeper else 1)
            k, per = self.depth - 1, defaultdict(dict)
            for r in self._within(self.mark(measured), k).groupBy("pattern", f"bucket{k}").agg(F.sum("size"), F.count("*")).collect():  # MAX_BUCKETS rows a pattern at most
                per[r[0]][r[1]] = int(r[2] or 0), r[3]
            for p in self.ranges:
                b = 0
                while b < self.ranges[p][k] - 1 and per[p].get(b, (0, 0))[0] <= self.gap[p]:
                    self.gap[p] -= per[p].get(b, (0, 0))[0]
                    b += 1
                self.reached[p].append(b)
                now = per[p].get(b, (0, 0))[1]
                # Rows that no hash tells apart stay together.
                left[p] = now if now < left[p] else min(now, ROWS_PER_BUCKET)

    @property
    def depth(self) -> int:
        return max(map(len, self.ranges.values()), default=0)

    def lookup(self) -> DataFrame:
        """A row per pattern."""
        d = self.depth
        rows = [(p, self.size[p], self.whole[p], self.gap[p], self.ranges[p], self.reached[p] + [0] * (d - len(self.reached[p]))) for p in self.size]
        return self.spark.createDataFrame(rows, "p_pattern string, pattern_size long, whole long, gap long, ranges array<int>, reached array<int>")

    def mark(self, rows: DataFrame) -> DataFrame:
        """Add the pattern's plan and the row's seeded place: `place`, and the range of each round, `bucket0` and so on."""
        rows = rows.withColumn("place", F.xxhash64(F.lit(self.seed), "doc_id", "size", "tkey"))
        rows = rows.join(F.broadcast(self.lookup()), F.col("pattern") == F.col("p_pattern")).drop("p_pattern")  # a row per pattern
        for k in range(self.depth):
            rows = rows.withColumn(f"bucket{k}", F.pmod(F.xxhash64("place", F.lit(k)), F.col("ranges")[k].cast("long")).cast("int"))
        return rows

    def _within(self, marked: DataFrame, depth: int) -> DataFrame:
        """Rows in the ranges reached in the first `depth` rounds."""
        for k in range(depth):
            marked = marked.where(F.col(f"bucket{k}") == F.col("reached")[k])
        return marked

    def _before(self) -> Column:
        """Whether a row lies before (1), in (null) or after (0) the ranges reached."""
        out = F.lit(None).cast("long")
        for k in reversed(range(self.depth)):
            b, r = F.col(f"bucket{k}"), F.col("reached")[k]
            out = F.when(b < r, F.lit(1)).when(b > r, F.lit(0)).otherwise(out).cast("long")
        return out

    def decide(self, measured: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows with `taken`: those outside and those inside the one range of each pattern that is taken in part."""
        most, marked = self.most, self.mark(measured).withColumn("before", self._before())
        sure = marked.where("before is not null").withColumn("taken", F.col("size") * (F.col("whole") + F.col("before")))
        edge = marked.where("before is null").select("doc_id", "pattern", "tkey", "size", "place", "whole", "gap")

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["place", "doc_id", "tkey", "size"], na_position="first", kind="stable")
            whole = int(pdf["whole"].iloc[0])
            pdf["taken"] = pdf["size"] * (whole + fill(pdf["size"].to_numpy(), int(pdf["gap"].iloc[0]), most - whole))
            return pdf

        edge = edge.groupBy("pattern").applyInPandas(run, edge.withColumn("taken", F.lit(0).cast("long")).schema)
        names = ["doc_id", "pattern", "tkey", "size", "taken"]
        return sure.select(names), edge.select(names)


def mixture(docs: DataFrame, sources: Column | None = None, **options) -> DataFrame:
    """What the mix takes of every row of `docs`.

    Without `sources`, each row belongs to its `source`: doc_id, source, size,
    source_size, target and taken. With an array of sources: doc_id, sources,
    size, pattern_size, quota (words taken of the row's pattern) and taken.
    """
    spark = docs.sparkSession
    measured = stage(sizes(docs, sources), "mix-sizes")
    mix = Mix(measured, **options)
    before, edge = mix.decide(measured)
    both = before.unionByName(edge)
    if sources is None:
        rows = [(p, own[0], mix.source_size[own[0]], float(mix.target[own[0]])) for p, own in mix.members.items()]
        plan = spark.createDataFrame(rows, "p string, source string, source_size long, target double")
        names = ["doc_id", "source", "size", "source_size", "target", "taken"]
    else:
        rows = [(p, own, mix.size[p], mix.amount[p]) for p, own in mix.members.items()]
        plan = spark.createDataFrame(rows, "p string, sources array<string>, pattern_size long, quota long")
        names = ["doc_id", "sources", "size", "pattern_size", "quota", "taken"]
    return both.join(F.broadcast(plan), F.col("pattern") == F.col("p")).select(names)  # a row per pattern


def mixed(docs: DataFrame, sources: Column | None = None, **options) -> DataFrame:
    """The rows of `docs`, each as many times as the mix takes it.

    The texts are not shuffled: a row's place follows from its own columns, and
    only the rows of the ranges that are taken in part are looked up.
    """
    names = docs.columns
    measured = stage(sizes(docs, sources), "mix-sizes")
    mix = Mix(measured, **options)
    _, edge = mix.decide(measured)
    edge = edge.select(F.col("doc_id").alias("e_id"), F.col("pattern").alias("e_pattern"), F.col("tkey").alias("e_tkey"), "taken")
    # Equal rows differ in what is taken by their number only.
    again = Window.partitionBy("e_id", "e_pattern", "e_tkey").orderBy(F.desc("taken"))
    edge = stage(edge.withColumn("e_nth", F.row_number().over(again)), "mix-edge")
    rows = docs.withColumn("weft_row", F.struct(*[F.col(f"`{c}`") for c in names]))
    text = F.col("text").cast("string")
    rows = rows.select("weft_row", F.col("doc_id").cast("long").alias("doc_id"), _pattern(docs, sources).alias("pattern"), F.xxhash64(text).alias("tkey"), n_words(text).alias("size"))
    marked = mix.mark(rows).withColumn("before", mix._before())
    sure = marked.where("before is not null").withColumn("copies", (F.col("whole") + F.col("before")) * (F.col("size") > 0).cast("long"))
    part = marked.where("before is null").withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "pattern", "tkey").orderBy("place")))
    part = part.join(edge, F.col("doc_id").eqNullSafe(F.col("e_id")) & (F.col("pattern") == F.col("e_pattern")) & F.col("tkey").eqNullSafe(F.col("e_tkey")) & (F.col("nth") == F.col("e_nth")), "left")
    part = part.withColumn("copies", F.when(F.col("size") > 0, F.coalesce(F.col("taken"), F.lit(0)) / F.col("size")).otherwise(0).cast("long"))
    both = sure.select("weft_row", "copies").unionByName(part.select("weft_row", "copies")).where("copies > 0")
    return both.select(F.explode(F.expr("sequence(1L, copies)")).alias("weft_copy"), "weft_row").select("weft_row.*")
