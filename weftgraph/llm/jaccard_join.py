"""N-gram Jaccard self-join by chosen paths.

A document is the set of its five-word shingles (a shorter text is one
shingle). Documents with equal sets form a class and go on as one. In each of
`RUNS` runs a class follows paths of sampled tokens: a token is chosen where
its hash lies below BRANCH / size, below each chosen token further tokens are
chosen by the hash of the path, and classes that share a path share a bucket.
Two sets of similarity 0.8 share BRANCH * 0.8 = 1 or more chosen tokens at
every level, unlike sets almost none. Buckets of at most `SMALL` classes are
brute-forced; larger ones are split by the next token of their paths. What is
still large after three tokens, and not connected yet, is split by sampled
bits of the sets' min-hash sketches, repeated until the target recall
(`sketch_splits`); what no split separates is linked to one representative.
No bucket is capped, and no row is copied once for each block of its bucket.
The number of runs follows from the target recall (`runs_needed`).

Brute force in a bucket compares sizes and 128-bit min-hash sketches and
keeps a spanning set of the pairs that may be similar. Their connected
components hold all candidates. Within a component every pair is then decided
exactly on the whole sets, each text being fetched once. A component of more
than BLOCK_ROWS different sets is packed into blocks of bounded size, a value
each, and every two blocks meet in one task: exact numbers of links between
different texts need that; only counts and spanning edges leave a task, never
pairs. Copies cost nothing, as they are one set.

Two sets of at least SKETCH_FROM shingles also have to agree in SKETCH_AGREE
of 128 bits, of which 115 agree on average at similarity 0.8: this loses less
than one pair in 10,000 there, which the tests measure against all pairs.

A very long text is one set of as many shingles; it is held by one task at a
time, in about 60 times its size. Ties can't decide anything: equal sets are
one class, and a class's least doc_id leads it.

Defined results: null and empty texts have no shingles, are their own class
and have no links; repeated rows and equal sets are one class and link to each
other; of a null doc_id the class is led by the least id there is, or null;
an empty table gives an empty result; further columns pass through
`keep_one` and are ignored otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as t
from ._common import stage, stage_counted, whole_groups
from ._graph import components

SHINGLE = 5
#: Similarity 0.8, as 9 * common >= 4 * (size + size).
BRANCH = 1.25
POOL = 8  # tokens of a run that deeper levels choose from, on average
RECALL = 0.9995
SMALL = 256
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 500_000
#: Below this size the sketch says too little and isn't asked.
SKETCH_FROM, SKETCH_AGREE = 64, 88
_BINS = 128
NULL_ID = -(2**63)
#: Ids or paths (8 bytes each) that may be broadcast, by count.
BROADCAST_IDS = 500_000
_SHINGLE_BASE = 0xD6E8FEB86659FD93


def runs_needed(recall: float = RECALL, overlap: float = 0.8, depth: int = 3) -> int:
    """Runs until a pair that shares `overlap` of the larger set meets with probability `recall`, at the deepest level."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-BRANCH * overlap * p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, flat, and the n + 1 offsets."""
    starts, ends, at = t.word_spans(data, offsets)
    n = len(offsets) - 1
    word = t.span_hash(data, starts, ends)
    size = np.diff(at)
    count = np.where(size > 0, np.maximum(size - SHINGLE + 1, 1), 0)
    owner = np.repeat(np.arange(n), count)
    first = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[:-1], count)
    h = np.zeros(len(first), np.uint64)
    for k in range(SHINGLE):
        inside = first + k < at[1:][owner]
        h += np.where(inside, word[np.minimum(first + k, max(0, len(word) - 1))], np.uint64(k + 1)) * np.uint64(pow(_SHINGLE_BASE, k + 1, 2**64))
    h = t.mix(h)
    _, one, _ = t.distinct(t.mix(h + owner.astype(np.uint64) * np.uint64(t.BASE)))
    one.sort()
    h, owner = h[one], owner[one]
    return h, np.searchsorted(owner, np.arange(n + 1))


def set_ids(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit number of each set, whatever the order; 0 for an empty one."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(t.mix(h * np.uint64(3) + np.uint64(1)), out=total[1:])
    n = np.diff(at)
    ids = t.mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64))
    return np.where(n > 0, ids, np.uint64(0)).view(np.int64)


def sketches(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One bit of the least hash in each of 128 bins; an empty bin takes another's, in an order common to all."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    x = t.mix(h ^ np.uint64(0x5851F42D4C957F2D))
    least = np.full(n * _BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, owner * _BINS + (x & np.uint64(_BINS - 1)).astype(np.int64), x >> np.uint64(7))
    least = least.reshape(n, _BINS)
    empty = least == np.iinfo(np.uint64).max
    filled = least.copy()
    bins = np.arange(_BINS)
    for k in range(1, 64):
        doc, b = np.nonzero(filled == np.iinfo(np.uint64).max)
        if not len(doc):
            break
        source = (bins[b] * 37 + k * (2 * bins[b] + 1)) % _BINS
        ok = ~empty[doc, source]
        filled[doc[ok], b[ok]] = least[doc[ok], source[ok]]
    return np.packbits((filled & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)


def paths(h: np.ndarray, at: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, path of two tokens) of all runs, and (number of such a path, its path of three tokens)."""
    n = len(at) - 1
    size = np.maximum(np.diff(at), 1)
    owner = np.repeat(np.arange(n), np.diff(at))
    # As 32-bit thresholds: a hash counts as chosen if its high half lies below.
    bar = (np.minimum(POOL / size, 1.0) * 2**32).astype(np.uint64)[owner]
    take = (np.minimum(BRANCH / size, 1.0) * 2**32).astype(np.uint64)
    deeper = (np.minimum(BRANCH / np.minimum(size, POOL), 1.0) * 2**32).astype(np.uint64)
    docs, seconds, parents, thirds, base = [], [], [], [], 0
    for r in range(runs):
        odd = pow(t.BASE, 2 * r + 3, 2**64) | 1
        salt = np.array([(r + 1) * t.BASE % 2**64, (r + 1) * odd % 2**64], np.uint64)
        x = ((t.mix(salt[:1]) ^ h) * np.uint64(odd)) >> np.uint64(32)
        pool = np.flatnonzero(x < bar)
        tok, doc = h[pool], owner[pool]
        begin = np.searchsorted(doc, np.arange(n + 1))
        first = np.flatnonzero(x[pool] < take[doc])
        node_doc, node = doc[first], t.mix(tok[first] + salt[1])

        def grow(node_doc, node, tok=tok, begin=begin):
            """Children of each node: index of the parent, path."""
            count = (begin[1:] - begin[:-1])[node_doc]
            parent = np.repeat(np.arange(len(node)), count)
            which = np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[:-1][node_doc], count)
            child = t.mix(node[parent] * np.uint64(5) + tok[which])
            chosen = (t.mix(child ^ np.uint64(0xA5A5A5A5)) >> np.uint64(32)) < deeper[node_doc[parent]]
            return parent[chosen], child[chosen]

        parent2, two = grow(node_doc, node)
        doc2 = node_doc[parent2]
        parent3, three = grow(doc2, two)
        docs.append(doc2)
        seconds.append(two.view(np.int64))
        parents.append(parent3 + base)
        thirds.append(three.view(np.int64))
        base += len(two)
    return np.concatenate(docs), np.concatenate(seconds), np.concatenate(parents), np.concatenate(thirds)


_MEASURED = "id long, cid long, n int, s0 long, s1 long, p array<long>, more array<array<long>>"


def measured(docs: DataFrame, runs: int) -> DataFrame:
    """A row per document: the number of its set, its size and sketch, its paths and how they go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in t.slices(batches, "text"):
            n = rows.num_rows
            h, at = shingles(data, offsets)
            doc, second, parent, third = paths(h, at, runs)
            by = np.argsort(doc, kind="stable")
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            ends = pa.array(np.searchsorted(doc[by], np.arange(n + 1)).astype(np.int32))
            child = np.argsort(place[parent], kind="stable")
            inner = pa.array(np.searchsorted(place[parent][child], np.arange(len(by) + 1)).astype(np.int32))
            sk = sketches(h, at)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0), pa.array(set_ids(h, at)), pa.array(np.diff(at).astype(np.int32)), pa.array(sk[:, 0].copy()), pa.array(sk[:, 1].copy()),
                    pa.ListArray.from_arrays(ends, pa.array(second[by])), pa.ListArray.from_arrays(ends, pa.ListArray.from_arrays(inner, pa.array(third[child]))),
                ],
                ["id", "cid", "n", "s0", "s1", "p", "more"],
            )

    return _slim(docs).mapInArrow(run, _MEASURED)


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.col("text").cast("string").alias("text"))


def _may_link(n, s0, s1, i, j) -> np.ndarray:
    """Sizes within 0.8 of each other, and sketches that agree or don't count."""
    low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    ok = 5 * low.astype(np.int64) >= 4 * high.astype(np.int64)
    differ = (np.bitwise_count((a[i] ^ a[j]).view(np.uint64)).astype(np.int64) for a in (s0, s1))  # of signed numbers it counts the absolute value's
    agree = 128 - sum(differ)
    return ok & ((agree >= SKETCH_AGREE) | (low < SKETCH_FROM))


def _labels(adjacent: np.ndarray) -> np.ndarray:
    """Least member of each one's component, by a boolean matrix."""
    m = len(adjacent)
    label = np.arange(m)
    while True:
        new = np.where(adjacent, label[None, :], m).min(axis=1, initial=m)
        new = np.minimum(label, new)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _bucket_edges(whole: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Spanning pairs of cids that may be similar, in buckets of bounded size."""
    key = whole.column(0).to_numpy()
    cid, n, s0, s1 = (whole.column(k).to_numpy() for k in range(1, 5))
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    a, b = [], []
    few = np.repeat(size <= 8, size)
    for shift in range(1, 8):
        i = np.flatnonzero((key[:-shift] == key[shift:]) & few[:-shift]) if len(key) > shift else np.zeros(0, np.int64)
        if not len(i):
            break
        ok = _may_link(n, s0, s1, i, i + shift)
        a.append(cid[i[ok]])
        b.append(cid[i[ok] + shift])
    for g in np.flatnonzero(size > 8).tolist():
        at = np.arange(begin[g], begin[g] + size[g])
        i, j = np.meshgrid(at, at, indexing="ij")
        label = _labels(_may_link(n, s0, s1, i, j))
        far = np.flatnonzero(label != np.arange(len(at)))
        a.append(cid[at[far]])
        b.append(cid[at[label[far]]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _edges_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, len(keys)):
            if len(keys) > 1:  # blocks of one bucket
                whole = _merged_key(whole, len(keys))
            a, b = _bucket_edges(whole)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows = rows.select(*keys, "cid", "n", "s0", "s1")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "cid").mapInArrow(run, "a long, b long")


def _merged_key(whole: pa.Table, n_keys: int) -> pa.Table:
    cols = [whole.column(k).to_numpy() for k in range(n_keys)]
    change = np.zeros(whole.num_rows, np.int64)
    for c in cols:
        change[1:] |= c[1:] != c[:-1]
    names = ["key", *whole.column_names[n_keys:]]
    return pa.table([pa.array(np.cumsum(change)), *whole.columns[n_keys:]], names=names)


def _shared(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged: the (p, cid) of buckets with several members, and the members of each bucket."""
    several = pairs.groupBy("p").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a <> b").select("p")
    shared = stage(pairs.join(several, "p").distinct(), "jaccard-shared")
    return shared, stage(shared.groupBy("p").agg(F.count("*").alias("c")), "jaccard-counts")


def _blocks(rows: DataFrame) -> DataFrame:
    """Members of large buckets (p, c, cid, n, s0, s1) in blocks; every bucket deals its members out anew, so that what meets in none of them meets in another."""
    rows = rows.withColumn("nb", F.ceil(F.col("c") / BLOCK_ROWS))
    return rows.withColumn("i", F.pmod(F.xxhash64("cid", "p"), F.col("nb")).cast("int"))


def sketch_splits(largest: int, recall: float = RECALL) -> tuple[int, int]:
    """Bits per split and number of splits of large buckets of up to `largest` sets.

    Bits of sets of similarity 0.8 agree 9 times in 10; those of sets that share
    but a third, 65 times in 100, and SMALL of these or fewer should stay together.
    """
    bits = max(16, math.ceil(math.log(max(1.0, largest / SMALL)) / -math.log(0.65)))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - 0.9**bits))


def _split(members: DataFrame, bits: int, splits: int) -> DataFrame:
    """(p, cid): each set under a sample of its sketch's bits, once for each split."""
    rng = np.random.default_rng(11)
    masks = np.zeros((splits, 128), np.uint8)
    for row in masks:
        row[rng.choice(128, min(bits, 128), replace=False)] = 1
    masks = np.packbits(masks, axis=1).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cid, s0, s1 = (b.column(k).to_numpy() for k in range(3))
            for r, (m0, m1) in enumerate(masks):
                key = t.mix(t.mix((s0 & m0).view(np.uint64) + np.uint64(2 * r + 1)) ^ (s1 & m1).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0)], ["p", "cid"])

    return members.select("cid", "s0", "s1").mapInArrow(run, "p long, cid long")


def candidate_components(rows: DataFrame, classes: DataFrame, recall: float = RECALL) -> DataFrame:
    """(node, root): components of cids that hold all similar pairs that met.

    rows: cid, p, more; classes: cid, n, s0, s1; both staged. Only paths and
    numbers of sets are shuffled until it is known who shares a path.
    """
    about = classes.select("cid", "n", "s0", "s1")
    pairs = rows.select("cid", F.explode("p").alias("p"))
    edges: DataFrame | None = None
    for level in (2, 3):
        shared, counts = _shared(pairs)
        small = shared.join(counts.where(F.col("c") <= SMALL).select("p"), "p").join(about, "cid")
        small = _edges_of(small, ["p"])
        edges = small if edges is None else edges.unionByName(small)
        large = counts.where(F.col("c") > SMALL)
        n_large = large.count()
        if not n_large:
            return components(edges)
        if level == 2:
            split = F.broadcast(large) if n_large <= BROADCAST_IDS else large
            zipped = rows.select("cid", F.explode(F.arrays_zip("p", "more")).alias("x")).select("cid", F.col("x.p").alias("p"), F.col("x.more").alias("more"))
            pairs = stage(zipped.join(split.select("p"), "p").select("cid", F.explode("more").alias("p")), "jaccard-third")
    # Still large after three tokens. First blocks of each bucket: what this and
    # the other buckets connect needs no further look, as all pairs of a
    # component are decided later.
    left = stage(_blocks(shared.join(large, "p").join(about, "cid")), "jaccard-left")
    edges = stage(edges.unionByName(_edges_of(left, ["p", "i"])), "jaccard-edges")
    comps = components(edges)
    left = left.where("nb > 1").join(comps.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    apart = left.groupBy("p").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("p")
    left, n_left = stage_counted(left.join(apart, "p"), "jaccard-apart")
    if not n_left:
        return comps
    # Sets that share a path by a common passage, mostly: they are split by the
    # bits of their sketches, a row for each set and split, whatever the bucket's size.
    bits, splits = sketch_splits(left.agg(F.max("c")).first()[0], recall)
    members = stage(left.select("cid", "s0", "s1").distinct(), "jaccard-members")
    shared, counts = _shared(stage(_split(members, bits, splits), "jaccard-split"))
    small = _edges_of(shared.join(counts.where(F.col("c") <= SMALL).select("p"), "p").join(about, "cid"), ["p"])
    # What no split separates is near-equal: each is linked to one representative.
    many = shared.join(counts.where(F.col("c") > SMALL).select("p"), "p")
    star = many.join(many.groupBy("p").agg(F.min("cid").alias("b")), "p").where("cid <> b").select(F.col("cid").alias("a"), "b")
    return components(edges.unionByName(small).unionByName(star))


def _exact(h: list[np.ndarray], side: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of similar sets; `same`: all pairs, else only pairs of different sides."""
    m = len(h)
    size = np.array([len(x) for x in h], np.int64)
    tok = np.concatenate(h) if m else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(m), size)
    by = np.argsort(tok, kind="stable")
    tok, row = tok[by], row[by]
    fresh = np.concatenate([[True], tok[1:] != tok[:-1]]) if len(tok) else np.zeros(0, bool)
    begin = np.flatnonzero(fresh)
    df = np.diff(np.append(begin, len(tok)))
    if m <= 16:
        common = np.zeros((m, m), np.int64)
        col = np.cumsum(fresh) - 1
        for shift in range(1, m):
            i = np.flatnonzero(col[:-shift] == col[shift:]) if len(col) > shift else np.zeros(0, np.int64)
            if not len(i):
                break
            common += np.bincount(row[i] * m + row[i + shift], minlength=m * m).reshape(m, m)
        common = common + common.T
    else:
        common = np.zeros((m, m), np.float32)
        wide = np.flatnonzero(df > 1)
        # Columns with equal members count together.
        for k in range(0, len(wide), 2048):
            cols = wide[k : k + 2048]
            x = np.zeros((m, len(cols)), np.float32)
            c = np.repeat(np.arange(len(cols)), df[cols])
            at = np.arange(len(c)) - np.repeat(np.cumsum(df[cols]) - df[cols], df[cols]) + np.repeat(begin[cols], df[cols])
            x[row[at], c] = 1
            common += x @ x.T
        common = common.astype(np.int64)
    links = 9 * common >= 4 * (size[:, None] + size[None, :])
    links &= size[:, None] > 0
    if not same:
        links &= side[:, None] != side[None, :]
    i, j = np.nonzero(np.triu(links, 1))
    return i, j


_FOUND = "cid long, links long, root long, comp long, side int, nb int, block binary"


def _freeze(cid: np.ndarray, copies: np.ndarray, sets: list[np.ndarray]) -> bytes:
    """A block of sets as one value."""
    head = np.array([len(cid)], np.int64)
    return b"".join(x.tobytes() for x in (head, cid, copies.astype(np.int64), np.array([len(x) for x in sets], np.int64), *sets))


def _thaw(block: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    m = int(np.frombuffer(block, np.int64, 1)[0])
    cid, copies, size = np.frombuffer(block, np.int64, 3 * m, 8).reshape(3, m)
    tok = np.frombuffer(block, np.uint64, offset=8 + 24 * m)
    return cid, copies, np.split(tok, np.cumsum(size)[:-1])


def _links(cid: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], side: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the sets that link: number, links to rows, and the least set that links lead to."""
    i, j = _exact(sets, side, same)
    links = np.bincount(i, copies[j], len(cid)) + np.bincount(j, copies[i], len(cid))
    label = np.arange(len(cid))
    while len(i):  # least label over the links, with jumps
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    hit = np.flatnonzero(links)
    return cid[hit], links[hit].astype(np.int64), cid[label[hit]]


def _found(cid, links, root, comp=None, side=None, nb=None, block=None) -> pa.RecordBatch:
    n = len(cid)
    blank = lambda x, kind: pa.array([x] * n, kind)
    return pa.RecordBatch.from_arrays(
        [pa.array(cid, pa.int64()), pa.array(links, pa.int64()), pa.array(root, pa.int64()), blank(comp, pa.int64()), blank(side, pa.int32()), blank(nb, pa.int32()), blank(block, pa.binary())],
        [c.split()[0] for c in _FOUND.split(", ")],
    )


def _verify(rows: DataFrame) -> DataFrame:
    """Links and local roots of components in one block; of larger ones, their blocks, a row each.

    rows: comp, side, cid, copies, nb and the sets' texts as blob.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        for whole in whole_groups(batches, 2):
            comp, side, cid, copies, nb = (whole.column(k).to_numpy() for k in range(5))
            change = np.concatenate([[True], (comp[1:] != comp[:-1]) | (side[1:] != side[:-1])])
            begin = np.append(np.flatnonzero(change), len(comp))
            blobs = whole.column(5)
            for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                texts = [open_.decompress(x) for x in blobs.slice(a, b - a).to_pylist()]
                lengths = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
                sets, own = [], []
                k = 0
                while k < len(texts):  # a few MB of text at a time
                    e = max(k + 1, int(np.searchsorted(lengths, lengths[k] + (2 << 20), "right")) - 1)
                    data = np.frombuffer(b"".join(texts[k:e]), np.uint8)
                    h, at = shingles(data, lengths[k : e + 1] - lengths[k])
                    own.append(set_ids(h, at))
                    sets += [h[at[i] : at[i + 1]] for i in range(e - k)]
                    k = e
                # Rows of another text under the same doc_id, or repeated rows, don't count.
                mine = np.concatenate(own)
                good, seen = [], set()
                for i in range(b - a):
                    if mine[i] == cid[a + i] and int(cid[a + i]) not in seen:
                        good.append(i)
                        seen.add(int(cid[a + i]))
                at = np.array(good, np.int64)
                c, w, sets = cid[a + at], copies[a + at], [sets[x] for x in good]
                if nb[a] > 1:
                    yield _found([None], [None], [None], int(comp[a]), int(side[a]), int(nb[a]), _freeze(c, w, sets))
                else:
                    yield _found(*_links(c, w, sets, np.zeros(len(c)), True))

    return rows.repartition("comp", "side").sortWithinPartitions("comp", "side", "cid").mapInArrow(run, _FOUND)


def _between(blocks: DataFrame) -> DataFrame:
    """Links within and between the blocks (comp, side, nb, block) of large components; what is copied are blocks, not their members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, 3, rows=1):
            comp, lo, hi, side = (whole.column(k).to_numpy() for k in range(4))
            change = np.concatenate([[True], (comp[1:] != comp[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
            begin = np.append(np.flatnonzero(change), len(comp))
            for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                parts = [_thaw(whole.column(4)[k].as_py()) for k in range(a, b)]
                sides = np.repeat(side[a:b], [len(p[0]) for p in parts])
                cid, copies = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                yield _found(*_links(cid, copies, [x for p in parts for x in p[2]], sides, lo[a] == hi[a]))

    tasks = blocks.select("comp", "side", "block", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    tasks = tasks.select("comp", F.least("side", "o").alias("lo"), F.greatest("side", "o").alias("hi"), "side", "block")
    return tasks.repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi").mapInArrow(run, _FOUND)


def _pack(texts: DataFrame) -> DataFrame:
    """The same rows with the text compressed, as `blob`: a third of the shuffle."""
    others = [f for f in texts.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for rows, data, offsets in t.slices(batches, "text"):
            raw = data.tobytes()
            blobs = [pack.compress(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[rows.column(rows.schema.get_field_index(f.name)) for f in others], pa.array(blobs, pa.binary())], [*[f.name for f in others], "blob"])

    return texts.mapInArrow(run, T.StructType([*others, T.StructField("blob", T.BinaryType())]))


def _least_id(column: str):
    """The least id that isn't null, if there is one."""
    return F.coalesce(F.min(F.when(F.col(column) != NULL_ID, F.col(column))), F.lit(NULL_ID))


def _joined(docs: DataFrame, recall: float) -> DataFrame:
    """id, cid, n, lead, root and n_links of every row; without shingles cid is 0 and the row leads itself."""
    rows = stage(measured(docs, runs_needed(recall)), "jaccard-docs")
    slim = rows.select("id", "cid", "n")
    classes = rows.where("n > 0").groupBy("cid").agg(_least_id("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("s0").alias("s0"), F.first("s1").alias("s1"))
    classes = stage(classes, "jaccard-classes")
    comps = candidate_components(rows.where("n > 0"), classes, recall)
    members = comps.select(F.col("node").alias("cid"), F.col("root").alias("comp")).join(classes.select("cid", "rep", "copies", "n"), "cid")
    members = stage(members, "jaccard-members")
    blocks = members.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    placed = members.join(blocks, "comp").withColumn("side", F.pmod(F.xxhash64("cid", F.lit(5)), F.col("nb").cast("long")).cast("int"))
    placed, n_placed = stage_counted(placed, "jaccard-placed")
    if n_placed <= BROADCAST_IDS:
        texts = _pack(_slim(docs).join(F.broadcast(placed), F.col("id") == F.col("rep")))
    else:
        texts = placed.join(_pack(_slim(docs)), placed["rep"] == F.col("id"))
    found = stage(_verify(texts.select("comp", "side", "cid", "copies", "nb", "blob")), "jaccard-links")
    # A component in one block has its roots already; between blocks they are joined.
    roots = found.where("cid is not null").select("cid", "root")
    if placed.where("nb > 1").limit(1).count():
        more = stage(_between(found.where("block is not null").select("comp", "side", "nb", "block")), "jaccard-between")
        joined = components(more.select(F.col("cid").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("cid"), "root")
        roots = roots.unionByName(joined)
        found = found.where("cid is not null").select("cid", "links").unionByName(more.select("cid", "links"))
    links = found.where("cid is not null").groupBy("cid").agg(F.sum("links").alias("links"))
    info = classes.select("cid", "rep", "copies").join(links, "cid", "left").join(roots, "cid", "left")
    info = info.select("cid", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    lead = info.groupBy("root").agg(_least_id("rep").alias("lead"))
    info = info.join(lead, "root").select("cid", "lead", "root", "n_links")
    none = slim.where("n = 0").select("id", "cid", "n", F.col("id").alias("lead"), F.lit(0).cast("long").alias("root"), F.lit(0).cast("long").alias("n_links"))
    return slim.where("n > 0").join(info, "cid").select("id", "cid", "n", "lead", "root", "n_links").unionByName(none)


def join(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links and n_shingles of every row of `docs` (doc_id, text).

    class_id is the least doc_id of the document's component of links, n_links
    the number of other documents of similarity 0.8 or more, copies included.
    """
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return _joined(docs, recall).select(real("id").alias("doc_id"), real("lead").alias("class_id"), "n_links", F.col("n").cast("long").alias("n_shingles"))


def _with_cid(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in t.slices(batches, "text"):
            cid = set_ids(*shingles(data, offsets))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cid)], [*rows.schema.names, "weft_cid"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("weft_cid", T.LongType())]))


def keep_one(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """The rows of `docs`, all columns, but of each class only one, with the class's least doc_id.

    The ids to drop are broadcast if they are counted to be few. Rows whose
    doc_id other rows have too are told apart by their sets of shingles.
    """
    found = stage(_joined(docs, recall), "jaccard-result")
    many = stage(found.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("id").alias("weft_id")), "jaccard-many")
    gone = stage(found.where("id <> lead").select(F.col("id").alias("weft_id")).distinct(), "jaccard-gone")
    n_many, n_gone = many.count(), gone.count()
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    gone = gone.join(many, "weft_id", "left_anti") if n_many else gone
    once = docs.join(F.broadcast(gone) if n_gone <= BROADCAST_IDS else gone, key == F.col("weft_id"), "left_anti")
    if not n_many:
        return once
    many = F.broadcast(many) if n_many <= BROADCAST_IDS else many
    again = _with_cid(docs.join(many, key == F.col("weft_id"), "left_semi"))
    stays = found.where("id = lead and n > 0").groupBy("root").agg(F.min(F.struct("id", "cid")).alias("x")).select(F.col("x.id").alias("weft_id"), F.col("x.cid").alias("weft_cid"))
    full = again.where("weft_cid <> 0").join(stays, (key == stays["weft_id"]) & (again["weft_cid"] == stays["weft_cid"]), "left_semi")
    full = full.dropDuplicates(["doc_id", "weft_cid"]).unionByName(again.where("weft_cid = 0")).drop("weft_cid")
    return once.join(many, key == F.col("weft_id"), "left_anti").unionByName(full)
