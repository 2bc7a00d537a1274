"""Benchmark decontamination with an FM-index per training shard.

A shard is a piece of a task's documents (about 2 MB of whole texts). Its words
become symbols: the number of the word in the benchmark's vocabulary, or a
break. Runs of known words shorter than the shortest window can't hold one
and are left out, which is exact. Over the rest, a suffix array gives the
Burrows-Wheeler transform, kept as a wavelet matrix (a bit vector with
prefix counts per bit of the symbol) and suffix positions at every
`SAMPLE`-th place. All benchmark windows are searched backwards at once; each
occurrence is located by stepping to a sampled position, and the spans of all
occurrences are merged.

The benchmark is the query set: its words are counted, and parts of at most
about `PASS_WORDS` of them, in blocks of `BLOCK_WORDS`, are broadcast, each
for one pass over the documents. Documents are not shuffled, but for the
numbers that put several passes' results together.

Defined results: null and empty texts have no words, no hits and are clean;
benchmark items without words have no window; items of fewer than `width`
words are one window; a null item_id is the name "", which several items may
share, as any other; repeated documents each get their own row, repeated items
count by their ids, once each; a window found at several places, or windows
that tie or overlap, count each word once; a very long text is a shard by
itself, of about 100 bytes a word in memory; empty tables on either side give
an empty result or no hits; further columns are ignored, or kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t
from ._common import ship, stage

WIDTH = 10
SAMPLE = 8
SHARD_BYTES = 2 << 20
BLOCK_WORDS = 500_000
#: Words of the benchmark that one pass over the documents searches; their blocks are broadcast together, under 200 MB.
PASS_WORDS = 2_000_000
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: A-Z to a-z; words are a-z, 0-9 and all beyond ASCII.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:int,end:int>>"


class Phrases:
    """The windows of a block of benchmark items: distinct ones, with the items that have them."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        self.names = [x[0] for x in items]
        data, offsets = t.buffers(pa.array([x[1] for x in items], pa.string()))
        data = _LOWER[data]
        starts, ends, at = t.word_spans(data, offsets, _WORD)
        hashes = t.span_hash(data, starts, ends)
        self.vocabulary = np.unique(hashes)  # symbol k + 1 is the word at k; 0 is a break
        symbols = np.searchsorted(self.vocabulary, hashes).astype(np.int32) + 1
        size = np.diff(at)
        count = np.where(size > 0, np.maximum(size - width + 1, 1), 0)
        item = np.repeat(np.arange(len(items)), count)
        first = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + at[:-1][item]
        length = np.minimum(size, width)[item]
        table = np.zeros((len(item), width), np.int32)  # right-aligned
        for k in range(width):
            inside = np.flatnonzero(k < length)
            table[inside, width - length[inside] + k] = symbols[first[inside] + k]
        self.table, which = np.unique(table, axis=0, return_inverse=True) if len(table) else (table, np.zeros(0, np.int64))
        self.lengths = (self.table > 0).sum(axis=1)
        self.shortest = int(self.lengths.min()) if len(self.table) else 0
        # The items of each window, each once.
        pairs = np.unique(which.ravel() * np.int64(len(items) + 1) + item)
        self.owner = pairs % (len(items) + 1)
        self.begin = np.searchsorted(pairs // (len(items) + 1), np.arange(len(self.table) + 1))

    def items(self, window: int) -> list[str]:
        return [self.names[k] for k in self.owner[self.begin[window] : self.begin[window + 1]].tolist()]


class WaveletMatrix:
    """Rank of a symbol before a place, one bit vector per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, n_bits: int):
        self.n_bits, self.counts, self.zeros = n_bits, [], []
        s = symbols
        for bit in range(n_bits - 1, -1, -1):
            ones = (s >> bit) & 1
            count = np.zeros(len(s) + 1, np.int32)
            np.cumsum(ones, out=count[1:])
            self.counts.append(count)
            self.zeros.append(len(s) - int(count[-1]))
            s = np.concatenate([s[ones == 0], s[ones == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low = np.zeros(len(place), np.int64)
        high = place.astype(np.int64)
        for k, bit in enumerate(range(self.n_bits - 1, -1, -1)):
            count, one = self.counts[k], ((symbol >> bit) & 1).astype(bool)
            a, b = count[low], count[high]
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
        return high - low

    def access(self, place: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        out = np.zeros(len(place), np.int64)
        at = place.astype(np.int64)
        for k in range(self.n_bits):
            count = self.counts[k]
            one = count[at + 1] - count[at]
            out = out * 2 + one
            at = np.where(one == 1, self.zeros[k] + count[at], at - count[at])
        return out


class FMIndex:
    """Counts and places of symbol strings in a text of symbols, in which 0 is a break that matches nothing."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        n = len(symbols)
        # Every break counts as a symbol of its own, so that suffixes are told apart there.
        breaks = symbols == 0
        first = symbols + int(breaks.sum())
        first[breaks] = np.arange(int(breaks.sum()))
        order = t.SuffixArray(first, np.full(n, n)).order
        self.n = n
        before = symbols[order - 1]  # the text is read as a ring; its last symbol is a break
        top = int(symbols.max()) if n else 0
        self.below = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(symbols, minlength=top + 1), out=self.below[1:])
        self.matrix = WaveletMatrix(before, max(1, top.bit_length()))
        # Places after a break are sampled too: a step over a break is never needed.
        self.known = (order % sample == 0) | (before == 0)
        self.at = np.zeros(n + 1, np.int64)
        np.cumsum(self.known, out=self.at[1:])
        self.samples = order[self.known]

    def search(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that start with each row of `table`; zeros on the left are not part of a row."""
        low, high = np.zeros(len(table), np.int64), np.full(len(table), self.n, np.int64)
        for k in range(table.shape[1] - 1, -1, -1):
            live = np.flatnonzero((table[:, k] > 0) & (low < high))
            symbol = table[live, k]
            fits = symbol < len(self.below) - 1
            low[live[~fits]] = high[live[~fits]] = 0
            live, symbol = live[fits], symbol[fits]
            base = self.below[symbol]
            low[live] = base + self.matrix.rank(symbol, low[live])
            high[live] = base + self.matrix.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes by their places in the order."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo, row = np.arange(len(rows)), rows.astype(np.int64)
        while len(todo):
            known = self.known[row]
            out[todo[known]] = self.samples[self.at[row[known]]] + steps[todo[known]]
            todo, row = todo[~known], row[~known]
            symbol = self.matrix.access(row)
            row = self.below[symbol] + self.matrix.rank(symbol, row)
            steps[todo] += 1
        return out


def occurrences(word: np.ndarray, at: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence; word: hashes of a shard's words, at: offsets of its documents."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(word) or not len(phrases.table):
        return none
    k = np.minimum(np.searchsorted(phrases.vocabulary, word), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[k] == word
    # Runs of known words within a document, of at least the shortest window.
    change = np.ones(len(word) + 1, bool)
    change[1:-1] = known[1:] != known[:-1]
    change[at] = True
    edge = np.flatnonzero(change)
    begin, end = edge[:-1], edge[1:]
    good = known[begin] & (end - begin >= phrases.shortest)
    begin, end = begin[good], end[good]
    if not len(begin):
        return none
    size = end - begin + 1  # a break ends each run
    total = int(size.sum())
    where = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
    symbols = np.where(where < np.repeat(end, size), k[np.minimum(where, len(word) - 1)] + 1, 0)
    index = FMIndex(symbols.astype(np.int64))
    low, high = index.search(phrases.table)
    n = high - low
    hit = np.flatnonzero(n > 0)
    if not len(hit):
        return none
    rows = np.repeat(low[hit] - np.cumsum(n[hit]) + n[hit], n[hit]) + np.arange(int(n[hit].sum()))
    return where[index.locate(rows)], np.repeat(hit, n[hit])


def _parts(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in parts of about PASS_WORDS words, one for each pass over the documents."""
    slim = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    words = F.regexp_count(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORDS))
    total = slim.agg(F.sum(words)).first()[0] or 0
    n = max(1, -(-total // PASS_WORDS))
    return [slim.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _shared(part: DataFrame, width: int) -> list:
    """One part as broadcast blocks of bounded size; its rows come to the driver one partition at a time."""
    sc = part.sparkSession.sparkContext
    out, items, words = [], [], 0

    def close() -> None:
        block = Phrases(items, width)
        if len(block.table):
            out.append(sc.broadcast(block))

    for r in part.toLocalIterator():
        data = _LOWER[np.frombuffer((r[1] or "").encode(), np.uint8)]
        items.append((r[0], r[1]))
        words += len(t.word_spans(data, np.array([0, len(data)]), _WORD)[0])
        if words >= BLOCK_WORDS:
            close()
            items, words = [], 0
    if items:
        close()
    return out


def _spans(hit: np.ndarray) -> list[dict[str, int]]:
    step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]


def _pass(docs: DataFrame, part: DataFrame, width: int) -> DataFrame:
    """SCHEMA of the rows (doc_id, text) against one part of the benchmark."""
    shared = _shared(part, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in t.slices(batches, "text", SHARD_BYTES):
            n = rows.num_rows
            data = _LOWER[data]
            starts, ends, at = t.word_spans(data, offsets, _WORD)
            word = t.span_hash(data, starts, ends)
            found: list[set] = [set() for _ in range(n)]
            firsts, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for b in shared:
                first, window = occurrences(word, at, b.value)
                firsts.append(first)
                lengths.append(b.value.lengths[window])
                doc = np.searchsorted(at, first, "right") - 1
                for d, w in np.unique(np.stack([doc, window], 1), axis=0).tolist() if len(doc) else []:
                    found[d].update(b.value.items(w))
            hit = t.covered(np.concatenate(firsts), np.concatenate(lengths), len(word))
            n_hit = t.per_document(hit, at)
            spans = [_spans(hit[at[d] : at[d + 1]]) if n_hit[d] else [] for d in range(n)]
            names = [sorted(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(np.diff(at).astype(np.int64)),
                    pa.array(n_hit.astype(np.int64)),
                    pa.array([len(x) for x in names], pa.int64()),
                    pa.array(names, pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                [c.split()[0] for c in ("doc_id", "n_words", "n_hit", "n_items", "items", "spans")],
            )

    return docs.mapInArrow(run, SCHEMA)


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """What of the benchmark each document holds, see SCHEMA; spans are of words, merged."""
    ship(docs.sparkSession)
    parts = _parts(benchmark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if len(parts) == 1:
        return _pass(slim, parts[0], width)
    # Several passes: rows get a number, and what the passes find of one row is put together.
    numbered = stage(slim.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    passes = [stage(_pass(numbered.select(F.col("row").alias("doc_id"), "text"), part, width).where(f"n_hit > 0 or {k} = 0"), "decontaminate") for k, part in enumerate(parts)]
    every = passes[0]
    for x in passes[1:]:
        every = every.unionByName(x)
    merged = every.groupBy(F.col("doc_id").alias("row")).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        _union(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    out = numbered.select("row", "doc_id").join(merged, "row")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans")


def _union(spans):
    """Spans sorted and merged."""

    def add(out, x):
        last = F.try_element_at(out, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(longer))
        return F.when((F.size(out) > 0) & (x["start"] <= F.try_element_at(out, F.lit(-1))["end"]), joined).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:int,end:int>>"), add)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of `docs`, all columns, that hold no window of the benchmark."""
    ship(docs.sparkSession)
    for part in _parts(benchmark):
        shared = _shared(part, width)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for rows, data, offsets in t.slices(batches, "text", SHARD_BYTES):
                data = _LOWER[data]
                starts, ends, at = t.word_spans(data, offsets, _WORD)
                word = t.span_hash(data, starts, ends)
                good = np.ones(rows.num_rows, bool)
                for b in shared:
                    first, _ = occurrences(word, at, b.value)
                    good[np.searchsorted(at, first, "right") - 1] = False
                yield rows.filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
