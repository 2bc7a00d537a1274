"""Suffix-array dedup: byte strings that occur twice anywhere in a corpus.

A suffix array of the whole corpus isn't needed to find repeats of at least
`MIN` bytes. Every window of MIN bytes has an anchor, the place of the least
hash of its `GRAM`-byte strings. Equal windows have equal anchor strings at
equal distances, so windows are dealt out by the hash of their anchor, in
segments: the neighbouring windows of one anchor. Most anchors occur once and
are done with; segments that are equal as a whole are one entry with a
multiplicity. What remains, different segments of one anchor, is fetched and
goes into an enhanced suffix array. A stack scan over its common-prefix
lengths builds the interval tree above MIN; an interval is put out as a group
of all its occurrences if what stands left of them differs (otherwise the
interval one byte to the left holds the same occurrences). The spans of the
groups' occurrences are what repeats.

A task holds the different segments of one anchor, and of more anchors up to
BATCH_BYTES. Where they come to more than HOT_BYTES, the windows are dealt out
again, by their distance from the anchor in steps of 16: windows of one step
have 385 bytes in common places, and only those equal there stay together.
What is still too much after that is dealt by single windows, which are equal
or not. So no task's share grows with the corpus, and nothing is capped.

`repeat_groups` gives the maximal repeats whole, across anchors. A maximal
repeat starts where what stands left differs; such starts are few, and each is
followed to the end of its removed span. Starts with one first window are one
group, whose distinct continuations are sorted and scanned in the same way;
groups that are too large for a task are first cut from the top, each round
taking off the common prefix of the least and the greatest member.

`passages` is the same over words instead of bytes: a symbol is a keyed
64-bit BLAKE2b of a word's bytes, a window is PASSAGE words, and what stands
between words doesn't count. It finds the passages that are long in words and
shorter than MIN bytes, or whose white space differs.

A very long text is cut into segments whole, by itself, in about 80 times its
size of memory. Segments count as equal by anchor and a keyed 64-bit BLAKE2b
of their bytes.

Defined results: a null text is as an empty one; a text of fewer than MIN
bytes, or an empty one, has no repeats; all of a repeated row that is MIN
bytes or longer repeats; overlapping occurrences count; there are no ties, as
a byte is covered or not; rows of one doc_id are told apart by a 64-bit hash
of their texts; null doc_ids are kept; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t
from ._common import ship, stage, stage_counted, whole_groups

MIN = 400
GRAM = 32
#: Over 50 words in a row are a passage; its anchors are strings of so many words.
PASSAGE = 51
WORD_GRAM = 8
#: Bytes of a word's number.
WORD = 8
#: Numbers of words that a task of `_fetch` keeps.
KEEP_WORDS = 100_000
#: Windows whose distances from the anchor differ by less go on together when a hot anchor is split.
STEP = 16
HOT_BYTES = 3 << 18
BATCH_BYTES = 1 << 20
GROUP_BYTES = 8 << 20
NULL_ID = -(2**63)


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbouring values."""
    out, step = values, 1
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    if step < width:
        rest = width - step
        out = np.minimum(out[: len(out) - rest], out[rest:])
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, least: int = MIN, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The segments of many texts: document, first window, number of windows, distance of the anchor, hash of its string, hash of the segment.

    `data` is bytes, or the numbers of words; all counts are of those symbols.
    """
    none = {k: np.zeros(0, np.int64) for k in ("doc", "lo", "windows", "rel", "anchor", "seg", "left")}
    n = len(data)
    if n < least:
        return none
    prefix = t.prefix_hash(data)
    at = np.arange(n - gram + 1)
    h = t.rolling_hash(prefix, at, at + gram)
    # The least hash, and the first place of it: both follow from the window's bytes alone.
    place = least_places((h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), least - gram + 1)
    place = (place & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(offsets)
    count = np.maximum(size - least + 1, 0)
    doc = np.repeat(np.arange(len(size)), count)
    if not len(doc):
        return none
    start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offsets[:-1], count)
    place = place[start]
    new = np.ones(len(doc), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(doc)))
    lo, rel = start[first], place[first] - start[first]
    # Bytes and distance; the numbers are those of this machine, which all workers share.
    raw, unit = data.tobytes(), data.itemsize
    seg = b"".join([_hash(raw[a:b] + r.to_bytes(2, "little")) for a, b, r in zip((lo * unit).tolist(), ((lo + windows + least - 1) * unit).tolist(), rel.tolist(), strict=True)])
    begin = lo == offsets[:-1][doc[first]]
    # Only `repeat_groups`, which is over bytes, asks for what stands on the left.
    left = np.where(begin | (unit > 1), -1, data[np.maximum(lo - 1, 0)].astype(np.int64))
    return {"doc": doc[first], "lo": lo - offsets[:-1][doc[first]], "windows": windows, "rel": rel, "anchor": h[place[first]].view(np.int64), "seg": np.frombuffer(seg, np.int64), "left": left}


def _hash(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=8, key=b"weft").digest()


def word_numbers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word, and n + 1 offsets of the texts into them."""
    starts, ends, at = t.word_spans(data, offsets)
    one, which = t.span_numbers(data, starts, ends)
    raw = data.tobytes()
    keys = b"".join([_hash(raw[a:b]) for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])
    return np.frombuffer(keys, "<u8")[which], at


class _WordKeys(dict):
    """Bytes of a word's number, by the word."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= KEEP_WORDS:
            self.clear()
        self[word] = out = _hash(word)
        return out


def _slim(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("tkey"), text.alias("text"))


def segments(docs: DataFrame, least: int = MIN, unit: int = 1) -> DataFrame:
    schema = "id long, tkey long, lo int, windows int, rel int, left short, anchor long, seg long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in t.slices(batches, "text", 1 << 20):
            x = anchors(data, offsets, least) if unit == 1 else anchors(*word_numbers(data, offsets), least, min(WORD_GRAM, least))
            doc = pa.array(x["doc"])
            ints = [pa.array(x[k].astype(np.int32)) for k in ("lo", "windows", "rel")]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(doc), rows.column(1).take(doc), *ints, pa.array(x["left"].astype(np.int16)), pa.array(x["anchor"]), pa.array(x["seg"])], [c.split()[0] for c in schema.split(", ")])

    return _slim(docs).mapInArrow(run, schema)


def _packed(docs: DataFrame) -> DataFrame:
    """id, tkey and compressed text: a third of the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for rows, data, offsets in t.slices(batches, "text"):
            raw = data.tobytes()
            blobs = [pack.compress(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(blobs, pa.binary())], ["id", "tkey", "blob"])

    return _slim(docs).mapInArrow(run, "id long, tkey long, blob binary")


def repeated(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, left: np.ndarray, least: int = MIN) -> list[tuple[np.ndarray, int]]:
    """Maximal repeat groups: (places, length), of windows at `starts` in concatenated pieces; ends: the end of each symbol's piece; left: what stands before each symbol."""
    n = len(data)
    pack = 7 if data.itemsize == 1 else 1
    first = np.zeros(n, np.int64) if pack > 1 else t.distinct(data)[2]
    for k in range(pack if pack > 1 else 0):  # seven bytes at once, nothing sorts before all bytes
        inside = np.arange(n) + k < ends
        first = first * 257 + np.where(inside, data[np.minimum(np.arange(n) + k, n - 1)].astype(np.int64) + 1, 0)
    array = t.SuffixArray(first, ends, pack)
    lcp = array.lcp()
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    at = np.flatnonzero(wanted[array.order])
    if len(at) < 2:
        return []
    order = array.order[at]
    shared = np.minimum.reduceat(lcp, at[:-1] + 1)[: len(at) - 1] if len(at) > 1 else np.zeros(0, np.int64)
    # reduceat's pieces run from one wanted suffix to the next, except the last, which must end there.
    shared[-1] = lcp[at[-2] + 1 : at[-1] + 1].min()
    i, j = order[:-1].copy(), order[1:].copy()
    a, b = i + shared, j + shared
    open_ = np.ones(len(a), bool)
    for _ in range(pack - 1):  # units of seven: up to six more bytes agree
        ok = open_ & (a < ends[i]) & (b < ends[j])
        ok[ok] = data[a[ok]] == data[b[ok]]
        a += ok
        b += ok
        open_ = ok
    shared = np.concatenate([[0], a - i])
    left = left[order]
    deep = shared >= least
    # Runs of neighbours that share enough; the tree above `least` lies within them.
    head = np.flatnonzero(~deep & np.append(deep[1:], False))
    out = []
    if not len(head):
        return out
    stop = np.flatnonzero(deep & ~np.append(deep[1:], False)) + 1
    differ = np.zeros(len(order), bool)
    differ[1:] = left[1:] != left[:-1]
    total = np.concatenate([[0], np.cumsum(differ)])
    for x, y in zip(head.tolist(), stop.tolist(), strict=True):
        if total[y] - total[x + 1] == 0:
            continue  # all have the same byte on their left, and so has every interval within
        own = shared[x:y].copy()
        own[0] = 0
        for u, v, length in t.interval_tree(own, left[x:y], least):
            out.append((order[x + u : x + v + 1], int(length)))
    return out


_PIECES = "anchor long, seg long, rel int, left int, body binary"


def _bodies(anchor, seg, rel, left, bodies: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(seg, pa.int64()), pa.array(rel, pa.int32()), pa.array(left, pa.int32()), pa.array(bodies, pa.binary())], [c.split()[0] for c in _PIECES.split(", ")])


def _fetch(wanted: DataFrame, docs: DataFrame, unit: int = 1) -> DataFrame:
    """The bytes, or the words' numbers, of one occurrence of each segment in `wanted` (anchor, seg, rel, left, lo, size, id, tkey)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_, keys = zstandard.ZstdDecompressor(), _WordKeys()
        for b in batches:
            t.release()
            segs = b.column(1)
            flat = segs.flatten()
            cols = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(6)]
            ends = np.cumsum(segs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)).tolist()
            lo, size = cols[4].tolist(), cols[5].tolist()
            bodies, held, begin, k = [], 0, 0, 0
            for i, end in enumerate(ends):
                text = open_.decompress(b.column(0)[i].as_py())
                text = text if unit == 1 else text.split()  # of bytes: at space and the controls 9 to 13
                while k < end:
                    body = text[lo[k] : lo[k] + size[k]]
                    bodies.append(body if unit == 1 else b"".join([keys[w] for w in body]))
                    held += size[k] * unit
                    k += 1
                    if held > 2 << 20:
                        yield _bodies(*[c[begin:k] for c in cols[:4]], bodies)
                        bodies, held, begin = [], 0, k
            yield _bodies(*[c[begin:k] for c in cols[:4]], bodies)

    per_doc = wanted.groupBy("id", "tkey").agg(F.collect_list(F.struct("anchor", "seg", "rel", F.col("left").cast("int").alias("left"), "lo", "size")).alias("segs"))
    return per_doc.join(_packed(docs), ["id", "tkey"]).select("blob", "segs").mapInArrow(run, _PIECES)


def _windows(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, place and hash of every window of pieces."""
    count = np.maximum(np.diff(offsets) - least + 1, 0)
    seg = np.repeat(np.arange(len(count)), count)
    start = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offsets[:-1], count)
    return seg, start, t.rolling_hash(t.prefix_hash(data), start, start + least)


def _groups_of(whole: pa.Table, least: int, real_left: bool = False, unit: int = 1) -> tuple[np.ndarray, np.ndarray, list]:
    """(rows of distinct segments, their offsets, groups over their concatenated symbols).

    real_left: what stands before a segment counts. Otherwise its first window
    always starts a group, whose bytes the segment before doesn't cover.
    """
    key, seg = whole.column(0).to_numpy(), whole.column(1).to_numpy()
    first = np.ones(len(key), bool)  # a repeated row brings its segments again
    first[1:] = (key[1:] != key[:-1]) | (seg[1:] != seg[:-1])
    rows = np.flatnonzero(first)
    data, offsets = t.buffers(whole.column(4).take(pa.array(rows)))
    if unit > 1:
        data, offsets = np.frombuffer(data.tobytes(), "<u8"), offsets // unit
    owner, start, digest = _windows(data, offsets, least)
    # Windows whose digest comes once can't repeat: only the bytes of the others are sorted.
    by = np.argsort(digest)
    same = digest[by][1:] == digest[by][:-1]
    twice = np.zeros(len(digest), bool)
    twice[by[1:][same]] = True
    twice[by[:-1][same]] = True
    keep = np.flatnonzero(twice)
    if not len(keep):
        return rows, offsets, []
    needed = t.covered(start[keep], np.full(len(keep), least), len(data))
    back = np.flatnonzero(needed)
    place = np.cumsum(needed) - 1
    piece = np.repeat(np.arange(len(rows)), np.diff(offsets))[back]
    cut = np.ones(len(back), bool)
    cut[1:] = (np.diff(back) > 1) | (piece[1:] != piece[:-1])
    begin = np.flatnonzero(cut)
    ends = np.repeat(np.append(begin[1:], len(back)), np.diff(np.append(begin, len(back))))
    left = np.zeros(len(data), np.int64)
    left[1:] = data[:-1] if unit == 1 else data[:-1] >> np.uint64(1)  # below 0 are the segments' own
    head = offsets[:-1][np.diff(offsets) > 0]
    own = -1 - np.arange(len(offsets) - 1, dtype=np.int64)
    if real_left:
        before = whole.column(3).to_numpy()[rows].astype(np.int64)
        own = np.where(before >= 0, before, own)
    left[head] = own[np.diff(offsets) > 0]
    found = repeated(data[back], ends, place[start[keep]], left[back], least)
    return rows, offsets, [(back[at], length) for at, length in found]


_MARKS = "anchor long, seg long, spans array<struct<start:int,end:int>>"


def _by_anchor(pieces: DataFrame):
    return pieces.select("anchor", "seg", "rel", "left", "body").repartition("anchor").sortWithinPartitions("anchor", "seg")


def _mark(pieces: DataFrame, least: int, unit: int = 1) -> DataFrame:
    """Of each segment, the spans that its maximal repeats cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, 1, 1 << 30, BATCH_BYTES):
            t.release()
            rows, offsets, groups = _groups_of(whole, least, unit=unit)
            if not groups:
                continue
            places = np.concatenate([at for at, _ in groups])
            lengths = np.concatenate([np.full(len(at), length) for at, length in groups])
            mask = t.covered(places, lengths, int(offsets[-1]))
            own = np.repeat(np.arange(len(rows)), np.diff(offsets))
            head = np.flatnonzero(mask & ~(np.append(False, mask[:-1]) & np.append(False, own[1:] == own[:-1])))
            tail = np.flatnonzero(mask & ~(np.append(mask[1:], False) & np.append(own[1:] == own[:-1], False)))
            owner = own[head]
            spans = pa.StructArray.from_arrays([pa.array((head - offsets[owner]).astype(np.int32)), pa.array((tail + 1 - offsets[owner]).astype(np.int32))], names=["start", "end"])
            hit = np.unique(owner)
            bounds = np.append(np.searchsorted(owner, hit), len(owner)).astype(np.int32)
            at = pa.array(rows[hit])
            cols = [whole.column(k).take(at).combine_chunks() for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(bounds), spans)], ["anchor", "seg", "spans"])

    return _by_anchor(pieces).mapInArrow(run, _MARKS)


def _steps(pieces: DataFrame, least: int, step: int, unit: int = 1) -> DataFrame:
    """Segments of the segments: windows whose distances from the anchor fall into one step.

    The anchor of a run is the hash of the old one, of the step, and of the
    bytes that all windows of the step have in common.
    """
    names = [c.split()[0] for c in _RUNS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int16(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]
            for anchor, seg, rel, left, body in zip(*[c.to_pylist() for c in b.columns], strict=True):
                last, at = len(body) // unit - least, 0
                while at <= last:
                    kind = (rel - at) // step
                    start = rel - kind * step  # of the window nearest to the anchor
                    end = min(last, start)
                    core = body[start * unit : (start - step + 1 + least) * unit]
                    mark = _hash(anchor.to_bytes(8, "little", signed=True) + kind.to_bytes(2, "little") + core)
                    own = _hash((rel - at).to_bytes(2, "little") + body[at * unit : (end + least) * unit])
                    values = (anchor, seg, at, end - at + 1, rel - at, left if at == 0 or unit > 1 else body[at - 1], int.from_bytes(mark, "little", signed=True), int.from_bytes(own, "little", signed=True))
                    for column, x in zip(out, values, strict=True):
                        column.append(x)
                    at = end + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    return pieces.select("anchor", "seg", "rel", "left", "body").mapInArrow(run, _RUNS)


#: Runs of windows of an owner: a text (id, tkey), or a segment of a hot anchor (anchor, seg).
_RUNS = "o1 long, o2 long, lo int, windows int, rel int, left short, anchor long, seg long"


def _tables(found: DataFrame, least: int, unit: int = 1) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Staged: all runs of anchors that occur twice; their different segments; the hot anchors, and how many those are."""
    count = found.groupBy("anchor").agg(F.count("*").alias("c"), F.min("seg").alias("a"), F.max("seg").alias("b")).where("c > 1")
    shared = stage(found.join(count.select("anchor", (F.col("a") == F.col("b")).alias("alike")), "anchor"), "repeat-shared")
    differ = shared.where("not alike").withColumn("x", F.struct("o1", "o2", "lo", "windows", "rel"))
    # What stands left of a segment: a byte, or -1 where that differs or nothing does.
    entries = differ.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min("x").alias("x"), F.min("left").alias("l0"), F.max("left").alias("l1"))
    entries = entries.select("anchor", "seg", "n", "x.*", (F.col("x.windows") + (least - 1)).alias("size"), F.when(F.col("l0") == F.col("l1"), F.col("l0")).otherwise(-1).cast("int").alias("left"))
    entries = stage(entries, "repeat-entries")
    hot, n_hot = stage_counted(entries.groupBy("anchor").agg(F.sum("size").alias("s")).where(F.col("s") * unit > HOT_BYTES).select("anchor"), "repeat-hot")
    return shared, entries, hot, n_hot


def _within(pieces: DataFrame, unit: int = 1):
    """A way to get the bytes of runs of staged pieces."""

    def fetch(wanted: DataFrame) -> DataFrame:
        whole = pieces.select(F.col("anchor").alias("o1"), F.col("seg").alias("o2"), "body")
        return wanted.join(whole, ["o1", "o2"]).select("anchor", "seg", "rel", "left", F.substring("body", F.col("lo") * unit + 1, F.col("size") * unit).alias("body"))

    return fetch


def _repeating(found: DataFrame, fetch, least: int, step: int = STEP, unit: int = 1) -> DataFrame:
    """(o1, o2, start, end): what repeats of the owners of the runs `found`."""
    shared, entries, hot, n_hot = _tables(found, least, unit)
    if n_hot:
        pieces = stage(fetch(entries), "repeat-pieces")
        marks = _mark(pieces.join(hot, "anchor", "left_anti"), least, unit)
        pieces = stage(pieces.join(hot, "anchor"), "repeat-hot-pieces")
        inner = _repeating(stage(_steps(pieces, least, step, unit), "repeat-runs"), _within(pieces, unit), least, 1, unit)
        marks = marks.unionByName(inner.groupBy(F.col("o1").alias("anchor"), F.col("o2").alias("seg")).agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    else:
        marks = _mark(fetch(entries), least, unit)
    # All of a segment that occurs twice repeats.
    full = F.array(F.struct(F.lit(0).alias("start"), (F.col("windows") + (least - 1)).alias("end")))
    counted = shared.where("not alike").join(entries.select("anchor", "seg", "n"), ["anchor", "seg"]).join(stage(marks, "repeat-marks"), ["anchor", "seg"], "left")
    counted = counted.select("o1", "o2", "lo", F.when(F.col("n") > 1, full).otherwise(F.col("spans")).alias("spans")).where("spans is not null")
    alike = shared.where("alike").select("o1", "o2", "lo", full.alias("spans"))
    each = alike.unionByName(counted).select("o1", "o2", "lo", F.explode("spans").alias("s"))
    return each.select("o1", "o2", (F.col("lo") + F.col("s.start")).alias("start"), (F.col("lo") + F.col("s.end")).alias("end"))


def _found(docs: DataFrame, least: int, unit: int = 1) -> DataFrame:
    return stage(segments(docs, least, unit).withColumnsRenamed({"id": "o1", "tkey": "o2"}), "repeat-segments")


def _from_docs(docs: DataFrame, unit: int = 1):
    return lambda wanted: _fetch(wanted.withColumnsRenamed({"o1": "id", "o2": "tkey"}), docs, unit)


def spans(docs: DataFrame, least: int = MIN) -> DataFrame:
    """id, tkey and the spans (bytes, from start to end) that repeat, per text that has any; spans may overlap."""
    ship(docs.sparkSession)
    return _per_text(_repeating(_found(docs, least), _from_docs(docs), least))


def passages(docs: DataFrame, least: int = PASSAGE) -> DataFrame:
    """id, tkey and the spans (words, from start to end) that repeat anywhere, the same text included; spans may overlap."""
    ship(docs.sparkSession)
    step = max(1, min(STEP, least // 8))  # the windows of a step have most of their words in common
    return _per_text(_repeating(_found(docs, least, WORD), _from_docs(docs, WORD), least, step, WORD))


def _per_text(each: DataFrame) -> DataFrame:
    return each.groupBy(F.col("o1").alias("id"), F.col("o2").alias("tkey")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _merged(spans_: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans_):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,end:int>>, kept binary, n_passage_words long"


def remove(docs: DataFrame, least: int = MIN, digest: bool = False, words: int | None = None) -> DataFrame:
    """Every document's repeated spans, merged, and the bytes that are left (or their SHA-256).

    n_passage_words: words in strings of `words` words that start anywhere else
    too (null without `words`); they are counted only, not removed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            n_bytes, n_removed, merged, kept = [], [], [], []
            n_words = [None if x is None else sum(v - u for u, v in _merged([(y["start"], y["end"]) for y in x])) for x in b.column(3).to_pylist()]
            for blob, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text = open_.decompress(blob)
                parts, done = [], 0
                out = _merged([(x["start"], x["end"]) for x in own or ()])
                for x, y in out:
                    parts.append(text[done:x])
                    done = y
                parts.append(text[done:])
                n_bytes.append(len(text))
                n_removed.append(sum(y - x for x, y in out))
                merged.append([{"start": x, "end": y} for x, y in out])
                rest = b"".join(parts)
                kept.append(hashlib.sha256(rest).digest() if digest else rest)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([len(x) for x in merged], pa.int64()), pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary()), pa.array(n_words, pa.int64())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "n_passage_words"],
            )

    both = _packed(docs).join(stage(spans(docs, least), "repeat-spans"), ["id", "tkey"], "left")
    in_words = F.lit(None).cast("array<struct<start:int,end:int>>")
    if words:
        both = both.join(stage(passages(docs, words).withColumnRenamed("spans", "in_words"), "repeat-passages"), ["id", "tkey"], "left")
        in_words = F.coalesce("in_words", F.array().cast("array<struct<start:int,end:int>>"))
    plain = F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id")
    return both.select(plain, "blob", "spans", in_words.alias("in_words")).mapInArrow(run, _REMOVED)


def _starts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Places (o1, o2, start) where a maximal repeat may start, and what repeats (o1, o2, start, end)."""
    found, fetch = _found(docs, least), _from_docs(docs)
    shared, entries, hot, n_hot = _tables(found, least)
    differs = F.col("l0").isNull() | (F.col("l0") != F.col("l1")) | (F.col("l0") < 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, 1, 1 << 30, BATCH_BYTES):
            rows, offsets, groups = _groups_of(whole, least, True)
            at = np.unique(np.concatenate([np.zeros(0, np.int64), *[x for x, _ in groups]]))
            owner = np.searchsorted(offsets, at, "right") - 1
            take = pa.array(rows[owner])
            yield pa.RecordBatch.from_arrays([*[whole.column(k).take(take).combine_chunks() for k in (0, 1)], pa.array((at - offsets[owner]).astype(np.int32))], ["anchor", "seg", "at"])

    pieces = stage(fetch(entries), "repeat-pieces")
    inside = _by_anchor(pieces.join(hot, "anchor", "left_anti")).mapInArrow(run, "anchor long, seg long, at int")
    if n_hot:  # of hot anchors, every window that repeats
        large = stage(pieces.join(hot, "anchor"), "repeat-hot-pieces")
        inner = _repeating(stage(_steps(large, least, STEP), "repeat-runs"), _within(large), least, 1)
        inside = inside.unionByName(inner.select(F.col("o1").alias("anchor"), F.col("o2").alias("seg"), F.explode(F.sequence(F.col("start"), F.col("end") - least)).alias("at")))
    segs = shared.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min("left").alias("l0"), F.max("left").alias("l1"))
    # The first window of a segment that occurs twice; its other windows have one byte on their left.
    first = segs.where((F.col("n") > 1) & differs).select("anchor", "seg", F.lit(0).alias("at"))
    at = inside.unionByName(first).distinct()
    starts = shared.join(at, ["anchor", "seg"]).select("o1", "o2", (F.col("lo") + F.col("at")).alias("start")).distinct()
    return starts, _repeating(found, fetch, least)


_MEMBERS = "key long, bkey long, id long, tkey long, start int, left int, body binary"


def _continuations(docs: DataFrame, least: int) -> DataFrame:
    """Of each such place: hashes of its first window and of all up to the end of its span, the byte before, and those bytes."""
    starts, repeats_ = _starts(docs, least)
    starts = starts.groupBy("o1", "o2").agg(F.collect_set("start").alias("starts"))
    own = repeats_.groupBy("o1", "o2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    both = _packed(docs).withColumnsRenamed({"id": "o1", "tkey": "o2"}).join(stage(starts.join(own, ["o1", "o2"]), "repeat-starts"), ["o1", "o2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        kinds = [pa.int64()] * 4 + [pa.int32(), pa.int32(), pa.binary()]
        names = [c.split()[0] for c in _MEMBERS.split(", ")]
        for b in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            for id_, tkey, blob, at, own in zip(*[c.to_pylist() for c in b.columns], strict=True):
                text = open_.decompress(blob)
                merged = _merged([(x["start"], x["end"]) for x in own])
                ends = [x[0] for x in merged]
                for k in sorted(at):
                    body = text[k : merged[bisect.bisect_right(ends, k) - 1][1]]
                    key, bkey = (int.from_bytes(_hash(x), "little", signed=True) for x in (body[:least], body))
                    for column, x in zip(out, (key, bkey, id_, tkey, k, text[k - 1] if k else -1, body), strict=True):
                        column.append(x)
                    held += len(body)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names)
                        out, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names)

    return both.select("o1", "o2", "blob", "starts", "spans").mapInArrow(run, _MEMBERS)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) if len(differ) else n


def _trees(bodies: DataFrame, least: int) -> DataFrame:
    """(group, length, key, bkey) of the maximal repeats of each key's different bodies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, 1, 1 << 30, BATCH_BYTES):
            cur, key, bkey, n, l0, l1 = (whole.column(k).to_numpy() for k in range(6))
            body = whole.column(6).to_pylist()
            begin = np.append(np.flatnonzero(np.concatenate([[True], cur[1:] != cur[:-1]])), len(cur))
            out: list[list] = [[], [], [], []]
            for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                # A body that occurs more than once stands twice, with two of its left neighbours.
                which = np.repeat(np.arange(a, b), np.minimum(n[a:b], 2))
                again = np.append(False, which[1:] == which[:-1])
                lcp = [0] + [len(body[y]) if x == y else _common(body[x], body[y]) for x, y in zip(which[:-1].tolist(), which[1:].tolist(), strict=True)]
                left = np.where(again, l1[which], l0[which]).astype(np.int64)
                left = np.where(left < 0, -1 - np.arange(len(left)), left)
                for first, last, length in t.interval_tree(np.array(lcp), left, least):
                    rows = np.unique(which[first : last + 1])
                    name = int.from_bytes(_hash(body[rows[0]][:length]), "little", signed=True)
                    out[0] += [name] * len(rows)
                    out[1] += [length] * len(rows)
                    out[2] += key[rows].tolist()
                    out[3] += bkey[rows].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["group", "length", "key", "bkey"])

    rows = bodies.select("cur", "key", "bkey", "n", "l0", "l1", "body")
    return rows.repartition("cur").sortWithinPartitions("cur", "body").mapInArrow(run, "group long, length int, key long, bkey long")


def repeat_groups(docs: DataFrame, least: int = MIN) -> DataFrame:
    """All maximal repeats of at least `least` bytes: (group, length, doc_id, start) of every occurrence.

    A repeat is maximal if its occurrences differ in the byte before and in the
    byte after; the union of the occurrences is what `remove` takes out.
    """
    ship(docs.sparkSession)
    members = stage(_continuations(docs, least), "repeat-members")
    bodies = members.groupBy("key", "bkey").agg(F.count("*").alias("n"), F.min("left").alias("l0"), F.max("left").alias("l1"), F.first("body").alias("body"))
    bodies = stage(bodies.withColumn("cur", F.col("key")), "repeat-bodies")
    cut = F.udf(_common, "int")  # on one row per large group
    found = None
    while True:
        large = bodies.groupBy("cur").agg(F.count("*").alias("c"), F.sum(F.length("body")).alias("s"), F.min("body").alias("a"), F.max("body").alias("b"), F.min("l0").alias("m0"), F.max("l1").alias("m1"))
        large, n_large = stage_counted(large.where((F.col("s") > GROUP_BYTES) & (F.col("c") > 1)).select("cur", cut("a", "b").alias("depth"), F.sha2("a", 256).alias("sha"), ((F.col("m0") != F.col("m1")) | (F.col("m0") < 0)).alias("differ")), "repeat-large")
        if not n_large:
            break
        of = bodies.join(large, "cur")
        own = of.where("differ").select(F.xxhash64(F.substring("body", F.lit(1), F.col("depth"))).alias("group"), F.col("depth").alias("length"), "key", "bkey")
        own = stage(own, "repeat-top")
        found = own if found is None else found.unionByName(own)
        # A body that ends there is whole in the group above.
        split = of.where(F.length("body") > F.col("depth")).withColumn("cur", F.xxhash64("cur", F.substring("body", F.col("depth") + 1, F.lit(1)))).select(*bodies.columns)
        bodies = stage(bodies.join(large, "cur", "left_anti").select(*split.columns).unionByName(split), "repeat-bodies")
    trees = _trees(bodies, least)
    found = trees if found is None else found.unionByName(trees)
    out = found.join(members.select("key", "bkey", "id", "start"), ["key", "bkey"])
    return out.select("group", "length", F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "start")
