"""Token-ID output: a content-addressed store of chunks of id streams.

Each document's ids are cut where a rolling hash over the last `WINDOW` ids
says so, which makes equal passages give equal chunks wherever they start.
The store is three Parquet tables below one path:

* ``chunks``: digest (BLAKE2b, 16 bytes, of the payload), n, payload (ids in
  little-endian 16 or 32 bits, as the vocabulary needs); each digest once;
* ``recipes``: in ascending order of doc_id, doc_id, start (ids of all
  documents before), n_tokens, chunks (digests in order), sizes, root (the
  Merkle root of the digests), part;
* ``manifest``: per part of the recipes, the number of documents and ids,
  the Merkle root of the documents' roots, and the width of an id.

`verify` reads all three back: payloads against digests, digests against
roots, roots against the manifest, and gives every document's CRC-32 from the
checksums of the stored chunks (the CRC of a concatenation is the XOR of the
parts' CRCs, each shifted by the bytes after it), so no payload is shuffled to
check a document. `read_ids` puts the documents together again.

A very long text is encoded whole, by itself, in about 60 times its size of
memory; a chunk never has more than LONGEST ids.

Defined results: a null text is as an empty one, an end id alone; several rows
of one doc_id are stored in the order of their digests; a null doc_id comes
first; equal rows are stored once as chunks and each get a recipe; an empty
table gives three empty tables; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as t
from ._common import drop_path, prefix_sums, stage, workspace

END_ID = 1
#: Rolling window, mean chunk (a power of two) and longest chunk, in ids.
WINDOW, MEAN, LONGEST = 16, 512, 4096
_ROLL = 0x9E3779B97F4A7C15
#: So many pieces of late are kept, and as many before; one piece of text adds its own.
CACHE_PIECES = 200_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 1: ASCII letters; 2: ASCII marks that neither compose with what follows nor belong to a special token.
_CLASS = np.zeros(256, np.int8)
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[list(b".,!?;:*#$%&()")] = 2
#: Second bytes, after 0xC3, of the letters from U+00C0 to U+00FF (all but the two signs).
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the others count from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()
#: The bytes of "ß" to "ÿ" that such vocabularies write with another letter than their own.
_HIDDEN = [b for b in range(0x9F, 0xC0) if _LETTERS[b] != b]


def _plain(low: np.ndarray) -> np.ndarray:
    """Of lower-cased words, a line each, whether they have only letters from "a" to "z" and from "ß" to "ÿ"."""
    after = np.append(low[1:], 0)
    lead = (low == 0xC3) & (after >= 0x9F) & (after <= 0xBF) & (after != 0xB7)
    good = ((low >= 97) & (low <= 122)) | (low == 10) | lead
    good[1:] |= lead[:-1]
    line = np.append(0, np.flatnonzero(low == 10) + 1)
    return np.logical_and.reduceat(good, line)


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces that are encoded apart, and n + 1 offsets of the documents into them."""
    starts, ends, _ = t.word_spans(data, offsets)
    kind = _CLASS[data]
    lead = np.flatnonzero((data[:-1] == 0xC3) & _LATIN[data[1:]])
    kind[lead] = kind[lead + 1] = 1
    turn = np.flatnonzero(kind[1:] + kind[:-1] == 3) + 1 if len(data) else np.zeros(0, np.int64)
    turn = turn[(kind[turn] > 0) & (kind[turn - 1] > 0)]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    turn = turn[~edge[turn]]
    starts, ends = np.concatenate([starts, turn]), np.concatenate([ends, turn])
    starts.sort()
    ends.sort()
    return starts, ends, np.searchsorted(starts, offsets)


def distinct_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The different spans, and of each span its number among them; told apart by their bytes."""
    n = len(starts)
    if not n:
        return [], np.zeros(0, np.int64)
    edges = np.empty(2 * n, np.int32)  # of the spans and of what lies between them
    edges[0::2], edges[1::2] = starts, ends
    both = pa.Array.from_buffers(pa.binary(), 2 * n - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    coded = both.take(pa.array(np.arange(0, 2 * n - 1, 2, dtype=np.int32))).dictionary_encode()
    _, at, held = coded.dictionary.buffers()
    at, raw = np.frombuffer(at, np.int32)[: len(coded.dictionary) + 1].tolist(), held.to_pybytes()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], coded.indices.to_numpy()


#: What a tokenizer must do with a text before its model sees it, for pieces of the text to be encoded apart.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _spelt(spec: dict) -> bool:
    """Whether a tokenizer composes, lower-cases, drops white space, splits letters from digits and marks, and then only spells bytes."""
    before = spec.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers") or []
    split, bytes_ = (steps + [{}, {}])[:2]
    return (
        (spec.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
        and len(steps) == 2
        and (split.get("type"), split.get("pattern"), split.get("invert")) == ("Split", {"Regex": _WORDS}, True)
        and split.get("behavior") == "Removed"
        and (bytes_.get("type"), bytes_.get("add_prefix_space"), bytes_.get("use_regex")) == ("ByteLevel", False, False)
        and all(x["content"].startswith("<|") and not x["normalized"] for x in spec.get("added_tokens") or ())
    )


class Encoder:
    """Ids of texts by a `tokenizers` file, as if each whole text were encoded.

    Where the file says that texts are composed, lower-cased, and split into
    letters, digits and marks (`_spelt`), no id depends on what lies beyond
    white space or between an ASCII letter and a mark: texts are cut there and
    each distinct piece is encoded once, kept by its bytes. The tests compare
    it with whole texts. With any other file, whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.by_pieces = _spelt(json.loads(self.tokenizer.to_str()))
        self.reset()

    def reset(self) -> None:
        # Ids of pieces, by their bytes: those of late, and those before, of which what is met again is kept.
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def known(self, keys: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces."""
        if len(self.young) > CACHE_PIECES:
            self.old, self.young = self.young, {}
        young, before = self.young, self.old.get
        got = list(map(young.get, keys))
        left = [i for i, x in enumerate(got) if x is None]
        new = []
        for i in left:
            x = got[i] = before(keys[i])
            if x is None:
                new.append(i)
            else:
                young[keys[i]] = x
        if new:
            flat, size = self.words([keys[i] for i in new])
            raw, ends = flat.tobytes(), np.cumsum(size * 4).tolist()
            for i, a, b in zip(new, [0, *ends[:-1]], ends, strict=True):
                got[i] = young[keys[i]] = raw[a:b]
        return got

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, flat, and how many each has; words of Latin letters need only be spelt as bytes for the model."""
        whole = b"\n".join(words).decode()  # no piece has white space
        low = whole.lower().encode()
        spelt = low.decode("latin-1")
        for byte in _HIDDEN:
            spelt = spelt.replace(chr(byte), chr(_LETTERS[byte]))
        plain = _plain(np.frombuffer(low, np.uint8)).tolist()
        rest = [w for w, p in zip(whole.split("\n"), plain, strict=True) if not p]
        others = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))
        model = self.tokenizer.model.tokenize
        got = [[x.id for x in model(w)] if p else next(others).ids for w, p in zip(spelt.split("\n"), plain, strict=True)]
        return np.fromiter(chain.from_iterable(got), np.int32), np.fromiter(map(len, got), np.int64, len(got))

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        got = self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], add_special_tokens=False)
        ids = [np.array([*x.ids, END_ID], np.int32) for x in got]
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.cumsum([0, *map(len, ids)])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts with the end id after each, and the n + 1 offsets of the documents."""
        if not self.by_pieces:
            return self._whole(data, offsets)
        if b"<|" not in data.tobytes():  # a special token has its own case
            data = _LOWER[data]
        starts, ends, at = pieces(data, offsets)
        keys, which = distinct_pieces(data, starts, ends)
        got = self.known(keys)
        flat = np.frombuffer(b"".join(got), np.int32)
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        n = len(offsets) - 1
        per_word = size[which] if len(which) else np.zeros(0, np.int64)
        total = np.zeros(len(per_word) + 1, np.int64)
        np.cumsum(per_word, out=total[1:])
        bounds = total[at] + np.arange(n + 1)  # an end id for each document before
        out = np.empty(int(bounds[-1]), np.int32)
        is_end = np.zeros(len(out), bool)
        is_end[bounds[1:] - 1] = True
        out[is_end] = END_ID
        if len(per_word):
            begin = (np.cumsum(size) - size)[which]
            out[~is_end] = flat[np.repeat(begin - total[:-1], per_word) + np.arange(total[-1])]
        return out, bounds


def cut(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a flat id stream; every document end is one."""
    n = len(ids)
    top = int(ids.max()) + 1 if n else 0
    value = t.mix(np.arange(1, top + 1, dtype=np.uint64))[ids]  # one number per id of the vocabulary
    rolled = np.zeros(n + 1, np.uint64)
    np.cumsum(value * t.powers(_ROLL, n), out=rolled[1:])
    is_end = np.zeros(n + 1, bool)
    is_end[bounds[1:]] = True
    if n >= WINDOW:
        i = np.arange(WINDOW, n + 1)
        inverse = t.powers(pow(_ROLL, -1, 2**64), n)
        h = (rolled[WINDOW:] - rolled[:-WINDOW]) * inverse[: n + 1 - WINDOW] * np.uint64(_ROLL)
        hit = i[(h >> np.uint64(64 - MEAN.bit_length() + 1)) == 0]
        doc_start = bounds[np.searchsorted(bounds, hit - 1, "right") - 1]
        is_end[hit[hit - WINDOW >= doc_start]] = True
    ends = np.flatnonzero(is_end)
    ends = ends[ends > 0]
    size = np.diff(np.concatenate([[0], ends]))
    extra = (size - 1) // LONGEST  # a chunk that is too long is cut at multiples
    if extra.any():
        first = np.repeat(ends - size, extra + 1)
        step = np.arange(len(first)) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1) + 1
        ends = np.minimum(first + step * LONGEST, np.repeat(ends, extra + 1))
    return ends


def merkle(digests: list[bytes]) -> bytes:
    """Root of a binary tree of digests; an odd one at the end goes up as it is."""
    level = digests or [b""]
    while len(level) > 1:
        pairs = [hashlib.blake2b(b"\x01" + level[i] + level[i + 1], digest_size=16).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) - len(level) % 2 :]
    return level[0]


def _digest(payload) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


#: Per worker process: a tokenizer leaves some of its memory behind when it goes, so that one is kept, with its pieces.
_KEPT: dict[bytes, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of a tokenizer file, made once in a process as long as the file has the same bytes."""
    with open(path, "rb") as f:
        key = hashlib.blake2b(f.read()).digest()
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Encoder(path)
    return _KEPT[key]


_ENCODED = "doc_id long, n_tokens long, chunks array<binary>, sizes array<int>, root binary, new_digests array<binary>, new_payloads array<binary>"


def encode_batches(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    """What `encode` gives, of one task's batches (doc_id, text)."""
    encoder = encoder_of(tokenizer)
    kind = np.dtype(f"<u{encoder.width}")
    given: set[bytes] = set()
    for rows, data, offsets in t.slices(batches, "text", 1 << 20):
        ids, bounds = encoder(data, offsets)
        ends = cut(ids, bounds)
        raw = ids.astype(kind).tobytes()
        last = np.searchsorted(ends, bounds[1:], "right")
        spots = np.concatenate([[0], ends]) * kind.itemsize
        view, places = memoryview(raw), spots.tolist()
        digests = [_digest(view[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)]
        fresh = np.zeros(len(digests), bool)
        for k, x in enumerate(digests):
            if x not in given:
                if len(given) > 50_000:  # then some are given again; the store keeps one
                    given.clear()
                given.add(x)
                fresh[k] = True
        at = pa.array(np.concatenate([[0], last]).astype(np.int32))
        new = np.flatnonzero(fresh)
        new_at = pa.array(np.searchsorted(new, np.concatenate([[0], last])).astype(np.int32))
        # Not an array of memoryviews: Arrow never lets go of what they show.
        payloads = pa.Array.from_buffers(pa.large_binary(), len(digests), [None, pa.py_buffer(spots.astype(np.int64)), pa.py_buffer(raw)])
        flat = pa.array(digests, pa.binary())
        cuts = np.concatenate([[0], last]).tolist()
        yield pa.RecordBatch.from_arrays(
            [
                rows.column(0),
                pa.array(np.diff(bounds)),
                pa.ListArray.from_arrays(at, flat),
                pa.ListArray.from_arrays(at, pa.array((np.diff(spots) // kind.itemsize).astype(np.int32))),
                pa.array([merkle(digests[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                pa.ListArray.from_arrays(new_at, flat.take(pa.array(new))),
                pa.ListArray.from_arrays(new_at, payloads.take(pa.array(new)).cast(pa.binary())),
            ],
            [x.split()[0] for x in _ENCODED.split(", ")],
        )


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """A row per document: its chunks' digests and sizes, and the payloads that this task has not given before."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(lambda batches: encode_batches(batches, tokenizer), _ENCODED)


def token_width(tokenizer: str) -> int:
    """Bytes that an id of a tokenizer takes."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4


def stored_width(spark: SparkSession, path: str) -> int:
    """Bytes that an id of a store takes, by its manifest."""
    row = spark.read.parquet(f"{path}/manifest").select("width").first()
    return row[0] if row else 2


def write_store(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write the three tables below `path`."""
    spark = docs.sparkSession
    once = workspace(spark, "encoded")
    encode(docs, tokenizer).write.option("compression", "zstd").parquet(once)
    encoded = spark.read.parquet(once)
    pieces = encoded.where(F.size("new_digests") > 0).select(F.explode(F.arrays_zip("new_digests", "new_payloads")).alias("x")).select(F.col("x.new_digests").alias("digest"), F.col("x.new_payloads").alias("payload"))

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes] = set()  # what one shuffle partition holds
        for b in batches:
            keep = []
            for x in b.column(0).to_pylist():
                keep.append(x not in given)
                given.add(x)
            yield b.filter(pa.array(keep, pa.bool_()))

    # A digest comes at most once from each task that encoded, so no key is hot here.
    pieces.repartition("digest").mapInArrow(unique, "digest binary, payload binary").write.option("compression", "zstd").parquet(f"{path}/chunks")

    slim = stage(encoded.select("doc_id", "n_tokens", "chunks", "sizes", "root"), "recipes", "zstd")
    placed = prefix_sums(slim, ["doc_id", "root"], "n_tokens", "start")
    placed = placed.withColumnRenamed("weft_bucket", "part")
    # Parts are ranges of doc_id, so the files are in its order, whatever their number.
    placed.repartitionByRange("part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "start").select("doc_id", "start", "n_tokens", "chunks", "sizes", "root", "part").write.option("compression", "zstd").parquet(f"{path}/recipes")
    drop_path(spark, once)
    recipes = spark.read.parquet(f"{path}/recipes")
    width = token_width(tokenizer)
    _roots(recipes).withColumn("width", F.lit(width)).write.option("compression", "zstd").parquet(f"{path}/manifest")


def _roots(recipes: DataFrame) -> DataFrame:
    """The manifest: a row per part (of a bounded number of documents)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start", kind="stable")
        pdf = pdf.sort_values(["start", "n_tokens"], kind="stable")
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "n_docs": [len(pdf)], "n_tokens": [int(pdf["n_tokens"].sum())], "root": [merkle([bytes(x) for x in pdf["root"]])]})

    return recipes.select("part", "start", "n_tokens", "root").groupBy("part").applyInPandas(run, "part int, n_docs long, n_tokens long, root binary")


# CRC-32 over GF(2): shifting a checksum by zero bytes is a linear map.
def _shift_tables() -> list[np.ndarray]:
    """For each power of two of bytes, four tables of 256: the map of each byte of a checksum."""
    poly = 0xEDB88320
    one = np.zeros(32, np.uint64)  # the map of one zero bit, by columns
    one[0] = poly
    one[1:] = [1 << k for k in range(31)]

    def apply(m, v):
        out = np.zeros_like(v)
        for k in range(32):
            out ^= np.where((v >> np.uint64(k)) & np.uint64(1), m[k], np.uint64(0))
        return out

    m = one
    for _ in range(3):
        m = apply(m, m)
    tables = []
    for _ in range(40):
        byte = np.arange(256, dtype=np.uint64)
        tables.append(np.stack([apply(m, byte << np.uint64(8 * k)) for k in range(4)]))
        m = apply(m, m)
    return tables


_SHIFTS: list[np.ndarray] = []


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What checksums contribute when so many bytes follow."""
    if not _SHIFTS:
        _SHIFTS.extend(_shift_tables())
    crc, left, k = crc.astype(np.uint64), n_bytes.astype(np.int64), 0
    while (left >> k).any():
        at = np.flatnonzero((left >> k) & 1)
        c = crc[at]
        table = _SHIFTS[k]
        crc[at] = table[0][c & np.uint64(255)] ^ table[1][(c >> np.uint64(8)) & np.uint64(255)] ^ table[2][(c >> np.uint64(16)) & np.uint64(255)] ^ table[3][c >> np.uint64(24)]
        k += 1
    return crc


def _checked_chunks(chunks: DataFrame) -> DataFrame:
    """Digest, n and CRC of every chunk as stored, payload checked against digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes, crcs = b.column(0).to_pylist(), [], []
            for digest, payload, width in zip(digests, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if _digest(payload) != digest:
                    raise ValueError(f"chunk {digest.hex()} doesn't hold what its digest says")
                wide = np.frombuffer(payload, f"<u{width}").astype("<u4").tobytes()
                sizes.append(len(wide) // 4)
                crcs.append(zlib.crc32(wide))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(crcs, pa.int64())], ["digest", "n", "crc"])

    return chunks.mapInArrow(run, "digest binary, n int, crc long")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone; raises where they disagree."""
    width = stored_width(spark, path)
    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "payload", F.lit(width).alias("width"))
    recipes = spark.read.parquet(f"{path}/recipes")
    bad = spark.read.parquet(f"{path}/manifest").alias("m").join(_roots(recipes).alias("r"), "part", "full").where("not (m.root <=> r.root and m.n_docs <=> r.n_docs and m.n_tokens <=> r.n_tokens)")
    if bad.limit(1).count():
        raise ValueError("the manifest doesn't fit the recipes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, root in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if merkle(own) != root:
                    raise ValueError("a document's chunks don't fit its root")
            sizes, owner, tail = b.column(3).to_pylist(), [], []
            for k, own in enumerate(sizes):
                rest = sum(own)
                for x in own:
                    rest -= x
                    owner.append(k)
                    tail.append(rest * 4)
            flat = pa.array([x for own in b.column(1).to_pylist() for x in own], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(owner, pa.int64())), b.column(4).take(pa.array(owner, pa.int64())), b.column(5).take(pa.array(owner, pa.int64())), flat, pa.array(tail, pa.int64()), pa.array([x for own in sizes for x in own], pa.int32())],
                ["doc_id", "start", "n_tokens", "digest", "tail", "size"],
            )

    used = recipes.select("doc_id", "chunks", "root", "sizes", "start", "n_tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, digest binary, tail long, size int")

    @F.pandas_udf("long")
    def shifted(crc: pd.Series, tail: pd.Series) -> pd.Series:
        return pd.Series(crc_shift(crc.to_numpy(np.uint64), tail.to_numpy(np.int64)).astype(np.int64))

    # A chunk that a recipe names but the store lacks makes the checksum null, and the sizes differ.
    parts = used.join(_checked_chunks(chunks), "digest", "left")
    out = parts.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor(shifted("crc", "tail")).alias("ids_crc32"), F.sum("n").alias("found"))
    return out.select("doc_id", "start", "n_tokens", F.when(F.col("found") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a chunk is missing"))).cast("long").alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids of every document, put together from its chunks."""
    width = stored_width(spark, path)
    chunks = spark.read.parquet(f"{path}/chunks")
    recipes = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", F.posexplode("chunks").alias("seq", "digest"))

    @F.pandas_udf("array<int>")
    def ids(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda xs: np.frombuffer(b"".join(xs), f"<u{width}").astype(np.int32))

    whole = recipes.join(chunks, "digest").groupBy("doc_id", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "payload"))), lambda x: x["payload"]).alias("payloads"))
    return whole.select("doc_id", "start", ids("payloads").alias("ids"))
