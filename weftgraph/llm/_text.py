"""Vectorised text primitives over Arrow string buffers (numpy only).

Texts are looked at as UTF-8 bytes. Words are runs of bytes that a 256-entry
table accepts; as all separators used here are ASCII, that equals the
code-point definition.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
#: Random 64-bit value of each byte, and the odd base of the polynomial.
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}

#: Of k bytes, in little-endian order, the bits that belong to them.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans up to this length are hashed and compared eight bytes at a time.
LONG_SPAN = 128
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: Space and the controls 9 to 13 end a word.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.ones(1, np.uint64)
        while len(have) < size:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 2**64))])
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte values (or of 64-bit numbers, made odd) times powers; n + 1 entries."""
    out = np.zeros(len(data) + 1, np.uint64)
    values = BYTE_VALUE[data] if data.dtype == np.uint8 else data | np.uint64(1)
    np.cumsum(values * powers(BASE, len(data)), out=out[1:])
    return out


def rolling_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each byte span; equal spans agree, but different ones can be made to: for candidates only."""
    inverse = powers(_INVERSE, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the end."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 8,), "<u8", padded, 0, (1,))


def _chunk(eights: np.ndarray, places: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place, of `left` that are there."""
    return eights[places] & _MASK[np.minimum(left, 8)]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, equal for equal bytes wherever they stand.

    Eight bytes at a time, each mixed in before the next; spans beyond
    LONG_SPAN by BLAKE2b. Where results must not hang on a hash, `spans_equal`
    compares the bytes.
    """
    eights, size = _eights(data), ends - starts
    h = mix(_chunk(eights, starts, size) + size.astype(np.uint64) * np.uint64(BASE))
    rest, k = np.flatnonzero((size > 8) & (size <= LONG_SPAN)), 8
    while len(rest):
        h[rest] = mix((h[rest] ^ _chunk(eights, starts[rest] + k, size[rest] - k)) * np.uint64(_INVERSE))
        k += 8
        rest = rest[size[rest] > k]
    long = np.flatnonzero(size > LONG_SPAN)
    if len(long):
        raw = data.tobytes()
        digests = [hashlib.blake2b(raw[a:b], digest_size=8, key=b"weft").digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        h[long] = np.frombuffer(b"".join(digests), "<u8")
    return h


def spans_equal(data: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether so many bytes of `data` from each `a` on are those of `other` from `b` on."""
    one, two = _eights(data), _eights(other) if other is not data else None
    two = one if two is None else two
    same = _chunk(one, a, size) == _chunk(two, b, size)
    rest, k = np.flatnonzero(same & (size > 8) & (size <= LONG_SPAN)), 8
    while len(rest):
        same[rest] = _chunk(one, a[rest] + k, size[rest] - k) == _chunk(two, b[rest] + k, size[rest] - k)
        k += 8
        rest = rest[same[rest] & (size[rest] > k)]
    for i in np.flatnonzero(same & (size > LONG_SPAN)).tolist():
        same[i] = np.array_equal(data[a[i] : a[i] + size[i]], other[b[i] : b[i] + size[i]])
    return same


def span_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different span, and of each span the number of its bytes among them: by hash, and then by the bytes."""
    _, one, which = distinct(span_hash(data, starts, ends))
    first, size = one[which], ends - starts
    if len(which) and not ((size == size[first]).all() and spans_equal(data, starts, data, starts[first], size).all()):
        raw = data.tobytes()  # different spans share a hash: number them by their bytes
        seen: dict[bytes, int] = {}
        which = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        _, one = np.unique(which, return_index=True)
    return one, which


def release() -> None:
    """Give memory that Arrow and the allocator hold back to the system, between pieces of work."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and of each place the number of its value."""
    by = np.argsort(values)
    keys = values[by]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    which = np.empty(len(keys), np.int64)
    which[by] = np.cumsum(fresh) - 1
    return keys[fresh], by[fresh], which


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets (from 0) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        kind = np.int32
    else:
        kind = np.int64
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches so that a piece has about `max_bytes` of text, or one longer text; yields rows, bytes, offsets."""
    for batch in batches:
        data, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        n, i = batch.num_rows, 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1)
            j = min(j, n)
            release()
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, accepts: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and n + 1 offsets of the documents into them."""
    n = len(data)
    word = accepts[data]
    before = np.zeros(n, bool)
    after = np.zeros(n, bool)
    if n:
        before[1:] = word[:-1]
        after[:-1] = word[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        before[cuts] = False
        after[cuts - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of `flags` within each document."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Boolean mask of the union of spans over 0..n."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


class SuffixArray:
    """Enhanced suffix array of many short sequences at once.

    `first` gives a number of each position, equal where the first `unit`
    symbols are equal; `ends` is the end of the sequence that a position lies
    in. Prefix doubling sorts again only the suffixes that are not yet alone
    in their group. Suffixes of different sequences compare as long as `first`
    lets them; a suffix that ends sorts before one that goes on.
    """

    def __init__(self, first: np.ndarray, ends: np.ndarray, unit: int = 1):
        n = len(first)
        self.n, self.unit, self.ends = n, unit, ends
        order = np.argsort(first) if n else np.zeros(0, np.int64)
        fresh = np.ones(n, bool)
        if n:
            keys = first[order]
            fresh[1:] = keys[1:] != keys[:-1]
        rank = np.empty(n, np.int64)
        place = np.arange(n)
        rank[order] = np.maximum.accumulate(np.where(fresh, place, 0)) if n else place
        self.levels = [rank.astype(np.int32)]
        step = unit
        while n:
            alone = fresh.copy()
            alone[:-1] &= fresh[1:]
            slots = np.flatnonzero(~alone)
            if not len(slots):
                break
            who = order[slots]
            ahead = who + step
            inside = ahead < ends[who]
            second = np.where(inside, rank[np.minimum(ahead, n - 1)], -1)
            if not inside.any():
                break
            key = rank[who] * np.int64(n + 1) + second + 1
            again = np.argsort(key)
            order[slots] = who[again]
            keys = key[again]
            new = np.ones(len(slots), bool)
            new[1:] = keys[1:] != keys[:-1]
            fresh[slots] = new
            rank = rank.copy()
            rank[order[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
            self.levels.append(rank.astype(np.int32))
            step *= 2
        self.order = order

    def lcp(self) -> np.ndarray:
        """Symbols (in steps of one, from units of `unit` up) that each suffix shares with the one before it; exact for unit 1."""
        n = self.n
        out = np.zeros(n, np.int64)
        if n < 2:
            return out
        i, j = self.order[:-1], self.order[1:]
        got = np.flatnonzero(self.levels[0][i] == self.levels[0][j])
        a, b = i[got].copy(), j[got].copy()
        ea, eb = self.ends[a], self.ends[b]
        length = np.zeros(len(got), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, width = self.levels[k], self.unit << k
            ok = (a + width <= ea) & (b + width <= eb)
            ok &= level[np.minimum(a, n - 1)] == level[np.minimum(b, n - 1)]
            a += width * ok
            b += width * ok
            length += width * ok
        out[got + 1] = length
        return out


def interval_tree(lcp: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Stack scan: (first, last, length) of each common-prefix interval of at least `least` whose left neighbours differ.

    lcp[k] is what suffix k shares with suffix k - 1 (lcp[0] = 0); left is the
    byte before each suffix, or a number of its own where there is none.
    """
    # An entry: length, first suffix, a left neighbour, whether they differ.
    stack: list[list] = []
    prefix, before = lcp.tolist(), left.tolist()
    for k in range(1, len(prefix) + 1):
        here = prefix[k] if k < len(prefix) else 0
        start, byte, mixed = k - 1, before[k - 1], False
        while stack and stack[-1][0] > here:
            length, start, b, m = stack.pop()
            mixed = mixed or m or b != byte
            byte = b
            if mixed:
                yield start, k - 1, length
        if here >= least:
            if stack and stack[-1][0] == here:
                stack[-1][3] = stack[-1][3] or mixed or stack[-1][2] != byte
            else:
                stack.append([here, start, byte, mixed])
        elif stack:  # below `least` nothing is open
            stack.clear()


def deepest(n: int, intervals: list[tuple[int, int, int]]) -> np.ndarray:
    """Of n suffixes, the length of the deepest interval that each lies in; intervals come children first, as the scan gives them."""
    out = np.zeros(n, np.int64)
    free = list(range(n + 1))  # the next suffix without a length, by jumps
    for first, last, length in intervals:
        k = first
        while True:
            root = k
            while free[root] != root:
                root = free[root]
            while free[k] != root:
                free[k], k = root, free[k]
            if root > last:
                break
            out[root] = length
            free[root] = root + 1
            k = root
    return out
