"""Quality rules: repetition inside a document, from its suffix array.

The words of a text are symbols. An enhanced suffix array (order and
longest-common-prefix lengths) gives its common-prefix intervals by a stack
scan; an interval of at least `min_repeat` words whose suffixes differ in the
word before them is a maximal repeated substring. The union of the spans of
their occurrences is the covered fraction, the longest of them the longest
repeat. A document passes if both stay within
their limits. Every covered word also lies in a repeated window of five words,
of which the base rule allows 20%: limits of that much or more would reject
nothing that the base rule does not, so they lie well below it.

Documents are independent, so there is no shuffle: each task looks at about
2 MB of whole texts at once, with one suffix array in which words of different
documents never match.

Lines and words are told apart by their bytes, not by a hash alone. A very
long text is looked at whole, by itself; it takes about 40 times its size in
memory while it is.

Defined results: null and empty texts have no words and fail the base rule of
ten words; ties in the suffix order can't occur, as every suffix of a
document ends at another place; repeated rows each get their own result; an
empty table gives an empty result; further columns, whatever their names, are
neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t

SYMBOLS = b"#*$%&|<>"
#: Repeats count from this many words; more than this part of a text in them, or one repeat of more than this part of it, is too much.
#: A repeat lies in its text twice, so that the second limit is less than half the first.
MIN_REPEAT = 10
MAX_COVERED = 0.1
MAX_LONGEST = 0.04

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_covered_words long, longest_repeat long, n_maximal long, base_failed boolean, kept boolean"
)
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_IS_LEAD = (np.arange(256) & 0xC0) != 0x80


def _maximal(lcp: np.ndarray, left: np.ndarray, least: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Places in the order whose suffixes lie in deep intervals, and the intervals (over them) of maximal repeats, children first."""
    deep = lcp >= least
    inside = deep.copy()
    inside[:-1] |= deep[1:]
    slots = np.flatnonzero(inside)
    if not len(slots):
        return slots, []
    own = np.where(deep[slots], lcp[slots], 0)  # a run's first suffix shares less with the one before it
    return slots, list(t.interval_tree(own, left[slots], least))


def measure(data: np.ndarray, offsets: np.ndarray, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """Counts of each document: whole texts in, one array entry per document out."""
    n = len(offsets) - 1
    starts, ends, at = t.word_spans(data, offsets)
    out = {"n_words": np.diff(at)}
    out["word_chars"] = t.per_document(t.NOT_SPACE[data] & _IS_LEAD[data], offsets)
    out["n_symbols"] = t.per_document(_IS_SYMBOL[data], offsets)

    # Lines: what lies between line feeds and the document's bounds, with a word in it.
    feeds = np.flatnonzero(data == 10)
    line_starts = np.concatenate([offsets[:-1], feeds + 1])
    doc_of_feed = np.searchsorted(offsets, feeds, "right") - 1
    owner = np.concatenate([np.arange(n), doc_of_feed])
    by = np.argsort(line_starts * 2 + (np.arange(len(line_starts)) >= n), kind="stable")
    # An empty document shares its start with the next one: order by document first.
    by = by[np.argsort(owner[by], kind="stable")]
    line_starts, owner = line_starts[by], owner[by]
    line_ends = np.empty_like(line_starts)
    if len(line_starts):
        last = np.append(owner[1:] != owner[:-1], True)
        line_ends[:-1] = line_starts[1:] - 1
        line_ends[last] = offsets[owner[last] + 1]
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, owner = line_starts[has_word], line_ends[has_word], owner[has_word]
    _, line = t.span_numbers(data, line_starts, line_ends)
    key = owner * np.int64(len(line) + 1) + line
    out["n_dup_lines"] = np.bincount(owner, minlength=n) - np.bincount(owner[np.unique(key, return_index=True)[1]], minlength=n)

    doc_of_word = np.repeat(np.arange(n), out["n_words"])
    one, word = t.span_numbers(data, starts, ends)
    array = t.SuffixArray(doc_of_word * np.int64(len(one) + 1) + word, at[1:][doc_of_word])
    lcp = array.lcp()
    nearest = lcp.copy()  # of each suffix: the longest prefix it shares with any other
    nearest[:-1] = np.maximum(lcp[:-1], lcp[1:])
    five = array.order[nearest >= 5]
    out["n_repeat_words"] = t.per_document(t.covered(five, np.full(len(five), 5), len(word)), at)
    left = np.full(len(word), 0, np.int64)
    left[1:] = word[:-1]
    left[at[:-1][out["n_words"] > 0]] = -1 - np.arange(int((out["n_words"] > 0).sum()))  # nothing stands before a text
    slots, intervals = _maximal(lcp, left[array.order], min_repeat)
    length = t.deepest(len(slots), intervals)
    places = array.order[slots]
    out["n_covered_words"] = t.per_document(t.covered(places, length, len(word)), at)
    out["n_maximal"] = np.zeros(n, np.int64)
    if intervals:
        first, _, size = np.array(intervals).T
        doc = doc_of_word[places[first]]
        out["n_maximal"] = np.bincount(doc, minlength=n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc_of_word[array.order], nearest)
    out["longest_repeat"] = longest
    return out


def repetition(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """Counts and verdicts of every document of `docs` (doc_id, text), see SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in t.slices(batches, "text"):
            m = measure(data, offsets, min_repeat)
            n_words = m["n_words"]
            failed = (n_words < 10) | (100 * m["n_repeat_words"] > 20 * n_words)
            good = (m["n_covered_words"] <= max_covered * n_words) & (m["longest_repeat"] <= np.maximum(max_longest * n_words, min_repeat))
            cols = [rows.column(rows.schema.get_field_index("doc_id")).cast(pa.int64())]
            cols += [pa.array(m[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat", "n_maximal")]
            cols += [pa.array(failed), pa.array(~failed & good)]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, **limits) -> DataFrame:
    """The rows of `docs`, all columns, that the rules keep; the text is judged where it lies, without a join."""
    limits = {"min_repeat": MIN_REPEAT, "max_covered": MAX_COVERED, "max_longest": MAX_LONGEST} | limits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in t.slices(batches, "text"):
            m = measure(data, offsets, limits["min_repeat"])
            n_words = m["n_words"]
            good = (n_words >= 10) & (100 * m["n_repeat_words"] <= 20 * n_words) & (m["n_covered_words"] <= limits["max_covered"] * n_words)
            good &= m["longest_repeat"] <= np.maximum(limits["max_longest"] * n_words, limits["min_repeat"])
            yield rows.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


