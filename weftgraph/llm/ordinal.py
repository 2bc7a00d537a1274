"""Quality classifier: ordinal regression on graded ratings.

A cumulative-link (proportional-odds) model: one weight vector shared by all
grades gives a text a place on a line, ordered thresholds cut the line into
grades, P(grade > k) = sigmoid(score - threshold k). Its outputs are the
expected grade and the tail probability of the best grade, by which documents
are selected.

Features: presence of lower-cased words, hashed into 2**BITS places (only
those in at least MIN_DOCS training texts get a weight, the L1 penalty sets
most of them to zero), and a few shares of the whole text (marks, capitals,
repeated lines, words). The model is fitted on the driver on a sample of at
most SAMPLE rated documents, those with the least hash of their doc_id; that
bound is the parameter `sample`. Whole texts are scored where they lie,
without a shuffle.

Defined results: a null text is as an empty one and gets the score of a text
without words; repeated rows get equal results; ratings without a document, or
with a null grade, are left out; conflicting ratings of a document are all
used; with fewer than two grades among the ratings every text gets the one
grade there is (or the lowest); an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as t
from ._common import least_hashed

BITS = 18
SAMPLE = 4000
MIN_DOCS = 5
MARKS = b"#*$%&|<>!"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
N_DENSE = len(MARKS) + 6


def dense(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of each whole text: marks per word, capitals, digits, short texts, repeated lines and words."""
    begin, end, at = t.word_spans(data, offsets)
    n_words = np.maximum(np.diff(at), 1)
    n_bytes = np.maximum(np.diff(offsets), 1)
    cols = [np.minimum(t.per_document(data == m, offsets) / n_words, 3) for m in MARKS]
    cols.append(t.per_document(_UPPER[data], offsets) / n_bytes)
    cols.append(t.per_document(_DIGIT[data], offsets) / n_bytes)
    cols.append((np.diff(at) < 20).astype(float))
    # Lines and words that the text has had before.
    feeds = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    owner = np.searchsorted(offsets, starts, "right") - 1
    long = ends - starts > 20
    ends = np.where(data[ends - 1] == 10, ends - 1, ends) if len(ends) else ends
    h = t.span_hash(data, starts[long], ends[long]) + owner[long].astype(np.uint64) * np.uint64(t.BASE)
    _, one, _ = t.distinct(h)
    fresh = np.zeros(int(long.sum()), bool)
    fresh[one] = True
    lines = np.maximum(np.bincount(owner[long], minlength=len(n_words)), 1)
    cols.append(np.bincount(owner[long][~fresh], minlength=len(n_words)) / lines)
    word = t.span_hash(data, begin, end)
    again = np.zeros(len(word), bool)  # words that follow themselves
    again[1:] = word[1:] == word[:-1]
    again[at[:-1][at[:-1] < len(word)]] = False
    cols.append(np.minimum(3 * t.per_document(again, at) / n_words, 1))
    cols.append(np.minimum(t.per_document(t.NOT_SPACE[data], offsets) / n_words / 10, 2))
    return np.stack(cols, 1)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed place of every word, and the n + 1 offsets of the documents."""
    low = _LOWER[data]
    starts, ends, at = t.word_spans(low, offsets, _WORD)
    return (t.span_hash(low, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64), at


@dataclass
class Model:
    thresholds: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    dense_weights: np.ndarray = field(default_factory=lambda: np.zeros(N_DENSE))
    dense_mean: np.ndarray = field(default_factory=lambda: np.zeros(N_DENSE))
    dense_scale: np.ndarray = field(default_factory=lambda: np.ones(N_DENSE))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        place, at = words(data, offsets)
        n = len(offsets) - 1
        hit = np.flatnonzero(self.weights[place] != 0)
        owner = np.searchsorted(at, hit, "right") - 1
        once = np.unique(owner * np.int64(1 << BITS) + place[hit])
        sparse = np.bincount(once >> BITS, self.weights[once & ((1 << BITS) - 1)], n)
        return sparse + (dense(data, offsets) - self.dense_mean) / self.dense_scale @ self.dense_weights

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def fit(rows: np.ndarray, cols: np.ndarray, x_dense: np.ndarray, grade: np.ndarray, n_grades: int, steps: int = 300, l1: float = 0.0004) -> Model:
    """Maximum likelihood by AdaGrad with an L1 step; (rows, cols): the places that each text has."""
    n = len(grade)
    mean, scale = x_dense.mean(0), np.maximum(x_dense.std(0), 1e-3)
    z = (x_dense - mean) / scale
    used, col = np.unique(cols, return_inverse=True)
    common = np.bincount(col, minlength=len(used)) >= MIN_DOCS
    new = np.cumsum(common) - 1
    keep = common[col]
    row, col, used = rows[keep], new[col[keep]], used[common]
    w, v = np.zeros(len(used)), np.zeros(z.shape[1])
    share = np.array([(grade > k).mean() for k in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    cut = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-6 * np.arange(n_grades - 1))
    # cut[0], then logs of the steps up
    raw = np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])
    sums = [np.full_like(x, 1e-8) for x in (w, v, raw)]
    k_low, k_high = np.maximum(grade - 1, 0), np.minimum(grade, n_grades - 2)
    for step in range(steps):
        cut = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        score = np.bincount(row, w[col], n) + z @ v
        up = np.where(grade > 0, 1 / (1 + np.exp(np.clip(cut[k_low] - score, -40, 40))), 1.0)  # P(grade >= g)
        down = np.where(grade < n_grades - 1, 1 / (1 + np.exp(np.clip(cut[k_high] - score, -40, 40))), 0.0)  # P(grade > g)
        p = np.maximum(up - down, 1e-12)
        d_up, d_down = up * (1 - up) / p, down * (1 - down) / p
        g_score = -(d_up - d_down) / n
        g_cut = np.zeros(n_grades - 1)
        np.add.at(g_cut, k_low, np.where(grade > 0, d_up, 0) / n)
        np.add.at(g_cut, k_high, -np.where(grade < n_grades - 1, d_down, 0) / n)
        g_raw = np.concatenate([[g_cut.sum()], np.cumsum(g_cut[::-1])[::-1][1:] * np.exp(raw[1:])])
        rate = 0.3 / (1 + step / 200)
        for x, g, s in ((w, np.bincount(col, g_score[row], len(w)), sums[0]), (v, z.T @ g_score + 1e-4 * v, sums[1]), (raw, g_raw, sums[2])):
            s += g * g
            x -= rate * g / np.sqrt(s)
        shrink = rate * l1 / np.sqrt(sums[0])
        w[:] = np.sign(w) * np.maximum(np.abs(w) - shrink, 0)
    model = Model(np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])])))
    model.weights[used] = w
    model.dense_weights, model.dense_mean, model.dense_scale = v, mean, scale
    return model


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` rows of `ratings` (doc_id, grade)."""
    rated = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).where("doc_id is not null and grade is not null")
    few = least_hashed(rated, ["doc_id", "grade"], sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")  # `sample` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in t.slices(batches, "text"):
            place, at = words(data, offsets)
            owner = np.repeat(np.arange(rows.num_rows), np.diff(at))
            once = np.unique(owner * np.int64(1 << BITS) + place)
            ends = np.searchsorted(once >> BITS, np.arange(rows.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), pa.ListArray.from_arrays(pa.array(ends), pa.array((once & ((1 << BITS) - 1)).astype(np.int32))), pa.array(list(dense(data, offsets)), pa.list_(pa.float64()))],
                ["doc_id", "grade", "places", "dense"],
            )

    got = texts.select("doc_id", "text", "grade").mapInArrow(run, "doc_id long, grade int, places array<int>, dense array<double>").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("grade", "ascending")]).combine_chunks()
    grade = got.column("grade").to_numpy().astype(np.int64)
    if len(np.unique(grade)) < 2:
        only = int(grade[0]) if len(grade) else 0
        return Model(np.where(np.arange(n_grades - 1) < only, -40.0, 40.0))
    lists = got.column("places").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    cols = lists.flatten().to_numpy().astype(np.int64)
    x = np.stack(got.column("dense").to_pylist())
    return fit(np.repeat(np.arange(len(grade)), sizes), cols, np.asarray(x, float), grade, n_grades)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, expected_grade, p_above_lowest and p_best of every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in t.slices(batches, "text"):
            s = shared.value.score(data, offsets)
            tails = shared.value.tails(s)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(s), pa.array(tails.sum(1)), pa.array(tails[:, 0].copy()), pa.array(tails[:, -1].copy())], ["doc_id", "score", "expected_grade", "p_above_lowest", "p_best"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double, expected_grade double, p_above_lowest double, p_best double")


def grade_of(quality: Column, toxic: Column) -> Column:
    """The scale of the labels: 0 toxic, 1 poor, 2 good."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 2)
