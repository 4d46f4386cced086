"""Operator 2: quality classifier, a support vector machine on naive Bayes features.

Features are indicators of n-grams: one- and two-grams of the tokens of a
text (runs of letters and digits, runs of symbols; ASCII lower-cased), and
one- to four-grams of the tokens' shapes (case class, symbol run, digits,
same as the token before), hashed to ``DIMS`` slots.  Indicators are scaled by
the class log-count ratios, rows to unit length, and a linear hinge-loss model
is fitted by dual coordinate descent.  Margins become probabilities by a
logistic fit on training rows that the model has not seen.

Learning uses a bounded sample of the labelled rows whose
``crc32(doc_id) mod 5`` is not 0: the ``train_rows`` rows with the least hash
of doc_id (a documented parameter).  Scoring reads every whole text; only the
text enters a score.

Defined results: null and empty texts have no feature and get the score of
the intercept; a document with several labels that disagree teaches nothing;
null labels and null doc_ids teach nothing; without rows of both classes
every score is the share of label 1 (0.5 without labels); repeated rows are
each scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simtrail.llm import textvec as tv
from simtrail.llm.shared import share, shared

DIMS = 1 << 20
TRAIN_ROWS = 4_000
SCORE_KEPT = 0.3
# A byte of text takes up to some hundred bytes of n-gram arrays.
BLOCK_BYTES = 1 << 18
# The driver takes in the features of the sample about so many at a time.
FIT_FEATURES = 1 << 17
_U = np.uint64
_SPACE = tv.class_table([0x20, *range(0x09, 0x0E)])
_UPPER = tv.class_table(range(0x41, 0x5B))
_LETTER = tv.class_table([*range(0x41, 0x5B), *range(0x61, 0x7B)])
_DIGIT = tv.class_table(range(0x30, 0x3A))


def tokens(data: np.ndarray, off: np.ndarray):
    """(surface hash, shape code, token offsets by row)."""
    kind = np.where(tv.ALNUM[data], np.uint8(1), np.where(_SPACE[data], np.uint8(0), np.uint8(2)))
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.zeros(len(off), np.int64)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    some = kind[starts] > 0
    starts, ends = starts[some], ends[some]
    tok_off = np.searchsorted(starts, off)
    surface = tv.span_hashes(tv.LOWER[data], starts, ends)
    upper, letters, digits = (_span_counts(t[data], starts, ends) for t in (_UPPER, _LETTER, _DIGIT))
    size = ends - starts
    first = _UPPER[data[starts]]
    word = np.select(
        [digits == size, (upper == letters) & (letters >= 2), first & (upper == 1), upper == 0], [4, 3, 2, 1], 5
    ).astype(np.uint64)
    shape = np.where(kind[starts] == 2, surface | _U(16), word)
    same = np.zeros(len(starts), dtype=bool)
    same[1:] = surface[1:] == surface[:-1]
    same[tok_off[:-1][tok_off[:-1] < len(starts)]] = False
    return surface, tv.mix64(shape * _U(2) + same.astype(np.uint64)), tok_off


def _span_counts(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


def ngram_features(data: np.ndarray, off: np.ndarray, dims: int = DIMS):
    """Distinct hashed n-grams of each row: (feature ids, row offsets)."""
    surface, shape, tok_off = tokens(data, off)
    counts = np.diff(tok_off)
    row = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    left = np.repeat(tok_off[1:], counts) - np.arange(len(surface))
    keys = []
    for stream, most, salt in ((surface, 2, 1), (shape, 4, 101)):
        acc = np.zeros(len(stream), np.uint64)
        for n in range(most):
            m = len(stream) - n
            if m <= 0:
                break
            acc = tv.mix64(acc[:m] * _U(0x9E3779B97F4A7C15) + stream[n:] + _U(salt + n))
            ok = left[:m] > n
            keys.append((row[:m][ok] << _U(32)) | (acc[ok] & _U(dims - 1)))
    key = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.uint64)
    at = np.searchsorted(key, np.arange(len(off), dtype=np.uint64) << _U(32))
    return (key & _U(0xFFFFFFFF)).astype(np.int64), at


def log_count_ratios(ids: np.ndarray, off: np.ndarray, labels: np.ndarray, dims: int, alpha: float = 1.0) -> np.ndarray:
    """Naive Bayes: log of the ratio of the smoothed, normalised class counts of each feature."""
    counts = np.zeros((2, dims), np.int64)
    for first, end, part, o in tv.blocks(ids, off, FIT_FEATURES):
        per_feature = np.repeat(labels[first:end], np.diff(o))
        for label in (0, 1):
            counts[label] += np.bincount(part[per_feature == label], minlength=dims)
    neg, pos = alpha + counts
    return np.log((pos / pos.sum()) / (neg / neg.sum()))


def feature_sums(ids: np.ndarray, off: np.ndarray, values_of) -> np.ndarray:
    """Sum of ``values_of(ids, rows, offsets)`` over each row, as ``tv.row_sums`` of all values (one running sum), a run of rows at a time."""
    out, before = [np.empty(0)], 0.0
    for first, end, part, o in tv.blocks(ids, off, FIT_FEATURES):
        total = np.cumsum(np.concatenate([[before], values_of(part, slice(first, end), o)]))
        out.append(total[o[1:]] - total[o[:-1]])
        before = total[-1]
    return np.concatenate(out)


def dual_coordinate_descent(ids, ratios, size, off, labels, dims: int, c: float = 1.0, epochs: int = 12, seed: int = 3):
    """L1-loss linear SVM: (weights, intercept); the intercept is a constant feature of 1.

    The features of a row are ``ratios`` divided by the row's ``size``; they are
    worked out as a row is met, so only ``ids`` lies in memory whole.
    """
    sign = np.where(labels == 1, 1.0, -1.0)
    weights, bias = np.zeros(dims), 0.0
    duals = np.zeros(len(labels))
    norms = feature_sums(ids, off, lambda at, rows, o: (ratios[at] / np.repeat(size[rows], np.diff(o))) ** 2) + 1.0
    # Equal weight of both classes.
    caps = np.where(labels == 1, c * len(labels) / (2 * max((labels == 1).sum(), 1)), c * len(labels) / (2 * max((labels == 0).sum(), 1)))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(labels)):
            at = ids[off[i] : off[i + 1]]
            x = ratios[at] / size[i]
            slope = sign[i] * (weights[at] @ x + bias) - 1
            new = min(max(duals[i] - slope / norms[i], 0.0), caps[i])
            change = (new - duals[i]) * sign[i]
            if change:
                duals[i] = new
                weights[at] += change * x
                bias += change
                largest = max(largest, abs(change))
        if largest < 1e-3:
            break
    return weights, bias


def row_sizes(squares: np.ndarray) -> np.ndarray:
    """The length of rows by the sums of their squares."""
    return np.sqrt(np.maximum(squares, 1e-12))


def unit_rows(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    return values / np.repeat(row_sizes(tv.row_sums(values * values, off)), np.diff(off))


def logistic_fit(margins: np.ndarray, labels: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """(a, b) of P(1) = 1 / (1 + exp(-(a m + b))) by Newton steps on smoothed targets."""
    pos, neg = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * margins * margins).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(g * margins).sum(), g.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


class QualityModel:
    """Fixed-size model: log-count ratios times weights, the ratios, intercept, calibration."""

    def __init__(self, ratios, weights, bias: float, slope: float, shift: float):
        self.ratios = ratios.astype(np.float32)
        self.weights = weights.astype(np.float32)
        self.bias, self.slope, self.shift = bias, slope, shift

    @classmethod
    def constant(cls, share: float, dims: int = 64) -> QualityModel:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return cls(np.zeros(dims), np.zeros(dims), 0.0, 0.0, float(np.log(share / (1 - share))))

    def margins(self, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
        values = self.ratios[ids].astype(np.float64)
        return tv.row_sums(unit_rows(values, off) * self.weights[ids], off) + self.bias

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        ids, at = ngram_features(data, off, len(self.ratios))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(ids, at) + self.shift, -30, 30)))


def _feature_rows(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tv.text_bytes(batch.column("text"))
            for first, end, d, o in tv.blocks(data, off, BLOCK_BYTES):
                ids, at = ngram_features(d, o, dims)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("order").slice(first, end - first),
                        batch.column("label").slice(first, end - first),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))),
                    ],
                    ["order", "label", "ids"],
                )

    return run


def in_fold(doc_id="doc_id"):
    """True for held-out documents: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS, dims: int = DIMS, epochs: int = 12
) -> QualityModel:
    """Fit on at most ``train_rows`` labelled rows outside the held-out fold."""
    known = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("label"), F.max("quality").alias("__most"))
        .where((F.col("label") == F.col("__most")) & ~in_fold())
        .select("doc_id", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("order"))
    )
    # Bounded by train_rows (24 bytes a row), so this side may be broadcast.
    sample = known.orderBy("order", "doc_id").limit(train_rows)
    texts = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    rows = (
        texts.join(F.broadcast(sample), "doc_id")
        .select("order", "label", "text")
        .mapInArrow(_feature_rows(dims), "order long, label int, ids array<int>")
        .toArrow()
        .combine_chunks()
    )
    if not rows.num_rows:
        return QualityModel.constant(0.5)
    # Tasks end in any order; the fit must not depend on it.
    rows = rows.sort_by([("order", "ascending")]).combine_chunks()
    y = rows.column("label").to_numpy().astype(np.int64)
    if len(np.unique(y)) < 2:
        return QualityModel.constant(float(y.mean()))
    lists = rows.column("ids").combine_chunks()
    off = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]).astype(np.int64)
    ids = lists.flatten().to_numpy()
    del rows, lists
    return fit(ids, off, y, dims, epochs)


def fit(ids: np.ndarray, off: np.ndarray, y: np.ndarray, dims: int, epochs: int) -> QualityModel:
    """The model of rows of features (in the order in which they are learnt) and their labels, of both classes."""
    cut = max(int(len(y) * 0.8), 1)
    if len(np.unique(y[:cut])) < 2 or len(np.unique(y[cut:])) < 2:
        cut = len(y)
    ratios = log_count_ratios(ids[: off[cut]], off[: cut + 1], y[:cut], dims)
    size = row_sizes(feature_sums(ids, off, lambda at, rows, o: ratios[at] * ratios[at]))
    weights, bias = dual_coordinate_descent(ids[: off[cut]], ratios, size, off[: cut + 1], y[:cut], dims, epochs=epochs)
    margins = feature_sums(ids, off, lambda at, rows, o: ratios[at] / np.repeat(size[rows], np.diff(o)) * weights[at]) + bias
    seen = slice(cut, None) if cut < len(y) else slice(None)
    slope, shift = logistic_fit(margins[seen], y[seen])
    return QualityModel(ratios, weights, bias, slope, shift)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared(model)
        for batch in batches:
            data, off = tv.text_bytes(batch.column("__text"))
            out = [fitted.scores(d, o) for _, _, d, o in tv.blocks(data, off, BLOCK_BYTES)]
            names = [c for c in batch.schema.names if c != "__text"]
            scores = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores)], [*names, "score"])

    return run


def with_scores(docs: DataFrame, model: QualityModel, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1 (an existing column of that name is replaced)."""
    rest = docs.drop("score", "__text")
    fitted = share(docs.sparkSession, model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.withColumn("__text", F.col(text).cast("string")).mapInArrow(_score(fitted), f"{schema}, score double")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    inner = docs.select("doc_id", F.col("text").alias("__body"))
    scored = with_scores(inner, model, text="__body").drop("__body")
    predicted = (F.col("score") >= SCORE_KEPT).cast("int").alias("predicted")
    return scored.select("doc_id", in_fold().alias("held_out"), "score", predicted)


def without_rejected(docs: DataFrame, labels: DataFrame, *, least: float = SCORE_KEPT) -> DataFrame:
    """``docs`` whose score reaches ``least``; the model is learnt from the labelled rows of ``docs``."""
    return with_scores(docs, train(docs, labels)).where(F.col("score") >= least).select(*docs.columns)
