"""Severity grades by cumulative-link ordinal regression on sparse text features.

Features are the words of a text and the first 4, 5 and 6 bytes of longer words, each valued
log(1 + count). One weight vector w serves all thresholds: P(grade >= k) = sigmoid(w.x - theta_k) with rising theta_k. The
model is fitted on a bounded, documented sample of the labelled rows; every document is scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelry.sources.scratch import keep
from parcelry.llm.words import PLAIN, Words, mix, slices

_PREFIXES = (4, 5, 6)
_OWN = ("expected_severity", "grade", "toxic")


@dataclass
class SeverityModel:
    """Feature hashes in rising order with their weights, and one threshold per grade above 0."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, margin: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., one row per text."""
        return _sigmoid(margin[:, None] - self.thresholds[None, :])


def fit_severity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    grade_col: str = "grade",
    sample_rows: int = 10_000,
    max_grade: int = 10,
    features: int = 4096,
    min_texts: int = 3,
    min_z: float = 4.5,
    l2: float = 1e-4,
    rounds: int = 300,
) -> SeverityModel:
    """Fit on at most ``sample_rows`` labelled texts: those whose ids have the smallest hashes (all, if there are no more).

    ``labels`` holds the ids of some ``docs`` and their grades. The sample is drawn before any text is read, so the join broadcasts a bounded
    table and only sampled texts move. The ``features`` that differ most between grade 0 and the rest are kept, as far as they differ by
    ``min_z`` standard errors. Their counts are made in the cluster; only the chosen features' values of the sample reach the driver.

    Defined cases: ``grade_col`` holds whole numbers from 0 to ``max_grade``; labels with another or a null grade or a null id take no part; an id that is
    labelled several times has its highest grade; of rows that share an id one takes part, that with the smallest text hash;
    null texts take no part. Without any labelled row, or with grade 0 alone, every text gets grade 0; without a grade 0, every text gets the highest.
    Other columns are not looked at.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade")).filter(F.col("id").isNotNull() & F.col("grade").between(0, max_grade))
    known = known.groupBy("id").agg(F.max("grade").alias("grade"))
    top = known.agg(F.max("grade")).collect()[0][0] or 1
    drawn = keep(known.orderBy(F.xxhash64(F.lit("severity"), "id"), "id").limit(sample_rows), "drawn")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL").join(F.broadcast(drawn), "id")
    # The tasks that read the texts leave one for each id already.
    one = texts.groupBy("id", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one"))
    sample = keep(one.select(F.col("one.text").alias("text"), "grade"), "sample")
    seen = {r["grade"]: r["count"] for r in sample.groupBy("grade").count().collect()}
    clean, other = seen.get(0, 0), sum(n for g, n in seen.items() if g > 0)
    if not clean or not other:
        return SeverityModel(np.zeros(0, np.uint64), np.zeros(0), np.full(top, np.inf if not other else -np.inf))

    present = sample.mapInArrow(_present, "feature long, bad boolean")
    counted = present.groupBy("feature").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).filter(F.col("n") >= min_texts)
    share, p1, p0 = F.col("n") / (clean + other), F.col("bad") / other, (F.col("n") - F.col("bad")) / clean
    z = F.abs(p1 - p0) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / other + 1 / clean))
    chosen = np.array([r["feature"] for r in counted.select("feature", z.alias("z")).filter(F.col("z") >= min_z).orderBy(F.desc("z"), "feature").limit(features).collect()], np.int64).view(np.uint64)
    chosen = np.sort(chosen)

    data = sample.mapInArrow(lambda batches: _design(batches, chosen), "grade int, at array<int>, value array<float>").toArrow()
    grade = data.column("grade").to_numpy()
    at = data.column("at").combine_chunks()
    row = np.repeat(np.arange(len(grade)), at.value_lengths().to_numpy(zero_copy_only=False))
    value = data.column("value").combine_chunks().flatten().to_numpy().astype(float)
    weights, thresholds = _fit(Objective(grade, row, at.flatten().to_numpy(), value, len(chosen), top, l2), rounds)
    used = weights != 0
    return SeverityModel(chosen[used], weights[used], thresholds)


def score_severity(docs: DataFrame, model: SeverityModel, *, text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """Add ``expected_severity`` (sum of P(grade >= k)), ``grade`` (most likely grade) and ``toxic`` (P(grade >= 1) >= ``reject_at``).

    Defined cases: a null or empty text is scored on no features, that is by the thresholds alone; rows are judged one by one, so
    repeated rows get equal scores; an empty table gives an empty result. Columns of ``docs`` named like an added one are replaced.
    """
    docs = docs.drop(*_OWN)
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most `features` weights
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("expected_severity double, grade int, toxic boolean").fields])
    return docs.mapInArrow(lambda batches: _score(batches, at, sent.value, reject_at), schema)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature hash of every word and prefix."""
    size = words.end - words.start
    raw = np.concatenate([words.raw, np.zeros(8, np.uint8)])
    first = np.lib.stride_tricks.sliding_window_view(raw, 8)[words.start].view(np.uint64).ravel()
    of, found = [words.text_of()], [words.hashes()]
    for n in _PREFIXES:
        longer = np.flatnonzero(size > n)
        of.append(of[0][longer])
        found.append(mix((first[longer] & np.uint64((1 << 8 * n) - 1)) + np.array([n << 56], np.uint64)))
    return np.concatenate(of), np.concatenate(found)


def _counts(of: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((feature, of))
    of, feature = of[order], feature[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (feature[1:] != feature[:-1])
    at = np.flatnonzero(new)
    return of[at], feature[at], np.diff(np.append(at, len(of)))


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            of, feature, _ = _counts(*_features(Words(part.column(0), PLAIN)))
            bad = np.asarray(part.column(1).to_numpy(zero_copy_only=False)) > 0
            yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(bad[of])], names=["feature", "bad"])


class _Known:
    """Values of a fixed, sorted set of features; a bit table drops most others at once."""

    def __init__(self, features: np.ndarray):
        self.features = features
        self.table = np.zeros(1 << 16, bool)
        self.table[(features >> np.uint64(48)).astype(np.int64)] = True

    def values(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of, feature = _features(words)
        likely = self.table[(feature >> np.uint64(48)).astype(np.int64)]
        of, feature = of[likely], feature[likely]
        if not len(self.features):
            return of[:0], of[:0], np.zeros(0)
        at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        same = self.features[at] == feature
        of, at, n = _counts(of[same], at[same])
        return of, at, np.log1p(n)


def _design(batches: Iterator[pa.RecordBatch], features: np.ndarray) -> Iterator[pa.RecordBatch]:
    known = _Known(features)
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            of, at, value = known.values(Words(part.column(0), PLAIN))
            ends = pa.array(np.searchsorted(of, np.arange(part.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(1), pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(value, pa.float32()))], names=["grade", "at", "value"]
            )


@dataclass
class Objective:
    """The mean negative log-likelihood of graded sparse rows, with a ridge on the weights and a weak pull of the thresholds to where they start.

    Parameters are the weights, the first threshold, and the logarithms of the steps to the later ones, so thresholds always rise.
    """

    grade: np.ndarray
    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    n_features: int
    top: int
    l2: float

    def start(self) -> np.ndarray:
        n = len(self.grade)
        share = np.clip(np.array([(self.grade >= k).mean() for k in range(1, self.top + 1)]), 0.5 / n, 1 - 0.5 / n)
        theta = np.maximum.accumulate(np.log(1 / share - 1) + 0.01 * np.arange(self.top))
        self.prior = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 0.1))])
        return np.concatenate([np.zeros(self.n_features), self.prior])

    def thresholds(self, x: np.ndarray) -> np.ndarray:
        return x[self.n_features] + np.concatenate([[0.0], np.cumsum(np.exp(x[self.n_features + 1 :]))])

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """The value and its gradient."""
        n, w, steps = len(self.grade), x[: self.n_features], np.exp(x[self.n_features + 1 :])
        margin = np.bincount(self.row, self.value * w[self.col], n)
        # P(grade >= k) for k = 0 .. top + 1; a grade's probability is the difference of its neighbours.
        p = np.column_stack([np.ones(n), _sigmoid(margin[:, None] - self.thresholds(x)[None, :]), np.zeros(n)])
        slope, i, grade = p * (1 - p), np.arange(n), self.grade
        each = np.maximum(p[i, grade] - p[i, grade + 1], 1e-12)
        off = x[self.n_features :] - self.prior
        loss = -np.log(each).mean() + 0.5 * self.l2 * (w @ w) + 0.5 * (off @ off) / n
        g_margin = -(slope[i, grade] - slope[i, grade + 1]) / each / n
        g_theta = np.zeros(self.top + 2)
        np.add.at(g_theta, grade, slope[i, grade] / each / n)
        np.add.at(g_theta, grade + 1, -slope[i, grade + 1] / each / n)
        after = np.cumsum(g_theta[1:-1][::-1])[::-1]
        g_weights = np.bincount(self.col, self.value * g_margin[self.row], self.n_features) + self.l2 * w
        return loss, np.concatenate([g_weights, after[:1] + off[:1] / n, after[1:] * steps + off[1:] / n])


def _fit(objective: Objective, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimise with Adam."""
    x = objective.start()
    first, second = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1):
        _, g = objective(x)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        x = x - 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return x[: objective.n_features], objective.thresholds(x)


def _score(batches: Iterator[pa.RecordBatch], text_at: int, model: SeverityModel, reject_at: float) -> Iterator[pa.RecordBatch]:
    known = _Known(model.features)
    for batch in batches:
        for part in slices(batch, batch.schema.names[text_at], 1 << 20):
            of, at, value = known.values(Words(part.column(text_at), PLAIN))
            p = model.at_least(np.bincount(of, value * model.weights[at], part.num_rows) if len(at) else np.zeros(part.num_rows))
            each = np.column_stack([np.ones(len(p)), p]) - np.column_stack([p, np.zeros(len(p))])
            own = [pa.array(p.sum(axis=1)), pa.array(each.argmax(axis=1), pa.int32()), pa.array(p[:, 0] >= reject_at)]
            yield pa.RecordBatch.from_arrays([*part.columns, *own], names=[*part.schema.names, *_OWN])
