"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

One weight vector is shared by all severity grades; ordered thresholds turn its score into P(grade > k). The output is the expected
severity. Features are words and word beginnings; which ones, and the weights, are learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, stored, whole_text

#: Labelled rows used for fitting (a bound of the training sample: half of it for each class, more where the other has fewer; within a
#: class in the order of a seeded hash) and features kept.
TRAIN_ROWS, MAX_FEATURES = 8000, 2000
#: A feature must stand in so many sampled rows and have so large a chi-square against the label.
LEAST_ROWS, LEAST_CHI2 = 5, 24.0
BEGINNINGS = range(3, 9)
#: Grades: none, mild, medium, severe. Labels say toxic or not; toxic rows are graded by thirds of their share of telling words.
GRADES = 4
SHORT = 40
LETTERS = re.compile(r"[^\W\d_]+")
KNOWN_WORDS = 400_000


def features_of(word: str) -> list[str]:
    """The word itself and its beginnings, marked by a trailing star."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if k < len(word))]


class Reader:
    """Turns texts into counts of known features; remembers the features of words it has met."""

    def __init__(self, index: dict[str, int]):
        class Known(dict):
            def __missing__(self, word: str) -> tuple[int, ...]:
                if len(self) > KNOWN_WORDS:
                    self.clear()
                found = self[word] = tuple(index[f] for f in features_of(word) if f in index)
                return found

        self.known = Known()

    def counts(self, text: str) -> tuple[int, Counter]:
        words = LETTERS.findall(text.lower())
        return len(words), Counter(chain.from_iterable(filter(None, map(self.known.__getitem__, words))))


def rate(count: np.ndarray, words: np.ndarray | int) -> np.ndarray:
    """Value of a feature: its count among a hundred words, on a log scale; SHORT words are added, as a short text's rate says little."""
    return np.log1p(100.0 * count / (words + SHORT))


@dataclass
class Ordinal:
    """P(grade > k) = 1 / (1 + exp(threshold[k] - weights . x))."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, eta: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.thresholds - np.asarray(eta)[..., None], -500, 500)))

    def severity(self, eta: np.ndarray) -> np.ndarray:
        return self.above(eta).sum(axis=-1)


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grade: np.ndarray, width: int, steps: int = 600, ridge: float = 1e-3, pace: float = 0.1) -> Ordinal:
    """Maximum likelihood with a ridge, by Adam over the whole sample.

    Gaps between thresholds are exponentials, so the thresholds stay in order.
    """
    n, cuts = len(grade), GRADES - 1
    share = np.clip(np.array([(grade > k).mean() for k in range(cuts)]), 1e-4, 1 - 1e-4)
    start = -np.log(share / (1 - share))
    gaps = np.maximum(np.diff(start), 1e-2)
    param = np.concatenate([np.zeros(width), start[:1], np.log(gaps)])
    m, v = np.zeros_like(param), np.zeros_like(param)
    for t in range(1, steps + 1):
        weights, first, gap = param[:width], param[width], np.exp(param[width + 1 :])
        theta = np.concatenate([[-np.inf], first + np.r_[0.0, np.cumsum(gap)], [np.inf]])
        eta = np.bincount(rows, weights=values * weights[cols], minlength=n)
        below = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
        high, low = below(theta[grade + 1] - eta), below(theta[grade] - eta)
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high) / p, low * (1 - low) / p
        d_eta = (dh - dl) / n  # of the negative log-likelihood
        g_theta = np.array([(-dh[grade == k].sum() + dl[grade == k + 1].sum()) / n for k in range(cuts)])
        grad = np.concatenate([
            np.bincount(cols, weights=values * d_eta[rows], minlength=width) + ridge * weights, [g_theta.sum()],
            [g_theta[k + 1 :].sum() * gap[k] for k in range(cuts - 1)]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        param = param - pace * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Ordinal(param[:width], param[width] + np.r_[0.0, np.cumsum(np.exp(param[width + 1 :]))])


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and toxic rows of each feature, over a few hundred texts at a time."""
    for batch in batches:
        for at in range(0, len(batch), 300):
            part = batch.slice(at, 300)
            n, toxic = Counter(), Counter()
            for text, label in zip(part.column("text"), part.column("toxic").to_pylist()):
                found = set(chain.from_iterable(map(features_of, set(LETTERS.findall(text.as_py().lower())))))
                n.update(found)
                if label:
                    toxic.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values())), pa.array([toxic[f] for f in n], pa.int64())], ["feature", "n", "toxic"])


@dataclass
class Model:
    index: dict[str, int]
    ordinal: Ordinal
    telling: np.ndarray  # features that stand for toxicity
    flag_at: float  # expected severity from which a text counts as toxic
    tilt: float = 1.0  # sampling rate of clean rows over that of toxic ones

    def chances(self, eta: np.ndarray) -> np.ndarray:
        """P(grade) for every grade among all documents: the sample's, each class divided by its sampling rate."""
        above = self.ordinal.above(eta)
        each = -np.diff(np.c_[np.ones(len(eta)), above, np.zeros(len(eta))], axis=1)
        each[:, 1:] *= self.tilt
        return each / each.sum(axis=1, keepdims=True)

    def severity(self, eta: np.ndarray) -> np.ndarray:
        return self.chances(eta) @ np.arange(GRADES)


def sample_sizes(clean: int, toxic: int, rows: int) -> tuple[int, int]:
    """Rows of each class in a sample of at most `rows`."""
    of_toxic = min(toxic, max(rows // 2, rows - clean))
    return min(clean, rows - of_toxic), of_toxic


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on at most `rows` labelled rows, up to half for each class, so that a rare class is seen.

    Null labels, ids and texts are left out. Grades' chances and the flag's bound are corrected for the classes' sampling rates; where all
    rows fit in, the rates are one. If labels are of one kind only, or none, a warning says so and the answer is None: `severities` then
    flags nothing.
    """
    labelled = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
    all_rows, all_bad = labelled.agg(F.count(F.lit(1)), F.count(F.when(F.col("toxic") > 0, 1))).first()
    sizes = sample_sizes(all_rows - all_bad, all_bad, rows)
    order = (F.xxhash64("doc_id", F.lit(7)), "doc_id")
    parts = [labelled.where(kind).orderBy(*order).limit(size) for kind, size in zip((F.col("toxic") <= 0, F.col("toxic") > 0), sizes)]
    chosen = stored(parts[0].unionByName(parts[1]), "toxic_sample")
    sample = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    sample = stored(sample.dropDuplicates(["doc_id"]), "toxic_texts")
    n, bad = sample.agg(F.count(F.lit(1)), F.count(F.when(F.col("toxic") > 0, 1))).first()
    if not 0 < bad < n:
        warnings.warn(f"toxicity: {bad} toxic rows among {n} labelled texts, so there is no model and nothing is flagged", stacklevel=2)
        return None
    rates = [size / max(whole, 1) for size, whole in zip(sizes, (all_rows - all_bad, all_bad))]
    counts = map_batches(sample.repartition(64, "doc_id"), _feature_counts, "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("t"))
    a, b = F.col("t").cast("double"), (F.col("n") - F.col("t")).cast("double")
    chi2 = F.lit(float(n)) * F.pow(a * (n - bad - b) - b * (bad - a), 2) / (F.lit(float(bad) * (n - bad)) * F.col("n") * F.greatest(n - F.col("n"), F.lit(1)))
    kept = counts.where(F.col("n") >= LEAST_ROWS).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2)
    top = kept.orderBy(F.desc("chi2"), "feature").limit(MAX_FEATURES).collect()
    index = {r["feature"]: k for k, r in enumerate(top)}
    telling = np.array([r["t"] * (n - bad) > (r["n"] - r["t"]) * bad for r in top], dtype=bool)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(index)
        for batch in batches:
            read = [reader.counts(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("toxic"), pa.array([w for w, _ in read], pa.int64()), pa.array([list(c) for _, c in read], pa.list_(pa.int64())),
                pa.array([list(c.values()) for _, c in read], pa.list_(pa.int64()))], ["doc_id", "toxic", "words", "at", "count"])

    id_type = sample.schema["doc_id"].dataType.simpleString()
    encoded = sample.mapInArrow(encode, f"doc_id {id_type}, toxic int, words long, at array<long>, count array<long>").orderBy("doc_id").collect()  # at most `rows`
    sizes = [len(r["at"]) for r in encoded]
    row, col = np.repeat(np.arange(len(encoded)), sizes), np.array([k for r in encoded for k in r["at"]], dtype=np.int64)
    words, count = np.array([r["words"] for r in encoded]), np.array([c for r in encoded for c in r["count"]], dtype=float)
    label = np.array([r["toxic"] for r in encoded]) > 0
    share = np.bincount(row, weights=count * telling[col], minlength=len(encoded)) / np.maximum(words, 1)
    marks = np.quantile(share[label & (share > 0)], [1 / 3, 2 / 3]) if (label & (share > 0)).any() else [1.0, 1.0]
    grade = np.where(label, 1 + np.searchsorted(marks, share, side="right") * (share > 0), 0)
    values = rate(count, words[row])
    ordinal = fit_ordinal(row, col, values, grade, len(index))
    model = Model(index, ordinal, telling, 0.0, rates[0] / rates[1])
    severity = model.severity(np.bincount(row, weights=values * ordinal.weights[col], minlength=len(encoded)))
    order = np.argsort(-severity, kind="stable")
    stands_for = np.where(label, 1 / rates[1], 1 / rates[0])  # rows of the whole table
    right = np.cumsum((label * stands_for)[order])
    f = 2 * right / (np.cumsum(stands_for[order]) + right[-1])
    last = np.r_[severity[order][1:] < severity[order][:-1], True]  # equal severities stand or fall together
    model.flag_at = float(severity[order][np.argmax(np.where(last, f, 0))])
    return model


def severities(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, severity (expected grade, 0 to GRADES - 1), grade (most likely), score (P of any grade above 0), toxic for every row.

    A null or empty text has no features: it gets what such a text gets from the model, and is never flagged. Without a model (labels of
    one kind only, or none) the values are 0 and false. Texts of any length are read whole. Rows that repeat an id are judged one by one. An empty table gives an empty
    result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        reader = Reader(model.index) if model else None
        for batch in batches:
            eta, hits = np.zeros(len(batch)), np.zeros(len(batch), dtype=bool)
            for i, value in enumerate(batch.column("text")):
                if reader:
                    words, found = reader.counts(value.as_py())
                    at = np.fromiter(found.keys(), np.int64, len(found))
                    eta[i] = model.ordinal.weights[at] @ rate(np.fromiter(found.values(), float, len(found)), words)
                    hits[i] = model.telling[at].any()
            each = model.chances(eta) if model else np.eye(GRADES)[np.zeros(len(batch), dtype=int)]
            severity, above = each @ np.arange(GRADES), each[:, 1:].sum(axis=1)
            toxic = hits & (severity >= model.flag_at) if model else hits
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(severity), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above), pa.array(toxic)],
                ["doc_id", "severity", "grade", "score", "toxic"])

    return map_batches(
        docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text")), run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, severity double, grade int, score double, toxic boolean")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return severities(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
