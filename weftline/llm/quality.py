"""Document quality by a regularised quadratic discriminant over statistics of the text.

Each document becomes a short vector of transformed statistics. Spark sums the means and
covariances of each class over all labelled rows; each class covariance is shrunk towards the
pooled one and towards a multiple of the identity, and its Cholesky factor is computed once. The
score of a document is the logistic function of the difference of the two log densities
(Mahalanobis distances and log determinants) plus the log odds of the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import as_bytes, cut

FEATURES = ["f_upper", "f_marks", "f_digits", "f_stops", "f_repeat", "f_distinct", "f_word", "f_letters"]


@dataclass(frozen=True)
class QualityParams:
    """pooled: weight of the pooled covariance in a class covariance. ridge: weight of its mean
    variance times the identity. odds: the largest prior odds of a class over the other.
    threshold: least score of a good document."""

    pooled: float = 0.3
    ridge: float = 0.05
    odds: float = 4.0
    threshold: float = 0.3


def _mask(values: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(values)] = 1
    return out


_UPPER = _mask(bytes(range(65, 91)))
_DIGIT = _mask(bytes(range(48, 58)))
_STOPS = _mask(b".,")
_SPACE = _mask(b" \t\n\r\x0b\x0c")
_LETTER = _UPPER + _mask(bytes(range(97, 123))) + _mask(bytes(range(128, 256)))
_MARK = 1 - np.minimum(1, _LETTER + _DIGIT + _STOPS + _SPACE)


def statistics(text: bytes | None) -> list[float]:
    """The vector of FEATURES. Every share is drawn to a usual value as if some usual text were added, so short and empty texts are near it."""
    text = text or b""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    total = len(text)
    words = text.split()
    n = len(words)
    share = lambda k, of, usual, weight: (k + usual * weight) / (of + weight)
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    distinct = len(set(words))
    bulk = float(total - counts @ _SPACE)
    return [
        share(counts @ _UPPER, total, 0.015, 100) ** 0.5,
        share(counts @ _MARK, total, 0.001, 50) ** 0.5,
        share(counts @ _DIGIT, total, 0.002, 100) ** 0.5,
        share(counts @ _STOPS, n, 0.15, 30) ** 0.5,
        share(repeated, n, 0.01, 20) ** 0.5,
        float(np.log(share(distinct, n**0.9, 1.3, 30))),
        float(np.log(share(bulk, n, 5.2, 30))),
        share(counts @ _LETTER, bulk, 0.95, 100),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(t) for t in as_bytes(batch.column("text"))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *map(pa.array, found.T.copy())], names=["doc_id", *FEATURES])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass(frozen=True)
class Discriminant:
    """Means and lower Cholesky factors of the classes 0 and 1, and the log odds of class 1."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_odds: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(x), 1 / (1 + np.exp(-self.log_odds)))
        density = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            density.append(-0.5 * (z * z).sum(axis=0) - np.log(np.diag(factor)).sum())
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_odds, -500, 500)))


def fit(rows: DataFrame, p: QualityParams) -> Discriminant:
    """From rows (label 0 or 1, FEATURES); all of them, summed by Spark.

    Without rows of both classes there are no densities: every score is then the share of class 1,
    with one row of each class added.
    """
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.count("*").alias("n"), *(F.avg(f).alias(f"m_{f}") for f in FEATURES)]
    sums += [F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c_{i}_{j}") for i, j in pairs]
    found = {r["label"]: r for r in rows.groupBy("label").agg(*sums).collect()}
    n = [found[k]["n"] if k in found else 0 for k in (0, 1)]
    odds = np.clip((n[1] + 1) / (n[0] + 1), 1 / p.odds, p.odds)
    if min(n) < 2:
        return Discriminant([], [], float(np.log(odds)))
    means, covs = [], []
    for k in (0, 1):
        means.append(np.array([found[k][f"m_{f}"] for f in FEATURES]))
        cov = np.zeros((d, d))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = found[k][f"c_{i}_{j}"]
        covs.append(cov)
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    scale = np.sqrt(np.diag(pooled) + 1e-9)  # shrinks each feature on its own scale
    factors = []
    for cov in covs:
        near = ((1 - p.pooled) * cov + p.pooled * pooled) / np.outer(scale, scale)
        near = (1 - p.ridge) * near + p.ridge * np.trace(near) / d * np.eye(d)
        factors.append(np.linalg.cholesky(near * np.outer(scale, scale)))
    return Discriminant(means, factors, float(np.log(odds)))


def held_out(doc_id: F.Column, parts: int, part: int) -> F.Column:
    """Whether crc32(doc_id as text) modulo parts is part; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def learn(found: DataFrame, labels: DataFrame, p: QualityParams) -> Discriminant:
    """From the features of documents that aren't held out and their labels."""
    known = labels.select("doc_id", F.col("quality").alias("label")).where("label in (0, 1)")
    return fit(found.where(~held_out(F.col("doc_id"), 5, 0)).join(known, "doc_id"), p)


def score_quality(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted.

    Learns from the rows of labels (doc_id, quality 0 or 1) whose documents aren't held out
    (crc32 of doc_id modulo 5 is 0). Other or null labels and labels without a document teach
    nothing; repeated labels count as often as they stand. Null and empty texts are scored like
    any text. Rows whose doc_id is null are scored and teach nothing. Other columns are not read.
    """
    found = cut(features(docs))
    model = learn(found, labels, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy() for f in FEATURES])
            score = model.scores(x)
            predicted = (score >= p.threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(predicted)], names=["doc_id", "score", "predicted"])

    scored = found.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """The rows of docs, all columns, whose score is at least the threshold; learned as in score_quality."""
    model = learn(features(docs), labels, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in as_bytes(batch.column("text"))]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.scores(x) >= p.threshold))

    return docs.mapInArrow(run, docs.schema)
