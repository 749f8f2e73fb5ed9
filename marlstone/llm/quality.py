"""Quality classifier: regularised quadratic discriminant analysis.

Statistics of whole texts (``profile.quality_features``) are the input; nothing else of a row
is. The sample to learn from is bounded by ``SAMPLE`` labelled ids (of more, those with the smallest
hashes), so it is broadcast and only its texts are described. Class moments are summed in each task and
then over tasks, so training gathers two small matrices. Each class covariance is
shrunk towards the diagonal of the pooled one; its Cholesky factor is kept, and a score is the
logistic of the difference of the Gaussian log-densities (Mahalanobis distances by solving with
the factor, and log-determinants) plus the log-odds of the classes.

Defined cases: a null text counts as empty and gets a score like any other; null labels and
labels of unknown documents are ignored; equal labels of a document count once, others as several
rows; a class with fewer than two training rows gives every text the share of label 1 (0.5 without any
rows); a text of any length is described in blocks; repeated rows, and texts that tie, get equal scores; an
empty table gives an empty result; other columns are ignored; rows with a null doc_id are scored and not
held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.profile import QUALITY, quality_features
from marlstone.llm.session import map_batches

SCORES = "doc_id bigint, held_out boolean, score double, predicted int"
SHRINKAGE = 0.1
FLOOR = 1e-4
THRESHOLD = 0.3
SAMPLE = 200_000


@dataclass
class Gaussian:
    mean: np.ndarray
    factor: np.ndarray  # Cholesky factor of the covariance
    constant: float  # log share of the class, less half the log-determinant

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = np.linalg.solve(self.factor, (x - self.mean).T)
        return self.constant - 0.5 * (z * z).sum(0)


def fit(count: np.ndarray, total: np.ndarray, product: np.ndarray, shrinkage: float = SHRINKAGE) -> list[Gaussian] | float:
    """Gaussians of labels 0 and 1 from counts, sums and sums of products of each class."""
    if count.min() < 2:
        return float(count[1] / count.sum()) if count.sum() else 0.5
    mean = total / count[:, None]
    cov = product / count[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = (count[:, None, None] * cov).sum(0) / count.sum()
    out = []
    for k in (0, 1):
        s = (1 - shrinkage) * cov[k] + shrinkage * np.diag(np.diag(pooled)) + FLOOR * np.eye(len(pooled))
        factor = np.linalg.cholesky(s)
        out.append(Gaussian(mean[k], factor, float(np.log(count[k] / count.sum()) - np.log(np.diag(factor)).sum())))
    return out


def score(model: list[Gaussian] | float, x: np.ndarray) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(x), model)
    d = model[1].log_density(x) - model[0].log_density(x)
    return 1 / (1 + np.exp(-np.clip(d, -500, 500)))


def in_fold(doc_id, folds: int, fold: int):
    """Whether the remainder of crc32 of the id as text is ``fold``."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def sample(labels: DataFrame, label: str, limit: int) -> DataFrame:
    """id and y of about ``limit`` labelled ids at most, the smallest hashes first, to be broadcast: two rows an id at most."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col(label).cast("int").alias("y"))
    rows = rows.filter(F.col("y").isin(0, 1) & F.col("id").isNotNull()).distinct()
    n = rows.agg(F.count_distinct("id")).first()[0]
    rank = F.pmod(F.shiftrightunsigned(F.xxhash64(F.lit(77), "id"), 16), F.lit(1 << 30))
    return F.broadcast(rows.filter(rank < int((1 << 30) * min(1.0, limit / max(n, 1)))))


def train(docs: DataFrame, labels: DataFrame, label: str, shrinkage: float = SHRINKAGE, limit: int = SAMPLE) -> list[Gaussian] | float:
    """The model of rows of ``docs`` that ``labels`` marks; the caller chooses the rows."""
    size = QUALITY

    def moments(batch):
        y = batch.column("y").to_numpy()
        x = quality_features(batch.column("text"))
        for k in (0, 1):
            v = x[y == k]
            sums = np.r_[len(v), v.sum(0), (v.T @ v).ravel()]
            yield [[k] * len(sums), list(range(len(sums))), sums]

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = rows.join(sample(labels, label, limit), F.col("doc_id") == F.col("id")).select("y", "text")
    sums = np.zeros((2, 1 + size + size * size))
    for r in map_batches(rows, moments, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect():
        sums[r["k"], r["i"]] = r["v"]
    return fit(sums[:, 0], sums[:, 1 : 1 + size], sums[:, 1 + size :].reshape(2, size, size), shrinkage)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; rows of the fold are never learnt from."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", in_fold(F.col("doc_id"), folds, fold).alias("held_out"))
    model = train(rows.filter(~F.col("held_out")), labels.filter(~in_fold(F.col("doc_id"), folds, fold)), "quality")

    def each(batch):
        p = score(model, quality_features(batch.column("text")))
        yield [batch.column("doc_id"), batch.column("held_out"), p, (p >= threshold).astype(np.int32)]

    return map_batches(rows, each, SCORES)
