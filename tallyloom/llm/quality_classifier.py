"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Learning needs, per class, the number of rows, the sum of the features and the sum of their products. Tasks add those up
over their rows and the sums are combined by key, so all labelled rows count and only a fixed number of sums reaches the
driver. Class covariances are shrunk towards the pooled diagonal; their Cholesky factors are computed once, sent out with
the model and used to whiten features, so a score is the logistic of prior odds plus the difference of two Gaussian log
densities (half Mahalanobis distance plus half log determinant).

Defined cases: null text counts as empty and is scored like any other; label rows with null quality, with a quality other
than 0 or 1, or without a document are ignored; repeated labels count each; with a single labelled class the score is 1
or 0, with none it is 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import held_out, learnable, without
from tallyloom.llm.stats import text_counts
from tallyloom.session import cut_lineage

SHRINK = 0.3
CUT = 0.3
FEATURES = 13


def features(text: str | None) -> list[float]:
    """Statistics of a whole text, transformed to be closer to Gaussian: logs of sizes, roots of shares."""
    c = text_counts(text)
    words, chars, size = max(1, c["n_words"]), max(1, c["word_chars"]), max(1, c["n_bytes"])
    distinct = c["n_distinct"] / words
    return [
        math.log1p(c["n_words"]),
        math.log1p(c["n_lines"]),
        c["word_chars"] / words / 10,
        math.sqrt(c["n_symbols"] / chars),
        math.sqrt(c["n_dup_lines"] / max(1, c["n_lines"])),
        math.sqrt(c["n_repeat_words"] / words),
        math.sqrt(c["n_upper"] / chars),
        math.sqrt(c["n_digits"] / chars),
        c["n_letters"] / size,
        math.sqrt(c["n_ends"] / words),
        distinct,
        math.log(max(1, c["n_distinct"])) / math.log(words + 1),
        1.0 if c["n_symbols"] else 0.0,
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([features(t) for t in texts])


def describe(docs: DataFrame) -> DataFrame:
    """Adds ``features``."""
    return docs.select(*without(docs, ["features"]), _features("text").alias("features"))


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per class: the products of (1, features) with themselves, flattened."""
    total = np.zeros((2, FEATURES + 1, FEATURES + 1))
    for batch in batches:
        x = np.column_stack([np.ones(len(batch)), np.array(batch["features"].tolist(), dtype=float).reshape(-1, FEATURES)])
        y = batch["quality"].to_numpy()
        for k in (0, 1):
            total[k] += x[y == k].T @ x[y == k]
    at = np.arange((FEATURES + 1) ** 2)
    for k in (0, 1):
        yield pd.DataFrame({"quality": k, "at": at, "value": total[k].ravel()})


@dataclass
class Discriminant:
    """``inverse[k]``: inverse of the Cholesky factor of class k's covariance."""

    counts: np.ndarray
    means: np.ndarray
    inverse: np.ndarray
    log_det: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.counts.min() < 2:
            return np.full(len(x), 0.5 if self.counts.max() < 2 else float(np.argmax(self.counts)))
        density = [
            -0.5 * np.sum(((x - self.means[k]) @ self.inverse[k].T) ** 2, axis=1) - 0.5 * self.log_det[k] + math.log(self.counts[k])
            for k in (0, 1)
        ]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def discriminant(products: np.ndarray, shrink: float = SHRINK) -> Discriminant:
    """The model from the two matrices of summed products."""
    counts = products[:, 0, 0]
    means, inverse, log_det = np.zeros((2, FEATURES)), np.zeros((2, FEATURES, FEATURES)), np.zeros(2)
    if counts.min() >= 2:
        scatter = []
        for k in (0, 1):
            means[k] = products[k, 0, 1:] / counts[k]
            scatter.append(products[k, 1:, 1:] / counts[k] - np.outer(means[k], means[k]))
        pooled = (counts[0] * scatter[0] + counts[1] * scatter[1]) / counts.sum()
        target = np.diag(np.diag(pooled)) + 1e-6 * np.eye(FEATURES)
        for k in (0, 1):
            factor = np.linalg.cholesky((1 - shrink) * scatter[k] + shrink * target)
            inverse[k] = np.linalg.inv(factor)
            log_det[k] = 2 * np.log(np.diag(factor)).sum()
    return Discriminant(counts, means, inverse, log_det)


def fit(described: DataFrame, labels: DataFrame, shrink: float = SHRINK) -> Discriminant:
    """Learn from every labelled row of ``described`` (doc_id, features)."""
    marked = labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality"))
    rows = described.select(F.col("doc_id").alias("_id"), "features").join(marked, "_id").select("features", "quality")
    sums = rows.mapInPandas(_sums, "quality int, at int, value double").groupBy("quality", "at").agg(F.sum("value").alias("value")).collect()
    products = np.zeros((2, (FEATURES + 1) ** 2))
    for r in sums:
        products[r["quality"], r["at"]] = r["value"]
    return discriminant(products.reshape(2, FEATURES + 1, FEATURES + 1), shrink)


def score(described: DataFrame, model: Discriminant, cut: float = CUT) -> DataFrame:
    """Adds ``score`` and ``predicted``; ``features`` go."""
    shared = described.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scored(rows: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.array(rows.tolist(), dtype=float).reshape(-1, FEATURES)))

    found = described.select(*without(described, ["features", "score", "predicted"]), scored("features").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; learns from rows that are not held out."""
    described = cut_lineage(describe(docs.select("doc_id", "text")).drop("text"))
    model = fit(described.filter(learnable(F.col("doc_id"), 5, 0)), labels)
    rows = score(described, model)
    return rows.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
