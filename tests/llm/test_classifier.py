"""Quadratic discriminant: densities against numpy's own, held-out accuracy, defined cases."""

import random

import numpy as np
import pytest
from frames import awkward_docs, empty_docs, rest

from tallyloom.llm import quality_classifier as qc

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, n=600):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(words) + "." if i % 4 else "!! ".join(w.upper() + "###" for w in words[:10]) * 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, n, 2)] + [(n + 5, 1, 0), (1, None, 0), (3, 7, 0)], LABELS)


def test_scores_are_log_density_differences():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(400, qc.FEATURES)), np.arange(400) % 3 > 0
    x[y] += 0.5
    one = np.column_stack([np.ones(400), x])
    model = qc.discriminant(np.array([one[~y].T @ one[~y], one[y].T @ one[y]]), 0.2)
    pooled = sum(np.cov(x[y == k].T, bias=True) * (y == k).sum() for k in (0, 1)) / 400
    logs = []
    for k in (0, 1):
        own = x[y == k]
        cov = 0.8 * np.cov(own.T, bias=True) + 0.2 * (np.diag(np.diag(pooled)) + 1e-6 * np.eye(qc.FEATURES))
        diff = x - own.mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(own)))
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])), rel=1e-6, abs=1e-12)


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    rows = qc.classify(docs, labels).collect()
    assert all(r["held_out"] == (rest(r["doc_id"], 5) == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 80 and sum(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held) >= 0.97 * len(held)


def test_only_rows_that_are_not_held_out_teach(spark):
    docs, labels = corpus(spark, 200)
    other = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) AS quality", "toxic")
    a = sorted((r["doc_id"], r["score"]) for r in qc.classify(docs, labels).collect())
    b = sorted((r["doc_id"], r["score"]) for r in qc.classify(docs, other).collect())
    assert [x for x, _ in a] == [x for x, _ in b] and [s for _, s in a] == pytest.approx([s for _, s in b], abs=1e-9)


def test_awkward_and_empty(spark):
    docs = awkward_docs(spark).withColumnRenamed("size", "features")
    _, labels = corpus(spark, 40)
    rows = qc.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in qc.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in qc.classify(docs, labels.filter("quality = 1")).collect()} == {1.0}
    assert qc.classify(empty_docs(spark), labels).count() == 0
