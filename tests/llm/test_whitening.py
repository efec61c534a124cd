"""Whitening against numpy: projections, exact deviations, left-out rows, tables without directions."""

import numpy as np
import pytest

from tallyloom.llm import whitening

SCHEMA = "vec_id long, vector array<float>, n string, whitened string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)


def direct(vectors, components=whitening.COMPONENTS):
    """n, deviations, projections up to their sign, and shares, of float32 vectors."""
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    order = [i for i in order if values[i] > 1e-12 * values.sum()]
    deviations = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total)) for row in x]
    return n, deviations, centred @ directions[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def table_of(rows, ids):
    at = {v: k for k, v in enumerate(ids)}
    width = max(r["component"] for r in rows)
    out = np.full((len(ids), width), np.nan)
    for r in rows:
        out[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
    return out


@pytest.mark.parametrize("dims, n, block", [(3, 40, 7), (40, 300, 64), (5, 64, 64)])
def test_matches_numpy(spark, monkeypatch, dims, n, block):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    rng = np.random.default_rng(dims)
    vectors = (rng.normal(size=(n, dims)) * rng.uniform(1, 9, dims) + rng.normal(size=dims)).astype(np.float32).tolist()
    rows = whitening.whiten(frame(spark, enumerate(vectors)).repartition(3)).collect()
    size, deviations, want, shares = direct(vectors)
    got = table_of(rows, range(n))
    signs = np.sign((got * want).sum(axis=0))
    assert np.allclose(got, want * signs, atol=1e-9)
    assert {r["vec_id"]: r["deviation"] for r in rows} == dict(enumerate(deviations)) and {r["n"] for r in rows} == {size}
    assert all(abs(r["explained"] - shares[r["component"] - 1]) < 1e-9 for r in rows)
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-8


def test_columns_of_blocks(spark, monkeypatch):
    """More dimensions than a block has columns."""
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 4)
    vectors = np.random.default_rng(1).normal(size=(50, 10)).astype(np.float32).tolist()
    rows = whitening.whiten(frame(spark, enumerate(vectors))).collect()
    _, _, want, _ = direct(vectors)
    got = table_of(rows, range(50))
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-9)


def test_left_out_rows(spark):
    good = [(i, [float(i), float(i * i % 7), 1.5]) for i in range(20)] + [(None, [3.0, 1.0, 1.5]), (5, [5.0, 4.0, 1.5])]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 1.0, 2.0]), (104, [1.0]), (105, []), (106, [1e30, 0.0, 0.0])]
    rows = whitening.whiten(frame(spark, good + bad)).collect()
    assert {r["vec_id"] for r in rows} == {i for i, _ in good} and {r["n"] for r in rows} == {22}
    assert {r["component"] for r in rows} == {1, 2}  # the third dimension is constant
    assert sum(r["vec_id"] == 5 for r in rows) == 4  # repeated ids give rows each


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whiten(frame(spark, rows)).collect() == []


def test_deviations_beyond_a_long():
    stats = whitening.Moments(3, [3 * (1 << 40), 0])
    x = np.array([[1 << 40, 0], [(1 << 40) + (1 << 33), 1]])
    assert stats.deviations(x) == [0, None]
    assert whitening.Moments(3, [7, 8]).deviations(np.array([[1, 2], [4, 3]])) == [(3 - 7) ** 2 + (6 - 8) ** 2, (12 - 7) ** 2 + (9 - 8) ** 2]
