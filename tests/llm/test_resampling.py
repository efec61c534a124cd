"""Importance resampling against plain Python: crc of windows, pieces of long texts, gains, draws."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from frames import LONG, awkward_docs, empty_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import resampling

_WORD = re.compile(resampling.WORD)


def plain_features(text):
    words = _WORD.findall((text or "").encode().lower().decode())
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def plain(docs, target):
    """(doc_id, n_words, n_features, weight, score, rank) of rows (doc_id, text)."""
    held = [(i, *plain_features(t)) for i, t in docs]
    own = Counter(bucket(f) for _, _, fs in held for f in fs)
    aim = Counter(bucket(f) for t in target for f in plain_features(t)[1])
    s_all, t_all = sum(own.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s_all + 10_000) / ((own[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    rows = []
    for i, n, fs in held:
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    for at, r in enumerate(able[: 5 * len(able) // 100]):
        r[5] = at + 1
    return Counter(map(tuple, rows))


@given(st.lists(st.text(max_size=40), max_size=6))
@settings(max_examples=60, deadline=None)
def test_buckets_of_windows(texts):
    sizes, found = resampling.Splitter().buckets([t.encode("utf-8", "replace") for t in texts] or [b""])
    for text, n, own in zip(texts or [""], sizes, found, strict=True):
        count, features = plain_features(text.encode("utf-8", "replace").decode())
        assert n == count and Counter(own.tolist()) == Counter(map(bucket, features))


def test_long_words_and_pieces(monkeypatch):
    text = "a" * 1000 + " " + "é" * 70 + " b " + "x" * 63 + " " + "y" * 64 + " " + "z" * 8200 + " " + LONG
    whole = resampling.Splitter().buckets([text.encode()])
    monkeypatch.setattr(resampling, "PIECE", 50)
    cut = resampling.Splitter().buckets([text.encode()])
    assert np.array_equal(whole[0], cut[0]) and np.array_equal(whole[1][0], cut[1][0])
    assert Counter(whole[1][0].tolist()) == Counter(map(bucket, plain_features(text)[1]))


def test_words_have_offsets():
    assert resampling.Splitter().words("ab, é1") == [("ab", (0, 2)), ("é1", (4, 7))]


def test_matches_plain_python(spark):
    rows = [(i, " ".join(f"w{(i * j) % 23} t{j % (i % 5 + 2)}" for j in range(i % 50))) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, rank string, weight string")
    target = ["w1 t1 w2 t0", "W3 t1 é", None]
    got = resampling.resample(docs.repartition(4), spark.createDataFrame([(t,) for t in target], "text string"))
    assert Counter(map(tuple, got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect())) == plain(rows, target)


@pytest.mark.parametrize("percent", [5, 60])
def test_awkward_ties_and_empty(spark, percent):
    docs = awkward_docs(spark).unionByName(awkward_docs(spark))
    none = spark.createDataFrame([], "text string")
    got = resampling.resample(docs, none, percent).collect()
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], [])
    assert Counter(tuple(r)[:5] for r in got) == Counter({k[:5]: 0 for k in want}) + Counter(tuple(k[:5]) for k, n in want.items() for _ in range(n))
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert ranks == list(range(1, percent * sum(r["n_words"] >= 20 for r in got) // 100 + 1))
    by_rank = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert all((a["score"], -(a["doc_id"] or 0)) >= (b["score"], -(b["doc_id"] or 0)) for a, b in zip(by_rank, by_rank[1:]))
    assert resampling.resample(empty_docs(spark), none).count() == 0
