"""LM scores: base scores against a direct count, normalised probabilities, held-out gain, defined cases."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from frames import awkward_docs, empty_docs, rest

from tallyloom.llm import lm


def plain_tokens(data):
    return [*data.lower().split(), lm.END]


def direct(rows):
    """n_tokens, n_known and base score of each row, and the number of training tokens."""
    counts = Counter()
    for doc_id, text in rows:
        if rest(doc_id, 5) not in (1, None):
            counts.update(plain_tokens((text or "").encode()))
    n, v = sum(counts.values()), len(counts)
    norm = math.log10(n + 0.5 * (v + 1))
    out = []
    for doc_id, text in rows:
        tokens = plain_tokens((text or "").encode())
        out.append((doc_id, len(tokens), sum(counts[t] > 0 for t in tokens), sum(math.log10(counts[t] + 0.5) - norm for t in tokens)))
    return out, n


def compare(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, n = direct(rows)
    got = lm.score_documents(docs).collect()
    key = lambda x: (str(x[0]), x[1], x[2], round(x[3], 6))
    found = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got), key=key)
    for a, b in zip(found, sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9, abs=1e-9)
    assert {r["train_tokens"] for r in got} <= {n}
    return got


def corpus(spark, n):
    rng = random.Random(6)
    words = {0: [f"k{i}" for i in range(30)], 1: [f"zu{i}" for i in range(30)]}
    rows = [(i, " ".join(rng.choice(words[i % 2]) if rng.random() < 0.95 else f"rare{rng.randint(0, 10**6)}" for _ in range(40))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_base_scores_with_and_without_the_head(spark, monkeypatch):
    compare(corpus(spark, 120))
    monkeypatch.setattr(lm, "HEAD", 10)
    monkeypatch.setattr(lm, "FLUSH", 50)
    monkeypatch.setattr(lm, "PIECE", 100)
    compare(corpus(spark, 120))


def test_the_model_gains_on_held_out_texts(spark):
    rows = [r for r in lm.score_documents(corpus(spark, 3000)).collect() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in rows)
    assert len(rows) > 80
    assert sum(r["score"] for r in rows) / tokens > sum(r["base_score"] for r in rows) / tokens + 0.1


def test_probabilities_are_normalised(spark):
    model, counts = lm.fit(corpus(spark, 200))
    k = model.classes
    one, two = 3, model.own  # any two classes before
    total = sum(10 ** model.log10(np.array([two, one, c]), np.array([0]))[2] for c in range(k))
    assert total == pytest.approx(1, rel=1e-5)
    held = {bytes(r["token"]): r["n"] for r in counts.collect()}
    for tail in range(5):  # inside a tail class: all tokens seen and one place for the unseen
        members = [n for t, n in held.items() if model.head.get(t, model.own) >= model.own and lm.tail(t) == tail]
        inside = sum(n + 0.5 for n in members) + 0.5
        assert inside == pytest.approx(10 ** model.class_total[model.own + tail])


def test_training_steps_lower_the_loss(spark):
    model, _ = lm.fit(corpus(spark, 50))
    trainer = lm.Trainer(model)
    rng = np.random.default_rng(0)
    one, target = rng.integers(0, 5, 4000), None
    target = (one + 1) % 5  # the class before decides
    before = model.log10(np.array([0, 1, 2]), np.array([0]))[1:].sum()
    for _ in range(60):
        trainer.step(one, np.full(4000, model.classes), target)
    for name, weight in trainer.weights.items():
        setattr(model, name, weight)
    assert model.log10(np.array([0, 1, 2]), np.array([0]))[1:].sum() > before


def test_awkward_and_empty(spark):
    docs = awkward_docs(spark).withColumnRenamed("source", "h")
    got = compare(docs)
    assert len(got) == docs.count() and all(math.isfinite(r["score"]) for r in got)
    assert all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (0, 1, 2))
    assert lm.score_documents(empty_docs(spark)).count() == 0
    nothing_to_learn = docs.filter("doc_id IS NULL")
    assert all(r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in compare(nothing_to_learn))


def test_words_outside_the_classes_are_learned(spark, monkeypatch):
    monkeypatch.setattr(lm, "WORDS", 8)
    monkeypatch.setattr(lm, "GROUP", 16)
    rng = random.Random(8)
    pairs = [(f"a{i}xx", f"b{rng.randint(0, 9)}{i}yy") for i in range(60)]  # two endings: the class says nothing of the word
    rows = [(i, " ".join(" ".join(rng.choice(pairs)) for _ in range(30))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in lm.score_documents(docs).collect() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in got)
    # a token in 60 costs 1.78, a second word that its first one decides next to nothing
    assert sum(r["score"] for r in got) / tokens > -1.45


def test_words_inside_a_class_are_normalised(spark, monkeypatch):
    monkeypatch.setattr(lm, "WORDS", 8)
    monkeypatch.setattr(lm, "GROUP", 4)
    monkeypatch.setattr(lm, "HEAD", 50)
    model, counts = lm.fit(corpus(spark, 200))
    held = {bytes(r["token"]): r["n"] for r in counts.collect()}
    before = model.codes([b"k1", b"zu2"])
    for tail in {lm.tail(t) for t in list(model.head)[model.own :]}:
        total = 0.0
        for t, n in held.items():
            code = model.codes([t])[0]
            if lm.tail(t) == tail and not 0 <= code < model.own:
                inside = model.log10_inside(np.append(before, code), np.array([0]))[2]
                total += 10 ** inside * (n + 0.5 if code < 0 else 1)
        total += 10 ** model.log10_inside(np.append(before, -1 - tail), np.array([0]))[2] * 0.5
        assert total == pytest.approx(1, rel=1e-4)


def test_head_is_filled_where_all_counts_are_equal(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 50)
    docs = spark.createDataFrame([(i, " ".join(f"t{i}x{j:02d}" for j in range(30))) for i in range(10)], "doc_id long, text string")
    head = lm.head_of(lm.count_tokens(docs))
    words = sorted(f"t{i}x{j:02d}".encode() for i in range(10) for j in range(30))
    assert head[0] == (lm.END, 10) and [t for t, _ in head[1:]] == words[:49]


def test_words_are_split_as_bytes_are():
    rng = random.Random(5)
    texts = [None, "", " ", "A", " a\u00c4 b\u0085c\u00a0d ", "".join(map(chr, range(1, 0x300)))]
    texts += ["".join(rng.choice("aB \n\t\x0b\x0c\r\x1c\x1f\u0130") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    for rows in (texts, texts[3:], [None, None], []):
        words, bounds = lm.words_of(pa.array(rows, pa.string()))
        want = [(t or "").encode().lower().split() for t in rows]
        assert bounds.tolist() == [sum(map(len, want[:i])) for i in range(len(rows) + 1)]
        assert words.to_pylist() == [w for own in want for w in own]


def test_slices_hold_every_text_once(monkeypatch):
    monkeypatch.setattr(lm, "SLICE", 10)
    for rows in ([], [None], ["a" * 50, "b", None, "c" * 9, "", "d" * 30, "e"]):
        texts = pa.array(rows, pa.string())
        assert [t for part in lm.text_slices(texts) for t in texts[part].to_pylist()] == rows
