"""Mixing: water level against a plain loop, words taken near targets, reruns, awkward tables."""

from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from frames import awkward_docs, empty_docs

from tallyloom.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), epochs=2):
    """Clamp, give the excess to the others by weight, again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        level = (total - sum(epochs * sizes[s] for s in full)) / max(1, sum(weight[s] for s in names if s not in full))
        over = {s for s in names if s not in full and weight[s] * level > epochs * sizes[s]}
        if not over:
            return {s: Fraction(epochs * sizes[s]) if s in full else weight[s] * level for s in names}
        full |= over


def docs_of(spark, rows):
    return spark.createDataFrame([(i, s, t, "x", "y") for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string, taken string, size string")


def size_of(text):
    return len((text or "").encode().split())


CASES = [
    [("a", "w " * (i % 9)) for i in range(60)] + [("b", "w " * 2)] + [("\U00010000", "x y z")] * 5 + [("￿", "x")] * 9 + [(None, "one two")] * 4,
    [("a", None), ("b", ""), ("c", "w")],
    [("a", "w w w")],
    [(f"s{i:03d}", "w " * (i * i % 37)) for i in range(120)],
    [("hot", "w " * (1 + i % 5)) for i in range(400)] + [(f"s{i}", "w " * i) for i in range(20)],
]


@pytest.mark.parametrize("rows", CASES)
def test_targets_and_taken(spark, rows):
    docs = docs_of(spark, rows)
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for s, t in rows:
        sizes[s] += size_of(t)
    want = plain_targets(dict(sizes))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size_of(t)) for i, (_, t) in enumerate(rows))
    taken = defaultdict(int)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - float(want[r["source"]])) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
    for s, n in taken.items():
        longest = max(size_of(t) for o, t in rows if o == s)
        assert n <= want[s] + 1e-6 and want[s] - n <= longest


def test_gaps_are_filled_by_shorter_documents(spark):
    docs = docs_of(spark, [("a", "w " * n) for n in [5000] * 3 + [900, 400, 130, 60, 30, 14, 6, 3, 2, 1, 1, 1]] + [("b", "w " * 16000)])
    got = [r for r in mixing.mix(docs).collect() if r["source"] == "a"]
    assert abs(sum(r["taken"] for r in got) - got[0]["target"]) < 40


def test_reruns_agree_whatever_the_partitions(spark):
    rows = CASES[4]
    first = Counter(mixing.mix(docs_of(spark, rows).repartition(5)).select("doc_id", "taken").collect())
    assert first == Counter(mixing.mix(docs_of(spark, rows).coalesce(1)).select("doc_id", "taken").collect())
    other = Counter(mixing.mix(docs_of(spark, rows), seed=1).select("doc_id", "taken").collect())
    assert other != first


def test_repetitions_hold_the_texts(spark):
    mixed = mixing.mix(docs_of(spark, CASES[4]), keep_text=True)
    want = Counter()
    for r in mixed.collect():
        want[r["doc_id"]] += r["copies"]
    got = mixing.repeat(mixed).collect()
    assert Counter(r["doc_id"] for r in got) == +want and all(size_of(r["text"]) == r["size"] for r in got)


def test_awkward_and_empty(spark):
    docs = awkward_docs(spark)
    got = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r["doc_id"], size_of(r["text"])) for r in docs.collect())
    assert mixing.mix(empty_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, weights=(1, 0))
