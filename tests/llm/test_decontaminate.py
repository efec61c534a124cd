"""Phrase matches against a direct reading of the contract, with and without the broadcast path; proximity matches."""

import random
import re

import pytest
from frames import awkward_docs, empty_docs

from tallyloom.llm import common, decontaminate

WORD = re.compile(decontaminate.WORD)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def direct(docs, items, window=13):
    """(doc_id, n_words, n_hit, sorted item ids, contaminated) of each document."""
    windows = {}
    for item_id, text in items:
        own = words(text)
        size = min(window, len(own))
        for s in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[s : s + size]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        own, hit, ids = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for s in range(len(own) - size + 1):
                if found := windows.get(tuple(own[s : s + size])):
                    hit |= set(range(s, s + size))
                    ids |= found
        out.append((doc_id, len(own), len(hit), sorted(str(i) for i in ids if i is not None), len(hit) > 0 and 20 * len(hit) >= len(own)))
    return out


def found(spark, docs, items):
    frame = docs if not isinstance(docs, list) else spark.createDataFrame(docs, "doc_id long, text string")
    rows = decontaminate.report(frame, spark.createDataFrame(items, ITEMS)).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in rows), key=str)


@pytest.mark.parametrize("limit", [common.BROADCAST_ROWS, 0])
def test_random_texts(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    rng = random.Random(limit)
    vocabulary = "the of and a to rare1 Rare2 é1 x-y z".split()
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 12, 13, 14, 30]))) for i in range(12)] + [(0, "the of"), (0, "the of"), (None, text(14)), (50, None), (51, "!?")]
    docs = []
    for i in range(60):
        body = text(rng.randint(0, 60)).split()
        if i % 2:  # a passage, whole or cut at either end of the text
            own = (rng.choice(items)[1] or "").upper().split()
            cut = rng.randint(0, max(0, len(own) - 13))
            at = rng.choice([0, len(body) // 2, len(body)])
            body[at:at] = own[cut:] if i % 4 == 1 else own[: len(own) - cut]
        docs.append((i % 55, " ".join(body)))
    assert found(spark, docs, items) == sorted(direct(docs, items), key=str)


def test_self_overlapping_windows(spark):
    items = [(1, "a b " * 10), (2, "c " * 20)]
    docs = [(1, "x " + "a b " * 12 + "y"), (2, "c " * 15), (3, "c " * 12), (4, "b a " * 7)]
    assert found(spark, docs, items) == sorted(direct(docs, items), key=str)


def test_awkward_and_empty(spark):
    docs = awkward_docs(spark).withColumnsRenamed({"size": "items", "score": "h"})
    items = [(1, "one"), (2, "HELLO world"), (3, "quick brown fox jumps over the lazy dog and runs far away from it"), (4, "word1 and word2 and word3 and word4 and word5 and word6 and word7 and")]
    want = direct([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    assert found(spark, docs, items) == sorted(want, key=str)
    bad = {w[0] for w in want if w[4]}
    kept = decontaminate.keep(docs, spark.createDataFrame(items, ITEMS))
    assert kept.columns == docs.columns and kept.count() == sum(not w[4] for w in want) and bad
    assert found(spark, empty_docs(spark), items) == []
    assert all(r[2] == 0 for r in found(spark, docs, []))


def test_proximity(spark):
    docs = [(1, "big red x x dog"), (2, "dog big red"), (3, "big x x x x x red dog"), (4, "red dog"), (5, "big " * 20 + "red x dog")]
    phrases = spark.createDataFrame([(1, "big red dog")], ITEMS)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    near = lambda slop: {r["doc_id"] for r in decontaminate.proximity_matches(frame, phrases, slop).collect()}
    brute = lambda slop: {
        d for d, t in docs if any({"big", "red", "dog"} <= set(words(t)[s : s + 3 + slop]) for s in range(len(words(t))))
    }
    for slop in range(6):
        assert near(slop) == brute(slop), slop
