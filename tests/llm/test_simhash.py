"""Covering masks, fingerprints against xxhash, components against brute force."""

import random

import pytest
from frames import AWKWARD, awkward_docs, empty_docs
from xxhash import xxh64_intdigest

from tallyloom.llm import simhash
from tallyloom.llm.components import components


def direct(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return simhash.signed(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))


def roots(values, radius=2):
    """Smallest value of each component, by comparing all pairs."""
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= radius:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {v: find(v) for v in values}


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(i, 64):
            assert any(not m & (1 << i | 1 << j) for m in masks)


def test_fingerprints():
    rng = random.Random(4)
    texts = [t for t in AWKWARD if t is None or len(t) < 5000] + [" ".join(rng.choice("Ab cd É zz".split()) for _ in range(rng.randint(1, 40))) for _ in range(50)]
    for text in texts:
        assert simhash.fingerprint((text or "").encode()) == direct(text), repr(text)


def test_long_texts_are_worked_on_in_pieces(monkeypatch):
    text = " ".join(f"w{i}" for i in range(100))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text.encode()) == whole == direct(text)


@pytest.mark.parametrize("bucket", [1, 4, 32])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(9)
    values = set()
    for _ in range(12):
        value = rng.getrandbits(64)
        for _ in range(12):  # a walk of small steps, some beyond the radius
            values.add(simhash.signed(value))
            for _ in range(rng.randint(1, 3)):
                value ^= 1 << rng.randrange(64)
    links = simhash.near_links(spark.createDataFrame([(v,) for v in values], "f long"))
    found = {r["node"]: r["root"] for r in components(links).collect()}
    want = roots(values)
    assert {v: found.get(v, v) for v in values} == want
    assert all(bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 2 for r in links.collect()) or bucket < 32


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (1001, 1000), (None, 3)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_and_empty(spark):
    docs = awkward_docs(spark).withColumnRenamed("size", "fingerprint")
    rows = simhash.group(docs).collect()
    texts = [(r["doc_id"], direct(r["text"])) for r in docs.collect()]
    assert sorted(((r["doc_id"], r["fingerprint"]) for r in rows), key=str) == sorted(texts, key=str)
    root = roots({f for _, f in texts})
    least = {}
    for doc_id, f in texts:
        if doc_id is not None:
            least[root[f]] = min(doc_id, least.get(root[f], doc_id))
    assert all(r["component_id"] == least.get(root[r["fingerprint"]]) for r in rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root.values()))
    assert simhash.group(empty_docs(spark)).count() == 0 and simhash.keep_one(empty_docs(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(i, f"text number {i // 10} of some length and more words", "x") for i in range(100)] + [(None, "text number 3 of some length and more words", "x")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, root string")).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(0, 100, 10))
