"""Token counts against a plain dynamic program for each pre-token."""

import math
import random

import public_tokenizers
import regex
from frames import AWKWARD, awkward_docs, empty_docs

from tallyloom.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def plain(token, logs):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(token)
    for end in range(1, len(token) + 1):
        for start in range(max(0, end - 130), end):
            log = logs.get(token[start:end])
            if log is not None:
                score, count = best[start][0] + log, best[start][1] + 1
                if score > best[end][0] or (score == best[end][0] and count < best[end][1]):
                    best[end] = score, count
    return best[-1][1]


def test_counts_match_a_plain_program():
    ranks = tc.load_ranks(PATH)
    logs = {k: -math.log(r + 1) for k, r in ranks.items()}
    trie = tc.Trie(ranks)
    rng = random.Random(5)
    tokens = ["", " the", "anthre", " èaux", "中文", "😀", "a" * 300] + ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 25))) for _ in range(300)]
    for token in tokens + tokens:
        assert trie.count(token.encode()) == plain(token.encode(), logs), token


def test_prefixes_are_shared_and_the_trie_is_bounded(monkeypatch):
    trie = tc.Trie(tc.load_ranks(PATH))
    trie.count(b"abcdef")
    nodes = len(trie.scores)
    trie.count(b"abcxyz")
    assert len(trie.scores) == nodes + 3
    monkeypatch.setattr(tc, "NODES", 20)
    want = trie.count(b"reset this one")
    for i in range(50):
        trie.count(b"word %d" % i)
    assert trie.count(b"reset this one") == want and len(trie.scores) < 60


def test_whole_tables(spark):
    docs = awkward_docs(spark).withColumnRenamed("size", "n_tokens")
    rows = tc.count_tokens(docs, PATH, public_tokenizers.PATTERN).collect()
    logs = {k: -math.log(r + 1) for k, r in tc.load_ranks(PATH).items()}
    split = regex.compile(public_tokenizers.PATTERN)
    assert len(rows) == docs.count()
    for r in rows:
        found = split.findall(r["text"] or "")
        assert r["n_pretokens"] == len(found)
        if len(found) < 1000:
            assert r["n_tokens"] == sum(plain(t.encode(), logs) for t in found)
    assert {r["n_tokens"] for r in rows if r["text"] in (None, "")} == {0}
    assert any(r["text"] == AWKWARD[12] and r["n_tokens"] >= 60_000 for r in rows)
    assert tc.count_tokens(empty_docs(spark), PATH, public_tokenizers.PATTERN).count() == 0
