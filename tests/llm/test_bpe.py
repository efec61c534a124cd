"""BPE against the tokenizers library, on awkward, random and real texts."""

import hashlib
import random

import public_tokenizers
import pytest
from frames import AWKWARD, awkward_docs, empty_docs
from tokenizers import Tokenizer

from tallyloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
POOL = "abc'stre \t\n\x1c\x1d\x1f\x85\xa0　​̧́ΣσςİßÀéÅﬁ½²٣१Ⅷ中文日😀<|>$_-.!\x00\x7f﻿­한각"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load(PATH))


def test_matches_the_library(library, encoder):
    rng = random.Random(1)
    texts = [t for t in AWKWARD if t] + ["".join(rng.choice(POOL) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    texts += ["<|endoftext|>", "a<|startoftext|><|endoftext|>b", "<|ENDOFTEXT|>", "I'LL we've", "x" * 5000]
    for text in texts:
        assert encoder.encode(text.encode()) == library.encode(text, add_special_tokens=False).ids, repr(text)[:200]


def test_recent_results_are_bounded_and_do_not_change(library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNKS", 8)
    small = bpe.Encoder(bpe.load(PATH))
    text = " ".join(f"word{i % 23} x{i % 5}" for i in range(300))
    assert small.encode(text.encode()) == library.encode(text, add_special_tokens=False).ids
    assert len(small.chunks) <= 4 and len(small.chunks.older) <= 4


def test_whole_tables(spark, library):
    docs = awkward_docs(spark).withColumnRenamed("size", "ids")
    rows = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(empty_docs(spark), PATH).count() == 0


def test_digests(spark, library):
    for r in bpe.with_digests(awkward_docs(spark), PATH).collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_decoding_skips_what_it_does_not_know(spark):
    rows = spark.createDataFrame([([320, None, 999_999],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(rows, PATH).collect()] == [bpe.load(PATH).strings[320], "", ""]


def test_slices_lose_no_row(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 8)
    texts = bpe.pa.array(["", None, "abc", "defgh", "i", "x" * 40, "", None, "yz"])
    pieces = list(bpe._slices(texts))
    assert len(pieces) > 2 and [t for piece in pieces for t in piece.to_pylist()] == texts.to_pylist()
    assert [p.to_pylist() for p in bpe._slices(texts.slice(0, 0))] == [[]]
