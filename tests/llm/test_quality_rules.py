"""Base counts against a direct reading of the contract; cutoffs against an exact binomial by fractions."""

import random
import re
from fractions import Fraction
from math import comb

import pytest
from frames import AWKWARD, awkward_docs, empty_docs

from tallyloom.llm import quality_rules as q
from tallyloom.llm.stats import text_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def direct(text):
    words = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": sum(line in lines[:i] for i, line in enumerate(lines)), "n_repeat_words": len(covered),
    }


def test_counts_match_the_contract():
    rng = random.Random(3)
    texts = [t for t in AWKWARD if t is None or len(t) < 5000]
    texts += ["".join(rng.choice("ab \n#é\x85 ") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [" ".join(rng.choice("abc") for _ in range(40)) for _ in range(50)]
    for text in texts:
        got = text_counts(text)
        assert {k: got[k] for k in direct(text)} == direct(text), repr(text)


@pytest.mark.parametrize(("k", "n", "p"), [(0, 100, 0.02), (3, 400, 0.02), (7, 400, 0.02), (1, 10, 0.5)])
def test_binomial_tail_is_exact(k, n, p):
    share = Fraction(p)
    exact = sum(comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1))
    assert q.tail(k, n, p) == pytest.approx(float(exact), rel=1e-9)


def test_cutoffs_keep_the_promise():
    good, bad = [0] * 51, [0] * 51
    good[0], bad[20], good[30] = 5000, 400, 1
    at = q.choose(good, bad, 0.01, 0.001)
    assert at is not None and 0 < at <= 20 and sum(good[at:]) <= 1
    assert q.choose([100] + [0] * 50, bad, 0.01, 0.001) is None  # too few good documents to certify anything
    good[25] = 500
    assert q.choose(good, bad, 0.01, 0.001) is None  # every cutoff that helps loses too many


def test_junk_goes_and_clean_documents_stay(spark):
    rng = random.Random(1)
    clean = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 9999)) for _ in range(60))
    rows = [(i, clean(), "en") for i in range(3000)] + [(3000 + i, clean().replace(" ", " ### "), "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 3000), 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in q.assess(docs, labels).collect()}
    assert sum(not kept[i] for i in range(3000)) <= 60 and not any(kept[i] for i in range(3000, 3300))
    assert {r["doc_id"] for r in q.keep(docs, labels).collect()} == {i for i, k in kept.items() if k}


def test_awkward_and_empty(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    docs = awkward_docs(spark).withColumnRenamed("size", "n_words")
    rows = q.assess(docs, labels).collect()
    assert len(rows) == docs.count()
    assert q.keep(docs, labels).columns == docs.columns
    assert q.assess(empty_docs(spark), labels).count() == 0
    assert q.assess(docs, labels.limit(0)).filter("kept = base_failed").count() == 0
