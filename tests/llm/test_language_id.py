"""Bloom filters: no false negatives, corrected popcounts, held-out accuracy, defined cases."""

import random

import numpy as np
from frames import awkward_docs, empty_docs, rest

from tallyloom.llm import language_id as lid

SYLLABLES = {"aa": "ka to mi re su".split(), "bb": "schl ung ver eit zu".split(), "cc": "eau oix ment que é".split()}


def docs_of(spark, n=400):
    rng = random.Random(2)
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4)))
    rows = [(i, " ".join(word(lang) for _ in range(30)), lang) for i in range(n) for lang in [rng.choice(list(SYLLABLES))]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_trigram_keys_are_exact():
    text = "Ab1cé 😀 中文"
    line = " ab cé 中文 "
    got = [int(k) for part in lid.trigrams(text) for k in part]
    assert got == [ord(line[i]) << 42 | ord(line[i + 1]) << 21 | ord(line[i + 2]) for i in range(len(line) - 2)]


def test_held_out_accuracy(spark):
    docs = docs_of(spark)
    want = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = lid.classify(docs).collect()
    assert all(r["held_out"] == (rest(r["doc_id"], 4) == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 50 and sum(r["lang_pred"] == want[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_predictions_only_use_the_text(spark):
    docs = docs_of(spark)
    other = docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 4 = 2, 'zz', lang) AS lang")
    assert sorted(map(tuple, lid.classify(docs).collect())) == sorted(map(tuple, lid.classify(other).collect()))


def test_every_member_is_found(spark):
    model = lid.fit(docs_of(spark), 1 << 12)
    for at, lang in enumerate(model.languages):
        text = " ".join(SYLLABLES[lang])
        keys = np.concatenate(list(lid.trigrams(text)))
        assert model.popcounts(keys)[at] >= 0.8 * len(keys)
    assert (model.false_rate < 0.05).all()


def test_more_than_64_languages(spark):
    rows = [(i, f"{chr(97 + i // 26)}{chr(97 + i % 26)}q{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5, f"l{i:03}") for i in range(70) for _ in range(3)]
    model = lid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.masks.shape[0] == 2
    assert sum(model.predict(text)[0] == lang for _, text, lang in rows) == len(rows)


def test_awkward_and_empty(spark):
    docs = awkward_docs(spark)
    rows = lid.classify(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (0, 1, 2, 11, 13))
    assert all(r["lang_pred"] == "en" for r in rows if r["doc_id"] in (4, 5, 14))
    assert lid.classify(empty_docs(spark)).count() == 0
    unknown = lid.classify(docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang")).collect()
    assert {r["lang_pred"] for r in unknown} == {"und"}
    assert lid.keep(docs, 0.0).columns == docs.columns


def test_numerals_are_no_letters():
    for text in ("½ ² ① Ⅷ", "12 ٣", "_ ."):
        assert list(lid.trigrams(text)) == []
    assert lid.letter_runs("x² é漢一 Ⅷa") == ["x", "é漢一", "a"]
