"""Language identification with bit-sliced Bloom filters of character trigrams.

A trigram belongs to a language when at least MIN_SHARE of the language's documents hold it and no other language holds
it more than RIVALRY times as often. Row r of the filter is a bit mask of the languages that set bit r; the AND of a
trigram's HASHES rows holds all languages that contain it. A document's popcount of each language over its trigrams is
corrected for the chance that an absent trigram passes the language's filter, and the largest corrected share decides.

Trigrams are taken from the lower-cased words (runs of letters), each between two spaces; three code points fit one
63-bit key, so keys are exact. Counts cover every learning document. A language keeps at most (mean distinct trigrams of
a document) / MIN_SHARE trigrams, so the filter's SLOTS rows are the only thing that reaches the driver or is sent out.

Defined cases: null text and text without letters are ``und`` with score 0; without learned languages everything is
``und``; a text without any known trigram gets the language with most learning documents, score 0; ties go to the
language that sorts first. Documents without lang or id are not learned from. Repeated rows count each.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import hand_back_memory, held_out, learnable, without

MIN_SHARE = 0.002
RIVALRY = 3.0
SLOTS = 1 << 18
HASHES = 3
#: Trigrams worked on at once, and entries after which a task hands its counts on.
PIECE = 1 << 20
FLUSH = 1 << 19

_WORD = re.compile(r"[^\W\d_]+")
#: Letters are what Unicode calls so; numerals that are no letters (fractions, Roman numerals, circled digits) are word characters to re.
_NUMERALS = {ord(c): " " for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isalnum() and not (c.isalpha() or c.isdecimal())}
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def letter_runs(text: str) -> list[str]:
    if not text.isascii() and not _NUMERALS.keys().isdisjoint(map(ord, set(text))):
        text = text.translate(_NUMERALS)
    return _WORD.findall(text)


def trigrams(text: str | None) -> Iterator[np.ndarray]:
    """Keys of all trigrams of a text in order, a bounded piece at a time."""
    words = letter_runs((text or "").lower())
    if not words:
        return
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), dtype="<u4")
    for start in range(0, len(codes) - 2, PIECE):
        part = codes[start : start + PIECE + 2].astype(np.uint64)
        yield (part[:-2] << np.uint64(42)) | (part[1:-1] << np.uint64(21)) | part[2:]


def slots(keys: np.ndarray, number: int) -> list[np.ndarray]:
    """HASHES row numbers for each key."""
    out = []
    for mix in _MIX[:HASHES]:
        mixed = keys * np.uint64(mix)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(_MIX[0])
        out.append(((mixed >> np.uint64(32)) % np.uint64(number)).astype(np.int64))
    return out


@dataclass
class Filter:
    """``masks[word, row]``: 64 languages a word. ``false_rate``: chance that an absent trigram passes, by language."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray
    common: str | None

    def popcounts(self, keys: np.ndarray) -> np.ndarray:
        rows = slots(keys, self.masks.shape[1])
        counts = np.zeros(len(self.languages), dtype=np.int64)
        for word, mask in enumerate(self.masks):
            hit = mask[rows[0]]
            for more in rows[1:]:
                hit &= mask[more]
            for at in range(word * 64, min(len(self.languages), word * 64 + 64)):
                counts[at] = np.count_nonzero(hit & np.uint64(1 << (at % 64)))
        return counts

    def predict(self, text: str | None) -> tuple[str, float]:
        counts, total = np.zeros(len(self.languages), dtype=np.int64), 0
        for keys in trigrams(text):
            counts += self.popcounts(keys)
            total += len(keys)
        if not total or not self.languages:
            return "und", 0.0
        corrected = np.maximum(0.0, (counts / total - self.false_rate) / (1 - self.false_rate))
        if corrected.sum() <= 0:
            return self.common or "und", 0.0
        best = int(np.argmax(corrected))
        return self.languages[best], float(corrected[best] / corrected.sum())


def _held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents that hold each trigram, by language; handed on whenever FLUSH entries have gathered."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def drain() -> Iterator[pd.DataFrame]:
        for lang, parts in held.items():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pd.DataFrame({"lang": lang, "gram": keys.astype(np.int64), "n": n.astype(np.int64)})
        held.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            own = [np.unique(keys) for keys in trigrams(text)]
            if own:
                own = np.unique(np.concatenate(own))
                held.setdefault(lang, []).append(own)
                size += len(own)
            if size >= FLUSH:
                yield from drain()
                size = 0
    yield from drain()
    hand_back_memory()


def fit(docs: DataFrame, number: int = SLOTS) -> Filter:
    """Learn from all rows of ``docs`` (text, lang) whose lang is known."""
    spark = docs.sparkSession
    rows = docs.filter(F.col("lang").isNotNull()).select("lang", "text")
    counts = rows.mapInPandas(_held, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    by_language = sorted((r["lang"], r["docs"]) for r in sizes.collect())
    languages = [lang for lang, _ in by_language]
    if not languages:
        return Filter([], np.zeros((1, number), np.uint64), np.zeros(0), None)
    known = spark.createDataFrame([(lang, i, n) for i, (lang, n) in enumerate(by_language)], "lang string, at int, docs long")
    shares = counts.join(F.broadcast(known), "lang").select("gram", "at", (F.col("n") / F.col("docs")).alias("share")).filter(F.col("share") >= MIN_SHARE)
    # one row per trigram with the few languages that hold it often enough
    grams = shares.groupBy("gram").agg(F.collect_list(F.struct("at", "share")).alias("in"), F.max("share").alias("top"))
    members = grams.select("gram", F.explode("in").alias("x"), "top").filter(F.col("x.share") * RIVALRY >= F.col("top")).select("gram", "x.at")

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = batch["at"].to_numpy()
            for row in slots(batch["gram"].to_numpy().astype(np.uint64), number):
                yield pd.DataFrame({"word": at // 64, "row": row, "bit": (np.uint64(1) << (at % 64).astype(np.uint64)).astype(np.int64)})

    sliced = members.mapInPandas(rows_of, "word int, row long, bit long").groupBy("word", "row").agg(F.bit_or("bit").alias("mask"))
    masks = np.zeros(((len(languages) + 63) // 64, number), dtype=np.uint64)
    found = sliced.toPandas()
    masks[found["word"].to_numpy(), found["row"].to_numpy()] = found["mask"].to_numpy().astype(np.int64).view(np.uint64)
    filled = np.array([np.count_nonzero(masks[i // 64] & np.uint64(1 << (i % 64))) / number for i in range(len(languages))])
    common = max(by_language, key=lambda x: x[1])[0]
    return Filter(languages, masks, filled**HASHES, common)


_RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(docs: DataFrame, model: Filter) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the language's share of all corrected popcounts)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(_RESULT)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])
        hand_back_memory()

    found = docs.withColumn("_found", predict("text"))
    return found.select(*without(found, ["lang_pred", "score", "_found"]), "_found.*")


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(learnable(F.col("doc_id"), 4, 2))


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    rows = identify(docs.select("doc_id", "text"), fit(learning_rows(docs)))
    return rows.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def keep(docs: DataFrame, least: float) -> DataFrame:
    """The documents in a known language with at least this score, with their own columns."""
    columns = docs.columns
    packed = docs.select(F.struct("*").alias("_doc"), "text")
    rows = identify(packed, fit(learning_rows(docs))).filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return rows.select(*[F.col("_doc")[c].alias(c) for c in columns])
