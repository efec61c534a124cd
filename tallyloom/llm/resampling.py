"""Importance resampling towards a target text, with hashed n-gram features.

Texts are lower-cased (A-Z) and split by an untrained Regex Split of the tokenizers library, which gives the words with
their offsets. Windows over 1 to WIDEST consecutive offset pairs are the features: their words joined by one space, hashed
by crc32 into BUCKETS. A window's crc is put together from those of its words and their lengths in bytes, so that windows are worked out in arrays.

The documents' buckets are written once; every task adds up a histogram over its documents, the histograms are added up by
bucket, and with the target's they give one gain a bucket. A document's weight is the sum of its features' gains; with
seeded Gumbel noise added the highest scores are a draw without replacement in proportion to exp(weight / 1000). Ranks
come from a range partitioning, no task holds them all.

Defined cases: null and empty texts have no words and no features, weight 0; documents of fewer than LEAST_WORDS words are
scored but not drawn; ties go to the smaller doc_id, null last (its noise is that of the empty id); equal rows are ranked
one after the other; without documents or target texts the sums are 0 and the gains still defined; bytes that are no UTF-8
count as the replacement character; extra columns do not matter.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import PreTokenizedString, Regex
from tokenizers.pre_tokenizers import Split

from tallyloom.llm.sharding import number_rows
from tallyloom.session import cut_lineage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDEST = 3
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Bytes of text split at once, and of texts whose windows are worked out together.
PIECE = 1 << 20

_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_DIRECT = 64


def _crc_steps() -> np.ndarray:
    """steps[k, b]: what byte k of a crc register turns into when one zero byte follows."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    steps = np.empty((4, 256), dtype=np.uint32)
    for k in range(4):
        register = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        steps[k] = (register >> np.uint32(8)) ^ table[register & np.uint32(255)]
    return steps


def _follow(crc: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return steps[0][crc & 255] ^ steps[1][(crc >> 8) & 255] ^ steps[2][(crc >> 16) & 255] ^ steps[3][crc >> 24]


class Crc:
    """crc32 of two strings from theirs: the first moved on by the length of the second, and the second."""

    def __init__(self):
        one = _crc_steps()
        zero = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        held = [zero]
        for _ in range(_DIRECT - 1):
            held.append(_follow(held[-1], one))
        self.direct = np.stack(held).reshape(-1)  # by length under _DIRECT, byte, value
        self.doubled = [_follow(held[-1], one)]  # of _DIRECT * 2^j zero bytes
        self.space = np.uint32(zlib.crc32(b" "))

    def moved(self, crc: np.ndarray, by: np.ndarray) -> np.ndarray:
        at = (by % _DIRECT) * 1024
        crc = self.direct[at + (crc & 255)] ^ self.direct[at + 256 + ((crc >> 8) & 255)] ^ self.direct[at + 512 + ((crc >> 16) & 255)] ^ self.direct[at + 768 + (crc >> 24)]
        rest, j = by // _DIRECT, 0
        while rest.any():
            if j == len(self.doubled):
                self.doubled.append(_follow(self.doubled[-1], self.doubled[-1]))
            odd = np.nonzero(rest & 1)[0]
            crc[odd] = _follow(crc[odd], self.doubled[j])
            rest, j = rest >> 1, j + 1
        return crc

    def joined(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.moved(first, length) ^ second

    def spaced(self, crc: np.ndarray) -> np.ndarray:
        return _follow(crc, self.direct[1024:2048].reshape(4, 256)) ^ self.space


class Splitter:
    """Words of texts as crc32 and length in bytes."""

    def __init__(self):
        self.split = Split(Regex(WORD), behavior="removed", invert=True)
        self.crc = Crc()

    def words(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        """The words with their offsets in bytes."""
        held = PreTokenizedString(text)
        self.split.pre_tokenize(held)
        return [(word, at) for word, at, _ in held.get_splits(offset_referential="original", offset_type="byte")]

    def pieces(self, data: bytes) -> Iterator[str]:
        """The text in pieces that end where no word does go on."""
        at = 0
        while at < len(data):
            found = _BREAK.search(data, at + PIECE) if len(data) - at > PIECE else None
            end = found.start() if found else len(data)
            yield data[at:end].decode("utf-8", "replace")
            at = end

    def codes(self, data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        crcs: list[np.ndarray] = [np.zeros(0, np.uint32)]
        lengths: list[np.ndarray] = [np.zeros(0, np.int64)]
        for piece in self.pieces((data or b"").lower()):
            found = self.words(piece)
            crcs.append(np.array([zlib.crc32(word.encode()) for word, _ in found], dtype=np.uint32))
            lengths.append(np.array([end - start for _, (start, end) in found], dtype=np.int64))
        return np.concatenate(crcs), np.concatenate(lengths)

    def buckets(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Words of each text, and the buckets of its windows, those of each width in order."""
        parts = [self.codes(data) for data in texts]
        sizes = np.array([len(lengths) for _, lengths in parts], dtype=np.int64)
        word, length = (np.concatenate(x) for x in zip(*parts, strict=True))
        ends = np.repeat(np.cumsum(sizes), sizes)  # of the own text
        at = np.arange(len(word))
        found, owners = [], []
        window = word
        text_of = np.repeat(np.arange(len(texts)), sizes)
        for width in range(1, WIDEST + 1):
            if width > 1:
                window = self.crc.joined(self.crc.spaced(window[:-1]), word[width - 1 :], length[width - 1 :])
            whole = at[: len(window)] + width <= ends[: len(window)]
            found.append((window[whole] % np.uint32(BUCKETS)).astype(np.uint16))
            owners.append(text_of[: len(window)][whole])
            if not len(window):
                break
        order = np.argsort(np.concatenate(owners), kind="stable")
        held = np.concatenate(found)[order]
        cuts = np.cumsum(np.bincount(np.concatenate(owners), minlength=len(texts)))
        return sizes, np.split(held, cuts[:-1])


_SPLITTERS: list[Splitter] = []


def _splitter() -> Splitter:
    """The splitter a worker keeps; its tables are of fixed size."""
    if not _SPLITTERS:
        _SPLITTERS.append(Splitter())
    return _SPLITTERS[0]


def _groups(texts: list[bytes | None]) -> Iterator[slice]:
    """Texts of about PIECE bytes together."""
    start, size = 0, 0
    for at, data in enumerate(texts):
        if at > start and size + len(data or b"") > PIECE:
            yield slice(start, at)
            start, size = at, 0
        size += len(data or b"")
    if texts:
        yield slice(start, len(texts))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    splitter = _splitter()
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for group in _groups(texts):
            sizes, buckets = splitter.buckets(texts[group])
            ids = batch.column("doc_id").slice(group.start, group.stop - group.start)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array([len(b) for b in buckets], pa.int64()), pa.array([b.tobytes() for b in buckets], pa.binary())], ["doc_id", "n_words", "n_features", "buckets"])


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features and buckets (two bytes a feature) of every row, written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut_lineage(rows.mapInArrow(_featured, "doc_id long, n_words long, n_features long, buckets binary"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for held in batch.column("buckets"):
            total += np.bincount(np.frombuffer(held.as_buffer(), dtype=np.uint16), minlength=BUCKETS)
    met = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])


def histogram(featured: DataFrame) -> list[int]:
    """Features in each bucket."""
    out = [0] * BUCKETS
    for r in featured.select("buckets").mapInArrow(_counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(own: list[int], target: list[int]) -> np.ndarray:
    """A thousand times the log of each bucket's smoothed share in the target over that in the documents, rounded down."""
    s_all, t_all = float(sum(own) + BUCKETS), float(sum(target) + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(own, target, strict=True)], dtype=np.int64)


def weigh(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight: the sum of the features' gains."""
    shared = featured.sparkSession.sparkContext.broadcast(gain)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [int(shared.value[np.frombuffer(b.as_buffer(), dtype=np.uint16)].sum()) for b in batch.column("buckets")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return featured.mapInArrow(weighed, "doc_id long, n_words long, n_features long, weight long")


def scored(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds ``score``: the weight plus a thousand times seeded Gumbel noise, rounded down."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def draw(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds ``rank`` from 1 to the drawn rows (doc_id, n_words, score), null to all others."""
    n = rows.filter(F.col("n_words") >= least_words).count()
    keyed = rows.withColumns({"_short": F.col("n_words") < least_words, "_falling": -F.col("score"), "_null": F.col("doc_id").isNull()})
    numbered = number_rows(keyed, ["_short", "_falling", "_null", "doc_id"], "_row")
    return numbered.withColumn("rank", F.when(F.col("_row") < percent * n // 100, F.col("_row") + 1)).drop("_short", "_falling", "_null", "_row", "_n")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``; ``target`` has a text column."""
    own = features(docs)
    aim = features(target.select(F.lit(None).alias("doc_id"), "text"))
    weighed = weigh(own, gains(histogram(own), histogram(aim)))
    return draw(cut_lineage(scored(weighed, seed)), percent, least_words)
