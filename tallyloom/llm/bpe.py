"""Byte-pair encoding and decoding with a given tokenizer file.

Encoding: special strings are cut out first; the rest is NFC-normalised, put in lower case and split by the pattern; each
pre-token's bytes become symbols (the last one with the word-end suffix), linked forwards and backwards. A heap of (merge
rank, position) is popped until empty; an entry whose two symbols have changed since is stale and skipped; a merge relinks
its neighbours and pushes the two new pairs. Decoding joins the vocabulary strings of the ids with a space, as a file
without a decoder asks for.

Pre-tokens never span ASCII white space, so the chunks between such spaces are encoded on their own and the ids of
recent chunks and pre-tokens are kept, at most CHUNKS and TOKENS of them. The vocabulary and merges are read once and sent out; their size is fixed. Workers keep an encoder by path between tasks, without the
ids it has gathered.

Defined cases: null text counts as empty and has no ids; decoding null or unknown ids skips them; symbols that the
vocabulary lacks are dropped; extra columns pass through, one named like a new column is replaced; equal rows give equal
results.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import Recent, hand_back_memory, without

CHUNKS = 60_000
TOKENS = 90_000
#: Bytes of text worked on and handed back at a time; a longer text goes alone.
SLICE = 1 << 19


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 256
    for byte in range(256):
        out.append(chr(byte) if byte in plain else chr(free))
        free += byte not in plain
    return out


@dataclass
class Vocabulary:
    """What encoding needs of a tokenizer file."""

    ids: dict[str, int]
    ranks: dict[int, int]  # by left id * width + right id
    merged: list[int]  # id made by the merge of each rank
    width: int
    special: dict[str, int]
    pattern: str
    suffix: str
    strings: dict[int, str] = field(default_factory=dict)


def load(path: str) -> Vocabulary:
    """Read a file of this kind: NFC and lower case, one split pattern, bytes, word ends, no decoder."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, steps = spec["model"], [n["type"] for n in spec["normalizer"]["normalizers"]]
    if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
        raise ValueError("not a lower-casing word BPE file")
    split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    ids = model["vocab"]
    pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
    width = max(ids.values()) + 1
    ranks = {ids[left] * width + ids[right]: rank for rank, (left, right) in enumerate(pairs)}
    merged = [ids[left + right] for left, right in pairs]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    strings = {i: s for s, i in ids.items()} | {i: s for s, i in special.items()}
    return Vocabulary(ids, ranks, merged, width, special, split, model["end_of_word_suffix"] or "", strings)


#: Symbol of a place that is gone or beyond either end; no merge has it.
GONE = -(1 << 60)


def merge(symbols: list[int], v: Vocabulary) -> list[int]:
    """Apply merges in order of rank, then position. A heap entry is rank * length + position."""
    n, width, merged, rank_of = len(symbols), v.width, v.merged, v.ranks.get
    heap = [rank * n + at for at, (x, y) in enumerate(pairwise(symbols)) if (rank := rank_of(x * width + y)) is not None]
    if not heap:
        return symbols
    heapify(heap)
    symbols = [*symbols, GONE]
    before, after = list(range(-1, n)), list(range(1, n + 2))
    while heap:
        rank, at = divmod(heappop(heap), n)
        right = after[at]
        if rank_of(symbols[at] * width + symbols[right]) != rank:
            continue  # stale: a symbol has changed, or is gone
        symbols[at] = symbol = merged[rank]
        symbols[right] = GONE
        after[at] = right = after[right]
        before[right] = at
        if (rank := rank_of(symbol * width + symbols[right])) is not None:
            heappush(heap, rank * n + at)
        left = before[at]
        if (rank := rank_of(symbols[left] * width + symbol)) is not None:
            heappush(heap, rank * n + left)
    return [s for s in symbols if s >= 0]


class Encoder:
    """Encodes texts; keeps the ids of recent chunks and of recent pre-tokens, packed as 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary = vocabulary
        self.chunks, self.tokens = Recent(self._chunk, CHUNKS), Recent(self._token, TOKENS)
        names = "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))
        self.special = regex.compile(f"({names})") if names else None
        # white space is what Unicode calls so; the separators 0x1C to 0x1F are not
        self.split = regex.compile(vocabulary.pattern.replace("^\\s", "^\\t-\\r \\x85\\p{Z}"))
        known = vocabulary.ids
        self.inner = [known.get(s, -1) for s in byte_symbols()]
        self.last = [known.get(s + vocabulary.suffix, -1) for s in byte_symbols()]

    def forget(self) -> None:
        self.chunks.forget()
        self.tokens.forget()

    def _chunk(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters are one pre-token
            return self.tokens[chunk.lower()]
        text = chunk.decode()
        if self.special is None or self.special.search(text) is None:
            return self._plain(text)
        parts = enumerate(self.special.split(text))
        return b"".join(_pack([self.vocabulary.special[part]]) if k % 2 else self._plain(part) for k, part in parts)

    def _plain(self, text: str) -> bytes:
        text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return b"".join([self.tokens[token.encode()] for token in self.split.findall(text)])

    def _token(self, token: bytes) -> bytes:
        symbols = [self.inner[b] for b in token]
        symbols[-1] = self.last[token[-1]]
        if -1 in symbols:
            symbols = [s for s in symbols if s >= 0]
        return _pack(merge(symbols, self.vocabulary))

    def packed(self, data: bytes) -> bytes:
        return b"".join(map(self.chunks.__getitem__, data.split()))

    def encode(self, data: bytes) -> list[int]:
        return np.frombuffer(self.packed(data), dtype=np.int32).tolist()


def _pack(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str, vocabulary: Vocabulary) -> Encoder:
    """The encoder a worker keeps from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(vocabulary)
    return _ENCODERS[path]


def _encoded(encoder: Encoder, texts: pa.Array) -> pa.Array:
    parts = [encoder.packed(data or b"") for data in texts.cast(pa.binary()).to_pylist()]
    ends = np.cumsum([0, *map(len, parts)]) // 4
    return pa.ListArray.from_arrays(ends.astype(np.int32), np.frombuffer(b"".join(parts), dtype=np.int32))


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The array in pieces of about SLICE bytes of text."""
    start, size = 0, 0
    for at, length in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if at > start and size + length > SLICE:
            yield texts.slice(start, at - start)
            start, size = at, 0
        size += length
    yield texts.slice(start)


def _table(vocabulary: Vocabulary) -> np.ndarray:
    """Strings by id; the last place, none, is for unknown ids."""
    return np.array([vocabulary.strings.get(i) for i in range(max(vocabulary.strings) + 1)] + [None], dtype=object)


def _decoded(table: np.ndarray, lists: pa.Array) -> pa.Array:
    ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    at, out = 0, []
    for length in pc.list_value_length(lists).fill_null(0).to_pylist():
        own = ids[at : at + length]
        at += length
        if length and (own.min() < 0 or own.max() >= len(table)):
            own = np.where((own >= 0) & (own < len(table)), own, len(table) - 1)
        strings = table[own].tolist()
        out.append(" ".join(strings) if None not in strings else " ".join(s for s in strings if s is not None))
    return pa.array(out, pa.string())


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of the whole text as an array."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(texts: pa.Array) -> pa.Array:
        return _encoded(encoder_of(path, shared.value), texts)

    # as a non-deterministic function it is not inlined into what reads the ids, which would encode each text again
    return docs.select(*without(docs, [ids]), encoded.asNondeterministic()(text).alias(ids))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of the ids."""
    shared = docs.sparkSession.sparkContext.broadcast(_table(load(path)))

    @F.arrow_udf(T.StringType())
    def decoded(lists: pa.Array) -> pa.Array:
        return _decoded(shared.value, lists)

    return docs.select(*without(docs, [text]), decoded(ids).alias(text))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Adds ``ids`` and ``decoded``, their text: both steps in one worker, a slice of a batch at a time."""
    vocabulary = load(path)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, _table(vocabulary)))

    @F.arrow_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary, table = shared.value
        encoder = encoder_of(path, vocabulary)
        for batch in batches:
            for texts in _slices(batch):
                ids = _encoded(encoder, texts)
                yield pa.StructArray.from_arrays([ids, _decoded(table, ids)], ["ids", "decoded"])
        encoder.forget()
        hand_back_memory()

    found = docs.select(*without(docs, ["ids", "decoded", "_both"]), both("text").alias("_both"))
    return found.select(*without(found, ["_both"]), "_both.*")


def with_digests(docs: DataFrame, path: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of the whole text, beside the other columns."""
    rows = round_trip(docs, path)
    rows = rows.withColumns(
        {
            "n_tokens": F.size("ids").cast("long"),
            "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256),
            "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256),
        }
    )
    return rows.drop("ids", "decoded")
