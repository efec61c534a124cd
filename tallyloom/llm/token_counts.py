"""Token counts under a unigram segmentation, with the dynamic program shared along a trie.

A text is cut into pre-tokens by the vocabulary's pattern. The token count of a pre-token is the length of its most
probable segmentation into vocabulary entries (log probability of rank r: -log(r + 1), Zipf's law; equal scores take
fewer tokens). Distinct pre-tokens go into a trie of bytes; a node holds the best score and count of the prefix it
stands for, so a shared prefix is worked out once, and the node where a pre-token ends holds its count.

Every single byte is in the vocabulary, so each text has a segmentation. A worker keeps one trie and drops it when it has
NODES nodes. Defined cases: null and empty texts have no pre-tokens and no tokens; extra columns pass through, one named
like a new column is replaced; repeated rows are counted each.
"""

from __future__ import annotations

import base64
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import Recent, without

NODES = 800_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary file with a base64 entry and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(entry): int(rank) for entry, rank in (line.split() for line in lines if line.strip())}


class Trie:
    """Forward scores of all prefixes seen. Node 0 is the empty prefix."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the single bytes {missing}")
        self.logs = {entry: -math.log(rank + 1) for entry, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.reset()

    def reset(self) -> None:
        self.children: dict[int, int] = {}  # by node * 256 + byte
        self.scores = [0.0]
        self.counts = [0]

    def count(self, token: bytes) -> int:
        """Insert a pre-token; the count at its last node."""
        if len(self.scores) > NODES:
            self.reset()
        node, path = 0, [0]
        for depth, byte in enumerate(token, 1):
            child = self.children.get(node * 256 + byte)
            if child is None:
                child = self._add(node, byte, token, depth, path)
            path.append(child)
            node = child
        return self.counts[node]

    def _add(self, node: int, byte: int, token: bytes, depth: int, path: list[int]) -> int:
        best, fewest = -math.inf, 0
        for start in range(max(0, depth - self.longest), depth):
            log = self.logs.get(token[start:depth])
            if log is not None:
                score, count = self.scores[path[start]] + log, self.counts[path[start]] + 1
                if score > best or (score == best and count < fewest):
                    best, fewest = score, count
        child = self.children[node * 256 + byte] = len(self.scores)
        self.scores.append(best)
        self.counts.append(fewest)
        return child


class Counter:
    """The trie, and the counts of recent pre-tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.trie = Trie(ranks)
        self.tokens = Recent(lambda token: self.trie.count(token.encode()), NODES // 2)


_RESULT = T.StructType([T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])


_COUNTERS: dict[str, Counter] = {}


def counter_of(path: str, ranks: dict[bytes, int]) -> Counter:
    """The counter a worker keeps from task to task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(ranks)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``n_pretokens`` and ``n_tokens`` of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    @F.arrow_udf(_RESULT)
    def counts(texts: pa.Array) -> pa.Array:
        import regex

        counter, split = counter_of(path, shared.value), regex.compile(pattern)
        parts, tokens = [], []
        for text in texts.to_pylist():
            found = split.findall(text or "")
            parts.append(len(found))
            tokens.append(sum(map(counter.tokens.__getitem__, found)))
        return pa.StructArray.from_arrays([pa.array(parts, pa.int64()), pa.array(tokens, pa.int64())], ["n_pretokens", "n_tokens"])

    found = docs.withColumn("_found", counts("text"))
    return found.select(*without(found, ["_found", "n_pretokens", "n_tokens"]), "_found.*")
