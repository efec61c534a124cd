"""Similarity scores that built-in functions cannot express, as Arrow batch functions.

They only ever see pairs that an equi-join has brought together. Tokens are taken in order, ties go
to the earlier token, so a score does not depend on set order.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Least similarity of two tokens that count as the same, and of prefix and suffix matches.
SAME_TOKEN = 0.84
PREFIX_SCORE = 0.96
SUFFIX_SCORE = 0.9


@lru_cache(maxsize=1 << 16)
def token_similarity(left: str, right: str, affixes: bool) -> float:
    """Of seed names (affixes) by matching blocks, of names in reports by the longest common subsequence."""
    if left == right:
        return 1.0
    if affixes:
        short, long = sorted((left, right), key=len)
        if len(short) >= 4 and long.startswith(short):
            return PREFIX_SCORE
        if len(short) >= 3 and long.endswith(short):
            return SUFFIX_SCORE
        return SequenceMatcher(None, left, right).ratio()
    return _indel(left, right) / 100


def matched_share(left, right, affixes: bool = True, by_left: bool = True) -> float:
    """Share of tokens that find a partner, each partner used once, an equal one first; of ``left`` or of the shorter list."""
    one = [t for t in left if len(t) > 1]
    two = [t for t in right if len(t) > 1]
    if not by_left:
        if len(one) < 2 or len(two) < 2:
            return 0.0
        if len(one) > len(two):
            one, two = two, one
    if not one or not two:
        return 0.0
    free = list(two)
    found = 0
    for token in one:
        scores = [token_similarity(token, other, affixes) for other in free]
        best = max(scores, default=0.0)
        if best >= SAME_TOKEN:
            free.pop(scores.index(best))
            found += 1
    return found / len(one)


def token_share(left: Column, right: Column, *, affixes: bool = True, by_left: bool = True) -> Column:
    @pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([matched_share(x, y, affixes, by_left) for x, y in zip(a, b)], dtype="float64")

    return score(left, right)


def _indel(left: str, right: str) -> float:
    """100 * 2 * longest common subsequence over total length."""
    if not left and not right:
        return 100.0
    if not left or not right:
        return 0.0
    row = [0] * (len(right) + 1)
    for a in left:
        diagonal = 0
        for j, b in enumerate(right, 1):
            above = row[j]
            row[j] = diagonal + 1 if a == b else max(above, row[j - 1])
            diagonal = above
    return 200.0 * row[-1] / (len(left) + len(right))


def set_ratio(left: str, right: str) -> float:
    """Ratio of two keys as token sets: shared tokens alone, or with the rest of either side."""
    one, two = set(left.split()), set(right.split())
    if not one or not two:
        return 0.0
    shared = " ".join(sorted(one & two))
    if shared and (one <= two or two <= one):
        return 100.0
    first = " ".join(filter(None, [shared, " ".join(sorted(one - two))]))
    second = " ".join(filter(None, [shared, " ".join(sorted(two - one))]))
    scores = [_indel(first, second)]
    if shared:
        scores += [_indel(shared, first), _indel(shared, second)]
    return max(scores)


def token_set_ratio(left: Column, right: Column) -> Column:
    @pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([set_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")

    return F.when(F.length(left) * F.length(right) > 0, score(left, right)).otherwise(F.lit(0.0))
