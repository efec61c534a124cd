"""Pairs of alike names, found through keys that no pair the rules accept can miss."""

from __future__ import annotations

import math
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tallyloom.functions.fuzzy import SAME_TOKEN, token_share, token_similarity

SHORT = 12  # two tokens of at most this length meet on what is left after deletions, others on three letters
BLOCK = 4096  # names of all lengths in one slice of a block
CLASSES = 32  # letters are counted in so many classes; letters that share one only raise the bound
EPS = 1e-9


def _residues(token: str) -> set[str]:
    """The token without any of its letters that a ratio of SAME_TOKEN can leave unmatched.

    Matched letters m hold 2m >= s(a + b) and m <= b, so b >= sa / (2 - s) and a - m <= a(2 - 2s) / (2 - s).
    """
    most = math.floor(len(token) * (2 - 2 * SAME_TOKEN) / (2 - SAME_TOKEN) + EPS)
    return {"".join(kept) for n in range(most + 1) for kept in combinations(token, len(token) - n)}


def _keys(token: str, left: bool) -> list[str]:
    """Keys on which a left and a right token meet if they are equal, one begins or ends the other, or their ratio is SAME_TOKEN.

    Over SHORT, a and b have over 20 letters together; at most 0.16(a + b) unmatched ones cut the 0.42(a + b)
    matched ones into runs, of which one has three letters at least.
    """
    own, other = ("<", ">") if left else (">", "<")
    keys = {own + "p" + token, own + "s" + token, "=" + token}
    keys |= {other + "p" + token[:n] for n in range(4, len(token) + 1)} | {other + "s" + token[-n:] for n in range(3, len(token) + 1)}
    if len(token) <= SHORT:
        keys |= {"d" + x for x in _residues(token)}
    if len(token) >= math.floor((SHORT + 1) * SAME_TOKEN / (2 - SAME_TOKEN)):
        keys |= {"g" + token[i : i + 3] for i in range(len(token) - 2)}
    return list(keys)


def _keyed(tokens: DataFrame, name: str, left: bool) -> DataFrame:
    @pandas_udf(T.ArrayType(T.StringType()))
    def keys(column: pd.Series) -> pd.Series:
        return column.map(lambda x: _keys(x, left))

    return tokens.select(F.col("token").alias(name), F.explode(keys("token")).alias("key"))


def token_links(left: DataFrame, right: DataFrame) -> DataFrame:
    """All (token, other) of two columns ``token`` of distinct tokens that count as the same."""
    @pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([token_similarity(x, y, True) for x, y in zip(a, b)], dtype="float64")

    met = _keyed(left, "token", True).join(_keyed(right, "other", False), "key").select("token", "other").distinct()
    return met.filter(alike("token", "other") >= SAME_TOKEN)


def long_tokens(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda t: F.length(t) > 1)


def rare_tokens(names: DataFrame, links: DataFrame, seeds: DataFrame, share: float) -> DataFrame:
    """(name, other): seed tokens like one of the rarest tokens of each name.

    Of n tokens at least m = ceil(share n) have to find a partner, so one of any n - m + 1 does.
    """
    counts = seeds.groupBy("other").agg(F.count(F.lit(1)).alias("_n"))
    reach = links.join(counts, "other").groupBy("token").agg(F.sum("_n").alias("_reach"))
    placed = names.select("name", F.explode(long_tokens(F.col("name"))).alias("token")).join(reach, "token", "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("_reach", F.lit(0)).alias("reach"), "token")))
    n = F.size("_order")
    first = F.slice("_order", F.lit(1), (n - F.ceil(n * share - EPS) + 1).cast("int"))
    chosen = placed.groupBy("name").agg(order.alias("_order")).select("name", F.explode(F.array_distinct(first)).alias("t")).filter("t.reach > 0")
    return chosen.select("name", F.col("t.token").alias("token")).join(links, "token").select("name", "other").distinct()


def _codes(names: list[str], length: int) -> np.ndarray:
    return (np.array([[ord(c) for c in x] for x in names], dtype=np.int64) % CLASSES).reshape(len(names), length)


def _longest(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of rows i of ``left`` (at most 63 letters) and j of ``right``."""
    places = np.zeros((len(left), CLASSES), dtype=np.uint64)
    for k in range(left.shape[1]):
        places[np.arange(len(left)), left[:, k]] |= np.uint64(1 << k)
    v = np.full(len(i), np.uint64(2**64 - 1))
    for k in range(right.shape[1]):
        u = v & places[i, right[j, k]]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v & np.uint64((1 << left.shape[1]) - 1))


def ratio_in_block(left: list[str], right: list[str], least: float) -> list[tuple[str, str]]:
    """Pairs of two lists, each of names of one length, whose sequence ratio is ``least`` or more.

    The matched letters are a common subsequence and a common multiset, so both bound their number.
    """
    a, b = len(left[0]), len(right[0])
    need = math.ceil(least * (a + b) / 2 - EPS)
    one, two = _codes(left, a), _codes(right, b)
    common = np.zeros((len(left), len(right)), dtype=np.int32)
    for c in range(CLASSES):
        common += np.minimum((one == c).sum(1)[:, None], (two == c).sum(1)[None, :])
    i, j = np.nonzero(common >= need)
    if min(a, b) < 64:
        kept = (_longest(one, two, i, j) if a < 64 else _longest(two, one, j, i)) >= need
        i, j = i[kept], j[kept]
    return [(left[x], right[y]) for x, y in zip(i, j) if SequenceMatcher(None, left[x], right[y]).ratio() >= least]


def ratio_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """All (name, normalized_name) of two columns ``name`` of distinct names whose sequence ratio is ``least`` or more.

    Names meet by length: b letters against a hold 2 min(a, b) >= least (a + b). Blocks are slices of one length.
    """
    slices = 1 + right.count() // BLOCK, 1 + left.count() // BLOCK

    def blocks(names: DataFrame, n: int) -> DataFrame:
        return names.groupBy(F.length("name").alias("length"), F.pmod(F.xxhash64("name"), F.lit(n)).cast("int").alias("slice")).agg(F.collect_list("name").alias("names"))

    step = least / (2 - least)
    reach = F.explode(F.sequence(F.ceil(F.col("length") * step - EPS).cast("int"), F.floor(F.col("length") / step + EPS).cast("int")))
    one = blocks(left, slices[1]).select(F.col("names").alias("left"), reach.alias("length")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(slices[0] - 1))).alias("slice"))
    two = blocks(right, slices[0]).withColumnRenamed("names", "right")

    @pandas_udf("array<struct<name:string,normalized_name:string>>")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"name": x, "normalized_name": y} for x, y in ratio_in_block(list(p), list(q), least)] for p, q in zip(a, b)])

    met = one.join(two.hint("shuffle_hash"), ["length", "slice"])
    return met.select(F.explode(alike("left", "right")).alias("p")).select("p.*")


def alike_names(names: DataFrame, seeds: DataFrame, links: DataFrame, places: DataFrame, least: float) -> DataFrame:
    """All (name, normalized_name) with a token share of ``least`` or, for two tokens or more, such a sequence ratio."""
    met = rare_tokens(names, links, places, least).join(places, "other").select("name", "normalized_name").distinct()
    shared = met.filter(token_share(F.split("name", " "), F.split("normalized_name", " ")) >= least)
    close = ratio_pairs(names.filter(F.size(F.split("name", " ")) >= 2), seeds.select(F.col("normalized_name").alias("name")), least)
    return shared.union(close).distinct()
