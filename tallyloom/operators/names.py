"""Matching of person names on keys that bound the pairs to score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.fuzzy import token_share
from tallyloom.functions.text import name_tokens
from tallyloom.session import spread


def same_token_set(left: Column, right: Column) -> Column:
    return F.array_sort(F.array_distinct(left)) == F.array_sort(F.array_distinct(right))


def surname_pair(tokens: Column) -> Column:
    """The last two tokens as a sorted pair, for names of three tokens or more."""
    pair = F.array_sort(F.array_distinct(F.slice(tokens, -2, 2)))
    return F.when((F.size(tokens) >= 3) & (F.size(pair) == 2), F.array_join(pair, " "))


def merge_allowed(left: Column, right: Column) -> Column:
    """Same token set, or the same two surnames at the end."""
    both = (F.size(left) > 0) & (F.size(right) > 0)
    return both & (same_token_set(left, right) | F.coalesce(surname_pair(left) == surname_pair(right), F.lit(False)))


def _keyed(df: DataFrame, side: str) -> DataFrame:
    tokens = F.col("tokens")
    keys = F.array_compact(F.array(
        F.concat(F.lit("set:"), F.array_join(F.array_sort(F.array_distinct(tokens)), " ")),
        F.concat(F.lit("end:"), surname_pair(tokens)),
    ))
    return df.filter(F.size("tokens") > 0).select(F.col("name").alias(side), tokens.alias(f"{side}_tokens"), F.explode(keys).alias("block"))


def distinct_names(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("name")).filter("name IS NOT NULL").distinct().withColumn("tokens", name_tokens(F.col("name")))


def gated_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of distinct names that may be merged (columns left, right and their tokens).

    Each distinct name carries its token set and its surname pair as keys, so the gate itself is the
    join key and only pairs that pass it are built.
    """
    pairs = _keyed(left, "left").join(_keyed(right, "right"), "block")
    return pairs.drop("block").dropDuplicates(["left", "right"])


def best_match(
    left: DataFrame, left_name: str, right: DataFrame, right_id: str, right_name: str, least: float = 0.75
) -> DataFrame:
    """Per distinct left name the right row with the highest share of matched tokens, lowest id on ties.

    Tokens of one letter and particles do not count.
    """
    lowest = right.groupBy(F.col(right_name).alias("right")).agg(F.min(right_id).alias("match_id"))
    pairs = gated_pairs(distinct_names(left, left_name), distinct_names(right, right_name))
    scored = pairs.withColumn("score", token_share(F.col("left_tokens"), F.col("right_tokens"), affixes=False, by_left=False))
    kept = scored.filter(F.col("score") >= least).join(lowest, "right")
    return kept.groupBy(F.col("left").alias(left_name)).agg(
        F.max_by(F.struct("match_id", "right"), F.struct("score", -F.col("match_id"))).alias("_m"), F.max("score").alias("score")
    ).select(left_name, F.col("_m.match_id").alias("match_id"), F.col("_m.right").alias("match_name"), F.round("score", 2).alias("score"))


def partial_matches(
    left: DataFrame, left_id: str, left_name: str, right: DataFrame, right_id: str, right_name: str,
    least: float = 0.5, most: int = 5,
) -> DataFrame:
    """The best ``most`` right rows per left row by share of common tokens of the shorter name.

    Equal token sets are scored once and expanded after the cut. Half of three or more tokens are two,
    so longer names meet on token pairs; a single token is a key only where one side is a name of two tokens,
    each side's short names having keys of their own.
    """
    from pyspark.sql import Window

    def token_sets(df: DataFrame, name: str, side: str) -> DataFrame:
        tokens = F.array_sort(F.array_distinct(F.filter(name_tokens(F.col(name)), lambda t: F.length(t) > 1)))
        return df.withColumn(f"{side}_set", tokens).filter(F.size(f"{side}_set") >= 2)

    def meet(df: DataFrame, side: str) -> DataFrame:
        tokens = F.col(f"{side}_set")
        short = F.size(tokens) == 2
        single = lambda owner: F.transform(tokens, lambda t: F.concat(F.lit(f"{owner}:"), t))
        pairs = F.flatten(F.transform(tokens, lambda a: F.transform(
            F.filter(tokens, lambda b: b > a), lambda b: F.concat(F.lit("2:"), a, F.lit(" "), b))))
        # "l:" holds the two-token names of the left and every name of the right, "r:" the longer ones of the left and the two-token ones of the right
        if side == "l":
            keys = F.when(short, single("l")).otherwise(F.concat(single("r"), pairs))
        else:
            keys = F.when(short, F.concat(single("l"), single("r"))).otherwise(F.concat(single("l"), pairs))
        return df.select(f"{side}_set").distinct().select(f"{side}_set", F.explode(keys).alias("block"))

    ls, rs = token_sets(spread(left), left_name, "l"), token_sets(spread(right), right_name, "r")
    met = meet(ls, "l").join(meet(rs, "r"), "block")
    scored = met.select("l_set", "r_set").distinct().withColumn(
        "score", F.size(F.array_intersect("l_set", "r_set")) / F.least(F.size("l_set"), F.size("r_set"))
    ).filter(F.col("score") >= least)
    # a right token set stands for at least one row, so the first sets cover the first rows
    lowest = rs.groupBy("r_set").agg(F.min(right_id).alias("_low"))
    shown = F.round("score", 2)
    by_set = Window.partitionBy("l_set").orderBy(shown.desc(), F.col("_low"))
    sets = scored.join(lowest, "r_set").withColumn("_r", F.row_number().over(by_set)).filter(F.col("_r") <= most)
    members = rs.select("r_set", right_id).withColumn(
        "_m", F.row_number().over(Window.partitionBy("r_set").orderBy(right_id))).filter(F.col("_m") <= most)
    rows = sets.join(members, "r_set").withColumn(
        "_r", F.row_number().over(Window.partitionBy("l_set").orderBy(shown.desc(), F.col(right_id)))).filter(F.col("_r") <= most)
    return ls.select(left_id, "l_set").join(rows, "l_set").select(left_id, right_id, shown.alias("match_confidence"))
