"""Containment matching between two name columns, as an equi-join on character grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column) -> Column:
    """Every distinct gram of length 1 to GRAM, in one walk over the characters."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    later = [F.slice(chars, F.lit(k), F.size(chars)) for k in range(2, GRAM + 1)]
    rows = F.arrays_zip(chars.alias("c1"), *[c.alias(f"c{k}") for k, c in enumerate(later, 2)])
    # past the end the later characters are null, and so is a gram of them
    return F.array_distinct(F.flatten(F.transform(rows, lambda r: F.array_compact(F.array(
        *[F.concat(*[r[f"c{k}"] for k in range(1, n + 1)]) for n in range(1, GRAM + 1)])))))


def contained_pairs(whole: DataFrame, part: DataFrame) -> DataFrame:
    """Pairs of distinct non-empty strings with ``part`` inside ``whole``.

    Inputs hold one string column each. A part can only occur where its first gram occurs, so grams meet on
    equality; a hash stands for the whole until its candidates are gathered, and each is then checked in full.
    """
    hay = whole.toDF("whole").filter(F.length("whole") > 0).distinct().withColumn("_id", F.xxhash64("whole"))
    pin = part.toDF("part").filter(F.length("part") > 0).distinct().withColumn("gram", F.substring("part", 1, GRAM))
    met = hay.select("_id", F.explode(_grams(F.col("whole"))).alias("gram")).join(pin, "gram").select("_id", "part")
    return hay.join(met, "_id").filter(F.contains("whole", "part")).select("whole", "part")


def parts_in_texts(texts: DataFrame, key: str, text: str, parts: DataFrame) -> DataFrame:
    """``texts`` with ``parts``: the entries of the catalog ``parts`` (part, rank) that occur in the row's text, as structs by rank.

    The longest run without blanks of an entry lies inside one such run of any text that holds the entry. So the
    vocabulary of the texts meets the catalog's runs, the words found lead to the rows that have them, and each row
    tests its few candidates. A row's text stands in the input alone: only its distinct words are dealt out, and what
    comes back is one array of catalog entries per key. Rows without a text or without an entry get an empty array;
    rows with equal or null keys are tested one by one.
    """
    words = F.array_distinct(F.split(F.col(text), " "))
    runs = F.array_sort(F.split(F.col("part"), " "), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    pins = parts.select("part", "rank").filter(F.trim("part") != "").withColumn("_run", F.get(runs, F.lit(0)))
    heard = texts.select(F.col(key).alias("_key"), F.explode(words).alias("_word")).filter("_word <> ''")
    known = contained_pairs(heard.select("_word"), pins.select("_run")).toDF("_word", "_run").join(pins, "_run").select("_word", F.struct("rank", "part").alias("_entry"))
    found = heard.join(known, "_word").groupBy("_key").agg(F.collect_set("_entry").alias("_parts"))
    joined = texts.join(found, F.col(key).eqNullSafe(F.col("_key")), "left")
    held = F.coalesce(F.filter("_parts", lambda e: F.col(text).contains(e["part"])), F.array())
    return joined.select(*[texts[c] for c in texts.columns], F.array_sort(held).alias("parts"))


def loose_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs equal or contained either way: columns ``left_key`` and ``right_key``."""
    one = contained_pairs(left, right).toDF("left_key", "right_key")
    two = contained_pairs(right, left).toDF("right_key", "left_key").select("left_key", "right_key")
    return one.union(two).distinct()
