"""Mixing sources to target weights by capped water-filling.

The sources are ranked (by code point, null last) and get the weights in turn. Their targets are in proportion to the
weights and add up to ``share`` times all sizes, but a target above ``epochs`` times its source's size stops there, and the
excess goes to the others by weight until none is above. That is one water level: a source either is full or holds weight
times level. Each round adds up, in Spark, what is full at the present level, and takes the level that the rest then
needs; levels only rise, and the rounds end when no further source fills.

A document is taken ``whole`` times, as often as its source's target holds all of the source. What is left of the target
is filled by one repetition more of the documents that fit it when all are laid end to end in a seeded order. The gap
behind them is filled from the other documents, SPARES of each bit length of the size, the longest first, each if it still
fits: SPARES of one length that fit leave a gap of less than that length, so a source misses its target by about its
shortest documents, and no document is taken more than ``epochs`` times. The running sizes go over slices of the order,
so a hot source fills many tasks; the spares of a source are a short list.

Defined cases: null text has size 0; null is a source of its own; a source of size 0 has target 0, and documents of size 0
are taken 0 words; an empty table gives an empty result; weights are whole and above 0. Equal rows are
mixed each, which of them gets a repetition does not matter. Extra columns pass through, those named like a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import small_or_plain, without
from tallyloom.llm.sharding import number_rows
from tallyloom.operators.skew import running
from tallyloom.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
EPOCHS = 2
SEED = 42
SPARES = 3
WORD = r"[^\x20\x09-\x0D]+"

_NEW = ("size", "source_size", "target", "copies", "taken")


@F.arrow_udf(T.LongType())
def _words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pc.fill_null(pc.count_substring_regex(texts, WORD), 0).cast(pa.int64())


def measure(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds ``size`` and ``_order``, the seeded place of a document; equal rows share theirs."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return docs.select(*without(docs, (*_NEW, "_order", "_tie", "_source", "_rank", "_upto")), F.coalesce(_words("text"), F.lit(0).cast("long")).alias("size"), F.concat(order, digest).alias("_order"))


def water_level(sources: DataFrame, share: Fraction = SHARE, epochs: int = EPOCHS) -> tuple[int, int]:
    """The level as numerator and denominator, for rows (weight, source_size); denominator 0: every source is full."""
    full = F.lit(False)
    filled = -1
    while True:
        r = sources.agg(
            F.sum("source_size").alias("all"), F.count_if(full).alias("n"), F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("full"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        wanted = share.numerator * (r["all"] or 0) - share.denominator * epochs * (r["full"] or 0)
        level = wanted, share.denominator * (r["weight"] or 0)
        if r["n"] == filled or not level[1]:
            return level
        filled = r["n"]
        full = F.col("source_size").cast("double") * epochs < F.col("weight") * F.lit(float(level[0])) / F.lit(float(level[1]))


def targets(sizes: DataFrame, source: str, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(rank, source, source_size, target) of each source, from rows (source, size); written to the shared folder."""
    if min(weights) <= 0:
        raise ValueError("weights are above 0")
    sums = sizes.groupBy(F.col(source).alias("_source")).agg(F.sum("size").alias("source_size"))
    ranked = number_rows(sums.withColumn("_null", F.col("_source").isNull()), ["_null", "_source"], "_rank").drop("_null", "_n")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long")
    rows = cut_lineage(ranked.withColumn("weight", weight))
    level, by = water_level(rows, share, epochs)
    cap = F.col("source_size") * F.lit(float(epochs))
    target = F.least(cap, F.lit(float(level)) * F.col("weight") / F.lit(float(by))) if by else cap
    return rows.withColumn("target", target)


def mix(
    docs: DataFrame, source: str = "source", weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, epochs: int = EPOCHS, seed: int = SEED, *, keep_text: bool = False
) -> DataFrame:
    """Adds size, source_size, target, copies (how often the mix takes the document) and taken (copies times size).

    The text is left out unless ``keep_text``.
    """
    measured = measure(docs, seed)
    rows = cut_lineage(measured if keep_text else measured.drop("text")).withColumn("_tie", F.monotonically_increasing_id())
    sources = targets(rows, source, weights, share, epochs)
    known = small_or_plain(sources.select("_source", "_rank", "source_size", "target"), sources.count())
    joined = rows.join(known, F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    placed = cut_lineage(running(joined, ["_rank"], [F.col("_order"), F.col("size"), F.col("_tie")], None, F.col("size"), "_upto"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.col("target") - whole * F.col("source_size")
    inside = (F.col("size") > 0) & (F.col("_upto") <= left)
    spare = fill_gaps(placed, inside, left).withColumnRenamed("_tie", "_spare")
    found = placed.join(small_or_plain(spare, spare.count()), F.col("_tie") == F.col("_spare"), "left")
    copies = (whole + (inside | F.col("_spare").isNotNull()).cast("long")).cast("long")
    return found.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("_rank", "_order", "_tie", "_upto", "_spare")


def fill_gaps(placed: DataFrame, inside: Column, left: Column) -> DataFrame:
    """_tie of the documents that fill what those ``inside`` leave of ``left``; written to the shared folder."""
    sums = placed.groupBy("_rank").agg(F.max(left).alias("_left"), F.sum(F.when(inside, F.col("size")).otherwise(0)).alias("_sum"))
    gaps = cut_lineage(sums.select("_rank", (F.col("_left") - F.col("_sum")).alias("_gap")))
    others = placed.filter(~inside & (F.col("size") > 0)).select("_rank", "size", "_order", "_tie", F.length(F.bin("size")).alias("_bits"))
    fitting = others.join(small_or_plain(gaps, gaps.count()), "_rank").filter(F.col("size") <= F.col("_gap"))
    first = F.row_number().over(Window.partitionBy("_rank", "_bits").orderBy("_order", "size", "_tie"))
    few = fitting.withColumn("_at", first).filter(F.col("_at") <= SPARES)
    lists = few.groupBy("_rank").agg(F.max("_gap").alias("_gap"), F.array_sort(F.collect_list(F.struct((-F.col("_bits")).alias("b"), F.col("_at").alias("at"), F.col("size").alias("s"), F.col("_tie").alias("t")))).alias("_row"))
    before = lambda i: F.aggregate(F.slice("_row", F.lit(1), i), F.col("_gap"), lambda g, c: F.when(c["s"] <= g, g - c["s"]).otherwise(g))
    taken = F.filter("_row", lambda c, i: c["s"] <= before(i))
    return cut_lineage(lists.select(F.explode(taken).alias("c")).select(F.col("c.t").alias("_tie")))


def repeat(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each repetition taken, numbered from 1."""
    return mixed.filter("copies > 0").withColumn("repetition", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
