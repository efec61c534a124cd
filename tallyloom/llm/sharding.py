"""Shards by a pseudo-random permutation of global row numbers.

Rows are numbered 0 to N - 1 in the order of given columns. A Feistel network over Z_a x Z_b, with a = ceil(sqrt(N)) and
b = ceil(N / a), permutes 0 to a * b - 1; a result of N or more is fed in again until it is less (cycle walking). Fewer
than a numbers lie at N or above and each is met at most once on a walk, so a * b - N steps always suffice, and only about
a rows walk at all. Shard and slot of a row are the remainder and the quotient of its permuted number by the number of
shards, so both can be worked out from the row number alone, and the row number from them.

Numbers come from a range partitioning: positions inside a partition plus the sizes of the partitions before. Rows equal
in the order columns are spread by a running id, so they may fill several partitions.

Law: ``rows`` - the shards' row counts differ by one at most, slots are gapless from 0. Defined cases: nulls sort first;
equal rows get different slots, which of them gets which does not matter; an empty table gives an empty result; extra
columns pass through, those named like a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import without
from tallyloom.session import cut_lineage

ROUNDS = 6
SEED = 20240901
#: The running number inside a partition is the lower 33 bits of Spark's increasing id.
_IN_PARTITION = (1 << 33) - 1


def number_rows(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """Adds a gapless number from 0 in the given order, and ``_n``, the number of rows."""
    spread = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order], F.col("_tie"))
    ranged = ranged.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order], "_tie").drop("_tie")
    placed = cut_lineage(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))}))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))  # a row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"), F.sum("_size").over(whole).alias("_n"))
    joined = placed.join(F.broadcast(starts), "_part")
    return joined.withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def _mix(turn: Column, half: Column, seed: int) -> Column:
    """The round function: 60 bits of a digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), turn.cast("string"), half.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _network(value: Column, a: Column, b: Column, seed: int, *, inverse: bool = False) -> Column:
    sign = -1 if inverse else 1
    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def turn(halves: Column, i: Column) -> Column:
        left, right = halves["l"], halves["r"]
        new_left = F.pmod(left + sign * F.pmod(_mix(i, right, seed), a), a)
        new_right = F.pmod(right + sign * F.pmod(_mix(i, left, seed), b), b)
        return F.when(i % 2 == 0, F.struct(new_left.alias("l"), right.alias("r"))).otherwise(F.struct(left.alias("l"), new_right.alias("r")))

    start = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, b).alias("r"))
    return F.aggregate(turns, start, turn, lambda h: h["l"] * b + h["r"])


def permute(df: DataFrame, value: str, n: str, out: str, seed: int = SEED, *, inverse: bool = False) -> DataFrame:
    """Adds ``out``: the permuted number of column ``value`` among ``n`` numbers, or back again."""
    a = F.ceil(F.sqrt(F.col(n).cast("double")))
    sized = df.withColumn("_a", F.greatest(a, F.lit(1)).cast("long"))
    sized = sized.withColumn("_b", F.ceil(F.col(n) / F.col("_a")).cast("long"))
    once = sized.withColumn("_v", _network(F.col(value), F.col("_a"), F.col("_b"), seed, inverse=inverse))
    steps = F.sequence(F.lit(1).cast("long"), F.col("_a") * F.col("_b") - F.col(n))
    again = lambda v, _: F.when(v < F.col(n), v).otherwise(_network(v, F.col("_a"), F.col("_b"), seed, inverse=inverse))
    walked = F.when(F.col("_v") < F.col(n), F.col("_v")).otherwise(F.aggregate(steps, F.col("_v"), again))
    return once.withColumn(out, walked).drop("_a", "_b", "_v")


def shard(df: DataFrame, order: Sequence[str], shards: int, seed: int = SEED) -> DataFrame:
    """Adds ``shard`` (0 to shards - 1) and ``slot`` (from 0) to every row."""
    clean = df.select(*without(df, ["shard", "slot", "_n", "_row", "_to", "_part", "_at", "_start", "_tie", "_size", "_a", "_b", "_v"]))
    moved = permute(number_rows(clean, order, "_row"), "_row", "_n", "_to", seed)
    return moved.withColumns({"shard": (F.col("_to") % shards).cast("int"), "slot": F.floor(F.col("_to") / shards).cast("long")}).drop("_row", "_n", "_to")


def row_at(places: DataFrame, n: str, shards: int, seed: int = SEED) -> DataFrame:
    """Adds ``row_number`` for rows (shard, slot, n): which row of the ordered table lies there."""
    to = places.withColumn("_to", F.col("slot") * shards + F.col("shard"))
    return permute(to, "_to", n, "row_number", seed, inverse=True).drop("_to")


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus one) and text_crc32 of each document; null text counts as empty."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
