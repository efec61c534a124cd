"""Grouped picks and ordered walks that hold when one key owns a large share of the rows.

* ``pick`` reduces to one row per key with a combinable aggregate instead of sorting whole groups.
* ``positions``, ``previous`` and ``running`` split each group into slices along its order,
  work inside a slice, and carry one summary row per slice across. ``slice_of`` must grow with the
  order and bound the rows it holds (a range of a unique id, a time range); without it the slices are
  the range partitions of (keys, order), written once so that every use sees the same cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import cut_lineage


def pick(df: DataFrame, keys: Sequence[str], order: Column, *, last: bool = True) -> DataFrame:
    """The row of each key with the largest (or smallest) ``order``."""
    chooser = F.max_by if last else F.min_by
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(chooser(row, order).alias("_row")).select("_row.*")


def by_slice(df: DataFrame, keys: Sequence[str], order: Sequence[Column], slice_of: Column | None) -> DataFrame:
    if slice_of is not None:
        return df.withColumn("_slice", slice_of)
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return cut_lineage(ranged.withColumn("_slice", F.spark_partition_id()))


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], slice_of: Column | None = None, name: str = "position"
) -> DataFrame:
    """Exact row number of each row within its key, starting at 1."""
    df = by_slice(df, keys, order, slice_of)
    sizes = df.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    walk = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(walk), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
    numbered = df.withColumn("_rn", F.row_number().over(inner))
    return _rejoin(numbered, starts, keys).withColumn(
        name, (F.col("_start") + F.col("_rn")).cast("long")
    ).drop("_slice", "_rn", "_start")


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], slice_of: Column | None, value: Column, name: str
) -> DataFrame:
    """``lag(value)`` over the whole key; ``order`` must be total."""
    df = by_slice(df, keys, order, slice_of).withColumn("_value", F.struct(value.alias("v")))
    last = df.groupBy(*keys, "_slice").agg(F.max_by("_value", F.struct(*order)).alias("_last"))
    carried = last.select(
        *keys, "_slice", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_carry")
    )
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
    lagged = df.withColumn("_lag", F.lag("_value").over(inner))
    return _rejoin(lagged, carried, keys).withColumn(
        name, F.coalesce("_lag", "_carry")["v"]
    ).drop("_slice", "_value", "_lag", "_carry")


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], slice_of: Column | None, value: Column, name: str,
    how=F.sum,
) -> DataFrame:
    """Sum (or ``F.min``, ``F.max``) of ``value`` up to and including the row, over the whole key."""
    df = by_slice(df, keys, order, slice_of).withColumn("_value", value)
    totals = df.groupBy(*keys, "_slice").agg(how("_value").alias("_t"))
    walk = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_slice", how("_t").over(walk).alias("_start"))
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = _rejoin(df.withColumn("_inner", how("_value").over(inner)), starts, keys)
    both = {F.min: F.least, F.max: F.greatest}.get(how)
    result = both("_start", "_inner") if both else F.coalesce("_start", F.lit(0)) + F.coalesce("_inner", F.lit(0))
    return joined.withColumn(name, result).drop("_slice", "_value", "_inner", "_start")


def _rejoin(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    left, right = df.alias("l"), summary.alias("r")
    on = F.col("l._slice").eqNullSafe(F.col("r._slice"))
    for key in keys:
        on = on & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    extra = [F.col(f"r.{c}") for c in summary.columns if c not in keys and c != "_slice"]
    return left.join(right, on, "left").select("l.*", *extra)


def members(df: DataFrame, keys: Sequence[str], kind: str, value: Column) -> DataFrame:
    """Set membership in long form: one row per distinct non-null value of a key."""
    return df.select(*keys, F.lit(kind).alias("kind"), value.cast("string").alias("value")).filter(
        F.col("value").isNotNull()
    ).distinct()
