"""Dedupe, version and page picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import upper_key
from tallyloom.operators import skew


def newest_per_source(rows: DataFrame, id_column: str) -> DataFrame:
    """List form of the progress dedupe: one row per source, or per row when it has no source."""
    key = F.coalesce(
        F.concat(F.lit("SOURCE:"), F.nullif(upper_key(F.col("source_path")), F.lit(""))),
        F.concat(F.lit("ROW:"), F.col(id_column).cast("string")),
    )
    keyed = rows.withColumn("_key", key)
    return skew.pick(keyed, ["_key"], F.col(id_column)).drop("_key")


def queue_order() -> list[Column]:
    return [F.col("manual_priority").desc_nulls_last(), F.col("automatic_priority").desc(), F.col("created_at"), F.col("item_id")]


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page and page_size are invalid")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def queue_page(items: DataFrame, number: int, size: int) -> DataFrame:
    return page(items, queue_order(), number, size)


def ranked_cases(items: DataFrame, keys: list[str], order: list[Column], most: int = 2) -> DataFrame:
    """Up to ``most`` cases per target: enough to tell none, one and several apart."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return items.withColumn("case_rank", rank).filter(F.col("case_rank") <= most)


def truncated_list(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows and whether there are more."""
    head = df.orderBy(*order).limit(most + 1)
    rank = F.row_number().over(Window.orderBy(*order))  # at most ``most + 1`` rows reach this window
    total = F.count(F.lit(1)).over(Window.partitionBy())
    return head.withColumn("_r", rank).withColumn("truncated", total > most).filter(F.col("_r") <= most).drop("_r")


def best_kept_in_order(df: DataFrame, key: str, score: str, position: str) -> DataFrame:
    """Best row per key, listed where the key was first seen; the earlier row wins a tie."""
    row = F.struct(*[F.col(c) for c in df.columns if c != key])
    best = df.groupBy(key).agg(F.max_by(row, F.struct(F.col(score), -F.col(position))).alias("_b"), F.min(position).alias("first_seen"))
    return best.select(key, "_b.*", "first_seen")


def last_wins(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    return skew.pick(df, keys, F.col(position))


def repeated_flags(df: DataFrame, keys: list[str], order: list[Column], name: str, slice_of: Column | None = None) -> DataFrame:
    """True from the second occurrence of a key on."""
    return skew.positions(df, keys, order, slice_of, "_p").withColumn(name, F.col("_p") > 1).drop("_p")


def page_count(df: DataFrame, size: int = 10) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / size).alias("pages"))


def reconcile_pairs(jobs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Re-key historical jobs to the document of their current twin and chain them; conflicts keep the row.

    ``jobs`` holds (id, document_key, is_current, supersedes_id); ``pairs`` holds (historical_id,
    current_id). Running it on its own output changes nothing.
    """
    current = pairs.join(jobs.select(
        F.col("id").alias("current_id"), F.col("document_key").alias("_key"), F.col("is_current").alias("_live"),
        F.col("supersedes_id").alias("_link")), "current_id")
    twins = current.groupBy("current_id").agg(F.count(F.lit(1)).alias("_twins"))
    current = current.join(twins, "current_id").withColumn(
        "_conflict",
        F.when(F.col("_twins") > 1, "several historical rows").when(~F.col("_live"), "not current")
        .when(F.col("_link").isNotNull() & (F.col("_link") != F.col("historical_id")), "linked elsewhere"),
    )
    old = current.select(F.col("historical_id").alias("id"), "_key", "_conflict")
    new = current.filter("_conflict IS NULL").select(F.col("current_id").alias("id"), F.col("historical_id").alias("_historical"))
    joined = jobs.join(old, "id", "left").join(new, "id", "left")
    move = F.col("_key").isNotNull() & F.col("_conflict").isNull()
    return joined.select(
        "id", F.when(move, F.col("_key")).otherwise(F.col("document_key")).alias("document_key"),
        F.when(move, F.lit(False)).otherwise(F.col("is_current")).alias("is_current"),
        F.coalesce("supersedes_id", "_historical").alias("supersedes_id"),
        F.col("_conflict").alias("conflict"), (move & (F.col("document_key") != F.col("_key"))).alias("changed"),
    )
