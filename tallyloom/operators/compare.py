"""Row hashes, table digests, snapshots and change plans.

A table digest must not pull the table through one task, so it adds up row hashes instead of
hashing the ordered concatenation: equal multisets of rows give equal digests in any order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators and the null token of a row text.
UNIT, NULL_TOKEN = "\x1f", "\\N"


def row_text(columns: list[str]) -> Column:
    return F.concat_ws(UNIT, *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_TOKEN)) for c in columns])


def row_hash(columns: list[str]) -> Column:
    return F.sha2(row_text(sorted(columns)), 256)


def _part(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")


def table_digest(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(label, row_count, digest): sha256 over the count and the sums of four parts of the row hashes."""
    hashed = df.select(row_hash(columns).alias("h"))
    sums = [F.coalesce(F.sum(_part(F.col("h"), s)), F.lit(0).cast("decimal(38,0)")).cast("string") for s in (1, 16, 31, 46)]
    return hashed.agg(F.count(F.lit(1)).alias("row_count"), F.concat_ws("-", *sums).alias("sums")).select(
        F.lit(label).alias("label"), "row_count", F.sha2(F.concat_ws(":", F.col("row_count").cast("string"), "sums"), 256).alias("digest"))


def snapshot(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [table_digest(df, label, columns) for label, (df, columns) in tables.items()])


def manifest_digest(digests: DataFrame) -> DataFrame:
    """One digest over the few table digests, in label order."""
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "label", F.col("row_count").cast("string"), "digest")))
    return digests.agg(F.count(F.lit(1)).alias("tables"), F.sha2(F.array_join(lines, "\n"), 256).alias("manifest"))


def compare_digests(before: DataFrame, after: DataFrame) -> DataFrame:
    """Removed, added and changed tables."""
    b = before.select("label", F.col("row_count").alias("_bn"), F.col("digest").alias("_bd"))
    a = after.select("label", F.col("row_count").alias("_an"), F.col("digest").alias("_ad"))
    change = (
        F.when(F.col("_an").isNull(), "removed").when(F.col("_bn").isNull(), "added")
        .when(F.col("_an") != F.col("_bn"), "row_count").when(F.col("_ad") != F.col("_bd"), "digest")
    )
    return b.join(a, "label", "full").select("label", change.alias("change"), (F.coalesce("_an", F.lit(0)) - F.coalesce("_bn", F.lit(0))).alias("row_delta")).filter("change IS NOT NULL")


def _tuple(alias: str, columns: list[str]) -> Column:
    return F.struct(*[F.col(f"{alias}.{c}") for c in columns])


def apply_plan(current: DataFrame, proposed: DataFrame, key: str, columns: list[str], locked: str) -> DataFrame:
    """(key, state): locked rows are never updated; ids on one side only are violations."""
    joined = current.alias("c").join(proposed.alias("p"), F.col(f"c.{key}") == F.col(f"p.{key}"), "full")
    state = (
        F.when(F.col(f"p.{key}").isNull(), "missing_in_proposal").when(F.col(f"c.{key}").isNull(), "missing_in_current")
        .when(F.col(f"c.{locked}"), "locked").when(_tuple("c", columns).eqNullSafe(_tuple("p", columns)), "unchanged").otherwise("changed")
    )
    return joined.select(F.coalesce(f"c.{key}", f"p.{key}").alias(key), state.alias("state"))


def drift(current: DataFrame, stored: DataFrame, proposed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows whose values are neither those of the snapshot nor those of the proposal."""
    joined = current.alias("c").join(stored.alias("s"), F.col(f"c.{key}") == F.col(f"s.{key}"), "left").join(
        proposed.alias("p"), F.col(f"c.{key}") == F.col(f"p.{key}"), "left")
    now = _tuple("c", columns)
    same = now.eqNullSafe(_tuple("s", columns)) | now.eqNullSafe(_tuple("p", columns))
    return joined.filter(~same).select(F.col(f"c.{key}").alias(key))


def restore_plan(current: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows to write back so that the table equals its snapshot."""
    joined = current.alias("c").join(stored.alias("s"), F.col(f"c.{key}") == F.col(f"s.{key}"))
    return joined.filter(~_tuple("c", columns).eqNullSafe(_tuple("s", columns))).select("s.*")


def verify_snapshot(current: DataFrame, stored: DataFrame, key: str, fixed: list[str], hash_column: str) -> DataFrame:
    """Violations: ids that came or went, immutable values that differ, row hashes that differ."""
    joined = current.withColumn("_h", row_hash(fixed)).alias("c").join(stored.alias("s"), F.col(f"c.{key}") == F.col(f"s.{key}"), "full")
    problem = (
        F.when(F.col(f"s.{key}").isNull(), "id added").when(F.col(f"c.{key}").isNull(), "id removed")
        .when(~_tuple("c", fixed).eqNullSafe(_tuple("s", fixed)), "immutable field mismatch")
        .when(F.col("c._h") != F.col(f"s.{hash_column}"), "hash mismatch")
    )
    return joined.select(F.coalesce(f"c.{key}", f"s.{key}").alias(key), problem.alias("violation")).filter("violation IS NOT NULL")


def apply_changes(master: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Master with the changed rows written in; fails when the changes name a row twice or a missing row."""
    bad = changes.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).join(
        master.select(key, F.lit(True).alias("_known")), key, "left").filter("_n > 1 OR _known IS NULL")
    if bad.limit(1).count():
        raise ValueError("each change must name exactly one existing row")
    c = changes.select(key, F.struct(*columns).alias("_c"))
    return master.join(c, key, "left").select(*[
        F.when(F.col("_c").isNotNull(), F.col(f"_c.{x}")).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in master.columns])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
