"""Locked decisions written out as five linked tables that a repeated run leaves as they are."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.hashing import uuid5
from tallyloom.functions.stage import put
from tallyloom.functions.text import target_key
from tallyloom.operators.decisions import first_owner
from tallyloom.session import cut_lineage

# Name space and prefix of row ids, and the fields a locked decision sets.
ROW_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
ROW_PREFIX = "human-review-b2b1"
FIELDS = ("canonical_identity_key", "canonical_name")
IDS = ["table_name", "row_id"]
ROW = ["decision_id", "target_key", "field", "value"]


def row_id(domain: str, *key: Column) -> Column:
    return uuid5(F.concat_ws(":", F.lit(ROW_PREFIX), F.lit(domain), *key), ROW_NAMESPACE)


def divergences(plan: DataFrame) -> DataFrame:
    """(kind, key): identity keys with more than one name, aliases of more than one identity."""
    keyed = plan.select(F.explode(F.array(
        F.struct(F.lit("identity").alias("kind"), F.col("canonical_identity_key").alias("key"), F.col("canonical_name").alias("means")),
        F.struct(F.lit("alias").alias("kind"), target_key(F.col("alias")).alias("key"), F.col("canonical_identity_key").alias("means")))).alias("r")).select("r.*")
    spread = keyed.filter("key IS NOT NULL").groupBy("kind", "key").agg(F.min("means").alias("a"), F.max("means").alias("b"))
    return spread.filter("a <> b").select("kind", "key")


def locked_rows(plan: DataFrame) -> DataFrame:
    """The rows of all five tables: (table_name, row_id, decision_id, target_key, field, value).

    ``plan`` holds (target_key, canonical_identity_key, canonical_name, alias), one row a target. A decision sets its fields
    by overrides; the first target of an identity or alias makes that row, and each row made is told by an audit row. All
    ids follow from the keys, so the same plan gives the same rows in any order and on any number of tasks.
    """
    plan = plan.withColumn("_alias", target_key(F.col("alias")))
    owners = lambda key, flag: first_owner(plan.filter(F.col(key).isNotNull()).select(key, "target_key"), [key], "target_key").select("target_key", F.lit(True).alias(flag))
    plan = plan.join(owners("canonical_identity_key", "_makes_identity"), "target_key", "left").join(owners("_alias", "_makes_alias"), "target_key", "left")
    target = F.col("target_key")
    # ids stand in several rows each and are worked out once
    ids = {
        "_decision": row_id("decision", target), "_identity": row_id("canonical-identity", F.col("canonical_identity_key")),
        "_alias_id": F.when(F.col("_makes_alias"), row_id("person-alias", F.col("_alias"))), **{f"_{f}": row_id("field-override", target, F.lit(f)) for f in FIELDS}}
    for name, value in ids.items():
        plan = plan.transform(put, name, value)
    decision, identity, alias = F.col("_decision"), F.col("_identity"), F.col("_alias_id")
    override = lambda f: F.col(f"_{f}")

    def row(table: str, own: Column, field: Column, value: Column) -> Column:
        return F.struct(F.lit(table).alias("table_name"), own.alias("row_id"), decision.alias("decision_id"), target.alias("target_key"), field.alias("field"), value.alias("value"))

    told = lambda event, subject: row("audit", row_id("audit", F.lit(event), subject), F.lit(event), subject)
    rows = [
        row("decision", decision, F.lit("validated"), F.col("canonical_identity_key")),
        *[row("override", override(f), F.lit(f), F.col(f)) for f in FIELDS],
        F.when(F.col("_makes_identity"), row("identity", identity, F.col("canonical_identity_key"), F.col("canonical_name"))),
        F.when(F.col("_makes_alias"), row("alias", alias, F.col("_alias"), identity)),
        F.when(F.col("_makes_identity"), told("identity_created", identity)),
        F.when(F.col("_makes_alias"), told("alias_created", alias)),
        *[told("override_created", override(f)) for f in FIELDS],
        told("locked_decision_imported", decision),
    ]
    return plan.select(F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.*")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of every run the manifest names; a run that was lost before its manifest line does not count."""
    runs = _read(spark, f"{folder}/manifest")
    if runs is None:
        return None
    rows = spark.read.parquet(f"{folder}/rows")
    return rows.join(runs.select("run").distinct(), "run", "left_semi").select(*IDS, *ROW)


def materialize(plan: DataFrame, folder: str) -> int:
    """Write the rows of a plan that are not stored yet, all of them or none, and return their number.

    Rows go to a folder of the run; its line in the manifest is written last and makes them count. Ambiguous plans,
    and plans that say something else than what is stored under an id, raise ValueError before anything is written.
    """
    spark = plan.sparkSession
    plan = cut_lineage(plan)
    ambiguous = divergences(plan).count()
    if ambiguous:
        raise ValueError(f"{ambiguous} identities or aliases mean more than one thing")
    rows = locked_rows(plan)
    known = stored(spark, folder)
    if known is not None:
        said = known.select(*IDS, F.struct("field", "value").alias("_said"))
        rows = cut_lineage(rows.join(said, IDS, "left"))
        changed = rows.filter(F.col("_said").isNotNull() & ~F.col("_said").eqNullSafe(F.struct("field", "value"))).count()
        if changed:
            raise ValueError(f"{changed} stored rows differ from the plan")
        rows = rows.filter("_said IS NULL").drop("_said")
        if rows.isEmpty():
            return 0
    run = uuid.uuid4().hex
    rows.write.partitionBy("table_name").parquet(f"{folder}/rows/run={run}")
    written = _read(spark, f"{folder}/rows/run={run}")
    if written is None:
        return 0
    line = written.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("row_id", *ROW).cast("decimal(38,0)")).alias("digest"))
    line = cut_lineage(line.select(F.lit(run).alias("run"), "rows", "digest"))
    line.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return line.first()["rows"]
