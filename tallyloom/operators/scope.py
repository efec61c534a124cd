"""Row scoping: document versions, current jobs, audited rows, effective status, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import skew

VALIDATED = "validated"
OPEN_STATUSES = ("ERROR", "QUEUED", "PROCESSING")
ID_SLICE = 1_000_000


def promote_versions(jobs: DataFrame, id_slice: int = ID_SLICE) -> DataFrame:
    """Mark the highest finalized job of each document as current and link it to its predecessor.

    The outcome does not matter, only that the job is finalized; a job without a document key is
    never current.
    """
    final = jobs.filter(~F.col("status").isin(*OPEN_STATUSES) & F.col("document_key").isNotNull())
    linked = skew.previous(
        final.select("document_key", "job_id"),
        ["document_key"], [F.col("job_id")], F.floor(F.col("job_id") / id_slice), F.col("job_id"), "supersedes_id",
    ).select("job_id", "supersedes_id")
    newest = final.groupBy("document_key").agg(F.max("job_id").alias("job_id")).select(
        "job_id", F.lit(True).alias("is_current")
    )
    return (
        jobs.join(linked, "job_id", "left").join(newest, "job_id", "left")
        .withColumn("is_current", F.coalesce("is_current", F.lit(False)))
    )


def current_jobs(jobs: DataFrame) -> DataFrame:
    """Ids of jobs that readers see: newest finalized job of its document, and successful."""
    final = jobs.filter(~F.col("status").isin(*OPEN_STATUSES) & F.col("document_key").isNotNull())
    newest = final.groupBy("document_key").agg(F.max(F.struct("job_id", "status")).alias("j"))
    return newest.filter(F.col("j.status") == "SUCCESS").select(F.col("j.job_id").alias("job_id"))


def audited_ids(audits: DataFrame, current: DataFrame, entity_type: str) -> DataFrame:
    """Ids that an audit row of a current job points at."""
    return (
        audits.filter((F.col("entity_type") == entity_type) & F.col("record_id").isNotNull())
        .join(current, "job_id", "left_semi").select("record_id").distinct()
    )


def flag_current(df: DataFrame, current: DataFrame, name: str = "in_current") -> DataFrame:
    """True where the row has no job or its job is current."""
    marked = df.join(current.withColumn("_hit", F.lit(True)), "job_id", "left")
    return marked.withColumn(name, F.col("job_id").isNull() | F.col("_hit").isNotNull()).drop("_hit")


def keep_current(df: DataFrame, current: DataFrame) -> DataFrame:
    return flag_current(df, current, "_keep").filter("_keep").drop("_keep")


def keep_operational(df: DataFrame, id_column: str, current: DataFrame, audited: DataFrame) -> DataFrame:
    """Current rows, plus rows of old jobs that a current job's audit still points at."""
    flagged = flag_current(df, current, "_keep").join(
        audited.select(F.col("record_id").alias(id_column), F.lit(True).alias("_audited")), id_column, "left"
    )
    return flagged.filter(F.col("_keep") | F.col("_audited").isNotNull()).select(*df.columns)


def is_discarded(status: Column) -> Column:
    key = F.lower(F.coalesce(status, F.lit("")))
    return key.startswith("discard") | key.isin("invalid", "invalid_text_fragment", "descartado")


def with_effective_status(df: DataFrame, decisions: DataFrame, id_column: str) -> DataFrame:
    """Status after approved decisions; a pending decision does not override the row."""
    overlay = decisions.filter("approved").select(
        F.col("target_id").alias(id_column), F.nullif(F.col("scientific_status"), F.lit("pending")).alias("_over")
    )
    return df.join(overlay, id_column, "left").withColumn(
        "effective_status", F.coalesce("_over", "validation_status")
    ).drop("_over")


def with_validated_author(productions: DataFrame, authors: DataFrame) -> DataFrame:
    """Adds ``is_validated``: own effective status and at least one validated author."""
    backed = authors.filter(F.col("validation_status") == VALIDATED).select("production_id").distinct()
    joined = productions.join(backed.withColumn("_backed", F.lit(True)), "production_id", "left")
    return joined.withColumn(
        "is_validated", (F.col("effective_status") == VALIDATED) & F.col("_backed").isNotNull()
    ).drop("_backed")


def visibility(status: Column, validated: Column) -> Column:
    return F.when(is_discarded(status), "discarded").when(validated, "eligible").otherwise("pending")


def with_role_identity(roles: DataFrame, teachers: DataFrame, externals: DataFrame) -> DataFrame:
    """Adds ``identity_validated``: validated teacher, or external that needs no review."""
    t = teachers.select("teacher_id", "career_id", (F.col("validation_status") == VALIDATED).alias("_teacher_ok"))
    e = externals.select("external_id", (~F.col("requires_review")).alias("_external_ok"))
    joined = roles.join(t, "teacher_id", "left").join(e, "external_id", "left")
    return joined.withColumn(
        "identity_validated",
        F.when(F.col("person_type") == "teacher", F.coalesce("_teacher_ok", F.lit(False)))
        .when(F.col("person_type") == "external_researcher", F.coalesce("_external_ok", F.lit(False)))
        .otherwise(F.lit(False)),
    ).drop("_teacher_ok", "_external_ok")
