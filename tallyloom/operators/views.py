"""Read models for people, productions, entities and reports, in flat rows instead of nested lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import collapse
from tallyloom.operators.participants import DIRECTOR_ROLES
from tallyloom.operators.scope import VALIDATED, is_discarded


def effective_names(roles: DataFrame, people: DataFrame) -> DataFrame:
    """Reviewed name of a teacher when all validated reviews agree on one identity, else the own name."""
    reviewed = roles.filter("teacher_id IS NOT NULL AND overlay_key IS NOT NULL AND overlay_name IS NOT NULL AND effective_status = 'validated'")
    pair = F.concat_ws("\x1f", "overlay_key", "overlay_name")
    one = reviewed.groupBy("teacher_id").agg(F.min(pair).alias("a"), F.max(pair).alias("b"), F.min("overlay_name").alias("_name")).filter("a = b")
    return people.join(one.select("teacher_id", "_name"), "teacher_id", "left").select(
        "teacher_id", F.coalesce("_name", "full_name").alias("full_name"), F.col("_name").isNotNull().alias("reviewed"))


def participant_state(status: Column, identity_validated: Column, role_type: Column) -> Column:
    """struct(rank, bucket, eligible): valid person, pending merge, pending author, pending person, or invalid text."""
    key = F.lower(status)
    author = (role_type == "autor_producto") | key.contains("author") | key.contains("autor")
    row = lambda rank, bucket, ok: F.struct(F.lit(rank).alias("rank"), F.lit(bucket).alias("bucket"), F.lit(ok).alias("eligible"))
    return (
        F.when(is_discarded(status), row(0, "invalid_text_fragment", False)).when((status == VALIDATED) & identity_validated, row(3, "valid_person", True))
        .when(key.contains("merge"), row(2, "pending_merge", False)).when(author, row(1, "pending_author_classification", False))
        .otherwise(row(1, "pending_person", False)))


def participant_states(roles: DataFrame) -> DataFrame:
    """The best state of each identity; the role read first decides ties."""
    df = roles.withColumn("_s", participant_state(F.col("effective_status"), F.col("identity_validated"), F.col("role_type"))).filter("_s.rank > 0")
    return df.groupBy("key").agg(
        F.max_by(F.struct(F.col("_s.bucket").alias("bucket"), F.col("_s.eligible").alias("eligible"), "person_type"), F.struct(F.col("_s.rank"), -F.col("role_id"))).alias("b")
    ).select("key", F.col("b.bucket").alias("review_bucket"), F.col("b.eligible").alias("kpi_eligible"), F.col("b.person_type").alias("person_type"))


def state_summary(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    is_bucket = lambda b: F.count_if(F.col("review_bucket") == b)
    return states.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("person_type") == "docente_interno").alias("docente_interno"),
        F.count_if(F.col("person_type") == "investigador_externo").alias("investigador_externo"), F.count_if("kpi_eligible").alias("kpi_eligible"),
        is_bucket("pending_person").alias("pending_people_count"), is_bucket("pending_author_classification").alias("pending_author_classification_count"),
        is_bucket("pending_merge").alias("pending_merge_count"))


def director_states(entities: DataFrame, roles: DataFrame, participants: DataFrame) -> DataFrame:
    """Director of each project: preferred head role, its identity and the three status labels.

    ``roles`` holds resolved identity keys of current role rows.
    """
    heads = roles.filter(F.col("role_type").isin(*DIRECTOR_ROLES))
    order = F.struct(F.col("identity_locked").cast("int"), F.coalesce("confidence", F.lit(0.0)), -F.col("role_id"))
    lead = heads.groupBy("entity_id", "period_id").agg(F.max_by("key", order).alias("director_key"), F.max_by("name", order).alias("_name"))
    related = heads.groupBy("entity_id", "period_id", F.col("key").alias("director_key")).agg(F.bool_or(F.col("effective_status") == VALIDATED).alias("_valid"))
    known = participants.select(F.col("canonical_identity_key").alias("director_key"), F.col("canonical_name").alias("_canonical"), "overall_status")
    joined = entities.join(lead, ["entity_id", "period_id"], "left").join(related, ["entity_id", "period_id", "director_key"], "left").join(known, "director_key", "left")
    found = F.col("director_key").isNotNull()
    relation = F.when(~found, "not_detected").when(F.col("_valid"), "validated").otherwise("pending_review")
    identity = F.when(~found, "not_resolved").otherwise(F.coalesce("overall_status", F.lit("pending_review")))
    labels = {
        "identity": {"validated": "identidad validada", "pending_review": "identidad pendiente", "not_resolved": "identidad no resuelta"},
        "relation": {"validated": "relación como director validada", "pending_review": "relación como director pendiente", "not_detected": "relación como director no detectada"},
    }
    pick = lambda kind, c: F.element_at(F.create_map(*[F.lit(x) for p in labels[kind].items() for x in p]), c)
    project = F.when(F.col("validation_status") == VALIDATED, "Proyecto validado").otherwise("Proyecto pendiente")
    return joined.select(
        "entity_id", "director_key", F.coalesce("_canonical", "_name", "director_name").alias("director_name"), relation.alias("relationship_status"),
        identity.alias("identity_status"), F.concat_ws(" / ", project, pick("identity", identity), pick("relation", relation)).alias("display_status"))


def affiliation(*choices: Column) -> Column:
    """The first non-blank of teacher career, reviewed institution, own institution and noted values."""
    return F.coalesce(*[F.nullif(collapse(c), F.lit("")) for c in choices])


def effective_products(productions: DataFrame, authors: DataFrame) -> DataFrame:
    """(production, author) rows that a report shows: discarded authors dropped, products without authors dropped."""
    kept = authors.filter(~is_discarded(F.col("validation_status"))).select("production_id", "author_id", "author_order", F.col("validation_status").alias("author_status"))
    return productions.join(kept, "production_id")
