"""Canonical participants: one identity population out of role rows and author rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import career_key, identity_name_key
from tallyloom.operators import matching, skew
from tallyloom.operators.scope import VALIDATED, is_discarded

AUTHOR_ROLE = "autor_producto"
# Person types from most to least preferred.
PERSON_TYPES = ("docente_interno", "investigador_externo", "estudiante", "graduado", "pendiente_clasificacion")
# Role types that make a person the head of a project.
DIRECTOR_ROLES = ("director", "director_proyecto", "coordinador", "tutor_semillero", "responsable_informe")


def person_type_of(column: Column) -> Column:
    return (
        F.when(column == "teacher", "docente_interno")
        .when(column.isin("external_researcher", "investigador_externo"), "investigador_externo")
        .when(column.isin("student", "estudiante"), "estudiante")
        .when(column.isin("graduate", "graduado"), "graduado")
        .otherwise("pendiente_clasificacion")
    )


def own_key(canonical: Column, person_key: Column, row_id: Column) -> Column:
    """Canonical key, else the person key, else a key of the row alone."""
    blank = F.lit("")
    return F.coalesce(
        F.nullif(canonical, blank),
        F.concat(F.lit("legacy:"), F.nullif(person_key, blank)),
        F.concat(F.lit("legacy-author:"), row_id.cast("string")),
    )


def evidence_jobs(productions: DataFrame, current: DataFrame, audits: DataFrame) -> DataFrame:
    """(production_id, evidence_job): own current job, else the lowest current job auditing it."""
    audited = (
        audits.filter(
            (F.col("entity_type") == "scientific_production") & (F.col("source_section") == "produccion_cientifica")
            & F.col("record_id").isNotNull()
        )
        .join(current, "job_id", "left_semi")
        .groupBy(F.col("record_id").alias("production_id")).agg(F.min("job_id").alias("_audit_job"))
    )
    own = productions.select("production_id", "job_id").join(
        current.withColumn("_own_job", F.col("job_id")), "job_id", "left"
    )
    return own.join(audited, "production_id", "left").select(
        "production_id", F.coalesce("_own_job", "_audit_job").alias("evidence_job")
    )


def role_mentions(
    roles: DataFrame, teachers: DataFrame, careers: DataFrame, externals: DataFrame, decisions: DataFrame
) -> DataFrame:
    """Operational role rows as mentions; discarded ones are still in, see ``status``."""
    people = teachers.join(careers.select("career_id", F.col("name").alias("_career")), "career_id").select(
        "teacher_id", F.col("career_id").alias("teacher_career"), "_career", F.col("institutional_email").alias("email")
    )
    homes = externals.select("external_id", F.col("institution").alias("_institution"))
    overlay = decisions.filter("approved").select(
        F.col("target_id").alias("role_id"),
        F.nullif(F.col("scientific_status"), F.lit("pending")).alias("_status"),
        F.col("identity_key").alias("overlay_key"), F.col("identity_name").alias("overlay_name"),
        F.col("scope").alias("overlay_scope"),
    )
    joined = roles.join(people, "teacher_id", "left").join(homes, "external_id", "left").join(overlay, "role_id", "left")
    return joined.select(
        "period_id", F.lit("person_roles").alias("source_table"), F.col("role_id").cast("string").alias("source_id"),
        own_key(F.col("canonical_key"), F.col("person_key"), F.col("role_id")).alias("source_key"),
        "overlay_key", "overlay_name", "overlay_scope",
        F.col("canonical_name").alias("row_name"), person_type_of(F.col("person_type")).alias("person_type"),
        "role_type", F.coalesce("_status", "validation_status").alias("status"),
        F.col("identity_locked").alias("locked"), "confidence",
        F.coalesce(F.concat(F.lit("job:"), F.col("job_id").cast("string")),
                   F.concat(F.lit("role:"), F.col("role_id").cast("string"))).alias("document"),
        "entity_id", F.lit(None).cast("long").alias("production_id"),
        F.coalesce("_career", "_institution").alias("affiliation"), "email", "reason",
        "teacher_career",
        F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("age"), F.col("role_id").alias("num"),
                 F.lit(0).alias("ord"), F.lit("").alias("txt")).alias("read_order"),
        F.col("role_id").alias("id_rank"),
    )


def products_of(productions: DataFrame, evidence: DataFrame) -> DataFrame:
    return productions.select(
        "production_id", "period_id", F.col("entity_id").alias("_entity"), F.col("created_at").alias("_made")
    ).join(evidence, "production_id", "left")


def _with_homes(rows: DataFrame, teachers: DataFrame, careers: DataFrame, externals: DataFrame) -> DataFrame:
    people = teachers.join(careers.select("career_id", F.col("name").alias("_career")), "career_id").select(
        "teacher_id", "_career"
    )
    homes = externals.select("external_id", F.col("institution").alias("_institution"))
    return rows.join(people, "teacher_id", "left").join(homes, "external_id", "left")


def author_mentions(
    authors: DataFrame, productions: DataFrame, evidence: DataFrame, teachers: DataFrame | None = None, careers: DataFrame | None = None,
    externals: DataFrame | None = None,
) -> DataFrame:
    """Authors of operational productions as mentions; without the tables of people their affiliation stays empty."""
    joined = authors.drop("entity_id", "created_at", "job_id").join(products_of(productions, evidence), "production_id")
    if teachers is None:
        joined = joined.select("*", F.lit(None).cast("string").alias("_career"), F.lit(None).cast("string").alias("_institution"))
    else:
        joined = _with_homes(joined, teachers, careers, externals)
    return joined.select(
        "period_id", F.lit("scientific_production_authors").alias("source_table"), F.col("author_id").alias("source_id"),
        own_key(F.col("canonical_key"), F.lit(None).cast("string"), F.col("author_id")).alias("source_key"),
        F.lit(None).cast("string").alias("overlay_key"), F.lit(None).cast("string").alias("overlay_name"),
        F.lit(None).cast("string").alias("overlay_scope"),
        F.col("canonical_name").alias("row_name"), "person_type", F.lit(AUTHOR_ROLE).alias("role_type"),
        F.col("validation_status").alias("status"), F.col("identity_locked").alias("locked"), "confidence",
        F.coalesce(F.concat(F.lit("job:"), F.col("evidence_job").cast("string")),
                   F.concat(F.lit("production:"), F.col("production_id").cast("string"))).alias("document"),
        F.col("_entity").alias("entity_id"), "production_id",
        F.coalesce("_career", "_institution").alias("affiliation"), F.lit(None).cast("string").alias("email"), "reason",
        F.lit(None).cast("long").alias("teacher_career"),
        F.struct(F.lit(1).alias("part"), (-F.unix_micros(F.col("_made").cast("timestamp"))).alias("age"), (-F.col("production_id")).alias("num"),
                 F.col("author_order").alias("ord"), F.col("author_id").alias("txt")).alias("read_order"),
        F.lit(None).cast("long").alias("id_rank"),
    )


def redirects(mentions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Own keys that global identity decisions send to exactly one other key."""
    sent = mentions.filter(
        F.col("overlay_key").isNotNull() & (F.col("overlay_scope") == "global_identity")
        & (F.col("overlay_key") != F.col("source_key"))
    )
    return (
        sent.groupBy(*(by or []), "source_key")
        .agg(F.count_distinct("overlay_key").alias("_targets"), F.min("overlay_key").alias("redirect_key"),
             F.max_by("overlay_name", "read_order").alias("redirect_name"))
        .filter("_targets = 1").drop("_targets")
    )


def redirect_keys(mentions: DataFrame, by: list[str]) -> DataFrame:
    """``redirects`` without the name."""
    return redirects(mentions.withColumns({"overlay_name": F.lit(None).cast("string"), "read_order": F.lit(0)}), by).drop("redirect_name")


def with_keys(mentions: DataFrame, moves: DataFrame, by: list[str]) -> DataFrame:
    """Adds the identity ``key`` alone; drops discarded mentions."""
    moved = mentions.filter(~is_discarded(F.col("status"))).join(moves, [*by, "source_key"], "left")
    return moved.withColumn("key", F.coalesce("overlay_key", "redirect_key", "source_key"))


def resolve_keys(mentions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds the identity ``key``, its ``name`` and ``by_review``; drops discarded mentions."""
    moved = mentions.join(redirects(mentions, by), [*(by or []), "source_key"], "left")
    return moved.filter(~is_discarded(F.col("status"))).select(
        "*",
        F.coalesce("overlay_key", "redirect_key", "source_key").alias("key"),
        F.coalesce("overlay_name", "redirect_name", "row_name").alias("name"),
        F.coalesce("overlay_key", "redirect_key").isNotNull().alias("by_review"),
    )


def _rank() -> Column:
    """Preference of a row as the one that names its identity: locked, confidence, lowest id, read first."""
    return F.struct(
        F.coalesce(F.col("locked"), F.lit(False)).cast("int").alias("locked"),
        F.coalesce(F.col("confidence"), F.lit(0.0)).alias("confidence"),
        (F.col("source_table") == "person_roles").cast("int").alias("role"),
        (-F.coalesce("id_rank", F.lit(0).cast("long"))).alias("id"),
        (-F.col("read_order.age")).alias("age"), (-F.col("read_order.num")).alias("num"),
        (-F.col("read_order.ord")).alias("ord"),
    )


def with_last_review(resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``_last``: where in read order the last reviewed row of the identity stands."""
    last = resolved.filter("by_review").groupBy(*keys).agg(F.max("read_order").alias("_last"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"m.{k}").eqNullSafe(F.col(f"l.{k}"))
    return resolved.alias("m").join(last.alias("l"), on, "left").select("m.*", "l._last")


def _type_rank() -> Column:
    return F.coalesce(*[F.when(F.col("person_type") == p, i) for i, p in enumerate(PERSON_TYPES)], F.lit(9))


def _standing() -> list[Column]:
    eligible = F.col("_any_valid") & ~F.col("key").startswith("pending:")
    return [eligible.alias("kpi_eligible"), F.when(eligible, "validated").otherwise("pending_review").alias("overall_status")]


def identity_counts(resolved: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What ``participant_metrics`` reads of ``canonical_participants``: no names, no join of reviews, other person types null.

    Documents, roles and productions are distinct rows of one long list, and only numbers are aggregated, so nothing is sorted.
    """
    keys = [*(by or []), "key"]
    values = (F.col("document"), F.when(F.col("source_table") == "person_roles", F.col("source_id")), F.col("production_id"))
    held = F.array(*[F.struct(F.lit(i).alias("kind"), v.cast("string").alias("value")) for i, v in enumerate(values)])
    rows = resolved.select(*keys, _type_rank().alias("_rank"), (F.col("status") == VALIDATED).alias("_valid"), F.explode(held).alias("m"))
    rows = rows.select(*keys, "_rank", "_valid", "m.kind", "m.value").filter("kind = 0 OR value IS NOT NULL")
    single = rows.groupBy(*keys, "kind", "value").agg(F.min("_rank").alias("_rank"), F.bool_or("_valid").alias("_valid"))
    count = lambda kind: F.count_if((F.col("kind") == kind) & F.col("value").isNotNull())
    grouped = single.groupBy(*keys).agg(
        count(0).alias("participation_count"), count(1).alias("role_count"), count(2).alias("authorship_count"),
        F.min("_rank").alias("_rank"), F.bool_or("_valid").alias("_any_valid"))
    kind = F.get(F.array(*[F.lit(p) for p in PERSON_TYPES]), F.col("_rank"))
    return grouped.select(
        *(by or []), F.col("key").alias("canonical_identity_key"), kind.alias("person_type"), "participation_count", "role_count", "authorship_count", *_standing())


def canonical_participants(resolved: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per identity (and per ``by`` columns) with counts, type, status and eligibility.

    A reviewed row names its identity when it is read; only a later row that ranks above it takes
    the name again, so the choice runs from the last reviewed row on. The lists of the identity
    (documents, entities, roles, ...) are rows of ``participant_members``.
    """
    by = list(by or [])
    keys = [*by, "key"]
    row = F.struct("name", "by_review", "locked", "confidence")
    considered = F.col("_last").isNull() | (F.col("read_order") >= F.col("_last"))
    grouped = with_last_review(resolved, keys).groupBy(*keys).agg(
        F.count_distinct("document").alias("participation_count"),
        F.count_distinct(F.when(F.col("source_table") == "person_roles", F.col("source_id"))).alias("role_count"),
        F.count_distinct("role_type").alias("role_type_count"),
        F.count_distinct("production_id").alias("authorship_count"),
        F.count_distinct("entity_id").alias("entity_count"),
        F.count(F.lit(1)).alias("evidence_count"),
        F.min(F.struct(_type_rank().alias("rank"), "person_type"))["person_type"].alias("person_type"),
        F.bool_or(F.col("status") == VALIDATED).alias("_any_valid"),
        F.max_by(row, F.when(considered, _rank())).alias("p"),
    )
    return grouped.select(
        *by, F.col("key").alias("canonical_identity_key"), F.col("p.name").alias("canonical_name"),
        F.when(F.col("p.by_review"), "human_review").otherwise("legacy_fallback").alias("identity_source"),
        (F.col("p.by_review") | F.coalesce("p.locked", F.lit(False))).alias("identity_locked"),
        F.col("p.confidence").alias("identity_confidence"), "person_type", "participation_count", "role_count",
        "role_type_count", "authorship_count", "entity_count", "evidence_count", *_standing(),
    )


def participant_members(resolved: DataFrame) -> DataFrame:
    """The sets an identity holds, one row per distinct member."""
    pending = F.when(F.col("status") != VALIDATED, F.coalesce("reason", "status"))
    kinds = {
        "person_type": F.col("person_type"), "role": F.col("role_type"), "document": F.col("document"),
        "research_entity": F.col("entity_id"), "authorship": F.col("production_id"), "status": F.col("status"),
        "pending_reason": pending, "affiliation": F.col("affiliation"), "email": F.col("email"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in kinds.items()])
    return (
        resolved.select(F.col("key").alias("canonical_identity_key"), F.explode(pairs).alias("m"))
        .select("canonical_identity_key", "m.kind", "m.value").filter("value IS NOT NULL").distinct()
    )


def participant_metrics(participants: DataFrame, by: list[str] | None = None) -> DataFrame:
    external = F.col("person_type") == "investigador_externo"
    return participants.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("canonical_identities"),
        F.coalesce(F.sum("participation_count"), F.lit(0)).alias("participations"),
        F.coalesce(F.sum("role_count"), F.lit(0)).alias("roles"),
        F.coalesce(F.sum("authorship_count"), F.lit(0)).alias("authorships"),
        F.count_if(F.col("overall_status") == "pending_review").alias("pending"),
        F.count_if(external).alias("external_detected"),
        F.count_if(external & F.col("kpi_eligible")).alias("external_kpi_eligible"),
        F.count_if(external & ~F.col("kpi_eligible")).alias("external_pending"),
    )


def possible_matches(participants: DataFrame) -> DataFrame:
    """Pending identities whose full name equals that of other pending identities.

    One row per identity with the number of others and the name group; the others are the rows of
    the same group, so no pair list is built.
    """
    pending = participants.filter(F.col("canonical_identity_key").startswith("pending:")).withColumn(
        "name_key", identity_name_key(F.col("canonical_name"))
    ).filter("name_key <> ''")
    groups = pending.groupBy("name_key").agg(F.count_distinct("canonical_identity_key").alias("_n")).filter("_n >= 2")
    return pending.join(groups, "name_key").select(
        "canonical_identity_key", "canonical_name", "name_key", (F.col("_n") - 1).alias("other_matches")
    )


def career_links(mentions: DataFrame, careers: DataFrame) -> DataFrame:
    """(affiliation, career_id) pairs by loose name match, for mentions without a teacher."""
    names = careers.select("career_id", career_key(F.col("name")).alias("right_key"))
    places = mentions.select("affiliation").filter("affiliation IS NOT NULL").distinct().withColumn(
        "left_key", career_key(F.col("affiliation"))
    )
    pairs = matching.loose_pairs(places.select("left_key"), names.select("right_key"))
    return places.join(pairs, "left_key").join(names, "right_key").select("affiliation", "career_id").distinct()
