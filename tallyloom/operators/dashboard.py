"""The dashboard row, for one period or as a matrix over all periods and careers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.numbers import percent
from tallyloom.functions.text import upper_key
from tallyloom.operators import kpis, matching, participants
from tallyloom.operators.scope import VALIDATED, is_discarded
from tallyloom.session import cut_lineage, written

KEYS = ["period_id", "scope_id"]
ROLE_MEASURES = ["total_teachers", "internal_fca_count", "internal_other_faculty_count"]
PRODUCT_MEASURES = [
    "scientific_output_total", "scientific_output_published", "scientific_output_in_review",
    "scientific_output_detected", "scientific_output_kpi_eligible", "scientific_output_pending_review",
    "scientific_output_discarded",
]
PROJECT_MEASURES = ["projects_total", "projects_current", "projects_approved", "projects_average_progress_percent"]
ENTITY_MEASURES = [
    "research_entities_detected", "research_entities_kpi_eligible", "research_entities_pending_review",
    "research_entities_excluded",
]
PEOPLE_MEASURES = [
    "canonical_identities_count", "participant_appearances_count", "participant_roles_count", "authorships_count",
    "pending_participants_count", "external_researchers_detected", "external_researchers_kpi_eligible",
    "external_researchers_pending_review",
]
REPORT_MEASURES = ["reports_received", "reports_requires_review"]
MEASURES = [
    *REPORT_MEASURES, *ROLE_MEASURES, *PRODUCT_MEASURES, *PROJECT_MEASURES, *ENTITY_MEASURES, *PEOPLE_MEASURES,
    "discarded_participants_count",
]


def with_own_faculty(roles: DataFrame, careers: DataFrame, faculties: DataFrame) -> DataFrame:
    home = careers.join(faculties.select("faculty_id", F.col("name").alias("_faculty")), "faculty_id").select(
        "career_id", upper_key(F.col("_faculty")).contains("CIENCIAS ADMINISTRATIVAS").alias("own_faculty")
    )
    return roles.join(home, "career_id", "left")


def with_production_career(roles: DataFrame, productions: DataFrame, teachers: DataFrame) -> DataFrame:
    owner = productions.select("production_id", "teacher_id").join(
        teachers.select("teacher_id", "career_id"), "teacher_id"
    ).select("production_id", F.col("career_id").alias("production_career"))
    return roles.join(owner, "production_id", "left")


def progress_counts(progress: DataFrame, traces: DataFrame, current: DataFrame, periods: DataFrame) -> DataFrame:
    """Reports per period: only rows of a current job, deduped."""
    rows = kpis.dedupe_progress(progress.join(current, "job_id", "left_semi"), traces)
    return rows.groupBy("yr", "cycle").agg(
        F.count(F.lit(1)).alias("reports_received"),
        F.count_if(F.col("trace_status").isin(*kpis.REVIEW_STATUSES)).alias("reports_requires_review"),
    ).join(periods, ["yr", "cycle"]).select("period_id", *REPORT_MEASURES)


# Columns of mentions that the dashboard reads.
MENTION_COLUMNS = ["period_id", "source_table", "source_id", "source_key", "overlay_key", "overlay_scope", "person_type", "status", "document", "production_id"]


def mention_scopes(roles: DataFrame, authors: DataFrame, productions: DataFrame, teachers: DataFrame, careers: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions of roles and of authors repeated for the total and for each career they fall in.

    The careers of products are joined to the authors by the key that joined these to their products, so their rows are
    shuffled once; only columns that are read go on.
    """
    places = written(participants.career_links(roles, careers), "places").groupBy("affiliation").agg(
        F.collect_set("career_id").alias("_place_careers")
    )
    product = production_career_scopes(productions, teachers, careers, entities).groupBy("production_id").agg(
        F.collect_set("career_id").alias("_product_careers")
    )
    none = F.array().cast("array<bigint>")
    role_ids = F.when(F.col("teacher_career").isNotNull(), F.array("teacher_career")).otherwise(F.coalesce("_place_careers", none))
    total = F.array(F.lit(kpis.TOTAL).cast("long"))
    at = lambda df, ids: df.select(*MENTION_COLUMNS, F.explode(F.array_distinct(F.concat(total, ids))).alias("scope_id"))
    of_roles = at(roles.join(places, "affiliation", "left"), role_ids)
    of_authors = at(authors.join(product, "production_id", "left"), F.coalesce("_product_careers", none))
    return of_roles.unionByName(of_authors)


def production_career_scopes(productions: DataFrame, teachers: DataFrame, careers: DataFrame, entities: DataFrame) -> DataFrame:
    """(production_id, career_id): own teacher's career, or a career name inside the entity's career name."""
    own = productions.select("production_id", "teacher_id").join(teachers.select("teacher_id", "career_id"), "teacher_id").select(
        "production_id", "career_id"
    )
    names = careers.select("career_id", F.explode(F.array_distinct(F.array(
        F.lower("name"), F.lower(_short_name(F.col("name"))))) ).alias("part"))
    texts = entities.select("entity_id", F.lower("career_name").alias("whole"))
    pairs = matching.contained_pairs(texts.select("whole"), names.select("part"))
    named = texts.join(pairs, "whole").join(names, "part").select("entity_id", "career_id").distinct()
    by_entity = productions.select("production_id", "entity_id").join(named, "entity_id").select("production_id", "career_id")
    return own.union(by_entity).distinct()


def _short_name(name: Column) -> Column:
    from tallyloom.functions.text import career_key

    return career_key(name)


def matrix(facts, period_ids: list[int] | None = None) -> DataFrame:
    """One row per (period, scope) with every dashboard measure; scope -1 covers all careers.

    Each fact is aggregated once; the small results are then stacked. ``period_ids`` narrows every
    fact before any shuffle.
    """
    t = facts.t

    def cut(df: DataFrame) -> DataFrame:
        return df if period_ids is None else df.filter(F.col("period_id").isin(*period_ids))

    valid_roles = with_production_career(
        with_own_faculty(cut(facts.valid_roles), t.careers, t.faculties), t.productions, t.teachers
    )
    roles = kpis.scoped(valid_roles, F.col("career_id"), F.col("production_career"))
    people = kpis.teacher_counts(roles, KEYS)

    owned = cut(facts.productions).join(t.teachers.select("teacher_id", F.col("career_id").alias("_career")), "teacher_id", "left")
    products = kpis.scoped(owned, F.col("_career"))
    kind = kpis.status_class(F.col("status"))
    gone = is_discarded(F.col("effective_status"))
    output = products.groupBy(*KEYS).agg(
        F.count_if("is_validated").alias("scientific_output_total"),
        F.count_if(F.col("is_validated") & (kind == "published")).alias("scientific_output_published"),
        F.count_if(F.col("is_validated") & (kind == "in_review")).alias("scientific_output_in_review"),
        F.count_if(~gone).alias("scientific_output_detected"),
        F.count_if("is_validated").alias("scientific_output_kpi_eligible"),
        F.count_if(~F.col("is_validated") & ~gone).alias("scientific_output_pending_review"),
        F.count_if(gone).alias("scientific_output_discarded"),
    )

    entity_scope = facts.entity_careers.groupBy("entity_id").agg(F.collect_set("career_id").alias("_careers"))
    base = cut(facts.entities).join(entity_scope, "entity_id", "left")
    ids = F.concat(F.array(F.lit(kpis.TOTAL).cast("long")), F.coalesce("_careers", F.array().cast("array<bigint>")))
    scoped_entities = base.withColumn("scope_id", F.explode(ids))
    projects = kpis.renamed(kpis.project_counts(scoped_entities, KEYS), {
        "total": "projects_total", "current": "projects_current", "approved": "projects_approved",
        "average_progress": "projects_average_progress_percent"})
    reconciled = kpis.renamed(kpis.entity_reconciliation(scoped_entities, KEYS), {
        "detected": "research_entities_detected", "eligible": "research_entities_kpi_eligible",
        "pending": "research_entities_pending_review", "excluded": "research_entities_excluded"})

    authors = participants.author_mentions(t.authors, cut(facts.productions), facts.evidence)
    mentions = cut_lineage(
        mention_scopes(cut(facts.role_mentions), authors, cut(facts.productions), t.teachers, t.careers, t.entities)
    )
    resolved = participants.with_keys(mentions, written(participants.redirect_keys(mentions, KEYS), "redirects"), KEYS)
    metrics = participants.participant_metrics(participants.identity_counts(resolved, KEYS), KEYS)
    metrics = kpis.renamed(metrics, dict(zip(
        ["canonical_identities", "participations", "roles", "authorships", "pending", "external_detected",
         "external_kpi_eligible", "external_pending"], PEOPLE_MEASURES)))
    dropped = mentions.filter(is_discarded(F.col("status"))).groupBy(*KEYS).agg(
        F.count_distinct(F.coalesce("overlay_key", "source_key")).alias("discarded_participants_count")
    )
    cells = kpis.stack_frames(
        [people, output, projects, reconciled, metrics, dropped], KEYS,
        [m for m in MEASURES if m not in REPORT_MEASURES],
    )
    periods = cut(t.periods)
    scopes = t.careers.select(F.explode(F.array(F.lit(kpis.TOTAL).cast("long"), F.col("career_id").cast("long"))).alias("scope_id")).distinct()
    grid = kpis.grid(periods.select("period_id"), scopes)
    reports = progress_counts(t.progress, t.traces, facts.current, periods)
    joined = grid.join(cells, KEYS, "left").join(reports, "period_id", "left")
    return joined.select(
        *KEYS, *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in MEASURES],
        percent(F.coalesce("total_teachers", F.lit(0)), F.coalesce("total_teachers", F.lit(0))).alias("teachers_in_research_percent"),
    )


def single(facts, yr: int, cycle: int, career_id: int | None = None) -> DataFrame:
    """The one dashboard row of a period; zeros and a notice when the period is unknown."""
    period_id = yr * 10 + cycle
    known = matrix(facts, [period_id]).filter(F.col("scope_id") == (kpis.TOTAL if career_id is None else career_id))
    sums = known.agg(
        *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in (*MEASURES, "teachers_in_research_percent")],
        F.when(F.count(F.lit(1)) == 0, F.lit(kpis.NO_PERIOD)).alias("alert"),
    )
    return sums.select(F.lit(yr).alias("yr"), F.lit(cycle).alias("cycle"), "*")


def validated_total(statuses: Column) -> Column:
    return F.count_if(statuses == VALIDATED)
