"""Row filters and predicates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.people import has_piece
from tallyloom.functions.text import contains_literal, upper_key

# Markers of people that were never detected.
PLACEHOLDER_PEOPLE = ("AUTOR NO DETECTADO", "DOCENTE NO DETECTADO", "DIRECTOR NO DETECTADO", "RESPONSABLE NO DETECTADO")
# Markers of text that is no product title.
BAD_TITLE_WORDS = (
    "EVIDENCIA", "ANEXO", "ADJUNTO", "OBSERVACION", "DESCRIPCION", "RESUMEN", "AVANCE", "ACCIONES EJECUTADAS",
    "ACTIVIDADES REALIZADAS", "SE ADJUNTA", "LINK DE EVIDENCIA", "ENLACE DE EVIDENCIA", "PIRAMIDE CIENTIFICA",
    "INDEX PHP", "HTTP", "WWW", ".COM", ".NET", ".ORG", "DOI", "ISSN", "ISBN", "/",
)
# Words a title cannot end on.
DANGLING_WORDS = ("A", "AL", "CON", "DE", "DEL", "EL", "EN", "LA", "LAS", "LOS", "PARA", "POR", "Y")
# Entity types that count as research.
RESEARCH_TYPES = ("proyecto_fci", "grupo_investigacion", "semillero", "informe_seguimiento")
# Prefixes a row locator may start with.
LOCATOR_PREFIXES = (
    "product", "entity", "external", "produccion_cientifica", "participant", "row", "person_roles",
    "scientific_productions", "scientific_production_authors", "research_entities", "external_researchers",
)


def is_placeholder_person(name: Column) -> Column:
    return has_piece(upper_key(name), PLACEHOLDER_PEOPLE)


def is_bad_title(title: Column) -> Column:
    key = upper_key(title)
    last = F.element_at(F.split(key, " "), -1)
    return (key == "") | has_piece(key, BAD_TITLE_WORDS) | last.isin(*DANGLING_WORDS)


def visible_to(items: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, items.*): faculty admins see their faculty, career managers their career, others nothing."""
    admins = users.filter("role = 'faculty_admin' AND faculty_id IS NOT NULL").select("user_id", F.col("faculty_id").alias("scope_faculty_id"))
    managers = users.filter("role = 'career_manager' AND career_id IS NOT NULL").select("user_id", F.col("career_id").alias("scope_career_id"))
    columns = ["user_id", *items.columns]
    return items.join(admins, "scope_faculty_id").select(*columns).unionByName(
        items.join(managers, "scope_career_id").select(*columns)
    )


def queue_filter(
    items: DataFrame, *, statuses: list[str] | None = None, case_types: list[str] | None = None,
    source_revision: str | None = None, created_from: datetime | None = None, created_to: datetime | None = None,
) -> DataFrame:
    if created_from is not None and created_to is not None and created_from > created_to:
        raise ValueError("created_from must not be after created_to")
    if statuses:
        items = items.filter(F.col("case_status").isin(*statuses))
    if case_types:
        items = items.filter(F.col("case_type").isin(*case_types))
    if source_revision is not None:
        items = items.filter(F.col("source_revision") == source_revision)
    if created_from is not None:
        items = items.filter(F.col("created_at") >= F.lit(created_from))
    if created_to is not None:
        items = items.filter(F.col("created_at") <= F.lit(created_to))
    return items


def search(items: DataFrame, targets: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Items with the literal text in a column or in their target's label; ``documento N`` is an id."""
    hit = F.lit(False)
    for column in columns:
        hit = hit | contains_literal(F.col(column), text)
    labelled = targets.filter(contains_literal(F.col("label"), text)).select("target_table", "target_pk")
    number = text.strip().lower().removeprefix("documento").strip()
    if number.isdigit() and int(number) > 0:
        labelled = labelled.union(targets.filter(F.col("job_id") == int(number)).select("target_table", "target_pk"))
    marked = items.join(labelled.distinct().withColumn("_hit", F.lit(True)), ["target_table", "target_pk"], "left")
    return marked.filter(F.coalesce(hit, F.lit(False)) | F.col("_hit").isNotNull()).select(*items.columns)


def no_control_characters(value: Column) -> Column:
    return ~value.rlike("[\\x00-\\x1f\\x7f]")


def _plain_segments(path: Column) -> Column:
    return F.forall(F.split(path, "/", -1), lambda p: ~p.isin("", ".", ".."))


def _not_encoded(value: Column) -> Column:
    return ~value.rlike("%[0-9A-Fa-f]{2}")


def is_safe_locator(value: Column) -> Column:
    has_prefix = value.contains(":")
    prefix = F.lower(F.substring_index(value, ":", 1))
    body = F.when(has_prefix, F.expr("substring({0}, instr({0}, ':') + 1)".format("_v"))).otherwise(F.col("_v"))
    foreign = body.rlike(r"(?i)(?:^|[^a-z0-9_])(?:dropbox(?:_path)?|minio|s3|gs|file|https?|ftp|sftp|postgres(?:ql)?|redis|jdbc|urn):")
    drive = body.rlike(r"(?i)(?:^|[^a-z0-9])[a-z]:/")
    return F.coalesce(
        (F.trim(value) != "") & (value == F.trim(value)) & (F.length(value) <= 500) & no_control_characters(value)
        & ~value.contains("\\") & _not_encoded(value) & (~has_prefix | prefix.isin(*LOCATOR_PREFIXES))
        & ~foreign & ~drive & (F.trim(body) != "") & _plain_segments(body),
        F.lit(False),
    )


def with_safe_locator(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn("_v", F.col(column)).withColumn(name, is_safe_locator(F.col("_v"))).drop("_v")


def is_safe_path(value: Column) -> Column:
    return F.coalesce(
        value.startswith("/") & (F.length(value) <= 500) & ~value.contains("\\") & ~value.contains(":")
        & no_control_characters(value) & _not_encoded(value) & _plain_segments(F.substring(value, 2, 500)),
        F.lit(False),
    )


def progress_scope(traces: DataFrame, progress: DataFrame, shown: DataFrame, yr: int | None, cycle: int | None) -> DataFrame:
    """Per trace: in the period filter or not, shown on the dashboard or not, and why not."""
    rows = progress.select("report_id", F.col("yr").alias("_yr"), F.col("cycle").alias("_cycle"))
    joined = traces.join(rows, "report_id", "left").join(
        shown.select("report_id", F.lit(True).alias("_shown")), "report_id", "left"
    )
    if yr is None and cycle is None:
        return joined.withColumn("in_scope", F.lit(True)).withColumn("exclusion_reason", F.lit(""))
    match = F.col("_yr").isNotNull()
    parts = []
    if yr is not None:
        match = match & (F.col("_yr") == yr)
        parts.append(f"periodo {yr}")
    if cycle is not None:
        match = match & (F.col("_cycle") == cycle)
        parts.append(f"ciclo {cycle}")
    expected = " y ".join(parts)
    reason = (
        F.when(F.col("_yr").isNull(), "La traza no esta vinculada a un registro de avance del periodo filtrado.")
        .when(match & F.col("_shown").isNotNull(), "")
        .when(F.col("_shown").isNull(), f"Excluido del Dashboard por deduplicacion de registros para {expected}.")
        .otherwise(f"Excluido del Dashboard por filtro de {expected}.")
    )
    return joined.withColumn("in_scope", match).withColumn("exclusion_reason", reason)
