"""Filter queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tallyloom.functions.text import career_key, upper_key
from tallyloom.operators import dashboard, filters, kpis, participants, scope
from tallyloom.plans.common import Facts
from tallyloom.plans.registry import query

GONE = "(lower({0}) LIKE 'discard%' OR lower({0}) IN ('invalid', 'invalid_text_fragment', 'descartado'))"


@query("flt01_current_jobs", "SELECT production_id FROM v_productions WHERE job_id IS NULL OR job_id IN (SELECT job_id FROM x_current)")
def _(t):
    return scope.keep_current(t.productions, Facts(t).current).select("production_id")


@query("flt02_audited_escape", "SELECT production_id FROM x_productions WHERE job_id IS NOT NULL AND job_id NOT IN (SELECT job_id FROM x_current)")
def _(t):
    f = Facts(t)
    audited = scope.audited_ids(t.audits, f.current, "scientific_production").withColumnRenamed("record_id", "production_id")
    return scope.flag_current(t.productions, f.current).filter("NOT in_current").join(audited, "production_id", "left_semi").select("production_id")


@query("flt03_effective_validated", """
SELECT production_id FROM v_productions p LEFT JOIN v_decisions d ON d.target_id = p.production_id AND d.approved
WHERE coalesce(d.scientific_status, p.validation_status) = 'validated'""")
def _(t):
    return scope.with_effective_status(t.productions, t.decisions, "production_id").filter("effective_status = 'validated'").select("production_id")


@query("flt04_discarded", f"SELECT author_id FROM v_authors WHERE {GONE.format('validation_status')}")
def _(t):
    return t.authors.filter(scope.is_discarded(F.col("validation_status"))).select("author_id")


@query("flt05_validated_products", "SELECT production_id FROM x_productions WHERE is_valid")
def _(t):
    return Facts(t).productions.filter("is_validated").select("production_id")


@query("flt06_visibility", f"SELECT production_id, CASE WHEN {GONE.format('eff')} THEN 'discarded' WHEN is_valid THEN 'eligible' ELSE 'pending' END AS visibility FROM x_productions")
def _(t):
    return Facts(t).productions.select("production_id", scope.visibility(F.col("effective_status"), F.col("is_validated")).alias("visibility"))


@query("flt07_role_identity", "SELECT role_id, identity_valid AS identity_validated FROM x_roles")
def _(t):
    return Facts(t).roles.select("role_id", "identity_validated")


@query("flt08_career_scope", """
SELECT role_id, career_id FROM x_roles WHERE career_id IS NOT NULL
UNION ALL SELECT r.role_id, c.career_id FROM x_roles r JOIN x_career_keys c ON contains(upper(r.affiliation), c.ck) OR contains(c.ck, upper(r.affiliation)) WHERE r.career_id IS NULL""")
def _(t):
    f = Facts(t)
    homes = t.externals.select("external_id", F.col("institution").alias("affiliation"))
    own = f.roles.filter("career_id IS NOT NULL").select("role_id", "career_id")
    away = f.roles.filter("career_id IS NULL").join(homes, "external_id")
    links = participants.career_links(away, t.careers)
    return own.unionByName(away.select("role_id", "affiliation").join(links, "affiliation").select("role_id", "career_id"))


@query("flt09_career_contains", """
SELECT p.production_id, t.career_id FROM x_productions p JOIN v_teachers t ON t.teacher_id = p.teacher_id
UNION SELECT p.production_id, c.career_id FROM x_productions p JOIN v_entities e ON e.entity_id = p.entity_id JOIN x_career_keys c
  ON contains(lower(e.career_name), lower(c.name)) OR contains(lower(e.career_name), lower(c.ck))""")
def _(t):
    return dashboard.production_career_scopes(Facts(t).productions, t.teachers, t.careers, t.entities)


@query("flt10_access_scope", """
SELECT u.user_id, count(*) AS visible FROM v_users u JOIN (SELECT t.teacher_id, c.career_id, c.faculty_id FROM v_teachers t JOIN v_careers c ON c.career_id = t.career_id) i
  ON (u.role = 'faculty_admin' AND u.faculty_id = i.faculty_id) OR (u.role = 'career_manager' AND u.career_id = i.career_id) GROUP BY 1""")
def _(t):
    items = t.teachers.join(t.careers.select("career_id", "faculty_id"), "career_id").select(
        "teacher_id", F.col("career_id").alias("scope_career_id"), F.col("faculty_id").alias("scope_faculty_id"))
    return filters.visible_to(items, t.users).groupBy("user_id").agg(F.count(F.lit(1)).alias("visible"))


@query("flt11_queue_filters", """
SELECT item_id FROM v_review_items WHERE case_status IN ('pending', 'reopened') AND case_type IN ('product_validation', 'identity_conflict')
  AND created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-20'""")
def _(t):
    return filters.queue_filter(
        t.review_items, statuses=["pending", "reopened"], case_types=["product_validation", "identity_conflict"],
        created_from=datetime(2024, 1, 5), created_to=datetime(2024, 1, 20)).select("item_id")


@query("flt12_literal_search", """
SELECT item_id FROM v_review_items i WHERE i.public_id ILIKE '%caso-1\\_0%' ESCAPE '\\' OR i.source_revision ILIKE '%rev-77%'
  OR EXISTS (SELECT 1 FROM v_targets t WHERE t.target_table = i.target_table AND t.target_pk = i.target_pk AND t.label ILIKE '%rev-77%')""")
def _(t):
    return filters.search(t.review_items, t.targets, "rev-77", ["public_id", "source_revision"]).select("item_id")


@query("flt12_literal_text", "SELECT doc_id FROM documents WHERE contains(lower(text), '%') OR contains(lower(source), '%')")
def _(t):
    from tallyloom.functions.text import contains_literal

    return t.documents.filter(contains_literal(F.col("text"), "%") | contains_literal(F.col("source"), "%")).select("doc_id")


@query("flt13_target_document", """
SELECT i.document_id, count(*) AS items FROM v_review_items i JOIN v_targets t ON t.target_table = i.target_table AND t.target_pk = i.target_pk AND t.job_id = i.document_id GROUP BY 1""")
def _(t):
    wanted = t.targets.filter("job_id IS NOT NULL").select("target_table", "target_pk", F.col("job_id").alias("document_id"))
    return t.review_items.join(wanted, ["target_table", "target_pk", "document_id"], "left_semi").groupBy("document_id").agg(F.count(F.lit(1)).alias("items"))


@query("flt14_progress_scope", """
SELECT t.trace_id, p.report_id IS NOT NULL AND p.yr = 1998 AND p.cycle = 1 AS in_scope,
  CASE WHEN p.report_id IS NULL THEN 'La traza no esta vinculada a un registro de avance del periodo filtrado.'
    WHEN p.yr = 1998 AND p.cycle = 1 AND k.report_id IS NOT NULL THEN ''
    WHEN k.report_id IS NULL THEN 'Excluido del Dashboard por deduplicacion de registros para periodo 1998 y ciclo 1.'
    ELSE 'Excluido del Dashboard por filtro de periodo 1998 y ciclo 1.' END AS exclusion_reason
FROM v_traces t LEFT JOIN v_progress p ON p.report_id = t.report_id LEFT JOIN x_progress_kept k ON k.report_id = p.report_id""")
def _(t):
    shown = kpis.dedupe_progress(t.progress.join(Facts(t).current, "job_id", "left_semi"), t.traces)
    return filters.progress_scope(t.traces, t.progress, shown, 1998, 1).select("trace_id", "in_scope", "exclusion_reason")


@query("flt15_progress_filters", """
SELECT p.report_id, c.career_id FROM v_progress p JOIN x_career_keys c
  ON trim(regexp_replace(replace(upper(trim(regexp_replace(p.career_name, ' +', ' ', 'g'))), 'LICENCIATURA EN ', ''), ' +', ' ', 'g')) = c.ck
WHERE p.job_id IN (SELECT job_id FROM x_current)""")
def _(t):
    names = t.careers.select("career_id", career_key(F.col("name")).alias("k"))
    rows = t.progress.join(Facts(t).current, "job_id", "left_semi").withColumn("k", career_key(upper_key(F.col("career_name"))))
    return rows.join(names, "k").select("report_id", "career_id")


@query("flt16_participant_filters", """
SELECT canonical_identity_key FROM x_participants p WHERE overall_status = 'validated' AND person_type = 'docente_interno' AND entity_count > 0
  AND EXISTS (SELECT 1 FROM x_resolved r WHERE r.key = p.canonical_identity_key AND r.role_type = 'director')
  AND EXISTS (SELECT 1 FROM x_resolved r WHERE r.key = p.canonical_identity_key AND r.affiliation ILIKE '%nation\\_1%' ESCAPE '\\')""")
def _(t):
    from tallyloom.functions.text import contains_literal

    f = Facts(t)
    keys = f.resolved.groupBy(F.col("key").alias("canonical_identity_key")).agg(
        F.bool_or(F.col("role_type") == "director").alias("a"),
        F.bool_or(F.coalesce(contains_literal(F.col("affiliation"), "nation_1"), F.lit(False))).alias("b")).filter("a AND b")
    people = f.participants.filter("overall_status = 'validated' AND person_type = 'docente_interno' AND entity_count > 0")
    return people.join(keys, "canonical_identity_key", "left_semi").select("canonical_identity_key")


@query("flt17_visibility_filter", f"SELECT production_id FROM x_productions WHERE NOT is_valid AND NOT {GONE.format('eff')}")
def _(t):
    bucket = scope.visibility(F.col("effective_status"), F.col("is_validated"))
    return Facts(t).productions.filter(bucket == "pending").select("production_id")


@query("flt18_bad_titles", """
WITH k AS (SELECT doc_id, trim(regexp_replace(strip_accents(upper(text)), '[\\s ]+', ' ', 'g')) AS k FROM documents)
SELECT doc_id, regexp_matches(k, 'AUTOR NO DETECTADO|DOCENTE NO DETECTADO|DIRECTOR NO DETECTADO|RESPONSABLE NO DETECTADO') AS placeholder,
  k = '' OR regexp_matches(k, 'EVIDENCIA|ANEXO|ADJUNTO|OBSERVACION|DESCRIPCION|RESUMEN|AVANCE|ACCIONES EJECUTADAS|ACTIVIDADES REALIZADAS|PIRAMIDE CIENTIFICA|INDEX PHP|HTTP|WWW|\\.COM|\\.NET|\\.ORG|DOI|ISSN|ISBN|/')
    OR list_contains(['A', 'AL', 'CON', 'DE', 'DEL', 'EL', 'EN', 'LA', 'LAS', 'LOS', 'PARA', 'POR', 'Y'], string_split(k, ' ')[-1]) AS bad_title FROM k""")
def _(t):
    return t.documents.select("doc_id", filters.is_placeholder_person(F.col("text")).alias("placeholder"), filters.is_bad_title(F.col("text")).alias("bad_title"))


@query("flt19_entity_list", """
SELECT e.entity_id FROM x_entities e WHERE e.validation_status = 'validated' AND e.status = 'Vigente' AND e.period_id = 19961
  AND EXISTS (SELECT 1 FROM x_entity_careers c WHERE c.entity_id = e.entity_id AND c.career_id = 1)""")
def _(t):
    f = Facts(t)
    rows = f.entities.filter("validation_status = 'validated' AND status = 'Vigente' AND period_id = 19961")
    return rows.join(f.entity_careers.filter("career_id = 1"), "entity_id", "left_semi").select("entity_id")


@query("flt20_research_types", "SELECT entity_id, entity_type FROM v_entities WHERE entity_type IN ('proyecto_fci', 'grupo_investigacion', 'semillero', 'informe_seguimiento')")
def _(t):
    return t.entities.filter(F.col("entity_type").isin(*filters.RESEARCH_TYPES)).select("entity_id", "entity_type")


@query("flt21_batch_jobs", """
SELECT coalesce(batch_id, job_id) AS batch, count(*) AS jobs, min(job_id) AS first_job FROM (SELECT job_id, CASE WHEN status = 'ERROR' THEN NULL ELSE batch_id END AS batch_id FROM v_jobs) j GROUP BY 1""")
def _(t):
    old = t.jobs.select("job_id", F.when(F.col("status") != "ERROR", F.col("batch_id")).alias("batch_id"))
    return old.groupBy(F.coalesce("batch_id", "job_id").alias("batch")).agg(F.count(F.lit(1)).alias("jobs"), F.min("job_id").alias("first_job"))


@query("flt22_role_scope", """
SELECT role_id, career_id FROM x_valid_roles WHERE career_id IS NOT NULL
UNION SELECT r.role_id, t.career_id FROM x_valid_roles r JOIN v_productions p ON p.production_id = r.production_id JOIN v_teachers t ON t.teacher_id = p.teacher_id""")
def _(t):
    rows = dashboard.with_production_career(Facts(t).valid_roles, t.productions, t.teachers)
    return kpis.scoped(rows, F.col("career_id"), F.col("production_career")).filter("scope_id >= 0").select("role_id", F.col("scope_id").alias("career_id"))


GATE = (("produccion_cientifica", "scientific_production"), ("integrantes", "teacher"), ("integrantes", "research_entity"))


@query("flt23_field_gate", """
SELECT audit_id FROM v_audits WHERE (source_section = 'produccion_cientifica' AND entity_type = 'scientific_production') OR (source_section = 'integrantes' AND entity_type IN ('teacher', 'research_entity'))""")
def _(t):
    pair = F.struct(F.col("source_section").alias("a"), F.col("entity_type").alias("b"))
    allowed = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in GATE]
    return t.audits.filter(pair.isin(*allowed)).select("audit_id")


@query("flt24_populations_for_jobs", """
SELECT DISTINCT j.batch_id, p.production_id FROM v_jobs j JOIN x_current c ON c.job_id = j.job_id JOIN v_productions p ON p.job_id = j.job_id
UNION SELECT j.batch_id, p.production_id FROM v_jobs j JOIN x_current c ON c.job_id = j.job_id
  JOIN v_audits a ON a.job_id = j.job_id AND a.entity_type = 'scientific_production' AND a.source_section = 'produccion_cientifica' JOIN v_productions p ON p.production_id = a.record_id""")
def _(t):
    live = t.jobs.select("job_id", "batch_id").join(Facts(t).current, "job_id", "left_semi")
    own = t.productions.select("job_id", "production_id").join(live, "job_id")
    seen = t.audits.filter("entity_type = 'scientific_production' AND source_section = 'produccion_cientifica'").select("job_id", F.col("record_id").alias("production_id"))
    seen = seen.join(live, "job_id").join(t.productions.select("production_id"), "production_id")
    return own.select("batch_id", "production_id").union(seen.select("batch_id", "production_id")).distinct()


@query("flt25_dimension_lists", """
SELECT 'career' AS kind, name AS label, career_id AS id FROM v_careers UNION ALL SELECT 'period', concat(yr, '-', cycle), period_id FROM v_periods""")
def _(t):
    careers = t.careers.orderBy("name").select(F.lit("career").alias("kind"), F.col("name").alias("label"), F.col("career_id").alias("id"))
    periods = t.periods.orderBy(F.col("yr").desc(), F.col("cycle").desc()).select(F.lit("period"), F.concat_ws("-", F.col("yr").cast("string"), F.col("cycle").cast("string")), "period_id")
    return careers.union(periods)


LOCAL = "regexp_replace(url, '^https?://[^/]*', '')"


@query("flt26_safe_paths", f"""
WITH p AS (SELECT page_id, {LOCAL} AS path FROM pages)
SELECT page_id, starts_with(path, '/') AND NOT contains(path, ':') AND NOT regexp_matches(path, '%[0-9A-Fa-f]{{2}}') AND length(path) <= 500
    AND len(list_filter(string_split(path[2:], '/'), lambda x: x IN ('', '.', '..'))) = 0 AS safe_path,
  false AS url_is_locator,
  NOT regexp_matches(path, '%[0-9A-Fa-f]{{2}}') AND NOT contains(path, ':') AND len(path) > 1 AND len(list_filter(string_split(path[2:], '/'), lambda x: x IN ('', '.', '..'))) = 0 AS safe_locator
FROM p""")
def _(t):
    rows = t.pages.select("page_id", "url", F.regexp_replace("url", "^https?://[^/]*", "").alias("path"))
    rows = rows.withColumn("safe_path", filters.is_safe_path(F.col("path"))).withColumn("row_locator", F.concat(F.lit("row:"), F.substring("path", 2, 1000)))
    rows = filters.with_safe_locator(filters.with_safe_locator(rows, "url", "url_is_locator"), "row_locator", "safe_locator")
    return rows.select("page_id", "safe_path", "url_is_locator", "safe_locator")
