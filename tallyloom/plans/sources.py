"""Source, import and output queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.text import upper_key
from tallyloom.operators import compare, kpis
from tallyloom.plans.common import Facts
from tallyloom.plans.kpis import X_CAREER, _career_kpis
from tallyloom.plans.registry import query
from tallyloom.sources import ingest


@query("src01_read_table", """
SELECT p_partkey AS "P_PARTKEY", p_name AS "P_NAME", p_brand AS "P_BRAND", p_type AS "P_TYPE", p_size AS "P_SIZE", p_retailprice AS "P_RETAILPRICE" FROM part""")
def _(t):
    return ingest.read_table(t.spark, f"{t.sf_dir}/part.parquet")


@query("src02_required_columns", "SELECT 'CARRERA,METRICA' AS missing, count(*) AS row_count FROM part")
def _(t):
    table = ingest.read_table(t.spark, f"{t.sf_dir}/part.parquet")
    missing = ingest.missing_columns(table, ["P_NAME", "CARRERA", "P_SIZE", "METRICA"])
    return table.agg(F.lit(",".join(missing)).alias("missing"), F.count(F.lit(1)).alias("row_count"))


@query("src03_import_research_base", """
SELECT c_mktsegment AS faculty_name, CAST(c_custkey AS VARCHAR) AS national_id, c_name AS full_name, nullif(CASE WHEN c_acctbal < 0 THEN '' ELSE 'M' END, '') AS gender,
  CAST(c_nationkey AS VARCHAR) AS project_code FROM customer""")
def _(t):
    sheet = t.customer.select(
        F.concat(F.lit("  "), "c_mktsegment").alias("FACULTAD"), F.col("c_custkey").alias("CEDULA"), F.concat("c_name", F.lit(" ")).alias("APELLIDOS Y NOMBRES"),
        F.when(F.col("c_acctbal") < 0, "  ").otherwise("M").alias("GENERO"), F.col("c_nationkey").alias("CODIGO"))
    fields = {h: ingest.RESEARCH_BASE[h] for h in sheet.columns}
    return ingest.import_sheet(sheet, fields).drop("bad_numbers")


@query("src04_import_participants", """
SELECT CAST(l_orderkey AS VARCHAR) AS project_code, CAST(l_suppkey AS VARCHAR) AS participant_identifier, l_returnflag AS participant_type,
  CASE l_linestatus WHEN 'O' THEN CASE l_linenumber WHEN 7 THEN NULL ELSE CAST(trunc(l_quantity) AS INT) END ELSE 0 END AS assigned_hours,
  CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN 'assigned_hours' END AS bad_numbers FROM lineitem""")
def _(t):
    hours = F.when(F.col("l_linestatus") == "F", " ").when(F.col("l_linenumber") == 7, "diez").otherwise((F.col("l_quantity") + 0.5).cast("string"))
    sheet = t.lineitem.select(F.col("l_orderkey").alias("CODIGO"), F.col("l_suppkey").alias("IDENTIFICACION_CODIGO"),
                              F.col("l_returnflag").alias("TIPO_PARTICIPANTE"), hours.alias("HORAS"))
    return ingest.import_sheet(sheet, ingest.PARTICIPANTS, {"HORAS": "assigned_hours"})


@query("src05_import_progress", """
SELECT trim(career_name) AS career_name, CAST(yr AS VARCHAR) AS year_label, teacher_name, cycle, articles, books, book_chapters, presentations, projects, NULL::VARCHAR AS bad_numbers FROM v_progress""")
def _(t):
    sheet = t.progress.select(
        F.col("career_name").alias("CARRERA"), F.col("yr").alias("ANO"), F.col("teacher_name").alias("DOCENTE"), F.col("cycle").alias("CICLO"),
        F.col("articles").alias("ARTICULOS"), F.col("books").alias("LIBROS"), F.col("book_chapters").alias("CAPITULOS"),
        F.col("presentations").alias("PONENCIAS"), F.col("projects").alias("PROYECTOS"))
    return ingest.import_sheet(sheet, ingest.PROGRESS, {"CICLO": "cycle", **ingest.PROGRESS_COUNTS})


@query("src06_progress_json", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, props AS parsed_payload, 'PENDIENTE_REVISION' AS review_status FROM events""")
def _(t):
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    records, traces = ingest.progress_from_json(t.events, "props", schema, ["event_id"])
    return records.join(traces, "event_id")


X_GOAL_ROWS = """
WITH g AS (SELECT o_orderkey AS position, ' ' || lower(n_name) AS career_name, CAST(year(o_orderdate) AS INT) AS yr,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Articles' WHEN '2-HIGH' THEN ' books' WHEN '3-MEDIUM' THEN 'scientific_output' ELSE 'desconocida' END AS metric_name,
  CAST(trunc(o_totalprice / 1000) AS BIGINT) AS v, n_nationkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
acc AS (SELECT position, CAST(n_nationkey AS BIGINT) AS career_id, yr, upper(trim(metric_name)) AS metric, v AS planned_value FROM g WHERE metric_name <> 'desconocida' AND n_nationkey < 24)"""


def _goal_rows(t):
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    metric = F.when(F.col("o_orderpriority") == "1-URGENT", "Articles").when(F.col("o_orderpriority") == "2-HIGH", " books").when(
        F.col("o_orderpriority") == "3-MEDIUM", "scientific_output").otherwise("desconocida")
    rows = rows.select(
        F.col("o_orderkey").alias("position"), F.concat(F.lit(" "), F.lower("n_name")).alias("career_name"),
        F.year("o_orderdate").alias("yr"), metric.alias("metric_name"), (F.col("o_totalprice") / 1000).cast("string").alias("value"))
    known = t.careers.filter("career_id < 24")  # one career is not registered
    return ingest.import_goals(rows, known, kpis.GOAL_METRICS)


@query("src07_import_goals", X_GOAL_ROWS + """, n AS (SELECT career_id, yr, metric, planned_value FROM (SELECT *, row_number() OVER (PARTITION BY career_id, yr, metric ORDER BY position DESC) AS rn FROM acc) q WHERE rn = 1)
SELECT * FROM n UNION ALL SELECT g.career_id, g.yr, g.metric, g.planned_value FROM v_goals g WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.career_id = g.career_id AND n.yr = g.yr AND n.metric = g.metric)""")
def _(t):
    accepted, _rejected = _goal_rows(t)
    return ingest.upsert(t.goals, accepted, ["career_id", "yr", "metric"], "position")


@query("src07_rejected_goals", X_GOAL_ROWS + """
SELECT position, career_name, metric_name, CASE WHEN n_nationkey >= 24 THEN 'unknown career' ELSE 'unknown metric' END AS reject_reason FROM g WHERE metric_name = 'desconocida' OR n_nationkey >= 24""")
def _(t):
    return _goal_rows(t)[1]


@query("src08_upsert_goal", "SELECT career_id, yr, metric, CASE WHEN career_id = 7 AND yr = 1997 AND metric = 'BOOKS' THEN 99 ELSE planned_value END AS planned_value FROM v_goals")
def _(t):
    one = t.goals.filter("career_id = 7 AND yr = 1997 AND metric = 'BOOKS'").withColumn("planned_value", F.lit(99).cast("long")).withColumn("position", F.lit(1))
    return ingest.upsert(t.goals, one, ["career_id", "yr", "metric"], "position")


DOC_KEY = """CASE WHEN external_id IS NOT NULL THEN concat('store:', external_id)
  WHEN array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '/') <> '' THEN concat('store_path:/', lower(array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '/'))) ELSE '' END"""
FILES = f"""
WITH f AS (SELECT file_id, external_id, rev, nullif(trim(name), '') AS name, nullif(trim(path), '') AS path, size_bytes, {DOC_KEY} AS document_key,
  CASE WHEN external_id IS NOT NULL AND rev IS NOT NULL THEN concat('store:', external_id, ':', rev) WHEN {DOC_KEY} <> '' THEN concat('store_fallback:', {DOC_KEY}) ELSE '' END AS fingerprint FROM v_files)"""


@query("src09_intake", FILES + "SELECT * FROM f")
def _(t):
    return ingest.intake(t.files)


@query("src10_document_key", FILES + "SELECT file_id, document_key FROM f")
def _(t):
    return t.files.select("file_id", ingest.document_key(F.col("external_id"), F.col("path")).alias("document_key"))


@query("src11_fingerprint", FILES + "SELECT fingerprint, count(*) AS files FROM f GROUP BY 1")
def _(t):
    return t.files.groupBy(ingest.fingerprint(F.col("external_id"), F.col("rev"), F.col("path")).alias("fingerprint")).agg(F.count(F.lit(1)).alias("files"))


@query("src12_intake_dedupe", FILES + """, old AS (SELECT * FROM f WHERE size_bytes < 1500)
SELECT file_id, CASE WHEN fingerprint <> '' AND file_id > (SELECT min(g.file_id) FROM f g WHERE g.fingerprint = f.fingerprint AND g.size_bytes >= 1500) THEN 'duplicate_in_payload'
  WHEN external_id IS NOT NULL AND rev IS NOT NULL THEN CASE WHEN EXISTS (SELECT 1 FROM old WHERE old.document_key = f.document_key AND old.rev = f.rev) THEN 'already_stored' ELSE 'queued' END
  WHEN document_key <> '' AND EXISTS (SELECT 1 FROM old WHERE old.document_key = f.document_key) THEN 'already_stored' ELSE 'queued' END AS outcome
FROM f WHERE size_bytes >= 1500""")
def _(t):
    files = ingest.intake(t.files)
    return ingest.intake_dedupe(files.filter("size_bytes >= 1500"), files.filter("size_bytes < 1500")).select("file_id", "outcome")


@query("src13_already_processed", FILES + """, old AS (SELECT * FROM f WHERE size_bytes < 1500)
SELECT file_id FROM f WHERE CASE WHEN external_id IS NOT NULL AND rev IS NOT NULL THEN EXISTS (SELECT 1 FROM old WHERE old.external_id = f.external_id AND old.rev = f.rev)
  ELSE EXISTS (SELECT 1 FROM old WHERE upper(coalesce(old.path, old.name)) = upper(coalesce(f.path, f.name))) END""")
def _(t):
    files = ingest.intake(t.files)
    return ingest.already_processed(files, files.filter("size_bytes < 1500")).select("file_id")


@query("src14_sync_traces", """
SELECT trace_id, CASE WHEN trace_id = max(trace_id) OVER (PARTITION BY upper(source_path)) THEN 'created' ELSE 'skipped' END AS outcome FROM v_traces""")
def _(t):
    return ingest.sync_traces(t.traces.select("trace_id", "source_path"), "trace_id").select("trace_id", "outcome")


@query("src15_backfill_counts", """
SELECT count(*) AS scanned, count(*) FILTER (quality IS NULL AND contains(upper(text), 'UNIVERSI')) AS updated, count(*) FILTER (quality IS NOT NULL) AS skipped,
  count(*) FILTER (quality IS NULL AND NOT contains(upper(text), 'UNIVERSI')) AS still_empty FROM documents LEFT JOIN labels USING (doc_id)""")
def _(t):
    rows = t.documents.join(t.labels, "doc_id", "left")
    return ingest.backfill_counts(rows, F.col("quality").isNotNull(), upper_key(F.col("text")).contains("UNIVERSI"))


@query("src16_clear_generated", """
SELECT t.trace_id, CASE WHEN p.report_id IS NULL OR p.teacher_name LIKE 'Docente 1%' THEN CASE WHEN p.teacher_name LIKE 'Docente 1%' THEN NULL ELSE t.report_id END ELSE t.report_id END AS report_id FROM v_traces t LEFT JOIN v_progress p ON p.report_id = t.report_id""")
def _(t):
    _kept, freed = ingest.clear_generated(t.progress, "teacher_name", ["Docente 1"], "report_id", t.traces)
    return freed.select("trace_id", "report_id")


X_PURGE = """
WITH bj AS (SELECT job_id FROM v_jobs WHERE batch_id = 3), pp AS (SELECT 19961 AS period_id),
tt AS (SELECT teacher_id FROM v_teachers WHERE job_id IN (SELECT job_id FROM bj)),
ee AS (SELECT entity_id FROM v_entities WHERE job_id IN (SELECT job_id FROM bj) OR (job_id IS NULL AND period_id IN (SELECT period_id FROM pp))),
pr AS (SELECT production_id FROM v_productions WHERE job_id IN (SELECT job_id FROM bj) OR (job_id IS NULL AND period_id IN (SELECT period_id FROM pp))
  OR teacher_id IN (SELECT teacher_id FROM tt) OR entity_id IN (SELECT entity_id FROM ee))"""


@query("src17_purge_batch", X_PURGE + """
SELECT 'teachers' AS table_name, count(*) AS deleted FROM tt UNION ALL SELECT 'research_entities', count(*) FROM ee UNION ALL SELECT 'scientific_productions', count(*) FROM pr
UNION ALL SELECT 'person_roles', count(*) FROM v_roles WHERE job_id IN (SELECT job_id FROM bj) OR teacher_id IN (SELECT teacher_id FROM tt) OR production_id IN (SELECT production_id FROM pr) OR entity_id IN (SELECT entity_id FROM ee)
UNION ALL SELECT 'scientific_production_authors', count(*) FROM v_authors WHERE production_id IN (SELECT production_id FROM pr) OR job_id IN (SELECT job_id FROM bj) OR entity_id IN (SELECT entity_id FROM ee)
UNION ALL SELECT 'normalization_audits', count(*) FROM v_audits WHERE job_id IN (SELECT job_id FROM bj)""")
def _(t):
    jobs = t.jobs.filter("batch_id = 3")
    return ingest.purge_batch(jobs, t.periods.filter("period_id = 19961"), t.teachers, t.productions, t.entities, t.roles, t.authors, t.audits)


@query("src18_clean_invalid", """
WITH bad AS (SELECT production_id FROM v_productions WHERE contains(title, '2') AND false), fake AS (SELECT teacher_id FROM v_teachers WHERE false)
SELECT 'teachers' AS table_name, count(*) AS deleted FROM fake UNION ALL SELECT 'scientific_productions', (SELECT count(*) FROM v_productions WHERE production_type = 'OTHER' OR production_type = 'ARTICLE')
UNION ALL SELECT 'person_roles', (SELECT count(*) FROM v_roles r WHERE r.production_id IN (SELECT production_id FROM v_productions WHERE production_type IN ('OTHER', 'ARTICLE')))
UNION ALL SELECT 'scientific_production_authors', (SELECT count(*) FROM v_authors r WHERE r.production_id IN (SELECT production_id FROM v_productions WHERE production_type IN ('OTHER', 'ARTICLE')))""")
def _(t):
    titled = t.productions.withColumn("title", F.when(F.col("production_type").isin("OTHER", "ARTICLE"), F.concat("title", F.lit(" de"))).otherwise(F.col("title")))
    return ingest.clean_invalid(t.teachers, titled, t.roles, t.authors)


@query("src19_reset", """
SELECT 'teachers' AS table_name, count(*) AS deleted FROM v_teachers UNION ALL SELECT 'scientific_productions', count(*) FROM v_productions UNION ALL SELECT 'person_roles', count(*) FROM v_roles
UNION ALL SELECT 'scientific_production_authors', count(*) FROM v_authors UNION ALL SELECT 'research_entities', count(*) FROM v_entities UNION ALL SELECT 'import_jobs', count(*) FROM v_jobs
UNION ALL SELECT 'normalization_audits', count(*) FROM v_audits UNION ALL SELECT 'imported_traces', count(*) FROM v_traces UNION ALL SELECT 'imported_progress', count(*) FROM v_progress""")
def _(t):
    tables = {
        "teachers": t.teachers, "scientific_productions": t.productions, "person_roles": t.roles, "scientific_production_authors": t.authors,
        "research_entities": t.entities, "import_jobs": t.jobs, "normalization_audits": t.audits, "imported_traces": t.traces, "imported_progress": t.progress}
    return ingest.reset_tables(tables)[1]


SHEET = {
    "career_name": "Career", "total_teachers": "Teachers", "teachers_in_research_percent": "Research teachers %", "projects": "Projects",
    "scientific_output_total": "Scientific output", "planned_output": "Planned output", "output_compliance_percent": "POA compliance %",
    "output_variation_percent": "Cycle variation %"}


@query("src20_kpi_sheet", X_CAREER + """
SELECT career_name AS "Career", total_teachers AS "Teachers", teachers_in_research_percent AS "Research teachers %", projects AS "Projects", scientific_output_total AS "Scientific output",
  planned_output AS "Planned output", output_compliance_percent AS "POA compliance %", output_variation_percent AS "Cycle variation %" FROM ck WHERE period_id = 19981""")
def _(t):
    return _career_kpis(t).filter("period_id = 19981").select(*[F.col(c).alias(h) for c, h in SHEET.items()])


@query("src21_report_summary", X_CAREER + """
SELECT period_id, CAST(sum(total_teachers) AS BIGINT) AS teachers, CAST(sum(projects) AS BIGINT) AS projects, CAST(sum(scientific_output_total) AS BIGINT) AS output, CAST(sum(planned_output) AS BIGINT) AS planned FROM ck GROUP BY 1""")
def _(t):
    return _career_kpis(t).groupBy("period_id").agg(
        F.sum("total_teachers").alias("teachers"), F.sum("projects").alias("projects"), F.sum("scientific_output_total").alias("output"), F.sum("planned_output").alias("planned"))


@query("src22_alert_outbox", X_CAREER + """
SELECT period_id, career_id, career_name, CAST((planned_output > 0 AND output_compliance_percent < 70)::INT + (projects = 0)::INT AS BIGINT) AS alerts FROM ck""")
def _(t):
    rows = _career_kpis(t)
    counts = kpis.alerts(rows).groupBy("period_id", "career_id").agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(counts, ["period_id", "career_id"], "left").select("period_id", "career_id", "career_name", F.coalesce("_n", F.lit(0).cast("long")).alias("alerts"))


ROLE_COLUMNS = ["role_id", "canonical_key", "canonical_name", "role_type"]


@query("src23_snapshot_rows", """
SELECT role_id, sha256(concat_ws(chr(31), coalesce(canonical_key, '\\N'), canonical_name, role_id, role_type)) AS row_hash FROM v_roles""")
def _(t):
    return t.roles.select("role_id", compare.row_hash(ROLE_COLUMNS).alias("row_hash"))


@query("src24_simulation_rows", """
SELECT source_key, key AS resolved_key, count(*) AS rows_moved FROM x_resolved WHERE source_key <> key GROUP BY 1, 2""")
def _(t):
    return Facts(t).resolved.filter("source_key <> key").groupBy("source_key", F.col("key").alias("resolved_key")).agg(F.count(F.lit(1)).alias("rows_moved"))


@query("src25_update_review", """
SELECT t.trace_id, CASE WHEN l.quality = 1 THEN 'VALIDADO' WHEN l.quality = 0 AND l.toxic = 0 THEN 'RECHAZADO' ELSE t.review_status END AS review_status,
  CASE WHEN l.quality = 1 OR (l.quality = 0 AND l.toxic = 0) THEN concat('user', CAST(l.doc_id % 3 AS VARCHAR)) END AS reviewed_by FROM v_traces t LEFT JOIN labels l ON l.doc_id = t.trace_id""")
def _(t):
    state = F.when(F.col("quality") == 1, "VALIDADO").when(F.col("toxic") == 0, "RECHAZADO").otherwise("DESCONOCIDO")
    changes = t.labels.select(F.col("doc_id").alias("change_id"), F.col("doc_id").alias("trace_id"), state.alias("new_status"),
                              F.concat(F.lit("user"), (F.col("doc_id") % 3).cast("string")).alias("reviewed_by"))
    return ingest.update_review(t.traces.select("trace_id", "review_status"), changes)[0]


@query("src26_new_production_rules", """
SELECT p.production_id, CASE WHEN p.status = 'borrador' THEN 'teacher is required' WHEN t.teacher_id IS NULL THEN 'unknown teacher' WHEN p.production_type = 'ARTICLE' AND p.cycle = 2 THEN 'article needs a quartile' END AS reject_reason
FROM v_productions p LEFT JOIN v_teachers t ON t.teacher_id = p.teacher_id AND t.is_active""")
def _(t):
    rows = t.productions.select(
        "production_id", F.when(F.col("status") != "borrador", F.col("teacher_id")).alias("teacher_id"), "production_type",
        F.when(F.col("cycle") == 1, "Q1").otherwise(" ").alias("quartile"))
    return ingest.validate_new_productions(rows, t.teachers.filter("is_active")).select("production_id", "reject_reason")


@query("src27_apply_changes", """
SELECT teacher_id, CASE WHEN segment = 'BUILDING' THEN upper(full_name) ELSE full_name END AS full_name, CASE WHEN segment = 'BUILDING' THEN 0 ELSE research_hours END AS research_hours FROM v_teachers""")
def _(t):
    changes = t.teachers.filter("segment = 'BUILDING'").select("teacher_id", F.upper("full_name").alias("full_name"), F.lit(0).alias("research_hours"))
    return compare.apply_changes(t.teachers.select("teacher_id", "full_name", "research_hours"), changes, "teacher_id", ["full_name", "research_hours"])


@query("src28_batch_results", """
SELECT doc_id, CASE WHEN length(trim(text)) < 200 THEN 'text too short' WHEN length(text) <> n_chars THEN 'length mismatch' END AS error,
  CASE WHEN length(trim(text)) < 200 OR length(text) <> n_chars THEN 'ERROR' ELSE 'SUCCESS' END AS result FROM documents""")
def _(t):
    checks = [(F.length(F.trim("text")) < 200, "text too short"), (F.length("text") != F.col("n_chars"), "length mismatch")]
    return ingest.batch_results(t.documents.select("doc_id", "text", "n_chars"), checks).select("doc_id", "error", "result")
