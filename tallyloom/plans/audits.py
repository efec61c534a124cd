"""Audit, redaction and report-level queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import redact
from tallyloom.functions.fuzzy import token_share
from tallyloom.functions.people import has_piece
from tallyloom.functions.text import alnum_key, name_tokens, upper_key
from tallyloom.operators import audit as A, legacy
from tallyloom.operators import extract, kpis, layouts, lines, views
from tallyloom.plans.common import Facts
from tallyloom.plans.participants import X_STATES, _states
from tallyloom.plans.registry import query
from tallyloom.plans.text import PEOPLE, _general_docs, _sections, member_docs, pick_one
from tallyloom.session import cut_lineage, work_folder



def _chain(t):
    return A.chain_events(t.audit_events)


@query("au01_event_chain")
def _(t):
    return _chain(t).select("aggregate_key", "seq", "event_hash")


@query("au02_chain_check", """
SELECT aggregate_key, seq, 'hash mismatch' AS violation FROM v_audit_events WHERE aggregate_key % 10 = 3 AND seq = 1
UNION ALL SELECT aggregate_key, seq, 'unknown predecessor' FROM (SELECT *, lag(seq) OVER (PARTITION BY aggregate_key ORDER BY seq) AS p FROM v_audit_events WHERE NOT (aggregate_key % 10 = 7 AND seq = 0)) e WHERE aggregate_key % 10 = 7 AND seq = 1""")
def _(t):
    edited = F.when((F.col("aggregate_key") % 10 == 3) & (F.col("seq") == 1), F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))
    stored = cut_lineage(_chain(t).withColumn("payload", edited).filter("NOT (aggregate_key % 10 = 7 AND seq = 0)"))
    return A.verify_chain(stored, F.floor(F.col("seq") / 100_000))


@query("au03_chain_heads", "SELECT aggregate_key, max(seq) AS seq FROM v_audit_events GROUP BY 1")
def _(t):
    return A.chain_heads(_chain(t)).select("aggregate_key", "seq")


@query("au04_corrections", """
SELECT e.case_id, e.seq, e.reverts_seq, o.seq IS NOT NULL AS linked FROM v_decision_log e LEFT JOIN v_decision_log o ON o.case_id = e.case_id AND o.seq = e.reverts_seq WHERE e.reverts_seq IS NOT NULL""")
def _(t):
    target = t.decision_log.select("case_id", F.col("seq").alias("reverts_seq"), F.lit(True).alias("_known"))
    return t.decision_log.filter("reverts_seq IS NOT NULL").join(target, ["case_id", "reverts_seq"], "left").select("case_id", "seq", "reverts_seq", F.col("_known").isNotNull().alias("linked"))


@query("au08_job_diagnostics", """
SELECT j.batch_id, count(*) AS jobs, count(t.trace_id) AS traced, CAST(coalesce(sum(t.n_chars), 0) AS BIGINT) AS chars, count(p.production_id) AS productions FROM v_jobs j
LEFT JOIN (SELECT job_id, max(trace_id) AS trace_id, arg_max(n_chars, trace_id) AS n_chars FROM v_traces GROUP BY 1) t ON t.job_id = j.job_id LEFT JOIN v_productions p ON p.job_id = j.job_id GROUP BY 1""")
def _(t):
    newest = t.traces.groupBy("job_id").agg(F.max("trace_id").alias("trace_id"), F.max_by("n_chars", "trace_id").alias("n_chars"))
    rows = t.jobs.select("job_id", "batch_id").join(newest, "job_id", "left").join(t.productions.select("job_id", "production_id"), "job_id", "left")
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("jobs"), F.count("trace_id").alias("traced"), F.coalesce(F.sum("n_chars"), F.lit(0)).cast("long").alias("chars"), F.count("production_id").alias("productions"))


@query("au09_participants_audit", """
SELECT j.batch_id, r.role_type, count(DISTINCT r.person_key) AS people, count(DISTINCT CASE WHEN r.validation_status = 'validated' THEN r.person_key END) AS valid_people FROM v_roles r JOIN v_jobs j ON j.job_id = r.job_id GROUP BY 1, 2""")
def _(t):
    rows = t.roles.join(t.jobs.select("job_id", "batch_id"), "job_id")
    valid = F.when(F.col("validation_status") == "validated", F.col("person_key"))
    return rows.groupBy("batch_id", "role_type").agg(F.count_distinct("person_key").alias("people"), F.count_distinct(valid).alias("valid_people"))


@query("au10_normalization_audit", """
SELECT entity_type, action, count(*) AS n, count(DISTINCT upper(raw_value)) AS distinct_values, count(record_id) AS linked FROM v_audits GROUP BY 1, 2""")
def _(t):
    return t.audits.groupBy("entity_type", "action").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(upper_key(F.col("raw_value"))).alias("distinct_values"), F.count("record_id").alias("linked"))


@query("au11_reconciliation_audit", """
SELECT t.lang, count(*) AS documents, count(*) FILTER (k.report_id IS NOT NULL) AS shown, count(*) FILTER (p.report_id IS NULL) AS unlinked, count(*) AS projects, count(*) AS products, count(*) AS members FROM v_traces t
LEFT JOIN v_progress p ON p.report_id = t.report_id LEFT JOIN x_progress_kept k ON k.report_id = p.report_id GROUP BY 1""")
def _(t):
    shown = kpis.dedupe_progress(t.progress.join(Facts(t).current, "job_id", "left_semi"), t.traces).select("report_id", F.lit(True).alias("_shown"))
    linked = t.traces.select("trace_id", "report_id", "lang").join(t.progress.select("report_id", F.lit(True).alias("_linked")), "report_id", "left").join(shown, "report_id", "left")
    base = linked.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.count_if("_shown").alias("shown"), F.count_if(F.col("_linked").isNull()).alias("unlinked"))
    sections = cut_lineage(_sections(t))
    langs = t.documents.select("doc_id", "lang")
    parts = [("projects", extract.project_rows(sections, "doc_id")), ("products", extract.product_records(extract.product_blocks(sections, "doc_id"))), ("members", extract.internal_members(sections, "doc_id"))]
    for name, rows in parts:
        base = base.join(rows.select("doc_id").join(langs, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias(name)), "lang", "left")
    return base


@query("au12_rebuild_comparison", """
SELECT entity_type, count(*) FILTER (action = 'persisted') AS before, count(*) FILTER (action IN ('persisted', 'merged_duplicate')) AS after, count(*) FILTER (action = 'merged_duplicate') AS difference FROM v_audits GROUP BY 1""")
def _(t):
    before, after = F.count_if(F.col("action") == "persisted"), F.count_if(F.col("action").isin("persisted", "merged_duplicate"))
    return t.audits.groupBy("entity_type").agg(before.alias("before"), after.alias("after"), (after - before).alias("difference"))


def _extraction(t):
    sections = cut_lineage(_sections(t))
    n = lambda rows, name: rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    people = extract.internal_members(sections, "doc_id").select("doc_id", "name").union(extract.project_rows(sections, "doc_id").select("doc_id", F.col("director")))
    products = extract.product_records(extract.product_blocks(sections, "doc_id"))
    authors = products.select("doc_id", F.explode("authors"))
    unique = people.union(authors).groupBy("doc_id").agg(F.count_distinct(upper_key(F.col("name"))).alias("people"))
    joined = n(sections, "sections").join(n(extract.project_rows(sections, "doc_id"), "projects"), "doc_id", "left").join(n(products, "products"), "doc_id", "left").join(
        n(extract.internal_members(sections, "doc_id"), "members"), "doc_id", "left").join(unique, "doc_id", "left")
    return joined.fillna(0)


@query("au13_extraction_by_file", "SELECT doc_id, 3::BIGINT AS sections, 1::BIGINT AS projects, 1::BIGINT AS products, 1::BIGINT AS members, 3::BIGINT AS people FROM documents")
def _(t):
    return _extraction(t)


# Least numbers of the approved batch and markers it must not hold.
GOLDEN = (("min_jobs", 10), ("min_internal_mentions", 28), ("min_external_mentions", 12), ("min_product_candidates", 3), ("min_research_entities", 1))


@query("au14_golden_check", """
WITH a AS (SELECT (SELECT count(*) FROM v_jobs) AS j, (SELECT count(*) FROM v_roles WHERE person_type = 'teacher') AS i, (SELECT count(*) FROM v_roles WHERE person_type <> 'teacher') AS e, (SELECT count(*) FROM v_productions) AS p, (SELECT count(*) FROM v_entities) AS n),
m AS (SELECT 'min_jobs' AS rule, j AS actual, 10 AS expected FROM a UNION ALL SELECT 'min_internal_mentions', i, 28 FROM a UNION ALL SELECT 'min_external_mentions', e, 12 FROM a UNION ALL SELECT 'min_product_candidates', p, 3 FROM a UNION ALL SELECT 'min_research_entities', n, 1 FROM a)
SELECT rule, actual, expected::BIGINT AS expected, actual >= expected AS passed FROM m UNION ALL SELECT 'forbidden_product_markers', count(*) FILTER (regexp_matches(strip_accents(upper(title)), 'EVIDENCIA|ANEXO|OBSERVACION|PIRAMIDE CIENTIFICA')), 0, count(*) FILTER (regexp_matches(strip_accents(upper(title)), 'EVIDENCIA|ANEXO|OBSERVACION|PIRAMIDE CIENTIFICA')) = 0 FROM v_productions""")
def _(t):
    teacher = F.col("person_type") == "teacher"
    counts = [t.jobs.agg(F.count(F.lit(1)).alias("v")), t.roles.agg(F.count_if(teacher).alias("v")), t.roles.agg(F.count_if(~teacher).alias("v")), t.productions.agg(F.count(F.lit(1)).alias("v")), t.entities.agg(F.count(F.lit(1)).alias("v"))]
    rows = None
    for (rule, least), frame in zip(GOLDEN, counts):
        part = frame.select(F.lit(rule).alias("rule"), F.col("v").alias("actual"), F.lit(least).cast("long").alias("expected"), (F.col("v") >= least).alias("passed"))
        rows = part if rows is None else rows.unionByName(part)
    bad = has_piece(upper_key(F.col("title")), ("EVIDENCIA", "ANEXO", "OBSERVACION", "PIRAMIDE CIENTIFICA"))
    markers = t.productions.agg(F.count_if(bad).alias("actual")).select(F.lit("forbidden_product_markers").alias("rule"), "actual", F.lit(0).cast("long").alias("expected"), (F.col("actual") == 0).alias("passed"))
    return rows.unionByName(markers)


@query("au15_completeness", """
SELECT entity_type, count(DISTINCT raw_value) AS detected, count(*) FILTER (action = 'persisted') AS persisted, count(*) FILTER (action = 'merged_duplicate') AS merged, count(*) FILTER (action = 'requires_review') AS review, count(*) FILTER (action = 'discarded') AS discarded,
  greatest(0, count(DISTINCT raw_value) - count(*) FILTER (action IN ('persisted', 'merged_duplicate', 'requires_review'))) AS possible_losses FROM v_audits GROUP BY 1""")
def _(t):
    n = lambda *a: F.count_if(F.col("action").isin(*a))
    detected = F.count_distinct(upper_key(F.col("raw_value")))
    return t.audits.groupBy("entity_type").agg(
        detected.alias("detected"), n("persisted").alias("persisted"), n("merged_duplicate").alias("merged"), n("requires_review").alias("review"), n("discarded").alias("discarded"),
        F.greatest(F.lit(0).cast("long"), detected - n("persisted", "merged_duplicate", "requires_review")).alias("possible_losses"))


@query("au16_match_matrix", """
SELECT project_id, count(*) OVER (PARTITION BY period_id, code) AS same_code, count(*) OVER (PARTITION BY period_id, name) AS same_name, count(*) OVER (PARTITION BY period_id, code, name) AS same_both, count(*) OVER (PARTITION BY period_id) AS same_period FROM v_projects""")
def _(t):
    base = t.projects.select("project_id", "period_id", "code", "name")
    cells = base.groupBy("period_id", "code", "name").agg(F.count(F.lit(1)).alias("n"))
    for keys, name in ((["period_id", "code"], "same_code"), (["period_id", "name"], "same_name"), (["period_id", "code", "name"], "same_both"), (["period_id"], "same_period")):
        base = base.join(cells.groupBy(*keys).agg(F.sum("n").alias(name)), keys)
    return base.select("project_id", "same_code", "same_name", "same_both", "same_period")


@query("au17_json_paths", "SELECT event_id, '$.k' AS path FROM events WHERE json_extract_string(props, '$.k') = CAST(user_id AS VARCHAR)")
def _(t):
    return A.json_paths(t.events, "event_id", "props", F.col("user_id").cast("string"))


@query("au20_event_comparison", """
SELECT aggregate_key, seq, CASE WHEN seq = 3 THEN 'missing' ELSE 'different' END AS state FROM v_audit_events WHERE seq = 3 OR (seq = 1 AND aggregate_key % 4 = 0)""")
def _(t):
    actual = t.audit_events.filter("seq <> 3").withColumn("payload", F.when((F.col("seq") == 1) & (F.col("aggregate_key") % 4 == 0), F.upper(F.concat("payload", F.lit("x")))).otherwise(F.col("payload")))
    return A.compare_events(t.audit_events, actual, ["event_type", "payload"])


@query("au24_locator_diagnosis", """
SELECT author_id, CASE WHEN job_id IS NULL THEN 'missing_source_document' WHEN confidence > 0.09 THEN 'conflicting_identity_fields' WHEN reason IS NOT NULL AND canonical_key IS NOT NULL THEN 'diagnostic_false_positive' WHEN author_order = 1 THEN 'locator_available_but_not_consumed'
  WHEN author_order = 3 THEN 'ambiguous_duplicate' WHEN reason IS NULL AND canonical_key IS NULL THEN 'historical_row_without_provenance' WHEN reason IS NULL THEN 'missing_source_section' ELSE 'missing_row_locator' END AS reason_code FROM v_authors""")
def _(t):
    rows = t.authors.select(
        "author_id", F.col("job_id").cast("string").alias("document_key"), F.col("reason").alias("source_section"), F.col("canonical_key").alias("row_or_block_id"), (F.col("confidence") > 0.09).alias("identity_conflict"),
        F.lit(0).alias("metadata_paths"), F.lit(0).alias("text_paths"), F.when(F.col("author_order") == 1, 1).when(F.col("author_order") == 3, 2).otherwise(0).alias("source_matches"))
    return rows.select("author_id", A.locator_diagnosis().alias("reason_code"))


# Surnames watched in the audit.
WATCHED = ("MENA", "VERA", "CEDENO", "ROJAS")


@query("au25_surname_groups", """
SELECT w.surname, count(*) AS people FROM v_teachers t JOIN (SELECT unnest(['MENA', 'VERA', 'CEDENO', 'ROJAS']) AS surname) w ON list_contains(string_split(strip_accents(full_name), ' '), w.surname) GROUP BY 1""")
def _(t):
    found = F.array_intersect(F.split(alnum_key(F.col("full_name")), " "), F.array(*map(F.lit, WATCHED)))
    return t.teachers.select(F.explode(found).alias("surname")).groupBy("surname").agg(F.count(F.lit(1)).alias("people"))


@query("au26_candidate_completeness", """
SELECT case_type, count(*) AS cases, count(DISTINCT public_id) AS unique_cases, count(*) FILTER (manual_priority IS NULL) AS without_priority, count(*) = count(DISTINCT public_id) AS complete FROM v_review_items GROUP BY 1""")
def _(t):
    return t.review_items.groupBy("case_type").agg(
        F.count(F.lit(1)).alias("cases"), F.count_distinct("public_id").alias("unique_cases"), F.count_if(F.col("manual_priority").isNull()).alias("without_priority"),
        (F.count(F.lit(1)) == F.count_distinct("public_id")).alias("complete"))


@query("au27_participant_flags", X_STATES + """
SELECT person_type, count(*) AS people, count(*) FILTER (person_type = 'docente_interno' AND kpi_eligible) AS counts_as_teacher, count(*) FILTER (person_type = 'investigador_externo' AND kpi_eligible) AS counts_as_external FROM st GROUP BY 1""")
def _(t):
    ok = F.col("kpi_eligible")
    return _states(t).groupBy("person_type").agg(
        F.count(F.lit(1)).alias("people"), F.count_if((F.col("person_type") == "docente_interno") & ok).alias("counts_as_teacher"), F.count_if((F.col("person_type") == "investigador_externo") & ok).alias("counts_as_external"))


@query("au28_candidate_lists", """
WITH a AS (SELECT entity_type, upper(raw_value) AS k, arg_min(action, audit_id) AS action FROM v_audits GROUP BY 1, 2), c AS (SELECT 'teacher' AS kind, concat('valor ', teacher_id) AS raw_value FROM v_teachers UNION ALL SELECT 'research_entity', concat('valor ', entity_id) FROM v_entities)
SELECT c.kind, coalesce(a.action, 'detected_not_persisted_yet') AS action, count(*) AS n FROM c LEFT JOIN a ON a.entity_type = c.kind AND a.k = upper(c.raw_value) GROUP BY 1, 2""")
def _(t):
    from tallyloom.operators.joins import candidate_actions

    parts = [("teacher", t.teachers, "teacher_id"), ("research_entity", t.entities, "entity_id")]
    rows = None
    for kind, df, key in parts:
        named = df.select(F.lit(kind).alias("kind"), F.concat(F.lit("valor "), F.col(key).cast("string")).alias("raw_value"))
        part = candidate_actions(named, t.audits, kind)
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("kind", "action").agg(F.count(F.lit(1)).alias("n"))


@query("au29_section_listing", "SELECT doc_id, kind, page, line_count, least(12, line_count) AS preview_lines FROM x_sections")
def _(t):
    return _sections(t).select("doc_id", "kind", "page", F.size("lines").cast("long").alias("line_count"), F.size(F.slice("lines", 1, 12)).cast("long").alias("preview_lines"))


@query("k32_pending_counters", X_STATES + """
SELECT count(*) FILTER (review_bucket = 'pending_person') AS pending_people_count, count(*) FILTER (review_bucket = 'pending_author_classification') AS pending_author_classification_count, count(*) FILTER (review_bucket = 'pending_merge') AS pending_merge_count,
  (SELECT count(*) FROM v_productions WHERE validation_status = 'pending_review') AS pending_product_count, (SELECT count(*) FROM v_entities WHERE validation_status = 'pending_review') AS pending_entity_count, (SELECT count(*) FROM v_traces WHERE review_status = 'PENDIENTE_REVISION') AS pending_ocr_count FROM st""")
def _(t):
    people = views.state_summary(_states(t)).select("pending_people_count", "pending_author_classification_count", "pending_merge_count")
    waiting = lambda df, c, v, name: df.agg(F.count_if(F.col(c) == v).alias(name))
    parts = [people, waiting(t.productions, "validation_status", "pending_review", "pending_product_count"), waiting(t.entities, "validation_status", "pending_review", "pending_entity_count"),
             waiting(t.traces, "review_status", "PENDIENTE_REVISION", "pending_ocr_count")]
    measures = [c for p in parts for c in p.columns]
    stacked = kpis.stack_frames([p.withColumn("k", F.lit(1)) for p in parts], ["k"], measures)
    return stacked.drop("k")


@query("id24_linked_evidence")
def _(t):
    left, right = name_tokens(F.col("raw_name")), name_tokens(F.col("official_name"))
    share = token_share(left, right)
    return t.mention_names.select("mention_id", (share >= 0.999).alias("one_to_one"), (F.size(left) < F.size(right)).alias("partial"))


def _product_docs(t):
    """A labelled table, a stacked one whose title goes on over a page, or a plain one, by document."""
    title, who = F.concat(F.lit("Modelo comparado de mercados para "), "source"), pick_one(PEOPLE, "doc_id")
    state = F.when(F.col("doc_id") % 2 == 0, "Publicado").otherwise("En\nrevision")
    labelled = F.concat_ws("\n", F.lit("Titulo"), title, F.lit("[[PAGE_BREAK:2]]"), F.lit("Titulo"), F.lit("y su entorno"), F.lit("Autor 1"), who, F.lit("Autor 2"), F.lit("Rentabilidad 2"), F.lit("Estado"), state, F.lit("Impacto"), F.lit("Regional"),
                           F.lit("Link"), F.lit("https://uni.edu/"), F.col("lang"))
    stacked = F.concat_ws("\n", title, F.upper(who), state, F.lit("Mundial"), F.lit("https://uni.edu/"), F.col("lang"), F.lit("[[PAGE_BREAK:2]]"), F.lit("y su entorno"), F.lit("Otra mirada larga de los puertos del sur"), who, state)
    plain = F.concat_ws("\n", title, F.lit("y su entorno"), F.lit("Impacto regional"))
    body = F.when(F.col("doc_id") % 3 == 0, labelled).when(F.col("doc_id") % 3 == 1, stacked).otherwise(plain)
    return t.documents.select("doc_id", F.concat_ws("\n", F.lit("Produccion cientifica"), body, F.lit("Evidencias"), "text").alias("text"))


@query("t14_label_products", f"""
WITH d AS (SELECT doc_id, lang, concat('Modelo comparado de mercados para ', source, ' y su entorno') AS title, {list(PEOPLE)}[doc_id % 5 + 1] AS who, CASE WHEN doc_id % 2 = 0 THEN 'PUBLICADO' ELSE 'EN REVISION' END AS status FROM documents)
SELECT doc_id, title, CASE WHEN doc_id % 3 < 2 THEN who ELSE '' END AS authors, CASE WHEN doc_id % 3 < 2 THEN status END AS status, CASE doc_id % 3 WHEN 0 THEN 'IMPACTO REGIONAL' WHEN 1 THEN 'Mundial' ELSE 'Impacto regional' END AS impact,
  CASE WHEN doc_id % 3 < 2 THEN concat('https://uni.edu/', lang) END AS link, CASE WHEN doc_id % 3 < 2 THEN 'validado' ELSE 'pending_review' END AS validation_status FROM d
UNION ALL SELECT doc_id, 'Otra mirada larga de los puertos del sur', who, status, NULL, NULL, 'validado' FROM d WHERE doc_id % 3 = 1""")
def _(t):
    rows = layouts.scientific_products(lines.section_rows(_product_docs(t), "doc_id"), "doc_id")
    return rows.select("doc_id", "title", F.array_join("authors", "|").alias("authors"), "status", "impact", "link", "validation_status")


@query("t29_loss_causes", """
SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'parser_anterior_perdia_proyectos_fci' END, CASE WHEN n_chars < 1000 THEN 'texto_extraido_insuficiente' END, CASE WHEN lang = 'de' THEN 'ocr_aplicado_texto_ruidoso' END], lambda x: x IS NOT NULL), ',') AS causes FROM documents""")
def _(t):
    rows = _extraction(t).join(t.documents.select("doc_id", "n_chars", "lang"), "doc_id")
    found = {k: F.lit(True) for k in ("integrantes_internos", "produccion_cientifica", "proyectos_fci")}
    current = {"integrantes_internos": F.col("members"), "produccion_cientifica": F.col("products"), "proyectos_fci": F.col("projects")}
    stored = {**current, "proyectos_fci": F.when(F.col("doc_id") % 3 == 0, F.col("projects") - 1).otherwise(F.col("projects"))}
    return rows.select("doc_id", F.array_join(A.loss_causes(found, current, stored, F.col("n_chars"), F.col("lang") == "de", F.lit("SUCCESS")), ",").alias("causes"))


@query("t30_reparse_comparison", """
SELECT 'members' AS kind, count(*) AS current, count(*) AS stored, count(*) FILTER (doc_id % 3 = 0) AS gained, count(*) FILTER (doc_id % 3 = 0) AS lost FROM documents
UNION ALL SELECT 'projects', count(*), count(*), 0, 0 FROM documents UNION ALL SELECT 'products', count(*), 0, count(*), 0 FROM documents""")
def _(t):
    members = cut_lineage(lines.section_rows(member_docs(t), "doc_id"))
    reports = cut_lineage(_sections(t))
    tagged = lambda rows, kind, *c: rows.select("doc_id", F.lit(kind).alias("kind"), F.concat_ws("|", *c).alias("row"))
    projects = tagged(extract.project_rows(reports, "doc_id"), "projects", "code", "name", "director", "progress")
    # what an earlier run stored: labelled members alone, and no products
    folder = work_folder(t.documents.sparkSession, "stored-extraction")
    tagged(layouts.labelled_internal(members, "doc_id"), "members", "name", "career").unionByName(projects).write.parquet(folder)
    stored = t.documents.sparkSession.read.parquet(folder)
    now = tagged(layouts.internal_members(members, "doc_id"), "members", "name", "career").unionByName(projects)
    now = now.unionByName(tagged(extract.product_records(extract.product_blocks(reports, "doc_id")), "products", "title"))
    return layouts.compare_extractions(now, stored, "kind", ["doc_id", "row"])


@query("t31_review_state", """
SELECT trace_id, CASE WHEN n_chars < 500 OR lang = 'de' OR source = 'src3' THEN 'PENDIENTE_REVISION' ELSE 'VALIDADO_AUTOMATICO' END AS state, (n_chars < 500)::INT + (lang = 'de')::INT + (source = 'src3')::INT AS issues FROM v_traces""")
def _(t):
    issues = F.array_compact(F.array(
        F.when(F.col("n_chars") < 500, "Confianza de clasificacion baja."), F.when(F.col("lang") == "de", "No se detecto carrera del informe."),
        F.when(F.col("source") == "src3", "No se detectaron secciones estructuradas del informe.")))
    return t.traces.select("trace_id", F.when(F.size(issues) > 0, "PENDIENTE_REVISION").otherwise("VALIDADO_AUTOMATICO").alias("state"), F.size(issues).alias("issues"))


@query("t32_public_payload", """
SELECT doc_id, NULL::VARCHAR AS source_path, concat('Informe ', doc_id, '.pdf') AS filename, CASE WHEN doc_id % 5 = 0 THEN 'Información técnica disponible únicamente en los registros del servidor.' ELSE source END AS note FROM documents""")
def _(t):
    note = F.when(F.col("doc_id") % 5 == 0, F.lit("ver s3://caja/x")).otherwise(F.col("source"))
    payload = F.to_json(F.struct(F.concat(F.lit("/srv/"), "source").alias("source_path"), F.concat(F.lit("C:\\tmp\\ Informe "), F.col("doc_id").cast("string"), F.lit(".PDF")).alias("File-Name"), note.alias("note")))
    rows = t.documents.select("doc_id", redact.public_payload(payload).alias("p"))
    return rows.select("doc_id", F.col("p")["source_path"].alias("source_path"), F.col("p")["File-Name"].alias("filename"), F.col("p")["note"].alias("note"))


@query("t33_text_safety")
def _(t):
    texts = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text").union(t.pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")), "url"))
    shown = texts.withColumn("plain", redact.decoded(F.col("text")))
    return shown.select("id", F.array_join(redact.unsafe_kinds(F.col("plain")), ",").alias("unsafe"), (redact.public_text(F.col("plain")) == redact.REDACTED).alias("redacted"))


@query("t35_general_data", """
SELECT doc_id, 'Rosa Elena Mena Vera' AS director, 'Convocatoria 2023' AS year, concat('Licenciatura en ', lang, CASE WHEN doc_id >= 0 THEN concat(' Porcentaje de avance ', doc_id % 140, ' %') END) AS career, concat('r', doc_id, '@uni.edu') AS email FROM documents""")
def _(t):
    df = extract.general_data(lines.with_lines(_general_docs(t)))
    mail = F.get(F.filter(F.transform("lines", lambda x: F.nullif(F.regexp_extract(x, r"[\w.\-]+@[\w.\-]+\.\w+", 0), F.lit(""))), lambda m: m.isNotNull() & ~m.contains("@local.import")), F.lit(0))
    return df.select("doc_id", F.col("label_director").alias("director"), F.col("label_year").alias("year"), F.col("label_career").alias("career"), mail.alias("email"))


@query("t36_document_kind", """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'duplicado' WHEN doc_id % 7 = 1 THEN 'semillero' WHEN doc_id % 7 = 2 THEN 'grupo_de_investigacion' ELSE 'proyecto' END AS kind FROM documents""")
def _(t):
    mod = F.col("doc_id") % 7
    name = F.when(mod == 1, "Informe semillero.pdf").when(mod == 2, "Informe grupo 3.pdf").otherwise("nota.pdf")
    key = upper_key(name)
    kinds = F.transform("sections", lambda s: s["kind"])
    docs = lines.with_sections(t.reports.select("doc_id", "text"))
    kind = (
        F.when(mod == 0, "duplicado").when(key.contains("SEMILLERO"), "semillero").when(has_piece(key, ("GRUPO", "GI")), "grupo_de_investigacion")
        .when(has_piece(key, ("PROYECTO", "FCI")) | F.array_contains(kinds, "proyectos_fci"), "proyecto").otherwise("otro"))
    return docs.select("doc_id", kind.alias("kind"))


@query("t37_payload_assembly", """
SELECT doc_id, 'progress_report' AS document_type, 'Ana Maria Paredes Ruiz' AS members, concat('FCI', 100 + doc_id % 900, '-2025') AS projects, concat('Analisis de la gestion financiera en empresas ', lang, ' ', source) AS products, 3 AS sections,
  'sections:3,members:1,projects:1,products:1' AS log FROM documents""")
def _(t):
    head = F.concat_ws("\n", F.lit("INFORME PARCIAL"), F.lit("DATOS GENERALES"), F.lit("CICLO ACADEMICO QUE REPORTA"), "text")
    docs = extract.classify_documents(t.reports.select("doc_id", head.alias("text"), F.lit("informe.pdf").alias("filename"))).filter("document_status = 'accepted'")
    found = cut_lineage(_sections(t).join(docs.select("doc_id"), "doc_id", "left_semi"))
    products = extract.product_records(extract.product_blocks(found, "doc_id")).select("doc_id", "section_no", "block_no", "title", "authors", "status")
    payload = layouts.assemble(docs.select("doc_id", "document_type"), "doc_id", {
        "sections": (found.select("doc_id", "section_no", "kind", "title", "page"), ["section_no"]), "members": (extract.internal_members(found, "doc_id"), ["section_no", "member_no"]),
        "projects": (extract.project_rows(found, "doc_id"), ["section_no", "project_no"]), "products": (products, ["section_no", "block_no"])})
    listed = lambda part, name: F.array_join(F.transform(part, lambda r: r[name]), "|").alias(part)
    log = F.array_join(F.transform("log", lambda x: F.concat_ws(":", x["part"], x["rows"].cast("string"))), ",")
    return payload.select("doc_id", "document_type", listed("members", "name"), listed("projects", "code"), listed("products", "title"), F.size("sections").alias("sections"), log.alias("log"))


@query("t38_progress_record", """
SELECT r.doc_id, (SELECT c.career_id FROM v_careers c WHERE contains(strip_accents(upper(r.text)), c.name) ORDER BY length(c.name) DESC, c.career_id LIMIT 1) AS career_id, CASE WHEN r.doc_id % 2 = 0 THEN 2 ELSE 1 END AS cycle, 1::BIGINT AS projects, 1::BIGINT AS members FROM v_reports r""")
def _(t):
    from tallyloom.operators.joins import longest_match

    counts = extract.text_counts(t.reports.select("doc_id", "text"), "text").select("doc_id", "cycle")
    careers = longest_match(t.reports, "doc_id", "text", t.careers, "career_id", "name")
    return careers.join(counts, "doc_id").join(_extraction(t).select("doc_id", "projects", "members"), "doc_id").select("doc_id", "career_id", "cycle", "projects", "members")


@query("t39_legacy_sections", "SELECT doc_id, 2::BIGINT AS lines_between FROM documents")
def _(t):
    docs = t.documents.select("doc_id", F.concat_ws("\n", F.lit("INTERCAMBIO DE CONOCIMIENTO"), "source", "lang", F.lit("ANEXOS"), "text").alias("text"))
    df = lines.with_lines(docs)
    start = F.array_position(F.transform("keys", lambda k: k.contains("INTERCAMBIO DE CONOCIMIENTO")), F.lit(True)).cast("int")
    stops = F.filter(F.transform("keys", lambda k, i: F.when(has_piece(k, ("EVIDENCIAS DE LO REPORTADO", "ANEXOS", "OBSERVACIONES")), i)), lambda i: i.isNotNull())
    return df.filter(start > 0).select("doc_id", (F.coalesce(F.array_min(F.filter(stops, lambda i: i >= start)), F.size("lines")) - start).cast("long").alias("lines_between"))


def _marked_sql(section, starts, stops):
    return f"""
l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> '') AS x FROM v_reports) d),
k AS (SELECT doc_id, line, i, trim(regexp_replace(strip_accents(upper(line)), '[^A-Z0-9%./:\\-]+', ' ', 'g')) AS k, regexp_matches(line, '(?i)^\\[\\[PAGE_BREAK(:[0-9]+)?\\]\\]$') AS mark FROM l),
b AS (SELECT doc_id, min(i) AS s FROM k WHERE NOT mark AND regexp_matches(k, '{'|'.join(starts)}') GROUP BY 1),
r AS (SELECT k.doc_id, k.i, k.line, NOT mark AND regexp_matches(k, '{'|'.join(stops)}') AS stop, mark OR regexp_matches(k, '{legacy.NOISE}') AS noise, NOT mark AND regexp_matches(k, '{legacy.HEADING}') AS head FROM k JOIN b ON k.doc_id = b.doc_id AND k.i > b.s),
o AS (SELECT doc_id, min(i) FILTER (stop) AS stop, min(i) FILTER (NOT noise) AS one FROM r GROUP BY 1),
e AS (SELECT o.doc_id, least(coalesce(min(o.stop), 1e9), coalesce(min(r.i) FILTER (r.head AND r.i > o.one), 1e9)) AS e FROM o JOIN r ON r.doc_id = o.doc_id GROUP BY 1)
SELECT r.doc_id, '{section}' AS section, CAST(row_number() OVER (PARTITION BY r.doc_id ORDER BY r.i) - 1 AS INT) AS line_no, line FROM r JOIN e ON e.doc_id = r.doc_id WHERE r.i < e.e AND NOT noise"""


@query("t39_marked_lines", "SELECT * FROM (WITH " + _marked_sql("products", *legacy.PRODUCTS) + ") p UNION ALL SELECT * FROM (WITH " + _marked_sql("exchange", *legacy.EXCHANGE) + ") x")
def _(t):
    return legacy.marked_lines(t.reports, "doc_id", {"products": legacy.PRODUCTS, "exchange": legacy.EXCHANGE})


@query("t41_extraction_merge", f"""
SELECT doc_id, {list(PEOPLE)}[doc_id % 5 + 1] AS name, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS layout, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 3 END::BIGINT AS candidates FROM documents""")
def _(t):
    sections = cut_lineage(lines.section_rows(member_docs(t), "doc_id"))
    found = [layouts.labelled_internal(sections, "doc_id"), extract.internal_members(sections, "doc_id").filter(F.col("career").isNotNull())]
    return layouts.merge_by_name(found, ["doc_id", "section_no"], "career").select("doc_id", "name", "layout", "candidates")


@query("t44_text_sufficiency", """
SELECT source, count(*) AS pages, count(*) FILTER (length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 300 AND length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) >= 150) AS digital_pages,
  CASE WHEN count(*) FILTER (length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 300 AND length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) >= 150) = count(*) THEN 'digital_text' WHEN count(*) FILTER (length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 300 AND length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) >= 150) = 0 THEN 'ocr' ELSE 'mixed' END AS method FROM documents GROUP BY 1""")
def _(t):
    enough = (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) >= 300) & (F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")) >= 150)
    counted = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.count_if(enough).alias("digital_pages"))
    return counted.withColumn("method", F.when(F.col("digital_pages") == F.col("pages"), "digital_text").when(F.col("digital_pages") == 0, "ocr").otherwise("mixed"))


