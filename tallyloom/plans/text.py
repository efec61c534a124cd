"""Text extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import people as P
from tallyloom.functions import text as K
from tallyloom.functions import titles
from tallyloom.functions import wordlists as W
from tallyloom.operators import extract, layouts, lines
from tallyloom.plans.registry import query

PK = "trim(regexp_replace(regexp_replace(strip_accents(upper(replace({0}, 'ß', 'ss'))), '[^A-Z0-9%./:\\- ]+', ' ', 'g'), ' +', ' ', 'g'))"
UK = "trim(regexp_replace(strip_accents(upper(replace({0}, 'ß', 'ss'))), '\\s+', ' ', 'g'))"


def _sections(t):
    return lines.section_rows(t.reports, "doc_id")


@query("t01_line_table", """
SELECT doc_id, page, count(*) AS line_count, CAST(sum(length(line)) AS BIGINT) AS chars FROM x_lines GROUP BY 1, 2""")
def _(t):
    return lines.line_table(t.reports, "doc_id").groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("line_count"), F.sum(F.length("line")).alias("chars"))


@query("t02_keys", f"""
SELECT doc_id, md5({UK.format('text')}) AS upper_key, md5({PK.format("replace(replace(text, chr(10), ' '), chr(9), ' ')")}) AS parser_key FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.md5(K.upper_key(F.col("text"))).alias("upper_key"), F.md5(K.parser_key(F.col("text"))).alias("parser_key"))


@query("t03_sections", """
SELECT doc_id, kind, page, line_count, 100.0::DOUBLE AS score FROM x_sections""")
def _(t):
    return _sections(t).select("doc_id", "kind", "page", F.size("lines").cast("long").alias("line_count"), "score")


@query("t04_document_class", f"""
WITH k AS (SELECT doc_id, concat('GI', CAST(100 + doc_id % 7 AS VARCHAR), ' ', lang, '.PDF') AS f, {PK.format("replace(replace(text, chr(10), ' '), chr(9), ' ')")} AS tk FROM v_reports),
a AS (SELECT doc_id, upper(f) || ' ' || tk AS a FROM k),
s AS (SELECT doc_id, {' + '.join(f"contains(a, '{s}')::INT" for s in W.MAIL_SIGNALS)} AS mail_signals, {' + '.join(f"contains(a, '{s}')::INT" for s in W.FORM_SIGNALS)} AS form_signals,
  {' + '.join(f"contains(a, '{s}')::INT" for s in W.REPORT_SIGNALS)} + 1 AS report_signals, {' + '.join(f"contains(a, '{s}')::INT" for s in W.PAPERWORK_SIGNALS)} AS paperwork_signals FROM a)
SELECT doc_id, CASE WHEN mail_signals >= 4 THEN 'email_capture' WHEN report_signals >= 3 AND form_signals >= 2 THEN 'progress_report' WHEN paperwork_signals > 0 AND report_signals <= 1 THEN 'administrative_document' ELSE 'unknown' END AS document_type,
  CASE WHEN mail_signals >= 4 THEN 100.0::DOUBLE WHEN report_signals >= 3 AND form_signals >= 2 THEN round(least(100.0::DOUBLE, report_signals * 100.0::DOUBLE / 6), 4)
   WHEN paperwork_signals > 0 AND report_signals <= 1 THEN greatest(40.0::DOUBLE, round(report_signals * 100.0::DOUBLE / 6, 4)) ELSE round(least(100.0::DOUBLE, report_signals * 100.0::DOUBLE / 6), 4) END AS score,
  mail_signals, form_signals, report_signals, paperwork_signals FROM s""")
def _(t):
    docs = t.reports.withColumn("filename", F.concat(F.lit("GI"), (F.col("doc_id") % 7 + 100).cast("string"), F.lit(" "), "lang", F.lit(".pdf")))
    return extract.classify_documents(docs).select("doc_id", "document_type", "score", "mail_signals", "form_signals", "report_signals", "paperwork_signals")


@query("t05_table_class")
def _(t):
    rows = lines.section_lines(_sections(t), "doc_id")
    return extract.classify_tables(rows, ["doc_id", "section_no", "kind"])


def _general_docs(t):
    head = F.concat_ws("\n", F.lit("Datos generales"), F.lit("1. Codigo de proyecto *"), F.concat(F.lit("FCI-"), (F.col("doc_id") % 90 + 10).cast("string"), F.lit("-2024")),
                       F.lit("Titulo del proyecto"), F.concat(F.lit("Gestion de "), "source"), F.lit("3 / 9"), F.concat(F.lit("en la region "), "lang"),
                       F.lit("Director del proyecto:"), F.lit("Rosa Elena Mena Vera"), F.lit("Correo"), F.concat(F.lit("r"), F.col("doc_id").cast("string"), F.lit("@uni.edu")),
                       F.lit("Año de convocatoria"), F.lit("Convocatoria 2023"), F.lit("Ciclo academico"), F.when(F.col("doc_id") % 2 == 0, "CICLO II").otherwise("I"),
                       F.lit("Carrera del director"), F.concat(F.lit("Licenciatura en "), "lang"), F.lit("Porcentaje de avance"), F.concat((F.col("doc_id") % 140).cast("string"), F.lit(" %")), F.lit("Resumen"))
    return t.documents.select("doc_id", F.concat_ws("\n", head, "text").alias("text"))


@query("t06_labelled_values", """
SELECT doc_id, concat('FCI-', doc_id % 90 + 10, '-2024 Titulo del proyecto Gestion de ', source, ' en la region ', lang) AS code, concat('Gestion de ', source, ' en la region ', lang) AS title, 'Rosa Elena Mena Vera' AS director, 'Convocatoria 2023' AS year FROM documents""")
def _(t):
    df = extract.general_data(lines.with_lines(_general_docs(t)))
    return df.select("doc_id", *[F.col(f"label_{c}").alias(c) for c in ("code", "title", "director", "year")])


@query("t07_entities", """
SELECT doc_id, 'proyecto_fci' AS entity_type, concat('FCI-', lpad(CAST(doc_id % 90 + 10 AS VARCHAR), 3, '0'), '-2024') AS code, 2023 AS year, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 1 END AS cycle,
  least(100.0::DOUBLE, CAST(doc_id % 140 AS DOUBLE)) AS progress_percentage, 'validated' AS validation_status, 0.95::DOUBLE AS confidence_score FROM documents""")
def _(t):
    df = extract.extract_entities(lines.with_lines(_general_docs(t)), "doc_id")
    return df.select("doc_id", "entity_type", "code", "year", "cycle", "progress_percentage", "validation_status", "confidence_score")


@query("t08_path_entities", """
WITH f AS (SELECT doc_id, concat('/INFORMES/', CASE doc_id % 4 WHEN 0 THEN 'GRUPO DE INVESTIGACION' WHEN 1 THEN 'S.I-' || doc_id % 50 WHEN 2 THEN 'GI ' || (100 + doc_id % 20) ELSE 'OTROS' END, '/', upper(source), '.PDF') AS k, n_chars < 500 AS pending FROM documents)
SELECT doc_id, 'grupo_investigacion' AS entity_type, CASE WHEN doc_id % 4 = 2 THEN 'GI' || (100 + doc_id % 20) END AS code FROM f WHERE doc_id % 4 IN (0, 2)
UNION ALL SELECT doc_id, 'semillero', 'S-I-' || doc_id % 50 FROM f WHERE doc_id % 4 = 1
UNION ALL SELECT doc_id, 'pendiente_ocr', NULL FROM f WHERE doc_id % 4 = 3 AND pending""")
def _(t):
    mod = F.col("doc_id") % 4
    folder = F.when(mod == 0, "Grupo de Investigación").when(mod == 1, F.concat(F.lit("S.I-"), (F.col("doc_id") % 50).cast("string"))).when(
        mod == 2, F.concat(F.lit("gi "), (F.col("doc_id") % 20 + 100).cast("string"))).otherwise("otros")
    files = t.traces.withColumnRenamed("trace_id", "doc_id").select(
        "doc_id", F.concat(F.lit("/Informes/"), folder, F.lit("/"), "source", F.lit(".pdf")).alias("path"), F.lit(None).cast("string").alias("name"), "review_status")
    return extract.path_entities(files, "doc_id", "name", "path", "review_status").select("doc_id", "entity_type", "code")


@query("t09_project_rows", """
SELECT doc_id, concat('FCI', 100 + doc_id % 900, '-2025') AS code, concat('Gestion de recursos ', lang) AS name, 'Rosa Elena Mena Vera' AS director, concat(doc_id % 101, '%') AS progress, 'Vigente' AS status FROM documents""")
def _(t):
    return extract.project_rows(_sections(t), "doc_id").select("doc_id", "code", "name", "director", "progress", "status")


PEOPLE = ("Rosa Elena Mena Vera", "Luis Jose Rojas Leon", "Ana Maria Paredes Ruiz", "Pedro Andres Solis Paz", "Nora Lucia Mora Rios")
CAREERS = W.CAREER_CATALOG[:8]


def pick_one(values: tuple[str, ...], at: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(at) % len(values) + 1).cast("int"))


def member_docs(t):
    """Reports with a labelled table, in which one career in three is missing, and after it the same people without labels."""
    wrapped = F.split(pick_one(PEOPLE, "doc_id"), " ")
    name = lambda a, n: F.array_join(F.slice(wrapped, a, n), " ")
    career = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("CARRERA\n"), pick_one(CAREERS, "doc_id")))
    head = F.concat_ws("\n", F.lit("14. Investigadores que participan en el proyecto"), F.lit("NOMBRE COMPLETO"), name(1, 3), F.lit("3 DE 9"), name(4, 1), F.lit("FACULTAD"), F.lit("Ciencias Administrativas"), career,
                       F.lit("FECHA DE INGRESO"), F.lit("2023-04-01"), F.upper(pick_one(PEOPLE, "doc_id")), F.lit("FACULTAD DE CIENCIAS ADMINISTRATIVAS"), pick_one(CAREERS, "doc_id"), F.lit("Septiembre 2023"),
                       F.lit("15. Investigadores que se desvinculan del proyecto"), F.col("text"))
    return t.documents.select("doc_id", head.alias("text"))


@query("t10_internal_members", f"""
SELECT doc_id, {list(PEOPLE)}[doc_id % 5 + 1] AS name, 'CIENCIAS ADMINISTRATIVAS' AS faculty, {list(CAREERS)}[doc_id % 8 + 1] AS career, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS layout FROM documents""")
def _(t):
    return layouts.internal_members(lines.section_rows(member_docs(t), "doc_id"), "doc_id").select("doc_id", "name", "faculty", "career", "layout")


def _external_docs(t):
    mod = F.col("doc_id") % 3
    labelled = F.concat_ws("\n", F.lit("Nombre completo"), F.lit("3 DE 9"), F.lit("Nora Lucia Paz Mora"), F.when(F.col("doc_id") % 4 == 0, "Institución externa\nUniversidad de\nMurcia").otherwise("Facultad\nCiencias Administrativas"))
    plain = (
        F.when(mod == 0, F.concat(F.lit("Universidad de "), "source", F.lit("\nPEDRO MARIA CRUZ SOLIS"))).when(mod == 1, F.concat(F.lit("PEDRO MARIA CRUZ SOLIS\nInstituto Tecnico de "), "source"))
        .otherwise(F.lit("PEDRO MARIA CRUZ SOLIS\nestudiante")))
    body = F.concat_ws("\n", F.lit("Investigadores externos que participan del proyecto"), F.when(F.col("doc_id") % 2 == 0, labelled).otherwise(F.concat(F.lit("Institución externa\nInvestigador\n"), plain)), F.lit("Resumen del proyecto"), F.col("text"))
    return t.documents.select("doc_id", body.alias("text"))


@query("t11_external_members", """
SELECT doc_id, 'Pedro Maria Cruz Solis' AS name, CASE doc_id % 3 WHEN 0 THEN concat('Universidad de ', upper(source[1]), source[2:]) WHEN 1 THEN concat('Instituto Tecnico de ', upper(source[1]), source[2:]) ELSE 'Universidad de Guayaquil' END AS institution,
  CASE doc_id % 3 WHEN 2 THEN 'estudiante' ELSE 'investigador_externo' END AS participant_type, 2 AS layout FROM documents WHERE doc_id % 2 = 1
UNION ALL SELECT doc_id, 'Nora Lucia Paz Mora', CASE WHEN doc_id % 4 = 0 THEN 'Universidad de Murcia' ELSE 'Universidad de Guayaquil' END, CASE WHEN doc_id % 4 = 0 THEN 'investigador_externo' ELSE 'estudiante' END, 1 FROM documents WHERE doc_id % 2 = 0""")
def _(t):
    return layouts.external_members(lines.section_rows(_external_docs(t), "doc_id"), "doc_id").select("doc_id", "name", "institution", "participant_type", "layout")


@query("t12_directors", """
SELECT doc_id, 'Rosa Elena Mena Vera' AS name, 'director' AS role_type FROM documents""")
def _(t):
    return extract.directors(lines.section_rows(_general_docs(t), "doc_id"), "doc_id").select("doc_id", "name", "role_type")


@query("t13_product_blocks", """
SELECT doc_id, 0 AS block_no, 4::BIGINT AS line_count FROM documents""")
def _(t):
    return extract.product_blocks(_sections(t), "doc_id").select("doc_id", "block_no", F.size("block").cast("long").alias("line_count"))


def _products(t):
    return extract.product_records(extract.product_blocks(_sections(t), "doc_id"))


@query("t15_product_records", """
SELECT doc_id, concat('Analisis de la gestion financiera en empresas ', lang, ' ', source) AS title, 'Luis Jose Rojas Leon' AS authors, CASE WHEN doc_id % 2 = 0 THEN 'PUBLICADO' ELSE 'EN REVISION' END AS status,
  'Impacto regional' AS impact, 'validado' AS validation_status, 'link' AS fields_missing FROM documents""")
def _(t):
    return _products(t).select("doc_id", "title", F.array_join("authors", "|").alias("authors"), "status", "impact", "validation_status", F.array_join("fields_missing", "|").alias("fields_missing"))


def _variant_products(t):
    """Three products a document, two of them variants of each other, in an order and with links that differ by document."""
    base = F.concat(F.lit("Analisis de la gestion financiera en "), "source")
    row = lambda at, title, link: F.struct(F.lit(at).alias("n"), title.alias("title"), link.alias("link"))
    link = F.when(F.col("doc_id") % 2 == 0, "https://uni.edu/x")
    none = F.lit(None).cast("string")
    three = [row(0, base, none), row(1, F.concat(base, F.lit(" y sus mercados")), link), row(2, F.concat(F.lit("Nuevo "), base, F.lit(" con una mirada larga al futuro")), none)]
    orders = ((0, 1, 2), (1, 0, 2), (2, 0, 1))
    pick = lambda k: F.array(*[three[i] for i in orders[k]])
    rows = F.when(F.col("doc_id") % 3 == 0, pick(0)).when(F.col("doc_id") % 3 == 1, pick(1)).otherwise(pick(2))
    df = t.documents.select("doc_id", "lang", F.posexplode(rows).alias("at", "p")).select(
        "doc_id", "at", "p.title", F.array("lang").alias("authors"), F.lit("PUBLICADO").alias("status"), F.lit(None).cast("string").alias("impact"), "p.link", F.lit("validado").alias("validation_status"))
    return titles.with_title_quality(df, "title")


@query("t16_variant_collapse", """
WITH d AS (SELECT doc_id, concat('Analisis de la gestion financiera en ', source) AS a, concat('Analisis de la gestion financiera en ', source, ' y sus mercados') AS b, concat('Nuevo Analisis de la gestion financiera en ', source, ' con una mirada larga al futuro') AS c FROM documents),
k AS (SELECT doc_id, c, CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 1 THEN b ELSE a END AS k FROM d)
SELECT doc_id, 0 AS position, CASE WHEN doc_id % 3 = 2 THEN c ELSE k END AS title FROM k UNION ALL SELECT doc_id, 1, CASE WHEN doc_id % 3 = 2 THEN k ELSE c END FROM k""")
def _(t):
    rows = layouts.with_variant_keys(_variant_products(t), ["at"], ["title"])
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("_variant")).alias("v"))
    return lists.select("doc_id", F.posexplode(layouts.collapse_in_order(F.col("v"))).alias("position", "x")).select("doc_id", "position", F.col("x.row.title").alias("title"))


@query("t17_interchanges", """
SELECT doc_id, 'Facultad de Ciencias' AS faculty, 'Ponencia' AS exchange_type, concat('Charla sobre ', source) AS title FROM documents""")
def _(t):
    docs = t.documents.select("doc_id", F.concat_ws("\n", F.lit("24. Intercambio de conocimiento"), F.lit("Facultad interviniente"), F.lit("Tipo"), F.lit("Titulo"), F.lit("Facultad de Ciencias"),
                                                    F.lit("Ponencia"), F.concat(F.lit("Charla sobre "), "source"), F.lit("Evidencias"), "text").alias("text"))
    return extract.interchange_rows(lines.section_rows(docs, "doc_id"), "doc_id").select("doc_id", "faculty", "exchange_type", "title")


@query("t18_text_counts", """
SELECT doc_id, CAST(least(5, doc_id % 9) AS INT) AS articles, CAST(least(3, doc_id % 5) AS INT) AS books, 1 AS book_chapters, 0 AS presentations, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS cycle, CASE WHEN doc_id % 3 = 0 THEN '2024-2025' ELSE '2025-2026' END AS year_label FROM documents""")
def _(t):
    n = F.col("doc_id")
    head = F.concat_ws(" ", F.lit("ciclo"), F.when(n % 2 == 0, "II").otherwise("I"), F.when(n % 3 == 0, "2024 - 2025").otherwise("CI2526"), (n % 9).cast("string"), F.lit("artículos y"),
                       (n % 5).cast("string"), F.lit("libros, un capitulo de libro."))
    return extract.text_counts(t.documents.select("doc_id", F.concat_ws(" ", head, "text").alias("text")), "text").drop("text")


QUALITY = f"""
WITH d AS (SELECT doc_id, nullif(substr(trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^[ \\-]+|[ \\-]+$', '', 'g')), 1, 240), '') AS x FROM documents),
k AS (SELECT doc_id, x, {UK.format('x')} AS k FROM d), q AS (SELECT doc_id, x, k, string_split(k, ' ') AS tk FROM k),
i AS (SELECT *, contains(k, '/') OR {' OR '.join(f"contains(k, '{s}')" for s in W.IDENTIFIER_WORDS)} OR (regexp_matches(k, '\\b[A-Z]*\\d[A-Z0-9]*\\b') AND regexp_matches(x, '\\.|/')) OR regexp_matches(k, '\\.[A-Z]{{1,3}}\\s+[A-Z]{{1,3}}\\b') AS ident FROM q)"""


@query("t19_title_quality", QUALITY + f"""
SELECT doc_id, CASE WHEN x IS NULL OR k = '' THEN 'invalid' WHEN len(tk) <= 6 AND len(list_intersect(tk, {list(W.TITLE_ROLE_WORDS)})) > 0 THEN 'invalid' WHEN len(tk) = 1 THEN 'invalid'
  WHEN contains(k, 'LIBRO') AND (contains(k, 'NO HA SIDO FINALIZADO') OR contains(k, 'PLANIFICADO')) THEN 'truncated'
  WHEN ident THEN CASE WHEN len(list_filter(tk, lambda w: list_contains({list(W.TITLE_TERMS)}, w))) >= 2 THEN 'truncated' ELSE 'invalid' END
  WHEN {' OR '.join(f"contains(k, '{s}')" for s in W.TITLE_NOISE)} OR list_contains({list(W.TITLE_FIELD_WORDS)}, k) THEN 'invalid'
  WHEN len(tk) >= 10 AND len(list_filter(tk[greatest(1, len(tk) - 11):], lambda w: list_contains({list(W.GLUED_NAMES)}, w))) >= 3 THEN 'truncated'
  WHEN list_contains({list(W.CUT_LAST_WORDS + W.CUT_PIECES)}, tk[-1]) OR (len(tk) <= 3 AND len(list_intersect(tk, {list(W.CUT_PIECES)})) > 0) THEN 'truncated'
  WHEN length(k) < 18 OR len(tk) < 4 THEN 'truncated' ELSE 'valid' END AS quality FROM i""")
def _(t):
    return titles.with_title_quality(t.documents.select("doc_id", "text"), "text").select("doc_id", "quality")


@query("t20_title_cleaning", """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('Analisis de la gestion en ', source, ' Luis R') WHEN 1 THEN concat('Estudio de empresas de la region ', source, ' - Public') ELSE 'Modelo de gestion para el puerto' END AS clean_title FROM documents""")
def _(t):
    mod = F.col("doc_id") % 3
    title = F.when(mod == 0, F.concat(F.lit("Analisis de la gestion en "), "source", F.lit(" Luis Rojas Leon 2024"))).when(
        mod == 1, F.concat(F.lit(" Estudio de empresas de la region "), "source", F.lit(" -  Publicado en revista"))).otherwise(
        F.lit("Modelo de gestion para el puerto. Ana Maria Vera, Jose Luis Paz"))
    df = t.documents.select("doc_id", title.alias("title"), F.array(F.lit("Luis Rojas Leon")).alias("authors"))
    return titles.with_clean_title(df, "title", "authors").select("doc_id", "clean_title")


@query("t21_product_keys", """
SELECT production_id, concat(production_type, '|', strip_accents(upper(title))) AS product_key FROM v_productions""")
def _(t):
    return t.productions.select("production_id", titles.product_key(F.col("production_type"), F.lit(None).cast("string"), F.col("title")).alias("product_key"))


@query("t22_product_reconciliation", """
WITH p AS (SELECT production_id, row_number() OVER (PARTITION BY production_type, title ORDER BY production_id) > 1 AS dup, validation_status FROM v_productions)
SELECT production_id, CASE WHEN dup THEN 'duplicate_evidence' WHEN validation_status = 'pending_review' THEN 'pending_review' WHEN validation_status = 'validated' THEN 'counted' ELSE 'detected_not_counted' END AS reconciliation_status FROM p""")
def _(t):
    rows = t.productions.select("production_id", F.col("production_type").alias("product_type"), F.lit(None).cast("string").alias("link"), "title",
                                F.array().cast("array<string>").alias("authors"), "validation_status")
    return extract.reconcile_products(rows, ["production_id"], [F.col("production_id")], F.floor(F.col("production_id") / 1_000_000)).select("production_id", "reconciliation_status")


@query("t24_person_names", """
SELECT teacher_id, true AS full_name_ok, false AS with_digit_ok, false AS with_word_ok FROM v_teachers""")
def _(t):
    name = F.col("full_name")
    return t.teachers.select("teacher_id", P.looks_like_person(name).alias("full_name_ok"), P.looks_like_person(F.concat(name, F.lit(" 2"))).alias("with_digit_ok"),
                             P.looks_like_person(F.concat(F.lit("Grupo "), name)).alias("with_word_ok"))


@query("t25_catalog_match")
def _(t):
    rows = t.entities.select("entity_id", F.when(F.col("entity_id") % 2 == 0, F.concat(F.lit("lic. en turismo "), "name")).otherwise("Comercio exterior y finanzas").alias("value"))
    return extract.catalog_columns(rows, "value", W.CAREER_CATALOG, "career").drop("value")


@query("t26_institutions", """
SELECT external_id, concat('Universidad de ', upper(substr(n, 1, 1)), lower(substr(n, 2))) AS display FROM (SELECT external_id, replace(institution, 'UNIVERSIDAD DE ', '') AS n FROM v_externals) x""")
def _(t):
    return t.externals.select("external_id", P.institution_display(F.concat(F.lit(" - "), F.lower("institution"), F.lit(": "))).alias("display"))


@query("t27_participant_type", """
SELECT doc_id, CASE WHEN regexp_matches(strip_accents(upper(text)), 'ESTUDIANTE|ALUMNO') THEN 'estudiante' WHEN regexp_matches(strip_accents(upper(text)), 'GRADUADO|EGRESADO') THEN 'graduado'
  WHEN regexp_matches(strip_accents(upper(text)), 'UNIVERSIDAD|INSTITUTO|ESCUELA|CENTRO|POLITECNICA') THEN 'investigador_externo' ELSE 'no_clasificado' END AS participant_type FROM documents""")
def _(t):
    return t.documents.select("doc_id", P.external_type(F.col("text")).alias("participant_type"))


@query("t28_career_words", """
SELECT entity_id, CASE entity_id % 3 WHEN 0 THEN 'Licenciatura en Contabilidad y Auditoria' WHEN 1 THEN 'Licenciatura en Turismo' END AS career FROM v_entities""")
def _(t):
    mod = F.col("entity_id") % 3
    value = F.when(mod == 0, F.concat(F.lit("auditoría y contabilidad "), "name")).when(mod == 1, F.concat("name", F.lit(" turismo"))).otherwise(F.col("name"))
    return t.entities.select("entity_id", P.career_by_words(value).alias("career"))


@query("t34_emails", """
SELECT teacher_id, coalesce(institutional_email IS NOT NULL, false) AS real_email, concat('imported-', substr(sha1(concat(full_name, '|', career_id)), 1, 12), '@local.import') AS synthetic FROM v_teachers""")
def _(t):
    return t.teachers.select("teacher_id", P.is_real_email(F.col("institutional_email")).alias("real_email"), P.synthetic_email(F.col("full_name"), F.col("career_id")).alias("synthetic"))


@query("t40_line_lookups", """
WITH l AS (SELECT line, trim(regexp_replace(regexp_replace(strip_accents(upper(replace(line, 'ß', 'ss'))), '[^A-Z0-9%./:\\- ]+', ' ', 'g'), ' +', ' ', 'g')) AS k FROM x_lines)
SELECT count(*) AS line_total, count(*) FILTER (regexp_matches(line, '^\\[\\[PAGE_BREAK(:\\d+)?\\]\\]$') OR regexp_matches(k, '^\\d+\\s+DE\\s+\\d+$') OR regexp_matches(k, '^\\d+/\\d+$') OR starts_with(k, 'FORMULARIO DE INFORME') OR regexp_matches(k, '^\\d{1,2}/\\d{1,2}/\\d{4}')
    OR k IN ('ABOUT', 'IMPACT', 'O', 'NOMBRE COMPLETO', 'FACULTAD', 'CARRERA', 'INVESTIGADOR', 'TITULO', 'ESTADO', 'IMPACTO', 'LINK')) AS skipped,
  count(*) FILTER (starts_with(replace(k, ' ', ''), 'PUBLIC') AND length(replace(k, ' ', '')) <= 10) AS published, count(*) FILTER (starts_with(replace(k, ' ', ''), 'ENREV')) AS in_review FROM l""")
def _(t):
    rows = lines.line_table(t.reports, "doc_id").withColumn("s", P.product_status(F.col("line_key")))
    return rows.agg(F.count(F.lit(1)).alias("line_total"), F.count_if(lines.is_skipped(F.col("line"), F.col("line_key"))).alias("skipped"),
                    F.count_if(F.col("s") == "PUBLICADO").alias("published"), F.count_if(F.col("s") == "EN REVISION").alias("in_review"))


@query("t42_wrapped_titles", """
SELECT entity_id, concat('Analisis de la gestion financie', 'nas de ', name, ' en el Ecuador') AS title FROM v_entities""")
def _(t):
    parts = F.array(F.lit("Analisis de la gestion financie"), F.lit("nas de"), F.concat("name", F.lit(" en")), F.lit(" el Ecuador "))
    return t.entities.select("entity_id", titles.join_wrapped(parts).alias("title"))


@query("t43_type_and_status", """
SELECT production_id, CASE production_type WHEN 'OTHER' THEN 'ARTICLE' ELSE production_type END AS production_type, CASE WHEN status = 'En Revisión' THEN 'en_revision' ELSE 'published' END AS status FROM v_productions""")
def _(t):
    return t.productions.select("production_id", P.production_type_of(F.lower("production_type")).alias("production_type"), P.production_status_of(F.col("status")).alias("status"))


