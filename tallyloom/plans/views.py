"""Domain views over the test tables, one SQL text shared by Spark and the SQL twin.

A view names its inputs in braces: a base table or another view. Spark binds them as DataFrames;
the twin gets them as a chain of common table expressions.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "v_faculties": """
SELECT CAST(r_regionkey AS BIGINT) AS faculty_id,
  CASE WHEN r_regionkey = 1 THEN 'Facultad de Ciencias Administrativas' ELSE r_name END AS name
FROM {region}""",
    "v_careers": """
SELECT CAST(n_nationkey AS BIGINT) AS career_id, CAST(n_regionkey AS BIGINT) AS faculty_id, n_name AS name
FROM {nation}""",
    "v_teachers": """
SELECT c_custkey AS teacher_id, CAST(c_nationkey AS BIGINT) AS career_id,
  concat(split_part('PAREDES,RUIZ,SUÁREZ,MENA,VERA,CRUZ,ROJAS,LEÓN,MORA,SOLIS,PAZ,RIOS', ',', CAST(c_custkey % 12 + 1 AS INT)), ' ',
    split_part('ARIAS,BRAVO,CEDEÑO,DUARTE,ESPIN,FLORES,GARCES,HERRERA,IBARRA,JARA,LARA', ',', CAST(c_custkey % 11 + 1 AS INT)), ' ',
    split_part('ANA,LUIS,ROSA,PEDRO,ELENA,MARCO,NORA', ',', CAST(c_custkey % 7 + 1 AS INT)), ' ',
    split_part('MARÍA,JOSÉ,ISABEL,ANDRES,LUCIA', ',', CAST(c_custkey % 5 + 1 AS INT))) AS full_name,
  c_acctbal >= 0 AS is_active, c_mktsegment AS segment,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE c_custkey END AS job_id,
  CASE WHEN c_acctbal >= 1000 THEN 'validated' WHEN c_acctbal >= 0 THEN 'pending_review' ELSE 'discarded_invalid' END AS validation_status,
  CASE WHEN c_mktsegment = 'BUILDING' THEN concat('docente', CAST(c_custkey AS STRING), '@correo.edu') ELSE NULL END AS institutional_email,
  CAST(floor(c_acctbal / 500) AS INT) AS research_hours
FROM {customer}""",
    "v_externals": """
SELECT s_suppkey AS external_id, s_name AS full_name, s_acctbal < 0 AS requires_review,
  concat('UNIVERSIDAD DE ', n_name) AS institution
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "v_productions": """
SELECT o_orderkey AS production_id, o_custkey AS teacher_id,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderkey END AS job_id,
  CAST(o_custkey AS BIGINT) AS entity_id,
  CAST(year(o_orderdate) AS INT) AS yr, CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS cycle,
  CAST(year(o_orderdate) * 10 + CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS BIGINT) AS period_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'ARTICLE' WHEN '2-HIGH' THEN 'BOOK' WHEN '3-MEDIUM' THEN 'BOOK_CHAPTER'
    WHEN '5-LOW' THEN 'PRESENTATION' ELSE 'OTHER' END AS production_type,
  CASE o_orderstatus WHEN 'F' THEN 'validated' WHEN 'O' THEN 'pending_review' ELSE 'discarded_invalid' END AS validation_status,
  CASE WHEN o_totalprice > 300000 THEN 'Publicado' WHEN o_totalprice > 150000 THEN 'En Revisión' ELSE 'borrador' END AS status,
  concat('Estudio del caso ', CAST(o_custkey AS STRING), ' sobre gestión ', lower(o_orderpriority)) AS title,
  o_orderdate AS created_at, o_totalprice AS amount
FROM {orders}""",
    "v_periods": """
SELECT DISTINCT period_id, yr, cycle FROM {v_productions}""",
    "v_authors": """
SELECT concat(CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING), ':', CAST(l_partkey AS STRING), ':', CAST(l_suppkey AS STRING)) AS author_id,
  l_orderkey AS production_id, l_linenumber AS author_order,
  CASE WHEN l_linenumber <= 2 THEN l_suppkey ELSE NULL END AS teacher_id,
  CASE WHEN l_linenumber > 2 THEN l_suppkey ELSE NULL END AS external_id,
  l_partkey AS entity_id,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE l_orderkey END AS job_id,
  CASE WHEN l_linenumber <= 2 THEN 'docente_interno' WHEN l_linenumber = 6 THEN 'estudiante' ELSE 'investigador_externo' END AS person_type,
  CASE l_returnflag WHEN 'A' THEN 'validated' WHEN 'N' THEN 'pending_review' ELSE 'discarded_invalid' END AS validation_status,
  l_linestatus = 'F' AS identity_locked, l_discount AS confidence, l_shipdate AS created_at,
  CASE WHEN l_linenumber % 2 = 0 THEN concat('pending:', CAST(l_suppkey AS STRING), '-', CAST(l_linenumber AS STRING))
    WHEN l_linenumber = 1 THEN concat('teacher:', CAST(l_suppkey AS STRING))
    WHEN l_linenumber = 7 THEN NULL ELSE concat('external:', CAST(l_suppkey AS STRING)) END AS canonical_key,
  concat('Persona ', CAST(l_suppkey AS STRING)) AS canonical_name,
  CASE WHEN l_tax > 0.04 THEN 'sin corroboracion' ELSE NULL END AS reason
FROM {lineitem}""",
    "v_roles": """
SELECT o_orderkey AS role_id,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey END AS teacher_id,
  CASE WHEN o_orderpriority = '5-LOW' THEN CAST(floor(o_custkey / 15) AS BIGINT) ELSE NULL END AS external_id,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE o_orderkey END AS job_id,
  CAST(o_custkey AS BIGINT) AS entity_id,
  CASE WHEN o_totalprice > 250000 THEN o_orderkey ELSE NULL END AS production_id,
  CAST(year(o_orderdate) * 10 + CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS BIGINT) AS period_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'director' WHEN '2-HIGH' THEN 'miembro' WHEN '3-MEDIUM' THEN 'coordinador'
    WHEN '5-LOW' THEN 'investigador_externo' ELSE 'autor_producto' END AS role_type,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'external_researcher' ELSE 'teacher' END AS person_type,
  CASE o_orderstatus WHEN 'F' THEN 'validated' WHEN 'O' THEN 'pending_review' ELSE 'discarded' END AS validation_status,
  CASE WHEN o_orderpriority = '5-LOW' THEN concat('external:', CAST(CAST(floor(o_custkey / 15) AS BIGINT) AS STRING))
    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
    WHEN o_orderpriority = '2-HIGH' THEN concat('pending:', CAST(o_custkey AS STRING), '-', CAST(month(o_orderdate) AS STRING))
    ELSE concat('teacher:', CAST(o_custkey AS STRING)) END AS canonical_key,
  concat('p', CAST(o_custkey AS STRING)) AS person_key,
  concat('Persona ', CAST(CAST(floor(o_custkey / 20) AS BIGINT) AS STRING)) AS canonical_name,
  o_totalprice > 300000 AS identity_locked, round(o_totalprice / 500000, 3) AS confidence,
  CASE WHEN o_totalprice > 400000 THEN 'clave exacta' ELSE NULL END AS reason,
  o_orderdate AS created_at
FROM {orders}""",
    "v_entities": """
SELECT p_partkey AS entity_id, p_name AS name, p_brand AS code,
  CASE p_type WHEN 'ECONOMY' THEN 'proyecto_fci' WHEN 'PROMO' THEN 'semillero' WHEN 'LARGE' THEN 'grupo_investigacion'
    WHEN 'SMALL' THEN 'linea_investigacion' ELSE 'otro' END AS entity_type,
  CAST(p_size * 2.3 AS DOUBLE) AS progress,
  CASE WHEN p_size % 3 = 0 THEN 'Aprobado' WHEN p_size % 3 = 1 THEN 'Vigente' ELSE 'en_proceso' END AS status,
  CASE WHEN p_size <= 30 THEN 'validated' WHEN p_size <= 42 THEN 'pending_review' ELSE 'discarded_invalid' END AS validation_status,
  concat('Licenciatura en Nation_', CAST(p_size % 25 AS STRING)) AS career_name,
  CAST((1995 + p_size % 7) * 10 + 1 + p_partkey % 2 AS BIGINT) AS period_id,
  CASE WHEN p_type = 'MEDIUM' THEN NULL ELSE p_partkey END AS job_id,
  concat('Director ', p_brand) AS director_name, p_retailprice AS budget
FROM {part}""",
    "v_jobs": """
SELECT event_id AS job_id,
  concat('doc:', CAST(user_id AS STRING), ':', CAST(event_id % 17 AS STRING)) AS document_key,
  ts AS created_at, CAST(floor(event_id / 100) AS BIGINT) AS batch_id, user_id,
  CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'view' THEN 'PROCESSING' WHEN 'click' THEN 'QUEUED'
    WHEN 'error' THEN 'ERROR' ELSE 'REQUIRES_REVIEW' END AS status, value, props
FROM {events}""",
    "v_audits": """
SELECT event_id AS audit_id, event_id AS job_id,
  CASE WHEN value < 35 THEN 'scientific_production' WHEN value < 70 THEN 'research_entity' ELSE 'teacher' END AS entity_type,
  CASE WHEN value < 2 THEN NULL ELSE CAST(floor(event_id / 2) AS BIGINT) END AS record_id,
  CASE event_type WHEN 'purchase' THEN 'persisted' WHEN 'view' THEN 'merged_duplicate' WHEN 'click' THEN 'requires_review'
    ELSE 'discarded' END AS action,
  concat('valor ', CAST(user_id AS STRING)) AS raw_value,
  CASE WHEN value < 60 THEN 'produccion_cientifica' ELSE 'integrantes' END AS source_section, value AS confidence
FROM {events}""",
    "v_decisions": """
SELECT doc_id AS case_id, doc_id AS target_id,
  CASE quality WHEN 1 THEN 'validated' ELSE 'discarded' END AS scientific_status,
  toxic = 0 AS approved,
  CASE WHEN doc_id % 3 = 0 THEN concat('human:', CAST(doc_id % 50 AS STRING)) ELSE NULL END AS identity_key,
  CASE WHEN doc_id % 3 = 0 THEN concat('Nombre ', CAST(doc_id % 25 AS STRING)) ELSE NULL END AS identity_name,
  CASE WHEN doc_id % 2 = 0 THEN 'global_identity' ELSE 'record' END AS scope
FROM {labels}""",
    "v_files": """
SELECT page_id AS file_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE concat('f', CAST(page_id % 60 AS STRING)) END AS external_id,
  CASE WHEN page_id % 4 = 0 THEN NULL ELSE concat('r', CAST(page_id % 6 AS STRING)) END AS rev,
  regexp_replace(url, '^https?://[^/]*', '') AS path, concat(' ', split_part(url, '/', 5), ' ') AS name, CAST(length(html) AS BIGINT) AS size_bytes
FROM {pages}""",
    "v_traces": """
SELECT doc_id AS trace_id, doc_id AS job_id, CAST(floor(doc_id / 2) AS BIGINT) AS report_id,
  concat('/Informes/', source, '/Doc ', CAST(doc_id % 40 AS STRING), '.pdf') AS source_path,
  CASE WHEN n_chars < 500 THEN 'PENDIENTE_REVISION' WHEN n_chars < 1500 THEN 'REQUIERE_REVISION_TIPO_DOCUMENTO'
    WHEN n_chars < 4000 THEN 'VALIDADO' ELSE 'RECHAZADO' END AS review_status,
  lang, source, n_chars, text
FROM {documents}""",
    "v_progress": """
SELECT o_orderkey AS report_id,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderkey END AS job_id,
  CAST(year(o_orderdate) AS INT) AS yr, CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS cycle,
  concat(' Licenciatura  en ', n_name) AS career_name,
  concat('Docente ', CAST(CAST(floor(o_custkey / 10) AS BIGINT) AS STRING)) AS teacher_name,
  CAST(o_custkey % 4 AS INT) AS articles, CAST(o_custkey % 3 AS INT) AS books,
  CAST(o_custkey % 2 AS INT) AS book_chapters, CAST(o_custkey % 5 AS INT) AS presentations,
  CAST(o_custkey % 6 AS INT) AS projects, o_orderdate AS created_at
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "v_career_years": """
SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS career_id, CAST(year(o_orderdate) AS INT) AS yr
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "v_goals": """
SELECT career_id, yr, 'SCIENTIFIC_OUTPUT' AS metric, 5 + career_id AS planned_value FROM {v_career_years}
UNION ALL SELECT career_id, yr, 'ARTICLES', 3 + career_id FROM {v_career_years}
UNION ALL SELECT career_id, yr, 'BOOKS', 2 + career_id FROM {v_career_years}
UNION ALL SELECT career_id, yr, 'PROJECTS', 1 + career_id FROM {v_career_years}""",
    "v_review_items": """
SELECT event_id AS item_id, concat('caso-', CAST(event_id AS STRING)) AS public_id,
  CASE event_type WHEN 'error' THEN 'product_validation' WHEN 'view' THEN 'identity_conflict' WHEN 'click' THEN 'project_director'
    WHEN 'purchase' THEN 'possible_duplicate' ELSE 'external_institution' END AS case_type,
  CASE event_type WHEN 'error' THEN 'scientific_productions' WHEN 'view' THEN 'teachers' WHEN 'click' THEN 'research_entities'
    WHEN 'purchase' THEN 'person_roles' ELSE 'external_researchers' END AS target_table,
  CASE event_type WHEN 'purchase' THEN event_id ELSE CAST(floor(event_id / 5) AS BIGINT) END AS target_pk,
  CASE WHEN value < 20 THEN 'pending' WHEN value < 50 THEN 'in_review' WHEN value < 80 THEN 'resolved' ELSE 'reopened' END AS case_status,
  CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST(user_id % 7 AS INT) END AS manual_priority, CAST(floor(value) AS INT) AS automatic_priority,
  concat('rev-', CAST(user_id AS STRING)) AS source_revision, CAST(floor(event_id / 5) AS BIGINT) AS document_id, ts AS created_at
FROM {events}""",
    "v_targets": """
SELECT 'scientific_productions' AS target_table, production_id AS target_pk, job_id, title AS label FROM {v_productions}
UNION ALL SELECT 'person_roles', role_id, job_id, canonical_name FROM {v_roles}
UNION ALL SELECT 'research_entities', entity_id, job_id, name FROM {v_entities}
UNION ALL SELECT 'teachers', teacher_id, job_id, full_name FROM {v_teachers}
UNION ALL SELECT 'external_researchers', external_id, CAST(NULL AS BIGINT), full_name FROM {v_externals}""",
    "v_users": """
SELECT CAST(r_regionkey AS BIGINT) AS user_id, 'faculty_admin' AS role, CAST(r_regionkey AS BIGINT) AS faculty_id, CAST(NULL AS BIGINT) AS career_id FROM {region}
UNION ALL SELECT 100 + CAST(n_nationkey AS BIGINT), 'career_manager', CAST(NULL AS BIGINT), CAST(n_nationkey AS BIGINT) FROM {nation}
UNION ALL SELECT 1000 + CAST(n_nationkey AS BIGINT), 'teacher', CAST(n_regionkey AS BIGINT), CAST(n_nationkey AS BIGINT) FROM {nation}""",
    "v_projects": """
SELECT p_partkey AS project_id, concat(p_brand, '-', CAST(p_size AS STRING)) AS code, p_name AS name,
  CAST((1995 + p_size % 7) * 10 + 1 + p_partkey % 2 AS BIGINT) AS period_id,
  CASE p_type WHEN 'PROMO' THEN 'semillero' ELSE 'proyecto_fci' END AS entity_type, concat('Director ', p_brand) AS director_name
FROM {part}""",
    "v_mention_names": """
SELECT teacher_id AS mention_id, CAST(floor(teacher_id / 5) AS BIGINT) AS document_id,
  CASE teacher_id % 4
    WHEN 0 THEN full_name
    WHEN 1 THEN concat(split_part(full_name, ' ', 3), ' ', split_part(full_name, ' ', 4), ' ', split_part(full_name, ' ', 1), ' ', split_part(full_name, ' ', 2))
    WHEN 2 THEN concat(split_part(full_name, ' ', 3), ' de ', split_part(full_name, ' ', 1), ' ', split_part(full_name, ' ', 2))
    ELSE concat(split_part(full_name, ' ', 3), ' ', split_part(full_name, ' ', 4), 'X ', lower(split_part(full_name, ' ', 1)), ' ', split_part(full_name, ' ', 2)) END AS raw_name,
  concat(split_part(full_name, ' ', 3), ' ', split_part(full_name, ' ', 4), ' ', split_part(full_name, ' ', 1), ' ', split_part(full_name, ' ', 2)) AS official_name,
  career_id, segment
FROM {v_teachers}""",
    "v_decision_log": """
SELECT conv_id AS case_id, turn + 1 AS seq, role, CASE WHEN turn % 3 = 2 THEN 'revert' WHEN turn % 2 = 0 THEN 'approve' ELSE 'correct' END AS action,
  CASE WHEN turn % 3 = 2 THEN turn ELSE NULL END AS reverts_seq, CAST(length(text) AS BIGINT) AS value,
  CASE WHEN conv_id % 3 = 0 THEN turn + 1 ELSE CAST(floor(turn / 2) AS INT) + 1 END AS expected_version,
  CASE turn WHEN 0 THEN 'pending' WHEN 1 THEN 'in_review' WHEN 2 THEN 'resolved' WHEN 3 THEN 'pending' WHEN 4 THEN 'in_review' WHEN 5 THEN 'conflicted' WHEN 6 THEN 'resolved' ELSE 'superseded' END AS case_status
FROM {conversations}""",
    "v_audit_events": """
SELECT conv_id AS aggregate_key, turn AS seq, role AS event_type, text AS payload FROM {conversations}""",
    "v_reports": """
SELECT doc_id, lang, source, concat('Formulario de informe', chr(10),
  'Periodo: 2025 ciclo ', CASE WHEN doc_id % 2 = 0 THEN 'II' ELSE 'I' END, chr(10),
  '13. Investigadores que participan en el proyecto', chr(10), 'ANA MARÍA PAREDES RUIZ', chr(10),
  'FACULTAD DE CIENCIAS ADMINISTRATIVAS', chr(10), 'CARRERA DE NATION_', CAST(doc_id % 25 AS STRING), chr(10),
  'PROYECTOS FCI', chr(10), 'FCI', CAST(100 + doc_id % 900 AS STRING), '-2025', chr(10),
  'Gestion de recursos ', lang, chr(10), 'ROSA ELENA MENA VERA', chr(10), '[[PAGE_BREAK:4]]', chr(10), CAST(doc_id % 101 AS STRING), '%', chr(10), 'VIGENTE', chr(10),
  'Producción científica impacto mundial y regional', chr(10),
  'Analisis de la gestion financiera en empresas ', lang, ' ', source, chr(10),
  'LUIS JOSE ROJAS LEON', chr(10), CASE WHEN doc_id % 2 = 0 THEN 'PUBLICADO' ELSE 'EN REVISION' END, chr(10), '[[PAGE_BREAK]]', chr(10), 'Impacto regional', chr(10), 'Evidencias', chr(10),
  text) AS text
FROM {documents}""",
}

_NAME = re.compile(r"\{(\w+)\}")


@cache
def _needs(name: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(_NAME.findall(VIEWS[name])))


class Tables:
    """Lazy access to base tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            key = name
        elif f"v_{name}" in VIEWS:
            key = f"v_{name}"
        elif name in VIEWS:
            key = name
        else:
            raise AttributeError(name)
        if key not in self._frames:
            if key in BASE:
                frame = self.spark.read.parquet(f"{self.sf_dir}/{key}.parquet")
            else:
                frame = self.spark.sql(VIEWS[key], **{n: getattr(self, n) for n in _needs(key)})
            self._frames[key] = frame
        return self._frames[key]


def with_views(sql: str) -> str:
    """Prefix a query with the views it names, inputs first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered or name not in VIEWS:
            return
        for need in _needs(name):
            visit(need)
        ordered.append(name)

    text = sql.strip().rstrip(";")
    for name in re.findall(r"\b[vx]_\w+", text):
        visit(name)
    if not ordered:
        return text
    parts = [f"{n} AS ({_NAME.sub(lambda m: m.group(1), VIEWS[n]).strip()})" for n in ordered]
    match = re.match(r"(?is)with\s+(recursive\s+)?", text)
    if match:
        return f"WITH {match.group(1) or ''}{', '.join(parts)}, {text[match.end():]}"
    return f"WITH {', '.join(parts)} {text}"


# Intermediate results of the SQL twins; Spark computes these through the operators instead.
TWINS: dict[str, str] = {
    "x_job_state": """
SELECT *, final AND job_id = max(CASE WHEN final THEN job_id END) OVER (PARTITION BY document_key) AS is_current,
  CASE WHEN final THEN max(CASE WHEN final THEN job_id END) OVER (PARTITION BY document_key ORDER BY job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS supersedes_id
FROM (SELECT *, status NOT IN ('ERROR', 'QUEUED', 'PROCESSING') AS final FROM {v_jobs}) j""",
    "x_current": "SELECT job_id FROM {x_job_state} WHERE is_current AND status = 'SUCCESS'",
    "x_audited": """
SELECT DISTINCT entity_type, record_id FROM {v_audits} WHERE record_id IS NOT NULL
  AND job_id IN (SELECT job_id FROM {x_current})""",
    "x_productions": """
SELECT p.*, coalesce(CASE WHEN d.approved THEN d.scientific_status END, p.validation_status) AS eff,
  coalesce(CASE WHEN d.approved THEN d.scientific_status END, p.validation_status) = 'validated'
    AND p.production_id IN (SELECT production_id FROM {v_authors} WHERE validation_status = 'validated') AS is_valid
FROM {v_productions} p LEFT JOIN {v_decisions} d ON d.target_id = p.production_id
WHERE p.job_id IS NULL OR p.job_id IN (SELECT job_id FROM {x_current})
  OR p.production_id IN (SELECT record_id FROM {x_audited} WHERE entity_type = 'scientific_production')""",
    "x_entities": """
SELECT * FROM {v_entities} WHERE job_id IS NULL OR job_id IN (SELECT job_id FROM {x_current})
  OR entity_id IN (SELECT record_id FROM {x_audited} WHERE entity_type = 'research_entity')""",
    "x_roles": """
SELECT r.*, t.career_id, coalesce(CASE WHEN d.approved THEN d.scientific_status END, r.validation_status) AS eff,
  coalesce(d.approved AND d.identity_key IS NOT NULL, false)
    OR (r.person_type = 'teacher' AND coalesce(t.validation_status = 'validated', false))
    OR (r.person_type = 'external_researcher' AND coalesce(NOT e.requires_review, false)) AS identity_valid,
  CASE WHEN d.approved THEN d.identity_key END AS overlay_key, CASE WHEN d.approved THEN d.identity_name END AS overlay_name,
  CASE WHEN d.approved THEN d.scope END AS overlay_scope, t.institutional_email AS email,
  coalesce(c.name, e.institution) AS affiliation
FROM {v_roles} r LEFT JOIN {v_teachers} t ON r.teacher_id = t.teacher_id LEFT JOIN {v_careers} c ON t.career_id = c.career_id
LEFT JOIN {v_externals} e ON r.external_id = e.external_id LEFT JOIN {v_decisions} d ON d.target_id = r.role_id
WHERE r.job_id IS NULL OR r.job_id IN (SELECT job_id FROM {x_current})""",
    "x_valid_roles": "SELECT * FROM {x_roles} WHERE eff = 'validated' AND identity_valid",
    "x_evidence": """
SELECT p.production_id, coalesce(CASE WHEN p.job_id IN (SELECT job_id FROM {x_current}) THEN p.job_id END, a.job_id) AS evidence_job
FROM {x_productions} p LEFT JOIN (SELECT record_id, min(job_id) AS job_id FROM {v_audits}
  WHERE entity_type = 'scientific_production' AND source_section = 'produccion_cientifica' AND record_id IS NOT NULL
    AND job_id IN (SELECT job_id FROM {x_current}) GROUP BY record_id) a ON a.record_id = p.production_id""",
    "x_mentions": """
SELECT period_id, 'person_roles' AS source_table, CAST(role_id AS VARCHAR) AS source_id,
  coalesce(canonical_key, concat('legacy:', person_key)) AS source_key, overlay_key, overlay_name, overlay_scope,
  canonical_name AS row_name, CASE person_type WHEN 'teacher' THEN 'docente_interno' ELSE 'investigador_externo' END AS person_type,
  role_type, eff AS status, identity_locked AS locked, confidence,
  CASE WHEN job_id IS NULL THEN concat('role:', role_id) ELSE concat('job:', job_id) END AS document,
  entity_id, NULL::BIGINT AS production_id, affiliation, email, reason, career_id AS teacher_career,
  0 AS o1, 0::BIGINT AS o2, role_id AS o3, 0 AS o4, '' AS o5
FROM {x_roles}
UNION ALL
SELECT p.period_id, 'scientific_production_authors', a.author_id, coalesce(a.canonical_key, concat('legacy-author:', a.author_id)),
  NULL, NULL, NULL, a.canonical_name, a.person_type, 'autor_producto', a.validation_status, a.identity_locked, a.confidence,
  CASE WHEN v.evidence_job IS NULL THEN concat('production:', p.production_id) ELSE concat('job:', v.evidence_job) END,
  p.entity_id, p.production_id, coalesce(c.name, e.institution), NULL, a.reason, NULL,
  1, -epoch_us(p.created_at), -p.production_id, a.author_order, a.author_id
FROM {v_authors} a JOIN {x_productions} p ON a.production_id = p.production_id LEFT JOIN {x_evidence} v ON v.production_id = p.production_id
LEFT JOIN {v_teachers} t ON a.teacher_id = t.teacher_id LEFT JOIN {v_careers} c ON t.career_id = c.career_id
LEFT JOIN {v_externals} e ON a.external_id = e.external_id""",
    "x_redirects": """
SELECT source_key, min(overlay_key) AS redirect_key, arg_max(overlay_name, o3) AS redirect_name FROM {x_mentions}
WHERE overlay_key IS NOT NULL AND overlay_scope = 'global_identity' AND overlay_key <> source_key
GROUP BY source_key HAVING count(DISTINCT overlay_key) = 1""",
    "x_resolved": """
SELECT m.*, coalesce(overlay_key, redirect_key, m.source_key) AS key, coalesce(overlay_name, redirect_name, row_name) AS name,
  coalesce(overlay_key, redirect_key) IS NOT NULL AS by_review
FROM {x_mentions} m LEFT JOIN {x_redirects} r ON m.source_key = r.source_key
WHERE NOT (lower(status) LIKE 'discard%' OR lower(status) IN ('invalid', 'invalid_text_fragment', 'descartado'))""",
    "x_participants": """
SELECT c.*, n.canonical_name, n.identity_source, n.identity_locked, n.identity_confidence,
  any_valid AND NOT starts_with(canonical_identity_key, 'pending:') AS kpi_eligible,
  CASE WHEN any_valid AND NOT starts_with(canonical_identity_key, 'pending:') THEN 'validated' ELSE 'pending_review' END AS overall_status
FROM (SELECT key AS canonical_identity_key, count(DISTINCT document) AS participation_count,
    count(DISTINCT CASE WHEN source_table = 'person_roles' THEN source_id END) AS role_count,
    count(DISTINCT role_type) AS role_type_count, count(DISTINCT production_id) AS authorship_count,
    count(DISTINCT entity_id) AS entity_count, count(*) AS evidence_count, bool_or(status = 'validated') AS any_valid,
    CASE min(CASE person_type WHEN 'docente_interno' THEN 0 WHEN 'investigador_externo' THEN 1 ELSE 2 END)
      WHEN 0 THEN 'docente_interno' WHEN 1 THEN 'investigador_externo' ELSE 'estudiante' END AS person_type
  FROM {x_resolved} GROUP BY key) c
JOIN (SELECT key, name AS canonical_name, CASE WHEN by_review THEN 'human_review' ELSE 'legacy_fallback' END AS identity_source,
    by_review OR locked AS identity_locked, confidence AS identity_confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY locked DESC, confidence DESC, o1, CASE WHEN o1 = 0 THEN o3 END, o2, o3, o4) AS pick
    FROM (SELECT *, max(CASE WHEN by_review THEN ROW(o1, o2, o3, o4, o5) END) OVER (PARTITION BY key) AS last_review FROM {x_resolved}) s
    WHERE last_review IS NULL OR ROW(o1, o2, o3, o4, o5) >= last_review) q WHERE pick = 1) n ON n.key = c.canonical_identity_key""",
    "x_progress_kept": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY yr, cycle, dkey ORDER BY report_id DESC) AS rn FROM (
  SELECT p.*, t.review_status AS trace_status, coalesce('SOURCE:' || upper(t.source_path),
    concat_ws('|', 'SIGNATURE', yr, cycle, trim(regexp_replace(upper(career_name), ' +', ' ', 'g')), upper(teacher_name), articles, books, book_chapters, presentations, projects)) AS dkey
  FROM {v_progress} p LEFT JOIN (SELECT report_id, arg_max(source_path, trace_id) AS source_path, arg_max(review_status, trace_id) AS review_status FROM {v_traces} GROUP BY 1) t ON t.report_id = p.report_id
  WHERE p.job_id IN (SELECT job_id FROM {x_current})) k) q WHERE rn = 1""",
    "x_raw_lines": r"""
SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM (SELECT doc_id,
  list_filter(list_transform(string_split_regex(regexp_replace(text, '[\x00-\x08\x0b\x0e-\x1f]', '', 'g'), '\r\n|[\n\r]'),
    lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM {v_reports}) d""",
    "x_lines": r"""
SELECT doc_id, line, line_no, CASE WHEN base IS NULL AND cum = 0 THEN NULL ELSE coalesce(base, 1) + CAST(cum - coalesce(at_base, 0) AS INT) END AS page
FROM (SELECT *, last_value(p IGNORE NULLS) OVER w AS base, last_value(CASE WHEN p IS NOT NULL THEN cum END IGNORE NULLS) OVER w AS at_base FROM (
  SELECT *, sum(CASE WHEN line = '[[PAGE_BREAK]]' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS cum,
    CAST(coalesce(nullif(regexp_extract(line, '^\[\[PAGE_BREAK:(\d+)\]\]$', 1), ''), nullif(regexp_extract(upper(line), '^(\d+)\s+DE\s+\d+$', 1), ''), nullif(regexp_extract(line, '^(\d+)/\d+$', 1), '')) AS INT) AS p
  FROM {x_raw_lines}) a WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) b""",
    "x_sections": """
SELECT s.doc_id, s.kind, s.page, least(coalesce(lead(s.line_no) OVER (PARTITION BY s.doc_id ORDER BY s.line_no), e.last + 1), e.stop) - s.line_no - 1 AS line_count
FROM (SELECT doc_id, line_no, page, CASE WHEN starts_with(line, '13. Investigadores') THEN 'integrantes_internos' WHEN line = 'PROYECTOS FCI' THEN 'proyectos_fci' ELSE 'produccion_cientifica' END AS kind
  FROM {x_lines} WHERE line IN ('13. Investigadores que participan en el proyecto', 'PROYECTOS FCI', 'Producción científica impacto mundial y regional')) s
JOIN (SELECT doc_id, max(line_no) AS last, min(CASE WHEN line = 'Evidencias' THEN line_no END) AS stop FROM {x_lines} GROUP BY 1) e ON e.doc_id = s.doc_id""",
    "x_career_keys": """
SELECT career_id, name, trim(regexp_replace(replace(replace(strip_accents(upper(name)), 'LICENCIATURA EN ', ''), 'LICENCIATURA ', ''), '\\s+', ' ', 'g')) AS ck FROM {v_careers}""",
    "x_entity_careers": """
SELECT e.entity_id, c.career_id FROM (SELECT *, trim(regexp_replace(replace(replace(strip_accents(upper(career_name)), 'LICENCIATURA EN ', ''), 'LICENCIATURA ', ''), '\\s+', ' ', 'g')) AS ek FROM {v_entities}) e
JOIN {x_career_keys} c ON contains(ek, ck) OR contains(ck, ek)""",
}
VIEWS.update(TWINS)
