"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.text import identity_name_key
from tallyloom.operators import joins, kpis, names, skew
from tallyloom.plans.common import Facts
from tallyloom.plans.registry import query


@query("jn01_star_lookup", """
SELECT t.teacher_id, t.full_name, c.name AS career, f.name AS faculty FROM v_teachers t JOIN v_careers c ON c.career_id = t.career_id JOIN v_faculties f ON f.faculty_id = c.faculty_id""")
def _(t):
    home = t.careers.withColumnRenamed("name", "career").join(t.faculties.withColumnRenamed("name", "faculty"), "faculty_id")
    return t.teachers.join(home, "career_id").select("teacher_id", "full_name", "career", "faculty")


@query("jn02_optional_lookups", """
SELECT r.role_id, j.status AS job_status, t.full_name AS teacher, e.name AS entity, p.yr, x.institution FROM v_roles r
LEFT JOIN v_jobs j ON j.job_id = r.job_id LEFT JOIN v_teachers t ON t.teacher_id = r.teacher_id LEFT JOIN v_entities e ON e.entity_id = r.entity_id
LEFT JOIN v_periods p ON p.period_id = r.period_id LEFT JOIN v_externals x ON x.external_id = r.external_id""")
def _(t):
    return (
        t.roles.select("role_id", "job_id", "teacher_id", "entity_id", "period_id", "external_id")
        .join(t.jobs.select("job_id", F.col("status").alias("job_status")), "job_id", "left")
        .join(t.teachers.select("teacher_id", F.col("full_name").alias("teacher")), "teacher_id", "left")
        .join(t.entities.select("entity_id", F.col("name").alias("entity")), "entity_id", "left")
        .join(t.periods.select("period_id", "yr"), "period_id", "left")
        .join(t.externals.select("external_id", "institution"), "external_id", "left")
        .select("role_id", "job_status", "teacher", "entity", "yr", "institution")
    )


@query("jn03_production_authors", """
SELECT p.production_id, a.author_id, count(a.author_id) OVER (PARTITION BY p.production_id) AS author_count,
  CASE WHEN a.author_id IS NOT NULL THEN row_number() OVER (PARTITION BY p.production_id ORDER BY a.author_order, a.author_id) END AS author_position
FROM v_productions p LEFT JOIN v_authors a ON a.production_id = p.production_id""")
def _(t):
    return joins.ordered_authors(t.productions, t.authors).select("production_id", "author_id", "author_count", "author_position")


@query("jn04_project_teachers", """
SELECT DISTINCT a.entity_id, a.teacher_id, CASE WHEN a.author_order = 1 THEN 'director' ELSE 'miembro' END AS role
FROM v_authors a JOIN v_teachers t ON t.teacher_id = a.teacher_id WHERE t.career_id = 3""")
def _(t):
    people = t.teachers.filter("career_id = 3").select("teacher_id")
    role = F.when(F.col("author_order") == 1, "director").otherwise("miembro")
    return t.authors.join(people, "teacher_id", "left_semi").select("entity_id", "teacher_id", role.alias("role")).distinct()


@query("jn05_has_validated_author", """
SELECT production_id FROM v_productions p WHERE EXISTS (SELECT 1 FROM v_authors a WHERE a.production_id = p.production_id AND a.validation_status = 'validated')""")
def _(t):
    return t.productions.join(t.authors.filter("validation_status = 'validated'"), "production_id", "left_semi").select("production_id")


@query("jn06_missing_authors", """
SELECT p.production_id, p.teacher_id, coalesce((SELECT max(author_order) FROM v_authors a WHERE a.production_id = p.production_id), 0) + 1 AS author_order
FROM v_productions p JOIN v_teachers t ON t.teacher_id = p.teacher_id
WHERE NOT EXISTS (SELECT 1 FROM v_authors a WHERE a.production_id = p.production_id AND (a.teacher_id = p.teacher_id OR upper(a.canonical_name) = strip_accents(upper(t.full_name))))""")
def _(t):
    return joins.missing_teacher_authors(t.productions, t.authors, t.teachers)


@query("jn07_changed_rows", """
SELECT teacher_id FROM v_teachers WHERE segment IS DISTINCT FROM CASE WHEN is_active THEN segment ELSE NULL END OR institutional_email IS DISTINCT FROM lower(institutional_email)
  OR research_hours IS DISTINCT FROM greatest(research_hours, 0)""")
def _(t):
    after = t.teachers.select(
        "teacher_id", F.when(F.col("is_active"), F.col("segment")).alias("segment"), F.lower("institutional_email").alias("institutional_email"),
        F.greatest("research_hours", F.lit(0)).alias("research_hours"))
    return joins.changed_rows(t.teachers, after, "teacher_id", ["segment", "institutional_email", "research_hours"]).select("teacher_id")


@query("jn08_loose_career_match", "SELECT entity_id, career_id FROM x_entity_careers")
def _(t):
    return Facts(t).entity_careers


@query("jn09_longest_match", """
SELECT r.doc_id, (SELECT c.career_id FROM v_careers c WHERE contains(strip_accents(upper(r.text)), c.name) ORDER BY length(c.name) DESC, c.career_id LIMIT 1) AS career_id FROM v_reports r""")
def _(t):
    return joins.longest_match(t.reports, "doc_id", "text", t.careers, "career_id", "name")


@query("jn10_first_match", """
SELECT v.value, CASE WHEN v.value = '' THEN 0::BIGINT ELSE (SELECT min(c.career_id) FROM x_career_keys c
    WHERE contains(replace(upper(v.value), 'LICENCIATURA EN ', ''), c.ck) OR contains(c.ck, replace(upper(v.value), 'LICENCIATURA EN ', ''))) END AS career_id
FROM (SELECT DISTINCT career_name AS value FROM v_entities UNION SELECT DISTINCT name FROM v_entities UNION SELECT '') v""")
def _(t):
    values = t.entities.select(F.explode(F.array("career_name", "name", F.lit(""))).alias("value"))
    return joins.first_match(values, "value", t.careers)


@query("jn11_previous_period", """
SELECT p.period_id, CASE WHEN cycle = 2 THEN (SELECT q.period_id FROM v_periods q WHERE q.yr = p.yr AND q.cycle = 1)
  ELSE (SELECT max(q.period_id) FROM v_periods q WHERE q.yr < p.yr AND q.cycle = 2) END AS previous_id FROM v_periods p""")
def _(t):
    return kpis.previous_periods(t.periods)


@query("jn12_newest_trace", """
SELECT p.report_id, t.trace_id, t.review_status FROM v_progress p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY trace_id DESC) AS rn FROM v_traces) t
  ON t.report_id = p.report_id AND t.rn = 1""")
def _(t):
    newest = skew.pick(t.traces.select("report_id", "trace_id", "review_status"), ["report_id"], F.col("trace_id"))
    return t.progress.select("report_id").join(newest, "report_id", "left").select("report_id", "trace_id", "review_status")


PAIRS = """
WITH h AS (SELECT trace_id AS id, lower(source_path) AS path FROM v_traces WHERE lang <> 'en'), c AS (SELECT trace_id AS id, lower(source_path) AS path FROM v_traces WHERE lang = 'en'),
n AS (SELECT path, count(*) AS n, min(id) AS id FROM c GROUP BY 1)"""


def _pairs(t):
    rows = t.traces.select(F.col("trace_id").alias("id"), F.lower("source_path").alias("path"), "lang")
    return joins.exact_pairs(rows.filter("lang <> 'en'"), rows.filter("lang = 'en'"), ["path"])


@query("jn13_exact_pairs", PAIRS + """
SELECT h.id AS historical_id, CASE WHEN n.n IS NULL THEN 'unmatched' WHEN n.n = 1 THEN 'paired' ELSE 'ambiguous' END AS outcome, CASE WHEN n.n = 1 THEN n.id END AS current_id
FROM h LEFT JOIN n ON n.path = h.path""")
def _(t):
    return _pairs(t)


@query("jn14_fuzzy_person_match")
def _(t):
    best = names.best_match(t.mention_names, "raw_name", t.mention_names, "mention_id", "official_name")
    return t.mention_names.select("mention_id", "raw_name").join(best, "raw_name", "left").select("mention_id", "match_id", "match_name", "score")


@query("jn15_project_evidence", """
WITH e AS (SELECT entity_id, entity_type, period_id, lower(concat(code, '-', CAST(CAST(round(progress / 2.3) AS INT) AS VARCHAR))) AS code, lower(name) AS name FROM v_entities),
p AS (SELECT project_id, period_id, lower(code) AS code, lower(name) AS name FROM v_projects),
m AS (SELECT e.entity_id, e.entity_type, count(*) FILTER ((p.code = e.code AND p.name <> e.name) OR (p.name = e.name AND p.code <> e.code)) AS bad,
  count(*) FILTER (p.code = e.code) AS ok, min(p.project_id) FILTER (p.code = e.code) AS pid FROM e LEFT JOIN p ON p.period_id = e.period_id AND (p.code = e.code OR p.name = e.name) GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN entity_type IN ('grupo_investigacion', 'semillero') THEN 'entity_type_incompatible' WHEN bad > 0 THEN 'contradictory_project_evidence'
  WHEN ok > 1 THEN 'ambiguous_project_evidence' WHEN ok = 1 THEN NULL WHEN entity_type <> 'proyecto_fci' THEN 'invariant_mismatch' ELSE 'missing_project_evidence' END AS blocker_code FROM m)
SELECT entity_id, blocker_code, CASE WHEN blocker_code IS NULL THEN pid END AS project_id, CASE WHEN blocker_code IS NULL THEN 'code' END AS match_criterion FROM b""")
def _(t):
    size = F.round(F.col("progress") / 2.3).cast("int").cast("string")
    entities = t.entities.select("entity_id", "entity_type", "period_id", F.concat_ws("-", "code", size).alias("code"), "name")
    return joins.project_evidence(entities, t.projects.select("project_id", "period_id", "code", "name"))


@query("jn16_evidence_job", "SELECT production_id, evidence_job FROM x_evidence")
def _(t):
    return Facts(t).evidence


X_PENDING = """
WITH n AS (SELECT canonical_identity_key AS key, trim(regexp_replace(strip_accents(upper(canonical_name)), '[^A-Z0-9]+', ' ', 'g')) AS name_key FROM x_participants
  WHERE starts_with(canonical_identity_key, 'pending:')),
g AS (SELECT name_key FROM n GROUP BY 1 HAVING count(DISTINCT key) >= 2)"""


# Fixed value: options shown for a case.
MOST_OPTIONS = 100


@query("jn17_counterpart_options", X_PENDING + """,
act AS (SELECT item_id, target_table, target_pk FROM v_review_items WHERE case_type = 'possible_duplicate' AND case_status <> 'superseded'),
named AS (SELECT n.name_key, n.key, r.source_table AS target_table, CAST(r.source_id AS BIGINT) AS target_pk FROM n JOIN g ON g.name_key = n.name_key JOIN x_resolved r ON r.key = n.key WHERE r.source_table = 'person_roles'),
one AS (SELECT target_table, target_pk FROM act GROUP BY 1, 2 HAVING count(*) = 1),
opt AS (SELECT a.item_id, o.target_table AS option_table, o.target_pk AS option_pk, row_number() OVER (PARTITION BY a.item_id ORDER BY o.target_table, o.target_pk) AS position
  FROM act a JOIN named me ON me.target_table = a.target_table AND me.target_pk = a.target_pk JOIN named o ON o.name_key = me.name_key AND o.key <> me.key
  JOIN one ON one.target_table = o.target_table AND one.target_pk = o.target_pk)
SELECT item_id, CAST(position AS INT) AS position, option_table, option_pk FROM opt WHERE position <= 100""")
def _(t):
    f = Facts(t)
    people = f.participants.filter(F.col("canonical_identity_key").startswith("pending:")).select(
        "canonical_identity_key", identity_name_key(F.col("canonical_name")).alias("name_key"))
    shared = people.groupBy("name_key").agg(F.count_distinct("canonical_identity_key").alias("_n")).filter("_n >= 2").select("name_key")
    people = people.join(shared, "name_key", "left_semi")
    sources = f.resolved.filter("source_table = 'person_roles'").select("source_table", F.col("source_id").cast("long").alias("source_id"), "key")
    return joins.counterpart_options(t.review_items, sources, people, MOST_OPTIONS)


@query("jn18_related_cases", """
WITH k AS (SELECT r.role_id, r.canonical_key AS key FROM v_roles r WHERE canonical_key IS NOT NULL
  UNION SELECT d.target_id, d.identity_key FROM v_decisions d JOIN v_roles r ON r.role_id = d.target_id WHERE d.approved AND d.identity_key IS NOT NULL),
x AS (SELECT k.key, i.item_id, row_number() OVER (PARTITION BY k.key ORDER BY i.target_pk, i.item_id) AS rn FROM k JOIN v_review_items i ON i.target_table = 'person_roles' AND i.target_pk = k.role_id)
SELECT key, item_id FROM x WHERE rn <= 50""")
def _(t):
    from pyspark.sql import Window

    own = t.roles.filter("canonical_key IS NOT NULL").select("role_id", F.col("canonical_key").alias("key"))
    projected = t.decisions.filter("approved AND identity_key IS NOT NULL").select(F.col("target_id").alias("role_id"), F.col("identity_key").alias("key"))
    keys = own.union(projected.join(t.roles, "role_id", "left_semi").select("role_id", "key")).distinct()
    items = t.review_items.filter("target_table = 'person_roles'").select("item_id", F.col("target_pk").alias("role_id"))
    ranked = keys.join(items, "role_id").withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("role_id", "item_id")))
    return ranked.filter("_r <= 50").select("key", "item_id")


@query("jn19_source_identity", "SELECT source_table, source_id, key FROM x_resolved")
def _(t):
    return Facts(t).resolved.select("source_table", "source_id", "key")


@query("jn20_candidate_action", """
WITH c AS (SELECT external_id, concat(' Valor ', CAST(external_id * 2 AS VARCHAR)) AS raw_value FROM v_externals),
a AS (SELECT upper(raw_value) AS k, arg_min(action, audit_id) AS action, arg_min(CASE WHEN record_id IS NULL THEN -1 ELSE record_id END, audit_id) AS record_id FROM v_audits WHERE entity_type = 'scientific_production' GROUP BY 1)
SELECT c.external_id, c.raw_value, coalesce(a.action, 'detected_not_persisted_yet') AS action, nullif(a.record_id, -1) AS record_id FROM c LEFT JOIN a ON a.k = trim(upper(c.raw_value))""")
def _(t):
    rows = t.externals.select("external_id", F.concat(F.lit(" Valor "), (F.col("external_id") * 2).cast("string")).alias("raw_value"))
    return joins.candidate_actions(rows, t.audits, "scientific_production")


@query("jn21_related_entity", """
SELECT i.item_id, CASE WHEN d.identity_key IS NOT NULL OR r.canonical_key IS NOT NULL THEN 'canonical_identity' WHEN t.teacher_id IS NOT NULL THEN 'teacher'
    WHEN e.external_id IS NOT NULL THEN 'external_researcher' ELSE 'record' END AS match_kind,
  coalesce(d.identity_key, r.canonical_key, CAST(t.teacher_id AS VARCHAR), CAST(e.external_id AS VARCHAR), concat('person_roles:', r.role_id)) AS match_id
FROM v_review_items i JOIN v_roles r ON i.target_table = 'person_roles' AND i.target_pk = r.role_id LEFT JOIN v_decisions d ON d.target_id = r.role_id AND d.approved
LEFT JOIN v_teachers t ON t.teacher_id = r.teacher_id LEFT JOIN v_externals e ON e.external_id = r.external_id""")
def _(t):
    return joins.related_entity(t.review_items, t.roles, t.teachers, t.externals, t.decisions)


@query("jn22_queue_context", """
WITH q AS (SELECT * FROM v_review_items ORDER BY manual_priority DESC NULLS LAST, automatic_priority DESC, created_at, item_id LIMIT 25)
SELECT q.item_id, t.label, j.status AS job_status FROM q LEFT JOIN v_targets t ON t.target_table = q.target_table AND t.target_pk = q.target_pk LEFT JOIN v_jobs j ON j.job_id = t.job_id""")
def _(t):
    from tallyloom.operators.versions import queue_page

    page = queue_page(t.review_items, 1, 25)
    return page.join(t.targets, ["target_table", "target_pk"], "left").join(
        t.jobs.select("job_id", F.col("status").alias("job_status")), "job_id", "left").select("item_id", "label", "job_status")


@query("jn23_evidence_signature", """
SELECT report_id, CASE WHEN count(DISTINCT source_path) = 1 THEN min(source_path) END AS source_path FROM v_traces GROUP BY 1""")
def _(t):
    return joins.evidence_signature(t.traces, "report_id")


@query("jn24_responsible_linking")
def _(t):
    people = names.best_match(t.mention_names, "raw_name", t.teachers, "teacher_id", "full_name")
    homes = names.best_match(t.mention_names, "raw_name", t.externals, "external_id", "full_name")
    rows = t.mention_names.groupBy("raw_name").agg(F.min("mention_id").alias("mention_id"))
    linked = rows.join(people.select("raw_name", F.col("match_id").alias("teacher_id"), F.col("score").alias("_t")), "raw_name", "left").join(
        homes.select("raw_name", F.col("match_id").alias("external_id"), F.col("score").alias("_e")), "raw_name", "left")
    return linked.select(
        "mention_id", "teacher_id", F.when(F.col("teacher_id").isNull(), F.col("external_id")).alias("external_id"),
        F.coalesce("_t", "_e", F.lit(0.0)).alias("confidence"),
        F.when(F.coalesce("teacher_id", "external_id").isNotNull(), "linked").otherwise("requires_review").alias("action"))


@query("jn25_match_keys", """
SELECT project_id, concat('code:', lower(code), '|name:', lower(name)) AS match_keys,
  concat('project:code:', lower(code), '|name:', lower(name), '|entity:', lower(code), '|director:', lower(director_name)) AS relation_key FROM v_projects""")
def _(t):
    return joins.match_keys(t.projects).select("project_id", "match_keys", "relation_key")


@query("jn26_row_locator", """
SELECT a.author_id, coalesce(ja.document_key, jp.document_key) AS document_key, p.period_id,
  CASE WHEN trim(p.title) <> '' THEN concat('product:', lower(p.title)) END AS row_or_block_id
FROM v_authors a LEFT JOIN v_productions p ON p.production_id = a.production_id LEFT JOIN v_jobs ja ON ja.job_id = a.job_id LEFT JOIN v_jobs jp ON jp.job_id = p.job_id""")
def _(t):
    jobs = t.jobs.select("job_id", "document_key")
    owners = t.productions.select("production_id", "period_id", "title", "job_id").join(jobs, "job_id", "left").select(
        "production_id", "period_id", "title", F.col("document_key").alias("_parent"))
    rows = t.authors.select("author_id", "production_id", "job_id").join(jobs, "job_id", "left").join(owners, "production_id", "left")
    return rows.select(
        "author_id", joins.first_nonblank(F.col("document_key"), F.col("_parent")).alias("document_key"), "period_id",
        F.concat(F.lit("product:"), F.lower(joins.nonblank(F.col("title")))).alias("row_or_block_id"))


