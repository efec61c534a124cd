"""Participant and read-model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.people import is_real_email
from tallyloom.operators import participants as P
from tallyloom.operators import views
from tallyloom.plans.common import Facts
from tallyloom.plans.registry import query

GONE = "(lower({0}) LIKE 'discard%' OR lower({0}) IN ('invalid', 'invalid_text_fragment', 'descartado'))"


@query("p01_canonical_participants", """
SELECT canonical_identity_key, canonical_name, identity_source, identity_locked, identity_confidence, person_type, participation_count, role_count, role_type_count, authorship_count, entity_count, evidence_count, kpi_eligible, overall_status FROM x_participants""")
def _(t):
    return Facts(t).participants


@query("p01_participant_members", """
SELECT DISTINCT key AS canonical_identity_key, m.kind, m.value FROM x_resolved, LATERAL (SELECT unnest([{'kind': 'person_type', 'value': person_type}, {'kind': 'role', 'value': role_type}, {'kind': 'document', 'value': document},
  {'kind': 'research_entity', 'value': CAST(entity_id AS VARCHAR)}, {'kind': 'authorship', 'value': CAST(production_id AS VARCHAR)}, {'kind': 'status', 'value': status},
  {'kind': 'pending_reason', 'value': CASE WHEN status <> 'validated' THEN coalesce(reason, status) END}, {'kind': 'affiliation', 'value': affiliation}, {'kind': 'email', 'value': email}]) AS m) u WHERE m.value IS NOT NULL""")
def _(t):
    return P.participant_members(Facts(t).resolved)


@query("p02_preferred_rows", "SELECT canonical_identity_key, canonical_name, identity_confidence, identity_locked FROM x_participants")
def _(t):
    return Facts(t).participants.select("canonical_identity_key", "canonical_name", "identity_confidence", "identity_locked")


@query("p03_person_type", "SELECT canonical_identity_key, person_type FROM x_participants")
def _(t):
    return Facts(t).participants.select("canonical_identity_key", "person_type")


@query("p04_key_fallback", """
SELECT author_id AS row_id, coalesce(canonical_key, concat('legacy-author:', author_id)) AS key FROM v_authors UNION ALL SELECT CAST(role_id AS VARCHAR), coalesce(canonical_key, concat('legacy:', person_key)) FROM v_roles""")
def _(t):
    none = F.lit(None).cast("string")
    authors = t.authors.select(F.col("author_id").alias("row_id"), P.own_key(F.col("canonical_key"), none, F.col("author_id")).alias("key"))
    return authors.union(t.roles.select(F.col("role_id").cast("string"), P.own_key(F.col("canonical_key"), F.col("person_key"), F.col("role_id"))))


@query("p05_kpi_eligible", "SELECT canonical_identity_key FROM x_participants WHERE kpi_eligible")
def _(t):
    return Facts(t).participants.filter("kpi_eligible").select("canonical_identity_key")


@query("p06_possible_matches", """
WITH n AS (SELECT canonical_identity_key, canonical_name, trim(regexp_replace(strip_accents(upper(canonical_name)), '[^A-Z0-9]+', ' ', 'g')) AS name_key FROM x_participants WHERE starts_with(canonical_identity_key, 'pending:')),
g AS (SELECT name_key, count(DISTINCT canonical_identity_key) AS c FROM n WHERE name_key <> '' GROUP BY 1 HAVING count(DISTINCT canonical_identity_key) >= 2)
SELECT n.canonical_identity_key, n.canonical_name, n.name_key, g.c - 1 AS other_matches FROM n JOIN g ON g.name_key = n.name_key""")
def _(t):
    return P.possible_matches(Facts(t).participants)


@query("p07_identity_redirects", "SELECT source_key, redirect_key, redirect_name FROM x_redirects")
def _(t):
    return P.redirects(Facts(t).mentions)


@query("p08_effective_names", """
WITH c AS (SELECT teacher_id, count(DISTINCT (overlay_key, overlay_name)) AS n, min(overlay_name) AS name FROM x_roles WHERE teacher_id IS NOT NULL AND overlay_key IS NOT NULL AND overlay_name IS NOT NULL AND eff = 'validated' GROUP BY 1)
SELECT t.teacher_id, CASE WHEN c.n = 1 THEN c.name ELSE t.full_name END AS full_name, coalesce(c.n = 1, false) AS reviewed FROM v_teachers t LEFT JOIN c ON c.teacher_id = t.teacher_id""")
def _(t):
    overlay = t.decisions.filter("approved").select(F.col("target_id").alias("role_id"), F.col("identity_key").alias("overlay_key"), F.col("identity_name").alias("overlay_name"))
    return views.effective_names(Facts(t).roles.join(overlay, "role_id", "left"), t.teachers)


@query("p09_affiliation", "SELECT role_id, affiliation FROM x_roles")
def _(t):
    careers = t.careers.select("career_id", F.col("name").alias("_career"))
    homes = t.externals.select("external_id", "institution")
    rows = Facts(t).roles.join(careers, "career_id", "left").join(homes, "external_id", "left")
    return rows.select("role_id", views.affiliation(F.col("_career"), F.col("institution")).alias("affiliation"))


def _keyed_roles(t):
    f = Facts(t)
    keyed = f.resolved.filter("source_table = 'person_roles'").select(F.col("source_id").cast("long").alias("role_id"), "key", "name")
    return f, f.roles.drop("person_type").join(keyed, "role_id")


X_STATES = """
WITH k AS (SELECT r.role_id, v.key, v.name, v.person_type, r.eff, r.identity_valid, r.role_type, r.identity_locked, r.confidence, r.entity_id, r.period_id FROM x_roles r JOIN x_resolved v ON v.source_table = 'person_roles' AND v.source_id = CAST(r.role_id AS VARCHAR)),
s AS (SELECT *, CASE WHEN eff = 'validated' AND identity_valid THEN 3 ELSE 1 END AS rank, CASE WHEN eff = 'validated' AND identity_valid THEN 'valid_person' WHEN role_type = 'autor_producto' THEN 'pending_author_classification' ELSE 'pending_person' END AS bucket FROM k),
st AS (SELECT key, bucket AS review_bucket, bucket = 'valid_person' AS kpi_eligible, person_type FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank DESC, role_id) AS rn FROM s) q WHERE rn = 1)"""


def _states(t):
    f = Facts(t)
    keyed = f.resolved.filter("source_table = 'person_roles'").select(F.col("source_id").cast("long").alias("role_id"), "key", "person_type")
    return views.participant_states(f.roles.drop("person_type").join(keyed, "role_id"))


@query("p10_participant_state", X_STATES + "SELECT * FROM st")
def _(t):
    return _states(t)


@query("p11_state_summary", X_STATES + """
SELECT count(*) AS total, count(*) FILTER (person_type = 'docente_interno') AS docente_interno, count(*) FILTER (person_type = 'investigador_externo') AS investigador_externo, count(*) FILTER (kpi_eligible) AS kpi_eligible,
  count(*) FILTER (review_bucket = 'pending_person') AS pending_people_count, count(*) FILTER (review_bucket = 'pending_author_classification') AS pending_author_classification_count, count(*) FILTER (review_bucket = 'pending_merge') AS pending_merge_count FROM st""")
def _(t):
    return views.state_summary(_states(t))


X_DIRECTOR = X_STATES + """,
h AS (SELECT * FROM k WHERE role_type IN ('director', 'director_proyecto', 'coordinador', 'tutor_semillero', 'responsable_informe')),
l AS (SELECT entity_id, period_id, key AS director_key, name AS lead_name FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, period_id ORDER BY identity_locked DESC, confidence DESC, role_id) AS rn FROM h) q WHERE rn = 1),
v AS (SELECT entity_id, period_id, key, bool_or(eff = 'validated') AS valid FROM h GROUP BY 1, 2, 3),
d AS (SELECT e.entity_id, l.director_key, coalesce(p.canonical_name, l.lead_name, e.director_name) AS director_name, CASE WHEN l.director_key IS NULL THEN 'not_detected' WHEN v.valid THEN 'validated' ELSE 'pending_review' END AS relationship_status,
  CASE WHEN l.director_key IS NULL THEN 'not_resolved' ELSE coalesce(p.overall_status, 'pending_review') END AS identity_status, e.validation_status, e.period_id, e.name, e.status
  FROM v_entities e LEFT JOIN l ON l.entity_id = e.entity_id AND l.period_id = e.period_id LEFT JOIN v ON v.entity_id = e.entity_id AND v.period_id = e.period_id AND v.key = l.director_key LEFT JOIN x_participants p ON p.canonical_identity_key = l.director_key)"""


def _directors(t):
    f, roles = _keyed_roles(t)
    return f, views.director_states(t.entities, roles, f.participants)


@query("p12_director_state", X_DIRECTOR + """
SELECT entity_id, director_key, director_name, relationship_status, identity_status, concat_ws(' / ', CASE WHEN validation_status = 'validated' THEN 'Proyecto validado' ELSE 'Proyecto pendiente' END,
  CASE identity_status WHEN 'validated' THEN 'identidad validada' WHEN 'pending_review' THEN 'identidad pendiente' ELSE 'identidad no resuelta' END,
  CASE relationship_status WHEN 'validated' THEN 'relación como director validada' WHEN 'pending_review' THEN 'relación como director pendiente' ELSE 'relación como director no detectada' END) AS display_status FROM d""")
def _(t):
    return _directors(t)[1]


@query("p13_entity_view", X_DIRECTOR + "SELECT d.entity_id, d.name, d.status, d.director_name, d.relationship_status FROM d WHERE d.validation_status = 'validated' AND d.entity_id IN (SELECT entity_id FROM x_entities)")
def _(t):
    f, states = _directors(t)
    return f.entities.filter("validation_status = 'validated'").select("entity_id", "name", "status").join(states.select("entity_id", "director_name", "relationship_status"), "entity_id")


@query("p14_production_view", f"""
SELECT p.production_id, CASE WHEN {GONE.format('p.eff')} THEN 'discarded' WHEN p.is_valid THEN 'eligible' ELSE 'pending' END AS visibility, a.author_id, coalesce(r.key, a.canonical_key, 'legacy-author:' || a.author_id) AS author_key
FROM x_productions p LEFT JOIN v_authors a ON a.production_id = p.production_id LEFT JOIN x_resolved r ON r.source_table = 'scientific_production_authors' AND r.source_id = a.author_id""")
def _(t):
    from tallyloom.operators.scope import visibility

    f = Facts(t)
    keys = f.resolved.filter("source_table = 'scientific_production_authors'").select(F.col("source_id").alias("author_id"), "key")
    authors = t.authors.select("production_id", "author_id", "canonical_key").join(keys, "author_id", "left").select(
        "production_id", "author_id", F.coalesce("key", P.own_key(F.col("canonical_key"), F.lit(None).cast("string"), F.col("author_id"))).alias("author_key"))
    rows = f.productions.select("production_id", visibility(F.col("effective_status"), F.col("is_validated")).alias("visibility"))
    return rows.join(authors, "production_id", "left").select("production_id", "visibility", "author_id", "author_key")


@query("p15_teacher_view", """
WITH live AS (SELECT DISTINCT r.teacher_id FROM v_roles r WHERE r.job_id IN (SELECT job_id FROM x_current) AND r.teacher_id IS NOT NULL)
SELECT t.teacher_id, c.name AS career_name, count(p.production_id) AS productions FROM v_teachers t JOIN v_careers c ON c.career_id = t.career_id LEFT JOIN x_productions p ON p.teacher_id = t.teacher_id AND p.is_valid
WHERE t.validation_status = 'validated' AND (t.job_id IS NULL OR t.job_id IN (SELECT job_id FROM x_current) OR t.teacher_id IN (SELECT teacher_id FROM live)) GROUP BY 1, 2""")
def _(t):
    from tallyloom.operators.scope import flag_current

    f = Facts(t)
    live = t.roles.filter("teacher_id IS NOT NULL").join(f.current, "job_id", "left_semi").select("teacher_id", F.lit(True).alias("_live")).distinct()
    people = flag_current(t.teachers.filter("validation_status = 'validated'"), f.current).join(live, "teacher_id", "left").filter("in_current OR _live")
    counts = f.productions.filter("is_validated").groupBy("teacher_id").agg(F.count(F.lit(1)).alias("_n"))
    names = t.careers.select("career_id", F.col("name").alias("career_name"))
    return people.join(names, "career_id").join(counts, "teacher_id", "left").select("teacher_id", "career_name", F.coalesce("_n", F.lit(0).cast("long")).alias("productions"))


@query("p16_progress_view", f"""
WITH j AS (SELECT p.report_id, p.job_id FROM v_progress p WHERE p.job_id IN (SELECT job_id FROM x_current))
SELECT j.report_id, (SELECT count(DISTINCT teacher_id) FROM x_valid_roles r WHERE r.job_id = j.job_id AND r.role_type <> 'autor_producto') AS members, (SELECT count(DISTINCT external_id) FROM x_valid_roles r WHERE r.job_id = j.job_id AND r.role_type <> 'autor_producto') AS externals,
  (SELECT count(DISTINCT p.production_id) FROM x_productions p JOIN v_authors a ON a.production_id = p.production_id AND NOT {GONE.format('a.validation_status')} WHERE p.job_id = j.job_id) AS products,
  (SELECT count(*) FROM v_entities e WHERE e.job_id = j.job_id AND e.validation_status = 'validated') AS entities FROM j""")
def _(t):
    f = Facts(t)
    reports = t.progress.join(f.current, "job_id", "left_semi").select("report_id", "job_id")
    people = f.valid_roles.filter("role_type <> 'autor_producto'").groupBy("job_id").agg(F.count_distinct("teacher_id").alias("members"), F.count_distinct("external_id").alias("externals"))
    shown = views.effective_products(f.productions.select("production_id", "job_id"), t.authors).groupBy("job_id").agg(F.count_distinct("production_id").alias("products"))
    things = t.entities.filter("validation_status = 'validated'").groupBy("job_id").agg(F.count(F.lit(1)).alias("entities"))
    return reports.join(people, "job_id", "left").join(shown, "job_id", "left").join(things, "job_id", "left").fillna(0).select("report_id", "members", "externals", "products", "entities")


@query("p17_presentation", """
SELECT p.canonical_identity_key, CASE WHEN kpi_eligible THEN 'valid_person' WHEN r.only_author THEN 'pending_author_classification' ELSE 'pending_person' END AS review_bucket, r.email, CASE WHEN kpi_eligible THEN 'validado' ELSE 'pendiente_validacion' END AS status
FROM x_participants p JOIN (SELECT key, bool_and(role_type = 'autor_producto') AS only_author, min(email) AS email FROM x_resolved GROUP BY 1) r ON r.key = p.canonical_identity_key""")
def _(t):
    f = Facts(t)
    roles = f.resolved.groupBy(F.col("key").alias("canonical_identity_key")).agg(
        F.bool_and(F.col("role_type") == "autor_producto").alias("_only"), F.min(F.when(is_real_email(F.col("email")), F.col("email"))).alias("email"))
    bucket = F.when(F.col("kpi_eligible"), "valid_person").when(F.col("_only"), "pending_author_classification").otherwise("pending_person")
    return f.participants.join(roles, "canonical_identity_key").select(
        "canonical_identity_key", bucket.alias("review_bucket"), "email", F.when(F.col("kpi_eligible"), "validado").otherwise("pendiente_validacion").alias("status"))


@query("p18_participant_roles", """
SELECT r.role_id FROM x_valid_roles r LEFT JOIN v_productions p ON p.production_id = r.production_id LEFT JOIN v_decisions d ON d.target_id = p.production_id AND d.approved
WHERE p.production_id IS NULL OR (coalesce(d.scientific_status, p.validation_status) = 'validated' AND p.production_id IN (SELECT production_id FROM v_authors WHERE validation_status = 'validated'))""")
def _(t):
    from tallyloom.operators.scope import with_effective_status, with_validated_author

    f = Facts(t)
    works = with_validated_author(with_effective_status(t.productions.select("production_id", "validation_status"), t.decisions, "production_id"), t.authors)
    rows = f.valid_roles.join(works.select("production_id", "is_validated"), "production_id", "left")
    return rows.filter("is_validated IS NULL OR is_validated").select("role_id")


@query("p19_progress_participants", """
SELECT DISTINCT r.job_id, CASE WHEN r.role_type IN ('director', 'coordinador') THEN 'director' WHEN r.external_id IS NOT NULL THEN 'external' ELSE 'member' END AS kind, v.name
FROM x_valid_roles r JOIN x_resolved v ON v.source_table = 'person_roles' AND v.source_id = CAST(r.role_id AS VARCHAR) WHERE r.job_id IS NOT NULL AND r.role_type <> 'autor_producto'""")
def _(t):
    f, roles = _keyed_roles(t)
    valid = roles.filter((F.col("effective_status") == "validated") & F.col("identity_validated") & (F.col("role_type") != "autor_producto") & F.col("job_id").isNotNull())
    kind = F.when(F.col("role_type").isin(*P.DIRECTOR_ROLES), "director").when(F.col("external_id").isNotNull(), "external").otherwise("member")
    return valid.select("job_id", kind.alias("kind"), "name").distinct()


@query("p20_effective_products", f"""
SELECT p.production_id, a.author_id, p.is_valid AS kpi_eligible FROM x_productions p JOIN v_authors a ON a.production_id = p.production_id WHERE NOT {GONE.format('a.validation_status')}""")
def _(t):
    rows = views.effective_products(Facts(t).productions, t.authors)
    return rows.select("production_id", "author_id", F.col("is_validated").alias("kpi_eligible"))


@query("p21_case_detail", """
SELECT i.item_id, t.label, d.scientific_status, coalesce(n.cases, 0) AS cases FROM v_review_items i LEFT JOIN v_targets t ON t.target_table = i.target_table AND t.target_pk = i.target_pk LEFT JOIN v_decisions d ON d.target_id = i.target_pk AND d.approved
LEFT JOIN (SELECT target_table, target_pk, count(*) AS cases FROM v_review_items GROUP BY 1, 2) n ON n.target_table = i.target_table AND n.target_pk = i.target_pk""")
def _(t):
    counts = t.review_items.groupBy("target_table", "target_pk").agg(F.count(F.lit(1)).alias("cases"))
    decided = t.decisions.filter("approved").select(F.col("target_id").alias("target_pk"), "scientific_status")
    return t.review_items.join(t.targets, ["target_table", "target_pk"], "left").join(decided, "target_pk", "left").join(counts, ["target_table", "target_pk"], "left").select(
        "item_id", "label", "scientific_status", "cases")
