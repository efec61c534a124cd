"""KPI queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.numbers import percent, variation
from tallyloom.functions.text import alnum_key, upper_key
from tallyloom.operators import dashboard, kpis, participants, scope
from tallyloom.plans.common import Facts
from tallyloom.plans.registry import query

GONE = "(lower({0}) LIKE 'discard%' OR lower({0}) IN ('invalid', 'invalid_text_fragment', 'descartado'))"
PUB = "strip_accents(upper(status)) LIKE '%PUBLIC%'"
REV = "(strip_accents(upper(status)) LIKE '%REVISION%' OR strip_accents(upper(status)) LIKE '%REVIEW%' OR strip_accents(upper(status)) LIKE '%ENVIADO%')"

X_SCOPES = """
WITH rs AS (SELECT DISTINCT r.role_id, r.period_id, r.teacher_id, r.person_type, r.career_id AS own, s.scope_id
  FROM x_valid_roles r LEFT JOIN v_productions p ON p.production_id = r.production_id LEFT JOIN v_teachers pt ON pt.teacher_id = p.teacher_id,
    LATERAL (SELECT unnest([-1::BIGINT, r.career_id, pt.career_id]) AS scope_id) s WHERE s.scope_id IS NOT NULL),
teach AS (SELECT rs.period_id, rs.scope_id, count(DISTINCT CASE WHEN person_type = 'teacher' THEN teacher_id END) AS total_teachers,
    count(DISTINCT CASE WHEN upper(f.name) LIKE '%CIENCIAS ADMINISTRATIVAS%' THEN teacher_id END) AS internal_fca_count,
    count(DISTINCT CASE WHEN person_type = 'teacher' AND NOT coalesce(upper(f.name) LIKE '%CIENCIAS ADMINISTRATIVAS%', false) THEN teacher_id END) AS internal_other_faculty_count
  FROM rs LEFT JOIN v_careers c ON c.career_id = rs.own LEFT JOIN v_faculties f ON f.faculty_id = c.faculty_id GROUP BY 1, 2),
ps AS (SELECT DISTINCT p.*, s.scope_id FROM x_productions p LEFT JOIN v_teachers t ON t.teacher_id = p.teacher_id,
    LATERAL (SELECT unnest([-1::BIGINT, t.career_id]) AS scope_id) s WHERE s.scope_id IS NOT NULL),
prod AS (SELECT period_id, scope_id, count(*) FILTER (is_valid) AS scientific_output_total,
    count(*) FILTER (is_valid AND {pub}) AS scientific_output_published,
    count(*) FILTER (is_valid AND NOT {pub} AND {rev}) AS scientific_output_in_review,
    count(*) FILTER (NOT {gone}) AS scientific_output_detected, count(*) FILTER (is_valid) AS scientific_output_kpi_eligible,
    count(*) FILTER (NOT is_valid AND NOT {gone}) AS scientific_output_pending_review,
    count(*) FILTER ({gone}) AS scientific_output_discarded FROM ps GROUP BY 1, 2),
es AS (SELECT e.*, -1::BIGINT AS scope_id FROM x_entities e UNION ALL SELECT e.*, c.career_id FROM x_entities e JOIN x_entity_careers c ON c.entity_id = e.entity_id),
ent AS (SELECT period_id, scope_id, count(*) FILTER (validation_status = 'validated') AS projects_total,
    count(*) FILTER (validation_status = 'validated' AND upper(status) LIKE '%VIGENTE%') AS projects_current,
    count(*) FILTER (validation_status = 'validated' AND upper(status) LIKE '%APROBADO%') AS projects_approved,
    coalesce(round(sum(CAST(trunc(progress) AS INT)) FILTER (validation_status = 'validated') / count(*) FILTER (validation_status = 'validated'), 2), 0.0) AS projects_average_progress_percent,
    count(*) FILTER (NOT {egone}) AS research_entities_detected, count(*) FILTER (validation_status = 'validated') AS research_entities_kpi_eligible,
    count(*) FILTER (validation_status <> 'validated' AND NOT {egone}) AS research_entities_pending_review, count(*) FILTER ({egone}) AS research_entities_excluded
  FROM es GROUP BY 1, 2),
pc AS (SELECT p.production_id, t.career_id FROM x_productions p JOIN v_teachers t ON t.teacher_id = p.teacher_id
  UNION SELECT p.production_id, c.career_id FROM x_productions p JOIN v_entities e ON e.entity_id = p.entity_id
    JOIN x_career_keys c ON e.career_name ILIKE '%' || replace(c.name, '_', '\\_') || '%' ESCAPE '\\' OR e.career_name ILIKE '%' || replace(c.ck, '_', '\\_') || '%' ESCAPE '\\'),
places AS (SELECT DISTINCT affiliation, c.career_id FROM (SELECT DISTINCT affiliation FROM x_mentions WHERE source_table = 'person_roles' AND affiliation IS NOT NULL) a
  JOIN x_career_keys c ON contains(upper(affiliation), c.ck) OR contains(c.ck, upper(affiliation))),
ms AS (SELECT m.*, -1::BIGINT AS scope_id FROM x_mentions m
  UNION ALL SELECT m.*, teacher_career FROM x_mentions m WHERE source_table = 'person_roles' AND teacher_career IS NOT NULL
  UNION ALL SELECT m.*, p.career_id FROM x_mentions m JOIN places p ON p.affiliation = m.affiliation WHERE source_table = 'person_roles' AND teacher_career IS NULL
  UNION ALL SELECT m.*, p.career_id FROM x_mentions m JOIN pc p ON p.production_id = m.production_id WHERE source_table <> 'person_roles'),
red AS (SELECT period_id, scope_id, source_key, min(overlay_key) AS redirect_key FROM ms
  WHERE overlay_key IS NOT NULL AND overlay_scope = 'global_identity' AND overlay_key <> source_key GROUP BY 1, 2, 3 HAVING count(DISTINCT overlay_key) = 1),
mr AS (SELECT ms.*, coalesce(overlay_key, redirect_key, ms.source_key) AS key FROM ms
  LEFT JOIN red ON red.period_id = ms.period_id AND red.scope_id = ms.scope_id AND red.source_key = ms.source_key WHERE NOT {mgone}),
ids AS (SELECT period_id, scope_id, key, count(DISTINCT document) AS docs, count(DISTINCT CASE WHEN source_table = 'person_roles' THEN source_id END) AS role_rows,
    count(DISTINCT production_id) AS works, bool_or(status = 'validated') AND NOT starts_with(key, 'pending:') AS eligible,
    min(CASE person_type WHEN 'docente_interno' THEN 0 WHEN 'investigador_externo' THEN 1 ELSE 2 END) AS ptype FROM mr GROUP BY 1, 2, 3),
ppl AS (SELECT period_id, scope_id, count(*) AS canonical_identities_count, CAST(sum(docs) AS BIGINT) AS participant_appearances_count,
    CAST(sum(role_rows) AS BIGINT) AS participant_roles_count, CAST(sum(works) AS BIGINT) AS authorships_count,
    count(*) FILTER (NOT eligible) AS pending_participants_count, count(*) FILTER (ptype = 1) AS external_researchers_detected,
    count(*) FILTER (ptype = 1 AND eligible) AS external_researchers_kpi_eligible, count(*) FILTER (ptype = 1 AND NOT eligible) AS external_researchers_pending_review
  FROM ids GROUP BY 1, 2),
gone AS (SELECT period_id, scope_id, count(DISTINCT coalesce(overlay_key, source_key)) AS discarded_participants_count FROM ms WHERE {mgone} GROUP BY 1, 2),
rep AS (SELECT period_id, count(*) AS reports_received, count(*) FILTER (trace_status IN ('PENDIENTE_REVISION', 'REQUIERE_REVISION_TIPO_DOCUMENTO')) AS reports_requires_review
  FROM x_progress_kept k JOIN v_periods p ON p.yr = k.yr AND p.cycle = k.cycle GROUP BY 1),
grid AS (SELECT period_id, scope_id FROM v_periods, (SELECT -1::BIGINT AS scope_id UNION ALL SELECT career_id FROM v_careers) s),
cells AS (SELECT g.period_id, g.scope_id, {measures},
    CASE WHEN coalesce(total_teachers, 0) > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS teachers_in_research_percent
  FROM grid g LEFT JOIN teach USING (period_id, scope_id) LEFT JOIN prod USING (period_id, scope_id) LEFT JOIN ent USING (period_id, scope_id)
  LEFT JOIN ppl USING (period_id, scope_id) LEFT JOIN gone USING (period_id, scope_id) LEFT JOIN rep USING (period_id))
""".replace("{pub}", PUB).replace("{rev}", REV).replace("{gone}", GONE.format("eff")).replace(
    "{egone}", GONE.format("validation_status")).replace("{mgone}", GONE.format("status")).replace(
    "{measures}", ", ".join(f"coalesce({m}, 0) AS {m}" for m in dashboard.MEASURES))


@query("k01_dashboard_totals", X_SCOPES + """
SELECT 1998 AS yr, 1 AS cycle, * EXCLUDE (period_id, scope_id), NULL::VARCHAR AS alert FROM cells WHERE period_id = 19981 AND scope_id = -1""")
def _(t):
    return dashboard.single(Facts(t), 1998, 1)


@query("k01_dashboard_career", X_SCOPES + """
SELECT 1997 AS yr, 2 AS cycle, * EXCLUDE (period_id, scope_id), NULL::VARCHAR AS alert FROM cells WHERE period_id = 19972 AND scope_id = 2""")
def _(t):
    return dashboard.single(Facts(t), 1997, 2, career_id=2)


@query("k02_period_matrix", X_SCOPES + "SELECT * FROM cells")
def _(t):
    return dashboard.matrix(Facts(t))


X_CAREER = """
WITH cj AS (SELECT DISTINCT period_id, career_id, job_id FROM x_valid_roles WHERE career_id IS NOT NULL AND job_id IS NOT NULL),
ppl AS (SELECT period_id, career_id, count(DISTINCT teacher_id) AS n FROM x_valid_roles WHERE career_id IS NOT NULL GROUP BY 1, 2),
links AS (SELECT p.period_id, t.career_id, p.production_id, p.production_type FROM x_productions p JOIN v_teachers t ON t.teacher_id = p.teacher_id WHERE is_valid
  UNION SELECT p.period_id, cj.career_id, p.production_id, p.production_type FROM x_productions p JOIN cj ON cj.period_id = p.period_id AND cj.job_id = p.job_id WHERE is_valid
  UNION SELECT p.period_id, e.career_id, p.production_id, p.production_type FROM x_productions p JOIN x_entity_careers e ON e.entity_id = p.entity_id WHERE is_valid),
outp AS (SELECT period_id, career_id, count(*) AS total, count(*) FILTER (production_type = 'ARTICLE') AS articles, count(*) FILTER (production_type = 'BOOK') AS books,
  count(*) FILTER (production_type = 'BOOK_CHAPTER') AS book_chapters, count(*) FILTER (production_type = 'PRESENTATION') AS presentations,
  count(*) FILTER (production_type = 'OTHER') AS unclassified FROM links GROUP BY 1, 2),
proj AS (SELECT period_id, career_id, count(*) AS n FROM (
  SELECT e.period_id, c.career_id, e.entity_id FROM x_entities e JOIN x_entity_careers c ON c.entity_id = e.entity_id WHERE validation_status = 'validated'
  UNION SELECT e.period_id, cj.career_id, e.entity_id FROM x_entities e JOIN cj ON cj.period_id = e.period_id AND cj.job_id = e.job_id WHERE validation_status = 'validated') x GROUP BY 1, 2),
prev AS (SELECT p.period_id, CASE WHEN cycle = 2 THEN (SELECT q.period_id FROM v_periods q WHERE q.yr = p.yr AND q.cycle = 1)
  ELSE (SELECT max(q.period_id) FROM v_periods q WHERE q.yr < p.yr AND q.cycle = 2) END AS previous_id FROM v_periods p),
own AS (SELECT p.period_id, t.career_id, count(*) AS n FROM x_productions p JOIN v_teachers t ON t.teacher_id = p.teacher_id WHERE is_valid GROUP BY 1, 2),
ck AS (SELECT p.period_id, c.career_id, c.name AS career_name, coalesce(ppl.n, 0) AS total_teachers,
  CASE WHEN coalesce(ppl.n, 0) > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS teachers_in_research_percent, coalesce(proj.n, 0) AS projects,
  coalesce(total, 0) AS scientific_output_total, coalesce(articles, 0) AS articles, coalesce(books, 0) AS books, coalesce(book_chapters, 0) AS book_chapters,
  coalesce(presentations, 0) AS presentations, coalesce(unclassified, 0) AS unclassified, coalesce(g.planned_value, 0) AS planned_output,
  CASE WHEN coalesce(g.planned_value, 0) > 0 THEN round(100.0::DOUBLE * coalesce(total, 0) / g.planned_value, 2) ELSE 0.0 END AS output_compliance_percent,
  CASE WHEN coalesce(own.n, 0) <= 0 THEN CASE WHEN coalesce(total, 0) > 0 THEN 100.0::DOUBLE ELSE 0.0 END
    ELSE round(100.0::DOUBLE * (coalesce(total, 0) - own.n) / own.n, 2) END AS output_variation_percent
  FROM v_periods p CROSS JOIN v_careers c JOIN prev ON prev.period_id = p.period_id
  LEFT JOIN ppl ON ppl.period_id = p.period_id AND ppl.career_id = c.career_id LEFT JOIN outp ON outp.period_id = p.period_id AND outp.career_id = c.career_id
  LEFT JOIN proj ON proj.period_id = p.period_id AND proj.career_id = c.career_id
  LEFT JOIN own ON own.period_id = prev.previous_id AND own.career_id = c.career_id
  LEFT JOIN v_goals g ON g.career_id = c.career_id AND g.yr = p.yr AND g.metric = 'SCIENTIFIC_OUTPUT')
"""


def _career_kpis(t):
    f = Facts(t)
    return kpis.career_kpis(t.careers, t.periods, f.valid_roles, f.productions, t.teachers, f.entities, f.entity_careers, t.goals)


@query("k03_career_kpi", X_CAREER + "SELECT * FROM ck")
def _(t):
    return _career_kpis(t)


@query("k04_production_breakdown", """
SELECT period_id, count(*) FILTER (production_type = 'ARTICLE') AS articles, count(*) FILTER (production_type = 'BOOK') AS books,
  count(*) FILTER (production_type = 'BOOK_CHAPTER') AS book_chapters, count(*) FILTER (production_type = 'PRESENTATION') AS presentations,
  count(*) FILTER (production_type = 'OTHER') AS unclassified FROM x_productions WHERE is_valid GROUP BY 1""")
def _(t):
    return kpis.production_breakdown(Facts(t).productions, ["period_id"])


@query("k05_status_counts", f"""
SELECT period_id, count(*) FILTER ({PUB}) AS published, count(*) FILTER (NOT {PUB} AND {REV}) AS in_review
FROM x_productions WHERE is_valid GROUP BY 1""")
def _(t):
    return kpis.status_counts(Facts(t).productions, ["period_id"])


@query("k06_product_reconciliation", f"""
SELECT period_id, count(*) FILTER (NOT {GONE.format('eff')}) AS detected, count(*) FILTER (is_valid) AS counted,
  count(*) FILTER (NOT is_valid AND NOT {GONE.format('eff')}) AS pending, count(*) FILTER ({GONE.format('eff')}) AS discarded
FROM x_productions GROUP BY 1""")
def _(t):
    return kpis.product_reconciliation(Facts(t).productions, ["period_id"])


@query("k07_project_counts", """
SELECT period_id, count(*) AS total, count(*) FILTER (upper(status) LIKE '%VIGENTE%') AS current,
  count(*) FILTER (upper(status) LIKE '%APROBADO%') AS approved,
  round(sum(CAST(trunc(progress) AS INT)) / count(*), 2) AS average_progress FROM x_entities WHERE validation_status = 'validated' GROUP BY 1""")
def _(t):
    return kpis.project_counts(Facts(t).entities, ["period_id"])


@query("k08_entity_reconciliation", """
SELECT period_id, count(*) FILTER (validation_status <> 'discarded_invalid') AS detected, count(*) FILTER (validation_status = 'validated') AS eligible,
  count(*) FILTER (validation_status = 'pending_review') AS pending, count(*) FILTER (validation_status = 'discarded_invalid') AS excluded
FROM x_entities GROUP BY 1""")
def _(t):
    return kpis.entity_reconciliation(Facts(t).entities, ["period_id"])


@query("k09_externals_by_institution", """
SELECT e.institution, count(DISTINCT e.external_id) AS n FROM x_valid_roles r JOIN v_externals e ON e.external_id = r.external_id GROUP BY 1 ORDER BY 1""")
def _(t):
    return (
        Facts(t).valid_roles.join(t.externals.select("external_id", "institution"), "external_id")
        .groupBy("institution").agg(F.count_distinct("external_id").alias("n")).orderBy("institution")
    )


@query("k10_teacher_counts", """
SELECT period_id, count(DISTINCT CASE WHEN person_type = 'teacher' THEN teacher_id END) AS total_teachers,
  count(DISTINCT CASE WHEN f.faculty_id = 1 THEN teacher_id END) AS internal_fca_count,
  count(DISTINCT CASE WHEN person_type = 'teacher' AND coalesce(f.faculty_id, 0) <> 1 THEN teacher_id END) AS internal_other_faculty_count
FROM x_valid_roles r LEFT JOIN v_careers c ON c.career_id = r.career_id LEFT JOIN v_faculties f ON f.faculty_id = c.faculty_id GROUP BY 1""")
def _(t):
    roles = dashboard.with_own_faculty(Facts(t).valid_roles, t.careers, t.faculties)
    return kpis.teacher_counts(roles, ["period_id"])


@query("k11_pending_roles", """
SELECT period_id, count(*) FILTER (eff NOT IN ('validated', 'discarded', 'discarded_invalid')) AS pending_roles FROM x_roles GROUP BY 1""")
def _(t):
    return kpis.pending_roles(Facts(t).roles, ["period_id"])


@query("k12_reports_requiring_review", """
SELECT p.period_id, count(*) AS reports_received, count(*) FILTER (trace_status IN ('PENDIENTE_REVISION', 'REQUIERE_REVISION_TIPO_DOCUMENTO')) AS reports_requires_review
FROM x_progress_kept k JOIN v_periods p ON p.yr = k.yr AND p.cycle = k.cycle GROUP BY 1""")
def _(t):
    return dashboard.progress_counts(t.progress, t.traces, Facts(t).current, t.periods)


@query("k13_participant_metrics", """
SELECT count(*) AS canonical_identities, CAST(sum(participation_count) AS BIGINT) AS participations, CAST(sum(role_count) AS BIGINT) AS roles,
  CAST(sum(authorship_count) AS BIGINT) AS authorships, count(*) FILTER (overall_status = 'pending_review') AS pending,
  count(*) FILTER (person_type = 'investigador_externo') AS external_detected,
  count(*) FILTER (person_type = 'investigador_externo' AND kpi_eligible) AS external_kpi_eligible,
  count(*) FILTER (person_type = 'investigador_externo' AND NOT kpi_eligible) AS external_pending FROM x_participants""")
def _(t):
    return participants.participant_metrics(Facts(t).participants)


@query("k14_discarded_identities", f"""
SELECT period_id, count(DISTINCT coalesce(overlay_key, source_key)) AS discarded FROM x_mentions WHERE {GONE.format('status')} GROUP BY 1""")
def _(t):
    return Facts(t).mentions.filter(scope.is_discarded(F.col("status"))).groupBy("period_id").agg(
        F.count_distinct(F.coalesce("overlay_key", "source_key")).alias("discarded")
    )


@query("k15_discarded_authors", f"""
SELECT p.period_id, count(*) AS discarded_authors FROM v_authors a JOIN v_productions p ON p.production_id = a.production_id
WHERE coalesce(a.job_id, p.job_id) IN (SELECT job_id FROM x_current) AND {GONE.format('a.validation_status')} GROUP BY 1""")
def _(t):
    owner = t.productions.select("production_id", "period_id", F.col("job_id").alias("_own"))
    rows = t.authors.filter(scope.is_discarded(F.col("validation_status"))).join(owner, "production_id")
    rows = rows.withColumn("job_id", F.coalesce("job_id", "_own")).join(Facts(t).current, "job_id", "left_semi")
    return rows.groupBy("period_id").agg(F.count(F.lit(1)).alias("discarded_authors"))


X_GOALS = """
WITH gt AS (SELECT period_id, 'TEACHERS_IN_RESEARCH' AS metric, count(DISTINCT teacher_id) AS n FROM x_valid_roles WHERE teacher_id IS NOT NULL GROUP BY 1
  UNION ALL SELECT period_id, 'SCIENTIFIC_OUTPUT', count(*) FROM x_productions WHERE is_valid GROUP BY 1
  UNION ALL SELECT period_id, CASE production_type WHEN 'ARTICLE' THEN 'ARTICLES' WHEN 'BOOK' THEN 'BOOKS' WHEN 'BOOK_CHAPTER' THEN 'BOOK_CHAPTERS' ELSE 'PRESENTATIONS' END, count(*)
    FROM x_productions WHERE is_valid AND production_type <> 'OTHER' GROUP BY 1, 2
  UNION ALL SELECT period_id, 'PROJECTS', count(*) FROM x_entities WHERE validation_status = 'validated' AND entity_type = 'proyecto_fci' GROUP BY 1),
gm AS (SELECT * FROM (VALUES (1, 'SCIENTIFIC_OUTPUT'), (2, 'ARTICLES'), (3, 'BOOKS'), (4, 'BOOK_CHAPTERS'), (5, 'PRESENTATIONS'), (6, 'PROJECTS'), (7, 'TEACHERS_IN_RESEARCH')) v(position, metric))
"""


def _goal_totals(t):
    f = Facts(t)
    return kpis.goal_totals(f.valid_roles, f.productions, f.entities)


@query("k16_goal_totals", X_GOALS + """
SELECT p.period_id, gm.metric, coalesce(n, 0) AS reported_value FROM (SELECT DISTINCT period_id FROM gt) p CROSS JOIN gm
LEFT JOIN gt ON gt.period_id = p.period_id AND gt.metric = gm.metric""")
def _(t):
    return _goal_totals(t)


@query("k17_goal_summary", X_GOALS + """
SELECT p.period_id, gm.position, gm.metric, coalesce(g.planned, 0) AS planned_value, coalesce(n, 0) AS reported_value,
  CASE WHEN coalesce(g.planned, 0) > 0 THEN round(100.0::DOUBLE * coalesce(n, 0) / g.planned, 2) ELSE 0.0 END AS compliance_percent
FROM v_periods p CROSS JOIN gm LEFT JOIN gt ON gt.period_id = p.period_id AND gt.metric = gm.metric
LEFT JOIN (SELECT yr, metric, CAST(sum(planned_value) AS BIGINT) AS planned FROM v_goals GROUP BY 1, 2) g ON g.yr = p.yr AND g.metric = gm.metric""")
def _(t):
    return kpis.goal_summary(_goal_totals(t), t.goals, t.periods)


@query("k18_goals_list", "SELECT * FROM v_goals ORDER BY yr DESC")
def _(t):
    return t.goals.orderBy(F.col("yr").desc())


@query("k19_percent", """
SELECT teacher_id, count(*) AS total, count(*) FILTER (is_valid) AS valid, round(100.0::DOUBLE * count(*) FILTER (is_valid) / count(*), 2) AS valid_percent
FROM x_productions GROUP BY 1""")
def _(t):
    counts = Facts(t).productions.groupBy("teacher_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_validated").alias("valid"))
    return counts.withColumn("valid_percent", percent(F.col("valid"), F.col("total")))


@query("k20_variation", """
WITH n AS (SELECT period_id, count(*) AS n FROM x_productions WHERE is_valid GROUP BY 1),
prev AS (SELECT p.period_id, CASE WHEN cycle = 2 THEN (SELECT q.period_id FROM v_periods q WHERE q.yr = p.yr AND q.cycle = 1)
  ELSE (SELECT max(q.period_id) FROM v_periods q WHERE q.yr < p.yr AND q.cycle = 2) END AS previous_id FROM v_periods p)
SELECT prev.period_id, coalesce(a.n, 0) AS output, coalesce(b.n, 0) AS previous_output,
  CASE WHEN coalesce(b.n, 0) <= 0 THEN CASE WHEN coalesce(a.n, 0) > 0 THEN 100.0::DOUBLE ELSE 0.0 END ELSE round(100.0::DOUBLE * (coalesce(a.n, 0) - b.n) / b.n, 2) END AS variation_percent
FROM prev LEFT JOIN n a ON a.period_id = prev.period_id LEFT JOIN n b ON b.period_id = prev.previous_id""")
def _(t):
    counts = Facts(t).productions.filter("is_validated").groupBy("period_id").agg(F.count(F.lit(1)).alias("output"))
    before = counts.select(F.col("period_id").alias("previous_id"), F.col("output").alias("previous_output"))
    joined = kpis.previous_periods(t.periods).join(counts, "period_id", "left").join(before, "previous_id", "left").fillna(0, ["output", "previous_output"])
    return joined.select("period_id", "output", "previous_output", variation(F.col("output"), F.col("previous_output")).alias("variation_percent"))


@query("k21_alerts", X_CAREER + """
SELECT period_id, career_id, career_name || ': la produccion cientifica esta por debajo del 70% del POA.' AS alert FROM ck WHERE planned_output > 0 AND output_compliance_percent < 70
UNION ALL SELECT period_id, career_id, career_name || ': no tiene investigaciones validadas para el filtro.' FROM ck WHERE projects = 0""")
def _(t):
    return kpis.alerts(_career_kpis(t))


def _status_totals(df, status):
    gone = scope.is_discarded(F.col(status))
    return df.groupBy("period_id").agg(
        F.count(F.lit(1)).alias("rows_total"), F.count_if(F.col(status) == "validated").alias("validated"),
        F.count_if(gone).alias("discarded"), F.count_if(F.col(status) == "pending_review").alias("pending"),
    )


@query("k22_kpi_diff", """
WITH d AS (SELECT p.period_id, validation_status AS b, coalesce(CASE WHEN d.approved THEN d.scientific_status END, validation_status) AS a
  FROM v_productions p LEFT JOIN v_decisions d ON d.target_id = p.production_id),
m AS (SELECT period_id, 'validated' AS metric, count(*) FILTER (b = 'validated') AS before, count(*) FILTER (a = 'validated') AS after FROM d GROUP BY 1
  UNION ALL SELECT period_id, 'discarded', count(*) FILTER (b LIKE 'discard%'), count(*) FILTER (a LIKE 'discard%') FROM d GROUP BY 1
  UNION ALL SELECT period_id, 'pending', count(*) FILTER (b = 'pending_review'), count(*) FILTER (a = 'pending_review') FROM d GROUP BY 1
  UNION ALL SELECT period_id, 'rows_total', count(*), count(*) FROM d GROUP BY 1)
SELECT period_id, metric, before, after, after - before AS delta FROM m WHERE before <> after""")
def _(t):
    both = scope.with_effective_status(t.productions, t.decisions, "production_id")
    measures = ["rows_total", "validated", "discarded", "pending"]
    before = _status_totals(both, "validation_status").unpivot(["period_id"], measures, "metric", "before")
    after = _status_totals(both, "effective_status").unpivot(["period_id"], measures, "metric", "after")
    return kpis.metric_diff(before, after, ["period_id"])


def _review_jobs(t):
    return t.traces.filter(F.col("review_status").isin(*kpis.REVIEW_STATUSES)).select("job_id")


BUCKETS = """count(*) FILTER (status = 'QUEUED') AS queued, count(*) FILTER (status = 'PROCESSING') AS processing,
  count(*) FILTER (status = 'SUCCESS') AS processed, count(*) FILTER (status = 'SKIPPED') AS ignored, count(*) FILTER (status = 'ERROR') AS failed,
  count(*) FILTER (status = 'REQUIRES_REVIEW' OR job_id IN (SELECT job_id FROM v_traces WHERE review_status IN ('PENDIENTE_REVISION', 'REQUIERE_REVISION_TIPO_DOCUMENTO'))) AS requires_review,
  count(*) AS total"""


@query("k23_batch_status_counts", f"SELECT batch_id, {BUCKETS} FROM v_jobs GROUP BY 1")
def _(t):
    return kpis.batch_buckets(t.jobs, _review_jobs(t), ["batch_id"])


@query("k24_latest_batch_status", f"""
SELECT batch_id, {BUCKETS.replace('AS ignored', '+ greatest(0, 105 - count(*)) AS ignored').replace('count(*) AS total', '105::BIGINT AS total')},
  count(*) FILTER (status IN ('QUEUED', 'PROCESSING')) > 0 AS active
FROM v_jobs WHERE batch_id = (SELECT max(batch_id) FROM v_jobs) GROUP BY 1""")
def _(t):
    newest = t.jobs.agg(F.max("batch_id").alias("batch_id"))
    jobs = t.jobs.join(newest, "batch_id", "left_semi")
    files = F.lit(105).cast("long")  # files listed for the batch, of which some were never queued
    counts = kpis.batch_buckets(jobs, _review_jobs(t), ["batch_id"])
    return counts.withColumn("ignored", F.col("ignored") + F.greatest(F.lit(0), files - F.col("total"))).withColumn(
        "total", files
    ).withColumn("active", F.col("queued") + F.col("processing") > 0)


@query("k25_teachers_per_career", """
SELECT c.career_id, c.name, count(t.teacher_id) AS n FROM v_careers c LEFT JOIN v_teachers t ON t.career_id = c.career_id AND t.is_active GROUP BY 1, 2""")
def _(t):
    counts = t.teachers.filter("is_active").groupBy("career_id").agg(F.count("teacher_id").alias("_n"))
    return t.careers.join(counts, "career_id", "left").select("career_id", "name", F.coalesce("_n", F.lit(0).cast("long")).alias("n"))


@query("k26_consistency_report", """
WITH d AS (SELECT period_id, count(DISTINCT CASE WHEN person_type = 'teacher' THEN teacher_id END) AS teachers FROM x_valid_roles GROUP BY 1),
m AS (
  SELECT p.period_id, 'total_teachers' AS metric, coalesce(d.teachers, 0) AS dashboard_value, (SELECT count(*) FROM v_teachers WHERE is_active) AS real_value FROM v_periods p LEFT JOIN d ON d.period_id = p.period_id
  UNION ALL SELECT p.period_id, 'scientific_output_total', (SELECT count(*) FROM x_productions x WHERE x.period_id = p.period_id AND is_valid), (SELECT count(*) FROM v_productions x WHERE x.period_id = p.period_id) FROM v_periods p
  UNION ALL SELECT p.period_id, 'projects_total', (SELECT count(*) FROM x_entities x WHERE x.period_id = p.period_id AND validation_status = 'validated'),
    (SELECT count(*) FROM v_entities x WHERE x.period_id = p.period_id AND entity_type IN ('proyecto_fci', 'grupo_investigacion', 'semillero', 'informe_seguimiento')) FROM v_periods p
  UNION ALL SELECT p.period_id, 'imports_total', (SELECT count(*) FROM x_progress_kept x WHERE x.yr = p.yr AND x.cycle = p.cycle), (SELECT count(*) FROM v_progress x WHERE x.yr = p.yr AND x.cycle = p.cycle) FROM v_periods p)
SELECT period_id, metric, dashboard_value, real_value, real_value - dashboard_value AS difference, 'count_mismatch' AS kind FROM m WHERE dashboard_value <> real_value
UNION ALL SELECT period_id, 'teachers_active_vs_endpoint_total', (SELECT count(*) FROM v_teachers WHERE is_active), (SELECT count(*) FROM v_teachers),
  (SELECT count(*) FROM v_teachers WHERE NOT is_active), 'scope_visibility_warning' FROM v_periods""")
def _(t):
    f = Facts(t)
    n = F.count(F.lit(1))
    headcount = t.teachers.agg(F.count_if("is_active").alias("_active"), n.alias("_all"))
    roles = f.valid_roles.groupBy("period_id").agg(F.count_distinct(F.when(F.col("person_type") == "teacher", F.col("teacher_id"))).alias("total_teachers"))
    shown = kpis.stack_frames([
        roles, f.productions.filter("is_validated").groupBy("period_id").agg(n.alias("scientific_output_total")),
        f.entities.filter("validation_status = 'validated'").groupBy("period_id").agg(n.alias("projects_total")),
        dashboard.progress_counts(t.progress, t.traces, f.current, t.periods).select("period_id", F.col("reports_received").alias("imports_total")),
    ], ["period_id"], ["total_teachers", "scientific_output_total", "projects_total", "imports_total"])
    types = ("proyecto_fci", "grupo_investigacion", "semillero", "informe_seguimiento")
    stored = kpis.stack_frames([
        t.productions.groupBy("period_id").agg(n.alias("scientific_output_total")),
        t.entities.filter(F.col("entity_type").isin(*types)).groupBy("period_id").agg(n.alias("projects_total")),
        t.progress.groupBy("yr", "cycle").agg(n.alias("imports_total")).join(t.periods, ["yr", "cycle"]).select("period_id", "imports_total"),
    ], ["period_id"], ["scientific_output_total", "projects_total", "imports_total"])
    active = int(headcount.first()["_active"])
    everyone = int(headcount.first()["_all"])
    stored = stored.withColumn("total_teachers", F.lit(active).cast("long"))
    measures = ["total_teachers", "scientific_output_total", "projects_total", "imports_total"]
    left = t.periods.select("period_id").join(shown, "period_id", "left").fillna(0).unpivot(["period_id"], measures, "metric", "dashboard_value")
    right = t.periods.select("period_id").join(stored, "period_id", "left").fillna(0).unpivot(["period_id"], measures, "metric", "real_value")
    diff = left.join(right, ["period_id", "metric"]).filter("dashboard_value <> real_value").select(
        "period_id", "metric", "dashboard_value", "real_value", (F.col("real_value") - F.col("dashboard_value")).alias("difference"),
        F.lit("count_mismatch").alias("kind"))
    warning = t.periods.filter(F.lit(everyone > active)).select(
        "period_id", F.lit("teachers_active_vs_endpoint_total").alias("metric"), F.lit(active).cast("long").alias("dashboard_value"),
        F.lit(everyone).cast("long").alias("real_value"), F.lit(everyone - active).cast("long").alias("difference"),
        F.lit("scope_visibility_warning").alias("kind"))
    return diff.unionByName(warning)


@query("k27_real_values", """
SELECT p.period_id, (SELECT count(*) FROM v_teachers WHERE is_active) AS active_teachers, (SELECT count(*) FROM v_teachers WHERE NOT is_active) AS inactive_teachers,
  coalesce(a.total, 0) AS products, coalesce(a.published, 0) AS published, coalesce(a.sent, 0) AS in_review,
  coalesce(e.total, 0) AS projects, coalesce(e.vig, 0) AS vigentes, coalesce(e.apr, 0) AS aprobados, coalesce(e.av, 0.0) AS average_progress
FROM v_periods p LEFT JOIN (SELECT period_id, count(*) AS total, count(*) FILTER (lower(status) IN ('published', 'publicado', 'publicada')) AS published,
    count(*) FILTER (status = 'borrador') AS sent FROM v_productions GROUP BY 1) a ON a.period_id = p.period_id
LEFT JOIN (SELECT period_id, count(*) AS total, count(*) FILTER (lower(status) = 'vigente') AS vig, count(*) FILTER (lower(status) = 'aprobado') AS apr,
    round(sum(CAST(round(progress * 100) AS BIGINT)) / 100.0::DOUBLE / count(*), 2) AS av FROM v_entities GROUP BY 1) e ON e.period_id = p.period_id""")
def _(t):
    n = F.count(F.lit(1))
    heads = t.teachers.agg(F.count_if("is_active").alias("a"), F.count_if(~F.col("is_active")).alias("i")).first()
    status = F.lower("status")
    products = t.productions.groupBy("period_id").agg(
        n.alias("products"), F.count_if(status.isin("published", "publicado", "publicada")).alias("published"),
        F.count_if(status == "borrador").alias("in_review"))
    cents = F.round(F.coalesce("progress", F.lit(0)) * 100).cast("long")
    projects = t.entities.groupBy("period_id").agg(
        n.alias("projects"), F.count_if(status == "vigente").alias("vigentes"), F.count_if(status == "aprobado").alias("aprobados"),
        F.round(F.sum(cents) / F.lit(100.0) / n, 2).alias("average_progress"))
    joined = t.periods.select("period_id").join(products, "period_id", "left").join(projects, "period_id", "left").fillna(0)
    return joined.select("period_id", F.lit(heads["a"]).cast("long").alias("active_teachers"), F.lit(heads["i"]).cast("long").alias("inactive_teachers"),
                         "products", "published", "in_review", "projects", "vigentes", "aprobados", "average_progress")


@query("k28_normalization_summary", "SELECT entity_type, action, count(*) AS n FROM v_audits GROUP BY 1, 2")
def _(t):
    return t.audits.groupBy("entity_type", "action").agg(F.count(F.lit(1)).alias("n"))


@query("k29_role_summary", "SELECT role_type, count(*) AS n FROM x_roles GROUP BY 1")
def _(t):
    return Facts(t).roles.groupBy("role_type").agg(F.count(F.lit(1)).alias("n"))


STATUSES = ["QUEUED", "PROCESSING", "SUCCESS", "SKIPPED", "ERROR", "REQUIRES_REVIEW"]


@query("k30_facets", """
WITH d AS (SELECT unnest(['QUEUED', 'PROCESSING', 'SUCCESS', 'SKIPPED', 'ERROR', 'REQUIRES_REVIEW']) AS value)
SELECT 'status' AS facet, d.value, count(j.job_id) AS n FROM d LEFT JOIN v_jobs j ON j.status = d.value AND j.value >= 10 GROUP BY 1, 2""")
def _(t):
    return kpis.facets(t.jobs.filter("value >= 10"), "status", STATUSES)


@query("k31_effective_revision", "SELECT count(*) AS revision FROM v_decisions WHERE approved")
def _(t):
    return t.decisions.filter("approved").agg(F.count(F.lit(1)).alias("revision"))


@query("k34_identity_merge_summary", """
SELECT count(DISTINCT source_key) AS identities_before, count(DISTINCT key) AS identities_after,
  count(DISTINCT (source_key, document)) AS participations_before, count(DISTINCT (key, document)) AS participations_after FROM x_resolved""")
def _(t):
    pair = lambda k: F.count_distinct(k, "document")
    return Facts(t).resolved.agg(
        F.count_distinct("source_key").alias("identities_before"), F.count_distinct("key").alias("identities_after"),
        pair("source_key").alias("participations_before"), pair("key").alias("participations_after"))


POPULATIONS = ["person_roles", "scientific_production_authors", "scientific_productions", "research_entities"]


@query("k33_population_overlaps", """
WITH m AS (SELECT 'person_roles' AS p, entity_id AS target FROM v_roles UNION SELECT 'scientific_production_authors', entity_id FROM v_authors
  UNION SELECT 'scientific_productions', entity_id FROM v_productions WHERE validation_status = 'validated'
  UNION SELECT 'research_entities', entity_id FROM v_entities WHERE validation_status = 'pending_review'),
f AS (SELECT target, bool_or(p = 'person_roles') AS a, bool_or(p = 'scientific_production_authors') AS b, bool_or(p = 'scientific_productions') AS c, bool_or(p = 'research_entities') AS d FROM m GROUP BY 1),
s AS (SELECT 'person_roles+scientific_production_authors' AS populations, count(*) FILTER (a AND b) AS stable_target_count FROM f
  UNION ALL SELECT 'person_roles+scientific_productions', count(*) FILTER (a AND c) FROM f UNION ALL SELECT 'person_roles+research_entities', count(*) FILTER (a AND d) FROM f
  UNION ALL SELECT 'scientific_production_authors+scientific_productions', count(*) FILTER (b AND c) FROM f UNION ALL SELECT 'scientific_production_authors+research_entities', count(*) FILTER (b AND d) FROM f
  UNION ALL SELECT 'scientific_productions+research_entities', count(*) FILTER (c AND d) FROM f
  UNION ALL SELECT 'person_roles+scientific_production_authors+scientific_productions', count(*) FILTER (a AND b AND c) FROM f
  UNION ALL SELECT 'person_roles+scientific_production_authors+research_entities', count(*) FILTER (a AND b AND d) FROM f
  UNION ALL SELECT 'person_roles+scientific_productions+research_entities', count(*) FILTER (a AND c AND d) FROM f
  UNION ALL SELECT 'scientific_production_authors+scientific_productions+research_entities', count(*) FILTER (b AND c AND d) FROM f
  UNION ALL SELECT 'person_roles+scientific_production_authors+scientific_productions+research_entities', count(*) FILTER (a AND b AND c AND d) FROM f)
SELECT * FROM s WHERE stable_target_count > 0""")
def _(t):
    parts = [
        (POPULATIONS[0], t.roles), (POPULATIONS[1], t.authors),
        (POPULATIONS[2], t.productions.filter("validation_status = 'validated'")),
        (POPULATIONS[3], t.entities.filter("validation_status = 'pending_review'")),
    ]
    rows = None
    for name, df in parts:
        part = df.select(F.lit(name).alias("population"), F.col("entity_id").alias("target")).distinct()
        rows = part if rows is None else rows.union(part)
    return kpis.overlap_counts(rows, POPULATIONS)


@query("k36_group_counts", """
SELECT canonical_name, count(DISTINCT author_id) AS row_count, count(DISTINCT canonical_key) AS identities,
  count(DISTINCT a.production_id) AS documents, count(DISTINCT p.period_id) AS periods
FROM v_authors a LEFT JOIN v_productions p ON p.production_id = a.production_id GROUP BY 1""")
def _(t):
    rows = t.authors.join(t.productions.select("production_id", "period_id"), "production_id", "left")
    return rows.groupBy("canonical_name").agg(
        F.count_distinct("author_id").alias("row_count"), F.count_distinct("canonical_key").alias("identities"),
        F.count_distinct("production_id").alias("documents"), F.count_distinct("period_id").alias("periods"))


@query("k37_criterion_matches", """
WITH n AS (SELECT entity_id, name, code, period_id, count(*) OVER (PARTITION BY name) AS by_name, count(*) OVER (PARTITION BY code) AS by_code,
  count(*) OVER (PARTITION BY code, name) AS by_both, count(*) OVER (PARTITION BY period_id, name) AS by_period FROM v_entities)
SELECT entity_id, by_code, by_name, by_both, by_period FROM n""")
def _(t):
    n = F.count(F.lit(1))
    base = t.entities.select("entity_id", "name", "code", "period_id")
    cells = base.groupBy("name", "code", "period_id").agg(n.alias("n"))
    for keys, name in ((["code"], "by_code"), (["name"], "by_name"), (["code", "name"], "by_both"), (["period_id", "name"], "by_period")):
        base = base.join(cells.groupBy(*keys).agg(F.sum("n").alias(name)), keys)
    return base.select("entity_id", "by_code", "by_name", "by_both", "by_period")


@query("k38_timing_rollup", """
SELECT batch_id, CAST(sum(greatest(0, q)) AS BIGINT) AS queue_ms, CAST(sum(p) AS BIGINT) AS parse_ms, max(p) AS parse_max_ms, count(*) AS jobs
FROM (SELECT batch_id, (CAST(floor(epoch_us(created_at) / 1000) AS BIGINT) - (1704067200000 + batch_id * 8000000)) AS q, CAST(floor(value * 10) AS BIGINT) AS p FROM v_jobs) j GROUP BY 1""")
def _(t):
    from tallyloom.functions.numbers import elapsed_ms

    start = F.timestamp_millis(F.lit(1704067200000) + F.col("batch_id") * 8000000)
    timed = t.jobs.select("batch_id", elapsed_ms(start, F.col("created_at")).alias("q"), F.floor(F.col("value") * 10).alias("p"))
    return timed.groupBy("batch_id").agg(
        F.sum("q").alias("queue_ms"), F.sum("p").alias("parse_ms"), F.max("p").alias("parse_max_ms"), F.count(F.lit(1)).alias("jobs"))


@query("k39_participant_page_totals", """
SELECT count(*) AS people, CAST(sum(participation_count) AS BIGINT) AS participations, CAST(sum(role_count) AS BIGINT) AS roles, CAST(sum(authorship_count) AS BIGINT) AS authorships,
  count(*) FILTER (person_type = 'investigador_externo' AND kpi_eligible) AS external_eligible, count(*) FILTER (person_type = 'investigador_externo' AND NOT kpi_eligible) AS external_pending
FROM x_participants""")
def _(t):
    m = participants.participant_metrics(Facts(t).participants)
    return m.select(F.col("canonical_identities").alias("people"), "participations", "roles", "authorships",
                    F.col("external_kpi_eligible").alias("external_eligible"), "external_pending")


@query("k40_project_count_rule", """
SELECT p.report_id, CASE WHEN t.report_id IS NOT NULL THEN len(string_split(t.txt, chr(10))) ELSE p.projects END AS project_count
FROM v_progress p LEFT JOIN (SELECT report_id, arg_max(text, trace_id) AS txt FROM v_traces GROUP BY 1) t ON t.report_id = p.report_id""")
def _(t):
    newest = t.traces.groupBy("report_id").agg(F.max_by(F.size(F.split("text", "\n")), "trace_id").alias("_parsed"))
    return t.progress.join(newest, "report_id", "left").select(
        "report_id", F.when(F.col("_parsed").isNotNull(), F.col("_parsed")).otherwise(F.col("projects")).cast("long").alias("project_count"))


@query("k41_planned_value", """
SELECT c.career_id, p.period_id, coalesce(g.planned_value, 0) AS planned_value FROM v_career_years c JOIN v_periods p ON p.yr = c.yr
LEFT JOIN v_goals g ON g.career_id = c.career_id AND g.yr = p.yr AND g.metric = 'ARTICLES'""")
def _(t):
    plan = t.goals.filter("metric = 'ARTICLES'").select("career_id", "yr", "planned_value")
    return t.career_years.join(t.periods.select("yr", "period_id"), "yr").join(plan, ["career_id", "yr"], "left").select(
        "career_id", "period_id", F.coalesce("planned_value", F.lit(0).cast("long")).alias("planned_value"))


@query("k42_progress_product_counts", """
SELECT job_id, count(*) FILTER (is_valid AND production_type = 'ARTICLE') AS articles, count(*) FILTER (is_valid AND production_type = 'BOOK') AS books,
  count(*) FILTER (is_valid AND production_type = 'BOOK_CHAPTER') AS book_chapters, count(*) FILTER (is_valid AND production_type = 'PRESENTATION') AS presentations,
  count(*) FILTER (is_valid AND production_type = 'OTHER') AS unclassified
FROM x_productions WHERE job_id IN (SELECT job_id FROM x_current) GROUP BY 1""")
def _(t):
    f = Facts(t)
    rows = f.productions.join(f.current, "job_id", "left_semi").withColumn(
        "production_type", F.when(F.col("is_validated"), F.col("production_type")))
    counts = rows.groupBy("job_id").agg(*kpis.breakdown_columns(), F.count_if(~F.col("is_validated")).alias("_not"))
    return counts.withColumn("unclassified", F.col("unclassified") - F.col("_not")).drop("_not")


@query("k44_ranked_bars", """
WITH c AS (SELECT e.institution AS name, count(DISTINCT r.external_id) AS n FROM v_roles r JOIN v_externals e ON e.external_id = r.external_id GROUP BY 1)
SELECT name, n, greatest(8.0::DOUBLE, 100.0::DOUBLE * n / (SELECT max(n) FROM c)) AS width FROM c ORDER BY name LIMIT 6""")
def _(t):
    counts = t.roles.join(t.externals.select("external_id", F.col("institution").alias("name")), "external_id").groupBy("name").agg(
        F.count_distinct("external_id").alias("n"))
    return kpis.ranked_bars(counts, "name", "n")
