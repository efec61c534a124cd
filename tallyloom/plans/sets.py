"""Set operations, digests and integrity checks over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import compare, dashboard, kpis, scope
from tallyloom.plans.common import Facts
from tallyloom.plans.registry import query

PATHS = """
WITH c AS (SELECT i.item_id, t.career_id FROM v_review_items i JOIN v_roles r ON i.target_table = 'person_roles' AND i.target_pk = r.role_id JOIN v_teachers t ON t.teacher_id = r.teacher_id
  UNION SELECT i.item_id, t.career_id FROM v_review_items i JOIN v_roles r ON i.target_table = 'person_roles' AND i.target_pk = r.role_id JOIN v_productions p ON p.production_id = r.production_id JOIN v_teachers t ON t.teacher_id = p.teacher_id
  UNION SELECT i.item_id, t.career_id FROM v_review_items i JOIN v_productions p ON i.target_table = 'scientific_productions' AND i.target_pk = p.production_id JOIN v_teachers t ON t.teacher_id = p.teacher_id
  UNION SELECT i.item_id, t.career_id FROM v_review_items i JOIN v_authors a ON i.target_table = 'scientific_productions' AND i.target_pk = a.production_id JOIN v_teachers t ON t.teacher_id = a.teacher_id)"""


def _paths(t):
    teachers = t.teachers.select("teacher_id", "career_id")
    roles = t.review_items.filter("target_table = 'person_roles'").select("item_id", F.col("target_pk").alias("role_id")).join(
        t.roles.select("role_id", "teacher_id", "production_id"), "role_id")
    products = t.review_items.filter("target_table = 'scientific_productions'").select("item_id", F.col("target_pk").alias("production_id"))
    owners = t.productions.select("production_id", "teacher_id")
    parts = [
        roles.select("item_id", "teacher_id"), roles.select("item_id", "production_id").join(owners, "production_id").select("item_id", "teacher_id"),
        products.join(owners, "production_id").select("item_id", "teacher_id"),
        products.join(t.authors.select("production_id", "teacher_id"), "production_id").select("item_id", "teacher_id"),
    ]
    people = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).distinct()
    return people.join(teachers, "teacher_id").select("item_id", "career_id").distinct()


@query("set01_career_paths", PATHS + "SELECT * FROM c")
def _(t):
    return _paths(t)


@query("set02_scope_rollup", PATHS + """,
s AS (SELECT i.item_id, count(DISTINCT c.career_id) AS n, count(DISTINCT k.faculty_id) AS f, min(c.career_id) AS cid, min(k.faculty_id) AS fid FROM v_review_items i LEFT JOIN c ON c.item_id = i.item_id LEFT JOIN v_careers k ON k.career_id = c.career_id GROUP BY 1)
SELECT item_id, CASE WHEN f = 1 THEN fid END AS scope_faculty_id, CASE WHEN f = 1 AND n = 1 THEN cid END AS scope_career_id,
  CASE WHEN f = 0 THEN 'unresolved_no_persisted_scope' WHEN f > 1 THEN 'unresolved_cross_faculty' END AS resolution_reason FROM s""")
def _(t):
    homes = _paths(t).join(t.careers.select("career_id", "faculty_id"), "career_id")
    rolled = homes.groupBy("item_id").agg(
        F.min("career_id").alias("c1"), F.max("career_id").alias("c2"), F.min("faculty_id").alias("f1"), F.max("faculty_id").alias("f2"))
    one = F.col("f1") == F.col("f2")
    return t.review_items.select("item_id").join(rolled, "item_id", "left").select(
        "item_id", F.when(one, F.col("f1")).alias("scope_faculty_id"), F.when(one & (F.col("c1") == F.col("c2")), F.col("c1")).alias("scope_career_id"),
        F.when(F.col("f1").isNull(), "unresolved_no_persisted_scope").when(~one, "unresolved_cross_faculty").alias("resolution_reason"))


@query("set03_identity_population", "SELECT source_table, count(*) AS n, count(DISTINCT source_key) AS identities FROM x_mentions GROUP BY 1")
def _(t):
    return Facts(t).mentions.groupBy("source_table").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_key").alias("identities"))


@query("set04_teacher_sets", """
WITH v AS (SELECT DISTINCT teacher_id FROM x_valid_roles WHERE teacher_id IS NOT NULL), f AS (SELECT t.teacher_id FROM v_teachers t JOIN v_careers c ON c.career_id = t.career_id WHERE c.faculty_id = 1)
SELECT teacher_id, CASE WHEN teacher_id IN (SELECT teacher_id FROM f) THEN 'own_faculty' ELSE 'other_faculty' END AS side FROM v""")
def _(t):
    roles = dashboard.with_own_faculty(Facts(t).valid_roles, t.careers, t.faculties)
    everyone = roles.filter("teacher_id IS NOT NULL").select("teacher_id").distinct()
    own = roles.filter("own_faculty").select("teacher_id")
    return everyone.intersect(own).withColumn("side", F.lit("own_faculty")).union(
        everyone.subtract(own).withColumn("side", F.lit("other_faculty")))


def _sums(columns):
    text = "concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '\\N')" for c in sorted(columns)) + ")"
    parts = ", ".join(f"CAST(coalesce(sum(CAST(('0x' || substr(h, {s}, 15)) AS BIGINT)), 0) AS VARCHAR)" for s in (1, 16, 31, 46))
    return text, f"concat_ws('-', {parts})"


def digest_sql(label, table, columns, where="true"):
    text, sums = _sums(columns)
    return f"SELECT '{label}' AS label, count(*) AS row_count, sha256(concat_ws(':', count(*), {sums})) AS digest FROM (SELECT sha256({text}) AS h FROM {table} WHERE {where}) d"


TABLES = {
    "teachers": ("v_teachers", ["teacher_id", "career_id", "full_name", "segment", "institutional_email"]),
    "roles": ("v_roles", ["role_id", "teacher_id", "canonical_key", "role_type", "validation_status"]),
    "authors": ("v_authors", ["author_id", "canonical_key", "person_type", "validation_status"]),
    "jobs": ("v_jobs", ["job_id", "document_key", "status"]),
    "documents": ("documents", ["doc_id", "lang", "source", "text"]),
}


def _snapshot(t, names=tuple(TABLES)):
    return compare.snapshot({n: (getattr(t, TABLES[n][0]), TABLES[n][1]) for n in names})


def snapshot_sql(names=tuple(TABLES)):
    return " UNION ALL ".join(digest_sql(n, *TABLES[n]) for n in names)


@query("au05_table_digest", snapshot_sql())
def _(t):
    return _snapshot(t)


@query("au06_query_digest", digest_sql("participants", "x_participants", ["canonical_identity_key", "participation_count", "authorship_count", "overall_status"]))
def _(t):
    return compare.table_digest(Facts(t).participants, "participants", ["canonical_identity_key", "participation_count", "authorship_count", "overall_status"])


X_CHANGED = f"""
WITH b AS ({snapshot_sql(("teachers", "roles", "jobs"))}),
a AS ({digest_sql("teachers", "v_teachers", TABLES["teachers"][1])} UNION ALL {digest_sql("roles", "v_roles", TABLES["roles"][1], "role_type <> 'coordinador'")} UNION ALL {digest_sql("documents", "documents", TABLES["documents"][1])}),
d AS (SELECT coalesce(b.label, a.label) AS label, CASE WHEN a.label IS NULL THEN 'removed' WHEN b.label IS NULL THEN 'added' WHEN a.row_count <> b.row_count THEN 'row_count' WHEN a.digest <> b.digest THEN 'digest' END AS change,
  coalesce(a.row_count, 0) - coalesce(b.row_count, 0) AS row_delta FROM b FULL JOIN a ON a.label = b.label)"""


def _changed(t):
    after = compare.snapshot({
        "teachers": (t.teachers, TABLES["teachers"][1]), "roles": (t.roles.filter("role_type <> 'coordinador'"), TABLES["roles"][1]),
        "documents": (t.documents, TABLES["documents"][1])})
    return compare.compare_digests(_snapshot(t, ("teachers", "roles", "jobs")), after)


@query("set05_table_comparison", X_CHANGED + "SELECT * FROM d WHERE change IS NOT NULL")
def _(t):
    return _changed(t)


@query("au07_invariant_compare", X_CHANGED + """
SELECT label AS item, change FROM d WHERE change IS NOT NULL
UNION ALL SELECT concat('participant_metrics.', metric), 'value' FROM (
  SELECT 'pending' AS metric, count(*) FILTER (overall_status = 'pending_review') AS b, count(*) FILTER (overall_status = 'pending_review' AND identity_source <> 'human_review') AS a FROM x_participants
  UNION ALL SELECT 'canonical_identities', count(*), count(*) FILTER (identity_source <> 'human_review') FROM x_participants) m WHERE a <> b""")
def _(t):
    people = Facts(t).participants.withColumn("plain", F.col("identity_source") != "human_review")
    counts = people.agg(
        F.count_if(F.col("overall_status") == "pending_review").alias("b_pending"), F.count_if((F.col("overall_status") == "pending_review") & F.col("plain")).alias("a_pending"),
        F.count(F.lit(1)).alias("b_canonical_identities"), F.count_if("plain").alias("a_canonical_identities"))
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").alias("b"), F.col(f"a_{m}").alias("a")) for m in ("pending", "canonical_identities")])
    metrics = counts.select(F.explode(pairs).alias("m")).filter("m.a <> m.b").select(
        F.concat(F.lit("participant_metrics."), "m.metric").alias("item"), F.lit("value").alias("change"))
    return _changed(t).select(F.col("label").alias("item"), "change").unionByName(metrics)


PROPOSED = """
WITH c AS (SELECT role_id, canonical_key, canonical_name, identity_locked FROM v_roles),
p AS (SELECT r.role_id, CASE WHEN d.approved THEN d.identity_key ELSE r.canonical_key END AS canonical_key, CASE WHEN d.approved THEN coalesce(d.identity_name, r.canonical_name) ELSE r.canonical_name END AS canonical_name
  FROM v_roles r LEFT JOIN v_decisions d ON d.target_id = r.role_id)"""


def _proposed(t):
    d = t.decisions.filter("approved").select(F.col("target_id").alias("role_id"), "identity_key", "identity_name", F.lit(True).alias("_d"))
    return t.roles.join(d, "role_id", "left").select(
        "role_id", F.when(F.col("_d"), F.col("identity_key")).otherwise(F.col("canonical_key")).alias("canonical_key"),
        F.when(F.col("_d"), F.coalesce("identity_name", "canonical_name")).otherwise(F.col("canonical_name")).alias("canonical_name"))


FIELDS = ["canonical_key", "canonical_name"]


@query("set06_apply_plan", PROPOSED + """
SELECT c.role_id, CASE WHEN c.identity_locked THEN 'locked' WHEN c.canonical_key IS NOT DISTINCT FROM p.canonical_key AND c.canonical_name IS NOT DISTINCT FROM p.canonical_name THEN 'unchanged' ELSE 'changed' END AS state FROM c JOIN p ON p.role_id = c.role_id""")
def _(t):
    return compare.apply_plan(t.roles, _proposed(t), "role_id", FIELDS, "identity_locked")


@query("set07_restore_plan", PROPOSED + """
SELECT c.role_id, c.canonical_key, c.canonical_name FROM c JOIN p ON p.role_id = c.role_id WHERE c.canonical_key IS DISTINCT FROM p.canonical_key OR c.canonical_name IS DISTINCT FROM p.canonical_name""")
def _(t):
    return compare.restore_plan(_proposed(t), t.roles.select("role_id", *FIELDS), "role_id", FIELDS)


@query("set08_drift", PROPOSED + """
SELECT c.role_id FROM c JOIN v_roles r ON r.role_id = c.role_id JOIN p ON p.role_id = c.role_id WHERE r.role_type = 'director' AND (c.canonical_name || '?' IS DISTINCT FROM p.canonical_name)""")
def _(t):
    now = t.roles.select("role_id", "canonical_key", F.when(F.col("role_type") == "director", F.concat("canonical_name", F.lit("?"))).otherwise(F.col("canonical_name")).alias("canonical_name"))
    return compare.drift(now, t.roles, _proposed(t), "role_id", FIELDS)


@query("set09_verify_snapshot", """
SELECT role_id, CASE WHEN role_type = 'coordinador' THEN 'id removed' ELSE 'immutable field mismatch' END AS violation FROM v_roles WHERE role_type = 'coordinador' OR role_type = 'miembro'""")
def _(t):
    columns = ["role_id", "person_key", "role_type"]
    stored = t.roles.select(*columns, compare.row_hash(columns).alias("stored_hash"))
    now = t.roles.filter("role_type <> 'coordinador'").withColumn("person_key", F.when(F.col("role_type") == "miembro", F.upper("person_key")).otherwise(F.col("person_key")))
    return compare.verify_snapshot(now.select(*columns), stored, "role_id", columns, "stored_hash")


@query("set10_operational_population", """
SELECT p.production_id, e.evidence_job AS effective_job_id, CASE WHEN p.job_id IN (SELECT job_id FROM x_current) THEN 'direct_current_product' WHEN e.evidence_job IS NOT NULL THEN 'current_normalization_audit' ELSE 'unscoped_master' END AS evidence_source
FROM v_productions p LEFT JOIN (SELECT q.production_id, coalesce(CASE WHEN q.job_id IN (SELECT job_id FROM x_current) THEN q.job_id END, a.job_id) AS evidence_job FROM v_productions q
  LEFT JOIN (SELECT record_id, min(job_id) AS job_id FROM v_audits WHERE entity_type = 'scientific_production' AND source_section = 'produccion_cientifica' AND record_id IS NOT NULL AND job_id IN (SELECT job_id FROM x_current) GROUP BY 1) a ON a.record_id = q.production_id) e ON e.production_id = p.production_id
WHERE p.job_id IS NULL OR e.evidence_job IS NOT NULL""")
def _(t):
    from tallyloom.operators.participants import evidence_jobs

    f = Facts(t)
    rows = t.productions.select("production_id", "job_id").join(evidence_jobs(t.productions, f.current, t.audits), "production_id")
    kept = rows.filter("job_id IS NULL OR evidence_job IS NOT NULL")
    source = F.when(F.col("evidence_job") == F.col("job_id"), "direct_current_product").when(F.col("evidence_job").isNotNull(), "current_normalization_audit").otherwise("unscoped_master")
    return kept.select("production_id", F.col("evidence_job").alias("effective_job_id"), source.alias("evidence_source"))


@query("au18_sequence_gap", "SELECT 'orders' AS table_name, max(production_id) + 1 AS next_id, count(*) AS row_count FROM v_productions")
def _(t):
    return t.productions.agg(F.lit("orders").alias("table_name"), (F.max("production_id") + 1).alias("next_id"), F.count(F.lit(1)).alias("row_count"))


@query("au19_duplicate_keys", "SELECT production_id, author_order, count(*) AS n FROM v_authors GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return compare.duplicate_keys(t.authors, ["production_id", "author_order"])


@query("au21_no_op", PROPOSED + """
SELECT count(*) FILTER (c.canonical_key IS DISTINCT FROM p.canonical_key) AS changed, 0::BIGINT AS changed_again FROM c JOIN p ON p.role_id = c.role_id""")
def _(t):
    once = _proposed(t)
    first = compare.apply_plan(t.roles.withColumn("identity_locked", F.lit(False)), once, "role_id", ["canonical_key"], "identity_locked")
    again = compare.apply_plan(once.withColumn("identity_locked", F.lit(False)), once, "role_id", ["canonical_key"], "identity_locked")
    count = F.count_if(F.col("state") == "changed")
    parts = [first.agg(count.alias("changed")).withColumn("k", F.lit(1)), again.agg(count.alias("changed_again")).withColumn("k", F.lit(1))]
    return kpis.stack_frames(parts, ["k"], ["changed", "changed_again"]).drop("k")


@query("au22_promotion_invariants", """
SELECT 'duplicate_current' AS violation, document_key, count(*) AS n FROM x_job_state WHERE is_current GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'duplicate_revision', document_key, count(*) FROM v_jobs GROUP BY document_key, user_id, status HAVING count(*) > 1""")
def _(t):
    state = scope.promote_versions(t.jobs)
    live = state.filter("is_current").groupBy("document_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    revisions = t.jobs.groupBy("document_key", "user_id", "status").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    links = state.select(F.col("supersedes_id").alias("_s"), F.col("document_key").alias("_d")).filter("_s IS NOT NULL")
    broken = links.join(state.select(F.col("job_id").alias("_s"), F.col("document_key").alias("_k"), "is_current"), "_s").filter("is_current OR _d <> _k")
    parts = [("duplicate_current", live.select("document_key", "n")), ("duplicate_revision", revisions.select("document_key", "n")),
             ("broken_chain", broken.select(F.col("_d"), F.lit(1).cast("long")))]
    result = None
    for name, df in parts:
        part = df.toDF("document_key", "n").select(F.lit(name).alias("violation"), "document_key", "n")
        result = part if result is None else result.union(part)
    return result


@query("au23_protected_snapshot", """
SELECT t.trace_id, t.report_id, sha256(t.text) AS text_hash, coalesce(r.n, 0) AS referencing_rows FROM v_traces t LEFT JOIN (SELECT job_id, count(*) AS n FROM v_roles GROUP BY 1) r ON r.job_id = t.job_id""")
def _(t):
    refs = t.roles.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"))
    return t.traces.join(refs, "job_id", "left").select("trace_id", "report_id", F.sha2("text", 256).alias("text_hash"), F.coalesce("_n", F.lit(0).cast("long")).alias("referencing_rows"))


