"""Decision log and overlay queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.hashing import IDENTITY_NAMESPACE
from tallyloom.functions.text import target_key
from tallyloom.operators import decisions as D
from tallyloom.operators import materialize as M
from tallyloom.plans.identity import uuid_sql
from tallyloom.plans.registry import query
from tallyloom.session import work_folder



def _seq_slice():
    return F.floor(F.col("seq") / 100_000)


def _cases(t):
    """Cases with their decision: labels as targets, every third one opened twice."""
    d = t.decisions.select("target_id", "scientific_status", "identity_key", "approved", F.lit("resolved").alias("case_status"),
                           (F.col("target_id") % 7 != 0).alias("locked"), (F.col("target_id") % 11 != 0).alias("snapshot_matches"))
    again = d.filter("target_id % 5 = 0").withColumn("case_status", F.when(F.col("target_id") % 2 == 0, "superseded").otherwise("reopened"))
    return d.unionByName(again)


CASES = """
WITH c AS (SELECT target_id, scientific_status, identity_key, approved, target_id % 7 <> 0 AS locked, target_id % 11 <> 0 AS snap FROM v_decisions UNION ALL
  SELECT target_id, scientific_status, identity_key, approved, target_id % 7 <> 0, target_id % 11 <> 0 FROM v_decisions WHERE target_id % 5 = 0 AND target_id % 2 <> 0),
o AS (SELECT target_id, count(*) AS cases, min(scientific_status) AS st, min(identity_key) AS ik, bool_and(approved AND locked AND snap) AS ok FROM c GROUP BY 1),
ov AS (SELECT target_id, CASE WHEN cases > 1 THEN 'ambiguous' WHEN NOT ok THEN 'not_materialized' ELSE 'effective' END AS overlay_state, CASE WHEN cases = 1 AND ok THEN st END AS scientific_status, CASE WHEN cases = 1 AND ok THEN ik END AS identity_key FROM o)"""


@query("ov01_effective_overlay", CASES + "SELECT * FROM ov")
def _(t):
    return D.effective_overlay(_cases(t))


@query("ov02_overlay_applied", CASES + """
SELECT r.role_id, coalesce(nullif(ov.scientific_status, 'pending'), r.validation_status) AS status, coalesce(ov.identity_key, r.canonical_key) AS key FROM v_roles r LEFT JOIN ov ON ov.target_id = r.role_id""")
def _(t):
    overlay = D.effective_overlay(_cases(t)).select(F.col("target_id").alias("role_id"), F.col("scientific_status").alias("_s"), "identity_key")
    return t.roles.join(overlay, "role_id", "left").select(
        "role_id", F.coalesce(F.nullif("_s", F.lit("pending")), "validation_status").alias("status"), F.coalesce("identity_key", "canonical_key").alias("key"))


@query("ov03_context_match", """
SELECT author_id, CASE author_order WHEN 1 THEN true WHEN 2 THEN job_id IS NOT NULL AND job_id % 2 = 0 WHEN 3 THEN production_id % 3 = 0 WHEN 4 THEN true WHEN 5 THEN true ELSE false END AS applies FROM v_authors""")
def _(t):
    scope = F.element_at(F.array(*[F.lit(s) for s in ("record", "document", "period", "relationship", "global_identity", "unknown", "unknown")]), F.col("author_order"))
    rows = t.authors.select(
        "author_id", scope.alias("scope"), F.col("author_id").alias("record_id"), F.col("author_id").alias("o_record"), F.col("job_id").alias("document_id"),
        F.when(F.col("job_id") % 2 == 0, F.col("job_id")).otherwise(F.lit(-1)).alias("o_document"), F.col("production_id").alias("period_id"),
        F.when(F.col("production_id") % 3 == 0, F.col("production_id")).alias("o_period"), F.col("canonical_key").alias("relation_key"), F.col("canonical_key").alias("o_relation"))
    return rows.select("author_id", D.in_context().alias("applies"))


def _override_rows(t):
    return t.authors.select(F.col("production_id").alias("decision_id"), F.col("author_order").cast("string").alias("context"), F.col("validation_status").alias("value"))


@query("ov04_materialization", """
WITH a AS (SELECT production_id AS d, author_order AS c, count(*) AS n, min(validation_status) AS v FROM v_authors GROUP BY 1, 2), s AS (SELECT production_id AS d, author_order AS c, count(*) AS n, min(CASE WHEN confidence > 0.08 THEN 'x' ELSE validation_status END) AS v FROM v_authors WHERE author_order < 7 GROUP BY 1, 2)
SELECT coalesce(a.d, s.d) AS decision_id, bool_and(coalesce(a.n = 1 AND s.n = 1 AND a.v IS NOT DISTINCT FROM s.v, false)) AS materialized, count(*) AS contexts FROM a FULL JOIN s ON s.d = a.d AND s.c = a.c GROUP BY 1""")
def _(t):
    stored = t.authors.filter("author_order < 7").select(
        F.col("production_id").alias("decision_id"), F.col("author_order").cast("string").alias("context"), F.when(F.col("confidence") > 0.08, "x").otherwise(F.col("validation_status")).alias("value"))
    return D.materialization(_override_rows(t), stored)


@query("ov05_override_replacement", """
SELECT audit_id, lead(audit_id) OVER (PARTITION BY raw_value, entity_type ORDER BY audit_id) AS superseded_by, lead(audit_id) OVER (PARTITION BY raw_value, entity_type ORDER BY audit_id) IS NULL AS is_active FROM v_audits""")
def _(t):
    rows = t.audits.select("audit_id", "raw_value", "entity_type")
    return D.supersede(rows, ["raw_value", "entity_type"], "audit_id", -F.floor(F.col("audit_id") / 1_000_000)).select("audit_id", "superseded_by", "is_active")


COMMANDS = """
WITH m AS (SELECT item_id, CASE case_type WHEN 'product_validation' THEN 'product' WHEN 'identity_conflict' THEN 'person_identity' WHEN 'project_director' THEN 'project_director_relation' WHEN 'possible_duplicate' THEN 'possible_duplicate' ELSE 'external_identity' END AS case_type,
  CASE WHEN automatic_priority % 3 = 0 THEN 'approve' WHEN automatic_priority % 3 = 1 THEN 'correct' ELSE 'link' END AS action, CASE item_id % 4 WHEN 0 THEN 'linked' WHEN 1 THEN 'merged' WHEN 2 THEN 'separated' END AS resolution FROM v_review_items)"""


def _commands(t):
    case = F.element_at(F.create_map(*[F.lit(x) for p in (("product_validation", "product"), ("identity_conflict", "person_identity"), ("project_director", "project_director_relation"),
                                                         ("possible_duplicate", "possible_duplicate"), ("external_institution", "external_identity")) for x in p]), F.col("case_type"))
    p = F.col("automatic_priority") % 3
    mod = F.col("item_id") % 4
    return t.review_items.select(
        "item_id", case.alias("case_type"), F.when(p == 0, "approve").when(p == 1, "correct").otherwise("link").alias("action"),
        F.when(mod == 0, "linked").when(mod == 1, "merged").when(mod == 2, "separated").alias("resolution"))


@query("ov06_decision_derivation", COMMANDS + """
SELECT item_id, CASE WHEN action <> 'link' AND case_type <> 'possible_duplicate' AND resolution IS NULL THEN CASE action WHEN 'approve' THEN 'validated' ELSE 'corrected' END
  WHEN action = 'link' AND case_type = 'possible_duplicate' AND resolution IN ('merged', 'separated') THEN resolution WHEN action = 'link' AND case_type NOT IN ('possible_duplicate', 'product') AND resolution IN ('linked', 'separated') THEN resolution END AS decision_type FROM m""")
def _(t):
    return D.derive_decisions(_commands(t)).select("item_id", "decision_type")


@query("ov07_reason_required", COMMANDS + "SELECT item_id, action <> 'approve' OR coalesce(resolution IN ('merged', 'separated'), false) OR item_id % 2 = 1 AS required FROM m")
def _(t):
    final = F.when(F.col("item_id") % 2 == 1, "b").otherwise("a")
    return _commands(t).select("item_id", F.coalesce(D.reason_required(F.col("action"), F.coalesce("resolution", F.lit("")), F.lit("a"), final), F.lit(False)).alias("required"))


@query("ov08_state_machine", """
SELECT case_id, seq, p AS previous_status, case_status FROM (SELECT *, lag(case_status) OVER (PARTITION BY case_id ORDER BY seq) AS p FROM v_decision_log) l
WHERE p IS NOT NULL AND NOT (p = 'pending' AND case_status IN ('in_review', 'resolved', 'superseded') OR p = 'in_review' AND case_status IN ('awaiting_gestor_approval', 'resolved', 'conflicted') OR p = 'resolved' AND case_status IN ('reopened', 'conflicted', 'superseded') OR p = 'conflicted' AND case_status IN ('in_review', 'resolved'))""")
def _(t):
    return D.transition_errors(t.decision_log, _seq_slice())


@query("ov09_version_fold", """
WITH RECURSIVE c AS (SELECT case_id, min(seq) AS seq, 1 AS v FROM v_decision_log WHERE expected_version = 1 GROUP BY 1
  UNION ALL SELECT c.case_id, (SELECT min(l.seq) FROM v_decision_log l WHERE l.case_id = c.case_id AND l.expected_version = c.v + 1 AND l.seq > c.seq) AS seq, c.v + 1 FROM c WHERE c.seq IS NOT NULL)
SELECT l.case_id, l.seq, CASE WHEN c.seq IS NOT NULL THEN 'applied' ELSE 'conflict' END AS outcome FROM v_decision_log l LEFT JOIN c ON c.case_id = l.case_id AND c.seq = l.seq""")
def _(t):
    return D.fold_versions(t.decision_log, -F.floor(F.col("seq") / 100_000)).select("case_id", "seq", "outcome")


@query("ov10_duplicate_resolution", """
WITH c AS (SELECT role_id, canonical_key AS own, CASE WHEN role_id % 3 = 0 THEN canonical_key ELSE concat('external:', role_id % 50) END AS other, CASE role_id % 4 WHEN 0 THEN 'merged' WHEN 1 THEN 'maintained_separate' ELSE 'separated' END AS dt FROM v_roles)
SELECT role_id, CASE WHEN own IS NULL OR other IS NULL THEN NULL WHEN dt = 'merged' THEN other WHEN dt = 'maintained_separate' THEN CASE WHEN own <> other THEN own END WHEN own = other THEN concat('human:separated:', sha256(concat('t', role_id))) ELSE own END AS result_key,
  CASE WHEN own IS NULL OR other IS NULL THEN 'two identities needed' WHEN dt = 'maintained_separate' AND own = other THEN 'identities must differ' END AS reject_reason FROM c""")
def _(t):
    mod = F.col("role_id") % 4
    rows = t.roles.select(
        "role_id", F.col("canonical_key").alias("own_key"), F.when(F.col("role_id") % 3 == 0, F.col("canonical_key")).otherwise(F.concat(F.lit("external:"), (F.col("role_id") % 50).cast("string"))).alias("counterpart_key"),
        F.when(mod == 0, "merged").when(mod == 1, "maintained_separate").otherwise("separated").alias("decision_type"), F.concat(F.lit("t"), F.col("role_id").cast("string")).alias("target_key"))
    return D.duplicate_resolution(rows).select("role_id", "result_key", "reject_reason")


@query("ov11_reversals", """
WITH RECURSIVE s AS (SELECT case_id, seq, CASE WHEN reverts_seq IS NULL THEN seq ELSE reverts_seq - 1 END AS src, 0 AS n FROM v_decision_log
  UNION ALL SELECT s.case_id, s.seq, l.reverts_seq - 1, s.n + 1 FROM s JOIN v_decision_log l ON l.case_id = s.case_id AND l.seq = s.src WHERE l.reverts_seq IS NOT NULL),
f AS (SELECT case_id, seq, arg_max(src, n) AS src FROM s GROUP BY 1, 2)
SELECT f.case_id, f.seq, v.value AS effective_value FROM f LEFT JOIN v_decision_log v ON v.case_id = f.case_id AND v.seq = f.src""")
def _(t):
    return D.restore_values(t.decision_log).select("case_id", "seq", "effective_value")


@query("ov12_sequence_errors", """
SELECT case_id, seq, p AS previous_seq FROM (SELECT case_id, seq, lag(seq) OVER (PARTITION BY case_id ORDER BY seq) AS p FROM v_decision_log WHERE role <> 'user' OR seq = 1) l WHERE seq <> coalesce(p, 0) + 1""")
def _(t):
    return D.sequence_errors(t.decision_log.filter("role <> 'user' OR seq = 1"), _seq_slice())


@query("ov13_stable_target", """
SELECT doc_id, concat('b2b:v1:product:', sha256('{"case_type":"product","document_key":"' || source || '","source_page":' || (doc_id % 9) || ',"source_section":null}')) AS stable_key, sha256(text) AS raw_hash FROM documents""")
def _(t):
    locator = {"document_key": F.col("source"), "source_section": F.lit(None).cast("string"), "source_page": F.col("doc_id") % 9}
    return t.documents.select("doc_id", D.stable_target_key(F.lit("product"), locator).alias("stable_key"), F.sha2("text", 256).alias("raw_hash"))


def _candidates(t):
    """Review candidates of four populations with the reason they cannot become a case."""
    pending = lambda df, table, key, doc: df.filter("validation_status = 'pending_review'").select(
        F.lit(table).alias("target_table"), F.col(key).cast("string").alias("target_pk"), F.lit("pending_status").alias("membership"), doc.alias("document"))
    doc = F.col("job_id").cast("string")
    rows = pending(t.roles, "person_roles", "role_id", doc).unionByName(pending(t.productions, "scientific_productions", "production_id", doc)).unionByName(
        pending(t.entities, "research_entities", "entity_id", doc)).unionByName(pending(t.authors, "scientific_production_authors", "author_id", doc))
    unsure = t.roles.filter("canonical_key IS NULL OR canonical_key LIKE 'pending:%'").select(
        F.lit("person_roles"), F.col("role_id").cast("string"), F.lit("pending_identity"), doc)
    return rows.union(unsure)


@query("ov14_case_discovery", """
WITH c AS (SELECT 'person_roles' AS target_table, CAST(role_id AS VARCHAR) AS target_pk, 'pending_status' AS m, job_id FROM v_roles WHERE validation_status = 'pending_review'
  UNION ALL SELECT 'scientific_productions', CAST(production_id AS VARCHAR), 'pending_status', job_id FROM v_productions WHERE validation_status = 'pending_review' UNION ALL SELECT 'research_entities', CAST(entity_id AS VARCHAR), 'pending_status', job_id FROM v_entities WHERE validation_status = 'pending_review'
  UNION ALL SELECT 'scientific_production_authors', author_id, 'pending_status', job_id FROM v_authors WHERE validation_status = 'pending_review' UNION ALL SELECT 'person_roles', CAST(role_id AS VARCHAR), 'pending_identity', job_id FROM v_roles WHERE canonical_key IS NULL OR canonical_key LIKE 'pending:%')
SELECT target_table, target_pk, string_agg(DISTINCT m, '+' ORDER BY m) AS memberships, CASE WHEN max(job_id) IS NULL THEN 'missing_stable_locator' END AS blocker FROM c GROUP BY 1, 2""")
def _(t):
    grouped = _candidates(t).groupBy("target_table", "target_pk").agg(
        F.array_join(F.array_sort(F.collect_set("membership")), "+").alias("memberships"), F.max("document").alias("_doc"))
    return grouped.select("target_table", "target_pk", "memberships", F.when(F.col("_doc").isNull(), "missing_stable_locator").alias("blocker"))


@query("ov15_ambiguous_alias", "SELECT lower(canonical_name) AS alias, count(DISTINCT canonical_key) AS identities FROM v_roles WHERE canonical_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT canonical_key) > 1")
def _(t):
    rows = t.roles.filter("canonical_key IS NOT NULL").select(target_key(F.col("canonical_name")).alias("alias"), "canonical_key")
    return rows.groupBy("alias").agg(F.count_distinct("canonical_key").alias("identities")).filter("identities > 1")


@query("ov16_evidence_resolution", """
SELECT i.item_id, CASE WHEN t.job_id IS NOT NULL AND t.job_id = i.document_id AND r.trace_id IS NOT NULL THEN 'available' ELSE 'unavailable' END AS evidence
FROM v_review_items i LEFT JOIN v_targets t ON t.target_table = i.target_table AND t.target_pk = i.target_pk LEFT JOIN v_traces r ON r.job_id = t.job_id""")
def _(t):
    traces = t.traces.select("job_id", "trace_id")
    rows = t.review_items.join(t.targets, ["target_table", "target_pk"], "left").join(traces, "job_id", "left")
    fits = F.col("job_id").isNotNull() & (F.col("job_id") == F.col("document_id")) & F.col("trace_id").isNotNull()
    return rows.select("item_id", F.when(fits, "available").otherwise("unavailable").alias("evidence"))


@query("ov17_current_values", """
SELECT i.item_id, CASE i.case_type WHEN 'product_validation' THEN d.scientific_status WHEN 'identity_conflict' THEN d.identity_key WHEN 'possible_duplicate' THEN d.identity_key ELSE d.identity_name END AS current_value FROM v_review_items i JOIN v_decisions d ON d.target_id = i.target_pk AND d.approved""")
def _(t):
    d = t.decisions.filter("approved").select(F.col("target_id").alias("target_pk"), "scientific_status", "identity_key", "identity_name")
    value = F.when(F.col("case_type") == "product_validation", F.col("scientific_status")).when(F.col("case_type").isin("identity_conflict", "possible_duplicate"), F.col("identity_key")).otherwise(F.col("identity_name"))
    return t.review_items.join(d, "target_pk").select("item_id", value.alias("current_value"))


@query("ov18_memberships", "SELECT item_id, CASE WHEN case_status IN ('pending', 'reopened') THEN 'open' WHEN case_status = 'resolved' THEN 'closed' ELSE 'working' END AS membership FROM v_review_items")
def _(t):
    s = F.col("case_status")
    return t.review_items.select("item_id", F.when(s.isin("pending", "reopened"), "open").when(s == "resolved", "closed").otherwise("working").alias("membership"))


@query("ov19_locked_import", """
SELECT author_id, CASE WHEN canonical_key IS NULL THEN 'missing identity key' WHEN reason IS NULL THEN 'missing actor' END AS blocker FROM v_authors WHERE identity_locked""")
def _(t):
    blocker = F.when(F.col("canonical_key").isNull(), "missing identity key").when(F.trim("canonical_name") == "", "missing name").when(F.col("reason").isNull(), "missing actor").when(F.col("created_at").isNull(), "missing time")
    return t.authors.filter("identity_locked").select("author_id", blocker.alias("blocker"))


def _accounts(t):
    role = F.when(F.col("segment") == "BUILDING", "career_manager").when(F.col("segment") == "MACHINERY", "teacher").otherwise("faculty_admin")
    users = t.teachers.select(F.col("teacher_id").alias("user_id"), F.concat(F.lit("u"), F.col("teacher_id").cast("string"), F.lit("@uni.edu")).alias("email"), "is_active", role.alias("role"),
                              F.when(F.col("segment") != "BUILDING", F.lit(1)).alias("faculty_id"), F.col("career_id"))
    n = F.col("user_id")
    held = users.filter(n % 3 == 0).select("user_id", F.when(n % 2 == 0, "research_manager").otherwise("system_admin").alias("capability"))
    held = held.union(users.filter(n % 15 == 0).select("user_id", F.lit("research_manager")))
    plan = users.select((n + 5).alias("user_id"), F.when(n % 9 == 0, "x@uni.edu").otherwise(F.concat(F.lit("u"), (n + 5).cast("string"), F.lit("@uni.edu"))).alias("email"), F.lit("research_manager").alias("capability"))
    return users, held, plan


ACCOUNTS = """
WITH u AS (SELECT teacher_id AS user_id, concat('u', teacher_id, '@uni.edu') AS email, is_active, CASE segment WHEN 'BUILDING' THEN 'career_manager' WHEN 'MACHINERY' THEN 'teacher' ELSE 'faculty_admin' END AS role FROM v_teachers),
h AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'research_manager' ELSE 'system_admin' END AS c FROM u WHERE user_id % 3 = 0 UNION ALL SELECT user_id, 'research_manager' FROM u WHERE user_id % 15 = 0),
g AS (SELECT user_id, count(*) AS n, min(c) AS c FROM h GROUP BY 1), p AS (SELECT user_id + 5 AS user_id, CASE WHEN user_id % 9 = 0 THEN 'x@uni.edu' ELSE concat('u', user_id + 5, '@uni.edu') END AS email FROM u),
v AS (SELECT p.user_id, CASE WHEN u.user_id IS NULL THEN 'user_not_found' WHEN u.email <> p.email THEN 'email_mismatch' WHEN NOT u.is_active THEN 'user_inactive' WHEN u.role = 'career_manager' THEN 'career_manager_denied' WHEN g.n IS NULL THEN 'eligible_for_insert'
  WHEN g.n <> 1 THEN 'conflicting_active_assignments' WHEN g.c = 'research_manager' THEN 'active_assignment_matches' ELSE 'different_active_capability' END AS reason FROM p LEFT JOIN u ON u.user_id = p.user_id LEFT JOIN g ON g.user_id = p.user_id)"""


def _assignments(t):
    users, held, plan = _accounts(t)
    return D.classify_assignments(plan, users, held)


@query("ov20_capability_plan", ACCOUNTS + "SELECT user_id, reason FROM v")
def _(t):
    return _assignments(t).select("user_id", "reason")


@query("k43_assignment_counts", ACCOUNTS + "SELECT CASE reason WHEN 'eligible_for_insert' THEN 'insert' WHEN 'active_assignment_matches' THEN 'unchanged' ELSE 'conflict' END AS action, count(*) AS n FROM v GROUP BY 1")
def _(t):
    return _assignments(t).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("ov21_effective_actions", ACCOUNTS + """
SELECT u.user_id, array_to_string(CASE WHEN NOT is_active OR role = 'teacher' THEN [] WHEN role = 'faculty_admin' AND g.n = 1 AND g.c = 'research_manager' THEN ['apply_scientific', 'propose_scientific', 'revert_scientific', 'view_audit', 'view_foundations']
  WHEN role = 'faculty_admin' AND g.n = 1 THEN ['apply_scientific', 'manage_technical_access', 'revert_scientific', 'view_audit', 'view_foundations'] ELSE ['apply_scientific', 'revert_scientific', 'view_audit', 'view_foundations'] END, ',') AS actions FROM u LEFT JOIN g ON g.user_id = u.user_id""")
def _(t):
    users, held, _plan = _accounts(t)
    return D.effective_actions(users, held).select("user_id", F.array_join("actions", ",").alias("actions"))


def _written(t):
    d = _commands(t).select("item_id", "case_type", F.when(F.col("item_id") % 2 == 0, "global_identity").otherwise("record").alias("scope"), F.lit("validated").alias("decision_type"),
                            F.concat(F.lit("v"), F.col("item_id").cast("string")).alias("payload_value"))
    return D.decision_overrides(d)


WRITTEN = COMMANDS + """,
f AS (SELECT item_id, case_type, CASE WHEN item_id % 2 = 0 THEN 'global_identity' ELSE 'record' END AS scope, unnest(CASE case_type WHEN 'person_identity' THEN ['canonical_identity_key', 'canonical_name', 'scientific_status'] WHEN 'product' THEN ['product_title', 'scientific_status']
  WHEN 'project_director_relation' THEN ['project_director_identity_key', 'project_director_relationship_status', 'scientific_status'] WHEN 'external_identity' THEN ['external_identity_key', 'external_institution', 'scientific_status'] ELSE ['scientific_status'] END) AS field_path FROM m),
w AS (SELECT item_id, field_path, CASE WHEN field_path = 'scientific_status' THEN 'record' ELSE scope END AS field_scope, CASE WHEN field_path = 'scientific_status' THEN 'validated' ELSE concat('v', item_id) END AS value FROM f)"""


@query("ov22_decision_fields", WRITTEN + "SELECT * FROM w")
def _(t):
    return _written(t).select("item_id", "field_path", "field_scope", "value")


@query("ov23_merge_overrides", WRITTEN + """
SELECT item_id, field_path, value FROM w WHERE item_id % 3 <> 0 OR field_path <> 'scientific_status' UNION ALL SELECT item_id, field_path, 'replaced' FROM w WHERE item_id % 3 = 0 AND field_path = 'scientific_status'""")
def _(t):
    current = _written(t).select("item_id", "field_path", "value")
    new = current.filter("item_id % 3 = 0 AND field_path = 'scientific_status'").withColumn("value", F.lit("replaced"))
    return D.merge_overrides(current, new, ["item_id", "field_path"])


@query("ov24_alias_supersession", """
SELECT role_id, lower(canonical_name) AS alias, lead(role_id) OVER (PARTITION BY lower(canonical_name) ORDER BY role_id) AS superseded_by FROM v_roles""")
def _(t):
    rows = t.roles.select("role_id", target_key(F.col("canonical_name")).alias("alias"))
    return D.supersede(rows, ["alias"], "role_id", -F.floor(F.col("role_id") / 1_000_000)).select("role_id", "alias", "superseded_by")


@query("ov25_payload_rules", """
SELECT case_id, NOT (scientific_status = 'validated' AND identity_key IS NULL AND scope = 'global_identity') AND NOT (identity_key IS NOT NULL AND identity_name IS NULL) AS consistent FROM v_decisions""")
def _(t):
    bad = (F.col("scientific_status") == "validated") & F.col("identity_key").isNull() & (F.col("scope") == "global_identity")
    half = F.col("identity_key").isNotNull() & F.col("identity_name").isNull()
    return t.decisions.select("case_id", (~bad & ~half).alias("consistent"))


@query("ov25_payload_consistency", """
WITH o AS (SELECT canonical_key, min(author_id) AS owner FROM v_authors WHERE canonical_key IS NOT NULL GROUP BY 1),
r AS (SELECT a.*, o.owner, CASE WHEN author_order IN (1, 6) THEN 'person_identity' WHEN author_order = 7 THEN 'product' ELSE 'possible_duplicate' END AS case_type,
  CASE WHEN a.validation_status = 'discarded_invalid' THEN 'discarded' WHEN author_order = 2 THEN 'merged' WHEN author_order = 3 THEN 'separated' WHEN author_order IN (4, 5) THEN 'maintained_separate' WHEN author_order = 6 THEN 'reverted' ELSE 'validated' END AS decision_type,
  CASE WHEN author_order = 1 THEN 'identity' WHEN author_order = 2 THEN 'identity_merge' WHEN author_order = 3 THEN 'identity_separation' WHEN author_order = 4 THEN 'maintain_separate' WHEN author_order = 6 THEN 'decision_reversal' ELSE 'field_override' END AS kind
  FROM v_authors a LEFT JOIN o ON o.canonical_key = a.canonical_key)
SELECT author_id, CASE WHEN decision_type = 'reverted' THEN kind = 'decision_reversal'
    WHEN case_type = 'possible_duplicate' THEN kind = CASE decision_type WHEN 'merged' THEN 'identity_merge' WHEN 'separated' THEN 'identity_separation' WHEN 'maintained_separate' THEN 'maintain_separate' ELSE 'field_override' END
    WHEN case_type = 'person_identity' THEN kind = CASE WHEN decision_type = 'discarded' THEN 'field_override' ELSE 'identity' END ELSE kind = 'field_override' END AS fits_case,
  CASE kind WHEN 'decision_reversal' THEN true WHEN 'field_override' THEN NOT coalesce(reason IS NOT NULL, false)
    WHEN 'identity_merge' THEN canonical_key IS NOT NULL AND author_id = owner ELSE canonical_key IS NOT NULL AND reason IS NULL END AS fits_snapshot FROM r""")
def _(t):
    rows = t.authors.filter("canonical_key IS NOT NULL")
    owner = D.first_owner(rows, ["canonical_key"], "author_id").select("author_id", F.lit(True).alias("_first"))
    rows = t.authors.join(owner, "author_id", "left")
    n, key, name = F.col("author_order"), F.col("canonical_key"), F.col("canonical_name")
    case = F.when(n.isin(1, 6), "person_identity").when(n == 7, "product").otherwise("possible_duplicate")
    decided = F.when(F.col("validation_status") == "discarded_invalid", "discarded").when(n == 2, "merged").when(n == 3, "separated").when(n.isin(4, 5), "maintained_separate").when(n == 6, "reverted").otherwise("validated")
    kind = F.when(n == 1, "identity").when(n == 2, "identity_merge").when(n == 3, "identity_separation").when(n == 4, "maintain_separate").when(n == 6, "decision_reversal").otherwise("field_override")
    shown = F.when(F.col("reason").isNull() | (n == 2), key).otherwise(F.lit("otra"))  # a reason stands for a case that was changed since
    none = F.lit(None).cast("string")
    payload = F.struct(
        kind.alias("kind"), key.alias("identity_key"), name.alias("identity_name"), F.col("person_type").alias("identity_type"), F.array(F.when(F.col("_first"), F.col("author_id"))).alias("members"),
        F.array(F.struct(F.lit("x").alias("target_key"), F.lit("y").alias("identity_key"), F.lit("z").alias("name")), F.struct(F.col("author_id").alias("target_key"), key.alias("identity_key"), name.alias("name"))).alias("assignments"),
        none.alias("target_key"), F.lit("canonical_name").alias("field"), F.lit("record").alias("scope"), name.alias("value"), none.alias("context"))
    identity = F.when(key.isNotNull(), F.struct(shown.alias("key"), name.alias("name"), F.col("person_type").alias("type")))
    override = F.struct(F.col("author_id").alias("target_key"), F.lit("canonical_name").alias("field"), F.lit("record").alias("scope"), F.when(F.col("reason").isNull(), name).alias("value"), none.alias("context"))
    snapshot = F.struct(identity.alias("identity"), F.array(override).alias("overrides"))
    return rows.select("author_id", D.payload_fits_case(case, decided, kind).alias("fits_case"), D.payload_fits_snapshot(F.col("author_id"), payload, snapshot).alias("fits_snapshot"))


@query("ov26_reversal_eligibility", """
SELECT r.case_id, r.seq, r.reverts_seq, CASE WHEN r.reverts_seq IS NULL THEN 'no target' WHEN o.seq IS NULL THEN 'unknown target' WHEN r.reverts_seq >= r.seq THEN 'target is later' WHEN o.action = 'revert' THEN 'target is a reversal' END AS reason
FROM v_decision_log r LEFT JOIN v_decision_log o ON o.case_id = r.case_id AND o.seq = r.reverts_seq WHERE r.action = 'revert'""")
def _(t):
    return D.reversal_eligibility(t.decision_log)


@query("ov27_locked_owner", "SELECT canonical_name, min(author_id) AS author_id, arg_min(canonical_key, author_id) AS canonical_key FROM v_authors WHERE identity_locked AND canonical_key IS NOT NULL GROUP BY 1")
def _(t):
    rows = t.authors.filter("identity_locked AND canonical_key IS NOT NULL").select("canonical_name", "author_id", "canonical_key")
    return D.first_owner(rows, ["canonical_name"], "author_id")


@query("ov28_plan_digest", """
WITH h AS (SELECT sha256(concat_ws(chr(31), CAST(item_id AS VARCHAR), case_type, target_table, CAST(target_pk AS VARCHAR))) AS h FROM (SELECT item_id, case_type, target_table, target_pk FROM v_review_items) i)
SELECT count(*) AS candidates, CAST(sum(CAST(('0x' || substr(h, 1, 15)) AS BIGINT)) AS VARCHAR) AS digest FROM h""")
def _(t):
    text = F.concat_ws("\x1f", F.col("item_id").cast("string"), "case_type", "target_table", F.col("target_pk").cast("string"))
    rows = t.review_items.select(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("h"))
    return rows.agg(F.count(F.lit(1)).alias("candidates"), F.sum("h").cast("string").alias("digest"))


@query("ov29_comparison_value", "SELECT teacher_id, full_name <> strip_accents(full_name) AS reason_needed FROM v_teachers")
def _(t):
    from tallyloom.functions.text import strip_accents

    return t.teachers.select("teacher_id", (F.col("full_name") != strip_accents(F.col("full_name"))).alias("reason_needed"))


@query("ov30_case_materialization", """
WITH p AS (SELECT item_id, case_type, target_table, CASE WHEN item_id % 10 = 0 THEN 'changed' ELSE case_status END AS s FROM v_review_items), s AS (SELECT item_id, case_type, target_table, case_status AS s FROM v_review_items WHERE case_type <> 'project_director')
SELECT CASE WHEN s.item_id IS NULL THEN 'created' WHEN s.s IS DISTINCT FROM p.s THEN 'conflict' ELSE 'unchanged' END AS outcome, count(*) AS n FROM p LEFT JOIN s ON s.item_id = p.item_id GROUP BY 1""")
def _(t):
    columns = ["case_type", "target_table", "case_status"]
    planned = t.review_items.select("item_id", "case_type", "target_table", F.when(F.col("item_id") % 10 == 0, "changed").otherwise(F.col("case_status")).alias("case_status"))
    stored = t.review_items.filter("case_type <> 'project_director'").select("item_id", *columns)
    pair = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in columns])
    joined = planned.alias("p").join(stored.alias("s"), F.col("p.item_id") == F.col("s.item_id"), "left")
    outcome = F.when(F.col("s.item_id").isNull(), "created").when(~pair("p").eqNullSafe(pair("s")), "conflict").otherwise("unchanged")
    return joined.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("ov31_locked_materialization", """
WITH c AS (SELECT author_id, canonical_name, canonical_key FROM v_authors WHERE identity_locked AND canonical_key IS NOT NULL), o AS (SELECT canonical_key, min(author_id) AS author_id FROM c GROUP BY 1)
SELECT 'decision' AS table_name, count(*) AS n FROM c UNION ALL SELECT 'override', 3 * count(*) FROM c UNION ALL SELECT 'identity', count(*) FROM o UNION ALL SELECT 'audit', count(*) FROM c""")
def _(t):
    rows = t.authors.filter("identity_locked AND canonical_key IS NOT NULL").select("author_id", "canonical_name", "canonical_key")
    owner = D.first_owner(rows, ["canonical_key"], "author_id").select("author_id", F.lit(True).alias("_owner"))
    outputs = F.array_compact(F.array(F.lit("decision"), F.lit("override"), F.lit("override"), F.lit("override"), F.when(F.col("_owner"), "identity"), F.lit("audit")))
    return rows.join(owner, "author_id", "left").select(F.explode(outputs).alias("table_name")).groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))


def _row_sql(*parts):
    own = "concat_ws(':', " + ", ".join([f"'{M.ROW_PREFIX}'", *parts]) + ")"
    return uuid_sql(own).replace(IDENTITY_NAMESPACE.replace("-", ""), M.ROW_NAMESPACE.replace("-", ""))


@query("ov31_locked_rows", f"""
WITH c AS (SELECT author_id AS k, canonical_key AS i, canonical_name AS n, trim(regexp_replace(lower(concat(canonical_key, ' ', canonical_name)), '[^a-z0-9]+', ' ', 'g')) AS a FROM v_authors WHERE identity_locked AND canonical_key IS NOT NULL),
o AS (SELECT i, min(k) AS k FROM c GROUP BY 1),
p AS (SELECT c.*, o.k IS NOT NULL AS makes, {_row_sql("'decision'", 'c.k')} AS d, {_row_sql("'canonical-identity'", 'c.i')} AS ii, {_row_sql("'person-alias'", 'c.a')} AS ai, {_row_sql("'field-override'", 'c.k', "'canonical_identity_key'")} AS o1, {_row_sql("'field-override'", 'c.k', "'canonical_name'")} AS o2 FROM c LEFT JOIN o ON o.i = c.i AND o.k = c.k),
r AS (SELECT 'decision' AS table_name, d AS row_id, d AS decision_id, k AS target_key, 'validated' AS field, i AS value FROM p
  UNION ALL SELECT 'override', o1, d, k, 'canonical_identity_key', i FROM p UNION ALL SELECT 'override', o2, d, k, 'canonical_name', n FROM p
  UNION ALL SELECT 'identity', ii, d, k, i, n FROM p WHERE makes UNION ALL SELECT 'alias', ai, d, k, a, ii FROM p WHERE makes),
e AS (SELECT d, k, 'locked_decision_imported' AS event, d AS subject FROM p UNION ALL SELECT d, k, 'override_created', o1 FROM p UNION ALL SELECT d, k, 'override_created', o2 FROM p
  UNION ALL SELECT d, k, 'identity_created', ii FROM p WHERE makes UNION ALL SELECT d, k, 'alias_created', ai FROM p WHERE makes)
SELECT * FROM r UNION ALL SELECT 'audit', {_row_sql("'audit'", 'event', 'subject')}, d, k, event, subject FROM e""")
def _(t):
    plan = t.authors.filter("identity_locked AND canonical_key IS NOT NULL").select(
        F.col("author_id").alias("target_key"), F.col("canonical_key").alias("canonical_identity_key"), "canonical_name", F.concat_ws(" ", "canonical_key", "canonical_name").alias("alias"))
    folder = work_folder(t.spark, "locked")
    M.materialize(plan, folder)
    return M.stored(t.spark, folder)


@query("ov32_discard", "SELECT role_id, 'discarded' AS scientific_status, canonical_key FROM v_roles WHERE validation_status = 'discarded'")
def _(t):
    return t.roles.filter("validation_status = 'discarded'").select("role_id", F.lit("discarded").alias("scientific_status"), "canonical_key")


@query("ov33_command_precondition", """
SELECT item_id, CASE WHEN automatic_priority % 5 = 0 THEN 'version_conflict' WHEN item_id % 7 = 0 THEN 'decision_conflict' WHEN case_status NOT IN ('pending', 'reopened') THEN 'incompatible_state' WHEN manual_priority = 3 THEN 'incompatible_status' ELSE 'accepted' END AS outcome FROM v_review_items""")
def _(t):
    rows = t.review_items.select(
        "item_id", "case_status", F.lit(2).alias("version"), F.when(F.col("automatic_priority") % 5 == 0, 1).otherwise(2).alias("expected_version"),
        F.when(F.col("item_id") % 7 == 0, F.lit("d")).alias("current_decision"), F.lit(None).cast("string").alias("expected_decision"),
        F.when(F.col("manual_priority") == 3, "validated").otherwise("pending").alias("scientific_status"))
    return rows.select("item_id", D.command_outcome().alias("outcome"))


@query("ov34_separated_key", "SELECT teacher_id, CASE WHEN teacher_id % 2 = 0 THEN concat('human:separated:', sha256(full_name)) ELSE concat('teacher:', teacher_id) END AS key FROM v_teachers")
def _(t):
    own = F.concat(F.lit("teacher:"), F.col("teacher_id").cast("string"))
    rows = t.teachers.select("teacher_id", own.alias("own_key"), F.when(F.col("teacher_id") % 2 == 0, own).otherwise("other").alias("counterpart_key"), F.lit("separated").alias("decision_type"), F.col("full_name").alias("target_key"))
    return D.duplicate_resolution(rows).select("teacher_id", F.col("result_key").alias("key"))


@query("ov35_identity_lookup", CASES + "SELECT i.item_id, ov.identity_key FROM v_review_items i JOIN ov ON ov.target_id = i.target_pk WHERE ov.identity_key IS NOT NULL")
def _(t):
    overlay = D.effective_overlay(_cases(t)).filter("identity_key IS NOT NULL").select(F.col("target_id").alias("target_pk"), "identity_key")
    return t.review_items.join(overlay, "target_pk").select("item_id", "identity_key")


@query("ov36_apply_assignments", ACCOUNTS + "SELECT user_id FROM v WHERE reason = 'eligible_for_insert' UNION SELECT user_id FROM h")
def _(t):
    _users, held, _plan = _accounts(t)
    return held.select("user_id").union(_assignments(t).filter("action = 'insert'").select("user_id")).distinct()


